"""Plans that read once: the dashboard, the counters of owners; texts ordered by collation."""

import random

import pytest
from pyspark.sql import functions as F

from postroom.operators import dashboard, ordering, owners, search
from postroom.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dashboard_reads_once_and_keeps_heads_in_the_tasks(spark):
    df = catalogue.dashboard_board(spark, SF)
    text = plan(df)
    assert text.count("FileScan parquet") == 1 and "props" not in text.split("ReadSchema")[1].split("\n")[0]
    assert text.count("WindowGroupLimit") == 2
    assert {r.section for r in df.collect()} == {"totals", "quality", "months", "senders", "domains", "hours", "weekdays", "attachments", "depths", "quoted"}


def test_board_equals_the_single_functions(spark):
    m = catalogue.mail(spark, SF).withColumns({"box": F.concat(F.lit("b"), (F.col("id") % 13).cast("string")), "folder": F.when(F.col("id") % 3 == 0, "in")})
    got = {}
    for r in dashboard.board(m, "box", "folder").collect():
        got.setdefault(r.section, []).append(r)
    ranked = lambda name: [(r.value, r.n) for r in sorted(got[name], key=lambda r: r.place)]
    for name, column in (("senders", "sender_email"), ("mailboxes", "box"), ("folders", "folder")):
        assert ranked(name) == [tuple(r) for r in dashboard.top(m, column).collect()]
    assert sorted((r.value, r.n, r.responses) for r in got["months"]) == [tuple(r) for r in dashboard.per_month(m, "is_response").collect()]
    one = dashboard.flag_counts(m).first().asDict()
    assert {r.value: (r.n, r.rate) for r in got["totals"] if r.value != "messages"} == {n: (one[n], one[f"{n}_rate"]) for n in ("with_parent", "parse_ok", "with_attachments", "responses", "forwards")}
    assert {r.value: r.n for r in got["quality"]} == dashboard.quality(m).first().asDict()
    assert dashboard.board(m.limit(0)).count() == 0


def headers(spark, seed, n=300):
    r = random.Random(seed)
    some = lambda *values: r.choice([None, *values])
    rows = [(f"box{r.randrange(3)}", i, "in", some("a.pst"), some("Ann", "Bo"), some("a@x", "b@x"), some("Ann", "Cy"), r.choice([None, [], ["Trader", "CEO"], ["CEO"]]), r.choice([None, [], [(None, "c@x"), ("Cy", "a@x"), ("Bo", None)]])) for i in range(n)]
    return spark.createDataFrame(rows, owners.HEADERS)


@pytest.mark.parametrize("seed", [1, 2])
def test_counters_equal_a_loop_and_parts_add_up(spark, seed):
    h = headers(spark, seed)
    want = {}

    def add(box, counter, a, b, at):
        if a is not None and (counter != "names" or b is not None):
            n, first = want.get((box, counter, a, b), (0, at))
            want[box, counter, a, b] = (n + 1, min(first, at))

    for r in h.collect():
        at = r.seq * 1000
        for counter, a, b, t in [("from_email", r.from_email, None, at), ("from_name", r.from_name, None, at), ("xfrom", r.x_from_name, None, at), ("x_filename", r.x_filename, None, at), ("emails", r.from_email, None, at), ("names", r.from_email, r.from_name, at), ("names", r.from_email, r.x_from_name, at + 1), *(("title", t, None, at) for t in r.titles or [])]:
            add(r.mailbox, counter, a, b, t)
        for i, c in enumerate(r.contacts or []):
            add(r.mailbox, "emails", c["email"], None, at + 2 + i)
            add(r.mailbox, "names", c["email"], c["name"], at + 2 + i)
    read = lambda df: {(r.mailbox, r.counter, r.a, r.b): (r.n, r["first"]) for r in df.collect()}
    assert read(owners.tagged_counts(h)) == want
    halves = [owners.tagged_counts(h.filter(F.col("seq") % 3 == k)) for k in range(3)]
    assert read(owners.merged_counts(*halves)) == want
    got = sorted(map(tuple, owners.infer_owners(h, "x", owners.merged_counts(*halves)).drop("all_emails").collect()), key=repr)
    assert got == sorted(map(tuple, owners.infer_owners(h, "x").drop("all_emails").collect()), key=repr)


def test_mail_is_parsed_once_for_all_counters(spark):
    """The Python node stands in one plan, that of the counts; the counters read what it left."""
    parsed = headers(spark, 3).mapInArrow(lambda batches: batches, owners.HEADERS)
    k = owners.counters(parsed)
    assert all("MapInArrow" not in plan(df) for df in k.values())
    assert plan(owners.tagged_counts(parsed)).count("MapInArrow") == 1


def test_collations(spark):
    words = ["b", "B", "á", "a", "A", "Z", None]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, i int")
    order = lambda *by: [r.w for r in df.orderBy(*by).collect()]
    assert order(ordering.asc("w")) == ["A", "B", "Z", "a", "b", "á", None]
    assert order(ordering.asc("w", "UNICODE")) == ["a", "A", "á", "b", "B", "Z", None]
    assert order(ordering.desc("w", "UNICODE")) == [None, "Z", "B", "b", "á", "A", "a"]
    m = catalogue.mail(spark, SF).limit(20).withColumn("sender_email", F.element_at(F.array(*map(F.lit, ("b", "B", "a", "A"))), (F.col("id") % 4 + 1).cast("int")))
    for collation, want in ((None, "A"), ("UNICODE", "a")):
        assert search.search_messages(m, search.SearchParameters(order="sender", collation=collation)).first().sender_email == want
