"""Operators against brute force and small corpora; the import from end to end."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postroom.operators import aliases, reports, search, tables, threads, views
from postroom.plans import importer


def corpus(seed, n=60):
    r = random.Random(seed)
    start = datetime(2001, 1, 1)
    rows, refs = [], []
    for i in range(n):
        at = None if r.random() < 0.1 else start + timedelta(hours=r.randrange(0, 24 * 40))
        mid = None if r.random() < 0.05 else f"<{r.randrange(n) if r.random() < 0.1 else i}>"
        rows.append((i, mid, f"u{r.randrange(4)}", at, r.choice(["x", "y", None]), [f"u{r.randrange(4)}"], r.choice([None, None, f"<{r.randrange(n)}>"]), r.choice([None, None, f"<{r.randrange(n + 5)}>"]), r.random() < 0.6, r.random() < 0.2))
        if r.random() < 0.2:
            refs += [(i, k, f"<{r.randrange(n + 10)}>") for k in range(r.randrange(1, 4))]
    return rows, refs


def pass_over(rows, refs):
    """Row at a time: newest first, undated before, writing into the rows as it goes."""
    keys = ("id", "mid", "sender", "at", "subject", "to", "root", "reply", "is_response", "is_forward")
    m = [dict(zip(keys, x, strict=True)) for x in rows]
    order = sorted(m, key=lambda x: (x["at"] is not None, -(x["at"] - datetime(1970, 1, 1)).total_seconds() if x["at"] else 0, x["id"]))
    by_id = {}
    for x in order:
        if x["mid"]:
            by_id[x["mid"]] = x
    of = {}
    for i, k, ref in sorted(refs):
        of.setdefault(i, []).append(ref)
    out = {}
    for x in order:
        hits = [y for y in of.get(x["id"], []) if y in by_id]
        if hits:
            res = ("references", hits[-1], hits[0], len(hits))
        elif x["reply"] in by_id:
            p = by_id[x["reply"]]
            res = ("in_reply_to", p["mid"], p["root"] or p["mid"], 1)
        else:
            best = None
            if x["subject"] and x["at"] and x["is_response"] and not x["is_forward"]:
                for c in sorted((c for c in m if c["at"] and c["subject"] == x["subject"] and c["id"] != x["id"] and c["mid"] and c["at"] < x["at"] and c["at"] >= x["at"] - timedelta(days=30)), key=lambda c: (c["at"], c["id"])):
                    age = (x["at"] - c["at"]).total_seconds()
                    score = 45 + 25 * (c["sender"] in x["to"]) + 20 * (x["sender"] in c["to"]) + (10 if age <= 3600 else 6 if age <= 86400 else 3 if age <= 7 * 86400 else 0)
                    if best is None or score > best[0]:
                        best = (score, c)
            if best:
                res = ("heuristic", best[1]["mid"], best[1]["root"] or best[1]["mid"], 1)
            elif x["mid"]:
                res = ("self_rooted", None, x["mid"], 0)
            else:
                res = ("unresolved", None, None, 0)
        x["root"] = res[2]
        out[x["id"]] = res
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_threads_equal_a_pass_over_rows(spark, seed):
    rows, refs = corpus(seed)
    m = spark.createDataFrame(rows, "id long, message_id string, sender string, sent_at timestamp, subject string, recipients array<string>, root string, in_reply_to string, is_response boolean, is_forward boolean")
    r = spark.createDataFrame(refs, "id long, pos int, reference string")
    got = {x.id: (x.kind, x.parent, x.root_id, x.depth) for x in threads.resolve_threads(m, r).collect()}
    assert got == pass_over(rows, refs)


def brute_candidates(rows, days):
    out = {}
    for i, _, sender, at, subject, to, _, _, response, forward in rows:
        best = None
        for c, mid, c_sender, c_at, c_subject, c_to, *_ in rows:
            if subject and at and response and not forward and c != i and mid and c_at and c_subject == subject and at - timedelta(days=days) <= c_at < at:
                age = (at - c_at).total_seconds()
                score = 45 + 25 * (c_sender in (to or ()) and c_sender is not None) + 20 * (sender in (c_to or ()) and sender is not None) + (10 if age <= 3600 else 6 if age <= 86400 else 3 if age <= 7 * 86400 else 0)
                best = max(best, (score, -c_at.timestamp(), -c)) if best else (score, -c_at.timestamp(), -c)
        if best:
            out[i] = (-best[2], best[0])
    return out


@pytest.mark.parametrize(("seed", "days", "bucket"), [(1, 30, 86_400), (2, 30, 600), (3, 3, 86_400), (4, 1, 40_000_000), (5, 40, 7200)])
def test_candidates_equal_all_pairs(spark, monkeypatch, seed, days, bucket):
    """Buckets from minutes to years; bounds of bands and look-back to the second; ties, nulls, several recipients."""
    monkeypatch.setattr(threads, "BUCKET", bucket)
    r = random.Random(seed)
    start, people = datetime(2001, 1, 1), ["a", "b", "c", "d", None]
    steps = [0, 1, 3599, 3600, 3601, 86400, 86401, 7 * 86400, 30 * 86400, 30 * 86400 + 1]
    rows = []
    for i in range(240):
        at = None if r.random() < 0.05 else start + timedelta(seconds=r.choice(steps) + r.choice(steps) + 43200 * r.randrange(0, 20), microseconds=r.choice([0, 0, 1]))
        rows.append((i, None if r.random() < 0.1 else f"<{i}>", r.choice(people), at, r.choice(["x", "y", "", None]), r.choice([None, [], [r.choice(people), r.choice(people), r.choice(people)]]), None, None, r.random() < 0.7, r.random() < 0.1))
    m = spark.createDataFrame(rows, "id long, message_id string, sender string, sent_at timestamp, subject string, recipients array<string>, root string, in_reply_to string, is_response boolean, is_forward boolean")
    got = {x.id: (x.parent_id, x.score) for x in threads.scored_candidates(m, days).collect()}
    assert got == brute_candidates(rows, days) and len({s for _, s in got.values()}) > 6


@pytest.mark.parametrize(("seed", "group"), [(6, 1), (7, 20), (8, 1000)])
def test_candidates_by_rows_and_in_groups(spark, monkeypatch, seed, group):
    """All subjects by rows, the busy ones by rows and the others in groups, all in groups: equal to all pairs."""
    monkeypatch.setattr(threads, "GROUP", group)
    r = random.Random(seed)
    start, people = datetime(2001, 1, 1), ["a", "b", "c", "d", None]
    rows = []
    for i in range(240):
        at = None if r.random() < 0.05 else start + timedelta(seconds=r.choice([0, 1, 3600, 86400, 7 * 86400, 30 * 86400]) + 43200 * r.randrange(0, 20))
        subject = r.choice(["x", "x", "x", "y", f"z{i % 7}", "", None])
        rows.append((i, None if r.random() < 0.1 else f"<{i}>", r.choice(people), at, subject, r.choice([None, [], [r.choice(people), r.choice(people), r.choice(people)]]), None, None, r.random() < 0.7, r.choice([False, False, False, True, None])))
    m = spark.createDataFrame(rows, "id long, message_id string, sender string, sent_at timestamp, subject string, recipients array<string>, root string, in_reply_to string, is_response boolean, is_forward boolean")
    found = threads.scored_candidates(m)
    rows = [x if x[-1] is not None else (*x[:-1], True) for x in rows]  # what is not known to be no forward does not ask
    assert {x.id: (x.parent_id, x.score) for x in found.collect()} == brute_candidates(rows, 30)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("Generate" in plan) == (group < 1000) and "FlatMapGroupsInArrow" in plan


def test_candidates_shuffle_a_message_once(spark):
    """No rows for windows and keys: the shuffle to the groups has as many rows as there are messages."""
    start = datetime(2001, 1, 1)
    rows = [(i, f"<{i}>", f"u{i % 5}", start + timedelta(hours=i), f"s{i % 4}", ["u1", "u2", "u3"], None, None, True, False) for i in range(200)]
    m = spark.createDataFrame(rows, "id long, message_id string, sender string, sent_at timestamp, subject string, recipients array<string>, root string, in_reply_to string, is_response boolean, is_forward boolean")
    plan = threads.scored_candidates(m)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan and "Window" not in plan and "Union" not in plan


def test_rows_without_a_key_are_not_shuffled(spark):
    rows = spark.createDataFrame([(i, None if i % 4 else f"k{i % 3}") for i in range(40)], "id long, key string")
    other = spark.createDataFrame([("k0", 7), ("k1", 8)], "own string, found int")
    got = threads._left(rows, other, "key", "own")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.join(other, rows["key"] == other["own"], "left").drop("own").collect()), key=str)
    plan = threads._left(rows, other.hint("merge"), "key", "own")._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(key" in plan.split("Exchange")[1] and plan.count("Exchange") == 2


def test_candidates_of_a_busy_subject_make_no_pairs(spark):
    """3000 messages of one subject within an hour: 4.5 million pairs, of which none is made."""
    start = datetime(2001, 1, 1)
    rows = [(i, f"<{i}>", f"u{i % 3}", start + timedelta(seconds=i), "x", [f"u{(i + 1) % 3}"], None, None, True, False) for i in range(3000)]
    m = spark.createDataFrame(rows, "id long, message_id string, sender string, sent_at timestamp, subject string, recipients array<string>, root string, in_reply_to string, is_response boolean, is_forward boolean")
    found = threads.scored_candidates(m)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan  # the one that names the parent
    got = {x.id: x.parent_id for x in found.collect()}
    assert len(got) == 2999 and got[2500] == 2 and got[1] == 0


def test_circles_and_long_chains(spark):
    """A circle of five with tails, two messages that answer each other, one that answers itself, a chain of 300."""
    up = {1: 2, 2: 3, 3: 4, 4: 5, 5: 1, 6: 1, 7: 6, 20: 21, 21: 20, 30: 30} | {i: i - 1 for i in range(101, 400)}
    start = datetime(2001, 1, 1)
    rows = [(i, f"<{i}>", "u", None if i in (5, 20) else start + timedelta(days=(i * 7) % 5), None, [], None, f"<{up[i]}>" if i in up else None, False, False) for i in [*up, 100]]
    m = spark.createDataFrame(rows, "id long, message_id string, sender string, sent_at timestamp, subject string, recipients array<string>, root string, in_reply_to string, is_response boolean, is_forward boolean")
    none = spark.createDataFrame([], "id long, pos int, reference string")
    got = {x.id: x.root_id for x in threads.resolve_threads(m, none, mode="fixpoint").collect()}
    assert {got[i] for i in range(1, 8)} == {"<3>"} and got[20] == got[21] == "<21>" and got[30] == "<30>"
    assert {got[i] for i in range(100, 400)} == {"<100>"}
    with pytest.raises(ValueError, match="rounds"):
        threads.resolve_threads(m, none, mode="fixpoint", rounds=4)


@pytest.mark.parametrize("seed", [1, 4])
def test_updates_equal_a_full_resolution(spark, tmp_path, seed):
    """Random splits of a corpus with repeated ids, circles and late parents, batch after batch."""
    rows, refs = corpus(seed, 80)
    schema = "id long, message_id string, sender string, sent_at timestamp, subject string, recipients array<string>, root string, in_reply_to string, is_response boolean, is_forward boolean"
    m, r = spark.createDataFrame(rows, schema).drop("root").withColumn("root", F.lit(None).cast("string")), spark.createDataFrame(refs, "id long, pos int, reference string")
    share = random.Random(seed)
    when = spark.createDataFrame([(x[0], share.choice([0, 0, 0, 1, 2])) for x in rows], "id long, k int").cache()
    from postroom.operators.store import Store

    store = Store(spark, str(tmp_path), buckets=8)
    for k in range(3):
        now = when.filter(F.col("k") <= k)
        some, named = m.join(now, "id", "left_semi"), r.join(now, "id", "left_semi")
        assert threads.store_update(store, some, named, when.filter(F.col("k") == k), "t", k)
        assert sorted(map(tuple, store.read("resolution").collect())) == sorted(map(tuple, threads.resolve_threads(some, named, mode="fixpoint").collect()))
    assert not threads.store_update(store, m, r, when, "t", 2)
    before = store.tables["resolution"].folders
    threads.store_update(store, m, r, when.filter("id = 3"), "t", 3)  # nothing new: no bucket is rewritten
    assert store.tables["resolution"].folders == before


def test_fixpoint_changes_nothing_the_second_time(spark):
    rows, refs = corpus(5)
    schema = "id long, message_id string, sender string, sent_at timestamp, subject string, recipients array<string>, root string, in_reply_to string, is_response boolean, is_forward boolean"
    m, r = spark.createDataFrame(rows, schema), spark.createDataFrame(refs, "id long, pos int, reference string")
    one = threads.resolve_threads(m, r, mode="fixpoint")
    again = threads.resolve_threads(m.drop("root").join(one.select("id", F.col("root_id").alias("root")), "id"), r, mode="fixpoint")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, again.select(*one.columns).collect()))


def test_porter2():
    words = {"caresses": "caress", "ponies": "poni", "running": "run", "hopping": "hop", "hoping": "hope", "generalization": "general", "relational": "relat", "happily": "happili", "licensed": "licens", "skies": "sky", "cry": "cri", "by": "by"}
    assert {w: search.stem(w) for w in words} == words


def test_full_text(spark):
    d = spark.createDataFrame([(1, "The licensed software runs"), (2, "software license, new"), (3, "plain words"), (4, None)], "k int, t string")
    hit = lambda q, **o: sorted(r.k for r in search.full_text(d, "k", F.coalesce("t", F.lit("")), q, **o).collect())
    assert hit("license software") == [1, 2]
    assert hit('"licensed software"') == [1]
    assert hit("plain or runs") == [1, 3]
    assert hit("software -runs") == [2]
    assert hit("-software") == [3, 4]
    ranks = {r.k: r["rank"] for r in search.full_text(d, "k", F.coalesce("t", F.lit("")), "license software", match="any").collect()}
    assert ranks[1] > 1e-3 and ranks[3] == pytest.approx(1e-20)
    assert d.select(search.headline(F.col("t"), "license", []).alias("h")).first().h == "The <mark><strong>licensed</strong></mark> software runs"


def test_tables_keep_the_first_and_the_last(spark):
    rows = [("b", "b/1", "h1", "late", "in", None), ("a", "a/1", "h1", "early", "in", "Inbox"), ("a", "a/2", "h2", "x", "in", "Later")]
    df = spark.createDataFrame(rows, "mailbox_key string, source_file string, canonical_hash string, subject string, folder_path string, folder_name string")
    assert {r.canonical_hash: r.subject for r in tables.messages_of(df).collect()} == {"h1": "early", "h2": "x"}
    f = tables.folders_of(df.withColumns({"folder_type": F.col("source_file"), "folder_topic": F.lit(None).cast("string")}))
    assert sorted(map(tuple, f.collect())) == [("a", "in", "Later", "a/2", None), ("b", "in", "in", "b/1", None)]


def test_contested_alias_goes_to_the_lowest_score(spark):
    c = spark.createDataFrame([("a", "x@y", 80.0, "strong_alias"), ("b", "x@y", 71.0, "strong_alias"), ("gone", "x@y", 70.0, "strong_alias")], "mailbox_owner string, candidate_email string, final_alias_score double, alias_label string")
    people = spark.createDataFrame([("a",), ("b",)], "employee_key string")
    mails = spark.createDataFrame([("x@y", None)], "email string, employee_key string")
    linked, stats = aliases.link_aliases(c, people, mails)
    assert linked.first().employee_key == "b" and stats.first().missing_collaborators == 1
    assert aliases.link_aliases(c, people, mails, best_score_wins=True)[0].first().employee_key == "a"


def test_search_parameters(spark):
    with pytest.raises(ValueError):
        search.facet_filter(spark.range(1).withColumn("sent_at", F.current_timestamp()), search.SearchParameters(sent_from="no date"))
    m = spark.createDataFrame([("100%_A", 1), ("b", 9)], "sender_email string, attachment_count int")
    assert search.facet_filter(m, search.SearchParameters(sender="%_a")).count() == 1
    assert search.facet_filter(m, search.SearchParameters(attachment_count=("x", "3"))).count() == 1


MESSAGE = "Message-ID: <{i}@x>\r\nDate: Mon, 14 May 2001 16:39:00 -0700 (PDT)\r\nFrom: Jane Doe <jane.doe@corp.com>\r\nTo: bob@corp.com,\r\n\t\"X, Al\" <al@ext.org>\r\nSubject: {s}\r\nX-FileName: jdoe (Non-Privileged).pst\r\n{h}\r\n{b}"
MULTIPART = "Message-ID: <5@x>\nFrom: bob@corp.com\nSubject: f\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/html\n\n<p>Hi &amp; bye</p><script>x</script>\n--b\nContent-Type: application/pdf; name=a.pdf\nContent-Disposition: attachment; filename=a.pdf\n\nabc\n--b--\n"


@pytest.fixture(scope="module")
def maildir(tmp_path_factory):
    root = tmp_path_factory.mktemp("mail")

    def put(path, content):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content if isinstance(content, bytes) else content.encode())

    put("doe-j/_sent_mail/1.", MESSAGE.format(i=1, s="Hello", h="", b="Hi there\r\n\r\n--\r\nJane Doe\r\n"))
    put("doe-j/inbox/1.", MESSAGE.format(i=2, s="Re: Hello", h="In-Reply-To: <1@x>\r\nReferences: <0@x> <1@x>\r\n", b="> Hi there\r\nok"))
    put("bob-x/all_documents/sub/1.", MESSAGE.format(i=9, s="Hello", h="", b="Hi there\r\n\r\n--\r\nJane Doe\r\n"))
    put("bob-x/inbox/2.", b"\xff\xfe broken")
    put("bob-x/inbox/3.", MULTIPART)
    put("bob-x/.hidden/1.", "x")
    put("bob-x/.x", "x")
    put("top-level", "x")
    return str(root)


def test_import_end_to_end(spark, maildir, tmp_path):
    done = importer.import_maildir(spark, maildir, str(tmp_path))
    t = importer.read_tables(spark, str(tmp_path))
    assert {n: df.count() for n, df in t.items()} == {"mailbox": 2, "folder": 4, "email_address": 3, "message": 4, "message_recipient": 4, "message_reference": 2, "attachment": 1, "message_occurrence": 5}
    assert done.report.first().messages_existing == 1
    m = {r.message_id: r for r in t["message"].collect()}
    assert "<1@x>" not in m  # the copy in bob-x comes first
    assert m["<9@x>"].body_clean == "Hi there" and m["<9@x>"].signature == "--\nJane Doe"
    assert m["<2@x>"].response_to_message_id == "<1@x>" and m["<2@x>"].thread_root_message_id == "<0@x>" and m["<2@x>"].quoted_line_count == 1
    assert m["<5@x>"].body_clean == "Hi & bye" and m["<5@x>"].attachment_count == 1
    assert str(m["<2@x>"].sent_at) == "2001-05-14 23:39:00"
    key = m["<2@x>"].canonical_hash
    detail = views.message_detail(t, key)
    assert detail["recipients"]["to"] == ["bob@corp.com", "al@ext.org"] and detail["references"] == ["<0@x>", "<1@x>"]
    with pytest.raises(views.NotFound):
        views.message_detail(t, "none")
    assert importer.read_maildir(spark, maildir, max_files=1).count() == 2
    with pytest.raises(FileNotFoundError):
        importer.read_maildir(spark, maildir + "/none")


def test_owners_and_reports(spark, maildir, tmp_path):
    o = importer.owners_of_maildir(spark, maildir, "corp.com").cache()
    top = {r.mailbox_owner: r for r in o.collect()}["doe-j"]
    assert (top.inferred_primary_email, top.inferred_display_name, top.owner_confidence_label, top.message_count) == ("jane.doe@corp.com", "Jane Doe", "high", 2)
    from postroom.operators.owners import owner_summary

    reports.save_report(o, owner_summary(o), reports.owner_tables(o), str(tmp_path / "r"), root=maildir)
    rows, summary, manifest = reports.load_report(spark, str(tmp_path / "r"))
    assert rows.count() == 2 and summary.first().row_count == 2 and manifest["root"] == maildir


def test_incremental_import_takes_each_file_once(spark, maildir, tmp_path):
    from postroom.streaming.incremental import run_incremental

    for _ in range(2):
        run_incremental(spark, maildir, str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(f"{r.mailbox_key}/{r.relative_path}" for r in rows) == ["bob-x/inbox/2.", "bob-x/inbox/3.", "doe-j/_sent_mail/1.", "doe-j/inbox/1."]


def test_search_reads_whole_texts(spark, tmp_path):
    """What stands behind 200000 characters is found, ranked and shown."""
    from postroom.plans import catalogue

    far = "filler " * 30_000
    rows = [(1, far + "worthless license of the public license"), (2, far)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: catalogue.queries()[name](spark, str(tmp_path)).collect()
    assert [x.doc_id for x in run("search_boolean")] == [1]
    assert [x.doc_id for x in run("search_rank")] == [1]
    assert [(x.doc_id, "<mark>" in x.headline) for x in run("search_headline")] == [(1, True)]


def test_search_page_with_text_and_facets(spark):
    from datetime import datetime

    from postroom.operators.search import SearchParameters, search_messages

    rows = [(1, "<a@t>", "plan", "the pipeline plan for gas pipelines", "<r@t>"), (2, "<b@t>", "gas", "pipeline", "<r@t>"), (3, "<c@t>", None, "nothing of it", "<r@t>"), (4, "<d@t>", "pipeline", None, "<s@t>"), (5, "<e@t>", None, None, None)]
    m = spark.createDataFrame([(i, k, s, b, r, datetime(2024, 1, i)) for i, k, s, b, r in rows], "id long, message_id string, subject_normalized string, body_clean string, in_reply_to string, sent_at timestamp")
    page = search_messages(m, SearchParameters(q="pipelines")).collect()
    assert [r.id for r in page] == [1, 4, 2]
    assert page[0].rank > page[1].rank == page[2].rank > 0
    assert page[2].headline_body == "<mark><strong>pipeline</strong></mark>"
    assert page[1].headline_subject == "<mark><strong>pipeline</strong></mark>" and page[1].headline_body is None
    assert [r.id for r in search_messages(m, SearchParameters(q="pipelines", in_reply_to="R@", order="sent_at")).collect()] == [1, 2]
    assert [r.id for r in search_messages(m, SearchParameters(order="what")).collect()] == [5, 4, 3, 2, 1]
    assert search_messages(m, SearchParameters(q="zebra")).count() == 0


def test_rebuild_writes_places_and_counts_changes(spark):
    from postroom.operators.threads import rebuild, rebuild_stats

    old = spark.createDataFrame([(1, None, None, "<a>", 0), (2, None, None, None, 0), (3, "<x>", "in_reply_to", "<x>", 1)], "id long, response_to_message_id string, response_to_message_id_source string, thread_root_message_id string, references_depth int")
    new = spark.createDataFrame([(1, "self_rooted", None, "<a>", 0), (2, "heuristic", "<a>", "<a>", 1)], "id long, kind string, parent string, root_id string, depth int")
    got = {r.id: r for r in rebuild(old, new).collect()}
    assert [got[i].updated for i in (1, 2, 3)] == [False, True, False]
    assert (got[2].response_to_message_id, got[2].response_to_message_id_source, got[2].references_depth) == ("<a>", "heuristic_subject_time_participants", 1)
    assert got[3].response_to_message_id == "<x>"
    assert rebuild_stats(rebuild(old, new)).first().updated_messages == 1
    # a second run changes nothing
    assert not rebuild(rebuild(old, new).drop("updated", "kind"), new).filter("updated").count()
