"""The stored index against the scan: answers, ranks, marks by stem, extension, what a query reads."""

import pytest
from pyspark.sql import functions as F

from postroom.operators import search, text_index
from postroom.operators.store import Store

SF = "/root/testdata/sf0.001/documents.parquet"
QUERIES = ["license software", '"licensed software"', "plain or runs", "software -runs", "-software", "public license", "the and of", "", "Runs runs RUN", "naïve ÉTÉ"]
TEXTS = [(1, "The licensed software runs"), (2, "software license, new: licensing"), (3, "plain words; été Été naïve"), (4, None), (5, ""), (6, "public (license) " * 300 + "license."), (7, "license_x licens licensee \U0001f600 license")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id long, body string")


@pytest.fixture(scope="module")
def store(spark, texts, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("index")), buckets=8)
    assert text_index.extend(s, texts.filter("id < 4"), "id", F.col("body"), "t", 0)
    assert text_index.extend(s, texts, "id", F.col("body"), "t", 1)
    return s


def plain(df):
    return sorted((r[0], round(r["rank"], 9)) for r in df.collect())


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("match", ["boolean", "any"])
def test_index_equals_scan(texts, store, query, match):
    assert plain(text_index.full_text(store, query, match=match)) == plain(search.full_text(texts, "id", F.coalesce("body", F.lit("")), query, match=match))


def test_index_equals_scan_on_documents(spark, tmp_path):
    d = spark.read.parquet(SF)
    s = Store(spark, str(tmp_path), buckets=8)
    text_index.extend(s, d, "doc_id", F.col("text"))
    for q in ("public license", '"software is provided"', "license or warranty -public"):
        want = plain(search.full_text(d, "doc_id", F.coalesce("text", F.lit("")), q))
        assert plain(text_index.full_text(s, q)) == want
    assert want


def test_marks_by_stem_and_not_by_leading_letters(texts, store):
    got = {r.id: r.headline for r in text_index.marked(store, texts, "id", F.col("body"), "license").collect()}
    assert got[2] == "software <mark><strong>license</strong></mark>, new: <mark><strong>licensing</strong></mark>"
    assert got[7] == "license_x licens licensee \U0001f600 <mark><strong>license</strong></mark>"
    assert got[3] is None and got[4] is None and got[6].count("<mark>") == 301
    scan = {r.id: r.h for r in texts.select("id", search.headline(F.col("body"), "license", []).alias("h")).collect()}
    assert all(scan[i] == (got[i] if got[i] is not None else dict(TEXTS)[i]) for i in got)


def test_extension_keeps_what_is_there(spark, texts, store):
    version = store.version
    assert not text_index.extend(store, texts, "id", F.col("body"), "t", 1) and store.version == version
    # the same keys with other texts: they stay as they were indexed first
    assert text_index.extend(store, texts.withColumn("body", F.lit("zebra")), "id", F.col("body"), "t", 2)
    assert text_index.full_text(store, "zebra").count() == 0
    assert text_index.extend(store, spark.createDataFrame([(9, "zebra"), (None, "zebra"), (9, "zebra")], "id long, body string").dropDuplicates(), "id", F.col("body"), "t", 3)
    assert [r[0] for r in text_index.full_text(store, "zebras").collect()] == [9]
    assert text_index.lookup(store, ["zebras", "licensing"]) == [("zebra", 1), ("licens", 4)]
    assert {r.stem: (r.texts, r.words) for r in text_index.dictionary(store).collect()}["licens"] == (4, 305)


def test_a_query_reads_its_stems_only(store, monkeypatch):
    read = []
    real = Store.read
    monkeypatch.setattr(Store, "read", lambda self, name, buckets=None: read.append((name, buckets)) or real(self, name, buckets))
    df = text_index.postings(store, ["licens"])
    assert [(n, len(b)) for n, b in read] == [("postings", 1)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "In(stem, [licens])" in plan or "EqualTo(stem,licens)" in plan


def test_a_worker_holds_few_postings(monkeypatch):
    """A batch of many texts gives many small batches of postings, with the same rows."""
    import pyarrow as pa

    texts = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([f"one two{i % 7} one three" for i in range(299)] + [""])], ["key", "text"])
    whole = list(text_index._words(True, frozenset())(iter([texts])))
    monkeypatch.setattr(text_index, "HELD", 40)
    small = list(text_index._words(True, frozenset())(iter([texts])))
    assert max(b.num_rows for b in small) <= 30
    assert [r for b in small for r in b.to_pylist()] == [r for b in whole for r in b.to_pylist()]
    assert {"key": 7, "stem": "one", "pos": [1, 2], "start": [0, 9], "len": [3, 3]} in whole[0].to_pylist()
