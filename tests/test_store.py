"""Versioned tables: incremental import against one import, cut off between tables, repeated, restarted."""

import random

import pytest
from pyspark.sql import functions as F

from postroom.operators.store import Store
from postroom.plans import importer
from postroom.streaming import incremental

BODY = "Message-ID: <{i}@x>\r\nFrom: {who}\r\nTo: {to}\r\nDate: Mon, 14 May 2001 1{t}:39:00 -0700\r\nSubject: {s}\r\n{h}\r\nHi {i}\r\n"


def tree(root, seed=1, n=36):
    """Files whose names are in the order of their arrival; some are copies of earlier ones under another name."""
    r = random.Random(seed)
    made = []
    for i in range(n):
        k = r.choice(made) if made and r.random() < 0.3 else i
        made.append(k)
        q = random.Random(k)
        who = q.choice(["jane@corp.com", '"Jane Doe" <jane@corp.com>', "Al <al@ext.org>", "bo@ext.org"])
        text = BODY.format(i=k, who=who, to=q.choice(["bo@ext.org", '"Bo" <bo@ext.org>, x@y.org', "al@ext.org"]), t=q.randrange(10), s=q.choice(["Hello", "Re: Hello"]), h=q.choice(["", f"In-Reply-To: <{q.randrange(9)}@x>\r\nReferences: <a@x> <b@x>\r\n"]))
        f = root / f"box-{i // 12}" / q.choice(["inbox", "_sent"]) / f"{i:03d}."
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(text.encode())
    return str(root)


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    root = tree(tmp_path_factory.mktemp("mail"))
    out = str(tmp_path_factory.mktemp("whole"))
    importer.import_maildir(spark, root, out)
    return out, spark.read.parquet(f"{out}/parsed")


def rows(tables):
    return {n: sorted(map(repr, (r.asDict(True) for r in df.select(*sorted(df.columns)).collect()))) for n, df in tables.items()}


def of(store):
    return {n: store.read(n) for n in store.tables}


def batches(parsed, n):
    at = F.regexp_extract("source_file", r"(\d+)\.$", 1).cast("int")
    return [parsed.filter(F.floor(at / (36 / n)) == k) for k in range(n)]


def test_batches_equal_one_import(spark, parsed, tmp_path):
    out, every = parsed
    store = Store(spark, str(tmp_path), buckets=4)
    for k, part in enumerate(batches(every, 3)):
        assert importer.apply_batch(store, part, "test", k)
    assert store.version == 3 and rows(of(store)) == rows(importer.read_tables(spark, out))
    before = rows(of(store))
    assert store.compact("message", most=1) and store.vacuum() > 0 and not store.compact("message", most=1)
    assert rows(of(Store(spark, str(tmp_path)))) == before


def test_a_batch_cut_off_between_tables(spark, parsed, tmp_path, monkeypatch):
    first, second = batches(parsed[1], 2)
    store = Store(spark, str(tmp_path), buckets=4)
    importer.apply_batch(store, first, "test", 0)
    before, real, calls = rows(of(store)), Store.stage, []

    def fails(self, *args, **more):
        calls.append(args[0])
        if len(calls) == 5:
            raise OSError("killed")
        return real(self, *args, **more)

    monkeypatch.setattr(Store, "stage", fails)
    with pytest.raises(OSError, match="killed"):
        importer.apply_batch(store, second, "test", 1)
    monkeypatch.undo()
    again = Store(spark, str(tmp_path))
    assert again.version == 1 and rows(of(again)) == before and rows(of(store)) == before
    assert importer.apply_batch(again, second, "test", 1)
    assert rows(of(again)) == rows(importer.read_tables(spark, parsed[0]))


def test_the_same_batch_twice(spark, parsed, tmp_path):
    first, second = batches(parsed[1], 2)
    store = Store(spark, str(tmp_path), buckets=4)
    for k, part in ((0, first), (1, second)):
        importer.apply_batch(store, part, "test", k)
    before, version = rows(of(store)), store.version
    assert not importer.apply_batch(store, second, "test", 1) and store.version == version
    # under another name it is a batch like any other, which finds all its rows there
    assert importer.apply_batch(store, second, "other", 1) and rows(of(store)) == before


def test_two_writers(spark, parsed, tmp_path):
    one = Store(spark, str(tmp_path), buckets=2)
    other = Store(spark, str(tmp_path), buckets=2)
    importer.apply_batch(one, batches(parsed[1], 2)[0])
    with pytest.raises(RuntimeError, match="another writer"):
        importer.apply_batch(other, batches(parsed[1], 2)[1])
    assert Store(spark, str(tmp_path)).version == 1


def test_old_tables_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Only the buckets and the key column that a batch needs are read, and no exchange stands over them."""
    store = Store(spark, str(tmp_path), buckets=8)
    new = spark.range(0, 1000).select(F.col("id").cast("string").alias("k"), F.lit("a").alias("v"))
    t, _ = store.merged("t", new, ["k"])
    store.publish({"t": t}, {})
    plans = []
    real = Store.read
    monkeypatch.setattr(Store, "read", lambda self, name, buckets=None: plans.append(buckets) or real(self, name, buckets))
    more = spark.createDataFrame([("5", "b"), ("1001", "b")], "k string, v string")
    t, created = store.merged("t", more, ["k"], {"v": F.col("new.v")})
    assert all(len(b) <= 2 for b in plans) and [r.k for r in created.collect()] == ["1001"]
    store.publish({"t": t}, {})
    got = {r.k: r.v for r in store.read("t").collect()}
    assert len(got) == 1001 and got["5"] == got["1001"] == "b" and got["6"] == "a"
    keys = more.select("k")
    plan = real(store, "t", [1]).select("k").join(F.broadcast(keys), "k", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "ReadSchema: struct<k:string>" in plan


def test_stream_of_batches_and_a_restart(spark, tmp_path, monkeypatch):
    root = tree(tmp_path / "mail", n=24)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    real, calls = importer.apply_batch, []

    def dies(store, *args, **more):
        done = real(store, *args, **more)
        calls.append(done)
        if len(calls) == 2:
            raise OSError("killed after its version was published")
        return done

    monkeypatch.setattr(incremental, "apply_batch", dies)
    with pytest.raises(Exception, match="killed"):
        incremental.run_import(spark, root, out, checkpoint, files_per_batch=9)
    store = incremental.run_import(spark, root, out, checkpoint, files_per_batch=9)
    assert calls == [True, True, False, True] and store.version == 3
    assert store.read("message_occurrence").count() == 24
    whole = importer.import_maildir(spark, root, str(tmp_path / "whole"))
    assert store.read("message").count() == whole.report.first().messages_created
    version = store.version
    assert incremental.run_import(spark, root, out, checkpoint).version == version
