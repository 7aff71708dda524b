"""The mail source through its format: against the JVM's reader, filters, splits, a stream with a restart."""

import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from postroom.sources import mail_source, maildir


@pytest.fixture
def tree(tmp_path):
    for name in ("doe-j/_sent_mail/1.", "doe-j/in box/deep/2+3.", "doe-j/50%/%41 [x].", "bob-x/é/1.", "bob-x/7.", "ann/.hidden/1.", "ann/.x", "top", ".secret/inbox/1."):
        f = tmp_path / "mail" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(name.encode() * 3)
    (tmp_path / "mail" / "empty").mkdir()
    for i in range(30):
        (tmp_path / "mail" / "bob-x" / f"{i:03d}.").write_bytes(b"%d" % i)
    mtime = time.time() - 100
    for d, _, names in os.walk(tmp_path):
        for n in names:
            os.utime(os.path.join(d, n), (mtime, mtime))
    return str(tmp_path / "mail")


def rows(df):
    return sorted(map(tuple, df.select("mailbox_key", "source_file", "relative_path", "length", "content").collect()))


@pytest.mark.parametrize("splits", [1, 3])
def test_same_rows_as_the_other_reader(spark, tree, splits):
    mail_source.register(spark)
    got = spark.read.format("mailtree").option("root", tree).option("splits", splits).load()
    assert rows(got) == rows(maildir.read_maildir(spark, tree)) and got.count() == 35
    assert got.rdd.getNumPartitions() == 4 * splits  # the mailboxes ann, bob-x, doe-j and empty
    few = spark.read.format("mailtree").option("maxFilesPerMailbox", 2).option("splits", splits).load("file:" + tree)
    assert rows(few) == rows(maildir.read_maildir(spark, tree, max_files=2))


def test_filters_leave_out_mailboxes(spark, tree, monkeypatch):
    mail_source.register(spark)
    df = spark.read.format("mailtree").option("root", tree).option("splits", 2).load()
    one = df.filter((F.col("mailbox_key") == "doe-j") & (F.col("length") > 0))
    assert one.rdd.getNumPartitions() == 2 and one.count() == 3
    assert df.filter(F.col("mailbox_key").isin("doe-j", "bob-x")).rdd.getNumPartitions() == 4
    assert df.filter("mailbox_key = 'none'").count() == 0
    reader = mail_source.MailReader({"root": tree, "splits": "1"})
    more = GreaterThan(("length",), 3)
    assert list(reader.pushFilters([EqualTo(("mailbox_key",), "ann"), more, In(("mailbox_key",), ("ann", "bob-x"))])) == [more]
    assert [p.mailbox for p in reader.partitions()] == ["ann"]


def test_roots_that_are_none(spark, tree):
    mail_source.register(spark)
    for root, text in ((tree + "/none", "FileNotFound"), (tree + "/top", "NotADirectory")):
        with pytest.raises(Exception, match=text):
            spark.read.format("mailtree").option("root", root).load().count()
    assert spark.read.format("mailtree").option("root", tree + "/empty").load().count() == 0


def test_stream_with_a_restart(spark, tree, tmp_path):
    """New files only, each once, over a restart from the checkpoint."""
    mail_source.register(spark)

    def run():
        source = spark.readStream.format("mailtree").option("root", tree).option("settle", "0.2").load()
        query = source.select("source_file", "mailbox_key").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        query.awaitTermination()
        return sorted(r.source_file.rsplit("/", 2)[-1] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert len(run()) == 35
    os.makedirs(tree + "/new-x/inbox")
    for name in ("new-x/inbox/1.", "bob-x/new."):
        with open(f"{tree}/{name}", "wb") as f:
            f.write(b"x")
    time.sleep(0.5)
    after = run()
    assert len(after) == 37 and "new." in after
    assert len(run()) == 37


def test_facts_are_held_by_pieces(spark, monkeypatch):
    """Arrow batches are bounded by bytes, and a worker makes the facts of some messages at a time."""
    from postroom.session import BATCH, ship
    from postroom.sources import mime

    ship(spark)
    assert 0 < int(spark.conf.get(BATCH[0])) <= 16 << 20
    monkeypatch.setattr(mime, "PIECE", 3)
    files = spark.createDataFrame([(i, f"Subject: s{i}\n\nbody".encode()) for i in range(10)], "i long, content binary").coalesce(1)
    assert sorted((r.i, r.headers["subject"][0]) for r in mime.parse(files).collect()) == [(i, f"s{i}") for i in range(10)]
    assert mime.parse(files.limit(0)).count() == 0
