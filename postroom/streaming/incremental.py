"""Incremental import: new files of a tree as a stream of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.operators.store import Store
from postroom.operators.validation import validate
from postroom.plans.importer import apply_batch
from postroom.plans.normalize import messages
from postroom.sources.mime import parse


def stream_maildir(spark: SparkSession, root: str, depth: int = 2, files_per_batch: int | None = None) -> DataFrame:
    """A streaming DataFrame of the files in the directories ``depth`` levels under ``root``.

    The glob names these levels, so folders that start with "_" are read; hidden
    files and folders are left out.
    """
    tail = root.split(":", 1)[-1].strip("/")
    files = spark.readStream.format("binaryFile")
    files = files if files_per_batch is None else files.option("maxFilesPerTrigger", files_per_batch)
    files = files.schema("path string, modificationTime timestamp, length bigint, content binary").load(root.rstrip("/") + "/*" * depth)
    below = F.substr("path", F.locate(tail, "path") + F.lit(len(tail) + 1))
    out = files.select(below.alias("below"), F.col("path").alias("source_file"), "length", "content").filter(~F.col("below").rlike(r"(^|/)\."))
    return out.select(F.substring_index("below", "/", 1).alias("mailbox_key"), "source_file", F.regexp_replace("below", "^[^/]*/", "").alias("relative_path"), "length", "content")


def run_incremental(spark: SparkSession, root: str, out: str, checkpoint: str, depth: int = 2) -> None:
    """Append the parsed form of files that were not seen before; each file exactly once."""
    rows = validate(messages(parse(stream_maildir(spark, root, depth))))
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_import(spark: SparkSession, root: str, out: str, checkpoint: str, depth: int = 2, persist_invalid: bool = False, organisation: str | None = None, files_per_batch: int | None = None) -> Store:
    """Import the files of a tree that were not seen before into the tables of the store at ``out``.

    Each micro-batch is one version of all tables.  A batch that was cut off is run again
    from its files; one that was published, but not noted by the stream, is known by its number.
    """
    store = Store(spark, f"{out}/store")

    def take(files: DataFrame, batch: int) -> None:
        place = f"{out}/parsed/{batch:012d}"
        validate(messages(parse(files), organisation)).write.mode("overwrite").parquet(place)
        apply_batch(store.refresh(), spark.read.parquet(place), source=checkpoint, batch=batch, persist_invalid=persist_invalid)

    rows = stream_maildir(spark, root, depth, files_per_batch)
    rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return store.refresh()


def mail_counts(rows: DataFrame, watermark: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Messages per sender and window of a stream of messages; late ones count within the watermark."""
    return rows.withWatermark("sent_at", watermark).groupBy(F.window("sent_at", window), "sender_email").agg(F.count(F.lit(1)).alias("n"))
