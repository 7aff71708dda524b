"""Mailbox directory trees as DataFrames of raw files.

The driver lists directories, not files, through Hadoop's file system, so any
store that Spark reads will do; Spark then lists and reads the files in
parallel.  Directories are named one by one because Spark's own recursive
listing leaves out names that start with "_", such as ``_sent_mail``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "mailbox_key string, source_file string, relative_path string, length bigint, content binary"


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _children(fs, path) -> list:
    found = [s for s in fs.listStatus(path) if not s.getPath().getName().startswith(".")]
    return sorted(found, key=lambda s: s.getPath().getName())


def mailboxes(spark: SparkSession, root: str, max_mailboxes: int | None = None) -> list[str]:
    """Names of the first-level directories that are not hidden, in order."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        raise FileNotFoundError(root)
    if not fs.getFileStatus(path).isDirectory():
        raise NotADirectoryError(root)
    return [s.getPath().getName() for s in _children(fs, path) if s.isDirectory()][:max_mailboxes]


def _folders(fs, path) -> list[str]:
    """A directory and those below it, as far as they hold files."""
    children, out = _children(fs, path), []
    if any(s.isFile() for s in children):
        out.append(path.toString())
    for s in children:
        if s.isDirectory():
            out += _folders(fs, s.getPath())
    return out


def read_maildir(spark: SparkSession, root: str, max_mailboxes: int | None = None, max_files: int | None = None) -> DataFrame:
    """One row per message file: mailbox, path, path below the mailbox, bytes.

    ``max_files``: per mailbox, the first by path; they are chosen before any
    content is read.
    """
    fs, path = _fs(spark, root)
    base = fs.getFileStatus(path).getPath().toString().rstrip("/") if fs.exists(path) else root
    dirs = [d for m in mailboxes(spark, root, max_mailboxes) for d in _folders(fs, spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{m}"))]
    if not dirs:
        return spark.createDataFrame([], SCHEMA)
    files = spark.read.format("binaryFile").load(dirs)
    tail = base.split(":", 1)[-1].lstrip("/")  # paths differ in how they write scheme and slashes
    below = F.substr(F.col("path"), F.locate(tail, "path") + F.lit(len(tail) + 1))
    out = files.select(below.alias("below"), "length", "content", "path")
    out = out.select(F.substring_index("below", "/", 1).alias("mailbox_key"), F.col("path").alias("source_file"), F.regexp_replace("below", "^[^/]*/", "").alias("relative_path"), "length", "content")
    if max_files is None:
        return out
    order = Window.partitionBy("mailbox_key").orderBy("source_file")
    chosen = out.select("mailbox_key", "source_file").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max_files)
    return out.join(chosen.select("source_file"), "source_file", "left_semi").select(*out.columns)
