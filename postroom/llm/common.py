"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word of all contracts: a run of anything but the six ASCII blanks.
#: ``bytes.split()`` splits on exactly these six, which the Python operators use.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` decides; a machine-local folder is made only where
    that setting is missing and the master is local (tests).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="postroom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return jsc.getCheckpointDir().get()


_written: list[tuple[SparkSession, str]] = []

#: Shuffle files go at the end of the execution that wrote them, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; its shuffles leave nothing on disk.

    Cuts the lineage, survives lost executors, and keeps column pruning, which
    ``checkpoint()`` would lose.  ``release`` drops all such tables.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables ``stored`` has written and not released, for ``release``."""
    return len(_written)


def release(since: int = 0, keep: int = 0) -> None:
    """Delete the tables that ``stored`` wrote after ``since`` others, but for the last ``keep``."""
    while len(_written) - keep > since:
        spark, path = _written.pop(since)
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: its folder goes with it
            continue


HOT = 100_000  # rows of a key that one task may be dealt in any case


def join_hot(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner", n: str = "n") -> DataFrame:
    """``left`` joined to ``right``, which has one row for each key and, in ``n``, the key's number of rows in ``left``.

    Keys with more than ``HOT`` rows and more than a thousandth of all, of which
    there are fewer than a thousand, are broadcast, so that no task is dealt a
    whole hot group; the others are shuffled.  ``left`` is then read twice: let it
    be a stored table or cheap.
    """
    keys = [keys] if isinstance(keys, str) else keys
    total, most = right.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    limit = max(total // 1000, HOT)
    if most <= limit:
        return left.join(right, keys, how)
    hot = F.broadcast(right.filter(F.col(n) > limit))
    cold = left.join(F.broadcast(right.filter(F.col(n) > limit).select(*keys)), keys, "left_anti")
    return left.join(hot, keys).unionByName(cold.join(right.filter(F.col(n) <= limit), keys, how))


def dealt_by(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` shuffled on ``keys`` to as many tasks as the session has shuffle partitions.

    For rows that are small and cost much work, which adaptive execution, going by
    bytes, would leave to a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows of one or two longs that a broadcast may hold: 32 MB of them.
FEW = 2_000_000


def if_few(df: DataFrame) -> DataFrame:
    """A stored table of one or two longs a row, to be broadcast if it has at most ``FEW`` rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name close to ``wanted`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def id_remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids count as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus
