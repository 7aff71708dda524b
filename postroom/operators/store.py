"""Tables that change by whole versions: readers see all tables before a change or all after it.

A version is one small JSON file that names, for each table and bucket of its key, the
Parquet folders that hold it.  A writer puts new folders beside the old ones, under names that no version
knows yet, and publishes them all by one file, renamed into place last; killed before that, it has
changed nothing.  Folders are never written twice, so readers of an older version go on reading it.

A row's bucket is a hash of its table's key.  A batch is matched with a table by a
scan of the key column of the batch's buckets against the batch's keys, broadcast while they are at
most ``FEW``; the table itself is not shuffled.  Rows that are new are appended to
their buckets; buckets are rewritten only where a row changes.  ``stamps`` hold the last batch
of each source, which makes a repeated batch a change of nothing.

One writer at a time; a second one fails when it publishes, for its version is taken.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
FEW = 100_000  # keys, of some hundred bytes, that are broadcast
BUCKET = "_bucket"


@dataclass
class Table:
    schema: str
    key: list[str]
    folders: dict[str, list[str]] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.version, self.tables, self.stamps = 0, {}, {}
        self.refresh()

    # ---- versions ----

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def refresh(self) -> Store:
        """See the newest version."""
        fs, p = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        self.version = max((int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)
        if self.version:
            said = json.loads(self.spark.read.text(f"{p}/{self.version:012d}.json", wholetext=True).first()[0])
            self.buckets, self.stamps = said["buckets"], said["stamps"]
            self.tables = {n: Table(**t) for n, t in said["tables"].items()}
        return self

    def publish(self, changed: dict[str, Table], stamps: dict[str, int]) -> None:
        """One new version with ``changed`` in place of the tables of these names."""
        tables = self.tables | changed
        said = {"buckets": self.buckets, "stamps": self.stamps | stamps, "tables": {n: vars(t) for n, t in tables.items()}}
        fs, p = self._fs()
        new = self.spark._jvm.org.apache.hadoop.fs.Path
        draft, place = new(f"{p}/.{uuid.uuid4().hex}"), new(f"{p}/{self.version + 1:012d}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(said), "utf-8"))
        out.close()
        if fs.exists(place) or not fs.rename(draft, place):
            fs.delete(draft, False)
            raise RuntimeError(f"version {self.version + 1} of {self.path} was published by another writer")
        self.version, self.tables, self.stamps = self.version + 1, tables, said["stamps"]

    # ---- tables ----

    def bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table of this version, or those of its buckets; without the buckets' numbers."""
        t = self.tables[name]
        folders = [f for b, found in t.folders.items() if buckets is None or int(b) in buckets for f in found]
        schema = StructType.fromJson(json.loads(t.schema))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def stage(self, name: str, rows: DataFrame, key: list[str], deal: bool = True) -> dict[str, list[str]]:
        """Rows written below a new name: their folders by bucket, which no version names yet.

        ``deal``: rows of a bucket are brought together first; rows read from buckets are so already.
        """
        folder = f"data/{name}-{uuid.uuid4().hex}"
        rows = rows.withColumn(BUCKET, self.bucket(key))
        (rows.hint("rebalance", BUCKET) if deal else rows).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        fs, _ = self._fs()
        made = fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}"))
        return {n.split("=")[1]: [f"{folder}/{n}"] for n in (s.getPath().getName() for s in made) if n.startswith(BUCKET)}

    def merged(self, name: str, new: DataFrame, key: list[str], changes: dict[str, Column] | None = None) -> tuple[Table, DataFrame]:
        """The table with the rows of a batch, staged, and the rows whose keys it did not have.

        ``new``: a stored table with one row a key.  ``changes``: for a row whose key is
        there, columns by expressions over ``old`` and ``new``; none: it stays as it is.
        """
        old = self.tables.get(name)
        if old is None:
            return Table(new.schema.json(), key, self.stage(name, new, key)), new
        place = f"{self.path}/data/{name}-keys-{uuid.uuid4().hex}"
        keys = new.select(*key)
        few = new.count() <= FEW
        hint = F.broadcast if few else (lambda df: df)
        touched = [r[0] for r in keys.select(self.bucket(key)).distinct().collect()]  # at most as many as there are buckets
        self.read(name, touched).select(*key).join(hint(keys), key, "left_semi").write.parquet(place)
        known = self.spark.read.schema(keys.schema).parquet(place)
        created = new.join(hint(known), key, "left_anti")
        folders = {b: list(f) for b, f in old.folders.items()}
        if changes and (again := [r[0] for r in known.select(self.bucket(key)).distinct().collect()]):
            own = self.read(name, again).alias("old").join(hint(new.alias("new")), [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in key], "left")
            same = F.col(f"new.{key[0]}").isNull()
            kept = own.select(*(F.when(same, F.col(f"old.{c}")).otherwise(changes[c]).alias(c) if c in changes else F.col(f"old.{c}") for c in new.columns))
            folders |= self.stage(name, kept, key, deal=False)
        for b, more in self.stage(name, created, key).items():
            folders[b] = folders.get(b, []) + more
        return Table(old.schema, key, folders), created

    def compact(self, name: str, most: int = 16) -> bool:
        """Buckets of more than ``most`` folders rewritten as one each, as a version of its own."""
        t = self.tables[name]
        many = [int(b) for b, f in t.folders.items() if len(f) > most]
        if many:
            rows = self.read(name, many).repartition(len(many), self.bucket(t.key))
            self.publish({name: Table(t.schema, t.key, t.folders | self.stage(name, rows, t.key))}, {})
        return bool(many)

    def vacuum(self) -> int:
        """Delete the folders that the newest version does not name; the number of them.

        Readers of older versions must have ended, and no writer be at work.
        """
        fs, _ = self._fs()
        new = self.spark._jvm.org.apache.hadoop.fs.Path
        used = {f.split("/")[1] for t in self.tables.values() for fs_ in t.folders.values() for f in fs_}
        data = new(f"{self.path}/data")
        gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in used] if fs.exists(data) else []
        for p in gone:
            fs.delete(p, True)
        return len(gone)
