"""Merkle manifest of a dataset: a leaf a row, a tree a group, one root, a proof for every row.

A leaf is the digest of the row's fields.  Within a group the leaves are in order of
their key; every ``FAN`` consecutive nodes, the last run being shorter, become the
digest of their digests (hex text) until one is left: the group's root.  The roots
of the groups, in the order of the groups, make the last tree in the same way.

1. Rows, reduced to key and leaf, are sorted by range over (group, key).  A group then
   lies in consecutive partitions, so that a leaf's place in its group is its place in
   the partition plus the group's count in earlier partitions.  Those offsets come from
   one small table of counts by partition and group.
2. Each partition builds the aligned subtrees that it holds whole, up to ``LOCAL``
   levels, in one pass that keeps one such subtree in memory.  What stays without a
   parent, ragged nodes at its ends and the tops of subtrees, are shuffled by
   coordinate (group, level, place), and joined run by run, level by level.
3. From the root down each such node gets its path, and goes back to its
   partition, where a second pass gives every leaf its proof.

No task holds more than a partition's share of the sorted rows, and sees them as a
stream; a group with most of the rows is spread over most partitions; tables of
steps in between have FAN ** -LOCAL of the rows and a few rows for each partition
and group.  Every step reads a stored table, so that a lost executor costs its tasks.

Defined results: the null group comes first, then groups by UTF-8 bytes; null keys
come first, rows equal in group and key are in the order of their leaves, and
equal rows are leaves of their own; null fields are written ``-``, empty ones ``0:``;
texts of any length are hashed whole; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postroom.llm.common import stored, table

FAN = 16
LOCAL = 3  # levels of a subtree that a partition builds: 4096 leaves
HEX = 64  # characters of a digest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: a proof: for each level, from the leaf up, the digests left and right of the node in its run
PROOF = "array<struct<left:string,right:string>>"
_NODE = "g long, level int, place long, digest string, p int"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(*fields: Column) -> Column:
    """Digest of fields, each as its UTF-8 length, a colon and its text."""
    said = []
    for f in fields:
        s = f.cast("string")
        said.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return digest(F.concat(*said))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, run: digest(F.concat(run["left"], node, run["right"])))


def proof_text(proof: Column) -> Column:
    return F.array_join(F.transform(proof, lambda run: F.concat(run["left"], run["right"])), "")


# ---- places -----------------------------------------------------------------------


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """``rows`` (grp, key, leaf ..) sorted by range and stored, with the number p of the partition.

    They are stored before too, as a sort by range reads its rows twice and the leaves are dear.
    """
    rows = stored(rows, "unsorted")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf")]
    # rows equal in the keys of the range stay together, so equal rows are told apart by a random part
    dealt = rows.withColumn("_deal", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(n, *order, "_deal")
    return stored(dealt.sortWithinPartitions(*order, "_deal").drop("_deal").withColumn("p", F.spark_partition_id()), "leaves")


def _parts(leaves: DataFrame) -> DataFrame:
    """One row for each partition and group: p, grp, offset of the group there, total of the group, number g of the group."""
    parts = leaves.groupBy("p", "grp").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("grp").orderBy("p")
    parts = parts.withColumn("offset", F.sum("c").over(upto) - F.col("c")).withColumn("total", F.sum("c").over(Window.partitionBy("grp")))
    # groups are numbered by the partition that they begin in: one row a partition is summed, not one a group
    new = (F.col("offset") == 0).cast("long")
    within = F.sum(new).over(Window.partitionBy("p").orderBy(F.col("grp").asc_nulls_first()))
    parts = stored(parts.withColumn("within", within), "parts")
    before = parts.groupBy("p").agg(F.sum((F.col("offset") == 0).cast("long")).alias("news"))
    before = before.select(F.col("p").alias("bp"), (F.sum("news").over(Window.orderBy("p")) - F.col("news")).alias("before"))
    first = parts.filter("offset = 0").join(before, F.col("p") == F.col("bp")).select(F.col("grp").alias("fg"), (F.col("before") + F.col("within") - 1).alias("g"))
    return stored(parts.join(first, F.col("grp").eqNullSafe(F.col("fg"))).select("p", "grp", "offset", "total", "g"), "places")


def levels(total: Column) -> Column:
    """Levels above the leaves of a tree of ``total``."""
    n = F.lit(0)
    for k in range(15):
        n = n + (total > FAN**k).cast("int")
    return n


# ---- in the partitions --------------------------------------------------------------


def _by_partition(leaves: DataFrame, heads: DataFrame, columns: list[str]) -> DataFrame:
    """Leaves and heads (rows about a group, kind 0 or 1) of a partition together, each group's heads before its leaves."""
    both = leaves.withColumn("kind", F.lit(2)).unionByName(heads, allowMissingColumns=True)
    n = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = ["p", F.col("grp").asc_nulls_first(), "kind", F.col("key").asc_nulls_first(), "leaf"]
    return both.repartitionById(n, F.col("p")).sortWithinPartitions(*sort).select(*columns)


class _Blocks:
    """Cuts the leaves of a task into blocks: those of one partition and group under one node of level ``LOCAL``."""

    schema: pa.Schema

    def of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(head, extra heads, place of the first leaf, rows of leaves)."""
        rows, extra, head, at, first = [], [], None, 0, 0
        span = FAN**LOCAL
        for batch in batches:
            self.schema = batch.schema
            for row in batch.to_pylist():
                if row["kind"] == 2:
                    if at % span == 0 and rows:
                        yield head, extra, first, rows
                        rows, first = [], at
                    rows.append(row)
                    at += 1
                    continue
                if rows:
                    yield head, extra, first, rows
                    rows = []
                if row["kind"] == 0:
                    head, extra, at = row, {}, row["offset"]
                else:
                    extra[row["level"], row["place"]] = row["path"]
                first = at
        if rows:
            yield head, extra, first, rows


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def _subtree(first: int, digests: list[str], total: int, most: int) -> tuple[list[dict[int, list]], list[tuple[int, int, str]]]:
    """Runs that the block holds whole, by level and place of their parent, and its nodes without a parent.

    ``digests``: those of the leaves from place ``first``; ``total``: leaves of the group; ``most``: levels of its tree.
    """
    runs, tops = [], []
    nodes = dict(enumerate(digests, first))
    size = total
    for level in range(min(LOCAL, most)):
        by_parent: dict[int, list] = {}
        for place in nodes:
            by_parent.setdefault(place // FAN, []).append(place)
        whole = {}
        up = {}
        for parent, places in by_parent.items():
            if len(places) == min(FAN, size - parent * FAN):
                whole[parent] = "".join(nodes[x] for x in places)
                up[parent] = _hash(whole[parent])
            else:
                tops += [(level, x, nodes[x]) for x in places]
        runs.append(whole)
        nodes, size = up, -(-size // FAN)
    tops += [(min(LOCAL, most), x, d) for x, d in nodes.items()]
    return runs, tops


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for head, _, first, rows in _Blocks().of(batches):
        for level, place, d in _subtree(first, [r["leaf"] for r in rows], head["total"], head["levels"])[1]:
            out.append({"g": head["g"], "level": level, "place": place, "digest": d, "p": head["p"]})
        if len(out) > 10_000:
            yield pa.RecordBatch.from_pylist(out, _TOPS)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, _TOPS)


_TOPS = pa.schema([("g", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string()), ("p", pa.int32())])


def _proofs(kept: list[str]):
    """Task that gives each leaf its proof and passes the columns ``kept`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks()
        for head, paths, first, rows in blocks.of(batches):
            runs, tops = _subtree(first, [r["leaf"] for r in rows], head["total"], head["levels"])
            known = {(level, place) for level, place, _ in tops}
            starts, left, right, subroots, roots = [0], [], [], [], []
            for i in range(len(rows)):
                place, level = first + i, 0
                while (level, place) not in known:
                    whole, at = runs[level][place // FAN], place % FAN * HEX
                    left.append(whole[:at])
                    right.append(whole[at + HEX :])
                    place, level = place // FAN, level + 1
                path = paths[level, place]
                for step in path["steps"]:
                    left.append(step["left"])
                    right.append(step["right"])
                starts.append(len(left))
                subroots.append(path["subroot"])
                roots.append(path["root"])
            proof = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"]))
            arrays = [pa.array([r[n] for r in rows], blocks.schema.field(n).type) for n in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(subroots, pa.string()), pa.array(roots, pa.string()), proof], [*kept, "subroot", "root", "proof"])

    return run


# ---- between the partitions ------------------------------------------------------------


def _above(nodes: DataFrame, rounds: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level up to the root of each tree g, and all (g, digest) of the roots.

    ``nodes``: (g, levels, level, place, digest), levels being those of the tree.  The
    runs of a level are joined once all its nodes are there.
    """
    given = stored(nodes, "nodes")
    found, below, roots = [], None, None
    for level in range(rounds + 1):
        here = given.filter(F.col("level") == level).select("g", "levels", "place", "digest")
        if below is not None:
            here = here.unionByName(below)
        done = here.filter(F.col("levels") == level).select("g", "digest")
        roots = done if roots is None else roots.unionByName(done)
        if level == rounds:
            break
        open_ = here.filter(F.col("levels") > level).withColumn("parent", F.floor(F.col("place") / FAN))
        runs = open_.groupBy("g", "parent").agg(F.first("levels").alias("levels"), F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("run"))
        runs = runs.withColumn("whole", F.array_join(F.transform("run", lambda x: x["digest"]), ""))
        joined = stored(runs.select("g", "levels", F.col("parent").alias("place"), digest(F.col("whole")).alias("digest"), "whole", F.col("run")[0]["place"].alias("first")), "runs")
        found.append(joined)
        below = joined.select("g", "levels", "place", "digest")
    return found, stored(roots, "roots")


def _paths(wanted: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """``wanted`` (g, level, place ..) with ``steps``: what is left and right of the node and of all above it in its tree.

    From the top down; ``runs[k]``: those of level k.
    """
    none = F.array().cast(PROOF)
    above = None
    out = None
    for level in range(len(runs) - 1, -1, -1):
        # nodes of this level, as children of the runs of it
        run = runs[level].select("g", F.col("place").alias("parent"), "first", "whole", F.posexplode(F.sequence(F.lit(0), (F.length("whole") / HEX - 1).cast("int"))).alias("at", "_"))
        step = F.struct(F.substring("whole", F.lit(1), F.col("at") * HEX).alias("left"), F.substring("whole", (F.col("at") + 1) * HEX + 1, F.length("whole")).alias("right"))
        here = run.select("g", "parent", (F.col("first") + F.col("at")).alias("place"), F.array(step).cast(PROOF).alias("steps"))
        if above is not None:
            up = above.select(F.col("g").alias("ug"), F.col("place").alias("up"), F.col("steps").alias("more"))
            here = here.join(up, (F.col("g") == F.col("ug")) & (F.col("parent") == F.col("up")), "left").withColumn("steps", F.concat("steps", F.coalesce("more", none)))
        above = stored(here.select("g", F.lit(level).alias("level"), "place", "steps"), "paths")
        out = above if out is None else out.unionByName(above)
    if out is None:
        return wanted.withColumn("steps", none)
    return wanted.join(out, ["g", "level", "place"], "left").withColumn("steps", F.coalesce("steps", none))


def manifest(rows: DataFrame, group: str, key: str, leaf: Column) -> DataFrame:
    """grp, key, leaf, subroot, root and proof of every row; ``fold`` leads a leaf and its proof to the root.

    ``rows`` may have further columns named ``kept_*``, which are passed on.
    """
    kept = [c for c in rows.columns if c.startswith("kept_")]
    leaves = _sorted_rows(rows.select(F.col(group).cast("string").alias("grp"), F.col(key).alias("key"), leaf.alias("leaf"), *kept))
    parts = _parts(leaves)
    heads = parts.select("p", "grp", "offset", "total", "g", levels(F.col("total")).alias("levels"), F.lit(0).alias("kind"))
    columns = ["kind", "p", "offset", "total", "g", "levels", "leaf"]
    tops = stored(_by_partition(leaves, heads, columns).mapInArrow(_tops, _NODE), "tops")
    groups = heads.filter("offset = 0").select("g", "levels")
    most = groups.agg(F.max("levels"), F.count(F.lit(1))).first()
    runs, subroots = _above(tops.drop("p").join(groups, "g"), most[0] or 0)
    # the tree of the groups' roots, as one more tree, 0
    n = _levels(most[1])
    as_leaves = subroots.select(F.lit(0).cast("long").alias("g"), F.lit(n).alias("levels"), F.lit(0).alias("level"), F.col("g").alias("place"), "digest")
    last, root = _above(as_leaves, n)
    of_groups = _paths(as_leaves.withColumnRenamed("digest", "subroot"), last)
    of_groups = of_groups.select(F.col("place").alias("pg"), "subroot", F.col("steps").alias("last"))
    paths = _paths(tops.select("g", "level", "place", "p"), runs).join(of_groups, F.col("g") == F.col("pg"))
    found = root.first()  # one row, or none of an empty table
    path = F.struct(F.concat("steps", "last").alias("steps"), "subroot", F.lit(found and found["digest"]).cast("string").alias("root")).alias("path")
    grp = parts.select(F.col("p").alias("hp"), F.col("g").alias("hg"), "grp")
    extra = paths.join(grp, (F.col("p") == F.col("hp")) & (F.col("g") == F.col("hg"))).select("p", "grp", "level", "place", path, F.lit(1).alias("kind"))
    columns = ["kind", "p", "offset", "total", "g", "levels", "leaf", "grp", "key", "level", "place", "path", *kept]
    both = _by_partition(leaves, heads.unionByName(extra, allowMissingColumns=True), columns)
    out = ["grp", "key", "leaf", *kept]
    kinds = dict(both.dtypes)
    schema = "".join(f"`{n}` {kinds[n]}, " for n in out) + f"subroot string, root string, proof {PROOF}"
    return both.mapInArrow(_proofs(out), schema)


def _levels(total: int) -> int:
    n = 0
    while FAN**n < total:
        n += 1
    return n


# ---- documents ------------------------------------------------------------------------


def documents_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof, and ``now``: the leaf after the tampering that the query asks for.

    The text is read once, by the scan that makes both leaves.
    """
    by_number = [F.col(c) for c in FIELDS]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    tampered = F.when(hit & (lower != F.col("text")), leaf_of(*by_number[:-1], lower))
    rows = docs.select("doc_id", "source", leaf_of(*by_number).alias("leaf"), tampered.alias("kept_now"))
    out = manifest(rows, "source", "doc_id", F.col("leaf"))
    return out.select(F.col("key").alias("doc_id"), F.col("grp").alias("source"), "leaf", "subroot", "root", "proof", F.coalesce("kept_now", "leaf").alias("now"))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    m = documents_manifest(table(spark, sf_dir, "documents"))
    m = m.select("doc_id", "leaf", "subroot", "root", digest(proof_text(F.col("proof"))).alias("proof_sha256"), fold(F.col("now"), F.col("proof")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))
