"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

* The tree is fitted on a sample of at most ``SAMPLE`` vectors by spherical k-means,
  ``BRANCHES`` ways at every node, down to ``LEAF`` vectors of the sample.  It has a
  bounded size, so it is broadcast.  Every row is then put into its leaf.
* A query goes down the tree by the nearest centre and puts the centres that it passes
  by into a priority queue; the best of the queue is gone down next, and so on.  Each
  leaf reached is a visit.
* How many leaves are visited is calibrated: for at most ``CALIBRATE`` queries the true
  neighbours are found among all rows, and visits widen until ``RECALL`` of them
  lie in the leaves visited.  Queries that have seen fewer rows than they need go on.
* Leaves are packed into shards of about ``SHARD`` rows and larger leaves are cut into
  several, by counts; a query meets a shard's rows once, whichever of its leaves it
  visits there.  Shards that very many queries meet are dealt to several tasks.

Of equal vectors only as many rows as one answer can name are indexed, those of the
smallest ids: no further copy can be in any answer.  Scores are taken on the original
vectors, in doubles, row by row, so that copies tie exactly.

Defined results: vectors that are null, empty, zero or hold null or non-finite entries
take no part; of vectors of several lengths those of the commonest length do (of
equals the longest); a query is a row: rows equal in id and vector are candidates of each
other, null ids are never queries and come last among ties; ties go to the smaller
id; long vectors are whole; an empty table, or a query without candidates, gives no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postroom.llm.common import if_few, stored, table
from postroom.llm.vectors import finite, matrix, of_one_length

NEAREST = 5
SAMPLE = 65_536  # vectors that the tree is fitted on, at the driver
BRANCHES, ROUNDS, LEAF = 8, 12, 128
CALIBRATE, RECALL = 128, 0.97
SHARD = 4096  # rows that a task compares with its queries
MEET = 16_384  # queries that a task compares with a shard
CLOSE = 1e-9  # by which products in blocks may differ from those row by row


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def cosines(one: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of a vector with rows; each by itself, so that equal rows have equal cosines."""
    return (rows * one).sum(axis=1) / (np.sqrt((one * one).sum()) * np.sqrt((rows * rows).sum(axis=1)))


class Tree:
    """centres: one unit vector a node; children: first and number of a node's children, numbers 0 for leaves; leaf: a leaf's number."""

    def __init__(self, sample: np.ndarray, leaf: int = LEAF, branches: int = BRANCHES, seed: int = 7):
        points = unit(sample)
        draw = np.random.default_rng(seed)
        self.centres, self.children = [points.mean(axis=0)], [(0, 0)]
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            parts = _split(points[own], branches, draw) if len(own) > leaf else []
            if len(parts) > 1:
                self.children[node] = (len(self.centres), len(parts))
                for centre, members in parts:
                    todo.append((len(self.centres), own[members]))
                    self.centres.append(centre)
                    self.children.append((0, 0))
        self.centres = np.array(self.centres)
        ends = [i for i, (_, n) in enumerate(self.children) if not n]
        self.leaf = {node: k for k, node in enumerate(ends)}
        self.leaves = len(ends)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        points = unit(rows)
        out = np.zeros(len(rows), np.int32)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            first, n = self.children[node]
            if not n:
                out[own] = self.leaf[node]
            elif len(own):
                best = (points[own] @ self.centres[first : first + n].T).argmax(axis=1)
                todo += [(first + k, own[best == k]) for k in range(n)]
        return out

    def visits(self, near: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a best-bin-first search; ``near``: products of the query with all centres."""
        near = near.tolist()
        queue = [(-near[0], 0)]
        while queue:
            node = heapq.heappop(queue)[1]
            first, n = self.children[node]
            while n:
                best = max(range(first, first + n), key=near.__getitem__)
                for other in range(first, first + n):
                    if other != best:
                        heapq.heappush(queue, (-near[other], other))
                node = best
                first, n = self.children[node]
            yield self.leaf[node]


def _split(points: np.ndarray, k: int, draw: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Centres and members of at most ``k`` parts, by spherical k-means."""
    centres = points[draw.choice(len(points), k, replace=False)]
    best = None
    for _ in range(ROUNDS):
        now = (points @ centres.T).argmax(axis=1)
        if best is not None and (now == best).all():
            break
        best = now
        sums = np.zeros_like(centres)
        np.add.at(sums, best, points)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    best = (points @ centres.T).argmax(axis=1)
    return [(centres[j], np.flatnonzero(best == j)) for j in range(k) if (best == j).any()]


# ---- the index -----------------------------------------------------------------------


def _placed(tree, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.value.place(matrix(batch.column("vec"), d)) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], [*batch.schema.names, "leaf"])

    return run


class Index:
    """Rows (row, vec_id, vec, leaf, shard), the tree, and by leaf its first shard, its number of shards and its rows."""

    def __init__(self, vectors: DataFrame, d: int, k: int = NEAREST):
        """``vectors``: (row, vec_id, vec), a stored table with vectors of length ``d``."""
        spark = vectors.sparkSession
        same = Window.partitionBy(F.xxhash64("vec"), "vec").orderBy(F.col("vec_id").asc_nulls_last(), "row")
        useful = stored(vectors.withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= k + 1).drop("copy"), "useful")
        self.k, self.d = k, d
        n = useful.count()
        part = useful if n <= SAMPLE else useful.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 40)) < int((1 << 40) * SAMPLE * 0.95 / n)).limit(SAMPLE)
        self.tree = Tree(matrix(part.select("vec").toArrow().column("vec").combine_chunks(), d))
        self.shared = spark.sparkContext.broadcast(self.tree)
        kind = dict(useful.dtypes)
        leaves = stored(useful.mapInArrow(_placed(self.shared, d), f"row long, vec_id {kind['vec_id']}, vec {kind['vec']}, leaf int"), "placed")
        counts = {r["leaf"]: r["count"] for r in leaves.groupBy("leaf").count().collect()}  # the tree's leaves, a bounded number
        self.place = self._pack(counts, self.tree.leaves)
        first, cuts = (F.array(*(F.lit(x[i]) for x in self.place)) for i in (0, 1))
        at = F.get(first, F.col("leaf")) + F.pmod(F.xxhash64("row"), F.get(cuts, F.col("leaf")))
        self.rows = leaves.withColumn("shard", at.cast("long"))

    @staticmethod
    def _pack(counts: dict[int, int], leaves: int) -> list[tuple[int, int, int]]:
        out, shard, held = [], 0, 0
        for leaf in range(leaves):
            n = counts.get(leaf, 0)
            if held and held + n > SHARD:
                shard, held = shard + 1, 0
            cuts = max(1, -(-n // SHARD))
            out.append((shard, cuts, n))
            if cuts > 1:
                shard, held = shard + cuts, 0
            else:
                held += n
        return out

    # ---- calibration ----

    def truth(self, queries: DataFrame) -> list[tuple[int, int]]:
        """(query's number, leaf of a true neighbour) for a few queries, against all rows."""
        rows = self.rows.select("row", "vec_id", "vec", "leaf").mapInArrow(_nearest(queries, self.d, self.k), "query int, row long, vec_id long, leaf int, score double")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row"))
        return [(r["query"], r["leaf"]) for r in rows.withColumn("rank", rank).filter(F.col("rank") <= self.k).select("query", "leaf").collect()]

    def calibrate(self, queries: DataFrame, recall: float = RECALL) -> int:
        """The number of leaves to visit, from the true neighbours of at most ``CALIBRATE`` queries."""
        few = queries.orderBy(F.xxhash64("row", F.lit("few"))).select("row", "vec").limit(CALIBRATE).toArrow()
        if not few.num_rows:
            return 1
        ids, vectors = few.column("row").to_numpy(), matrix(few.column("vec").combine_chunks(), self.d)
        near = unit(vectors) @ self.tree.centres.T
        ranks = [{leaf: i for i, leaf in enumerate(self.tree.visits(x))} for x in near]
        wanted = sorted(ranks[q][leaf] for q, leaf in self.truth((ids, vectors)))
        visits = 1
        while visits < self.tree.leaves and np.searchsorted(wanted, visits) < recall * len(wanted):
            visits += 1
        return visits

    # ---- search ----

    def search(self, queries: DataFrame, visits: int) -> DataFrame:
        """(query, query_id, rank, vec_id, score): the nearest found of each query (row, vec_id, vec)."""
        kind = dict(queries.dtypes)
        probes = queries.mapInArrow(_probes(self.shared, self.place, self.d, visits, self.k), f"row long, query_id {kind['vec_id']}, vec {kind['vec']}, shard long, leaves array<int>")
        probes = stored(probes, "probes")
        # shards that many queries meet are copied, and their queries dealt to the copies
        load = probes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / MEET).cast("int").alias("deals"))
        load = if_few(stored(load, "load"))
        probes = probes.join(load, "shard").withColumn("deal", F.pmod(F.hash("row"), F.col("deals"))).drop("deals")
        rows = self.rows.join(load, "shard").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
        best = "query long, query_id long, found array<struct<score:double,vec_id:bigint,row:bigint>>"
        met = probes.groupBy("shard", "deal").cogroup(rows.groupBy("shard", "deal")).applyInArrow(_meet(self.d, self.k), best)
        every = met.select("query", "query_id", F.explode("found").alias("f"))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("f.score"), F.col("f.vec_id").asc_nulls_last(), "f.row"))
        return every.withColumn("rank", rank).filter(F.col("rank") <= self.k).select("query", "query_id", "rank", "f.vec_id", "f.score")


def _best(one: np.ndarray, rows: np.ndarray, units: np.ndarray, ids, numbers: np.ndarray, own: int, k: int) -> list[tuple]:
    """The ``k`` nearest of ``rows`` as (score, id, row number, index), by cosines taken row by row."""
    near = units @ (one / np.sqrt((one * one).sum()))
    near[numbers == own] = -np.inf
    if len(near) > k:
        near = np.flatnonzero(near >= np.partition(near, -k)[-k] - CLOSE)
    else:
        near = np.arange(len(near))
    near = near[numbers[near] != own]
    found = zip(cosines(one, rows[near]).tolist(), near.tolist(), strict=True)
    return sorted(((s, ids[i], int(numbers[i]), i) for s, i in found), key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))[:k]


def _nearest(queries: tuple[np.ndarray, np.ndarray], d: int, k: int):
    """Task: the nearest rows of its own for each of a few queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query", "row", "vec_id", "leaf", "score"]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column("vec"), d)
            units, numbers, ids, leaf = unit(rows), batch.column("row").to_numpy(), batch.column("vec_id").to_pylist(), batch.column("leaf").to_numpy()
            out = [(q, n, i, int(leaf[at]), s) for q, (own, one) in enumerate(zip(*queries, strict=True)) for s, i, n, at in _best(one, rows, units, ids, numbers, own, k)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)], names) if out else pa.RecordBatch.from_pylist([], pa.schema([("query", pa.int32()), ("row", pa.int64()), ("vec_id", pa.int64()), ("leaf", pa.int32()), ("score", pa.float64())]))

    return run


def _probes(tree, place: list[tuple[int, int, int]], d: int, visits: int, k: int):
    """Task: for each query the shards that it meets, with the leaves that it visits there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = unit(matrix(batch.column("vec"), d)) @ tree.value.centres.T
            take, shards, leaves = [], [], []
            for i, x in enumerate(near):
                by_shard: dict[int, list[int]] = {}
                seen = 0
                for n, leaf in enumerate(tree.value.visits(x)):
                    if n >= visits and seen > k:
                        break
                    first, cuts, rows = place[leaf]
                    seen += rows
                    for shard in range(first, first + cuts) if rows else ():
                        by_shard.setdefault(shard, []).append(leaf)
                take += [i] * len(by_shard)
                shards += by_shard
                leaves += by_shard.values()
            part = batch.take(pa.array(take, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shards, pa.int64()), pa.array(leaves, pa.list_(pa.int32()))], ["row", "query_id", "vec", "shard", "leaves"])

    return run


_FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("found", pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64()), ("row", pa.int64())])))])


def _meet(d: int, k: int):
    """Task: the queries that meet a shard against the rows of the leaves that each visits in it."""

    def run(probes: pa.Table, rows: pa.Table) -> pa.Table:
        if not probes.num_rows or not rows.num_rows:
            return _FOUND.empty_table()
        rows = rows.sort_by("leaf")
        vectors, leaf = matrix(rows.column("vec").combine_chunks(), d), rows.column("leaf").to_numpy()
        units, numbers, ids = unit(vectors), rows.column("row").to_numpy(), rows.column("vec_id").to_pylist()
        asking = matrix(probes.column("vec").combine_chunks(), d)
        out = {"query": probes.column("row"), "query_id": probes.column("query_id"), "found": []}
        every = len(np.unique(leaf))
        for one, own, wanted in zip(asking, probes.column("row").to_pylist(), probes.column("leaves").to_pylist(), strict=True):
            if len(wanted) == every:
                best = _best(one, vectors, units, ids, numbers, own, k)
            else:
                part = np.concatenate([np.arange(*np.searchsorted(leaf, (x, x + 1))) for x in wanted])
                best = [(s, i, n, 0) for s, i, n, _ in _best(one, vectors[part], units[part], [ids[x] for x in part], numbers[part], own, k)]
            out["found"].append([{"score": s, "vec_id": i, "row": n} for s, i, n, _ in best])
        return pa.Table.from_pydict(out, _FOUND)

    return run


def neighbours(rows: DataFrame, id_column: str, vector_column: str, every: int, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id is divisible by ``every``, against all rows."""
    spark = rows.sparkSession
    vectors, d = of_one_length(finite(rows, id_column, vector_column).filter(F.exists("vec", lambda c: c != 0)))
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = stored(vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "vec"), "vectors")
    index = Index(vectors, d, k)
    queries = vectors.filter(F.col("vec_id") % every == 0)
    return index.search(queries, index.calibrate(queries)).select("query_id", "rank", "vec_id", "score")


def op13_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 50)
