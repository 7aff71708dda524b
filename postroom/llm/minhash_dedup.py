"""Near-duplicate documents by an inverted join over MinHash coordinates.

1. Every row gets its set of word shingles (64-bit hashes), the set's size and
   identity, and ``K`` MinHash coordinates.
2. Rows with equal sets form a class; only one representative of each class goes
   on, so exact copies cost nothing more.
3. Representatives are posted under every (coordinate, value) pair.  Lists with a
   single document are dropped.  A linked pair agrees in at least ``T`` of the
   ``K`` coordinates (see ``match_threshold``), so a document that is in fewer
   than ``T`` longer lists can have no partner and is dropped too.
4. Prefix and skip: a pair that agrees in ``T`` of ``K`` coordinates meets in at
   least one of any K - T + 1 of them.  Each document skips its ``T`` - 1 longest
   lists and stays in the rest.
5. Candidates are pairs that meet in a remaining list.  Their collisions are
   counted over all coordinates, those with ``T`` or more are compared on their
   full shingle sets, and those that the sets confirm are links.
6. What is linked is one component, and pairs inside a component can change
   nothing; ``lists`` says how that keeps the candidates few.  What is left after
   its first looks is compared in blocks: a task holds two blocks at most, and no
   pair leaves a task but a spanning forest of confirmed links.  So no link
   between different texts is lost, and a group of n near copies that a hub links
   costs n pairs.  Left quadratic, in blocks: lists of documents that agree in
   ``T`` coordinates, or nearly, and are not linked.
7. Alternating stars turn links into components.

Defined results: null texts and texts without words have no shingles and no
links; a text with fewer words than a shingle is one shingle; a text of any
length is read whole, in linear time; rows that share an id are one node of
``near_duplicates``, with the size of each row's own set; rows without an id take
part, and a component's id is its smallest id, null if none of its rows has one;
equal sets are a tie that the smallest id wins; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import dealt_by, free_name, if_few, join_hot, mark, release, stored, table
from postroom.llm.components import merged
from postroom.llm.lists import linked

WORDS, SIMILARITY = 5, 0.8
K = 64
CHUNK = 400  # partners that a hub meets in one task
MISS = 1e-8  # probability that a linked pair agrees in fewer than T coordinates
MEMO = 250_000  # words whose hash a task remembers
_A = np.array([(xxhash.xxh64_intdigest(b"coordinate", k) | 1) for k in range(K)], dtype=np.uint64)
_M = np.uint64(0x9E3779B97F4A7C15)
_memo: dict[bytes, int] = {}


def match_threshold(similarity: float, k: int = K, miss: float = MISS) -> int:
    """The largest T with P(Binomial(k, similarity) < T) <= miss."""
    below, t = 0.0, 0
    while t < k:
        below += math.comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if below > miss:
            break
        t += 1
    return max(t, 1)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles of a whole text."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    if len(_memo) > MEMO:
        _memo.clear()
    get, digest, ids = _memo.get, xxhash.xxh64_intdigest, []
    for w in words:
        h = get(w)
        if h is None:
            h = _memo[w] = digest(w)
        ids.append(h)
    h = np.array(ids, dtype=np.uint64)
    width = min(n, len(h))
    m = len(h) - width + 1
    out = np.full(m, width, np.uint64)
    for k in range(width):
        out = _mix(out * _M + h[k : k + m])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """K MinHash coordinates of a non-empty set, 32 bits each."""
    low = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(low, (s[i : i + 2048, None] * _A).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


SIGNED = "row bigint, doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, sig array<int>"


def forgetting(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task``, after which the words are forgotten: workers go on to the tasks of other stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            _memo.clear()
            pa.default_memory_pool().release_unused()

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): ``row`` stands for id and text."""
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


def signed(docs: DataFrame, words: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, sig = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, words)
                n.append(len(s))
                one.append(int(s.sum().astype(np.uint64).view(np.int64)) if len(s) else 0)
                two.append(int(_mix(s + _M).sum().view(np.int64)) if len(s) else 0)
                sig.append(signature(s) if len(s) else None)
            cols = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "n_shingles", "h1", "h2", "sig"])

    return keyed(docs).mapInArrow(forgetting(sign), SIGNED)


def postings(reps: DataFrame, t: int) -> DataFrame:
    """(rep, weight, home, load, token): the lists in which a representative may meet partners.

    ``weight`` is the company in all its lists, ``home`` the longest of them.
    """
    posted = reps.select("rep", F.posexplode("sig").alias("k", "v"))
    posted = posted.select("rep", (F.col("k").cast("long") * (1 << 32) + F.col("v")).alias("token"))
    lists = stored(posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "lists")
    met = join_hot(posted, lists, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("own"))  # K at most
    kept = met.filter(F.size("own") >= t)
    weight = F.aggregate("own", F.lit(0).cast("long"), lambda w, x: w + x["n"])
    kept = kept.select("rep", weight.alias("weight"), F.element_at("own", -1)["token"].alias("home"), F.slice("own", 1, F.size("own") - (t - 1)).alias("prefix"))
    return kept.select("rep", "weight", "home", F.lit(1).alias("load"), F.explode("prefix.token").alias("token"))


class Corpus:
    """The texts, and what all looks at them need."""

    def __init__(self, docs: DataFrame, reps: DataFrame, words: int, similarity: float, repeats: bool):
        self.docs, self.reps, self.words, self.hundredths, self.repeats = docs, reps, words, round(100 * similarity), repeats
        self.t = match_threshold(similarity)

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(rep, shingles): full sets of the representatives ``wanted``."""
        words, names = self.words, ["rep", "shingles"]

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [shingle_set(t, words).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=names)

        texts = keyed(self.docs).select(F.col("row").alias("rep"), "text").join(if_few(wanted), "rep", "left_semi")
        if self.repeats:
            texts = texts.dropDuplicates(["rep"])
        return texts.mapInArrow(forgetting(sets), "rep bigint, shingles binary")

    def links(self, pairs: DataFrame) -> DataFrame:
        """(a, b): the pairs that agree in ``t`` coordinates and whose sets have the similarity.

        Partners of a hub ``a`` are dealt to tasks in chunks.
        """
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            return pairs
        hubs = stored(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(self.reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a"), "hubs")
        met = join_hot(pairs, hubs, "a").join(self.reps.select(F.col("rep").alias("b"), "sig"), "b")
        collisions = F.aggregate(F.zip_with("sig", "sig_a", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
        chunk = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK))
        met = stored(met.filter(collisions >= self.t).select("a", chunk.alias("chunk"), "b"), "met")
        roles = met.select(F.col("b").alias("rep"), "a", "chunk", F.lit(False).alias("hub"))
        roles = roles.unionByName(met.select(F.col("a").alias("rep"), "a", "chunk", F.lit(True).alias("hub")).distinct())
        dealt = self.sets(stored(roles.select("rep").distinct(), "wanted")).join(roles, "rep").select("a", "chunk", "hub", "rep", "shingles")
        hundredths = self.hundredths

        def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = [], []
                for hub_id, is_hub, rep, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "hub", "rep", "shingles")), strict=True):
                    own = np.frombuffer(raw, np.uint64)
                    if is_hub:
                        hub = own
                        continue
                    shared = len(np.intersect1d(hub, own, assume_unique=True))
                    if 100 * shared >= hundredths * (len(hub) + len(own) - shared):
                        a.append(hub_id)
                        b.append(rep)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        return stored(dealt_by(dealt, "a", "chunk").sortWithinPartitions("a", "chunk", F.desc("hub")).mapInArrow(confirmed, "a bigint, b bigint"), "links")

    def block_links(self, members: DataFrame, pairs: DataFrame) -> DataFrame:
        """(a, b): links of different components in pairs of blocks."""
        sides = pairs.select("pair", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
        dealt = members.join(self.reps, "rep").join(sides, "block").select("pair", "rep", "comp", "sig")
        t = self.t

        def candidates(rows: list[tuple]) -> list[tuple]:
            sig = np.array([r[3] for r in rows], np.int32)
            comp = np.array([r[2] for r in rows])
            hit = np.zeros(len(rows), bool)
            for i in range(len(rows) - 1):
                near = ((sig[i + 1 :] == sig[i]).sum(1) >= t) & (comp[i + 1 :] != comp[i])
                hit[i] |= near.any()
                hit[i + 1 :] |= near
            return [(rows[i][0], rows[i][1], rows[i][2]) for i in np.flatnonzero(hit)]

        met = stored(by_pair(dealt, candidates, ["pair", "rep", "comp"]), "met")
        dealt = self.sets(stored(met.select("rep").distinct(), "wanted")).join(met, "rep").select("pair", "rep", "comp", "shingles")
        hundredths = self.hundredths

        def confirmed(rows: list[tuple]) -> list[tuple]:
            return forest([r[1] for r in rows], [np.frombuffer(r[3], np.uint64) for r in rows], np.array([r[2] for r in rows]), hundredths)

        return stored(by_pair(dealt, confirmed, ["a", "b"]), "links")


def by_pair(dealt: DataFrame, work, names: list[str]) -> DataFrame:
    """What ``work`` makes of the rows of every pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != now:
                    out += work(rows) if len(rows) > 1 else []
                    now, rows = row[0], []
                rows.append(row)
            yield flush()
        out += work(rows) if len(rows) > 1 else []
        yield flush()

    return dealt_by(dealt, "pair").sortWithinPartitions("pair").mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def forest(ids: list[int], sets: list[np.ndarray], comp: np.ndarray, similarity: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among documents of different components, by full sets; ``similarity`` in hundredths."""
    n = len(ids)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    often = np.bincount(at) > 1
    place = np.cumsum(often) - 1
    keep = often[at]
    row, col = row[keep], place[at[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width, shared = 4096, np.zeros((n, n), np.float32)
    cuts = np.searchsorted(col, np.arange(0, int(often.sum()) + width, width))
    for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            used = np.unique(row[a:b])  # few documents of a block share any one stretch of columns
            m = np.zeros((len(used), width), np.float32)
            m[np.searchsorted(used, row[a:b]), col[a:b] - c * width] = 1
            shared[np.ix_(used, used)] += m @ m.T
    shared = shared.astype(np.int64)
    linked = (100 * shared >= similarity * (size[:, None] + size[None, :] - shared)) & (comp[:, None] != comp[None, :])
    over = {}

    def root(x):
        while x in over:
            x = over[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        a, b = root(comp[i]), root(comp[j])
        if a != b:
            over[b] = a
            out.append((ids[int(i)], ids[int(j)]))
    return out


def near_components(docs: DataFrame, words: int, similarity: float, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """((row, doc_id, n_shingles, comp), (comp, n, first)): every row, and every component with its rows and its first (no_id, doc_id, row).

    Rows without words have no ``comp``.  ``by_id``: rows that share an id are linked.
    """
    before = mark()
    sig = stored(signed(docs, words), "signatures")
    own = sig.filter("n_shingles > 0")
    key = ["h1", "h2", "n_shingles"]
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = stored(own.groupBy(*key).agg(F.min("row").alias("rep"), F.first("sig").alias("sig"), F.min(first).alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    repeats = not sig.groupBy("row").count().filter("count > 1").isEmpty()
    corpus = Corpus(docs, classes.select("rep", "sig"), words, similarity, repeats)
    found = linked(stored(postings(corpus.reps, corpus.t), "postings"), corpus.links, corpus.block_links)
    rows = sig.select("row", "doc_id", *key)
    if by_id:
        with_rep = join_hot(rows.filter("n_shingles > 0 and doc_id is not null"), classes.select(*key, "rep", "n"), key)
        ids = with_rep.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("high")).filter("b < high").select("doc_id", "b")
        found = merged(found, stored(with_rep.join(ids, "doc_id").filter("rep != b").select(F.col("rep").alias("a"), "b").distinct(), "same_id"))
    whole = classes.select(*key, "rep", "first", "n").join(found, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "rep"))
    whole = stored(whole.select(*key, "first", "n", "comp"), "classes")
    groups = stored(whole.groupBy("comp").agg(F.sum("n").alias("n"), F.min("first").alias("first")), "groups")
    columns = ["row", "doc_id", "n_shingles", "comp"]
    with_comp = join_hot(rows.filter("n_shingles > 0"), whole.select(*key, "n", "comp"), key).select(*columns)
    wordless = rows.filter("n_shingles = 0").withColumn("comp", F.lit(None).cast("long")).select(*columns)
    rows = stored(with_comp.unionByName(wordless), "rows")
    release(before, keep=2)  # all but the groups and the rows
    return rows, groups


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows, groups = near_components(docs, words, similarity, by_id=True)
    ids = groups.select("comp", "n", F.col("first.doc_id").alias("component_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    out = join_hot(rows.filter("comp is not null"), ids, "comp").select(*columns)
    out = out.unionByName(rows.filter("comp is null").withColumn("component_id", F.col("doc_id")).select(*columns))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component: the rows of ``docs`` that stay, with the same columns.

    The row with the smallest id stays, of those that share it the one with the
    smallest hash; of rows equal in id and text, one.  Rows without words all
    stay; rows of different components stay even if they share an id.
    """
    rows, groups = near_components(docs, words, similarity, by_id=False)
    with_first = join_hot(rows.filter("comp is not null"), groups.select("comp", "n", F.col("first.row").alias("best")), "comp")
    row = free_name(docs, "_row")
    gone = stored(with_first.filter("row != best").select(F.col("row").alias(row)).distinct(), "gone")
    repeated = stored(with_first.filter("row = best").groupBy("row").count().filter("count > 1").select(F.col("row").alias(row)), "repeated")
    out = docs.withColumn(row, F.xxhash64("doc_id", "text")).join(if_few(gone), row, "left_anti")
    if not repeated.isEmpty():
        again = out.join(if_few(repeated), row, "left_semi").dropDuplicates([row])
        out = out.join(if_few(repeated), row, "left_anti").unionByName(again)
    return out.select(*docs.columns)


def op6_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 0.85)
