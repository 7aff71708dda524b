"""Language-model scores by a hierarchical Pitman-Yor process.

Every word is a dish and every word, and the start of a text, a context.  The frequent words
(those with at least ``SHARE`` of all training tokens, so at most 1 / SHARE of them), the start,
and all rarer words together have a restaurant each, whose dishes are the frequent words and
one for all rarer words; their tables are customers of one
parent restaurant, whose base is uniform.  A rarer word is then drawn from a
restaurant of the rarer words, with a share of its mass for words never seen.  These are the
parents of what follows: each rarer word has a restaurant of its own as a context, for all words, whose
parent is that of the rarer contexts together, and each frequent context one for the rarer words after
it, whose parent is the restaurant of the rarer words.  A parent counts all tokens, not its children's tables.

Seating is sampled by Gibbs sweeps: each sweep takes the customers of every dish
out of their restaurants and seats them anew, given the tables of the other
dishes and the parent's predictive probabilities.  Customers are seated in
batches of a tenth of those that sit already.  The restaurants with parents of their own are seated after them,
``CHILD_SWEEPS`` times, each dish given the tables of the sweep before; a pair that occurs once has one table.  Words of the rare restaurant with
equal counts are exchangeable and are sampled together.  After ``BURN_IN``
sweeps the predictive probabilities of the samples are averaged; scores and
perplexity use these averages.

Everything gathered from the corpus follows its size: counts of all words and of
all context-dish pairs over all training texts.  What reaches the driver and the
executors whole is bounded: (1 / SHARE + 2)^2 pair counts, 1 / KNOWN_SHARE
frequent words with their counts, and how many rarer words have which count: every
count by itself, a row each.  Different counts add up to the tokens at most, so there are
sqrt(2 * tokens) of them at most, 10^5 for 5 * 10^9 tokens.  The counts of all other words
stay in a table, to which the rarer words of every document are joined by hash, and so do the pairs with a rarer word,
to which those of every document are joined by a hash of both words.

Defined results: null and empty texts consist of the end token; without training
texts the base formula and the uniform model apply; repeated rows, and rows with
null or repeated ids, are each scored; words of equal counts are a tie that the
hash settles; a text of any length is scored whole; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import secrets
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import id_remainder, join_hot, mark, release, stored, table

SHARE = 1 / 2000
KNOWN_SHARE = 1 / 200_000
DISCOUNT, STRENGTH = 0.75, 1.0
SWEEPS, BURN_IN = 12, 4
CHILD_SWEEPS, DRAWS = 3, 4  # of the restaurants of rarer words; of the last of these sweeps, the mean is taken of so many
FLUSH = 600_000
SLICES = 4  # of the pairs, by their hash, that are joined to the documents one after another: each shuffles its share only
MEMO = 600_000
RARE = 1 << 20  # word hashes are above this, indices of frequent words below
START = RARE - 1  # the context of a text's first token
END = xxhash.xxh64_intdigest(b"\n") | RARE  # no word holds a line break


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) | RARE


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def _signed(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def seat(customers: np.ndarray, base: np.ndarray, tables: np.ndarray, discount: float, strength: float, rng: np.random.Generator, many: np.ndarray | None = None) -> np.ndarray:
    """Tables of each dish after its customers were seated anew.

    ``base``: the parent's probability of the dish; ``tables``: all tables of the
    restaurant before; ``many``: how many like dishes each entry stands for (the
    result is then their mean).
    """
    n_all = customers.astype(np.int64)
    t_all = np.zeros(customers.shape)
    at = np.flatnonzero(n_all > 0)
    t_all.flat[at] = 1.0
    open_ = ((strength + discount * tables) * base).flat[at] if base.shape == customers.shape else np.broadcast_to((strength + discount * tables) * base, customers.shape).flat[at]
    goal, t, n = n_all.flat[at], np.ones(len(at)), np.ones(len(at), np.int64)
    k = np.ones(len(at), np.int64) if many is None else many.flat[at].astype(np.int64)
    live = np.flatnonzero(goal > 1)
    while len(live):
        m = np.minimum(np.maximum(1, n[live] // 10), goal[live] - n[live])
        p = open_[live] / (open_[live] + n[live] - discount * t[live])
        t[live] += rng.binomial(m * k[live], p) / k[live]
        n[live] += m
        live = live[n[live] < goal[live]]
    t_all.flat[at] = t
    return t_all


def sample_contexts(counts: np.ndarray, sweeps: int = SWEEPS, burn_in: int = BURN_IN, seed: int = 1) -> np.ndarray:
    """Averaged predictive probability of each dish (column) in each context (row)."""
    rng = np.random.default_rng(seed)
    rows, dishes = counts.shape
    tables = (counts > 0).astype(float)
    root = (tables.sum(0) > 0).astype(float)
    total = counts.sum(1, keepdims=True)
    out, taken = np.zeros((rows, dishes)), 0
    for sweep in range(sweeps):
        customers = tables.sum(0)
        root = seat(customers, np.full(dishes, 1 / dishes), np.full(dishes, root.sum()), DISCOUNT, STRENGTH, rng)
        parent = (customers - DISCOUNT * root + (STRENGTH + DISCOUNT * root.sum()) / dishes) / (STRENGTH + customers.sum())
        own = np.broadcast_to(tables.sum(1, keepdims=True), counts.shape)
        tables = seat(counts, np.broadcast_to(parent, counts.shape), own, DISCOUNT, STRENGTH, rng)
        if sweep >= burn_in:
            left = STRENGTH + DISCOUNT * tables.sum(1, keepdims=True)
            out += (counts - DISCOUNT * tables + left * parent) / (STRENGTH + total)
            taken += 1
    return out / taken


def sample_rare(counts: np.ndarray, many: np.ndarray, types: int, sweeps: int = SWEEPS, burn_in: int = BURN_IN, seed: int = 2) -> tuple[np.ndarray, float]:
    """Averaged predictive probability of a word with each of ``counts``, and of an unseen word.

    ``many``: words with that count; ``types``: of the uniform base.
    """
    rng = np.random.default_rng(seed)
    total = float((counts * many).sum())
    tables = np.ones(len(counts))
    out, unseen = np.zeros(len(counts)), 0.0
    base = np.full(len(counts), 1 / types)
    for sweep in range(sweeps):
        tables = seat(counts, base, np.full(len(counts), float((tables * many).sum())), DISCOUNT, STRENGTH, rng, many)
        if sweep >= burn_in:
            new = (STRENGTH + DISCOUNT * float((tables * many).sum())) / (STRENGTH + total) / types
            out += (counts - DISCOUNT * tables) / (STRENGTH + total) + new
            unseen += new
    return out / (sweeps - burn_in), unseen / (sweeps - burn_in)


def count_words(training: DataFrame) -> DataFrame:
    """(h, c): how often every word, and the end, occurs in the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        ends = 0

        def flush() -> pa.RecordBatch:
            h, c = [word_hash(w) for w in seen], list(seen.values())
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(_signed(h)), pa.array(c, pa.int64())], names=["h", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
                ends += 1
                if len(seen) > FLUSH:
                    yield flush()
        yield flush()
        yield pa.RecordBatch.from_arrays([pa.array(_signed([END])), pa.array([ends], pa.int64())], names=["h", "c"])

    return training.select("text").mapInArrow(count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")).filter("c > 0")


@dataclass
class Coder:
    """Indices of frequent words; hashes of the others.

    ``index``: hash -> place in ``counts``; the first ``dishes`` places are dishes
    with restaurants of their own, the rest are words whose counts are at hand.
    """

    index: dict[int, int]
    dishes: int
    counts: np.ndarray
    memo: dict[bytes, int] = field(default_factory=dict)

    def codes(self, text: str | None) -> np.ndarray:
        """Codes of the words and the end: a place, or the hash of another word."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        out, get, index = [], memo.get, self.index
        for w in words_of(text):
            c = get(w)
            if c is None:
                h = word_hash(w)
                c = memo[w] = index.get(h, h)
            out.append(c)
        out.append(index.get(END, END))
        return np.array(out, dtype=np.uint64)

    def pairs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context and dish of every token; contexts end with the start and the rare words."""
        f = self.dishes
        dish = np.minimum(codes, np.uint64(f)).astype(np.int64)
        context = np.concatenate(([f], np.where(dish[:-1] == f, f + 1, dish[:-1])))
        return context, dish


    def children(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts, words and hashes of the pairs with a rarer word, in codes."""
        f = np.uint64(self.dishes)
        before = np.concatenate((np.array([START], np.uint64), codes[:-1]))
        at = (codes >= f) | ((before >= f) & (before != np.uint64(START)))
        u, w = before[at], codes[at]
        z = u * np.uint64(0x9E3779B97F4A7C15) ^ (w + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return u, w, (z ^ (z >> np.uint64(29))).view(np.int64)


def count_pairs(training: DataFrame, coder: Coder) -> DataFrame:
    """(p, c): how often every dish follows every context in the training texts."""
    width = coder.dishes + 1
    shared = training.sparkSession.sparkContext.broadcast((coder.index, coder.dishes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Coder(*shared.value, np.zeros(0))
        total = np.zeros((width + 1) * width, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                context, dish = own.pairs(own.codes(text))
                p, c = np.unique(context * width + dish, return_counts=True)
                total[p] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["p", "c"])

    return training.select("text").mapInArrow(count, "p bigint, c bigint").groupBy("p").agg(F.sum("c").alias("c"))


def count_children(training: DataFrame, coder: Coder) -> DataFrame:
    """(p, u, w, c): how often every word follows every context in the training texts, where one of both is rarer; ``p`` is the pair's hash."""
    shared = training.sparkSession.sparkContext.broadcast((coder.index, coder.dishes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Coder(*shared.value, np.zeros(0))
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            u, w, p = (np.concatenate(x) for x in zip(*held, strict=True))
            p, at, c = np.unique(p, return_index=True, return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (p, u[at].view(np.int64), w[at].view(np.int64), c)], names=["p", "u", "w", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(own.children(own.codes(text)))
                n += len(held[-1][0])
                if n > FLUSH:
                    n = 0
                    yield flush()
        if held:
            yield flush()

    found = training.select("text").mapInArrow(count, "p bigint, u bigint, w bigint, c bigint")
    return found.groupBy("p").agg(F.max("u").alias("u"), F.max("w").alias("w"), F.sum("c").alias("c"))


def seat_children(pairs: DataFrame, draws: int, seed: int) -> DataFrame:
    """(p, u, c, lp, t): the pairs' tables; ``pairs`` has the restaurant's ``tables`` and, in ``lp``, log10 of the parent's probability."""

    def sit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, u, c, lp, tables = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            rng = np.random.default_rng([seed, int(p[:1].view(np.uint64).sum())])
            t = sum(seat(c, 10.0**lp, tables, DISCOUNT, STRENGTH, rng) for _ in range(draws)) / draws if len(c) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(t, pa.float64())], names=["p", "u", "c", "lp", "t"])

    return pairs.select("p", "u", "c", "lp", "tables").mapInArrow(sit, "p bigint, u bigint, c bigint, lp double, t double")


def child_restaurants(training: DataFrame, coder: Coder, log_rest: np.ndarray, log_known: np.ndarray, far: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((u, lb), (p, lc)): log10 of the share that the restaurant of ``u`` leaves to its parent, and what each of its pairs adds to that and the parent's log10.

    ``log_rest``: of the dishes in the restaurant of the rarer contexts together; ``far``: (w, lp) of the rarer words that ``coder`` does not know.
    """
    spark, f = training.sparkSession, coder.dishes
    before = mark()
    pairs = stored(count_children(training, coder), "pairs")
    # the parent's probability: of a frequent word, or of a rarer one, which is one dish more where contexts are rarer, too
    known = pa.table({"w": pa.array(np.arange(f + len(log_known))), "lp": pa.array(np.concatenate((log_rest[:f], log_known)))})
    known = spark.createDataFrame(known) if len(known) else spark.createDataFrame([], "w bigint, lp double")
    near = pairs.filter(F.col("w") < RARE).filter("w >= 0").join(F.broadcast(known), "w")
    pairs = near.unionByName(pairs.filter((F.col("w") >= RARE) | (F.col("w") < 0)).join(far.select("w", "lp"), "w"))
    frequent = ((F.col("u") >= 0) & (F.col("u") < f)) | (F.col("u") == START)
    dish = F.when(((F.col("w") >= 0) & (F.col("w") < f)) | frequent, 0.0).otherwise(float(log_rest[f]))
    # together by restaurants, so that these and the probabilities, of which there are few, take little room
    pairs = stored(pairs.select("p", "u", "c", (F.col("lp") + dish).alias("lp")).sortWithinPartitions("u"), "children")
    release(before, keep=1)
    own = stored(pairs.groupBy("u").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") > 1).alias("many")), "restaurants")
    tables = own.withColumn("tables", F.col("n").cast("double"))
    for sweep in range(CHILD_SWEEPS):
        met = join_hot(pairs.filter("c > 1"), tables.filter("many > 0").select("u", "tables", "many"), "u", n="many")
        seated = stored(seat_children(met, DRAWS if sweep == CHILD_SWEEPS - 1 else 1, sweep), "seated")
        more = seated.groupBy("u").agg(F.sum(F.col("t") - 1).alias("more"))
        tables = stored(own.join(more, "u", "left").select("u", "total", "n", "many", (F.col("n") + F.coalesce("more", F.lit(0.0))).alias("tables")), "tables")
    left = STRENGTH + DISCOUNT * F.col("tables")
    whole = pairs.filter("c = 1").withColumn("t", F.lit(1.0)).unionByName(seated)
    met = join_hot(whole, tables.select("u", "tables", "n"), "u")
    added = met.select("p", F.log10(1 + (F.col("c") - DISCOUNT * F.col("t")) / (left * F.pow(F.lit(10.0), "lp"))).alias("lc"))
    return tables.select("u", F.log10(left / (STRENGTH + F.col("total"))).alias("lb")), added


PARTS = "key bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, h array<bigint>, n array<bigint>, p array<bigint>, k array<bigint>"


def parts(docs: DataFrame, coder: Coder, log_context: np.ndarray, log_known: np.ndarray, log_base: np.ndarray, log_left: np.ndarray) -> DataFrame:
    """Per document: what frequent words and contexts say, and its other words, and pairs with a rarer one, with their numbers.

    ``log_left``: of the known contexts, by code, and the start.
    """
    shared = docs.sparkSession.sparkContext.broadcast((coder.index, coder.dishes, log_context.astype(np.float32), log_known, log_base, log_left))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, dishes, contexts, known, base, left = shared.value
        own, f = Coder(index, dishes, np.zeros(0)), dishes
        for batch in batches:
            rows = []
            for doc_id, held_out, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = own.codes(text)
                context, dish = own.pairs(codes)
                s = float(contexts[context, dish].sum(dtype=np.float64))
                far = codes >= RARE
                near = codes[~far].astype(np.int64)
                s += float(known[near[near >= f] - f].sum())
                h, n = np.unique(codes[far], return_counts=True)
                u, _, p = own.children(codes)
                u = np.where(u == np.uint64(START), np.uint64(len(left) - 1), u)
                s += float(left[u[u < RARE].astype(np.int64)].sum())
                p, k = np.unique(p, return_counts=True)
                rows.append((secrets.randbits(63), doc_id, held_out, len(codes), len(near), float(base[near].sum()), s, h.view(np.int64), n, p, k))
            cols = list(zip(*rows, strict=True)) or [()] * 11
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), *[pa.list_(pa.int64())] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "h", "n", "p", "k"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(score, PARTS)


def score_documents(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``docs`` has doc_id, held_out and text; ``training`` has text.
    """
    words = stored(count_words(training), "words")
    tokens, types = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = words.filter(F.col("c") >= max(1.0, tokens * KNOWN_SHARE)).toArrow()  # 1 / KNOWN_SHARE rows at most
    h = frequent["h"].to_numpy().view(np.uint64)
    c = frequent["c"].to_numpy()
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    f = int((c >= tokens * SHARE).sum())
    coder = Coder({int(x): i for i, x in enumerate(h)}, f, c)
    # context restaurants
    pairs = count_pairs(training, coder).toArrow()  # (f + 2) * (f + 1) rows at most
    counts = np.zeros((f + 2) * (f + 1))
    counts[pairs["p"].to_numpy()] = pairs["c"].to_numpy()
    log_context = np.log10(sample_contexts(counts.reshape(f + 2, f + 1)))
    # the restaurant of rarer words, by how often they occur
    rare = words.filter(F.col("c") < tokens * SHARE)
    by_count = rare.groupBy("c").agg(F.count(F.lit(1)).alias("k")).orderBy("c").toArrow()  # sqrt(2 * tokens) rows at most
    k, many = by_count["c"].to_numpy(), by_count["k"].to_numpy()
    p, unseen = sample_rare(k, many, types + 1)
    log_of = dict(zip(k.tolist(), np.log10(p).tolist(), strict=True))
    log_known = np.array([log_of[x] for x in c[f:].tolist()])
    whole = tokens + 0.5 * (types + 1)
    log_base = np.log10((c + 0.5) / whole)

    spark = docs.sparkSession
    rare_log = pa.table({"c": by_count["c"], "lp": np.log10(p)})
    rare_log = spark.createDataFrame(rare_log) if len(k) else spark.createDataFrame([], "c bigint, lp double")
    rest = rare.filter(F.col("c") < tokens * KNOWN_SHARE).join(F.broadcast(rare_log), "c").select(F.col("h").alias("w"), "c", "lp")
    restaurants, added = child_restaurants(training, coder, log_context[f + 1], log_known, rest)
    near = restaurants.filter((F.col("u") >= 0) & (F.col("u") < RARE)).toArrow()  # 1 / KNOWN_SHARE rows at most, and the start
    log_left = np.zeros(len(c) + 1)
    at = near["u"].to_numpy()
    log_left[np.where(at == START, len(c), at)] = near["lb"].to_numpy()
    found = stored(parts(docs, coder, log_context, log_known, log_base, log_left), "scores")
    rest = rest.join(restaurants, rest["w"] == restaurants["u"], "left").select("w", "c", (F.col("lp") + F.coalesce("lb", F.lit(0.0))).alias("lp"))
    far = found.select("key", F.explode(F.arrays_zip("h", "n")).alias("x")).select("key", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    joined = far.join(rest, far["h"] == rest["w"], "left")
    count = F.coalesce("c", F.lit(0))
    more = joined.groupBy("key").agg(
        F.sum(F.when(count > 0, F.col("n")).otherwise(0)).alias("known2"),
        F.sum(F.col("n") * F.log10((count + 0.5) / F.lit(whole))).alias("base2"),
        F.sum(F.col("n") * F.coalesce("lp", F.lit(float(np.log10(unseen))))).alias("score2"),
    )
    more = stored(more, "more")
    met = found.select("key", F.explode(F.arrays_zip("p", "k")).alias("x")).select("key", F.col("x.p").alias("p"), F.col("x.k").alias("k"))
    own = F.pmod("p", F.lit(SLICES))
    slices = [stored(met.filter(own == i).join(added.filter(own == i), "p").groupBy("key").agg(F.sum(F.col("k") * F.col("lc")).alias("score3")), "slice") for i in range(SLICES)]
    pairs = reduce(DataFrame.unionByName, slices).groupBy(F.col("key").alias("key3")).agg(F.sum("score3").alias("score3"))
    out = found.drop("h", "n", "p", "k").join(pairs, F.col("key") == F.col("key3"), "left").join(more.withColumnRenamed("key", "key2"), F.col("key") == F.col("key2"), "left")
    zero = F.lit(0)
    score = F.col("score") + F.coalesce("score2", zero) + F.coalesce("score3", zero)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known2", zero)).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero)).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )


def op8_language_model(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (id_remainder("doc_id", 5) == 1).alias("held_out"))
    return score_documents(docs, docs.filter(~F.col("held_out")))
