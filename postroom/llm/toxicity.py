"""Toxicity by class-conditional Kneser-Ney language models.

Two models, of toxic and of ordinary text, share their lowest backoff counts:

* bigram of the class, absolute discounting, over the pooled bigram (an expression
  that few documents of the class have goes to the backoff entirely),
* continuation unigram of the class (number of distinct left contexts),
* continuation counts of the word's first letters in the class, which know
  rare expressions by their stem,
* continuation counts of first letters pooled over both classes,
* the pooled share of a word among the words of its stem; it is the same for
  both classes and so cancels out of the comparison.

A document is compared by its length-normalised log-likelihoods: the mean over
all tokens of log P(toxic) - log P(ordinary), and the largest such mean over
windows of ``WINDOW`` tokens, which finds a toxic passage in a long text.  A
logistic curve over both and the log of the length turns them into a score; it is fitted on training rows only, each
scored by models that were fitted without it.

The models are fitted on a bounded sample of labelled rows: at most
``max_docs_per_class`` training documents of each class, those of the smallest
hash of their id.  All else, scoring above all, covers every whole text.

Defined results: null and empty texts have a score too (that of no evidence);
unlabelled rows are scored, not learned from; several labels of one id count as
toxic if any is; repeated rows are each scored; without training rows of both
classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import id_remainder, table

STEM = 4
WINDOW = 48
DISCOUNT = 0.75
MAX_DOCS_PER_CLASS = 2500
THRESHOLD = 0.7
MEMO = 500_000
CLIP = (-1.0, 6.0)
#: A class keeps of an expression's count what is above this; families of near copies hold a few.
CLASS_DISCOUNT = 3.0
#: Counts that a context lends to the backoff besides its discounts; contexts seen a few times say little.
STRENGTH = 16.0
_EDGE = b".,;:!?\"'()[]{}<>|*#$%&-_=+/\\~`^"


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words without the punctuation around them."""
    return [w.strip(_EDGE) or w for w in (text or "").lower().encode("utf-8").split()]


def stem(word: bytes) -> bytes:
    return word.decode("utf-8", "ignore")[:STEM].encode("utf-8")


def _discounts(counts: np.ndarray) -> np.ndarray:
    """What a class gives up to the shared counts: of an expression that few documents have, all of it."""
    return np.minimum(counts, CLASS_DISCOUNT)


def _over(counts: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, float]:
    """Discounted class probabilities over a lower order, and the weight left to it."""
    off = _discounts(counts)
    total = max(counts.sum(), 1.0)
    left = off.sum() / total if counts.sum() else 1.0
    return (counts - off) / total + left * lower, left


@dataclass
class ClassModels:
    """log P(toxic) - log P(ordinary) of a word after a word.

    ``codes``: sorted (previous id, id) pairs that a class has more often than the discount,
    with ``ratio``; other pairs back off to the words' unigrams, weighted by
    what the previous word leaves to them in each class.  Ids from ``edge`` + 1
    on stand for unknown words of a known stem.
    """

    vocabulary: dict[bytes, int]
    stems: dict[bytes, int]
    codes: np.ndarray
    ratio: np.ndarray
    unigram: np.ndarray  # log ratio of each id
    backoff: np.ndarray  # log ratio of the weights that each previous id leaves

    def __post_init__(self):
        self.memo: dict[bytes, int] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.memo = {}

    def _id(self, raw: bytes) -> int:
        word = raw.strip(_EDGE) or raw
        edge = len(self.vocabulary)
        i = self.vocabulary.get(word)
        if i is None:
            i = edge + 1 + self.stems.get(stem(word), len(self.stems))
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[raw] = i
        return i

    def diffs(self, text: str | None) -> np.ndarray:
        raw = (text or "").lower().encode("utf-8").split()
        n = len(raw)
        if not n:
            return np.zeros(0)
        get, make = self.memo.get, self._id
        ids = np.fromiter([i if (i := get(w)) is not None else make(w) for w in raw], np.int64, n)
        width = len(self.unigram)
        before = np.empty(n, np.int64)
        before[0] = len(self.vocabulary)
        before[1:] = ids[:-1]
        out = self.unigram[ids] + self.backoff[before]
        if len(self.codes):
            pair = before * width + ids
            at = np.searchsorted(self.codes, pair)
            at[at == len(self.codes)] = 0
            seen = self.codes[at] == pair
            out[seen] = self.ratio[at[seen]]
        out[ids == before] = 0.0  # a word said over and over counts once
        return out

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """Mean over the text, largest mean over a window, and log of the length, by which the latter grows."""
        d = self.diffs(text)
        n = len(d)
        if not n:
            return 0.0, 0.0, 0.0
        d = np.clip(d, *CLIP)  # no single token decides
        if n <= WINDOW:
            return float(d.mean()), float(d.sum() / WINDOW), 0.0
        total = np.concatenate(([0.0], np.cumsum(d)))
        return float(d.mean()), float((total[WINDOW:] - total[:-WINDOW]).max() / WINDOW), float(np.log(n / WINDOW))


def fit_models(toxic: list[str], ordinary: list[str]) -> ClassModels:
    """Both models from texts; exact copies of a text count once."""
    vocabulary: dict[bytes, int] = {}
    docs_ids = []
    for texts in (toxic, ordinary):
        own = []
        for t in dict.fromkeys(texts):
            own.append(np.array([-1, *(vocabulary.setdefault(w, len(vocabulary)) for w in tokens(t))], dtype=np.int64))
        docs_ids.append(own)
    v = len(vocabulary)
    stem_ids: dict[bytes, int] = {}
    of_word = np.fromiter((stem_ids.setdefault(stem(w), len(stem_ids)) for w in vocabulary), np.int64, v)
    s = len(stem_ids)
    width = v + 2 + s  # words, the edge of a text, unknown words by stem, words of unknown stem
    pairs, counts, cont = [], [], []
    for own in docs_ids:
        # an expression counts once for each document, so that one document's refrain stays a rare expression
        codes = [np.unique(np.where(i[:-1] < 0, v, i[:-1]) * width + i[1:]) for i in own if len(i) > 1]
        u, c = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.int64), return_counts=True)
        pairs.append(u)
        counts.append(c.astype(float))
        # Kneser-Ney continuation counts: distinct left contexts, at most one of each document
        holders = np.bincount(np.concatenate([np.unique(x % width) for x in codes]) if codes else np.zeros(0, np.int64), minlength=v)[:v]
        cont.append(np.minimum(np.bincount(u % width, minlength=v)[:v], holders).astype(float))
    by_stem = [np.bincount(of_word, weights=c, minlength=s) for c in cont]
    pooled = by_stem[0] + by_stem[1]
    pooled = (np.maximum(pooled - DISCOUNT, 0) + DISCOUNT * np.count_nonzero(pooled) / (s + 1)) / max(pooled.sum(), 1.0)
    words = cont[0] + cont[1]
    share = words / np.maximum(np.bincount(of_word, weights=words, minlength=s)[of_word], 1.0)
    of_stem, stem_left, of_unigram, word_left, left_by = [], [], [], [], []
    for k in (0, 1):
        p, left = _over(by_stem[k], pooled)
        of_stem.append(p)
        stem_left.append(left)
        p, left = _over(cont[k], share * p[of_word])
        of_unigram.append(p)
        word_left.append(left)
    # pooled bigrams over pooled unigrams: what both classes back off to
    word_share = words / max(words.sum(), 1.0)
    pooled_pairs, at = np.unique(np.concatenate(pairs), return_inverse=True)
    pooled_counts = np.bincount(at, weights=np.concatenate(counts), minlength=len(pooled_pairs))
    pooled_total = np.bincount(pooled_pairs // width, weights=pooled_counts, minlength=width) + STRENGTH
    frequent = np.unique(np.concatenate([u[c > CLASS_DISCOUNT] for u, c in zip(pairs, counts, strict=True)]))
    b, w = frequent // width, frequent % width
    both = (pooled_counts[np.searchsorted(pooled_pairs, frequent)] + STRENGTH * word_share[w]) / pooled_total[b]
    seen = []
    for u, c, p in zip(pairs, counts, of_unigram, strict=True):
        before, off = u // width, _discounts(c)
        total = np.bincount(before, weights=c, minlength=width) + STRENGTH
        left = (np.bincount(before, weights=off, minlength=width) + STRENGTH) / total
        at = np.searchsorted(u, frequent)
        at[at == len(u)] = 0
        own = np.where(u[at] == frequent, (c - off)[at], 0.0) if len(u) else np.zeros(len(frequent))
        seen.append(own / total[b] + left[b] * both * p[w] / word_share[w])
        left_by.append(left)
    lower = np.log(word_left[0] / word_left[1])
    unigram = np.concatenate((np.log(of_unigram[0] / of_unigram[1]), [0.0], np.log(of_stem[0] / of_stem[1]) + lower, [np.log(stem_left[0] / stem_left[1]) + lower]))
    return ClassModels(vocabulary, stem_ids, frequent, np.log(seen[0] / seen[1]), unigram, np.log(left_by[0] / left_by[1]))


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression on standardised columns, bias last, for raw columns."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    ridge = np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    raw = w[:-1] / scale
    return np.append(raw, w[-1] - raw @ mean)


@dataclass
class Scorer:
    models: ClassModels | None
    curve: np.ndarray

    def score(self, text: str | None) -> float:
        if self.models is None:
            return 0.0
        z = float(np.dot(self.curve[:-1], self.models.evidence(text)) + self.curve[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit_scorer(rows: list[tuple[str, int]]) -> Scorer:
    """``rows``: text and label of the training documents, in a fixed order."""
    by = [[t for t, y in rows if y == k] for k in (0, 1)]
    if min(map(len, by)) < 2:
        return Scorer(None, np.zeros(4))
    x, y = [], []
    folds = 2 if min(map(len, by)) >= 500 else min(10, min(map(len, by)))  # few rows: leave few out
    for fold in range(folds):
        m = fit_models(*([t for i, t in enumerate(by[k]) if i % folds != fold] for k in (1, 0)))
        for k in (0, 1):
            for t in by[k][fold::folds]:
                x.append(m.evidence(t))
                y.append(k)
    return Scorer(fit_models(by[1], by[0]), fit_curve(np.array(x), np.array(y, dtype=float)))


def training_rows(docs: DataFrame, labels: DataFrame, max_docs_per_class: int) -> list[tuple[str, int]]:
    """At most ``max_docs_per_class`` rows of each class that are not held out."""
    own = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.filter(id_remainder("doc_id", 3) != 1).withColumn("h", F.xxhash64("doc_id"))
    chosen = None
    for k in (0, 1):
        part = own.filter(F.col("toxic") == k).orderBy("h", "doc_id").limit(max_docs_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # bounded by max_docs_per_class, hence the broadcast
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = joined.groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text")).toArrow().to_pylist()
    return [(r["text"] or "", r["toxic"]) for r in sorted(got, key=lambda r: (r["h"], r["doc_id"]))]


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_docs_per_class: int = MAX_DOCS_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    spark = docs.sparkSession
    scorer = spark.sparkContext.broadcast(fit_scorer(training_rows(docs, labels, max_docs_per_class)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer.value
        for batch in batches:
            s = [own.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "text")
    scored = rows.mapInArrow(score, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
