"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0), which says nothing.  A document
is good, or bad in one of the ways of ``KINDS``: repetition, wording, shape.
Expectation-maximisation over the votes estimates, for good documents and for each
kind, how often a vote of each rule is "bad", and the shares of all four: a rule has an
accuracy on good documents and another one on bad ones, so that the good votes that
junk gets like any other text say little.  The posterior probability of "good"
replaces the all-must-pass filter.  Kinds begin with the rules that are theirs; one
kind for all of them would learn the commonest alone and take the others for good.
The rates of a kind with two rules are known loosely: a document with one bad vote
of such a kind, all others being good, is near the threshold.

The text is read once, in Arrow batches, to count features; votes, posterior
and verdict are column expressions.  EM runs on the driver over the distinct
vote patterns with their counts: at most 3 ** len(RULES) = 6561 rows at any
corpus size.

Defined results: a null or empty text has no words and fails the base rules; a text
of any length is counted whole; null and repeated ids, and repeated rows, each get
their own verdict; a posterior equal to the threshold keeps; an empty table gives an
empty result (EM then keeps its starting values); columns of the input that share a
name with an output column are not touched, since features live in one struct.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postroom.llm.common import free_name, stored, table

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = frozenset(
    w.encode()
    for w in (
        "the of and to in is that it for was as with be by on are this or "
        "le la de et des les un une que qui du pour dans est par sur au en "
        "der die das und den von zu mit ein eine ist nicht sich im für auf "
        "el los las del y que un una por con para se su no lo es"
    ).split()
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop", "n_upper", "n_ended", "n_distinct")
FEATURES = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

_P = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        rolled += h[k : k + n] * _P[k % WINDOW] * np.uint64(2 * (k // WINDOW) + 1)
    order = np.argsort(rolled)
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def features(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of ``COUNTS``."""
    raw = (text or "").encode("utf-8")
    words = raw.split()
    if not words:
        return (0,) * len(COUNTS)
    blanks = len(raw) - sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lower = raw.lower().split()
    distinct = set(lower)
    stops = distinct & STOP_WORDS
    return (
        len(words),
        len(text) - blanks,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        sum(w in stops for w in lower) if stops else 0,
        len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        sum(x.rstrip()[-1:] in b".!?:;\"" for x in lines),
        len(distinct),
    )


def with_features(df: DataFrame, text: str, keep: list[str], into: str) -> DataFrame:
    """Columns ``keep`` of ``df`` and the struct ``into`` with the counts of ``text``."""
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(into, FEATURES)])
    columns = keep if text in keep else [*keep, text]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column(columns.index(text)).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(COUNTS)
            struct = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(COUNTS))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), struct], names=[*keep, into])

    return df.select(*columns).mapInArrow(count, schema)


def rules(f: Column) -> list[tuple[str, Column]]:
    """Name and vote of every rule over the struct of counts."""
    words, chars = f["n_words"], f["word_chars"]

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return [
        ("length", vote(words < 20, words >= 50)),
        ("word_length", vote((chars < 2 * words) | (chars > 12 * words), (chars >= 3 * words) & (chars <= 9 * words))),
        ("symbols", vote(10 * f["n_symbols"] > words, 100 * f["n_symbols"] <= words)),
        ("repeated_windows", vote(100 * f["n_repeat_words"] > 30 * words, 100 * f["n_repeat_words"] <= 5 * words)),
        ("repeated_lines", vote(10 * f["n_dup_lines"] > 3 * f["n_lines"], f["n_dup_lines"] == 0)),
        ("function_words", vote((words >= 20) & (100 * f["n_stop"] < 3 * words), 100 * f["n_stop"] >= 8 * words)),
        ("upper_case", vote(10 * f["n_upper"] > 3 * chars, 10 * f["n_upper"] <= chars)),
        ("sentence_ends", vote((words >= 20) & (f["n_ended"] == 0), 2 * f["n_ended"] >= f["n_lines"])),
    ]


#: The ways to be bad, each with the rules that it begins with.
KINDS = (("repeated_windows", "repeated_lines"), ("word_length", "symbols", "function_words", "upper_case"), ("length", "sentence_ends"))
#: Where EM begins: how often a vote on a good document is bad, and on a bad one by a rule of its kind; the share of good ones.
FALSE_ALARM, ALARM, GOOD = 0.05, 0.7, 0.85
WEIGHT = 4.0  # votes that these beginnings count for


def starting_rates(names: list[str]) -> np.ndarray:
    """Rate of bad votes by class (good, then ``KINDS``) and rule."""
    return np.array([[ALARM if name in kind else FALSE_ALARM for name in names] for kind in ((), *KINDS)])


def log_likelihoods(votes: np.ndarray, rates: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Of each vote pattern and class; abstentions add nothing."""
    return np.log(shares) + (votes == -1) @ np.log(rates).T + (votes == 1) @ np.log(1 - rates).T


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """(rates of bad votes by class and rule, shares of the classes) from vote patterns and their counts."""
    rates, shares = start, np.array([GOOD] + [(1 - GOOD) / (len(start) - 1)] * (len(start) - 1))
    if not len(votes):
        return rates, shares
    for _ in range(rounds):
        odds = log_likelihoods(votes, rates, shares)
        p = np.exp(odds - odds.max(axis=1, keepdims=True))
        p *= (counts / p.sum(axis=1))[:, None]
        bad, cast = p.T @ (votes == -1), p.T @ (votes != 0)
        new, shares = (bad + WEIGHT * start) / (cast + WEIGHT), (p.sum(axis=0) + 1) / (counts.sum() + len(start))
        done = np.abs(new - rates).max() < 1e-9
        rates = new
        if done:
            break
    return rates, shares


Fit = list[tuple[float, list[tuple[float, float]]]]


def fit(counted: DataFrame, into: str) -> Fit:
    """Of each kind the log odds against good: of its share, and of a bad and a good vote of every rule."""
    named = rules(F.col(into))
    patterns = counted.groupBy(*(v.alias(n) for n, v in named)).count().collect()
    votes = np.array([r[:-1] for r in patterns], dtype=float).reshape(-1, len(named))
    rates, shares = expectation_maximisation(votes, np.array([r[-1] for r in patterns], dtype=float), starting_rates([n for n, _ in named]))
    return [(math.log(shares[k] / shares[0]), [(math.log(a / b), math.log((1 - a) / (1 - b))) for a, b in zip(rates[k].tolist(), rates[0].tolist(), strict=True)]) for k in range(1, len(rates))]


def posterior(f: Column, fitted: Fit) -> Column:
    """Probability that a document is good."""
    against = F.lit(0.0)
    for share, weights in fitted:
        odds = F.lit(share)
        for (_, vote), (bad, good) in zip(rules(f), weights, strict=True):
            odds = odds + F.when(vote == -1, bad).when(vote == 1, good).otherwise(0.0)
        against = against + F.exp(odds)
    return 1 / (1 + against)


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 20) | (100 * f["n_repeat_words"] > 30 * f["n_words"])


def quality_verdicts(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, quality (posterior), kept."""
    f = F.col("f")
    counted = stored(with_features(docs, "text", ["doc_id"], "f"), "quality")
    out = counted.withColumn("quality", posterior(f, fit(counted, "f"))).withColumn("base_failed", base_failed(f))
    return out.select("doc_id", *(f[c].alias(c) for c in COUNTS), "base_failed", "quality", (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the verdict keeps, with the same columns."""
    name = free_name(docs, "_counts")
    slim = docs.select("text")
    fitted = fit(with_features(slim, "text", [], name), name)
    f = F.col(name)
    counted = with_features(docs, "text", docs.columns, name)
    return counted.filter(~base_failed(f) & (posterior(f, fitted) >= threshold)).select(*docs.columns)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_verdicts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("quality", 6).alias("quality"), "kept")
