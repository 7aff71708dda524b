"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of template tokens: lower-cased words without the
punctuation around them, with numbers, units after numbers and names replaced by
typed placeholders (``NUM``, ``UNIT``, ``NAME``; neighbouring names are one).
A name is a capitalised word that no item has in lower case, at the start of a
sentence too.  A second reading keeps names as words, so that copies in another
case are found.  Windows with more placeholders than words say little as
templates; they are matched by the surface of their numbers instead, exactly.

Windows of ``window`` template tokens of every benchmark item form a hash index;
the windows of every document are joined to it.  Windows that hit one item on
one diagonal (document position less item position), or on diagonals at most
``DRIFT`` apart (a word was put in or left out), are laid together, and the
slots under them are compared: each value of the item must stand for one value
of the document and the other way round.  A match is ``exact`` if all values are
equal, ``reparameterised`` if they are consistent but differ; inconsistent ones
are dropped.  A document is contaminated by an item if the matched windows cover
``min_share`` of the item's template, or ``min_tokens`` of it.

The index is a hash table in every worker.  Its size is bounded: the benchmark
is cut into blocks of about ``block_chars`` characters by hash of the item id,
and each block is one pass over the documents, so any benchmark works and none
is broadcast whole.

Defined results: null and empty texts match nothing, items without words are
left out; items shorter than a window are matched whole if they have at least
``min_item`` tokens; repeated items are reported by each of their ids; repeated
documents, and those with null or repeated ids, each get their row; of several
matches of one item the exact one counts, then the longest; a text of any length
is searched whole; without documents or items nothing is found; other columns of
the documents are not read, and ``drop_leaks`` keeps them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postroom.llm.common import stored, table

WINDOW = 8
MIN_SHARE = 0.5
MIN_TOKENS = 30
MIN_ITEM = 5
BLOCK_CHARS = 4_000_000
MEMO = 500_000
DRIFT = 3  # tokens put in or left out between windows that are laid together
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs oz "
    "ml l litre litres liter liters s sec second seconds min minute minutes h hour hours day days week weeks month months "
    "year years percent % $ € £ dollar dollars euro euros cent cents kmh mph hz khz mhz w kw v kb mb gb tb c f k".split()
)
NUM, UNIT, NAME = 1, 2, 3  # ids of the placeholders; 0: a word that no item has
_FIRST = 4
_CAP, _END, _NUM, _UNIT = 1, 2, 4, 8
_EDGE = ".,;:!?\"'()[]{}<>|*#&=_~`^…«»“”‘’-"
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%|[a-zA-Z]{1,3})?")


def _mix(ids: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of every id."""
    z = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(27))


class Template:
    """Template tokens of texts under one vocabulary."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.common: set[int] = set()  # ids of words that items have in lower case
        self.memo: dict[str, int] = {}
        self.open = True

    def close(self) -> None:
        """No more words are learned: those of other texts have id 0."""
        self.open = False
        self.memo.clear()
        self.is_common = np.zeros(len(self.ids) + _FIRST, dtype=bool)
        self.is_common[list(self.common)] = True

    def _code(self, token: str) -> int:
        """id << 4 | flags of one token; -1 if nothing but punctuation."""
        word = token.strip(_EDGE)
        if not word:
            return -1
        end = _END if token[-1] in ".!?:" or token[-2:-1] in (".", "!", "?") else 0
        low = word.lower()
        if self.open:
            i = self.ids.setdefault(low, len(self.ids) + _FIRST)
            if word == low:
                self.common.add(i)
        else:
            i = self.ids.get(low, 0)
        if _NUMBER.fullmatch(word):
            return i << 4 | _NUM | end
        flags = end | (_CAP if word[0].isupper() and not word.isupper() else 0) | (_UNIT if low in UNITS else 0)
        return i << 4 | flags

    def read(self, text: str) -> tuple[np.ndarray, list[str]]:
        """Codes and surface forms of the tokens of a text."""
        tokens = text.split()
        memo, code = self.memo, self._code
        if len(memo) > MEMO:
            memo.clear()
        out = np.empty(len(tokens), dtype=np.int64)
        for i, t in enumerate(tokens):
            c = memo.get(t)
            if c is None:
                c = memo[t] = code(t)
            out[i] = c
        return out, tokens

    def templates(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, token positions) of the readings with all as it stands, with names as words, and with names as slots."""
        at = np.flatnonzero(codes >= 0)
        c = codes[at]
        ids, flags = c >> 4, c & 15
        number = (flags & _NUM) > 0
        after_number = np.zeros(len(c), dtype=bool)
        after_number[1:] = number[:-1]
        plain = np.where(((flags & _UNIT) > 0) & after_number, UNIT, np.where(number, NUM, ids))
        name = ((flags & _CAP) > 0) & (plain != UNIT)
        if name.any():
            inner = np.zeros(len(c), dtype=bool)
            inner[1:] = (flags[:-1] & _END) == 0
            at_start = np.flatnonzero(name & ~inner)
            name[at_start] = ~self.is_common[ids[at_start]]
        if not name.any():
            return [(ids, at), (plain, at)]
        first = name.copy()
        first[1:] &= ~name[:-1]
        keep = ~name | first
        return [(ids, at), (plain, at), (np.where(name, NAME, plain)[keep], at[keep])]


class LeakIndex:
    """Template windows of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, min_share: float = MIN_SHARE, min_tokens: int = MIN_TOKENS, min_item: int = MIN_ITEM):
        self.window, self.min_share, self.min_tokens = window, min_share, min_tokens
        self.template = Template()
        self.items: list[tuple[int, np.ndarray, list[str]]] = []
        self.of: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        self.heavy: set[int] = set()  # sizes of the windows matched by surface, and of the others
        self.plain: set[int] = set()
        read = []
        for item_id, text in items:
            read.append((item_id, *self.template.read(text)))
        self.template.close()
        for item_id, codes, tokens in read:
            readings = self.template.templates(codes)
            for r, (ids, at) in enumerate(readings):
                if len(ids) < min_item:
                    continue
                k = len(self.items)
                self.items.append((item_id, ids, [tokens[i] for i in at]))
                size = min(window, len(ids))
                # as it stands: only where the template of the same tokens has too few words
                for p in self._heavy(ids, readings[1][0], size) if r == 0 else self._fit(ids, size):
                    (self.heavy if r == 0 else self.plain).add(size)
                    self.of[size][int(self._hash(ids[p : p + size], size)[0])].append((k, int(p)))
        self.of = {size: dict(d) for size, d in self.of.items()}
        self.keys = {size: np.array(sorted(d), dtype=np.uint64) for size, d in self.of.items()}

    @staticmethod
    def _hash(ids: np.ndarray, size: int) -> np.ndarray:
        n = len(ids) - size + 1
        mixed, out = _mix(ids), np.zeros(max(n, 0), dtype=np.uint64)
        for k in range(size):
            out = out * np.uint64(0x100000001B3) + mixed[k : k + n]
        return out

    @staticmethod
    def _fit(ids: np.ndarray, size: int) -> np.ndarray:
        """Starts of windows whose tokens all are known, at least half of them words."""
        if len(ids) < size:
            return np.zeros(0, dtype=np.int64)
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        words = np.concatenate(([0], np.cumsum(ids >= _FIRST)))
        return np.flatnonzero((known[size:] - known[:-size] == size) & (2 * (words[size:] - words[:-size]) >= size))

    @staticmethod
    def _heavy(ids: np.ndarray, plain: np.ndarray, size: int) -> np.ndarray:
        """Starts of windows whose tokens all are known as they stand, less than half of them words."""
        if len(ids) < size:
            return np.zeros(0, dtype=np.int64)
        words = np.concatenate(([0], np.cumsum(plain >= _FIRST)))
        starts = np.flatnonzero(2 * (words[size:] - words[:-size]) < size)
        return starts[[bool((ids[s : s + size] > 0).all()) for s in starts]] if len(starts) else starts

    def search(self, text: str | None) -> list[tuple[int, str, int, float]]:
        """(item_id, kind, tokens covered, share covered) of every item that the text holds."""
        if not text or not self.items:
            return []
        codes, tokens = self.template.read(text)
        best: dict[int, tuple[bool, int, float]] = {}
        readings = self.template.templates(codes)
        for r, (ids, at) in enumerate(readings):
            diagonals: dict[tuple[int, int], set[int]] = defaultdict(set)
            for size in self.heavy if r == 0 else self.plain:
                keys = self.keys[size]
                starts = self._heavy(ids, readings[1][0], size) if r == 0 else self._fit(ids, size)
                if not len(starts):
                    continue
                mixed = _mix(ids)
                h = np.zeros(len(starts), dtype=np.uint64)
                for k in range(size):
                    h = h * np.uint64(0x100000001B3) + mixed[starts + k]
                near = np.searchsorted(keys, h)
                near[near == len(keys)] = 0
                for i in np.flatnonzero(keys[near] == h):
                    s = int(starts[i])
                    for k, p in self.of[size][int(h[i])]:
                        if np.array_equal(ids[s : s + size], self.items[k][1][p : p + size]):
                            diagonals[k, s - p].update(range(p, p + size))
            for k, covered in self._laid(diagonals):
                item_id, own, surface = self.items[k]
                share = len(covered) / len(own)
                if share < self.min_share and len(covered) < self.min_tokens:
                    continue
                slots = [(surface[p].strip(_EDGE).lower(), tokens[at[p + covered[p]]].strip(_EDGE).lower()) for p in sorted(covered) if own[p] < _FIRST]
                there, back = {}, {}
                if all(there.setdefault(a, b) == b and back.setdefault(b, a) == a for a, b in slots):
                    found = (all(a == b for a, b in slots), len(covered), share)
                    best[item_id] = max(best.get(item_id, found), found)
        return [(i, "exact" if same else "reparameterised", n, share) for i, (same, n, share) in sorted(best.items())]


    @staticmethod
    def _laid(diagonals: dict[tuple[int, int], set[int]]) -> Iterator[tuple[int, dict[int, int]]]:
        """(item, covered position -> shift) of every diagonal, and of each run of neighbouring ones together."""
        run: dict[int, int] = {}
        before, members = None, 0
        for (k, shift), covered in sorted(diagonals.items()):
            yield k, dict.fromkeys(covered, shift)
            if before is None or before[0] != k or shift - before[1] > DRIFT:
                if members > 1:
                    yield before[0], run
                run, members = {}, 0
            for p in covered:
                run.setdefault(p, shift)
            before, members = (k, shift), members + 1
        if members > 1:
            yield before[0], run


def _indexes(benchmark: DataFrame, block_chars: int, **options) -> Iterator[tuple[bool, LeakIndex]]:
    """Whether it is the last, and an index, of each block of the benchmark; an empty benchmark has none."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()  # about block_chars characters
        yield k == n - 1, LeakIndex(sorted((r[0], r[1]) for r in rows), **options)


LEAKS = "doc_id bigint, item_ids array<bigint>, kinds array<string>, covered array<bigint>, share double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS, **options) -> DataFrame:
    """One row per contaminated document: its items, the kind and extent of each match."""
    spark, out = docs.sparkSession, []
    # a row is known by this key where the results of several blocks have to be laid together
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    names = ["row", "doc_id", "item_ids", "kinds", "covered", "share"]
    for last, index in _indexes(benchmark, block_chars, **options):
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                rows = [(r, d, own.search(t)) for r, d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                rows = [(r, d, *map(list, list(zip(*m, strict=True))[:3]), max(x[3] for x in m)) for r, d, m in rows if m]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        found = rows.mapInArrow(search, f"row bigint, {LEAKS}")
        if last and not out:
            return found.drop("row")
        # one block's index at a time is in memory
        out.append(stored(found, "leaks"))
        shared.unpersist()
    if not out:
        return spark.createDataFrame([], LEAKS)
    # rows with a hit in some block; equal rows have equal hits, which are laid together once
    whole = reduce(DataFrame.unionByName, (part.dropDuplicates(["row"]) for part in out))
    hit = F.array_sort(F.collect_list(F.struct("item_ids", "kinds", "covered", "share")))  # one for each block
    whole = whole.groupBy("row").agg(hit.alias("hit"))
    flat = [F.flatten(F.col(f"hit.{c}")).alias(c) for c in ("item_ids", "kinds", "covered")]
    return rows.select("row", "doc_id").join(whole, "row").select("doc_id", *flat, F.array_max("hit.share").alias("share"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, with the same columns."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    for _, index in _indexes(benchmark, block_chars, **options):
        shared = spark.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                yield batch.filter(pa.array([not own.search(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(keep, T.StructType(docs.schema.fields))
    return docs


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_ids", "kinds", F.size("item_ids").cast("long").alias("n_items"))
