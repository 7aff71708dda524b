"""Token counts without token ids.

1. A text is cut at white space into chunks, which no piece of these vocabularies
   crosses, and each chunk into the vocabulary's pre-tokens.
2. Each worker counts the pre-tokens of its texts; the sums over the corpus give
   one row for each distinct pre-token, whose pieces are counted once, there.
3. Per document, pre-tokens and their frequencies are joined to the pieces of a
   pre-token, and frequency times pieces is summed.  Pre-tokens with at least
   ``SHARE`` of all occurrences, so 1 / ``SHARE`` of them at most, are broadcast and
   joined in the worker that cut the text; all others are joined by a shuffle.

The key of a pre-token is its bytes, or, beyond 15 of them, a digest of 16 bytes.
The workers remember how chunks are cut, ``MEMO`` of them at most, and then start
anew, so memory does not grow with the corpus and no result changes.

Special strings inside a text are found as the library's default has it; they
contain no white space, so each lies within one chunk, and a chunk that holds
one stands as a whole where pre-tokens do and is given to the library as it is.

Defined results: a null text counts as empty, with no bytes and no tokens;
repeated rows, and rows with null or repeated ids, are each counted; a text of
any length is counted whole; an empty table gives an empty result; other columns
are not read; a vocabulary whose pieces cross white space is refused.
"""

from __future__ import annotations

import json
import re
import struct
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import stored, table

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
MEMO = 300_000
FLUSH = 300_000  # distinct chunks or rows that a worker gathers before it hands them on
SHARE = 1 / 500_000
TOGETHER = 5000  # chunks that are cut in one call
TEXTS = 2_000_000  # bytes of text, and one text more, that are cut at once
WHOLE = "\n"  # begins what is given to the library as a whole; no pre-token holds a line break

#: ``str.split`` also splits at these four, which are not white space to the library.
SEPARATORS = re.compile("[\x1c-\x1f]")
BLANK = re.compile("[\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


PROBE = "a b  c\nd\te"

#: Visible ASCII and the letters of Latin-1: composed and in lower case alike to all versions of Unicode.
LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that ByteLevel leaves as they are
_LEVEL = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_SEEN)))}


def latin_rule(tokenizer) -> re.Pattern | None:
    """The pattern that cuts chunks of visible ASCII and Latin-1 letters, in lower case, as the library does; None for vocabularies of other rules."""
    rules = json.loads(tokenizer.to_str())
    split, *rest = (rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    kind = {k: split.get(k) for k in ("type", "behavior", "invert")}
    if (rules["normalizer"] or {}).get("normalizers") != NORMAL or rest != [BYTES] or kind != {"type": "Split", "behavior": "Removed", "invert": True}:
        return None
    pattern = split["pattern"].get("Regex", r"\p").replace(r"\p{L}", LATIN).replace(r"\p{N}", "0-9")
    return None if r"\p" in pattern else re.compile(pattern)


def chunks(text: str) -> list[str]:
    """The runs of a text without white space, as the library sees white space."""
    if SEPARATORS.search(text):
        return [c for c in BLANK.split(text) if c]
    return text.split()


def key(unit: str) -> bytes:
    """The join key of a pre-token."""
    raw = unit.encode("utf-8", "surrogatepass")
    return raw if len(raw) < 16 else xxhash.xxh3_128_digest(raw)


class PieceCounter:
    """Pre-tokens and their numbers of pieces by the library ``tokenizers``, from a vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if any(BLANK.search(PROBE[a:b]) for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(PROBE)):
            raise ValueError(f"pieces of {path} cross white space, so texts cannot be cut there")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.rule = latin_rule(self.tokenizer)
        self.latin = re.compile(rf"[!-~{LATIN}]+").fullmatch

    def units(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk, or the marked chunk if it holds a special string."""
        if self.special and self.special.search(chunk):
            return [WHOLE + chunk]
        return [pre for pre, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.normal(chunk))]

    def normal(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text

    def cut(self, chunks: list[str]) -> Iterator[list[str]]:
        """``units`` of every chunk; thousands are cut in one call, with blanks between them.

        Chunks of visible ASCII and Latin-1 letters are cut by the vocabulary's own
        pattern here, which takes a tenth of the library's time.
        """
        for at in range(0, len(chunks), TOGETHER):
            some = chunks[at : at + TOGETHER]
            if self.special and self.special.search(" ".join(some)):
                yield from map(self.units, some)
            elif self.rule is None:
                yield from self.cut_together(some)
            else:
                found, latin = self.rule.findall, self.latin
                near = [c.isascii() and c.isprintable() or latin(c) is not None for c in some]
                others = self.cut_together([c for c, own in zip(some, near, strict=True) if not own])
                for chunk, own in zip(some, near, strict=True):
                    if not own:
                        yield next(others)
                    elif chunk.isascii():
                        yield [chunk.lower()] if chunk.isalpha() else found(chunk.lower())
                    else:
                        yield [u.encode().decode("latin-1").translate(_LEVEL) for u in found(chunk.lower())]

    def cut_together(self, some: list[str]) -> Iterator[list[str]]:
        """``units`` of chunks without special strings, by the library."""
        if not some:
            return
        normal = self.normal(" ".join(some))
        if normal.count(" ") != len(some) - 1:
            yield from map(self.units, some)
            return
        own, end = [], normal.find(" ")
        for pre, (start, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
            while 0 <= end < start:
                yield own
                own, end = [], normal.find(" ", end + 1)
            own.append(pre)
        while end >= 0:  # chunks without pre-tokens at the end
            yield own
            own, end = [], normal.find(" ", end + 1)
        yield own

    def pieces(self, unit: str) -> int:
        """The number of pieces of what ``units`` gives."""
        if unit.startswith(WHOLE):
            return len(self.tokenizer.encode(unit[len(WHOLE) :], add_special_tokens=False).ids)
        return len(self.tokenizer.model.tokenize(unit))


_counters: dict[str, PieceCounter] = {}


def counter(path: str | None) -> PieceCounter:
    """One counter for each worker process and vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    path = str(path)
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def pre_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(unit, c): every distinct pre-token of the texts and how often it occurs in them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = counter(path), Counter()

        def flush() -> pa.RecordBatch:
            found: dict[str, int] = {}
            for units, k in zip(own.cut(list(seen)), seen.values(), strict=True):
                for unit in units:
                    found[unit] = found.get(unit, 0) + k
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["unit", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(chunks(text or ""))
                if len(seen) > FLUSH:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(count, "unit string, c bigint").groupBy("unit").agg(F.sum("c").alias("c"))


def piece_table(units: DataFrame, path: str | None = None) -> DataFrame:
    """(unit_key, c, pieces) of every row (unit, c): the pieces of each are counted once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            units = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(map(key, units), pa.binary()), batch.column(1), pa.array(map(own.pieces, units), pa.int64())], names=["unit_key", "c", "pieces"])

    return units.select("unit", "c").mapInArrow(count, "unit_key binary, c bigint, pieces bigint")


PARTS = "row bigint, doc_id bigint, n_bytes bigint, unit_key binary, n bigint"


def frequencies(docs: DataFrame, near: dict[bytes, int], path: str | None = None) -> DataFrame:
    """(row, doc_id, n_bytes, unit_key, n): per document its other pre-tokens with their frequencies.

    One row of each document, with ``n_bytes`` and a key that no pre-token has,
    holds the pieces of its pre-tokens in ``near``; ``docs`` has row, doc_id, n_bytes, text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(near)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, memo = counter(path), shared.value, {}
        cols: tuple[list, ...] = ([], [], [], [], [])  # whole columns, as rows of their own would cost more than what is in them
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())

        def flush() -> pa.RecordBatch:
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            for c in cols:
                c.clear()
            return pa.RecordBatch.from_arrays(made, names=["row", "doc_id", "n_bytes", "unit_key", "n"])

        def look_up(new: list[str]) -> None:
            for chunk, units in zip(new, own.cut(new), strict=True):
                pieces, others = 0, []
                for unit in units:
                    k = unit.encode("utf-8", "surrogatepass")
                    if len(k) >= 16:
                        k = key(unit)
                    near_by = known.get(k)
                    if near_by is None:
                        others.append(k)
                    else:
                        pieces += near_by
                memo[chunk] = pieces, tuple(others)

        def count(docs: list[tuple]) -> None:
            if len(memo) > MEMO:
                memo.clear()
            counts = [Counter(chunks(text or "")) for *_, text in docs]
            look_up([c for c in set().union(*counts) if c not in memo])
            for (row, doc_id, n_bytes, _), found in zip(docs, counts, strict=True):
                own_key = WHOLE.encode() + struct.pack(">q", row)
                total, far = 0, {own_key: 0}
                for chunk, k in found.items():
                    pieces, others = memo[chunk]
                    total += pieces * k
                    for other in others:
                        far[other] = far.get(other, 0) + k
                far[own_key] = total
                none = [None] * (len(far) - 1)
                for column, values in zip(cols, (repeat(row, len(far)), chain((doc_id,), none), chain((n_bytes,), none), far, far.values()), strict=True):
                    column.extend(values)

        for batch in batches:
            waiting, size = [], 0
            for doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting.append(doc)
                size += doc[2]
                if size > TEXTS:
                    count(waiting)
                    waiting, size = [], 0
                    if len(cols[0]) > FLUSH:
                        yield flush()
            count(waiting)
            yield flush()

    return docs.select("row", "doc_id", "n_bytes", "text").mapInArrow(cut, PARTS)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, share: float = SHARE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document.

    ``docs`` is a table that was read or stored: it is read twice, and its rows are
    known by their places.  ``share``: pre-tokens of so much of all occurrences are broadcast.
    ``path``: a vocabulary file of the library ``tokenizers`` that every
    executor can read; by default ``public_tokenizers.path(VOCABULARY)`` there.
    """
    table_ = stored(piece_table(pre_tokens(docs, path), path), "pieces")
    total = table_.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    least = max(1.0, total * share)
    near = table_.filter(F.col("c") >= least).select("unit_key", "pieces").toArrow()  # 1 / SHARE rows at most
    near = dict(zip(*(near[c].to_pylist() for c in ("unit_key", "pieces")), strict=True))
    # the same for a task that runs again, as the parts of a scan are
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    parts = frequencies(rows, near, path)
    rest = table_.filter(F.col("c") < least).select("unit_key", "pieces")
    met = parts.join(rest, "unit_key", "left")
    counted = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).cast("long").alias("n_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
