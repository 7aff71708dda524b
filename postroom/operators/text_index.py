"""A stored positional index of texts, and full-text search that reads only the query's stems.

Postings are one row for each stem and text: positions of its words, their offsets and
lengths in characters, as differences to the one before.  They lie in buckets by hash of the stem, so
a query reads the buckets of its stems, and of these the row groups whose stems can match.  The
dictionary has the number of texts and of words of each stem and batch.  All are tables of a
``Store``: an extension is one version, texts that are there already stay as they
are, and a batch that comes twice changes nothing.

Answers are those of ``search.full_text`` over the same texts.  Null texts are indexed as
empty; texts of any length are indexed whole; null keys are not indexed.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.operators import search
from postroom.operators.store import BUCKET, Store, Table

POSTINGS, DICTIONARY, DOCUMENTS = "postings", "dictionary", "documents"
STEMS = 200_000  # that a worker remembers
HELD = 50_000  # words whose postings a worker holds before it gives them away, beyond those of one text
_WORD = re.compile(r"\w+")


def _words(stemmed: bool, stops: frozenset[str]):
    """Task: the postings of each text, in batches of about ``HELD`` words, however many rows the batches read have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            at, stems, out, held = [], [], {"pos": [], "start": [], "len": []}, 0

            def made() -> pa.RecordBatch:
                arrays = [_differences(out["pos"]), _differences(out["start"]), _lists(out["len"])]
                return pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int32())), pa.array(stems, pa.string()), *arrays], ["key", "stem", "pos", "start", "len"])  # noqa: B023

            for row, text in enumerate(batch.column("text")):
                own: dict[str, tuple[array, array, array]] = {}
                n = 0
                for n, m in enumerate(_WORD.finditer(text.as_py()), 1):
                    word = m.group().lower()
                    if word in stops:
                        continue
                    stem = word
                    if stemmed and (stem := known.get(word)) is None:
                        if len(known) >= STEMS:
                            known.clear()
                        stem = known[word] = search.stem(word)
                    if (found := own.get(stem)) is None:
                        found = own[stem] = (array("i"), array("i"), array("i"))
                    found[0].append(n)
                    found[1].append(m.start())
                    found[2].append(m.end() - m.start())
                at += [row] * len(own)
                stems += own
                for name, k in (("pos", 0), ("start", 1), ("len", 2)):
                    out[name] += [x[k] for x in own.values()]
                held += n
                if held >= HELD:
                    yield made()
                    at, stems, out, held = [], [], {"pos": [], "start": [], "len": []}, 0
            yield made()

    return run


def _lists(rows: list[array], differences: bool = False) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.fromiter((x for r in rows for x in r), np.int32, int(ends[-1]))
    if differences and len(flat):
        first = flat[ends[:-1]]
        flat = np.diff(flat, prepend=0)
        flat[ends[:-1]] = first
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32, copy=False)))


def _differences(rows: list[array]) -> pa.ListArray:
    return _lists(rows, differences=True)


def summed(column: str) -> Column:
    """Positions from their differences; the vectors of a batch at a time."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(np.cumsum)

    return F.pandas_udf(run, "array<int>")(column)


def extend(store: Store, df: DataFrame, key: str, text: Column, source: str | None = None, batch: int | None = None, stemmed: bool = True, stops: list[str] | None = None) -> bool:
    """Index the texts of ``df`` whose keys are not indexed yet; False if the batch is in it already.

    Texts are read and cut into words once, in Arrow batches; postings are then grouped by
    bucket.  An index is stemmed or not from its first batch on, and so it is with the
    words that it leaves out (``stops``; English ones if none are given).
    """
    if source is not None and store.stamps.get(source, -1) >= batch:
        return False
    kind = dict(df.select(F.col(key).alias("key")).dtypes)["key"]
    keys = df.select(F.col(key).alias("key"), F.lit(1).alias("n")).filter("key is not null").dropDuplicates(["key"])
    place = f"{store.path}/data/batch-{uuid.uuid4().hex}"

    def written(name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{place}/{name}")
        return store.spark.read.schema(rows.schema).parquet(f"{place}/{name}")

    documents, created = store.merged(DOCUMENTS, written(DOCUMENTS, keys), ["key"])
    texts = df.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")).filter("key is not null")
    if DOCUMENTS in store.tables:
        texts = texts.join(created.select("key"), "key", "left_semi")
    words = texts.mapInArrow(_words(stemmed, frozenset(search.stop_words(df) if stops is None else stops)), f"key {kind}, stem string, pos array<int>, start array<int>, len array<int>")
    changed = {DOCUMENTS: documents}
    old = store.tables.get(POSTINGS)
    folders = {b: list(f) for b, f in old.folders.items()} if old else {}
    dealt = words.withColumn(BUCKET, store.bucket(["stem"])).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, "stem")
    for b, more in store.stage(POSTINGS, dealt.drop(BUCKET), ["stem"], deal=False).items():
        folders[b] = folders.get(b, []) + more
    changed[POSTINGS] = Table(words.schema.json(), ["stem"], folders)
    counts = store.spark.read.schema(words.schema).parquet(*(f"{store.path}/{f[-1]}" for b, f in folders.items() if not old or f != old.folders.get(b, []))) if folders else words
    counts = counts.groupBy("stem").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.size("pos")).alias("words"))
    old = store.tables.get(DICTIONARY)
    folders = {b: list(f) for b, f in old.folders.items()} if old else {}
    for b, more in store.stage(DICTIONARY, counts, ["stem"]).items():
        folders[b] = folders.get(b, []) + more
    changed[DICTIONARY] = Table(counts.schema.json(), ["stem"], folders)
    store.publish(changed, {} if source is None else {source: batch})
    return True


def dictionary(store: Store) -> DataFrame:
    """(stem, texts, words) over all batches."""
    return store.read(DICTIONARY).groupBy("stem").agg(F.sum("texts").alias("texts"), F.sum("words").alias("words"))


def postings(store: Store, stems: list[str]) -> DataFrame:
    """Rows (key, stem, pos, start, len) of these stems: their buckets alone are read, filtered by stem in the scan."""
    if not stems:
        return store.read(POSTINGS, [])
    of = store.spark.createDataFrame([(s,) for s in stems], "stem string").select(store.bucket(["stem"]).alias("b")).distinct().collect()  # a query's stems
    return store.read(POSTINGS, [r.b for r in of]).filter(F.col("stem").isin(stems))


def full_text(store: Store, query: str, stemmed: bool = True, match: str = "boolean") -> DataFrame:
    """(key, rank) of the texts that match, as ``search.full_text`` finds them."""
    parsed = search.parse_query(query, search.stop_words(store.spark.range(0)), stemmed)
    documents = store.read(DOCUMENTS).select("key")
    if not parsed.alternatives:
        return documents.select("key", F.lit(0.0).alias("rank")).limit(0)
    at = {s: f"p{i}" for i, s in enumerate(parsed.stems)}
    found = postings(store, list(at)).select("key", "stem", summed("pos").alias("pos"))
    # one row for each stem and text, so the greatest is the only one
    own = found.groupBy("key").agg(*(F.max(F.when(F.col("stem") == s, F.col("pos"))).alias(p) for s, p in at.items()))
    if match == "any" or any(all(negated for negated, _ in a) for a in parsed.alternatives):
        own = documents.join(own, "key", "left")
    empty = F.array().cast("array<int>")
    return search.matches(own.withColumns({p: F.coalesce(F.col(p), empty) for p in at.values()}), "key", parsed, at, match)


def marked(store: Store, df: DataFrame, key: str, text: Column, query: str, name: str = "headline", start: str = search.START, stop: str = search.STOP) -> DataFrame:
    """``df`` with its texts, every word of the query's stems marked where the index has it; null where none is.

    For a page of results: texts are cut at the stored offsets and not read for words.
    """
    stems = search.parse_query(query, search.stop_words(df)).stems
    hits = postings(store, stems).select("key", F.explode(F.arrays_zip(summed("start").alias("start"), F.col("len").alias("len"))).alias("h"))
    hits = hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("h.start", "h.len"))).alias("_hits")).withColumnRenamed("key", "_key")
    end = lambda h: h["start"] + h["len"]
    before = lambda i: F.when(i > 0, end(F.get("_hits", i - 1))).otherwise(0)
    cut = lambda a, n: F.substring(text, a + 1, n)
    pieces = F.transform("_hits", lambda h, i: F.concat(cut(before(i), h["start"] - before(i)), F.lit(start), cut(h["start"], h["len"]), F.lit(stop)))
    last = F.element_at("_hits", -1)
    out = F.concat(F.array_join(pieces, ""), cut(end(last), F.length(text)))
    return df.join(hits, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn(name, out).drop("_key", "_hits")


def lookup(store: Store, terms: list[str]) -> list[tuple[str, int]]:
    """Of each term's stem the number of texts, rarest first."""
    stems = [search.stem(t) for t in terms]
    found = dictionary(store).filter(reduce(lambda a, b: a | b, (F.col("stem") == s for s in stems), F.lit(False))).collect()
    return sorted(((r.stem, r.texts) for r in found), key=lambda x: (x[1], x[0]))
