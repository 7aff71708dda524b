"""Mixing sources to target weights by systematic sampling.

Every source gets a target, in words.  A document's expected copies are
target / size of its source.  Within a source the expected copies are summed in
a fixed order, one random offset is added, and the document is emitted once for
every whole number that its part of the sum crosses.  The order runs by size, so
that the words taken come close to the target and not just in expectation.

Column expressions only.  The prefix sum needs no task that holds a source: each
source is cut into size classes (bit length of the size) and these, by hash of
the id, into cells of about ``CELL`` documents; cell totals are prefix-summed
over the small table of cells, ranks within a cell by a window over that cell.

The random offset comes from an MD5 of seed and source, so reruns agree.

Defined results: null or empty texts have size 0, are never short of their
copies' zero words, and sources of size 0 have target 0 and take nothing; the
null source is a source of its own, last in the order; null and repeated ids,
and repeated rows, are separate documents; ties of size are settled by id, then
by a hash of the row, and equal rows are interchangeable; a text of any length is
counted whole; an empty table gives an empty result; columns with the names of
inner ones are kept (the number of a copy is then ``copy_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postroom.llm.common import WORD, free_name, if_few, stored, table

CELL = 2_000
MOST = 3  # times its size that a source or document may take
SEED = "mix"
_MOST_CELLS = 1 << 20  # of a class


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from rows of (source, source_size).

    Weights 1, 2, 3, repeating, by code point of the source, null last.  A
    target stops at ``MOST`` times the size; the excess goes to the others by
    weight until none is above.  That fixed point is found directly: with the
    sources in the order of most / weight, the first k are capped and the others
    share what is left, for the smallest k at which no other is above.
    One row per source: this table is the mixture's recipe, not the corpus.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("w", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("most", F.col("source_size") * MOST)
    everything = Window.partitionBy(F.lit(0))
    by_ratio = everything.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    w = (
        w.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("free", F.col("left") * F.col("w") <= F.col("most") * F.col("w_left"))
        .withColumn("k", F.row_number().over(by_ratio))
    )
    first = F.min(F.when(F.col("free"), F.col("k"))).over(everything)
    at = F.when(F.col("k") == F.col("first"), F.struct("left", "w_left"))
    w = w.withColumn("first", first).withColumn("at", F.max(at).over(everything))
    share = F.col("at.left") * F.col("w") / F.col("at.w_left")
    target = F.when(F.col("first").isNull() | (F.col("k") < F.col("first")), F.col("most").cast("double")).otherwise(share)
    return w.select("source", "source_size", target.cast("double").alias("target"))


def offset(source: Column) -> Column:
    """The random offset of a source, in [0, 1), the same in every run."""
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(source, F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def copies(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with columns source and size, and: source_size, target, n_copies.

    ``by``: the columns that settle ties of size; equal rows are interchangeable.
    """
    # as many fine cells as the largest class can need: a power of two
    most = min(_MOST_CELLS, 1 << max(0, (rows.count() - 1) // CELL).bit_length())
    fine = F.pmod(F.xxhash64(*by), F.lit(most)).cast("int")
    rows = rows.withColumn("_class", F.length(F.bin("size"))).withColumn("_fine", fine)
    cells = rows.groupBy("source", "_class", "_fine").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    per_class = Window.partitionBy("source", "_class")
    # as many cells as the class needs: 1, 2, 4 ..
    need = F.ceil(F.sum("n").over(per_class) / CELL)
    coarse = F.least(F.lit(most), F.pow(2, F.ceil(F.log2(need))).cast("int"))
    cells = cells.withColumn("_cell", F.floor(F.col("_fine") * coarse / most).cast("int"))
    # what comes before a cell: the running sum with the cell's own rows, less those
    upto = Window.partitionBy("source").orderBy("_class", "_cell").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy("source", "_class", "_cell")
    plan = cells.withColumn("_start", F.sum("n").over(upto) - F.sum("n").over(own)).drop("n", "words")
    sizes = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes).withColumnRenamed("source", "s2")
    plan = plan.join(targets, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    plan = plan.select(*(F.col(c).alias(f"p_{c}") for c in plan.columns))
    joined = rows.join(plan, rows["source"].eqNullSafe(F.col("p_source")) & (rows["_class"] == F.col("p__class")) & (rows["_fine"] == F.col("p__fine")), "left")
    within = Window.partitionBy("source", "p__class", "p__cell").orderBy("size", *by)
    i = F.col("p__start") + F.row_number().over(within)
    rate = F.when(F.col("p_source_size") > 0, F.col("p_target") / F.col("p_source_size")).otherwise(0.0)
    u = offset(F.col("source"))
    out = joined.withColumn("_i", i)
    n = F.floor(F.col("_i") * rate + u) - F.floor((F.col("_i") - 1) * rate + u)
    n = F.least(F.lit(MOST), n).cast("int")
    return out.select(*[c for c in rows.columns if not c.startswith("_")], F.col("p_source_size").alias("source_size"), F.col("p_target").alias("target"), n.alias("n_copies"))


def row_key() -> Column:
    """Stands for id, source and text of a row."""
    return F.xxhash64("doc_id", "source", "text")


def sizes(docs: DataFrame) -> DataFrame:
    return stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_key().alias("row")), "sizes")


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, n_copies, taken of every document."""
    out = copies(sizes(docs), ["doc_id", "row"]).drop("row")
    return out.withColumn("taken", F.col("size") * F.col("n_copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as it is taken, numbered by ``copy``.

    m rows equal in id, source and text share the copies that they take
    together: each is emitted the m-th part, rounded down, and one of them the rest.
    """
    row, total, m, number = (free_name(docs, c) for c in ("_row", "_total", "_m", "copy"))
    taken = copies(sizes(docs), ["doc_id", "row"]).groupBy("row").agg(F.sum("n_copies").cast("int").alias(total), F.count(F.lit(1)).cast("int").alias(m))
    taken = stored(taken.filter(F.col(total) > 0).withColumnRenamed("row", row), "taken")
    out = docs.withColumn(row, row_key()).join(if_few(taken), row)

    def emitted(rows: DataFrame, first: Column, last: Column) -> DataFrame:
        return rows.filter(first <= last).withColumn(number, F.explode(F.sequence(first, last))).select(*docs.columns, number)

    each = F.floor(F.col(total) / F.col(m)).cast("int")
    every = emitted(out, F.lit(1), each)
    if taken.filter(F.col(m) > 1).isEmpty():
        return every
    return every.unionByName(emitted(out.filter(F.col(m) > 1).dropDuplicates([row]), each + 1, each + F.col(total) % F.col(m)))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    out = mixture(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


#: For sources with at most ``CELL`` documents in a size class, where the order is plainly by size and id.
SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w, source_size * 3 AS most FROM s),
r AS (SELECT *, row_number() OVER o AS k,
        CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
        CAST(sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS w_rest
      FROM w WINDOW o AS (ORDER BY CAST(most AS DOUBLE) / w, source ASC NULLS LAST)),
f AS (SELECT *, min(CASE WHEN rest * w <= most * w_rest THEN k END) OVER () AS first FROM r),
t AS (SELECT a.source, a.source_size, CASE WHEN a.first IS NULL OR a.k < a.first THEN CAST(a.most AS DOUBLE) ELSE CAST(b.rest * a.w AS DOUBLE) / CAST(b.w_rest AS DOUBLE) END AS target
      FROM f a LEFT JOIN f b ON b.k = a.first),
n AS (SELECT d.*, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS i,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        CAST(CAST('0x' || substr(md5('mix:' || coalesce(d.source, 'null')), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * least(3, floor(i * rate + u) - floor((i - 1) * rate + u)) AS BIGINT) AS taken FROM n
"""
