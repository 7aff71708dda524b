"""Plain text: trimming, line ends, quotes, snippets, keywords."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The common words that keywords leave out, and the lengths of results.
KEYWORD_STOP_WORDS = ("this", "that", "with", "have", "from", "your", "will", "would", "there", "their", "about", "please", "thanks", "thank", "subject", "message", "forward", "regards")
SNIPPET_LENGTH = 240
KEYWORD_LIMIT = 10

BLANK = r"[\s\x1C-\x1F]"
# the same characters, for trimming, which looks at a text's ends alone
_INNER = "\t\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, and the plan as small as it looks.

    A Column that is used n times is n copies of its expression; nested, such
    copies multiply.  A lambda variable is one.
    """
    return F.get(F.transform(F.array(value), body), 0)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit("\n" + _INNER))


def normalize_text(c: Column) -> Column:
    """Trimmed, runs of white space as one space, null if nothing is left."""
    return blank_to_null(F.regexp_replace(strip(c), rf"(?U){BLANK}+", " "))


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def normalize_body(c: Column) -> Column:
    """Unix line ends, no white space at the ends of lines, trimmed, null if empty."""
    ends = F.transform(F.split(unix_lines(c), "\n"), lambda line: F.rtrim(line, F.lit(_INNER)))
    return blank_to_null(strip(F.array_join(ends, "\n")))


def clean_body(c: Column) -> Column:
    """As ``normalize_body``, and of neighbouring blank lines only the first."""
    return F.regexp_replace(normalize_body(c), r"\n{3,}", "\n\n")


def lines(c: Column) -> Column:
    """The lines of a text, by all line breaks of Unicode."""
    return F.split(c, LINE_BREAK)


def quoted_lines(c: Column) -> Column:
    """Number of lines that start with '>' after white space."""
    found = F.filter(lines(normalize_body(c)), lambda x: x.rlike(rf"(?U)^{BLANK}*>"))
    return F.size(F.coalesce(found, F.array().cast("array<string>")))


def quoted_text(c: Column) -> Column:
    """The quoted lines themselves, and the lines that announce a quote."""
    found = F.filter(lines(normalize_body(c)), lambda x: x.rlike(rf"(?U)^{BLANK}*>") | x.rlike(r"(?i)^\s*on .+ wrote:\s*$"))
    return blank_to_null(F.array_join(found, "\n"))


def snippet(c: Column, length: int = SNIPPET_LENGTH) -> Column:
    return blank_to_null(strip(F.left(normalize_text(c), F.lit(length))))


def words(c: Column) -> Column:
    """Lower-case ASCII words of four letters or more between word boundaries."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b([a-z]{4,})\b"), F.lit(1))


def keywords(df: DataFrame, key: str, text: str, limit: int = KEYWORD_LIMIT, stop_words: tuple[str, ...] = KEYWORD_STOP_WORDS) -> DataFrame:
    """(key, rank, word, n): the most frequent words of every text, ties by word.

    Add the name of the organisation whose mail it is to ``stop_words``.
    """
    counted = df.select(key, F.explode(words(F.col(text))).alias("word")).filter(~F.col("word").isin(*stop_words)).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "word")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(key, F.col("rank").cast("long").alias("rank"), "word", "n")


def capitalized(c: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 1 << 30)))


def title(c: Column) -> Column:
    """Every run of letters capitalised: also after hyphens and apostrophes."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, capitalized), "")
