"""Signatures at the end of bodies.

Only the last ``TAIL`` lines are looked at.  A separator line opens the
signature, else a disclaimer does, else the best-scoring run of last lines.

Closings of several words are known without their blanks (``bestregards,``), for
equal results; ``closing=SPACED_CLOSING`` knows them as people write them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postroom.functions.text import blank_to_null, let, normalize_body, strip

TAIL = 12
# What lines of signatures look like, and their scores.
SEPARATOR = r"^\s*(--\s*$|__+\s*$|-{3,}\s*$|\*{3,}\s*$)"
CLOSING = r"(?i)^\s*(thanks|thankyou|regards|best|bestregards|sincerely|cheers|cordially|manythanks),?\s*$|(?i)^\s*(cordialement|biencordialement)\s*$"
SPACED_CLOSING = r"(?i)^\s*(thanks|thank you|regards|best|best regards|sincerely|cheers|cordially|many thanks),?\s*$|(?i)^\s*(cordialement|bien cordialement)\s*$"
DISCLAIMER = r"(?i)^\s*(this\s+e-?mail|this\s+message|the\s+information\s+contained\s+in\s+this|this\s+communication|confidential(ity)?|privileged\s+and\s+confidential)"
HINT = r"(?i)\b(tel|telephone|phone|office|cell|mobile|mob|fax|pager)\b|\b[e-]?mail\b|@|\bwww\.|\bhttps?://|\b(assistant|manager|director|president|vicepresident|vp|analyst|specialist|chairman|trader)\b"
SEPARATOR_SCORE, CLOSING_SCORE, DISCLAIMER_SCORE, HINT_SCORE, SHORT_SCORE = 4, 4, 4, 2, 1
OPENING_BONUS, SENTENCE_COST, LEAST = 3, 2, 4


def _line_score(line: Column, hint: str, closing: str) -> Column:
    words = F.size(F.split(line, r"(?U)\s+"))
    short = (F.length(line) <= 40) & ~line.rlike(r"[.!?:]$") & (words <= 6)
    sentence = (F.length(line) > 60) & line.rlike("[.!?]$")
    score = lambda test, n: F.when(test, n).otherwise(0)
    total = score(line.rlike(SEPARATOR), SEPARATOR_SCORE) + score(line.rlike(closing), CLOSING_SCORE) + score(line.rlike(DISCLAIMER), DISCLAIMER_SCORE) + score(line.rlike(hint), HINT_SCORE) + score(short, SHORT_SCORE)
    return F.when(line == "", 0).otherwise(total - score(sentence, SENTENCE_COST))


def is_signature_line(line: Column, hint: str = HINT, closing: str = CLOSING) -> Column:
    line = strip(line)
    short = (F.length(line) <= 40) & ~line.rlike(r"[.!?:]$") & (F.size(F.split(line, r"(?U)\s+")) <= 6)
    return (line != "") & (line.rlike(SEPARATOR) | line.rlike(closing) | line.rlike(DISCLAIMER) | line.rlike(hint) | short)


def extract_signature(body: Column, organisation: str | None = None, closing: str = CLOSING) -> Column:
    """The signature of a body, or null.

    ``organisation``: a name (as a pattern) that hints at a signature as well.
    """
    return _signature_of(normalize_body(body), organisation, closing)


def _signature_of(text: Column, organisation: str | None, closing: str) -> Column:
    """The signature of a normalised body, of which only the last lines are cut."""
    hint = HINT + (rf"|\b{organisation}\b" if organisation else "")
    tail = let(F.split(F.substring_index(text, "\n", -TAIL), "\n"), lambda e: F.when(F.size(e) >= 2, e))
    return let(tail, lambda t: blank_to_null(strip(F.array_join(F.slice(t, F.nullif(_opening(t, hint, closing), F.lit(0)), F.lit(TAIL)), "\n"))))


def _opening(tail: Column, hint: str, closing: str) -> Column:
    """Place of the signature's first line among the last lines, from 1; 0 if there is none."""
    bare = F.transform(tail, strip)
    first = lambda pattern: F.nullif(F.array_position(F.transform(bare, lambda x: x.rlike(pattern)), True).cast("int"), F.lit(0))
    # scores from each start to the end, in one pass from the last line
    scored = F.transform(bare, lambda x: F.struct(_line_score(x, hint, closing).alias("s"), (x != "").alias("full"), x.rlike(closing).alias("closing")))
    start = F.struct(F.lit(0).alias("total"), F.lit(False).alias("opens"), F.size(tail).alias("at"), F.lit(LEAST - 1).alias("most"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["total"] + x["s"]
        opens = F.when(x["full"], x["closing"]).otherwise(acc["opens"])
        mine = total + F.when(opens, OPENING_BONUS).otherwise(0)
        wins = (mine >= LEAST) & (mine >= acc["most"])  # going backwards, of equal runs the earliest start wins
        return F.struct(total.alias("total"), opens.alias("opens"), (acc["at"] - 1).alias("at"), F.when(wins, mine).otherwise(acc["most"]).alias("most"), F.when(wins, acc["at"]).otherwise(acc["best"]).alias("best"))

    best = F.aggregate(F.reverse(scored), start, step, lambda acc: acc["best"])
    return F.coalesce(first(SEPARATOR), first(DISCLAIMER), best)


def split_signature(body: Column, organisation: str | None = None, closing: str = CLOSING) -> Column:
    """struct(body, signature): the body without its signature, and that."""

    def split(text: Column, signature: Column) -> Column:
        rest = F.regexp_replace(F.left(text, F.length(text) - F.length(signature)), r"(?U)(?<!\s)\s++$", "")
        return F.struct(F.when(signature.isNull(), text).otherwise(blank_to_null(rest)).alias("body"), signature.alias("signature"))

    return let(normalize_body(body), lambda text: let(_signature_of(text, organisation, closing), lambda s: split(text, s)))
