"""Subjects, and what bodies tell about replies and forwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postroom.functions.text import blank_to_null, let, lines, normalize_body, normalize_text, quoted_lines

# Prefixes and lines that mark replies, forwards and quoted headers.
PREFIXES = r"(?i)^((re|fw|fwd)\s*:\s*)+"
ON_WROTE = r"(?dim)^\s*on .+ wrote:\s*$"
ORIGINAL = r"(?dim)^\s*-{2,}\s*original message\s*-{2,}\s*$"
FORWARDED = r"(?dim)^\s*(?:begin forwarded message|[- ]*forwarded by|[- ]*forwarded message)\b"
QUOTED_HEADER = r"(?i)^\s*(from|sent|to|cc|bcc|subject|date)\s*:\s+.+$"


def normalize_subject(c: Column) -> Column:
    """Without any number of Re:, Fw:, Fwd: before it, lower-case."""
    return blank_to_null(F.lower(F.trim(F.regexp_replace(normalize_text(c), PREFIXES, ""))))


def is_reply(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)^\s*re\s*:"), F.lit(False))


def is_forward(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)^\s*(fw|fwd)\s*:"), F.lit(False))


def header_lines(body: Column) -> Column:
    """Lines like ``From: x`` inside a body."""
    found = F.filter(lines(normalize_body(body)), lambda x: x.rlike(QUOTED_HEADER))
    return F.coalesce(F.transform(found, F.trim), F.array().cast("array<string>"))


def looks_like_reply(body: Column) -> Column:
    def test(text: Column) -> Column:
        return (quoted_lines(text) > 0) | text.rlike(ON_WROTE) | text.rlike(ORIGINAL) | (F.size(header_lines(text)) >= 2)

    return F.coalesce(let(normalize_body(body), test), F.lit(False))


def looks_like_forward(body: Column) -> Column:
    def test(text: Column) -> Column:
        heads = let(header_lines(text), lambda h: (F.size(h) >= 3) & F.exists(h, lambda x: F.lower(x).startswith("subject:")))
        return text.rlike(FORWARDED) | text.rlike(ORIGINAL) | heads

    return F.coalesce(let(normalize_body(body), test), F.lit(False))
