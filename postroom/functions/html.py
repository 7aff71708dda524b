"""HTML bodies: recognising, sanitising, turning into text.

The sanitised HTML is what the rules below leave; it is not safe to render.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from postroom.functions.text import blank_to_null, clean_body, strip, unix_lines

# What marks a text as HTML, what goes, and what breaks a line.
KNOWN_TAG = r"(?is)<\s*(html|body|head|meta|table|tr|td|div|span|font|p|br)\b|</?(html|body|div|span|table|tr|td|font|p|br|a)\b"
ANY_TAG = r"<[a-zA-Z][^>]{0,200}>"
ENTITY = r"&nbsp;|&lt;|&gt;|&amp;|&#\d+;"
COMMENT = r"(?is)<!--.*?-->"
SCRIPT = r"(?is)<(script|style)\b[^>]*>.*?</\1>"
HANDLER = r"""(?is)\s+on[a-z]+\s*=\s*(".*?"|'.*?'|[^\s>]+)"""
SCRIPT_LINK = r"""(?is)(href|src)\s*=\s*("javascript:[^"]*"|'javascript:[^']*'|javascript:[^\s>]+)"""
STYLE = r"""(?is)\sstyle\s*=\s*(".*?"|'.*?')"""
BREAK = r"(?i)<br\s*/?>"
BLOCK = r"(?i)</(p|div|tr|table|li|ul|ol|h[1-6])\s*>|<(p|div|tr|table|li|ul|ol|h[1-6])\b[^>]*>"
SNIFFED = 10_000


def looks_like_html(c: Column) -> Column:
    head = F.left(c, F.lit(SNIFFED))
    found = head.rlike(KNOWN_TAG) | (F.regexp_count(head, F.lit(ANY_TAG)) >= 2) | head.rlike(ENTITY)
    return F.coalesce(found, F.lit(False))


def sanitize(c: Column, escaped_quotes: bool = True) -> Column:
    """Without comments, scripts, handlers and styles; script links point nowhere.

    ``escaped_quotes``: the neutral link is written with backslashes before its
    quotes, as existing archives have it; False writes plain quotes.
    """
    link = '$1=\\\\"#\\\\"' if escaped_quotes else '$1="#"'
    c = unix_lines(c)
    for pattern, by in ((COMMENT, ""), (SCRIPT, ""), (HANDLER, ""), (SCRIPT_LINK, link), (STYLE, "")):
        c = F.regexp_replace(c, pattern, by)
    return blank_to_null(strip(c))


def strip_tags(c: Column) -> Column:
    """Text with its entities still in place."""
    c = F.regexp_replace(F.regexp_replace(unix_lines(c), COMMENT, " "), SCRIPT, " ")
    c = F.regexp_replace(F.regexp_replace(c, BREAK, "\n"), BLOCK, "\n")
    return F.regexp_replace(c, r"(?s)<[^>]+>", " ")


def unescape(c: Column) -> Column:
    """All named and numeric entities; there is no built-in function for it."""

    def decoded(c: pd.Series) -> pd.Series:
        import html

        return c.map(html.unescape, na_action="ignore")

    return F.pandas_udf(decoded, "string")(c)


def html_to_text(c: Column) -> Column:
    """Readable text; texts without an entity go to Python as nulls."""
    text = strip_tags(c)
    return clean_body(F.coalesce(unescape(F.when(F.contains(c, F.lit("&")), text)), text))
