"""E-mail addresses and message ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postroom.functions.text import BLANK, blank_to_null, let, normalize_text, strip

# What counts as an address.
CANDIDATE = r"(?i)(?<![\w])[a-z0-9][a-z0-9._%+\-']*@(?:[a-z0-9-]+\.)+[a-z]{2,}\b"
COMPLETE = r"(?i)^[a-z0-9][a-z0-9._%+\-]*@(?:[a-z0-9-]+\.)+[a-z]{2,}$"
# What needs no mending, alone or in brackets: no doubled or outer punctuation, no quotes.
CLEAN = r"(?i)^(?:[^<>@]*<)?\s*([a-z0-9](?:[a-z0-9_%+]|\.(?!\.)|-(?!-))*(?<![._-])@(?!-)(?:[a-z0-9-]+\.)+[a-z]{2,})\s*>?\s*\z"
ANGLE = r"<\s*([^<>@\s]+@[^<>@\s]+)\s*>"
JUNK = BLANK[1:-1] + r"<>\(\)\[\]\{\},;:"


def _found(c: Column) -> Column:
    """The first address somewhere in a text, lower-case, or null."""
    return blank_to_null(F.lower(F.regexp_extract(c, f"({CANDIDATE})", 1)))


def bare(c: Column) -> Column:
    """Without mailto:, brackets, separators and quotes around the value."""
    c = strip(F.regexp_replace(strip(c), r"(?i)^mailto:", ""))
    c = strip(F.regexp_replace(c, rf"(?U)^[{JUNK}]+|[{JUNK}]+$", ""))
    c = strip(F.regexp_replace(c, r"""^["']+|["']+$""", ""))
    return strip(F.regexp_replace(c, r"(?s)^<(.*)>$", "$1"))


def normalize_address(c: Column) -> Column:
    """The address that a noisy value holds, lower-case; null if there is none.

    With exactly one @, the two sides are cleaned (quotes, doubled and outer
    punctuation) and must form an address; otherwise, and if they do not, the
    first address inside the value is taken.  Most values are ``CLEAN`` and take one pattern.
    """
    return let(c, lambda v: let(F.lower(F.regexp_extract(v, CLEAN, 1)), lambda a: F.when(a == "", _noisy(v)).otherwise(a)))


def _noisy(c: Column) -> Column:
    return let(bare(c), lambda v: let(F.coalesce(blank_to_null(F.regexp_extract(v, ANGLE, 1)), v), _mended))


def _mended(value: Column) -> Column:
    one = F.length(value) - F.length(F.replace(value, F.lit("@"))) == 1
    domain = F.regexp_replace(F.regexp_replace(F.lower(strip(F.substring_index(value, "@", -1))), r"^\.+|\.+$", ""), r"\.+", ".")
    domain = F.regexp_replace(F.regexp_replace(domain, r"""^[ '"]+|[ '"]+$""", ""), r"^[ ._-]+|[ ._-]+$", "")
    local = F.replace(F.regexp_replace(strip(F.substring_index(value, "@", 1)), r"""^[ '"]+|[ '"]+$""", ""), F.lit("'"))
    local = F.regexp_replace(F.regexp_replace(F.regexp_replace(local, r"\.{2,}", "."), "-{2,}", "-"), r"^[ ._-]+|[ ._-]+$", "")
    whole = F.concat(blank_to_null(local), F.lit("@"), blank_to_null(domain))
    return F.when(one, let(whole, lambda w: F.when(w.rlike(COMPLETE), F.lower(w)).otherwise(_found(w)))).otherwise(_found(value))


def local_part(address: Column) -> Column:
    """What stands before the first @ of an address, lower-case."""
    return F.when(F.contains(address, F.lit("@")), blank_to_null(F.lower(F.substring_index(address, "@", 1))))


def domain_of(address: Column) -> Column:
    return F.when(F.contains(address, F.lit("@")), blank_to_null(F.regexp_replace(address, r"(?s)^[^@]*@", "")))


def is_internal(address: Column, domain: str) -> Column:
    """Whether the address is of ``domain``; null without an address."""
    return domain_of(address) == F.lit(domain)


def addresses_in(header: Column) -> Column:
    """All addresses of a header: those in plain sight, then those of its parts; each once."""
    seen = F.transform(F.regexp_extract_all(header, F.lit(f"({CANDIDATE})"), F.lit(1)), normalize_address)
    parts = F.transform(F.split(header, "[;,]"), normalize_address)
    return F.array_distinct(F.filter(F.concat(seen, parts), lambda a: a.isNotNull()))


def normalize_message_id(c: Column) -> Column:
    """The first <...> of a value, else the whole of it, lower-case."""
    return let(normalize_text(c), lambda t: F.lower(F.coalesce(blank_to_null(F.regexp_extract(t, r"(<[^<>]+>)", 1)), t)))


def references_in(header: Column) -> Column:
    """Message ids of a References header, in order, each once."""
    empty = F.array().cast("array<string>")

    def ids(text: Column) -> Column:
        found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(<[^<>]+>)"), F.lit(1)), F.lower))
        return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lower(text))))

    return F.coalesce(let(normalize_text(header), lambda t: F.when(t.isNotNull(), ids(t))), empty)
