"""Names, titles and kinds of identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postroom.functions.address import local_part
from postroom.functions.text import blank_to_null, capitalized, let, normalize_text, strip, title

# Local parts that belong to no person.
GENERIC_LOCAL_PARTS = ("admin", "administrator", "info", "team", "office", "mail", "contact", "support", "noreply", "no-reply", "system", "corp", "service", "services", "group", "list", "newsletter")
# Parts of local parts that mark bulk senders and corporate mailboxes.
BULK_PARTS = ("newsletter", "announce", "announcement", "listserv")
CORPORATE_PARTS = ("team", "group", "office", "corp", "committee")
# Order of preference among kinds of identities.
PRIORITIES = (("person", 0), ("likely_person", 1), ("unknown", 2), ("corporate", 3), ("system", 4), ("external_bulk", 5))
# Job titles in the order in which they are reported.
TITLES = (
    (r"(?i)\bceo\b", "CEO"),
    (r"(?i)\bcfo\b", "CFO"),
    (r"(?i)\bcoo\b", "COO"),
    (r"(?i)\bpresident\b", "President"),
    (r"(?i)\b(vice president|vp)\b", "Vice President"),
    (r"(?i)\bdirector\b", "Director"),
    (r"(?i)\bmanager\b", "Manager"),
    (r"(?i)\banalyst\b", "Analyst"),
    (r"(?i)\btrader\b", "Trader"),
    (r"(?i)\b(attorney|lawyer|counsel)\b", "Legal Counsel"),
    (r"(?i)\bassistant\b", "Assistant"),
)


def alpha_tokens(c: Column) -> Column:
    """The set of letter runs of two or more, lower-case; empty for null."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1)), lambda t: F.length(t) >= 2))
    return F.coalesce(found, F.array().cast("array<string>"))


def split_name(c: Column) -> Column:
    """struct(first, last) of a display name; "Last, First" is turned round."""
    return let(strip(c), _first_and_last)


def _first_and_last(name: Column) -> Column:
    turned = F.concat(strip(F.regexp_replace(name, "(?s)^[^,]*,", "")), F.lit(" "), strip(F.substring_index(name, ",", 1)))
    name = F.when(F.contains(name, F.lit(",")), turned).otherwise(name)
    return let(F.filter(F.split(name, r"(?U)\s+"), lambda t: F.length(t) > 1), _ends)


def _ends(parts: Column) -> Column:
    return F.struct(
        title(F.try_element_at(parts, F.lit(1))).alias("first_name"),
        F.when(F.size(parts) > 1, title(F.try_element_at(parts, F.lit(-1)))).alias("last_name"),
    )


def name_from_address(address: Column) -> Column:
    """A name made from the local part: up to three parts, without generic ones."""
    cleaned = F.regexp_replace(local_part(address), "[^a-zA-Z._ -]", " ")
    parts = F.filter(F.split(cleaned, r"[._\-\s]+"), lambda p: (p != "") & ~F.lower(p).isin(*GENERIC_LOCAL_PARTS))
    return blank_to_null(F.array_join(F.transform(F.slice(parts, 1, 3), capitalized), " "))


def sender_name(x_from: Column) -> Column:
    """The display name of an X-From header."""
    c = strip(F.regexp_replace(normalize_text(x_from), r"(?i)\s*\(e-mail\)\s*$", ""))
    return normalize_text(strip(F.regexp_replace(c, r"\s*<[^>]+>\s*$", "")))


def identity_type(name: Column, address: Column) -> Column:
    return let(F.coalesce(local_part(address), F.lit("")), lambda local: _kind(name, address, local))


def _kind(name: Column, address: Column, local: Column) -> Column:
    holds = lambda parts: local.rlike("|".join(parts))
    return (
        F.when((F.coalesce(name, F.lit("")) == "") & (F.coalesce(address, F.lit("")) == ""), "unknown")
        .when(local.isin(*GENERIC_LOCAL_PARTS), "system")
        .when(holds(BULK_PARTS), "external_bulk")
        .when(holds(CORPORATE_PARTS), "corporate")
        .when(F.size(alpha_tokens(name)) >= 2, "person")
        .when(F.contains(local, F.lit(".")) & (F.size(alpha_tokens(local)) >= 2), "likely_person")
        .otherwise("unknown")
    )


def identity_priority(kind: Column) -> Column:
    out = F.when(kind.isNull(), 6)
    for label, n in PRIORITIES:
        out = out.when(kind == label, n)
    return out.otherwise(99)


def titles_in(*values: Column) -> Column:
    """Job titles that the values name, each once, in the order found."""
    found = [F.when(v.rlike(pattern), label) for v in values for pattern, label in TITLES]
    return F.array_distinct(F.array_compact(F.array(*found)))


def file_name_hints(names: Column) -> Column:
    """Letter runs of archive file names, without their usual endings."""
    cleaned = F.transform(names, lambda n: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(normalize_text(n)), r"\(non-privileged\)", " "), r"\.pst$|\.nsf$", " "), "[^a-z]+", " "))
    return F.array_distinct(F.filter(F.flatten(F.transform(F.filter(cleaned, lambda n: n.isNotNull()), lambda n: F.split(n, " "))), lambda t: F.length(t) >= 2))


def canonical_name(c: Column) -> Column:
    """Display name for comparison: quotes off, "Last, First" turned, one-letter parts dropped, capitalised."""
    return let(F.regexp_replace(normalize_text(c), """^['"]+|['"]+$""", ""), _canonical)


def _canonical(name: Column) -> Column:
    left, right = strip(F.substring_index(name, ",", 1)), strip(F.regexp_replace(name, "(?s)^[^,]*,", ""))
    name = F.when(F.contains(name, F.lit(",")) & (left != "") & (right != ""), F.concat(right, F.lit(" "), left)).otherwise(name)
    return blank_to_null(F.array_join(F.transform(F.filter(F.split(name, r"(?U)\s+"), lambda t: F.length(t) > 1), capitalized), " "))


def canonical_address(c: Column) -> Column:
    return blank_to_null(F.regexp_replace(F.lower(normalize_text(c)), """^['"]+|['"]+$""", ""))


def squashed_local(c: Column) -> Column:
    """Letters and digits of a local part."""
    return blank_to_null(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.nullif(F.size(F.array_union(a, b)), F.lit(0))), F.lit(0.0))


def local_similarity(a: Column, b: Column) -> Column:
    """Of two local parts: 1 if equal, else the Jaccard of their characters, at least 0.85 if one holds the other."""
    return let(squashed_local(a), lambda x: let(squashed_local(b), lambda y: _local_similarity(x, y)))


def _local_similarity(a: Column, b: Column) -> Column:
    chars = lambda c: F.array_distinct(F.split(c, ""))
    score = jaccard(chars(a), chars(b))
    score = F.when(F.contains(a, b) | F.contains(b, a), F.greatest(score, F.lit(0.85))).otherwise(score)
    return F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).otherwise(F.round(score, 4))


def name_similarity(a: Column, b: Column) -> Column:
    return F.round(jaccard(alpha_tokens(canonical_name(a)), alpha_tokens(canonical_name(b))), 4)
