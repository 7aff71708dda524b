"""Mailbox and folder names, their types and topics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postroom.functions.text import blank_to_null, let, normalize_text

# Folder types by whole name, in order of precedence.
FOLDER_TYPES = (
    ("^inbox$", "inbox"),
    ("^sent$", "sent"),
    ("^sent items?$", "sent"),
    ("^sent mail$", "sent"),
    ("^outbox$", "outbox"),
    ("^deleted items?$", "deleted"),
    ("^notes inbox$", "notes"),
    ("^discussion threads$", "discussion"),
    ("^all documents$", "archive"),
    ("^calendar$", "calendar"),
    ("^contacts$", "contacts"),
    ("^tasks?$", "tasks"),
    ("^to do$", "tasks"),
)
# Folder topics by part of the name, in order of precedence.
FOLDER_TOPICS = (
    (r"\bit\b", "it"),
    ("credit|loan|financ", "finance"),
    ("bank|west bank", "bank"),
    ("contract|contracts|lt contracts", "contracts"),
    ("ferc|regulat", "regulation"),
    ("transmission|power|energy|gas|electric", "energy"),
    ("legal|law|litigation", "legal"),
    ("task|to do|todo", "task_management"),
    ("calendar|meeting|schedule", "scheduling"),
    ("contact|address book", "contacts"),
    ("personal|family|private", "personal"),
    ("project|deal", "project"),
)
# Types whose folders have no topic.
SYSTEM_TYPES = ("inbox", "sent", "deleted", "notes", "discussion", "archive", "calendar", "contacts", "tasks", "outbox")


def mailbox_key(c: Column) -> Column:
    """Stable form of a mailbox name."""
    key = F.regexp_replace(F.lower(normalize_text(c)), "[^a-z0-9._-]+", "_")
    return blank_to_null(F.regexp_replace(F.regexp_replace(key, "_+", "_"), "^_+|_+$", ""))


def folder_key(c: Column) -> Column:
    """The name with underscores as spaces, lower-case."""
    return F.lower(normalize_text(F.replace(normalize_text(c), F.lit("_"), F.lit(" "))))


def _first(key: Column, rules, otherwise: Column) -> Column:
    out = None
    for pattern, label in rules:
        out = F.when(key.rlike(pattern), label) if out is None else out.when(key.rlike(pattern), label)
    return out.otherwise(otherwise)


def folder_type(c: Column, rules=FOLDER_TYPES) -> Column:
    """The type of the first rule that the name meets, else the normalised name."""
    return let(folder_key(c), lambda key: _first(key, rules, key))


def folder_topic(c: Column, type_: Column, rules=FOLDER_TOPICS) -> Column:
    none = F.lit(None).cast("string")
    found = let(folder_key(c), lambda key: _first(key, rules, none))
    return F.when(type_.isin(*SYSTEM_TYPES), none).otherwise(found)


def occurrence_folder(relative: Column, rules=FOLDER_TYPES, topics=FOLDER_TOPICS) -> Column:
    """Folder of a file by its path below the mailbox: path, leaf name, type and topic of the leaf.

    A file directly in the mailbox has the path "." and an empty name.
    """
    parts = F.split(relative, "/")
    path = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    name = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    where = F.when(path == "", ".").otherwise(path)
    return let(folder_type(name, rules), lambda kind: F.struct(where.alias("folder_path"), name.alias("folder_name"), kind.alias("folder_type"), folder_topic(name, kind, topics).alias("folder_topic")))


def path_parts(relative: Column) -> Column:
    """Owner, first folder, folder path and depth by the path below the root of the archive."""
    parts = F.split(relative, "/")
    n = F.size(parts)
    inner = F.when(n >= 3, F.slice(parts, 2, n - 2)).when(n == 2, F.slice(parts, 2, 1)).otherwise(F.array().cast("array<string>"))
    inner = F.transform(inner, lambda p: F.coalesce(normalize_text(p), p))
    return F.struct(
        normalize_text(F.get(parts, 0)).alias("mailbox_owner"),
        normalize_text(F.get(parts, 1)).alias("folder_name"),
        blank_to_null(F.array_join(F.filter(inner, lambda p: p != ""), "/")).alias("folder_path"),
        F.size(inner).alias("folder_depth"),
        n.alias("path_depth"),
    )
