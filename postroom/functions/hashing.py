"""Canonical forms and hashes of messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postroom.functions.address import normalize_address, normalize_message_id
from postroom.functions.text import normalize_text


def canonical_text(c: Column) -> Column:
    """Trimmed, white space collapsed, lower-case; '' for null."""
    return F.coalesce(F.lower(normalize_text(c)), F.lit(""))


def canonical_time(ts: Column) -> Column:
    """UTC, whole seconds, ISO; '' for null."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx"), F.lit(""))


def joined(items: Column, ordered: bool) -> Column:
    """Non-empty items, one to a line; sorted unless their order counts."""
    kept = F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(kept if ordered else F.array_sort(kept), "\n")


def content_hash(sender: Column, subject: Column, body: Column) -> Column:
    """Hash of the normalised sender, the subject and the body."""
    return F.sha2(F.concat_ws("\n", F.coalesce(normalize_address(sender), F.lit("")), canonical_text(subject), canonical_text(body)), 256)


def canonical_hash(sender: Column, sent_at: Column, subject: Column, body: Column, recipients: Column, references: Column, attachments: Column) -> Column:
    """Hash of seven labelled sections; the message id is not among them.

    ``recipients``: array of struct(recipient_type, email); ``references``: array
    of message ids, whose order counts; ``attachments``: array of
    struct(filename, mime_type, size_bytes).
    """
    empty = F.lit("")
    people = F.transform(recipients, lambda r: F.concat(canonical_text(r["recipient_type"]), F.lit(":"), F.coalesce(normalize_address(r["email"]), empty)))
    files = F.transform(attachments, lambda a: F.concat_ws("|", canonical_text(a["filename"]), canonical_text(a["mime_type"]), F.coalesce(a["size_bytes"], F.lit(0)).cast("string"), empty))
    # Labels and layout of the sections.
    sections = (
        F.concat(F.lit("sender="), F.coalesce(normalize_address(sender), empty)),
        F.concat(F.lit("sent_at="), canonical_time(sent_at)),
        F.concat(F.lit("subject="), canonical_text(subject)),
        F.concat(F.lit("body="), canonical_text(body)),
        F.concat(F.lit("recipients=\n"), joined(people, False)),
        F.concat(F.lit("references=\n"), joined(F.transform(references, normalize_message_id), True)),
        F.concat(F.lit("attachments=\n"), joined(files, False)),
    )
    return F.sha2(F.concat_ws("\n\n", *sections), 256)
