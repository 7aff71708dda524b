"""The import from end to end, and the runs over imported mail."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postroom.operators.owners import infer_owners
from postroom.operators.store import Store
from postroom.operators.tables import addresses_of, attachments_of, build_tables, messages_of, persistence_stats, recipients_of, references_of, upsert, write_snapshot
from postroom.operators.validation import persistable, validate
from postroom.plans.normalize import messages, owner_headers
from postroom.sources.maildir import read_maildir
from postroom.sources.mime import decoded_headers, parse

KEYS = {
    "mailbox": ["mailbox_key"],
    "folder": ["mailbox_key", "folder_path"],
    "email_address": ["email"],
    "message": ["canonical_hash"],
    "message_recipient": ["canonical_hash", "email", "recipient_type"],
    "message_reference": ["canonical_hash", "referenced_message_id"],
    "attachment": ["canonical_hash", "pos"],
    "message_occurrence": ["source_file"],
}


@dataclass
class Import:
    """What an import left: the parsed snapshot and the counters of the report."""

    parsed: DataFrame
    report: DataFrame


def import_maildir(spark: SparkSession, root: str, out: str, max_mailboxes: int | None = None, max_files: int | None = None, persist_invalid: bool = False, organisation: str | None = None) -> Import:
    """Parse a tree, write the parsed snapshot, validate it, write the tables below ``out``.

    Python runs once per message; all tables are derived from the snapshot.
    """
    files = read_maildir(spark, root, max_mailboxes, max_files)
    validate(messages(parse(files), organisation)).write.mode("overwrite").parquet(f"{out}/parsed")
    parsed = spark.read.parquet(f"{out}/parsed")
    write_snapshot(build_tables(persistable(parsed, persist_invalid)), f"{out}/tables")
    return Import(parsed, persistence_stats(parsed))


def read_tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{out}/tables/{name}") for name in KEYS}


def merge_import(spark: SparkSession, old: str, new: str, out: str) -> None:
    """Tables of two imports as one, at a new place; existing messages stay as they are."""
    a, b = read_tables(spark, old), read_tables(spark, new)
    kept = ("message", "message_recipient", "message_reference", "attachment", "email_address")
    write_snapshot({n: upsert(b[n], a[n], k) if n in kept else upsert(a[n], b[n], k) for n, k in KEYS.items()}, f"{out}/tables")


def apply_batch(store: Store, parsed: DataFrame, source: str | None = None, batch: int | None = None, persist_invalid: bool = False) -> bool:
    """Tables of ``store`` with a batch of validated messages, as one version; False if it holds the batch already.

    Messages that are there stay as they are, and so do their recipients, references
    and attachments; an address without a name takes the batch's; folders and occurrences take
    what the batch says.  ``parsed`` is read for each table: let it be a stored table.

    All or nothing: the version is published when every table is staged.
    """
    if source is not None and store.stamps.get(source, -1) >= batch:
        return False
    rows = persistable(parsed, persist_invalid)
    new = build_tables(rows)
    place, changed = f"{store.path}/data/batch-{uuid.uuid4().hex}", {}

    def staged(name: str) -> DataFrame:
        new[name].write.parquet(f"{place}/{name}")
        return store.spark.read.schema(new[name].schema).parquet(f"{place}/{name}")

    blank = F.coalesce(F.col("old.display_name"), F.lit("")) == ""
    takes = {
        "email_address": {"display_name": F.when(blank, F.col("new.display_name")).otherwise(F.col("old.display_name"))},
        "folder": {"folder_name": F.when(F.col("new.folder_name") != F.col("new.folder_path"), F.col("new.folder_name")).otherwise(F.col("old.folder_name"))} | {c: F.col(f"new.{c}") for c in ("folder_type", "folder_topic")},
        "message_occurrence": {c: F.col(f"new.{c}") for c in new["message_occurrence"].columns if c != "source_file"},
    }
    changed["message"], created = store.merged("message", staged("message"), KEYS["message"])
    first = messages_of(rows).join(created.select("canonical_hash"), "canonical_hash", "left_semi")
    new |= {"email_address": addresses_of(rows, first), "message_recipient": recipients_of(first), "message_reference": references_of(first), "attachment": attachments_of(first)}
    for name in KEYS:
        if name != "message":
            changed[name], _ = store.merged(name, staged(name), KEYS[name], takes.get(name))
    store.publish(changed, {} if source is None else {source: batch})
    return True


def debug_records(parsed: DataFrame, path: str) -> None:
    """The parsed snapshot as JSON lines, for looking at."""
    parsed.write.mode("overwrite").json(path)


def owners_of_maildir(spark: SparkSession, root: str, domain: str, max_messages: int | None = 200, max_mailboxes: int | None = None) -> DataFrame:
    """Owners of the mailboxes of a tree, from the first ``max_messages`` files of each."""
    headers = owner_headers(decoded_headers(read_maildir(spark, root, max_mailboxes, max_messages)))
    order = Window.partitionBy("mailbox").orderBy("source_file")
    return infer_owners(headers.withColumn("seq", F.row_number().over(order).cast("long")).drop("source_file"), domain)
