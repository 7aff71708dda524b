"""From parsed messages to the normalised tables, first occurrence first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MESSAGE_COLUMNS = (
    "canonical_hash message_id sender_email sent_at in_reply_to subject_normalized body_clean body_html_clean signature mime_type content_type_header "
    "has_attachments attachment_count parse_ok parse_error is_response is_forward response_to_message_id response_to_message_id_source "
    "thread_root_message_id references_depth quoted_line_count"
).split()


def first_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key; the window keeps only the group's head before the shuffle."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")


def import_order() -> Column:
    """The order in which files are taken: mailbox, then path."""
    return F.struct("mailbox_key", "source_file")


def messages_of(parsed: DataFrame) -> DataFrame:
    """One row per canonical hash: that of the first file."""
    return first_by(parsed, ["canonical_hash"], ["mailbox_key", "source_file"])


def mailboxes_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("mailbox_key").distinct()


def folders_of(parsed: DataFrame) -> DataFrame:
    """One row per mailbox and path; the last file's name (if it has one), type and topic count."""
    seq = import_order()
    named = F.when(F.coalesce(F.col("folder_name"), F.lit("")) != "", seq)
    return parsed.groupBy("mailbox_key", "folder_path").agg(
        F.coalesce(F.max_by("folder_name", named), F.col("folder_path")).alias("folder_name"),
        F.max_by("folder_type", seq).alias("folder_type"),
        F.max_by("folder_topic", seq).alias("folder_topic"),
    )


def addresses_of(parsed: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """One row per address; its first display name. Recipients count for first occurrences only (``first``, if these are known)."""
    seq = import_order()
    senders = parsed.select(F.col("sender_email").alias("email"), F.col("sender_display_name").alias("display_name"), F.struct(seq.alias("s"), F.lit(-1).alias("pos")).alias("seq"))
    people = (messages_of(parsed) if first is None else first).select(seq.alias("s"), F.posexplode("recipients").alias("pos", "r"))
    people = people.select(F.col("r.email").alias("email"), F.col("r.display_name").alias("display_name"), F.struct("s", "pos").alias("seq"))
    every = senders.unionByName(people).filter("email is not null")
    named = F.when(F.coalesce(F.col("display_name"), F.lit("")) != "", F.col("seq"))
    found = every.groupBy("email").agg(F.min_by("display_name", named).alias("display_name"))
    return found.select("email", F.substring_index("email", "@", 1).alias("local_part"), F.substring_index("email", "@", -1).alias("domain"), "display_name")


def recipients_of(messages: DataFrame) -> DataFrame:
    rows = messages.select("canonical_hash", F.posexplode("recipients").alias("pos", "r")).select("canonical_hash", "pos", F.col("r.recipient_type").alias("recipient_type"), F.col("r.email").alias("email"), F.col("r.display_name").alias("display_name")).filter("email is not null")
    return rows.groupBy("canonical_hash", "email", "recipient_type").agg(F.min("pos").alias("pos"), F.min_by("display_name", "pos").alias("display_name"))


def references_of(messages: DataFrame) -> DataFrame:
    rows = messages.select("canonical_hash", F.posexplode("references").alias("pos", "referenced_message_id")).filter("coalesce(referenced_message_id, '') != ''")
    return rows.groupBy("canonical_hash", "referenced_message_id").agg(F.min("pos").alias("pos"))


def attachments_of(messages: DataFrame) -> DataFrame:
    rows = messages.select("canonical_hash", F.posexplode("attachments").alias("pos", "a"))
    null = F.lit(None).cast("string")
    return rows.select("canonical_hash", "pos", "a.filename", "a.mime_type", "a.content_id", "a.size_bytes", null.alias("storage_path"), null.alias("sha256"))


def occurrences_of(validated: DataFrame) -> DataFrame:
    return validated.select("source_file", "canonical_hash", "mailbox_key", "folder_path", F.col("is_valid").alias("validation_is_valid"), F.col("errors").alias("validation_errors"), F.col("warnings").alias("validation_warnings"))


def build_tables(validated: DataFrame) -> dict[str, DataFrame]:
    """All tables of a validated snapshot (cache or write it first: it is read for each)."""
    first = messages_of(validated)
    return {
        "mailbox": mailboxes_of(validated),
        "folder": folders_of(validated),
        "email_address": addresses_of(validated),
        "message": first.select(*(c for c in MESSAGE_COLUMNS if c in first.columns)),
        "message_recipient": recipients_of(first),
        "message_reference": references_of(first),
        "attachment": attachments_of(first),
        "message_occurrence": occurrences_of(validated),
    }


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new``, and the rows of ``old`` whose keys it does not have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet below ``path``; write to a new path and switch readers to it."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def persistence_stats(validated: DataFrame) -> DataFrame:
    """Counters of one import: files, messages new and repeated, invalid ones."""
    own = Window.partitionBy("canonical_hash").orderBy("mailbox_key", "source_file")
    marked = validated.withColumn("n", F.row_number().over(own))
    new = (F.col("n") == 1) & F.col("canonical_hash").isNotNull()
    n = lambda column: F.sum(F.when(new, F.size(column)).otherwise(0))
    return marked.agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.count_if(new).alias("messages_created"),
        F.count_if(F.col("n") > 1).alias("messages_existing"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
        F.count_if(~F.col("parse_ok")).alias("parse_errors"),
        n("recipients").alias("recipients_created"),
        n("references").alias("references_created"),
        n("attachments").alias("attachments_created"),
    )
