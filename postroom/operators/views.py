"""Reads of single entities and lists, with the rows that belong to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postroom.operators.ordering import collated


class NotFound(LookupError):
    """No row has the key."""


def one(df: DataFrame, column: str, value) -> dict:
    """The row with a key, or NotFound."""
    rows = df.filter(F.col(column) == F.lit(value)).limit(1).collect()
    if not rows:
        raise NotFound(f"{column} = {value!r}")
    return rows[0].asDict(recursive=True)


def contains(column: str, text: str):
    """Case-insensitive substring; the text is taken literally."""
    return F.contains(F.upper(F.col(column)), F.upper(F.lit(text)))


def collaborator_list(collaborators: DataFrame, addresses: DataFrame, search: str | None = None, collation: str | None = None) -> DataFrame:
    """Collaborators with the number and the sorted list of their addresses.

    ``search`` looks at their key, their names (first and last ones if there are
    such columns) and any of their addresses; the list stays whole for those found.
    """
    own = addresses.groupBy("employee_key").agg(F.count_distinct("email").alias("email_count"), F.array_join(F.array_sort(F.collect_set("email")), ", ").alias("emails"))
    out = collaborators.join(own, "employee_key", "left").withColumns({"email_count": F.coalesce("email_count", F.lit(0)), "emails": F.coalesce("emails", F.lit(""))})
    if search:
        hit = addresses.filter(contains("email", search)).select(F.col("employee_key").alias("_hit")).distinct()
        out = out.join(hit, F.col("employee_key") == F.col("_hit"), "left")
        found = F.col("_hit").isNotNull()
        for name in ("employee_key", "display_name", "first_name", "last_name"):
            if name in collaborators.columns:
                found = found | F.coalesce(contains(name, search), F.lit(False))
        out = out.filter(found).drop("_hit")
    return out.orderBy(collated("display_name", collation).asc_nulls_last(), collated("employee_key", collation))


def collaborator_detail(collaborators: DataFrame, addresses: DataFrame, mailboxes: DataFrame, folders: DataFrame, key: str) -> dict:
    """A collaborator, the addresses, and the mailboxes with their folders."""
    row = one(collaborators, "employee_key", key)
    row["emails"] = [r.email for r in addresses.filter(F.col("employee_key") == key).select("email").distinct().orderBy("email").collect()]
    boxes = mailboxes.filter(F.col("owner") == key).join(folders, "mailbox_key", "left").groupBy("mailbox_key").agg(F.array_sort(F.collect_list("folder_path")).alias("folders"))
    row["mailboxes"] = [r.asDict() for r in boxes.orderBy("mailbox_key").collect()]
    return row


def folder_messages(occurrences: DataFrame, messages: DataFrame, mailbox: str, path: str) -> DataFrame:
    """Messages of a folder, newest first, undated last."""
    own = occurrences.filter((F.col("mailbox_key") == mailbox) & (F.col("folder_path") == path))
    return own.join(messages, "canonical_hash").orderBy(F.col("sent_at").desc_nulls_last(), "source_file")


def folder_page(folders: DataFrame, mailboxes: DataFrame, collaborators: DataFrame, occurrences: DataFrame, messages: DataFrame, addresses: DataFrame, mailbox: str, path: str, collation: str | None = None) -> DataFrame:
    """Messages of a folder with what the page says of each: the folder's type and topic, the mailbox's owner
    and the owner's name, the sender's collaborator and that one's name; nulls where there is none.

    The folder, its mailbox and the owner are one row each, found by their keys; messages meet
    them by joins, so a folder of any length stays distributed.  Newest first, undated last.
    """
    named = collaborators.select(F.col("employee_key").alias("_key"), F.col("display_name").alias("_name"))
    own = folders.filter((F.col("mailbox_key") == mailbox) & (F.col("folder_path") == path)).select("mailbox_key", "folder_path", "folder_name", "folder_type")
    own = own.join(mailboxes.filter(F.col("mailbox_key") == mailbox).select("mailbox_key", "owner"), "mailbox_key", "left")
    own = own.join(named, F.col("owner") == F.col("_key"), "left").withColumnRenamed("_name", "owner_name").drop("_key")
    seen = occurrences.filter((F.col("mailbox_key") == mailbox) & (F.col("folder_path") == path)).select("mailbox_key", "folder_path", "canonical_hash", "source_file")
    of = addresses.select(F.col("email").alias("_email"), F.col("employee_key").alias("sender_key"))
    out = seen.join(own, ["mailbox_key", "folder_path"]).join(messages, "canonical_hash")
    out = out.join(of, F.col("sender_email") == F.col("_email"), "left").drop("_email")
    out = out.join(named, F.col("sender_key") == F.col("_key"), "left").withColumnRenamed("_name", "sender_name").drop("_key")
    return out.orderBy(F.col("sent_at").desc_nulls_last(), collated("source_file", collation))


def message_detail(tables: dict[str, DataFrame], key: str) -> dict:
    """A message with its recipients by type, attachments, references and occurrences."""
    row = one(tables["message"], "canonical_hash", key)
    own = lambda name: tables[name].filter(F.col("canonical_hash") == key)
    people = own("message_recipient").orderBy("pos").collect()
    row["recipients"] = {kind: [r.email for r in people if r.recipient_type == kind] for kind in ("to", "cc", "bcc")}
    row["attachments"] = [r.asDict() for r in own("attachment").orderBy("pos").collect()]
    row["references"] = [r.referenced_message_id for r in own("message_reference").orderBy("pos").collect()]
    row["occurrences"] = [r.asDict() for r in own("message_occurrence").orderBy("source_file").collect()]
    return row


def sent_messages(messages: DataFrame, addresses: DataFrame, employee_key: str) -> DataFrame:
    """What a collaborator sent from any address: a semi-join, so each message once."""
    own = addresses.filter(F.col("employee_key") == employee_key).select(F.col("email").alias("sender_email"))
    return messages.join(own, "sender_email", "left_semi").orderBy(F.col("sent_at").desc_nulls_last(), "message_id")
