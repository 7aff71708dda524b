"""Rules that a parsed message must meet, as codes with texts.

A rule that fails adds its code to ``errors`` or ``warnings``; rules on list
elements add the position.  ``MESSAGES`` has the French texts of the codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The texts of reports.
MESSAGES = {
    "parse_failed": "Le parsing a échoué.",
    "source_file_missing": "occurrence.source_file est requis.",
    "mailbox_key_missing": "occurrence.folder.mailbox_key est requis.",
    "folder_path_missing": "occurrence.folder.folder_path est requis.",
    "sender_missing": "message.sender.email est manquant.",
    "message_id_missing": "message.message_id est manquant.",
    "sent_at_missing": "message.sent_at est manquant.",
    "subject_missing": "message.subject_normalized est manquant.",
    "body_missing": "message.body_clean est vide ou manquant.",
    "reply_without_flag": "message.in_reply_to est présent mais message.is_response vaut False.",
    "recipient_type_invalid": "message.recipients[{}].recipient_type invalide",
    "recipient_empty": "message.recipients[{}] ne contient ni display_name ni email.",
    "recipient_repeated": "message.recipients[{}] dupliqué",
    "no_recipients": "Aucun destinataire extrait.",
    "reference_missing": "message.references[{}].referenced_message_id est manquant.",
    "reference_repeated": "message.references[{}] dupliquée",
    "attachment_count_differs": "message.attachment_count est incohérent avec le nombre réel d'attachments.",
    "has_attachments_differs": "message.has_attachments est incohérent avec la liste attachments.",
    "attachment_size_negative": "message.attachments[{}].size_bytes ne peut pas être négatif.",
    "attachment_anonymous": "message.attachments[{}] ne contient ni filename, ni mime_type, ni content_id.",
    "depth_negative": "message.references_depth ne peut pas être négatif.",
    "quoted_negative": "message.quoted_line_count ne peut pas être négatif.",
    "parent_without_flag": "message.response_to_message_id est présent mais is_response vaut False.",
    "source_without_parent": "message.response_to_message_id_source est renseigné sans response_to_message_id.",
    "depth_differs": "message.references_depth diffère du nombre de références extraites.",
    "reply_differs": "message.in_reply_to diffère de message.response_to_message_id.",
}
RECIPIENT_TYPES = ("to", "cc", "bcc")


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _each(items: str, code: str, bad) -> Column:
    """code[i] for every element of ``items`` that is bad(element, index)."""
    marked = F.transform(items, lambda x, i: F.when(bad(x, i), F.concat(F.lit(f"{code}["), i.cast("string"), F.lit("]"))))
    return F.array_compact(F.coalesce(marked, F.array().cast("array<string>")))


def _before(items: str, i: Column) -> Column:
    return F.slice(F.col(items), 1, i)


def validate(messages: DataFrame) -> DataFrame:
    """``messages`` with errors, warnings and is_valid.

    Needs the columns of a parsed message: recipients
    array<struct<recipient_type, display_name, email>>, references array<string>,
    attachments array<struct<filename, mime_type, content_id, size_bytes>> and
    the scalar fields named below.
    """
    one = lambda test, code: F.when(F.coalesce(test, F.lit(False)), code)
    response = F.coalesce(F.col("is_response"), F.lit(False))
    n_files = F.coalesce(F.size("attachments"), F.lit(0))
    n_refs = F.coalesce(F.size("references"), F.lit(0))
    errors = F.concat(
        F.array_compact(F.array(one(~F.col("parse_ok"), "parse_failed"), one(_empty("source_file"), "source_file_missing"), one(_empty("mailbox_key"), "mailbox_key_missing"), one(_empty("folder_path"), "folder_path_missing"))),
        _each("recipients", "recipient_type_invalid", lambda r, i: ~F.coalesce(r["recipient_type"].isin(*RECIPIENT_TYPES), F.lit(False))),
        _each("recipients", "recipient_empty", lambda r, i: r["display_name"].isNull() & r["email"].isNull()),
        _each("references", "reference_missing", lambda r, i: r.isNull()),
        F.array_compact(F.array(one(F.col("attachment_count") != n_files, "attachment_count_differs"), one(F.col("has_attachments") != (n_files > 0), "has_attachments_differs"))),
        _each("attachments", "attachment_size_negative", lambda a, i: a["size_bytes"] < 0),
        F.array_compact(F.array(one(F.col("references_depth") < 0, "depth_negative"), one(F.col("quoted_line_count") < 0, "quoted_negative"))),
    )
    warnings = F.concat(
        F.array_compact(
            F.array(
                one(_empty("sender_email"), "sender_missing"),
                one(_empty("message_id"), "message_id_missing"),
                one(F.col("sent_at").isNull(), "sent_at_missing"),
                one(_empty("subject_normalized"), "subject_missing"),
                one(_empty("body_clean"), "body_missing"),
                one(~_empty("in_reply_to") & ~response, "reply_without_flag"),
            )
        ),
        _each("recipients", "recipient_repeated", lambda r, i: F.exists(_before("recipients", i), lambda x: (x["recipient_type"] == r["recipient_type"]) & (x["email"] == r["email"]))),
        F.array_compact(F.array(one(F.coalesce(F.size("recipients"), F.lit(0)) == 0, "no_recipients"))),
        _each("references", "reference_repeated", lambda r, i: F.array_contains(_before("references", i), r)),
        _each("attachments", "attachment_anonymous", lambda a, i: a["filename"].isNull() & a["mime_type"].isNull() & a["content_id"].isNull()),
        F.array_compact(
            F.array(
                one(~_empty("response_to_message_id") & ~response, "parent_without_flag"),
                one(F.col("response_to_message_id_source").isNotNull() & F.col("response_to_message_id").isNull(), "source_without_parent"),
                one(F.col("references_depth") != n_refs, "depth_differs"),
                one(F.col("in_reply_to") != F.col("response_to_message_id"), "reply_differs"),
            )
        ),
    )
    return messages.withColumn("errors", errors).withColumn("warnings", warnings).withColumn("is_valid", F.size("errors") == 0)


def message_text(code: str) -> str:
    """The report text of a code such as ``recipient_empty[2]``."""
    name, _, at = code.partition("[")
    return MESSAGES[name].replace("{}", at.rstrip("]"))


def persistable(validated: DataFrame, persist_invalid: bool = False) -> DataFrame:
    """Valid rows, and with ``persist_invalid`` the others; never rows without a hash."""
    return validated.filter((F.col("is_valid") | F.lit(persist_invalid)) & F.col("canonical_hash").isNotNull())
