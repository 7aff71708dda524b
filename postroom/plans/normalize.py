"""Raw facts to messages: every rule as an expression over the facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.functions.address import addresses_in, normalize_address, normalize_message_id, references_in
from postroom.functions.folder import occurrence_folder, path_parts
from postroom.functions.hashing import canonical_hash, content_hash
from postroom.functions.html import html_to_text, looks_like_html, sanitize
from postroom.functions.identity import sender_name, titles_in
from postroom.functions.signature import split_signature
from postroom.functions.subject import normalize_subject
from postroom.functions.text import blank_to_null, clean_body, normalize_text, quoted_text, snippet, strip
from postroom.operators.threads import infer_thread


def header(name: str) -> Column:
    return F.try_element_at(F.try_element_at("headers", F.lit(name)), F.lit(1))


def bodies(df: DataFrame, organisation: str | None = None) -> DataFrame:
    """body_clean, body_html_clean, signature and what else a body tells, from the text parts.

    Plain parts win; parts that look like HTML count as HTML whatever their type.
    """
    marked = F.transform("parts", lambda p: F.struct(p["text"].alias("text"), ((p["type"] == "text/html") | looks_like_html(p["text"])).alias("html")))
    df = df.withColumn("_parts", marked)
    join = lambda html: blank_to_null(strip(F.array_join(F.transform(F.filter("_parts", lambda p: p["html"] == F.lit(html)), lambda p: p["text"]), "\n")))
    df = df.withColumns({"_plain": join(False), "_html": join(True)})
    none = F.col("_plain").isNull() & F.col("_html").isNull()
    as_html = looks_like_html(F.col("fallback"))
    df = df.withColumns({"_plain": F.when(none & ~as_html, F.col("fallback")).otherwise(F.col("_plain")), "_html": F.when(none & as_html, F.col("fallback")).otherwise(F.col("_html"))})
    candidate = F.coalesce(clean_body(F.col("_plain")), html_to_text(F.when(F.col("_plain").isNull(), F.col("_html"))))
    df = df.withColumn("_candidate", candidate).withColumn("_split", split_signature(F.col("_candidate"), organisation))
    df = df.withColumns({"body_clean": F.col("_split.body"), "signature": F.col("_split.signature"), "body_html_clean": sanitize(F.col("_html")), "body_raw": F.coalesce("_plain", "_html"), "has_plain_text_body": F.col("_plain").isNotNull(), "has_html_body": F.col("_html").isNotNull()})
    df = df.withColumns({"quoted_text": quoted_text(F.col("body_clean")), "snippet": snippet(F.col("body_clean"))})
    return df.drop("_parts", "_plain", "_html", "_candidate", "_split")


def messages(facts: DataFrame, organisation: str | None = None) -> DataFrame:
    """One row per file with all columns of a message; rows that failed to parse keep their error."""
    df = bodies(facts, organisation)
    null = F.lit(None).cast("string")
    raw_subject = normalize_text(header("subject"))
    content_type = normalize_text(header("content-type"))
    people = F.filter(F.transform("people", lambda p: F.struct(p["kind"].alias("recipient_type"), normalize_text(p["name"]).alias("display_name"), normalize_address(p["address"]).alias("email"))), lambda p: p["email"].isNotNull())
    df = df.withColumn("_people", people)
    keys = F.transform("_people", lambda p: F.concat(p["recipient_type"], F.lit(":"), p["email"]))
    df = df.withColumn("_keys", keys).withColumn("recipients", F.filter("_people", lambda p, i: F.array_position("_keys", F.concat(p["recipient_type"], F.lit(":"), p["email"])) == i + 1))
    refs = F.array_distinct(F.flatten(F.transform(F.coalesce(F.try_element_at("headers", F.lit("references")), F.array().cast("array<string>")), references_in)))
    x_name = normalize_text(F.col("sender_x_name"))
    df = df.withColumns(
        {
            "message_id": normalize_message_id(header("message-id")),
            "in_reply_to": normalize_message_id(header("in-reply-to")),
            "sender_email": normalize_address(F.col("sender.address")),
            "sender_display_name": F.coalesce(normalize_text(F.col("sender.name")), x_name),
            "reply_to_email": normalize_address(F.col("reply_to.address")),
            "subject_raw": raw_subject,
            "subject_normalized": normalize_subject(header("subject")),
            "content_type_header": content_type,
            "mime_type": blank_to_null(F.lower(F.trim(F.substring_index(content_type, ";", 1)))),
            "references": refs,
            "attachments": F.coalesce("attachments", F.array().cast(facts.schema["attachments"].dataType)),
            "_folder": occurrence_folder(F.col("relative_path")),
        }
    )
    for name in ("x_from", "x_to", "x_cc", "x_bcc", "x_folder", "x_origin", "x_filename", "mime_version", "content_transfer_encoding"):
        df = df.withColumn(name, normalize_text(header({"x_filename": "x-filename"}.get(name, name.replace("_", "-")))))
    df = df.withColumns({"attachment_count": F.size("attachments"), "has_attachments": F.size("attachments") > 0})
    df = df.withColumn("_thread", infer_thread(F.col("subject_raw"), F.col("message_id"), F.col("in_reply_to"), F.col("references"), F.col("body_clean")))
    df = df.select("*", "_thread.is_response", "_thread.looks_like_response", "_thread.is_forward", "_thread.response_to_message_id", "_thread.response_to_message_id_source", "_thread.thread_root_message_id", "_thread.references_depth", "_thread.quoted_line_count", F.col("_thread.confidence").alias("thread_confidence"), F.col("_thread.decision_notes").alias("thread_notes"), "_folder.folder_path", "_folder.folder_name", "_folder.folder_type", "_folder.folder_topic")
    parts = (F.col("sender_email"), F.col("subject_normalized"), F.col("body_clean"))
    files = F.transform("attachments", lambda a: F.struct(a["filename"].alias("filename"), a["mime_type"].alias("mime_type"), a["size_bytes"].alias("size_bytes")))
    ok = F.col("parse_ok")
    df = df.withColumns({"content_hash": F.when(ok, content_hash(*parts)).otherwise(null), "canonical_hash": F.when(ok, canonical_hash(parts[0], F.col("sent_at"), parts[1], parts[2], F.col("recipients"), F.col("references"), files)).otherwise(null)})
    return df.drop("_people", "_keys", "_thread", "_folder", "headers", "people", "parts", "fallback", "sender", "reply_to", "sender_x_name", "sent_at_naive")


def owner_headers(decoded: DataFrame) -> DataFrame:
    """Rows for ``operators.owners`` from decoded headers; files that failed are left out."""
    def value(name: str) -> Column:
        return F.try_element_at("headers", F.lit(name))["value"]

    def pairs(name: str) -> Column:
        """Names and addresses of a header, then addresses in plain sight that the parser missed."""
        parsed = F.coalesce(F.try_element_at("headers", F.lit(name))["pairs"], F.array().cast("array<struct<name:string,address:string>>"))
        own = F.transform(parsed, lambda p: F.struct(normalize_text(p["name"]).alias("name"), normalize_address(p["address"]).alias("email")))
        own = F.transform(own, lambda p: F.when(p["email"].isNull() & normalize_address(p["name"]).isNotNull(), F.struct(F.lit(None).cast("string").alias("name"), normalize_address(p["name"]).alias("email"))).otherwise(p))
        own = F.filter(own, lambda p: p["name"].isNotNull() | p["email"].isNotNull())
        seen = F.transform(own, lambda p: p["email"])
        more = F.array_except(F.coalesce(addresses_in(value(name)), F.array().cast("array<string>")), seen)
        return F.concat(own, F.transform(more, lambda e: F.struct(F.lit(None).cast("string").alias("name"), e.alias("email"))))

    df = decoded.filter("headers is not null").withColumn("_from", pairs("from"))
    first = F.get("_from", 0)
    return df.select(
        F.col("mailbox_key").alias("mailbox"),
        F.xxhash64("source_file").alias("_order"),
        "source_file",
        path_parts(F.concat_ws("/", "mailbox_key", "relative_path"))["folder_name"].alias("folder_name"),
        normalize_text(value("x-filename")).alias("x_filename"),
        first["name"].alias("from_name"),
        first["email"].alias("from_email"),
        sender_name(value("x-from")).alias("x_from_name"),
        titles_in(normalize_text(value("x-from")), normalize_text(value("from"))).alias("titles"),
        F.concat(*(pairs(n) for n in ("to", "cc", "bcc", "x-to", "x-cc", "x-bcc"))).alias("contacts"),
    ).drop("_order")
