"""Bytes of a message to raw facts: headers, addresses, date, text parts, attachments.

The only place where Python sees messages: once each, in Arrow batches.  What the
facts mean is decided by expressions in ``postroom.plans.normalize``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from email import message_from_bytes, policy
from email.utils import getaddresses, parseaddr, parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postroom.functions.text import let

FACTS = """
parse_ok boolean, parse_error string, headers map<string,array<string>>, sent_at timestamp, sent_at_naive boolean,
sender struct<name:string,address:string>, sender_x_name string, reply_to struct<name:string,address:string>,
people array<struct<kind:string,name:string,address:string>>,
parts array<struct<type:string,text:string>>, fallback string,
attachments array<struct<filename:string,mime_type:string,content_id:string,size_bytes:bigint>>
"""
PIECE = 500  # messages whose facts a worker holds
_BLANK_LINE = (b"\r\n\r\n", b"\n\n", b"\r\r")
_HEADER = re.compile(r"^([^:\s][^:]*):\s*(.*)$", re.S)


def header_block(raw: bytes) -> tuple[str, str]:
    """Headers and body as text, cut at the first blank line of the first kind present."""
    for mark in _BLANK_LINE:
        if mark in raw:
            head, body = raw.split(mark, 1)
            return head.decode("utf-8", "replace"), body.decode("utf-8", "replace")
    return raw.decode("utf-8", "replace"), ""


def header_map(head: str) -> dict[str, list[str]]:
    """Unfolded headers by lower-case name; encoded words stay as they are."""
    whole: list[str] = []
    for line in re.split(r"\r\n|\n|\r", head):
        if line[:1] in (" ", "\t"):
            if whole:
                whole[-1] += " " + line.strip()
        else:
            whole.append(line.strip())
    out: dict[str, list[str]] = {}
    for line in whole:
        if m := _HEADER.match(line):
            out.setdefault(m[1].strip().lower(), []).append(m[2].strip())
    return out


def _date(value: str | None):
    try:
        return parsedate_to_datetime(" ".join(value.split())) if value and value.split() else None
    except Exception:  # dates of any shape occur; an unreadable one is no date
        return None


def _text(part) -> str | None:
    payload = part.get_payload(decode=True)
    if payload is None:
        return None
    try:
        return payload.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _attachment(part) -> dict | None:
    kind, name = (part.get_content_disposition() or "").lower(), part.get_filename()
    if kind != "attachment" and (not name or kind == "inline"):
        return None
    payload = part.get_payload(decode=True)
    return {"filename": name, "mime_type": (part.get_content_type() or "").lower() or None, "content_id": part.get("Content-ID"), "size_bytes": None if payload is None else len(payload)}


def facts(raw: bytes | None) -> dict:
    """The facts of one message; what can't be parsed says why."""
    out = dict.fromkeys(("parse_error", "headers", "sent_at", "sent_at_naive", "sender", "sender_x_name", "reply_to", "people", "parts", "fallback", "attachments"))
    try:
        raw = raw or b""
        head, body = header_block(raw)
        h = header_map(head)
        first = lambda name: h.get(name, [None])[0]
        sent = _date(first("date"))
        message = message_from_bytes(raw)
        leaves = [p for p in message.walk() if not p.is_multipart()]
        files = {}
        for p in leaves:
            if (a := _attachment(p)) is not None:
                files.setdefault(tuple((a[k] or "").lower() for k in ("filename", "mime_type", "content_id")), a)
        pair = lambda value: dict(zip(("name", "address"), parseaddr(value), strict=True)) if value else None
        sender = pair(first("from") or first("x-from"))
        if sender:
            sender["address"] = sender["address"] or first("from") or first("x-from")
        reply = pair(first("reply-to"))
        if reply:
            reply["address"] = reply["address"] or first("reply-to")
        return out | {
            "parse_ok": True,
            "headers": h,
            "sent_at": sent,
            "sent_at_naive": sent is not None and sent.tzinfo is None,
            "sender": sender,
            "sender_x_name": parseaddr(first("x-from"))[0] if first("x-from") else None,
            "reply_to": reply,
            "people": [{"kind": k, "name": n, "address": a} for k in ("to", "cc", "bcc") for value in h.get(k, []) for n, a in getaddresses([value])],
            "parts": [{"type": (p.get_content_type() or "").lower(), "text": t} for p in leaves if (p.get_content_disposition() or "").lower() != "attachment" and (t := _text(p))],
            "fallback": body,
            "attachments": list(files.values()),
        }
    except Exception as e:  # one bad message must not end the import
        return out | {"parse_ok": False, "parse_error": f"{type(e).__name__}: {e}"}


def parse(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``files`` and the facts of its ``content``."""
    keep = [c for c in files.columns if c != "content"] if keep is None else keep
    facts_schema = T.StructType.fromDDL(FACTS) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(FACTS)
    schema = T.StructType([files.schema[c] for c in keep] + facts_schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (whole.iloc[k : k + PIECE] for whole in batches for k in range(0, max(len(whole), 1), PIECE)):
            rows = pd.DataFrame([facts(None if r is None else bytes(r)) for r in pdf["content"]], columns=facts_schema.names)
            rows["sent_at"] = pd.to_datetime([None if t is None else (t.replace(tzinfo=None) if t.tzinfo is None else t.astimezone(_utc()).replace(tzinfo=None)) for t in rows["sent_at"].astype(object).where(rows["sent_at"].notna(), None)], errors="coerce")
            yield pd.concat([pdf[keep].reset_index(drop=True), rows], axis=1)

    return files.select(*keep, "content").mapInPandas(run, schema)


def _utc():
    from datetime import UTC

    return UTC


def decoded_headers(files: DataFrame) -> DataFrame:
    """(mailbox_key, source_file, relative_path, headers): as a mail reader decodes them.

    Used to find owners: encoded words are decoded, and of a repeated header the
    first counts.  Files that can't be parsed have null headers.
    """
    names = ("From", "To", "Cc", "Bcc", "X-From", "X-To", "X-cc", "X-bcc", "X-FileName")
    keep = ["mailbox_key", "source_file", "relative_path"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for raw in pdf["content"]:
                try:
                    m = message_from_bytes(bytes(raw), policy=policy.default)
                    out.append({n.lower(): {"value": str(v), "pairs": [{"name": a, "address": b} for a, b in getaddresses([str(v)])]} for n in names if (v := m.get(n)) is not None})
                except Exception:  # unreadable files are counted, not fatal
                    out.append(None)
            yield pdf[keep].assign(headers=out)

    return files.select(*keep, "content").mapInPandas(run, "mailbox_key string, source_file string, relative_path string, headers map<string,struct<value:string,pairs:array<struct<name:string,address:string>>>>")


# ---- attachments that a text only speaks of -----------------------------------

# Endings of file names, phrases, and types by ending.
MENTIONED_FILE = r"(?i)\b([a-zA-Z0-9_\-() ]{1,200}\.(?:pdf|png|jpg|jpeg|gif|bmp|tif|tiff|csv|xls|xlsx|doc|docx|ppt|pptx|txt|rtf|zip|7z|tar|gz|xml|json|eml))\b"
HINTS = ("attached", "attachment", "attachments", "pièce jointe", "pièces jointes", "pj", "ci-joint", "voir en pièce jointe", "find attached", "attached file", "attached files", "see attached", "please find attached", "enclosed")
HEADER_HINTS = ("attachment", "inline", "filename=", "filename*=", "name=", "name*=", "x-attachment-id", "content-id")
TYPES = {
    "pdf": "application/pdf",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "csv": "text/csv",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "txt": "text/plain",
    "zip": "application/zip",
    "xml": "application/xml",
    "json": "application/json",
    "eml": "message/rfc822",
}


def type_by_name(name):
    """MIME type by the ending of a file name, or null."""
    types = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    return F.try_element_at(types, F.lower(F.substring_index(name, ".", -1)))


def mentioned_files(text):
    """File names that a text mentions, each once whatever its case, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(MENTIONED_FILE), F.lit(1)), lambda n: F.trim(n))
    return let(found, lambda files: let(F.transform(files, F.lower), lambda low: F.filter(files, lambda n, i: F.array_position(low, F.lower(n)) == i + 1)))


def candidates(text):
    """array of (filename, mime_type): files that a text mentions, or one without a name if it only speaks of an attachment."""
    named = lambda files: F.transform(files, lambda n: F.struct(n.alias("filename"), type_by_name(n).alias("mime_type")))
    null = F.lit(None).cast("string")
    hint = F.when(mentions_attachment(text), F.array(F.struct(null.alias("filename"), null.alias("mime_type"))))
    return let(mentioned_files(text), lambda files: F.when(F.size(files) > 0, named(files)).otherwise(hint))


def mentions_attachment(text):
    return F.coalesce(F.lower(text).rlike("|".join(HINTS)), F.lit(False))


def has_attachment_headers(head):
    return F.coalesce(F.lower(head).rlike("|".join(re.escape(h) for h in HEADER_HINTS)), F.lit(False))
