"""The dashboard: counts, rates, distributions, top lists, quality.

Counts over one table are one aggregate; bodies are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP, BUCKETS, QUOTED_BUCKETS = 10, 15, 20


def rate(part: Column, whole: Column) -> Column:
    """Per cent with two places, 0 of nothing."""
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), 2), F.lit(0.0))


def flag_counts(messages: DataFrame) -> DataFrame:
    """One row: totals and rates of the flags."""
    total = F.count(F.lit(1))
    parts = {
        "with_parent": F.count_if(F.coalesce(F.col("response_to_message_id"), F.lit("")) != ""),
        "parse_ok": F.count_if("parse_ok"),
        "with_attachments": F.count_if("has_attachments"),
        "responses": F.count_if("is_response"),
        "forwards": F.count_if("is_forward"),
    }
    out = messages.agg(total.alias("messages"), *(c.alias(n) for n, c in parts.items()))
    out = out.select("*", *(rate(F.col(n), F.col("messages")).alias(f"{n}_rate") for n in parts))
    return out.withColumn("without_attachments_rate", F.greatest(F.lit(0.0), F.round(100 - F.col("with_attachments_rate"), 2)))


def totals(messages: DataFrame, collaborators: DataFrame, mailboxes: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row: how many rows each table has."""
    tables = {"messages": messages, "collaborators": collaborators, "mailboxes": mailboxes, "attachments": attachments}
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), "n") for name, df in tables.items()]
    union = counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])
    return union.agg(*(F.max(F.when(F.col("t") == name, F.col("n"))).alias(f"total_{name}") for name in tables))


def per_month(messages: DataFrame, *flags: str) -> DataFrame:
    month = F.date_trunc("month", "sent_at")
    return messages.filter("sent_at is not null").groupBy(F.date_format(month, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(f).alias(f"n_{f}") for f in flags)).orderBy("month")


def top(df: DataFrame, column: str, n: int = TOP, unknown: str | None = None) -> DataFrame:
    """The most frequent values, nulls as a value of their own, ties by value."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col(column).asc_nulls_last()).limit(n)
    return counted if unknown is None else counted.withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(unknown)))


def histogram(df: DataFrame, value: Column, name: str, n: int | None = None) -> DataFrame:
    """Rows per value in the order of the values, the first ``n`` of them."""
    out = df.filter(value.isNotNull()).groupBy(value.cast("long").alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(name)
    return out if n is None else out.limit(n)


def quality(messages: DataFrame) -> DataFrame:
    none = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) == "")
    return messages.agg(
        none("sender_email").alias("without_sender"),
        F.count_if(F.col("sent_at").isNull()).alias("without_date"),
        none("message_id").alias("without_message_id"),
        none("subject_normalized").alias("without_subject"),
        F.count_if(~F.col("parse_ok")).alias("parse_errors"),
    )


# What the quality section counts, by the column that is empty.
_EMPTY = {"without_sender": "sender_email", "without_message_id": "message_id", "without_subject": "subject_normalized"}
_FLAGS = ("with_parent", "parse_ok", "with_attachments", "responses", "forwards")


def board(messages: DataFrame, mailbox: str | None = None, folder: str | None = None) -> DataFrame:
    """The whole dashboard from one read of the messages: (section, place, value, n, responses, forwards, rate).

    Grouping sets count every section at once, before any shuffle; the lists keep their head in each
    task.  Sections: ``totals`` and ``quality`` (value: the counter; rate in per cent of all messages),
    ``months``, the top lists ``senders``, ``domains`` (and ``mailboxes``, ``folders`` by the columns
    named), the histograms ``hours``, ``weekdays``, ``attachments``, ``depths``, ``quoted``.
    Lists are as long as those of the functions above, months are all there.  No messages give no rows.
    """
    text = lambda c: c.cast("string")
    domain = F.substring_index("sender_email", "@", -1)
    sections: list[tuple[str, Column, bool, int | None]] = [
        ("months", F.date_format(F.date_trunc("month", "sent_at"), "yyyy-MM"), False, None),
        ("senders", F.col("sender_email"), True, TOP),
        ("domains", F.when(F.contains("sender_email", F.lit("@")), domain), True, TOP),
        *((name, F.col(c), True, TOP) for name, c in (("mailboxes", mailbox), ("folders", folder)) if c),
        ("hours", F.lpad(text(F.hour("sent_at")), 2, "0"), False, None),
        ("weekdays", text(F.dayofweek("sent_at")), False, None),
        ("attachments", text(F.col("attachment_count")), False, BUCKETS),
        ("depths", text(F.col("references_depth")), False, BUCKETS),
        ("quoted", text(F.col("quoted_line_count")), False, QUOTED_BUCKETS),
    ]
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    marks = {"with_parent": ~empty("response_to_message_id"), "parse_ok": F.col("parse_ok"), "with_attachments": F.col("has_attachments"), "responses": F.col("is_response"), "forwards": F.col("is_forward")}
    marks |= {n: empty(c) for n, c in _EMPTY.items()} | {"without_date": F.col("sent_at").isNull(), "parse_errors": ~F.col("parse_ok")}
    rows = messages.select(*(c.alias(f"s_{n}") for n, c, _, _ in sections), *(c.alias(f"m_{n}") for n, c in marks.items()))
    names = [f"s_{n}" for n, _, _, _ in sections]
    counted = rows.groupingSets([[n] for n in names] + [[]], *names).agg(F.grouping_id().alias("_id"), F.count(F.lit(1)).alias("n"), *(F.count_if(f"m_{n}").alias(n) for n in marks))
    bit = {n: 1 << (len(names) - 1 - i) for i, n in enumerate(names)}
    every = (1 << len(names)) - 1
    of = lambda pick: F.coalesce(*(F.when(F.col("_id") == every - bit[f"s_{s[0]}"], pick(s)) for s in sections))
    value, is_top = F.coalesce(*(F.col(n) for n in names)), of(lambda s: F.lit(s[2]))
    counted = counted.withColumns({"section": F.coalesce(of(lambda s: F.lit(s[0])), F.lit("totals")), "value": value, "most": of(lambda s: F.lit(s[3]).cast("int"))})
    # values of histograms that are null are none; those of lists count
    counted = counted.filter((F.col("section") == "totals") | F.coalesce(is_top, F.lit(False)) | F.col("value").isNotNull())
    numeric = F.when(F.col("section").isin("attachments", "depths", "quoted", "hours", "weekdays"), F.col("value").cast("long"))
    # rows of a section without a limit are partitions of their own, so that one constant limit holds:
    # each task keeps the head of its own lists before they meet
    limit = max(TOP, BUCKETS, QUOTED_BUCKETS)
    order = Window.partitionBy("section", F.when(F.col("most").isNull(), F.col("value"))).orderBy(F.when(is_top, -F.col("n")).otherwise(numeric), F.col("value").asc_nulls_last())
    ranked = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).filter(F.col("place") <= F.coalesce("most", F.lit(1)))
    none = F.lit(None).cast("long")
    row = lambda section, place, value, n, responses, forwards, share: F.struct(section.alias("section"), place.alias("place"), value.alias("value"), n.alias("n"), responses.alias("responses"), forwards.alias("forwards"), share.alias("rate"))
    one = lambda name, n: row(F.lit("totals" if name in ("messages", *_FLAGS) else "quality"), none.cast("int"), F.lit(name), n, none, none, rate(n, F.col("n")))
    shown = F.when(F.col("section") == "domains", F.coalesce(F.nullif(F.col("value"), F.lit("")), F.lit("(unknown)"))).otherwise(F.col("value"))
    own = row(F.col("section"), F.when(F.col("most").isNotNull(), F.col("place")), shown, F.col("n"), F.col("responses"), F.col("forwards"), F.lit(None).cast("double"))
    return ranked.select(F.inline(F.when(F.col("section") == "totals", F.array(one("messages", F.col("n")), *(one(n, F.col(n)) for n in marks))).otherwise(F.array(own))))
