"""Whose mailbox is it: counters over headers, scored candidates, one owner each.

Counters are kept in long form, one row per mailbox and value, so that they
aggregate before any shuffle; "most common" means by count, then by the first
message that had it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.functions.address import is_internal, local_part
from postroom.functions.identity import alpha_tokens, file_name_hints, identity_priority, identity_type, name_from_address, split_name
from postroom.functions.text import title

# Weights of the owner score, bonuses by kind, bounds of the labels.
FROM_WEIGHT, NAME_WEIGHT, XFROM_WEIGHT, INTERNAL_BONUS, DOTTED_BONUS = 12.0, 5.0, 8.0, 8.0, 4.0
ANCHOR_BOTH, ANCHOR_ONE, MAILBOX_MATCH, FILE_MATCH = 30.0, 12.0, 20.0, 18.0
KIND_BONUS = (("person", 20.0), ("likely_person", 8.0), ("unknown", -2.0), ("corporate", -35.0), ("system", -45.0), ("external_bulk", -45.0))
HIGH, MEDIUM = 40, 18
IMPERSONAL = ("corporate", "system", "external_bulk")

HEADERS = "mailbox string, seq bigint, folder_name string, x_filename string, from_name string, from_email string, x_from_name string, titles array<string>, contacts array<struct<name:string,email:string>>"


# what each counter counts, and its columns
COUNTERS = {"from_email": ("email",), "from_name": ("name",), "xfrom": ("name",), "title": ("title",), "x_filename": ("x_filename",), "emails": ("email",), "names": ("email", "name")}


def _by_frequency(value: str) -> Column:
    """For max(): most common, then first seen."""
    return F.struct("n", (-F.col("first")).alias("f"), value)


def tagged_counts(headers: DataFrame) -> DataFrame:
    """(mailbox, counter, a, b, n, first): all counters at once, by one read of the headers and one shuffle.

    A header gives a row for each thing that it counts for, and rows of a counter and value are
    added up before the shuffle.  ``n`` and ``first`` (the place of the first appearance) are sums
    and minima, so counts of parts of the mail add up to those of the whole: ``merged_counts``.
    """
    at, null = F.col("seq") * 1000, F.lit(None).cast("string")
    row = lambda counter, a, b, at: F.struct(F.lit(counter).alias("counter"), a.alias("a"), b.alias("b"), at.alias("at"))
    sender, name, other = F.col("from_email"), F.col("from_name"), F.col("x_from_name")
    ones = F.array(row("from_email", sender, null, at), row("from_name", name, null, at), row("xfrom", other, null, at), row("x_filename", F.col("x_filename"), null, at), row("emails", sender, null, at), row("names", sender, name, at), row("names", sender, other, at + 1))
    none = F.array().cast("array<struct<counter:string,a:string,b:string,at:bigint>>")
    titles = F.transform("titles", lambda t: row("title", t, null, at))
    place = lambda i: at + 2 + F.least(i, F.lit(900)).cast("long")
    contacts = F.flatten(F.transform("contacts", lambda c, i: F.array(row("emails", c["email"], null, place(i)), row("names", c["email"], c["name"], place(i)))))
    every = F.concat(ones, F.coalesce(titles, none), F.coalesce(contacts, none))
    said = headers.select("mailbox", F.inline(every)).filter(F.col("a").isNotNull() & ((F.col("counter") != "names") | F.col("b").isNotNull()))
    return said.groupBy("mailbox", "counter", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))


def merged_counts(*parts: DataFrame) -> DataFrame:
    """Counts of parts of the mail as those of the whole."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("mailbox", "counter", "a", "b").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def counters(headers: DataFrame, tagged: DataFrame | None = None) -> dict[str, DataFrame]:
    """Each counter as a table of its own; ``tagged``: the counts, if they are made already.

    Where the session has a folder for checkpoints the counts are written there, so that the mail is not
    parsed again for each counter.
    """
    if tagged is None:
        tagged = tagged_counts(headers)
        if tagged.sparkSession._jsc.sc().getCheckpointDir().isDefined():
            tagged = tagged.checkpoint(eager=False)
    return {name: tagged.filter(F.col("counter") == name).select("mailbox", *(F.col(c).alias(k) for c, k in zip("ab", keys, strict=False)), "n", "first") for name, keys in COUNTERS.items()}


def _overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def owner_score(c: dict[str, Column], domain: str) -> Column:
    """Score of a candidate; ``c`` has kind, email, hits and token sets."""
    local = local_part(c["email"])
    own, name, mail, hints = c["owner_tokens"], c["name_tokens"], c["email_tokens"], c["hints"]
    by_owner, by_file = _overlap(own, name) | _overlap(own, mail), _overlap(hints, name) | _overlap(hints, mail)
    score = F.log1p(c["from_hits"]) * FROM_WEIGHT + F.log1p(c["name_hits"]) * NAME_WEIGHT + F.log1p(c["xfrom_hits"]) * XFROM_WEIGHT
    score = score + F.when(is_internal(c["email"], domain), INTERNAL_BONUS).otherwise(0.0)
    score = score + F.when(by_owner & by_file, ANCHOR_BOTH).when(by_owner | by_file, ANCHOR_ONE).otherwise(0.0)
    for a, b, points in ((own, name, MAILBOX_MATCH), (own, mail, MAILBOX_MATCH), (hints, name, FILE_MATCH), (hints, mail, FILE_MATCH)):
        score = score + F.when(_overlap(a, b), points).otherwise(0.0)
    score = score + F.when(F.contains(local, F.lit(".")), DOTTED_BONUS).otherwise(0.0)
    bonus = F.lit(0.0)
    for kind, points in KIND_BONUS:
        bonus = F.when(c["kind"] == kind, points).otherwise(bonus)
    return score + bonus


def confidence_label(score: Column, kind: Column) -> Column:
    return F.when(kind.isin(*IMPERSONAL), kind).when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def infer_owners(headers: DataFrame, domain: str, tagged: DataFrame | None = None) -> DataFrame:
    """One row per mailbox with its most likely owner and what speaks for that.

    ``headers`` as in ``HEADERS``; ``domain``: that of the organisation.  Ties of
    kind and score go to senders before others, then by address.
    """
    k = counters(headers, tagged)
    boxes = headers.groupBy("mailbox").agg(F.count(F.lit(1)).alias("message_count"), F.count_distinct("folder_name").alias("folder_count"))
    # arrays of this many values at most
    common = lambda df, value, n: df.groupBy("mailbox").agg(F.slice(F.sort_array(F.collect_list(_by_frequency(value)), False), 1, n).alias("v")).select("mailbox", F.transform("v", lambda x: x[value]).alias(f"all_{value}"))
    files = common(k["x_filename"], "x_filename", 20)
    titles = common(k["title"], "title", 20)
    best_name = k["names"].groupBy("mailbox", "email").agg(F.max(_by_frequency("name"))["name"].alias("observed"))
    c = k["emails"].select("mailbox", "email").join(best_name, ["mailbox", "email"], "left")
    c = c.withColumn("name", F.coalesce("observed", name_from_address(F.col("email"))))
    c = c.join(k["from_email"].select("mailbox", "email", F.col("n").alias("from_hits")), ["mailbox", "email"], "left")
    c = c.join(k["from_name"].select("mailbox", "name", F.col("n").alias("name_hits")), ["mailbox", "name"], "left")
    c = c.join(k["xfrom"].select("mailbox", "name", F.col("n").alias("xfrom_hits")), ["mailbox", "name"], "left")
    c = c.join(files.withColumn("hints", file_name_hints(F.col("all_x_filename"))).select("mailbox", "hints"), "mailbox", "left")
    zero = F.lit(0)
    kind = identity_type(F.col("name"), F.col("email"))
    score = owner_score(
        {
            "kind": F.col("kind"),
            "email": F.col("email"),
            "from_hits": F.coalesce("from_hits", zero),
            "name_hits": F.coalesce("name_hits", zero),
            "xfrom_hits": F.coalesce("xfrom_hits", zero),
            "owner_tokens": alpha_tokens(F.col("mailbox")),
            "name_tokens": alpha_tokens(F.col("name")),
            "email_tokens": alpha_tokens(local_part(F.col("email"))),
            "hints": F.coalesce("hints", F.array().cast("array<string>")),
        },
        domain,
    )
    c = c.withColumn("kind", kind).withColumn("score", score)
    rank = F.struct(identity_priority(F.col("kind")).alias("p"), (-F.col("score")).alias("s"), F.col("from_hits").isNull().alias("later"), F.col("email"), F.col("name"), F.col("kind"), F.coalesce("from_hits", zero).alias("from_hits"), F.coalesce("name_hits", zero).alias("name_hits"), F.coalesce("xfrom_hits", zero).alias("xfrom_hits"))
    best = c.groupBy("mailbox").agg(F.min(rank).alias("b"), F.array_sort(F.collect_set("email")).alias("all_emails"))
    sender = k["from_email"].groupBy("mailbox").agg(F.max(_by_frequency("email"))["email"].alias("dominant_sender_email"))
    sender = sender.join(best_name.withColumnRenamed("email", "e").withColumnRenamed("mailbox", "m"), (F.col("mailbox") == F.col("m")) & (F.col("dominant_sender_email") == F.col("e")), "left").select("mailbox", "dominant_sender_email", F.col("observed").alias("dominant_sender_name"))
    top_name = lambda df, alias: df.groupBy("mailbox").agg(F.max(_by_frequency("name"))["name"].alias(alias))
    shown = k["from_name"].select("mailbox", "name").unionByName(k["xfrom"].select("mailbox", "name")).groupBy("mailbox").agg(F.array_sort(F.collect_set("name")).alias("all_display_names"))
    out = boxes
    for more in (best, sender, top_name(k["xfrom"], "top_x"), top_name(k["from_name"], "top_from"), shown, titles, files):
        out = out.join(more, "mailbox", "left")
    email, none = F.col("b.email"), F.array().cast("array<string>")
    plain = title(F.translate("mailbox", "-_", "  "))
    name = F.coalesce("b.name", "top_x", "top_from", plain)
    out = out.withColumn("name", name).withColumn("kind", F.coalesce("b.kind", identity_type(name, email)))
    dominant_kind = identity_type(F.col("dominant_sender_name"), F.col("dominant_sender_email"))
    score = F.coalesce(-F.col("b.s"), F.lit(0.0))
    return out.select(
        F.col("mailbox").alias("mailbox_owner"),
        F.col("name").alias("inferred_display_name"),
        split_name(F.col("name"))["first_name"].alias("inferred_first_name"),
        split_name(F.col("name"))["last_name"].alias("inferred_last_name"),
        email.alias("inferred_primary_email"),
        F.try_element_at("all_title", F.lit(1)).alias("inferred_position_title"),
        F.col("kind").alias("inferred_identity_type"),
        F.col("kind").isin(*IMPERSONAL).alias("is_corporate_mailbox_candidate"),
        "message_count",
        "folder_count",
        F.coalesce("all_emails", none).alias("all_emails"),
        F.coalesce("all_display_names", none).alias("all_display_names"),
        F.coalesce("all_title", none).alias("all_title_candidates"),
        F.slice(F.coalesce("all_x_filename", none), 1, 10).alias("x_filename_examples"),
        F.coalesce("b.from_hits", zero).alias("top_from_email_count"),
        F.coalesce("b.name_hits", zero).alias("top_name_count"),
        F.coalesce("b.xfrom_hits", zero).alias("top_xfrom_count"),
        F.round(score, 2).alias("owner_confidence_score"),
        confidence_label(score, F.col("kind")).alias("owner_confidence_label"),
        "dominant_sender_email",
        "dominant_sender_name",
        dominant_kind.alias("dominant_sender_identity_type"),
        (~email.eqNullSafe(F.col("dominant_sender_email")) | ~F.col("kind").eqNullSafe(dominant_kind)).alias("owner_vs_sender_mismatch"),
    )


def owner_summary(owners: DataFrame) -> DataFrame:
    """One row of totals over the inferred owners."""
    label = lambda v: F.count_if(F.col("owner_confidence_label") == v)
    kind = lambda v: F.count_if(F.col("inferred_identity_type") == v)
    return owners.agg(
        F.count(F.lit(1)).alias("row_count"),
        *(label(v).alias(f"{v}_confidence_count") for v in ("high", "medium", "low")),
        *(kind(v).alias(f"{v}_count") for v in IMPERSONAL),
        F.count_distinct("mailbox_owner").alias("unique_mailbox_owners"),
        F.count_distinct("inferred_primary_email").alias("unique_primary_emails"),
        F.count_distinct("inferred_display_name").alias("unique_display_names"),
        F.count_if("is_corporate_mailbox_candidate").alias("corporate_mailbox_candidates"),
        F.count_if("owner_vs_sender_mismatch").alias("owner_sender_mismatch_count"),
        F.round(F.avg("owner_confidence_score"), 2).alias("avg_owner_confidence_score"),
    )


def link_owners(owners: DataFrame, collaborators: DataFrame, addresses: DataFrame, mailboxes: DataFrame, mailbox_key) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Collaborators upserted by mailbox key; their primary address and mailbox linked if they exist."""
    from postroom.operators.tables import upsert

    notes = F.array_join(
        F.array_compact(
            F.array(
                F.concat(F.lit("identity_type="), F.col("inferred_identity_type")),
                F.concat(F.lit("confidence="), F.col("owner_confidence_label")),
                F.concat(F.lit("score="), F.col("owner_confidence_score").cast("string")),
                F.concat(F.lit("primary_email="), F.col("inferred_primary_email")),
                F.when(F.col("owner_vs_sender_mismatch"), "owner_vs_sender_mismatch"),
            )
        ),
        " | ",
    )
    new = owners.filter("mailbox_owner is not null").select(F.lower("mailbox_owner").alias("employee_key"), F.col("inferred_display_name").alias("display_name"), F.col("inferred_first_name").alias("first_name"), F.col("inferred_last_name").alias("last_name"), F.col("inferred_position_title").alias("position_title"), notes.alias("notes"), (~F.col("is_corporate_mailbox_candidate")).alias("is_employee"))
    primary = owners.select(F.col("inferred_primary_email").alias("e"), F.lower("mailbox_owner").alias("k")).filter("e is not null").groupBy("e").agg(F.max("k").alias("k"))
    linked = addresses.join(primary, F.col("email") == F.col("e"), "left").withColumn("employee_key", F.coalesce("k", "employee_key")).drop("e", "k")
    boxes = owners.select(mailbox_key(F.col("mailbox_owner")).alias("b"), F.lower("mailbox_owner").alias("k")).groupBy("b").agg(F.max("k").alias("k"))
    owned = mailboxes.join(boxes, mailbox_key(F.col("mailbox_key")) == F.col("b"), "left").withColumn("owner", F.coalesce("k", "owner")).drop("b", "k")
    return upsert(collaborators, new.select(*collaborators.columns), ["employee_key"]), linked, owned
