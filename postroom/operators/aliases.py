"""Other addresses of a mailbox owner: scored pairs of owner and address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postroom.functions.address import domain_of, is_internal, local_part
from postroom.functions.identity import alpha_tokens, canonical_address, canonical_name, file_name_hints, identity_type, local_similarity, name_from_address, name_similarity
from postroom.functions.text import normalize_text

# Local parts that are nobody's alias, and beginnings of list addresses.
BLOCKED = ("admin", "administrator", "support", "help", "info", "mail", "announce", "announcements", "team", "all", "office", "chairman", "outlook", "perfmgmt", "postmaster", "noreply", "no-reply", "webmaster", "customerservice", "newsletter")
LIST_PREFIXES = ("all.", "dl-", "dl_")
# Weights, gate, and bounds of the labels.
WEIGHTS = {"localpart": 35.0, "name": 25.0, "owner": 15.0, "xfile": 15.0, "domain": 5.0, "sender": 5.0}
GATE, SENDER_GATE, EXTERNAL_NEAR, EXTERNAL_BONUS = 0.45, 0.6, 0.75, 5.0
KIND_POINTS = (("person", 5.0), ("likely_person", 2.0), ("unknown", -3.0))
STRONG, POSSIBLE, UNLIKELY = 70, 45, 25


def _half(a: Column, b: Column) -> Column:
    return F.when(F.coalesce(F.arrays_overlap(a, b), F.lit(False)), 0.5).otherwise(0.0)


def domain_score(a: Column, b: Column, domain: str) -> Column:
    """Equal, both of the organisation, equal in the last two labels, or not."""
    return (
        F.when(a.isNull() | b.isNull(), 0.0)
        .when(a == b, 1.0)
        .when(a.endswith(domain) & b.endswith(domain), 0.8)
        .when(F.substring_index(a, ".", -2) == F.substring_index(b, ".", -2), 0.4)
        .otherwise(0.0)
    )


def alias_label(score: Column) -> Column:
    return F.when(score >= STRONG, "strong_alias").when(score >= POSSIBLE, "possible_alias").when(score >= UNLIKELY, "unlikely_alias").otherwise("not_alias")


def alias_reasons(c: dict[str, Column], kind: Column) -> Column:
    def step(v: Column, high: float, strong: str, low: float, weak: str, above: bool = False) -> Column:
        return F.when(v >= high, strong).when(v > low if above else v >= low, weak)

    # The texts of reports.
    return F.array_join(
        F.array_compact(
            F.array(
                step(c["localpart"], 0.95, "localpart quasi identique", 0.75, "localpart proche"),
                step(c["name"], 0.95, "nom quasi identique", 0.75, "nom proche"),
                step(c["owner"], 1.0, "fort alignement mailbox_owner", 0.0, "alignement mailbox_owner", True),
                step(c["xfile"], 1.0, "fort alignement X-FileName", 0.0, "alignement X-FileName", True),
                step(c["domain"], 1.0, "même domaine", 0.8, "domaine interne compatible"),
                step(c["sender"], 1.0, "même sender dominant", 0.75, "sender dominant proche"),
                F.when(kind == "person", "profil personne").when(kind == "likely_person", "profil probablement personne"),
            )
        ),
        " | ",
    )


def alias_candidates(owners: DataFrame, domain: str) -> DataFrame:
    """Pairs of a mailbox and one of its addresses that could be its owner's, with scores and label."""
    none = F.array().cast("array<string>")
    c = owners.select(
        normalize_text(F.col("mailbox_owner")).alias("mailbox_owner"),
        canonical_address(F.col("inferred_primary_email")).alias("pivot_email"),
        canonical_name(F.col("inferred_display_name")).alias("pivot_name"),
        F.col("inferred_identity_type").alias("pivot_identity_type"),
        canonical_address(F.col("dominant_sender_email")).alias("sender"),
        F.coalesce(file_name_hints(F.col("x_filename_examples")), none).alias("hints"),
        F.explode(F.array_distinct(F.array_compact(F.transform("all_emails", canonical_address)))).alias("candidate_email"),
    )
    c = c.filter(~F.col("candidate_email").eqNullSafe(F.col("pivot_email")))
    c = c.withColumns({"candidate_localpart": local_part(F.col("candidate_email")), "candidate_domain": domain_of(F.col("candidate_email")), "candidate_name": F.coalesce(canonical_name(name_from_address(F.col("candidate_email"))), F.col("pivot_name"))})
    c = c.withColumn("candidate_identity_type", identity_type(F.col("candidate_name"), F.col("candidate_email")))
    local = F.coalesce("candidate_localpart", F.lit(""))
    listed = local.isin(*BLOCKED)
    for prefix in LIST_PREFIXES:
        listed = listed | local.startswith(prefix)
    c = c.filter(~F.col("candidate_identity_type").isin("corporate", "system", "external_bulk") & ~listed)
    names, mails, box = alpha_tokens(F.col("candidate_name")), alpha_tokens(F.col("candidate_localpart")), alpha_tokens(F.col("mailbox_owner"))
    c = c.withColumns(
        {
            "localpart": local_similarity(local_part(F.col("pivot_email")), F.col("candidate_localpart")),
            "name": name_similarity(F.col("pivot_name"), F.col("candidate_name")),
            "owner": _half(box, names) + _half(box, mails),
            "xfile": _half(F.col("hints"), names) + _half(F.col("hints"), mails),
            "domain": domain_score(domain_of(F.col("pivot_email")), F.col("candidate_domain"), domain),
            "sender_score": F.when(F.col("sender") == F.col("candidate_email"), 1.0).otherwise(local_similarity(local_part(F.col("sender")), F.col("candidate_localpart"))),
        }
    )
    parts = {n: F.col("sender_score" if n == "sender" else n) for n in WEIGHTS}
    c = c.filter(~((parts["localpart"] < GATE) & (parts["name"] < GATE) & (parts["owner"] == 0) & (parts["xfile"] == 0) & (parts["sender"] < SENDER_GATE)))
    total = sum((parts[n] * w for n, w in WEIGHTS.items()), F.lit(0.0))
    internal = F.coalesce(is_internal(F.col("candidate_email"), domain), F.lit(False))
    external = F.col("candidate_domain").isNotNull() & ~internal
    total = total + F.when(external & (parts["localpart"] >= EXTERNAL_NEAR), EXTERNAL_BONUS).otherwise(0.0)
    for kind, points in KIND_POINTS:
        total = total + F.when(F.col("candidate_identity_type") == kind, points).otherwise(0.0)
    c = c.withColumn("final_alias_score", F.round(F.greatest(F.lit(0.0), F.least(total, F.lit(100.0))), 2))
    return c.select(
        "mailbox_owner",
        "pivot_email",
        "pivot_name",
        "pivot_identity_type",
        "candidate_email",
        "candidate_name",
        "candidate_domain",
        "candidate_localpart",
        "candidate_identity_type",
        F.lit(False).alias("is_same_as_pivot"),
        internal.alias("is_internal_email"),
        external.alias("is_external_email"),
        F.col("localpart").alias("localpart_similarity_score"),
        F.col("name").alias("name_similarity_score"),
        F.col("owner").alias("mailbox_owner_alignment_score"),
        F.col("xfile").alias("xfilename_alignment_score"),
        F.col("domain").alias("domain_alignment_score"),
        F.col("sender_score").alias("sender_alignment_score"),
        "final_alias_score",
        alias_label(F.col("final_alias_score")).alias("alias_label"),
        alias_reasons(parts, F.col("candidate_identity_type")).alias("alias_reasons"),
    )


def similar_classes(people: DataFrame, one: str, other: str) -> DataFrame:
    """(kind, id, representative, similarity): classes of equal names, and the similarity of every two of a nation.

    ``people``: (kind, id, nation, name) of the kinds ``one`` and ``other``.  A class is a kind,
    a nation (null is none) and a name; its smallest id stands for it.  Each row gets its class's
    representative; rows of kind ``pair`` have in ``id`` that of ``one`` and in ``representative``
    that of ``other``.  So any two rows' similarity is that of their representatives, and the work grows
    with the rows and the pairs of different names, not with the pairs of rows.
    """
    classes = people.groupBy("kind", "nation", "name").agg(F.min("id").alias("representative"))
    # a class can hold a large share of all: the members are met by a join that adaptive execution can split, not by a window
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}")) for k in ("kind", "nation", "name")]
    none = F.lit(None).cast("double")
    members = people.alias("p").join(classes.alias("c"), same).select("p.kind", "p.id", "c.representative", none.alias("similarity"))
    side = lambda kind, k: classes.filter(F.col("kind") == kind).select(F.col("nation").alias(f"nation{k}"), F.col("name").alias(f"name{k}"), F.col("representative").alias(f"rep{k}"))
    met = side(one, 1).join(side(other, 2), F.col("nation1") == F.col("nation2"))
    pairs = met.select(F.lit("pair").alias("kind"), F.col("rep1").alias("id"), F.col("rep2").alias("representative"), local_similarity(F.col("name1"), F.col("name2")).alias("similarity"))
    return members.unionByName(pairs)


def similar_pairs(people: DataFrame, one: str, other: str) -> DataFrame:
    """(id1, id2, similarity) of every row of kind ``one`` and every row of kind ``other`` of its nation.

    Names are compared once for each two classes, then the classes' members are met: as many rows as
    there are pairs, which no plan shortens, but each costs a look-up instead of a comparison.
    """
    found = similar_classes(people, one, other)
    members = lambda kind, k: found.filter(F.col("kind") == kind).select(F.col("id").alias(f"id{k}"), F.col("representative").alias(f"rep{k}"))
    pairs = found.filter("kind = 'pair'").select(F.col("id").alias("rep1"), F.col("representative").alias("rep2"), "similarity")
    met = members(one, 1).join(pairs, "rep1")
    # few bytes that become many rows: adaptive execution, going by bytes, would leave them to a few tasks
    met = met.repartition(int(people.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id1", "rep2")
    return met.join(members(other, 2), "rep2").select("id1", "id2", "similarity")


def alias_summary(candidates: DataFrame) -> DataFrame:
    labels = ("strong_alias", "possible_alias", "unlikely_alias", "not_alias")
    return candidates.agg(F.count_distinct("mailbox_owner").alias("mailbox_count"), F.count(F.lit(1)).alias("candidate_row_count"), *(F.count_if(F.col("alias_label") == v).alias(f"{v}_count") for v in labels))


def link_aliases(candidates: DataFrame, collaborators: DataFrame, addresses: DataFrame, accepted: tuple[str, ...] = ("strong_alias",), best_score_wins: bool = False) -> tuple[DataFrame, DataFrame]:
    """(addresses with their collaborators, counters of the linking).

    Of several owners that claim an address, the one with the lowest score wins,
    then the last by name: rows used to be written best first, each over the one
    before.  ``best_score_wins`` turns that round.
    """
    rows = candidates.filter(F.col("alias_label").isin(*accepted)).withColumn("key", F.lower("mailbox_owner"))
    rows = rows.join(collaborators.select(F.lower("employee_key").alias("ck"), F.col("employee_key").alias("found_key")), F.col("key") == F.col("ck"), "left")
    rows = rows.join(addresses.select(F.col("email").alias("ae"), F.col("employee_key").alias("held_by")), F.col("candidate_email") == F.col("ae"), "left")
    both = F.col("found_key").isNotNull() & F.col("ae").isNotNull()
    stats = rows.agg(
        F.count(F.lit(1)).alias("rows_seen"),
        F.count_if(F.col("found_key").isNull()).alias("missing_collaborators"),
        F.count_if(F.col("ae").isNull()).alias("missing_addresses"),
        F.count_if(both).alias("linkable"),
        F.count_if(both & F.col("held_by").eqNullSafe(F.col("found_key"))).alias("already_linked"),
        F.count_if(both & F.col("held_by").isNotNull() & (F.col("held_by") != F.col("found_key"))).alias("conflicts"),
    )
    score = F.col("final_alias_score")
    order = Window.partitionBy("candidate_email").orderBy(score.desc() if best_score_wins else score.asc(), F.desc("mailbox_owner"))
    won = rows.filter(both).withColumn("n", F.row_number().over(order)).filter("n = 1").select(F.col("candidate_email").alias("e"), F.col("found_key").alias("k"))
    return addresses.join(won, F.col("email") == F.col("e"), "left").withColumn("employee_key", F.coalesce("k", "employee_key")).drop("e", "k"), stats
