"""Reports over inferred owners and aliases: previews, top lists, counts; and their files."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING = "<missing>"
TABLE_ROWS, LABEL_ROWS = 200, 20


def value_counts(df: DataFrame, *columns: str, limit: int = LABEL_ROWS) -> DataFrame:
    """Frequencies of values or pairs, nulls and '' as ``<missing>``, ties by value."""
    named = [F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(MISSING)).alias(c) for c in columns]
    return df.select(*named).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns).limit(limit)


def head(df: DataFrame, order: list[Column], where: Column | None = None, limit: int = TABLE_ROWS) -> DataFrame:
    """The first rows in an order, with '' for missing strings."""
    df = df if where is None else df.filter(where)
    return df.orderBy(*order).limit(limit).na.fill("")


def owner_tables(owners: DataFrame) -> dict[str, DataFrame]:
    by_score = [F.desc("owner_confidence_score"), F.asc("mailbox_owner")]
    return {
        "preview": head(owners, [F.asc("mailbox_owner")]),
        "top_confident": head(owners, by_score, F.col("owner_confidence_label") == "high"),
        "corporate_candidates": head(owners, by_score, F.col("is_corporate_mailbox_candidate")),
        "owner_sender_mismatches": head(owners, by_score, F.col("owner_vs_sender_mismatch")),
        "identity_by_confidence": value_counts(owners, "inferred_identity_type", "owner_confidence_label", limit=TABLE_ROWS),
        "top_position_titles": value_counts(owners, "inferred_position_title"),
        "top_primary_emails": value_counts(owners, "inferred_primary_email"),
    }


def alias_tables(candidates: DataFrame) -> dict[str, DataFrame]:
    order = [F.desc("final_alias_score"), F.asc("mailbox_owner"), F.asc("candidate_email")]
    label = F.col("alias_label")
    return {
        "preview": head(candidates, order),
        "top_strong": head(candidates, order, label == "strong_alias"),
        "top_possible": head(candidates, order, label == "possible_alias"),
        "label_counts": value_counts(candidates, "alias_label"),
        "owner_by_label": value_counts(candidates, "mailbox_owner", "alias_label", limit=TABLE_ROWS),
    }


def save_report(df: DataFrame, summary: DataFrame, tables: dict[str, DataFrame], path: str, **manifest) -> None:
    """CSV of all rows (arrays joined by ' | '), and JSON of summary, tables and manifest."""
    flat = [F.array_join(c, " | ").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/rows")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    for name, t in tables.items():
        t.coalesce(1).write.mode("overwrite").json(f"{path}/tables/{name}")
    note = json.dumps({"status": "ok", "generated_at_utc": datetime.now(UTC).isoformat(), "tables": sorted(tables)} | manifest)
    df.sparkSession.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict | None]:
    """(rows, summary, manifest); rows and summary must be there, the manifest may be missing."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{path}/rows")
    summary = spark.read.json(f"{path}/summary")
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        manifest = None
    return rows, summary, manifest
