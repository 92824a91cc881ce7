"""Writers of findings, reports, training sets and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datavigil.operators.compliance import evidence
from datavigil.operators.findings import Filters, filtered
from datavigil.operators.grouping import page, upsert



def export_rows(findings, classifications, assets, reviews, tenant, f: Filters = Filters(),
                limit: int | None = None) -> DataFrame:
    """Rows of the findings export, newest first, confidence with two decimals."""
    rows = filtered(findings, classifications, assets, reviews, tenant, f)
    return page(rows, [F.desc("created_at"), "finding_id"], limit).select(
        "finding_id", "pattern_name", "severity",
        F.format_string("%.2f", F.round("confidence_score", 2)).alias("confidence_score"),
        F.coalesce("asset_name", F.lit("")).alias("asset_name"), F.coalesce("asset_path", F.lit("")).alias("asset_path"),
        F.coalesce("environment", F.lit("")).alias("environment"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def snapshot_report(facts: DataFrame, snapshot_id: str, taken_at: str) -> DataFrame:
    """Facts of one snapshot as report rows; the facts of a snapshot are as many as sources times classes."""
    return facts.select(
        F.lit(snapshot_id).alias("snapshot_id"), F.lit(taken_at).alias("taken_at"), "source", "classification",
        "asset_count", "finding_count", F.format_string("%.2f", F.round("sensitivity_avg", 2)).alias("sensitivity_avg"))


def golden_dataset(findings: DataFrame, feedback: DataFrame, limit: int | None = None) -> DataFrame:
    """Labelled texts from confirmed and false-positive feedback, newest first."""
    kept = feedback.filter("feedback_type IN ('CONFIRMED', 'FALSE_POSITIVE')")
    rows = kept.join(findings.select("finding_id", "matched_value", "pattern_name"), "finding_id")
    return page(rows, [F.desc("created_at"), "finding_id"], limit).select(
        "finding_id", F.col("matched_value").alias("text"), F.col("pattern_name").alias("label"),
        (F.col("feedback_type") == "CONFIRMED").alias("is_pii_confirmed"), "feedback_type")


def evidence_package(tables, tenant, as_of: str, folder: str, limits: dict[str, int] | None = None) -> list[str]:
    """All evidence datasets of a tenant as JSON under one folder, written in parallel; see evidence."""
    parts = evidence(tables, tenant, as_of, limits)
    for name, df in parts.items():
        write_json(df, f"{folder}/{name}")
    return sorted(parts)


def write_upsert(table_path: str, out_path: str, changes: DataFrame, keys: list[str], version: str) -> None:
    """New version of a table with the changes merged by key, written next to the old one."""
    old = changes.sparkSession.read.parquet(table_path)
    upsert(old, changes, keys, version).write.mode("overwrite").parquet(out_path)
