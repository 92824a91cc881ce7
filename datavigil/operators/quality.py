"""Integrity checks over the governance tables, and clean-up jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datavigil.operators.grouping import pick_latest

# Recommendation per status.
ADVICE = {
    "CRITICAL": "Immediate attention required",
    "FAIL": "Must be fixed",
    "WARNING": "Should be reviewed",
    "PASS": "No issues found",
}

# Path and text patterns of test data that is purged.
PURGE_PATHS = ["%test%", "%mock%", "%spec%", "%fixture%", "/tmp/%", "%example%"]
PURGE_TEXTS = ["%john doe%", "%example%", "%test%"]


def _check(name: str, severity: str, counted: DataFrame) -> DataFrame:
    """`counted` has one row with the column `n`."""
    return counted.select(F.lit(name).alias("test_name"), F.when(F.col("n") == 0, "PASS").otherwise(severity)
                          .alias("status"), F.col("n").cast("long").alias("count_affected"))


def _rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def _sum(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def integrity_checks(findings, assets, scans, classifications, patterns) -> DataFrame:
    """All checks, one row each.

    Findings are counted by the key under test before they are compared, so orphans and totals cost one small join.
    `patterns` holds `pattern_name`.
    """
    empty = F.col("scan_run_id").isNull() | F.col("asset_id").isNull() | (
        F.coalesce("pattern_name", F.lit("")) == "") | (F.coalesce("severity", F.lit("")) == "")
    score = F.col("confidence_score")
    by_pattern = findings.groupBy("pattern_name").agg(F.count("*").alias("n"))
    by_scan = findings.groupBy("scan_run_id").agg(F.count("*").alias("n"))
    by_asset = findings.groupBy("asset_id").agg(F.count("*").alias("n"))
    by_place = findings.groupBy("asset_id", "scan_run_id").agg(F.count("*").alias("n"))
    total = findings.select(F.count("*").alias("n")).scalar()
    traced = by_place.join(assets.select("asset_id"), "asset_id", "left_semi").join(
        scans.select("scan_run_id"), "scan_run_id", "left_semi")
    unknown_pattern = _sum(by_pattern.join(patterns, "pattern_name", "left_anti"))
    checks = [
        _check("finding_required_fields", "FAIL", _rows(findings.filter(empty))),
        _check("valid_pii_types", "FAIL", unknown_pattern),
        _check("confidence_score_range", "FAIL", _rows(findings.filter((score < 0) | (score > 1)))),
        _check("scan_finding_relationship", "CRITICAL", _sum(by_scan.join(scans, "scan_run_id", "left_anti"))),
        _check("scan_statistics_accuracy", "WARNING", _rows(scans.join(by_scan, "scan_run_id", "left").filter(
            F.coalesce("n", F.lit(0)) != F.col("total_findings")))),
        _check("asset_finding_relationship", "CRITICAL", _sum(by_asset.join(assets, "asset_id", "left_anti"))),
        _check("asset_statistics_accuracy", "WARNING", _rows(
            assets.select("asset_id", "total_findings").join(by_asset, "asset_id", "left").filter(
                F.coalesce("n", F.lit(0)) != F.col("total_findings")))),
        _check("location_traceability", "FAIL", _sum(by_asset.join(
            assets.filter(F.coalesce("path", F.lit("")) != ""), "asset_id", "left_anti"))),
        _check("unique_asset_locations", "WARNING", _rows(
            assets.filter("path <> ''").groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"))),
        _check("validation_logic_reference", "FAIL", unknown_pattern),
        _check("classification_completeness", "WARNING", _rows(findings.select("finding_id").join(
            classifications.select("finding_id"), "finding_id", "left_anti"))),
        _check("aggregation_integrity", "CRITICAL", scans.agg(F.abs(
            F.coalesce(F.sum("total_findings"), F.lit(0)) - total).alias("n"))),
        _check("classification_filtering", "WARNING", _rows(classifications.filter("classification_type = 'Non-PII'"))),
        _check("complete_traceability", "CRITICAL", traced.agg(
            (total - F.coalesce(F.sum("n"), F.lit(0))).alias("n"))),
    ]
    return reduce(DataFrame.unionByName, checks)


def audit_report(checks: DataFrame) -> DataFrame:
    """Checks with a rank by severity and the recommendation."""
    names = list(ADVICE)
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("status"))
    advice = F.get(F.array(*[F.lit(ADVICE[n]) for n in names]), (rank - 1).cast("int"))
    return checks.withColumns({"severity_rank": rank.cast("int"), "recommendation": advice})


def health_summary(checks: DataFrame) -> DataFrame:
    """One row: checks per status and the worst of them."""
    counts = {s: F.count_if(F.col("status") == s) for s in ADVICE}
    return checks.agg(*[c.alias(s.lower()) for s, c in counts.items()]).withColumn(
        "status", F.when(F.col("critical") > 0, "CRITICAL").when(F.col("fail") > 0, "FAIL")
        .when(F.col("warning") > 0, "WARNING").otherwise("PASS"))


def repair_counts(checks: DataFrame) -> DataFrame:
    """Records that need repair, by kind."""
    kinds = {"scan_finding_relationship": "ORPHANED_FINDINGS", "asset_finding_relationship": "ASSET_ORPHANS",
             "classification_completeness": "MISSING_CLASSIFICATIONS", "valid_pii_types": "INVALID_PATTERNS"}
    name = F.col("test_name")
    kind = reduce(lambda a, k: F.when(name == k, kinds[k]).otherwise(a), kinds, F.lit(None).cast("string"))
    return checks.select(kind.alias("issue_type"), F.col("count_affected").alias("records")).filter(
        "issue_type IS NOT NULL")


def keep_newest(findings: DataFrame) -> DataFrame:
    """The newest finding per asset and pattern."""
    return pick_latest(findings, ["asset_id", "pattern_name"], "created_at", "finding_id")


def cascade(children: DataFrame, findings: DataFrame) -> DataFrame:
    """Child rows whose finding is still there."""
    return children.join(findings.select("finding_id"), "finding_id", "left_semi")


def purge_test_data(findings: DataFrame, assets: DataFrame, sample: str = "matched_value") -> DataFrame:
    """Findings without those on test paths and those with test texts."""
    path = reduce(lambda a, p: a | F.ilike(F.col("path"), F.lit(p)), PURGE_PATHS, F.lit(False))
    text = reduce(lambda a, p: a | F.ilike(F.col(sample), F.lit(p)), PURGE_TEXTS, F.col(sample) == "1234567890")
    return findings.filter(~F.coalesce(text, F.lit(False))).join(
        assets.filter(path).select("asset_id"), "asset_id", "left_anti")


def drop_orphan_assets(assets: DataFrame, findings: DataFrame) -> DataFrame:
    return assets.join(findings.select("asset_id").distinct(), "asset_id", "left_semi")
