"""Heatmap, distributions, trends and dashboard numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from datavigil.functions import scoring as S

# Columns of the heatmap.
HEATMAP_TYPES = [
    "IN_AADHAAR", "IN_PAN", "IN_PASSPORT", "CREDIT_CARD",
    "IN_UPI", "IN_IFSC", "IN_BANK_ACCOUNT",
    "IN_PHONE", "EMAIL_ADDRESS",
    "IN_VOTER_ID", "IN_DRIVING_LICENSE",
]
OPEN_REVIEW = ["confirmed", "false_positive", "remediated"]
SEVERITIES = ["Critical", "High", "Medium", "Low"]


def pii_heatmap(findings: DataFrame, assets: DataFrame, classifications: DataFrame) -> DataFrame:
    """Asset type x data type: count, worst severity and intensity against the fullest cell of the row.

    Findings are counted per asset before they meet the assets, so an asset with very many findings is one row by then.
    """
    named = classifications.filter("sub_category <> ''").select("finding_id", "sub_category")
    per_asset = findings.select("finding_id", "asset_id", "severity").join(named, "finding_id").groupBy(
        "asset_id", "sub_category").agg(F.count("*").alias("n"), F.max(S.severity_rank("severity")).alias("worst"))
    row = W.partitionBy("asset_type")  # by now one row per asset type and data type
    cells = per_asset.join(assets.select("asset_id", "asset_type"), "asset_id").groupBy(
        "asset_type", F.col("sub_category").alias("pii_type")).agg(
        F.sum("n").alias("n"), F.max("worst").alias("worst")).withColumns({
            "total": F.sum("n").over(row), "fullest": F.max("n").over(row)})
    grid = cells.select("asset_type", "total", "fullest").distinct().withColumn(
        "pii_type", F.explode(F.array(*[F.lit(t) for t in HEATMAP_TYPES])))
    count = F.coalesce("n", F.lit(0))
    return grid.join(cells.select("asset_type", "pii_type", "n", "worst"), ["asset_type", "pii_type"], "left").select(
        "asset_type", "total", "pii_type", count.alias("finding_count"),
        S.severity_of_rank(F.coalesce("worst", F.lit(1))).alias("risk_level"),
        F.floor(count * 100 / F.col("fullest")).cast("int").alias("intensity"))


def risk_distribution(findings: DataFrame) -> DataFrame:
    """Findings per severity and their total."""
    counts = findings.groupBy(F.coalesce("severity", F.lit("Low")).alias("severity")).agg(F.count("*").alias("findings"))
    return counts.withColumn("total", F.sum("findings").over(W.partitionBy()))


def calendar(spark: SparkSession, as_of: str, days: int) -> DataFrame:
    """The last `days` dates up to and including `as_of`."""
    return spark.range(1).select(F.explode(F.sequence(
        F.date_sub(F.lit(as_of).cast("date"), days - 1), F.lit(as_of).cast("date"))).alias("day"))


def risk_trend(findings: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Findings per day and severity without gaps; `newly_exposed` and `resolved` compare a day with the one before."""
    first = F.date_sub(F.lit(as_of).cast("date"), days - 1)
    rows = findings.filter(
        (F.col("created_at") >= first.cast("timestamp_ntz"))
        & (F.col("created_at") < F.date_add(F.lit(as_of).cast("date"), 1).cast("timestamp_ntz")))
    counts = rows.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES[:3]],
        F.count_if(~F.coalesce(F.col("severity").isin(SEVERITIES[:3]), F.lit(False))).alias("low"))
    filled = calendar(findings.sparkSession, as_of, days).join(counts, "day", "left").fillna(0)
    step = F.col("total") - F.lag("total").over(W.partitionBy().orderBy("day"))
    return filled.withColumns({
        "newly_exposed": F.coalesce(F.greatest(step, F.lit(0)), F.lit(0)),
        "resolved": F.coalesce(F.greatest(-step, F.lit(0)), F.lit(0))})


def dashboard_metrics(findings, reviews, scans, environment: str | None = None, tenant=None) -> DataFrame:
    """One row: findings, critical ones, assets hit, open actions and the last completed scan."""
    rows = findings
    if environment:
        rows = rows.filter(F.col("environment") == environment)
    if tenant is not None:
        rows = rows.filter(F.col("tenant_id") == tenant)
    handled = reviews.filter(F.col("status").isin(OPEN_REVIEW))
    open_rows = rows.filter("severity IN ('Critical', 'High')").join(handled, "finding_id", "left_anti")
    return rows.agg(
        F.count("*").alias("total_pii"), F.count_if(F.col("severity") == "Critical").alias("high_risk_findings"),
        F.count_distinct("asset_id").alias("assets_hit"),
    ).withColumns({
        "actions_required": open_rows.select(F.count("*").alias("n")).scalar(),
        "last_scan": scans.filter("status = 'completed'").select(F.max("scan_completed_at").alias("t")).scalar()})


def scan_risk_trend(scans: DataFrame, findings: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Weighted severity (8/5/2/1) in percent of the worst case, and completed scans, per day a scan started."""
    recent = scans.filter(
        (F.col("scan_started_at") >= F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days)))
        & (F.col("status") == "completed"))
    weight = {"Critical": 8, "High": 5, "Medium": 2, "Low": 1}
    counts = findings.groupBy("scan_run_id").agg(
        F.count("*").alias("_n"), *[F.count_if(F.col("severity") == s).alias(s) for s in weight])
    per_day = recent.select("scan_run_id", F.to_date("scan_started_at").alias("day")).join(
        counts, "scan_run_id", "left").groupBy("day").agg(
        F.count_distinct("scan_run_id").alias("scan_count"), F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"),
        *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in weight])
    weighted = reduce(lambda a, s: a + F.col(s) * weight[s], weight, F.lit(0))
    score = F.when(F.col("_n") > 0, F.floor(weighted * 100 / (F.col("_n") * 8))).otherwise(0)
    return per_day.select("day", score.cast("int").alias("score"), "scan_count")
