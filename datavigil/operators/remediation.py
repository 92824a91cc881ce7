"""Masking of assets, remediation of source tables and its history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datavigil.functions import masking as M
from datavigil.operators.grouping import page

# Days before an open finding goes one severity up, by pattern.
ESCALATION_DAYS = {
    "unencrypted_pii": 7,
    "excessive_retention": 14,
    "missing_consent_tag": 3,
    "no_rbac": 5,
    "unclassified_sensitive": 10,
}
DEFAULT_ESCALATION_DAYS = 14
NEXT_SEVERITY = {"low": "medium", "Low": "Medium", "medium": "high", "Medium": "High", "high": "critical",
                 "High": "Critical"}
CLOSED = ["remediated", "resolved"]
EXPORTED = ["remediated", "approved", "rejected"]
AFTER = {"MASK": "***REDACTED***", "DELETE": "[DELETED]", "ENCRYPT": "[ENCRYPTED]"}


def mask_asset(findings: DataFrame, assets: DataFrame, strategy: str, masked_by: str, as_of: str):
    """Mask the findings of the given, not yet masked assets.

    Returns the findings with `masked_value`, the assets with their flags and one audit row per asset with findings.
    """
    due = assets.filter(~F.col("is_masked")).select("asset_id")
    hit = findings.join(due, "asset_id", "left_semi").withColumn(
        "masked_value", M.mask("matched_value", "pattern_name", strategy))
    audit = hit.groupBy("asset_id").agg(F.count("*").alias("findings_count")).withColumns({
        "masked_by": F.lit(masked_by), "masking_strategy": F.lit(strategy), "masked_at": F.lit(as_of).cast("timestamp_ntz")})
    done = audit.select("asset_id", F.lit(True).alias("_done"))
    flagged = assets.join(done, "asset_id", "left").withColumns({
        "masking_strategy": F.when(F.col("_done"), strategy),
        "is_masked": F.col("is_masked") | F.coalesce("_done", F.lit(False))}).drop("_done")
    return hit, flagged, audit


def masking_status(assets: DataFrame, audit: DataFrame) -> DataFrame:
    last = audit.groupBy("asset_id").agg(F.max("masked_at").alias("masked_at"))
    return assets.select("asset_id", "is_masked").join(last, "asset_id", "left")


def masking_audit(audit: DataFrame, asset_id) -> DataFrame:
    return audit.filter(F.col("asset_id") == asset_id)


def remediation_preview(findings: DataFrame, assets: DataFrame, ids: DataFrame, action: str) -> DataFrame:
    """Before and after of the listed findings (`finding_id`)."""
    return findings.join(ids.select("finding_id").distinct(), "finding_id", "left_semi").join(
        assets.select("asset_id", "host", F.col("name").alias("asset_name"), F.col("path").alias("asset_path")),
        "asset_id", "left").select(
        "finding_id", "asset_id", "host", "asset_name", "asset_path", "pii_type",
        F.lit(AFTER["MASK"]).alias("sample_before"), F.lit(AFTER.get(action, AFTER["MASK"])).alias("sample_after"))


def remediation_impact(preview: DataFrame) -> DataFrame:
    return preview.agg(
        F.count("*").alias("total_findings"), F.count_distinct("asset_id").alias("affected_assets"),
        F.count_distinct("host").alias("affected_systems"), F.sort_array(F.collect_set("pii_type")).alias("pii_types"))


def remediate(source: DataFrame, targets: DataFrame, key: str, column: str, action: str, secret: str | None = None):
    """Source table with the cells of the target rows masked, encrypted or their rows deleted, and the originals.

    `targets` holds `key`; the originals (`key`, `column_name`, `original_value`) are what `rollback` needs.
    """
    ids = targets.select(key).distinct()
    originals = source.join(ids, key, "left_semi").select(
        key, F.lit(column).alias("column_name"), F.col(column).cast("string").alias("original_value"))
    if action == "DELETE":
        return source.join(ids, key, "left_anti"), originals
    if action == "MASK":
        new = F.lit("REDACTED")
    elif action == "ENCRYPT":
        if not secret:
            raise ValueError("ENCRYPT needs a key")
        new = M.encrypt(column, secret)
    else:
        raise ValueError(f"unknown action {action}")
    changed = source.join(ids.withColumn("_hit", F.lit(True)), key, "left").withColumn(
        column, F.when(F.col("_hit"), new).otherwise(F.col(column))).drop("_hit")
    return changed.select(source.columns), originals


def rollback(source: DataFrame, originals: DataFrame, actions: DataFrame, key: str, column: str):
    """Cells of completed actions set back, and the actions marked ROLLED_BACK.

    `actions` holds `key` and `status`; any other status stays. Deleted rows cannot come back from a cell value alone.
    """
    done = actions.filter("status = 'COMPLETED'").select(key).distinct()
    back = originals.filter(F.col("column_name") == column).join(done, key, "left_semi").select(
        key, F.col("original_value").alias("_old"), F.lit(True).alias("_hit"))
    restored = source.join(back, key, "left").withColumn(
        column, F.when(F.col("_hit"), F.col("_old")).otherwise(F.col(column))).drop("_old", "_hit")
    marked = actions.withColumn("status", F.when(F.col("status") == "COMPLETED", "ROLLED_BACK").otherwise(F.col("status")))
    return restored.select(source.columns), marked


def remediate_batch(spark: SparkSession, source: DataFrame, targets: DataFrame, key: str, column: str, action: str,
                    out_dir: str, batch_id: str, secret: str | None = None) -> tuple[str, str]:
    """All or nothing: the new version and the originals are written next to the old one and count only if every target
    was found. Returns the status and the folder; readers use the folder of the last completed batch."""
    folder = f"{out_dir}/batch={batch_id}"
    new, originals = remediate(source, targets, key, column, action, secret)
    originals.write.mode("overwrite").parquet(f"{folder}/originals")
    wanted = targets.select(key).distinct().count()
    met = spark.read.parquet(f"{folder}/originals").select(key).distinct().count()
    if met != wanted:
        return "CANCELLED", folder
    new.write.mode("overwrite").parquet(f"{folder}/data")
    return "COMPLETED", folder


def remediation_actions(actions, findings, assets, action_type: str = "ALL", limit: int | None = None, offset: int = 0):
    """Actions with asset, type and severity, newest first."""
    rows = actions if action_type in ("", "ALL") else actions.filter(F.col("action_type") == action_type)
    top = page(rows, [F.desc("executed_at"), "action_id"], limit, offset)
    return _with_context(top, findings, assets)


def _with_context(actions, findings, assets):
    return (
        actions.join(findings.select("finding_id", "asset_id", F.col("pattern_name").alias("_p"),
                                     F.col("severity").alias("_s")), "finding_id", "left")
        .join(assets.select("asset_id", F.col("name").alias("_n"), F.col("path").alias("_path")), "asset_id", "left")
        .select(*actions.columns, F.coalesce("_n", F.lit("")).alias("asset_name"),
                F.coalesce("_path", F.lit("")).alias("asset_path"), F.coalesce("_p", F.lit("")).alias("pii_type"),
                F.coalesce("_s", F.lit("Medium")).alias("risk_level")))


def actions_of_finding(actions: DataFrame, finding_id: str) -> DataFrame:
    return actions.filter(F.col("finding_id") == finding_id)


def asset_history(actions: DataFrame, findings: DataFrame, asset_id) -> DataFrame:
    own = findings.filter(F.col("asset_id") == asset_id).select("finding_id")
    return actions.join(own, "finding_id", "left_semi")


def pii_preview(findings: DataFrame) -> DataFrame:
    return findings.select("finding_id", "pii_type", M.preview("matched_value", "pii_type").alias("masked_text"))


def escalate(findings: DataFrame, reviews: DataFrame, as_of: str) -> DataFrame:
    """Open findings past the age limit of their pattern, with the next severity."""
    limit = F.lit(DEFAULT_ESCALATION_DAYS)
    for name, days in ESCALATION_DAYS.items():
        limit = F.when(F.lower("pattern_name") == name, days).otherwise(limit)
    above = F.lit("Critical")
    for old, new in NEXT_SEVERITY.items():
        above = F.when(F.col("severity") == old, new).otherwise(above)
    now = F.lit(as_of).cast("timestamp_ntz")
    age = F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))) / 86400)
    open_rows = findings.filter(F.lower("severity") != "critical").join(
        reviews.filter(F.col("status").isin(CLOSED)), "finding_id", "left_anti")
    return open_rows.filter(F.col("created_at") < now - F.make_interval(days=limit)).select(
        "finding_id", "asset_id", "pattern_name", "severity", above.alias("new_severity"), age.cast("int").alias("age_days"))


def remediation_export(findings, reviews, assets, limit: int | None = None) -> DataFrame:
    """Rows of the remediation report: reviewed findings with their asset, newest first."""
    done = reviews.filter(F.col("status").isin(EXPORTED))
    rows = findings.join(done, "finding_id")
    top = page(rows.select("finding_id", "asset_id", "pattern_name", "severity", "status", "created_at"),
               [F.desc("created_at"), "finding_id"], limit)
    return top.join(assets.select("asset_id", F.col("name").alias("asset_name"), F.col("path").alias("asset_path")),
                    "asset_id", "left")
