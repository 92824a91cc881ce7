"""Lists, counts and summaries of findings, assets and scans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from datavigil.operators.grouping import exact_avg, page, share_of_total

# Sort names a list accepts | column.
SORT_COLUMNS = {
    "created_at": "created_at",
    "severity": "severity",
    "pattern_name": "pattern_name",
    "asset_name": "asset_name",
    "confidence": "confidence_score",
}
REVIEW_FILTERS = {"Suppressed": "false_positive", "Remediated": "confirmed"}


@dataclass(frozen=True)
class Filters:
    scan_run_id: int | str | None = None
    asset_id: int | str | None = None
    asset_name: str = ""
    severity: str = ""
    pattern_name: str = ""
    data_source: str = ""
    search: str = ""
    review_status: str = ""


def _holds(col: str, text: str):
    return F.contains(F.lower(col), F.lit(text.lower()))


def filtered(findings, classifications, assets, reviews, tenant, f: Filters = Filters()) -> DataFrame:
    """Findings of a tenant without Non-PII, with the filters that are set; a join is planned only if a filter needs it.

    Non-PII findings are removed by an anti join, so a finding with several classifications stays one row.
    """
    out = findings.filter(F.col("tenant_id") == tenant)
    if f.scan_run_id is not None:
        out = out.filter(F.col("scan_run_id") == f.scan_run_id)
    if f.asset_id is not None:
        out = out.filter(F.col("asset_id") == f.asset_id)
    if f.severity:
        out = out.filter(F.col("severity").isin(f.severity.split(",")))
    if f.pattern_name:
        out = out.filter(_holds("pattern_name", f.pattern_name))
    out = without_non_pii(out, classifications)
    if f.review_status == "Active":
        out = out.join(reviews.filter("status <> 'pending'"), "finding_id", "left_anti")
    elif f.review_status in REVIEW_FILTERS:
        out = out.join(reviews.filter(F.col("status") == REVIEW_FILTERS[f.review_status]), "finding_id", "left_semi")
    names = assets.select("asset_id", F.col("name").alias("asset_name"), F.col("path").alias("asset_path"),
                          F.col("data_source").alias("asset_source"))
    out = out.join(names, "asset_id", "left")
    if f.asset_name:
        out = out.filter(_holds("asset_name", f.asset_name))
    if f.data_source:
        out = out.filter(F.col("asset_source") == f.data_source)
    if f.search:
        out = out.filter(_holds("asset_name", f.search) | _holds("asset_path", f.search)
                         | _holds("pattern_name", f.search))
    return out


def without_non_pii(findings: DataFrame, classifications: DataFrame) -> DataFrame:
    """Findings that have no classification, or one that is not Non-PII."""
    return findings.join(
        classifications.groupBy("finding_id")
        .agg(F.bool_and(F.col("classification_type") == "Non-PII").alias("_non_pii"))
        .filter("_non_pii"), "finding_id", "left_anti")


def list_findings(findings, classifications, assets, reviews, tenant, f: Filters = Filters(),
                  sort_by: str = "created_at", sort_order: str = "desc", limit: int | None = None, offset: int = 0) -> DataFrame:
    col = F.col(SORT_COLUMNS.get(sort_by.lower(), "created_at"))
    rows = filtered(findings, classifications, assets, reviews, tenant, f)
    return page(rows, [col.asc() if sort_order.lower() == "asc" else col.desc(), F.col("finding_id")], limit, offset)


def count_findings(findings, classifications, assets, reviews, tenant, f: Filters = Filters()) -> DataFrame:
    return filtered(findings, classifications, assets, reviews, tenant, f).agg(
        F.count_distinct("finding_id").alias("total"))


def findings_by_scan(findings, scan_run_id, limit: int | None = None, offset: int = 0) -> DataFrame:
    rows = findings.filter(F.col("scan_run_id") == scan_run_id)
    return page(rows, [F.desc("created_at"), "finding_id"], limit, offset)


def findings_by_asset(findings, asset_id, limit: int | None = None, offset: int = 0) -> DataFrame:
    rows = findings.filter(F.col("asset_id") == asset_id)
    return page(rows, [F.desc("created_at"), "finding_id"], limit, offset)


def findings_global(findings, classifications, limit: int | None = None, offset: int = 0) -> DataFrame:
    """All tenants; the caller decides who may see that."""
    return page(without_non_pii(findings, classifications), [F.desc("created_at"), "finding_id"], limit, offset)


def findings_masked(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """Matches replaced by the masked value where the asset is masked."""
    flags = assets.select("asset_id", "is_masked")
    hide = F.col("is_masked") & (F.coalesce("masked_value", F.lit("")) != "")
    return findings.join(flags, "asset_id").withColumn(
        "matches", F.when(hide, F.array("masked_value")).otherwise(F.col("matches")))


def finding_details(findings, classifications, assets, reviews) -> DataFrame:
    """Findings with asset, their classifications and the review status (pending if none)."""
    classes = classifications.groupBy("finding_id").agg(F.sort_array(F.collect_list(
        F.struct("classification_type", "sub_category", "confidence_score"))).alias("classifications"))
    names = assets.select("asset_id", F.col("name").alias("asset_name"), F.col("path").alias("asset_path"))
    return (
        findings.join(classes, "finding_id", "left").join(reviews, "finding_id", "left").join(names, "asset_id", "left")
        .withColumn("review_status", F.coalesce("status", F.lit("pending"))).drop("status"))


def facets(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """Distinct pattern and asset names that findings refer to."""
    patterns = findings.select(F.lit("pattern").alias("facet"), F.col("pattern_name").alias("value")).distinct()
    names = assets.join(findings.select("asset_id").distinct(), "asset_id", "left_semi").select(
        F.lit("asset").alias("facet"), F.col("name").alias("value")).distinct()
    return patterns.unionByName(names)


def high_risk_assets(assets: DataFrame, threshold: int, limit: int | None = None) -> DataFrame:
    return page(assets.filter(F.col("risk_score") >= threshold), [F.desc("risk_score"), "asset_id"], limit)


def masked_assets(assets: DataFrame) -> DataFrame:
    return assets.filter("is_masked")


def assets_by_stable_id(assets: DataFrame, stable_ids: list[str]) -> DataFrame:
    return assets.filter(F.col("stable_id").isin(stable_ids))


def list_assets(assets: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    return page(assets, ["asset_id"], limit, offset)


def active(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.filter(F.col("deleted_at").isNull())


def latest_scan(scans: DataFrame) -> DataFrame:
    return page(scans, [F.desc("scan_started_at"), F.desc("scan_run_id")], 1)


def list_scans(scans: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    return page(scans, [F.desc("scan_started_at"), F.desc("scan_run_id")], limit, offset)


def scan_pii_summary(findings: DataFrame, classifications: DataFrame, scan_run_id=None) -> DataFrame:
    """Count and mean confidence per type, of one scan or of each."""
    rows = findings if scan_run_id is None else findings.filter(F.col("scan_run_id") == scan_run_id)
    return rows.select("finding_id", "scan_run_id").join(
        classifications.select("finding_id", "sub_category", "confidence_score"), "finding_id"
    ).groupBy("scan_run_id", F.col("sub_category").alias("pii_type")).agg(
        F.count("*").alias("findings"), exact_avg("confidence_score").alias("avg_confidence"))


def scan_delta(scans: DataFrame, findings: DataFrame, classifications: DataFrame) -> DataFrame:
    """New and gone findings by type between each scan and the last completed one before it, for every scan.

    Counts are made once per (scan, type); a scan meets its predecessor by a full outer join of those counts.
    """
    per_type = findings.select("finding_id", "scan_run_id").join(
        classifications.select("finding_id", F.col("sub_category").alias("pii_type")), "finding_id"
    ).groupBy("scan_run_id", "pii_type").agg(F.count("*").alias("n"))
    # Scans are headers, one row per run; this frame is small and its window runs over headers only.
    before = W.orderBy("scan_started_at", "scan_run_id").rowsBetween(W.unboundedPreceding, -1)
    pairs = scans.select("scan_run_id", F.last(F.when(F.col("status") == "completed", F.col("scan_run_id")),
                                               ignorenulls=True).over(before).alias("previous_scan_id"),
                         ).filter("previous_scan_id IS NOT NULL")
    current = pairs.join(per_type, "scan_run_id").select(
        "scan_run_id", "previous_scan_id", "pii_type", F.col("n").alias("_now"))
    previous = pairs.join(per_type.select(F.col("scan_run_id").alias("previous_scan_id"), "pii_type",
                                          F.col("n").alias("_then")), "previous_scan_id")
    now, then = F.coalesce("_now", F.lit(0)), F.coalesce("_then", F.lit(0))
    return current.join(previous, ["scan_run_id", "previous_scan_id", "pii_type"], "full_outer").select(
        "scan_run_id", "previous_scan_id", "pii_type", F.greatest(now - then, F.lit(0)).alias("new_findings"),
        F.greatest(then - now, F.lit(0)).alias("gone_findings"), (now - then).alias("net_change"))


def classification_summary(findings, classifications, reviews) -> DataFrame:
    """Long table of the summary: `section`, `name`, `count`, `average`, `percent`."""
    pii = classifications.filter("classification_type <> 'Non-PII'")

    def section(df, name, label, *extra):
        cols = {"average": F.lit(None).cast("double"), "percent": F.lit(None).cast("double"), **dict(extra)}
        return df.select(F.lit(name).alias("section"), label.alias("name"), F.col("count"),
                         *[v.alias(k) for k, v in cols.items()])

    by_type = share_of_total(
        pii.groupBy("classification_type").agg(F.count("*").alias("count"), exact_avg("confidence_score").alias("avg")),
        "count", "pct")
    by_severity = without_non_pii(findings, classifications).groupBy("severity").agg(F.count("*").alias("count"))
    marks = reviews.groupBy("status").agg(F.count("*").alias("count"))
    consent = pii.filter("classification_type IN ('Personal Data', 'Sensitive Personal Data')").agg(
        F.count("*").alias("count"))
    hit = without_non_pii(findings, classifications).agg(F.count_distinct("asset_id").alias("count"))
    return (
        section(by_type, "type", F.col("classification_type"), ("average", F.col("avg")), ("percent", F.col("pct")))
        .unionByName(section(by_severity, "severity", F.col("severity")))
        .unionByName(section(marks, "review", F.col("status")))
        .unionByName(section(consent, "consent", F.lit("required")))
        .unionByName(section(hit, "assets", F.lit("hit")))
        .unionByName(section(pii.agg(F.count("*").alias("count")), "total", F.lit("classifications"))))
