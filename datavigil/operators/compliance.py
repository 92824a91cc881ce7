"""Consent, retention, obligations, requests and evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datavigil.functions import scoring as S
from datavigil.operators.grouping import page, pick_latest

# Types whose exposure is critical, age indicators, request states, periods in days.
CRITICAL_TYPES = ["IN_AADHAAR", "IN_PAN", "IN_PASSPORT", "CREDIT_CARD"]
AGE_CATEGORY = "AGE_INDICATOR"
AGE_WORDS = ["age", "dob", "date_of_birth"]
REQUEST_STATUSES = ["PENDING", "IN_PROGRESS", "COMPLETED", "REJECTED"]
FINAL_STATUSES = ["COMPLETED", "REJECTED"]
EXPIRING_DAYS, DEFAULT_RETENTION_DAYS, RESPONSE_DAYS, RESCAN_DAYS = 30, 365, 30, 90
HOME_COUNTRY = "IN"


def _at(as_of: str):
    return F.lit(as_of).cast("timestamp_ntz")


def _days(n):
    return F.make_interval(days=n if not isinstance(n, int) else F.lit(n))


# --- overview -------------------------------------------------------------------------------------------------------

def asset_rollup(assets, findings, classifications) -> DataFrame:
    """One row per asset: findings, worst severity, critical and consent flags, types.

    Findings are counted per asset before the assets are joined; the types of an asset are as many as there are types.
    """
    rows = findings.select("finding_id", "asset_id", "severity").join(
        classifications.select("finding_id", "sub_category", "requires_consent"), "finding_id", "left")
    stats = rows.groupBy("asset_id").agg(
        F.count_distinct("finding_id").alias("finding_count"), F.max(S.severity_rank("severity")).alias("worst"),
        F.coalesce(F.bool_or("requires_consent"), F.lit(False)).alias("requires_consent"),
        F.sort_array(F.collect_set("sub_category")).alias("pii_types"))
    return assets.select("asset_id", "name", "path").join(stats, "asset_id", "left").withColumns({
        "finding_count": F.coalesce("finding_count", F.lit(0)),
        "has_critical": F.coalesce(F.col("worst") >= 4, F.lit(False)),
        "requires_consent": F.coalesce("requires_consent", F.lit(False)),
        "risk_level": S.severity_of_rank(F.coalesce("worst", F.lit(0)))})


def remediation_queue(rollup: DataFrame) -> DataFrame:
    """Assets with critical or consent-requiring findings, by priority."""
    return rollup.filter((F.col("finding_count") > 0) & (F.col("has_critical") | F.col("requires_consent"))).select(
        "asset_id", "name", "path", "risk_level", "pii_types", "finding_count",
        F.when(F.col("has_critical"), "critical").otherwise("high").alias("priority"))


def compliance_overview(rollup: DataFrame) -> DataFrame:
    """One row: assets, compliance score and exposure."""
    hit = F.col("finding_count") > 0
    return rollup.agg(
        F.count("*").alias("total_assets"), F.count_if(~hit).alias("compliant_assets"),
        F.count_if(hit).alias("non_compliant_assets"), F.count_if(F.col("has_critical")).alias("critical_assets"),
        F.count_if(F.col("requires_consent")).alias("consent_assets"),
        F.sum(F.when(F.col("has_critical"), F.size(F.array_intersect(
            "pii_types", F.array(*[F.lit(t) for t in CRITICAL_TYPES])))).otherwise(0)).alias("critical_exposures"),
    ).withColumn("compliance_score", F.coalesce(
        F.try_divide(F.col("compliant_assets") * 100.0, F.col("total_assets")), F.lit(0.0)))


def category_breakdown(findings, classifications) -> DataFrame:
    """Assets per class."""
    return findings.select("finding_id", "asset_id").join(
        classifications.select("finding_id", "classification_type"), "finding_id").groupBy("classification_type").agg(
        F.count_distinct("asset_id").alias("assets"))


def critical_assets(queue: DataFrame) -> DataFrame:
    return queue.filter("priority = 'critical'")


def consent_assets(queue: DataFrame) -> DataFrame:
    return queue.filter("priority IN ('high', 'critical')")


# --- consent --------------------------------------------------------------------------------------------------------

def consent_status(consents: DataFrame, as_of: str) -> DataFrame:
    now, expires = _at(as_of), F.col("consent_expires_at")
    return consents.withColumn(
        "status", F.when(F.col("consent_withdrawn_at").isNotNull(), "WITHDRAWN").when(expires < now, "EXPIRED")
        .when(expires < now + _days(EXPIRING_DAYS), "EXPIRING_SOON").otherwise("VALID"))


def current_consent(consents: DataFrame) -> DataFrame:
    return pick_latest(consents, ["asset_id", "pii_type"], "consent_obtained_at", "consent_id")


def list_consents(consents: DataFrame, as_of: str, asset_id=None, pii_type: str | None = None,
                  status: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    rows = consent_status(consents, as_of)
    for col, value in (("asset_id", asset_id), ("pii_type", pii_type), ("status", status)):
        if value is not None:
            rows = rows.filter(F.col(col) == value)
    return page(rows, [F.desc("consent_obtained_at"), "consent_id"], limit, offset)


def consent_violations(findings, assets, consents, as_of: str) -> DataFrame:
    """(Asset, type) with findings whose consent is missing, expired or withdrawn. Findings are counted first."""
    counts = findings.groupBy("asset_id", "pii_type").agg(F.count("*").alias("n"))
    states = consent_status(consents, as_of).groupBy("asset_id", "pii_type", "status").agg(F.count("*").alias("m"))
    bad = F.col("status").isNull() | F.col("status").isin("EXPIRED", "WITHDRAWN")
    return (
        counts.join(states, ["asset_id", "pii_type"], "left").filter(bad)
        .join(assets.select("asset_id", F.col("name").alias("asset_name")), "asset_id")
        .select("asset_id", "asset_name", "pii_type", (F.col("n") * F.coalesce("m", F.lit(1))).alias("finding_count"),
                F.coalesce("status", F.lit("MISSING")).alias("consent_status")))


def withdraw(consents: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """Consents with the listed ones withdrawn now, unless they already were. `ids` holds `consent_id`."""
    listed = ids.select("consent_id").distinct().withColumn("_hit", F.lit(True))
    return consents.join(listed, "consent_id", "left").withColumn(
        "consent_withdrawn_at", F.when(F.col("_hit"), F.coalesce("consent_withdrawn_at", _at(as_of)))
        .otherwise(F.col("consent_withdrawn_at"))).drop("_hit")


# --- retention ------------------------------------------------------------------------------------------------------

def deletion_due(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """Findings with the day they must be gone: creation plus the days of the asset's policy, 365 without one."""
    policy = assets.select("asset_id", F.col("name").alias("asset_name"), F.coalesce(
        "retention_policy_days", F.lit(DEFAULT_RETENTION_DAYS)).alias("retention_days"))
    return findings.select("finding_id", "asset_id", "pattern_name", "created_at").join(policy, "asset_id").withColumn(
        "deletion_due_at", F.col("created_at") + _days(F.col("retention_days")))


def retention_violations(findings, assets, as_of: str) -> DataFrame:
    overdue = F.floor((F.unix_seconds(_at(as_of).cast("timestamp")) - F.unix_seconds(
        F.col("deletion_due_at").cast("timestamp"))) / 86400).cast("int")
    return deletion_due(findings, assets).filter(F.col("deletion_due_at") < _at(as_of)).withColumn(
        "days_overdue", F.greatest(overdue, F.lit(0)))


def violating_assets(findings, assets, as_of: str) -> DataFrame:
    """Assets with at least one overdue finding, from the oldest finding alone: one row per asset meets its policy."""
    oldest = findings.groupBy("asset_id").agg(F.min("created_at").alias("created_at")).withColumns({
        "finding_id": F.lit(""), "pattern_name": F.lit("")})
    return retention_violations(oldest, assets, as_of).select("asset_id", "asset_name")


def retention_expiring(findings, assets, as_of: str) -> DataFrame:
    return deletion_due(findings, assets).filter(
        F.col("deletion_due_at").between(_at(as_of), _at(as_of) + _days(EXPIRING_DAYS)))


def retention_timeline(findings, assets, as_of: str) -> DataFrame:
    due, now = F.col("deletion_due_at"), _at(as_of)
    return deletion_due(findings, assets).withColumn(
        "status", F.when(due < now, "OVERDUE").when(due < now + _days(EXPIRING_DAYS), "EXPIRING_SOON")
        .otherwise("COMPLIANT"))


def set_retention(assets: DataFrame, policies: DataFrame) -> DataFrame:
    """Assets with the retention days of `policies` (`asset_id`, `days`) set."""
    return assets.join(policies.select("asset_id", F.col("days").alias("_days")), "asset_id", "left").withColumn(
        "retention_policy_days", F.coalesce("_days", "retention_policy_days")).drop("_days")


# --- obligations ----------------------------------------------------------------------------------------------------

def _gap(df, section: str, status, detail, subject="asset_id", name="name") -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), F.col(subject).cast("long").alias("subject_id"), F.col(name).alias("subject"),
        status.alias("status"), detail.alias("detail"))


def _pass_if(ok, passed: str, failed: str):
    return F.when(ok, "PASS").otherwise("FAIL"), F.when(ok, passed).otherwise(failed)


def unconsented(findings, classifications, consents, as_of: str) -> DataFrame:
    """Consent-requiring findings of assets without an active consent, one row each: the evidence of Sec 4."""
    need = findings.select("finding_id", "asset_id").join(
        classifications.filter("requires_consent").select("finding_id"), "finding_id", "left_semi")
    active = consent_status(consents, as_of).filter("status IN ('VALID', 'EXPIRING_SOON')").select("asset_id")
    return need.join(active, "asset_id", "left_anti")


def ob_lawful(assets, findings, classifications, consents, as_of: str) -> DataFrame:
    """Sec 4. The evidence is `unconsented`, as rows; a gap carries its number."""
    gaps = unconsented(findings, classifications, consents, as_of).groupBy("asset_id").agg(F.count("*").alias("n"))
    return _gap(gaps.join(assets, "asset_id"), "SEC4", F.lit("FAIL"),
                F.format_string("%d findings require consent, none is active", "n"))


def ob_purpose(assets, findings) -> DataFrame:
    """Sec 5: a purpose is declared on every asset with findings."""
    ok = F.coalesce("declared_purpose", F.lit("")) != ""
    hit = assets.join(findings.select("asset_id").distinct(), "asset_id", "left_semi")
    return _gap(hit, "SEC5", *_pass_if(ok, "Purpose declared", "No declared purpose"))


def ob_consent(assets, consents, as_of: str) -> DataFrame:
    """Sec 6: expired or withdrawn consents."""
    bad = consent_status(consents, as_of).filter("status IN ('WITHDRAWN', 'EXPIRED')").groupBy("asset_id").agg(
        F.count("*").alias("n"))
    return _gap(bad.join(assets, "asset_id"), "SEC6", F.lit("FAIL"),
                F.format_string("%d expired or withdrawn consents", "n"))


def ob_rights(tenants, requests, as_of: str) -> DataFrame:
    """Sec 7: requests pending for more than 30 days."""
    late = requests.filter((F.col("status") == "PENDING") & (F.col("created_at") < _at(as_of) - _days(RESPONSE_DAYS)))
    per_tenant = late.groupBy("tenant_id").agg(F.count("*").alias("n")).join(tenants, "tenant_id")
    return _gap(per_tenant, "SEC7", F.lit("FAIL"), F.format_string("%d requests pending over 30 days", "n"),
                subject="tenant_id")


def ob_accuracy(assets, findings, scans, as_of: str) -> DataFrame:
    """Sec 8: the last scan is at most 90 days old."""
    seen = findings.select("asset_id", "scan_run_id").distinct().join(
        scans.select("scan_run_id", "scan_completed_at"), "scan_run_id").groupBy("asset_id").agg(
        F.max("scan_completed_at").alias("last_scan"))
    ok = F.coalesce(F.col("last_scan") >= _at(as_of) - _days(RESCAN_DAYS), F.lit(False))
    return _gap(assets.join(seen, "asset_id", "left"), "SEC8",
                *_pass_if(ok, "Scanned within 90 days", "Not scanned within 90 days"))


def ob_children(assets, findings, classifications, words: list[str] = AGE_WORDS) -> DataFrame:
    """Sec 9: findings that point at an age or birth date, by the words or by their `dpdpa_category`, if there is such a column;
    one UNKNOWN row when nothing was scanned at all."""
    told = F.lower("sub_category").rlike("|".join(words))
    if "dpdpa_category" in classifications.columns:
        told = F.coalesce(told, F.lit(False)) | F.coalesce(F.col("dpdpa_category") == AGE_CATEGORY, F.lit(False))
    hits = classifications.filter(told).select("finding_id")
    flagged = findings.join(hits, "finding_id", "left_semi").groupBy("asset_id").agg(F.count("*").alias("n"))
    gaps = _gap(flagged.join(assets, "asset_id"), "SEC9", F.lit("FAIL"),
                F.format_string("%d age indicators", "n"))
    scanned = findings.select(F.count("*").alias("n")).filter("n = 0")
    unknown = _gap(scanned.select(F.lit(None).cast("long").alias("asset_id"), F.lit("").alias("name")), "SEC9",
                   F.lit("UNKNOWN"), F.lit("Nothing scanned"))
    return gaps.unionByName(unknown)


def ob_fiduciary(assets, tenants) -> DataFrame:
    """Sec 10: a data protection officer for assets of significant fiduciaries."""
    own = assets.join(tenants.filter("is_significant_data_fiduciary").select("tenant_id"), "tenant_id", "left_semi")
    ok = F.coalesce("dpo_assigned", F.lit("")) != ""
    return _gap(own, "SEC10", *_pass_if(ok, "Officer assigned", "No officer assigned"))


def ob_grievance(tenants) -> DataFrame:
    """Sec 11: a grievance contact."""
    return _gap(tenants.filter(F.coalesce("gro_email", F.lit("")) == ""), "SEC11", F.lit("FAIL"),
                F.lit("No grievance contact"), subject="tenant_id")


def ob_cross_border(assets) -> DataFrame:
    """Sec 12: data kept abroad."""
    return _gap(assets.filter(F.col("data_residency_country") != HOME_COUNTRY), "SEC12", F.lit("FAIL"),
                F.concat(F.lit("Stored in "), F.col("data_residency_country")))


def ob_retention(assets, findings, as_of: str) -> DataFrame:
    """Sec 17: overdue findings, or findings without a policy; an overdue asset is reported once."""
    late = violating_assets(findings, assets, as_of)
    none = assets.filter("retention_policy_days IS NULL").join(
        findings.select("asset_id").distinct(), "asset_id", "left_semi").join(late, "asset_id", "left_anti")
    return _gap(late, "SEC17", F.lit("FAIL"), F.lit("Findings past retention"), name="asset_name").unionByName(
        _gap(none, "SEC17", F.lit("FAIL"), F.lit("No retention policy")))


def gap_report(t, as_of: str) -> DataFrame:
    """All ten checks; `t` has the governance tables as attributes."""
    parts = [
        ob_lawful(t.assets, t.findings, t.classifications, t.consents, as_of), ob_purpose(t.assets, t.findings),
        ob_consent(t.assets, t.consents, as_of), ob_rights(t.tenants, t.data_principal_requests, as_of),
        ob_accuracy(t.assets, t.findings, t.scan_runs, as_of), ob_children(t.assets, t.findings, t.classifications),
        ob_fiduciary(t.assets, t.tenants), ob_grievance(t.tenants), ob_cross_border(t.assets),
        ob_retention(t.assets, t.findings, as_of)]
    return reduce(DataFrame.unionByName, parts)


def gap_summary(gaps: DataFrame) -> DataFrame:
    return gaps.agg(
        F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.count_if(F.col("status") == "UNKNOWN").alias("unknown"), F.count("*").alias("total"),
        F.count_distinct("subject_id").alias("subjects"))


def obligation_scorecard(gaps: DataFrame) -> DataFrame:
    """Per section: status and share of passed checks."""
    return gaps.groupBy("section").agg(
        F.count("*").alias("checks"), (F.count_if(F.col("status") == "PASS") * 100.0 / F.count("*")).alias("score"),
        F.when(F.bool_or(F.col("status") == "FAIL"), "FAIL").when(F.bool_or(F.col("status") == "UNKNOWN"), "UNKNOWN")
        .otherwise("PASS").alias("status"))


def regressions(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Types of each scan that no earlier completed scan of the tenant held.

    The first completed appearance of a type is one minimum per (tenant, type); no scan is compared with all before it.
    """
    seen = findings.select("tenant_id", "scan_run_id", "pii_type").distinct().join(
        scans.select("scan_run_id", "status", "scan_started_at"), "scan_run_id")
    first = seen.filter("status = 'completed'").groupBy("tenant_id", "pii_type").agg(
        F.min("scan_started_at").alias("first_seen"))
    return seen.join(first, ["tenant_id", "pii_type"], "left").filter(
        F.col("first_seen").isNull() | (F.col("scan_started_at") <= F.col("first_seen"))).select(
        "tenant_id", "scan_run_id", "pii_type")


# --- requests -------------------------------------------------------------------------------------------------------

def list_requests(requests: DataFrame, tenant, status: str | None = None, limit: int | None = None, offset: int = 0):
    rows = requests.filter(F.col("tenant_id") == tenant)
    if status:
        rows = rows.filter(F.col("status") == status)
    return page(rows, [F.desc("created_at"), "request_id"], limit, offset)


def dpr_stats(requests: DataFrame, as_of: str) -> DataFrame:
    """Requests per tenant and status with zeros, the overdue ones and whether the tenant is compliant."""
    late = (F.col("status") == "PENDING") & (F.col("created_at") < _at(as_of) - _days(RESPONSE_DAYS))
    per_tenant = requests.groupBy("tenant_id").agg(
        F.count_if(late).alias("overdue"),
        *[F.count_if(F.col("status") == s).alias(s) for s in REQUEST_STATUSES])
    return per_tenant.select(
        "tenant_id", "overdue", (F.col("overdue") == 0).alias("compliant"),
        F.inline(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("requests")) for s in REQUEST_STATUSES])))


def dpr_update(requests: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """Status and response of `changes` (`request_id`, `status`, `response`) applied; a final status is time-stamped."""
    new = changes.filter(F.col("status").isin(REQUEST_STATUSES)).select(
        "request_id", F.col("status").alias("_status"), F.col("response").alias("_response"))
    done = F.when(F.col("_status").isin(FINAL_STATUSES), _at(as_of))
    return requests.join(new, "request_id", "left").withColumns({
        "resolved_at": F.coalesce(done, "resolved_at"), "response": F.coalesce("_response", "response"),
        "status": F.coalesce("_status", "status")}).drop("_status", "_response")


# --- evidence -------------------------------------------------------------------------------------------------------

def evidence(t, tenant, as_of: str, limits: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """The datasets of an evidence package of one tenant, by name, whole but for sections that `limits` gives a number of rows."""
    limits = limits or {}
    mine = F.col("tenant_id") == tenant
    assets, findings = t.assets.filter(mine), t.findings.filter(mine)
    own = findings.select("finding_id")
    gaps = gap_report(TenantView(t, tenant), as_of)
    actions = t.remediation_actions.join(own, "finding_id", "left_semi")
    consents = t.consents.join(assets.select("asset_id"), "asset_id", "left_semi")
    return {
        "obligations": obligation_scorecard(gaps),
        "requests": t.data_principal_requests.filter(mine),
        "grievance_contact": t.tenants.filter(mine).select("tenant_id", "name", "gro_email"),
        "consents": page(consent_status(consents, as_of), [F.desc("consent_obtained_at"), "consent_id"], limits.get("consents")),
        "scan_history": page(t.scan_runs.join(findings.select("scan_run_id").distinct(), "scan_run_id", "left_semi"),
                             [F.desc("scan_started_at")], limits.get("scan_history")),
        "remediation": page(actions, [F.desc("executed_at"), "action_id"], limits.get("remediation")),
        "categories": findings.groupBy("pii_type").agg(
            F.count("*").alias("finding_count"), F.max("created_at").alias("last_seen")),
        "summary": gap_summary(gaps),
    }


class TenantView:
    """Governance tables of one tenant: every table that has a tenant column is filtered when it is loaded."""

    def __init__(self, tables, tenant):
        self._tables, self._tenant = tables, tenant

    def __getattr__(self, name):
        df = getattr(self._tables, name)
        if isinstance(df, DataFrame) and "tenant_id" in df.columns:
            return df.filter(F.col("tenant_id") == self._tenant)
        return df


def for_tenant(df: DataFrame, tenant) -> DataFrame:
    return df.filter(F.col("tenant_id") == tenant)


