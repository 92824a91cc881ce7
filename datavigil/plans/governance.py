"""Queries over discovery, compliance, audit and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from datavigil.operators import audit as U
from datavigil.operators import compliance as C
from datavigil.operators import discovery as V
from datavigil.operators import lineage as L
from datavigil.plans.registry import query
from datavigil.plans.views import AS_OF, EVENTS_AS_OF, SNAPSHOT_A, Tables

# --- discovery ------------------------------------------------------------------------------------------------------


@query("asset_summaries", """
SELECT a.asset_id, coalesce(i.classification, '') AS classification, coalesce(i.sensitivity, 0) AS sensitivity, coalesce(i.finding_count, 0) AS finding_count
FROM assets a LEFT JOIN inventory i USING (asset_id)""")
def asset_summaries(spark, sf):
    t = Tables(spark, sf)
    return V.asset_summaries(t.assets, t.findings).select("asset_id", "classification", "sensitivity", "finding_count")


def inventory_sql(until):
    """Inventory as of a time: the findings created before it."""
    return f"""
  SELECT a.tenant_id, a.asset_id, a.name AS asset_name, a.data_source AS source, s.classification, s.sensitivity, s.finding_count
  FROM assets a JOIN (
    SELECT asset_id, pattern_name AS classification, count(*) AS finding_count,
           max(CASE severity WHEN 'Critical' THEN 100 WHEN 'High' THEN 80 WHEN 'Medium' THEN 50 ELSE 20 END) AS sensitivity,
           row_number() OVER (PARTITION BY asset_id ORDER BY count(*) DESC, pattern_name) AS rn
    FROM findings WHERE created_at < TIMESTAMP '{until}' GROUP BY asset_id, pattern_name) s ON s.asset_id = a.asset_id AND s.rn = 1"""


def inventory_at(t, until):
    early = t.findings.filter(F.col("created_at") < F.lit(until).cast("timestamp_ntz"))
    return V.refresh_inventory(V.asset_summaries(t.assets, early))


def facts_sql(until):
    return f"""SELECT source, classification, count(DISTINCT asset_id) AS asset_count, CAST(sum(finding_count) AS BIGINT) AS finding_count,
      avg(sensitivity) AS sensitivity_avg FROM ({inventory_sql(until)}) i GROUP BY ALL"""


def facts_at(t, until):
    return V.snapshot_facts(inventory_at(t, until))


@query("inventory_refresh", f"""
SELECT coalesce(n.tenant_id, o.tenant_id) AS tenant_id, coalesce(n.asset_id, o.asset_id) AS asset_id, coalesce(n.classification, o.classification) AS classification,
  coalesce(n.finding_count, o.finding_count) AS finding_count, n.asset_id IS NOT NULL AS refreshed
FROM ({inventory_sql(SNAPSHOT_A)}) o FULL OUTER JOIN ({inventory_sql(AS_OF)}) n ON o.tenant_id = n.tenant_id AND o.asset_id = n.asset_id AND o.classification = n.classification""")
def inventory_refresh(spark, sf):
    t = Tables(spark, sf)
    old = inventory_at(t, SNAPSHOT_A).withColumn("refreshed_at", F.lit(SNAPSHOT_A))
    early = t.findings.filter(F.col("created_at") < F.lit(AS_OF).cast("timestamp_ntz"))
    new = V.asset_summaries(t.assets, early).withColumn("refreshed_at", F.lit(AS_OF))
    return V.refresh_inventory(new, old).select("tenant_id", "asset_id", "classification", "finding_count",
                                                (F.col("refreshed_at") == AS_OF).alias("refreshed"))


@query("inventory_list", """
SELECT asset_id, finding_count FROM inventory WHERE source = 'Brand#2' ORDER BY finding_count DESC, asset_id LIMIT 100""")
def inventory_list(spark, sf):
    return V.list_inventory(Tables(spark, sf).inventory, source="Brand#2", limit=100).select("asset_id", "finding_count")


@query("inventory_count", "SELECT tenant_id, count(*) AS rows FROM inventory GROUP BY 1")
def inventory_count(spark, sf):
    return V.count_inventory(Tables(spark, sf).inventory)


@query("snapshot_facts", f"SELECT * REPLACE (round(sensitivity_avg, 6) AS sensitivity_avg) FROM ({facts_sql(AS_OF)})")
def snapshot_facts(spark, sf):
    return facts_at(Tables(spark, sf), AS_OF).withColumn("sensitivity_avg", F.round("sensitivity_avg", 6))


HEADER_SQL = """SELECT {id} AS snapshot_id, TIMESTAMP '{at}' AS taken_at, 'completed' AS status, count(DISTINCT source) AS source_count, CAST(sum(asset_count) AS BIGINT) AS asset_count,
  CAST(sum(finding_count) AS BIGINT) AS finding_count, CAST(coalesce(sum(asset_count) FILTER (sensitivity_avg >= 70), 0) AS BIGINT) AS high_risk_count,
  sum(finding_count * sensitivity_avg) / sum(finding_count) AS composite_risk_score FROM ({facts}) f"""
SNAPSHOTS = ["1996-01-01", "1996-07-01", "1997-01-01", "1997-07-01", SNAPSHOT_A, AS_OF]
SNAPSHOTS_SQL = " UNION ALL ".join(HEADER_SQL.format(id=i, at=at, facts=facts_sql(at)) for i, at in enumerate(SNAPSHOTS))


def snapshots(t):
    out = None
    for i, at in enumerate(SNAPSHOTS):
        head = V.snapshot_header(facts_at(t, at)).select(
            F.lit(i).alias("snapshot_id"), F.lit(at).cast("timestamp_ntz").alias("taken_at"),
            F.lit("completed").alias("status"), "*")
        out = head if out is None else out.unionByName(head)
    return out


_HEAD_COLS = "snapshot_id, source_count, asset_count, finding_count, high_risk_count, round(composite_risk_score, 6) AS composite_risk_score"


def _head(df):
    return df.select("snapshot_id", "source_count", "asset_count", "finding_count", "high_risk_count",
                     F.round("composite_risk_score", 6).alias("composite_risk_score"))


@query("snapshot_list", f"SELECT {_HEAD_COLS} FROM ({SNAPSHOTS_SQL}) ORDER BY taken_at DESC, snapshot_id DESC LIMIT 50")
def snapshot_list(spark, sf):
    return _head(V.list_snapshots(snapshots(Tables(spark, sf)), 50))


@query("snapshot_last", f"""
SELECT {_HEAD_COLS} FROM ({SNAPSHOTS_SQL}) WHERE snapshot_id <> {len(SNAPSHOTS) - 1} ORDER BY taken_at DESC, snapshot_id DESC LIMIT 1""")
def snapshot_last(spark, sf):
    return _head(V.last_snapshot(snapshots(Tables(spark, sf)), exclude=len(SNAPSHOTS) - 1))


_DRIFT = f"""
WITH b AS ({facts_sql('{old}')}), a AS ({facts_sql('{new}')}),
j AS (SELECT coalesce(b.source, a.source) AS source, coalesce(b.classification, a.classification) AS classification, b.source IS NULL AS fresh, a.source IS NULL AS gone,
  b.finding_count AS o, a.finding_count AS n, a.asset_count AS ac, b.sensitivity_avg AS os, a.sensitivity_avg AS ns,
  CASE WHEN b.finding_count > 0 THEN (a.finding_count - b.finding_count) / b.finding_count END AS growth
  FROM b FULL OUTER JOIN a ON b.source = a.source AND b.classification = a.classification)
SELECT source, classification, 'asset_added' AS event_type, CASE WHEN ns >= 70 THEN 'high' WHEN ac > 10 THEN 'medium' ELSE 'low' END AS severity, NULL::DOUBLE AS pct_increase FROM j WHERE fresh
UNION ALL SELECT source, classification, 'asset_removed', 'medium', NULL FROM j WHERE gone
UNION ALL SELECT source, classification, 'finding_count_spike', CASE WHEN growth > 5 THEN 'critical' WHEN growth > 2 THEN 'high' ELSE 'medium' END, round(growth, 6) FROM j WHERE NOT fresh AND NOT gone AND growth > 0.5
UNION ALL SELECT source, classification, 'risk_increased', 'high', round(growth, 6) FROM j WHERE ns - os > 20
UNION ALL SELECT source, classification, 'risk_decreased', 'low', round(growth, 6) FROM j WHERE ns - os < -20"""


def _drift_sql(old, new):
    return _DRIFT.replace("{old}", old).replace("{new}", new)


def _drift(t, old, new):
    return V.drift(facts_at(t, old), facts_at(t, new))


@query("drift_events", _drift_sql("1996-01-01", AS_OF))
def drift_events(spark, sf):
    d = _drift(Tables(spark, sf), "1996-01-01", AS_OF)
    return d.select("source", "classification", "event_type", "severity", F.round("pct_increase", 6).alias("pct_increase"))


@query("drift_timeline", f"""
SELECT source, classification, event_type FROM ({_drift_sql(SNAPSHOT_A, AS_OF)}) ORDER BY event_type, source, classification LIMIT 100""")
def drift_timeline(spark, sf):
    t = Tables(spark, sf)
    events = _drift(t, "1996-01-01", SNAPSHOT_A).withColumn("detected_at", F.lit(SNAPSHOT_A).cast("timestamp_ntz")).unionByName(
        _drift(t, SNAPSHOT_A, AS_OF).withColumn("detected_at", F.lit(AS_OF).cast("timestamp_ntz")))
    return V.drift_timeline(events, 100).select("source", "classification", "event_type")


@query("drift_since", f"SELECT source, classification, event_type, severity FROM ({_drift_sql(SNAPSHOT_A, AS_OF)})")
def drift_since(spark, sf):
    t = Tables(spark, sf)
    events = _drift(t, "1996-01-01", SNAPSHOT_A).withColumn("detected_at", F.lit(SNAPSHOT_A).cast("timestamp_ntz")).unionByName(
        _drift(t, SNAPSHOT_A, AS_OF).withColumn("detected_at", F.lit(AS_OF).cast("timestamp_ntz")))
    return V.drift_since(events, SNAPSHOT_A).select("source", "classification", "event_type", "severity")


@query("classification_changes", f"""
SELECT b.source, 'classification_changed' AS event_type, b.c AS before, a.c AS after
FROM (SELECT source, string_agg(DISTINCT classification, ',' ORDER BY classification) AS c FROM ({inventory_sql('1995-03-01')}) GROUP BY 1) b
JOIN (SELECT source, string_agg(DISTINCT classification, ',' ORDER BY classification) AS c FROM ({inventory_sql(AS_OF)}) GROUP BY 1) a USING (source) WHERE b.c <> a.c""")
def classification_changes(spark, sf):
    t = Tables(spark, sf)
    d = V.classification_changes(facts_at(t, "1995-03-01"), facts_at(t, AS_OF))
    return d.withColumns({"before": F.array_join("before", ","), "after": F.array_join("after", ",")})


# Assets of one brand and size are taken together, so that a group has enough findings per scan for an average.
_SPIKE_FINDINGS = """(SELECT f.scan_run_id, (f.asset_id % 10) * 1000 + CASE WHEN f.scan_run_id = (SELECT max(scan_run_id) FROM scan_runs WHERE status = 'completed') THEN 0 ELSE f.asset_id % 7 END AS asset_id FROM findings f)"""


@query("pii_spikes", f"""
WITH cnt AS (SELECT asset_id, scan_run_id, count(*) AS n, scan_completed_at FROM {_SPIKE_FINDINGS} JOIN scan_runs USING (scan_run_id) WHERE status = 'completed' GROUP BY ALL),
last AS (SELECT scan_run_id FROM scan_runs WHERE status = 'completed' ORDER BY scan_completed_at DESC, scan_run_id DESC LIMIT 1),
s AS (SELECT asset_id, CAST(sum(n) FILTER (scan_run_id = (SELECT scan_run_id FROM last)) AS BIGINT) AS current_count,
  avg(n) FILTER (scan_completed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS rolling_average FROM cnt GROUP BY asset_id)
SELECT asset_id, current_count, round(rolling_average, 6) AS rolling_average, round(current_count / rolling_average, 6) AS ratio FROM s JOIN assets USING (asset_id)
WHERE rolling_average >= 10 AND current_count / rolling_average >= 2.5""")
def pii_spikes(spark, sf):
    t = Tables(spark, sf)
    last = t.scan_runs.filter("status = 'completed'").select(F.max("scan_run_id").alias("m")).scalar()
    group = (F.col("asset_id") % 10) * 1000 + F.when(F.col("scan_run_id") == last, 0).otherwise(F.col("asset_id") % 7)
    spikes = V.pii_spikes(t.scan_runs, t.findings.withColumn("asset_id", group), t.assets, AS_OF)
    return spikes.select("asset_id", "current_count", F.round("rolling_average", 6).alias("rolling_average"),
                         F.round("ratio", 6).alias("ratio"))


@query("composite_scores", """
SELECT asset_id, round(sum(finding_count * 1.0 + sensitivity * 2.0 + finding_count * sensitivity * 1.5), 2)::DOUBLE AS score FROM inventory GROUP BY 1""")
def composite_scores(spark, sf):
    return V.composite_score(Tables(spark, sf).inventory)


_DUE = "f.created_at + to_days(CAST(coalesce(a.retention_policy_days, 365) AS INTEGER))"
_INPUTS = f"""
  SELECT i.asset_id, count(*) FILTER (finding_count > 0) / count(*) AS pii_density,
    coalesce(avg(CASE WHEN sensitivity >= 80 THEN 1.0::DOUBLE WHEN sensitivity >= 50 THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END) FILTER (finding_count > 0), 0) AS sensitivity_weight, 0.5 AS access_exposure,
    max(CASE WHEN i.asset_id IN (SELECT f.asset_id FROM findings f JOIN assets a USING (asset_id) WHERE {_DUE} < TIMESTAMP '{AS_OF}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS retention_violation
  FROM inventory i GROUP BY i.asset_id"""
_SCORE = "round(round((pii_density * 0.35::DOUBLE + sensitivity_weight * 0.30::DOUBLE + access_exposure * 0.20::DOUBLE + retention_violation * 0.15::DOUBLE) * 10000, 6)) / 100"


def _tier(score):
    return f"CASE WHEN {score} >= 80 THEN 'Critical' WHEN {score} >= 60 THEN 'High' WHEN {score} >= 40 THEN 'Medium' ELSE 'Low' END"


def _dpdpa(t, inventory=None):
    late = C.violating_assets(t.findings, t.assets, AS_OF)
    return V.dpdpa_score(V.dpdpa_inputs(t.inventory if inventory is None else inventory, late))


@query("dpdpa_scores", f"""
SELECT asset_id, round(pii_density, 6) AS pii_density, round(sensitivity_weight, 6) AS sensitivity_weight, retention_violation, score, {_tier('score')} AS tier,
  round(round(sensitivity_weight * 0.30::DOUBLE * 10000, 6)) / 100 AS sensitivity_part FROM (SELECT *, {_SCORE} AS score FROM ({_INPUTS}) i) s""")
def dpdpa_scores(spark, sf):
    return _dpdpa(Tables(spark, sf)).select(
        "asset_id", F.round("pii_density", 6).alias("pii_density"),
        F.round("sensitivity_weight", 6).alias("sensitivity_weight"), "retention_violation", "score", "tier",
        F.col("breakdown.sensitivity_weight").alias("sensitivity_part"))


@query("rescore_scan", f"""
SELECT asset_id, {_SCORE} AS score, 199810 AS scan_run_id FROM ({_INPUTS}) i WHERE asset_id IN (SELECT asset_id FROM findings WHERE scan_run_id = 199810)""")
def rescore_scan(spark, sf):
    t = Tables(spark, sf)
    late = C.violating_assets(t.findings, t.assets, AS_OF)
    return V.rescore_scan(t.findings, 199810, t.inventory, late).select("asset_id", "score", "scan_run_id")


# A history of scores: one per asset and snapshot, from the sensitivity and size of its inventory row.
_HIST = " UNION ALL ".join(
    f"SELECT asset_id, TIMESTAMP '{at}' AS computed_at, least(100.0::DOUBLE, sensitivity * 0.5::DOUBLE + finding_count * 2) AS score FROM ({inventory_sql(at)}) i{n}"
    for n, at in enumerate(SNAPSHOTS))


def history(t):
    out = None
    for at in SNAPSHOTS:
        rows = inventory_at(t, at).select(
            "asset_id", F.lit(at).cast("timestamp_ntz").alias("computed_at"),
            F.least(F.lit(100.0), F.col("sensitivity") * 0.5 + F.col("finding_count") * 2).alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("tier", V.S.risk_tier("score"))


@query("tier_changes", f"""
WITH h AS (SELECT *, {_tier('score')} AS tier FROM ({_HIST})),
l AS (SELECT *, lag(tier) OVER w AS old_tier, lag(score) OVER w AS old_score FROM h WINDOW w AS (PARTITION BY asset_id ORDER BY computed_at)),
o AS (SELECT *, list_position(['Low','Medium','High','Critical'], tier) - list_position(['Low','Medium','High','Critical'], old_tier) AS step FROM l)
SELECT asset_id, computed_at, old_tier, tier AS new_tier, old_score, score AS new_score, CASE WHEN step > 0 THEN 'risk_increased' ELSE 'risk_decreased' END AS event_type,
  CASE WHEN tier = 'Critical' THEN 'critical' WHEN abs(step) >= 2 THEN 'high' ELSE 'medium' END AS severity FROM o WHERE old_tier <> tier""")
def tier_changes(spark, sf):
    return V.tier_changes(history(Tables(spark, sf)))


_HOT = f"""
  SELECT s.asset_id, asset_name, s.score, classification, finding_count FROM (SELECT asset_id, arg_max(score, computed_at) AS score FROM ({_HIST}) GROUP BY 1) s
  LEFT JOIN inventory USING (asset_id) ORDER BY score DESC, s.asset_id LIMIT"""


@query("risk_hotspots", f"{_HOT} 20")
def risk_hotspots(spark, sf):
    t = Tables(spark, sf)
    return V.hotspots(history(t), t.inventory, 20)


@query("discovery_overview", f"""
WITH heads AS (SELECT *, row_number() OVER (ORDER BY taken_at DESC) AS rank FROM ({SNAPSHOTS_SQL})), hot AS ({_HOT} 5)
SELECT 'header' AS section, 0 AS rank, name, round(value, 6) AS value FROM (SELECT source_count::DOUBLE AS source_count, asset_count::DOUBLE AS asset_count, finding_count::DOUBLE AS finding_count,
   high_risk_count::DOUBLE AS high_risk_count, composite_risk_score FROM heads WHERE rank = 1) UNPIVOT (value FOR name IN (source_count, asset_count, finding_count, high_risk_count, composite_risk_score))
UNION ALL SELECT 'hotspot', row_number() OVER (ORDER BY score DESC, asset_id), asset_name, score FROM hot
UNION ALL SELECT 'trend', rank, snapshot_id::VARCHAR, round(composite_risk_score, 6) FROM heads WHERE rank <= 4""")
def discovery_overview(spark, sf):
    t = Tables(spark, sf)
    return V.overview(snapshots(t), history(t), t.inventory).withColumn("value", F.round("value", 6))


# --- compliance -----------------------------------------------------------------------------------------------------

_ROLLUP = """
  SELECT a.asset_id, a.name, a.path, count(DISTINCT f.finding_id) AS finding_count, coalesce(bool_or(f.severity = 'Critical'), false) AS has_critical,
    coalesce(bool_or(c.requires_consent), false) AS requires_consent, max(CASE f.severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 END) AS worst,
    list_sort(list_distinct(list(c.sub_category) FILTER (c.sub_category IS NOT NULL))) AS types
  FROM assets a LEFT JOIN findings f USING (asset_id) LEFT JOIN classifications c USING (finding_id) GROUP BY ALL"""


def _rollup(t):
    return C.asset_rollup(t.assets, t.findings, t.classifications)


@query("compliance_overview", f"""
SELECT count(*) AS total_assets, count(*) FILTER (finding_count = 0) AS compliant_assets, count(*) FILTER (finding_count > 0) AS non_compliant_assets,
  count(*) FILTER (has_critical) AS critical_assets, count(*) FILTER (requires_consent) AS consent_assets,
  CAST(sum(CASE WHEN has_critical THEN len(list_intersect(types, ['IN_AADHAAR','IN_PAN','IN_PASSPORT','CREDIT_CARD'])) ELSE 0 END) AS BIGINT) AS critical_exposures,
  round(count(*) FILTER (finding_count = 0) * 100.0::DOUBLE / count(*), 6) AS compliance_score FROM ({_ROLLUP})""")
def compliance_overview(spark, sf):
    return C.compliance_overview(_rollup(Tables(spark, sf))).withColumn("compliance_score", F.round("compliance_score", 6))


_QUEUE = f"""
  SELECT asset_id, CASE worst WHEN 4 THEN 'Critical' WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS risk_level, array_to_string(types, ',') AS pii_types, finding_count,
    CASE WHEN has_critical THEN 'critical' ELSE 'high' END AS priority FROM ({_ROLLUP}) WHERE finding_count > 0 AND (has_critical OR requires_consent)"""


def _queue(t):
    return C.remediation_queue(_rollup(t)).withColumn("pii_types", F.array_join("pii_types", ",")).drop("name", "path")


@query("remediation_queue", _QUEUE)
def remediation_queue(spark, sf):
    return C.consent_assets(_queue(Tables(spark, sf)))


@query("critical_assets", f"SELECT * FROM ({_QUEUE}) WHERE priority = 'critical'")
def critical_assets(spark, sf):
    return C.critical_assets(_queue(Tables(spark, sf)))


@query("category_breakdown", """
SELECT classification_type, count(DISTINCT asset_id) AS assets FROM findings JOIN classifications USING (finding_id) GROUP BY 1""")
def category_breakdown(spark, sf):
    t = Tables(spark, sf)
    return C.category_breakdown(t.findings, t.classifications)


_STATUS = f"""
  SELECT *, CASE WHEN consent_withdrawn_at IS NOT NULL THEN 'WITHDRAWN' WHEN consent_expires_at < TIMESTAMP '{AS_OF}' THEN 'EXPIRED'
    WHEN consent_expires_at < TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY THEN 'EXPIRING_SOON' ELSE 'VALID' END AS status FROM consents"""


@query("consent_status", _STATUS)
def consent_status(spark, sf):
    return C.consent_status(Tables(spark, sf).consents, AS_OF)


@query("consent_current", """
SELECT asset_id % 100 AS asset_id, pii_type, arg_max(consent_id, (consent_obtained_at, consent_id)) AS consent_id FROM consents GROUP BY 1, 2""")
def consent_current(spark, sf):
    # Assets are folded, so that an (asset, type) has several consents to choose from.
    rows = Tables(spark, sf).consents.withColumn("asset_id", F.col("asset_id") % 100)
    return C.current_consent(rows).select("asset_id", "pii_type", "consent_id")


@query("consent_list", f"""
SELECT consent_id, consent_obtained_at FROM ({_STATUS}) WHERE pii_type = 'IN_PAN' AND status = 'VALID' ORDER BY consent_obtained_at DESC, consent_id LIMIT 100""")
def consent_list(spark, sf):
    return C.list_consents(Tables(spark, sf).consents, AS_OF, pii_type="IN_PAN", status="VALID", limit=100).select(
        "consent_id", "consent_obtained_at")


@query("consent_violations", f"""
SELECT f.asset_id, a.name AS asset_name, f.pii_type, count(*) AS finding_count, coalesce(c.status, 'MISSING') AS consent_status
FROM findings f JOIN assets a USING (asset_id) LEFT JOIN ({_STATUS}) c ON c.asset_id = f.asset_id AND c.pii_type = f.pii_type
WHERE c.status IS NULL OR c.status IN ('EXPIRED','WITHDRAWN') GROUP BY ALL""")
def consent_violations(spark, sf):
    t = Tables(spark, sf)
    return C.consent_violations(t.findings, t.assets, t.consents, AS_OF)


@query("consent_withdraw", f"""
SELECT consent_id, CASE WHEN pii_type = 'IN_PHONE' THEN coalesce(consent_withdrawn_at, TIMESTAMP '{AS_OF}') ELSE consent_withdrawn_at END AS consent_withdrawn_at FROM consents""")
def consent_withdraw(spark, sf):
    c = Tables(spark, sf).consents
    return C.withdraw(c, c.filter("pii_type = 'IN_PHONE'"), AS_OF).select("consent_id", "consent_withdrawn_at")


_DUE_ROWS = f"SELECT f.*, a.name AS asset_name, coalesce(a.retention_policy_days, 365) AS retention_days, {_DUE} AS deletion_due_at FROM findings f JOIN assets a USING (asset_id)"


@query("retention_violations", f"""
SELECT finding_id, asset_id, asset_name, retention_days, deletion_due_at, CAST(date_diff('day', deletion_due_at, TIMESTAMP '{AS_OF}') AS INTEGER) AS days_overdue
FROM ({_DUE_ROWS}) WHERE deletion_due_at < TIMESTAMP '{AS_OF}'""")
def retention_violations(spark, sf):
    t = Tables(spark, sf)
    return C.retention_violations(t.findings, t.assets, AS_OF).select(
        "finding_id", "asset_id", "asset_name", "retention_days", "deletion_due_at", "days_overdue")


@query("retention_expiring", f"""
SELECT finding_id, deletion_due_at FROM ({_DUE_ROWS}) WHERE deletion_due_at BETWEEN TIMESTAMP '{AS_OF}' AND TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY""")
def retention_expiring(spark, sf):
    t = Tables(spark, sf)
    return C.retention_expiring(t.findings, t.assets, AS_OF).select("finding_id", "deletion_due_at")


@query("retention_timeline", f"""
SELECT finding_id, deletion_due_at, CASE WHEN deletion_due_at < TIMESTAMP '{AS_OF}' THEN 'OVERDUE' WHEN deletion_due_at < TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY THEN 'EXPIRING_SOON'
  ELSE 'COMPLIANT' END AS status FROM ({_DUE_ROWS})""")
def retention_timeline(spark, sf):
    t = Tables(spark, sf)
    return C.retention_timeline(t.findings, t.assets, AS_OF).select("finding_id", "deletion_due_at", "status")


@query("retention_policy_set", """
SELECT asset_id, CASE WHEN data_residency_country = 'US' THEN 90 ELSE retention_policy_days END AS retention_policy_days FROM assets""")
def retention_policy_set(spark, sf):
    a = Tables(spark, sf).assets
    days = a.filter("data_residency_country = 'US'").select("asset_id", F.lit(90).alias("days"))
    return C.set_retention(a, days).select("asset_id", "retention_policy_days")


_OPEN = f"""(SELECT f.finding_id, f.asset_id FROM findings f JOIN classifications c USING (finding_id) WHERE c.requires_consent
  AND f.asset_id NOT IN (SELECT asset_id FROM ({_STATUS}) WHERE status IN ('VALID','EXPIRING_SOON')))"""
_CUT = f"TIMESTAMP '{AS_OF}'"
OBLIGATIONS = {
    "obligation_lawful": f"SELECT 'SEC4' AS section, a.asset_id::BIGINT AS subject_id, a.name AS subject, 'FAIL' AS status, count(*) || ' findings require consent, none is active' AS detail FROM {_OPEN} u JOIN assets a USING (asset_id) GROUP BY a.asset_id, a.name",
    "obligation_purpose": "SELECT 'SEC5' AS section, asset_id::BIGINT AS subject_id, name AS subject, CASE WHEN coalesce(declared_purpose, '') <> '' THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN coalesce(declared_purpose, '') <> '' THEN 'Purpose declared' ELSE 'No declared purpose' END AS detail FROM assets WHERE asset_id IN (SELECT asset_id FROM findings)",
    "obligation_consent": f"SELECT 'SEC6' AS section, a.asset_id::BIGINT AS subject_id, a.name AS subject, 'FAIL' AS status, count(*) || ' expired or withdrawn consents' AS detail FROM ({_STATUS}) s JOIN assets a USING (asset_id) WHERE s.status IN ('WITHDRAWN','EXPIRED') GROUP BY a.asset_id, a.name",
    "obligation_rights": f"SELECT 'SEC7' AS section, t.tenant_id::BIGINT AS subject_id, t.name AS subject, 'FAIL' AS status, count(*) || ' requests pending over 30 days' AS detail FROM data_principal_requests r JOIN tenants t USING (tenant_id) WHERE r.status = 'PENDING' AND r.created_at < {_CUT} - INTERVAL 30 DAY GROUP BY t.tenant_id, t.name",
    "obligation_accuracy": f"SELECT 'SEC8' AS section, a.asset_id::BIGINT AS subject_id, a.name AS subject, CASE WHEN coalesce(max(s.scan_completed_at) >= {_CUT} - INTERVAL 90 DAY, false) THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN coalesce(max(s.scan_completed_at) >= {_CUT} - INTERVAL 90 DAY, false) THEN 'Scanned within 90 days' ELSE 'Not scanned within 90 days' END AS detail FROM assets a LEFT JOIN findings f USING (asset_id) LEFT JOIN scan_runs s USING (scan_run_id) GROUP BY a.asset_id, a.name",
    "obligation_fiduciary": "SELECT 'SEC10' AS section, asset_id::BIGINT AS subject_id, a.name AS subject, CASE WHEN coalesce(dpo_assigned, '') <> '' THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN coalesce(dpo_assigned, '') <> '' THEN 'Officer assigned' ELSE 'No officer assigned' END AS detail FROM assets a JOIN tenants t USING (tenant_id) WHERE t.is_significant_data_fiduciary",
    "obligation_grievance": "SELECT 'SEC11' AS section, tenant_id::BIGINT AS subject_id, name AS subject, 'FAIL' AS status, 'No grievance contact' AS detail FROM tenants WHERE coalesce(gro_email, '') = ''",
    "obligation_cross_border": "SELECT 'SEC12' AS section, asset_id::BIGINT AS subject_id, name AS subject, 'FAIL' AS status, 'Stored in ' || data_residency_country AS detail FROM assets WHERE data_residency_country <> 'IN'",
    "obligation_retention": f"SELECT 'SEC17' AS section, asset_id::BIGINT AS subject_id, name AS subject, 'FAIL' AS status, CASE WHEN late THEN 'Findings past retention' ELSE 'No retention policy' END AS detail FROM (SELECT a.asset_id, a.name, bool_or({_DUE} < {_CUT}) AS late, bool_or(a.retention_policy_days IS NULL) AS none FROM findings f JOIN assets a USING (asset_id) GROUP BY a.asset_id, a.name) WHERE late OR none",
}


@query("obligation_lawful", OBLIGATIONS["obligation_lawful"])
def obligation_lawful(spark, sf):
    t = Tables(spark, sf)
    return C.ob_lawful(t.assets, t.findings, t.classifications, t.consents, AS_OF)


@query("obligation_lawful_evidence", f"SELECT * FROM {_OPEN} u")
def obligation_lawful_evidence(spark, sf):
    t = Tables(spark, sf)
    return C.unconsented(t.findings, t.classifications, t.consents, AS_OF)


@query("obligation_purpose", OBLIGATIONS["obligation_purpose"])
def obligation_purpose(spark, sf):
    t = Tables(spark, sf)
    return C.ob_purpose(t.assets, t.findings)


@query("obligation_consent", OBLIGATIONS["obligation_consent"])
def obligation_consent(spark, sf):
    t = Tables(spark, sf)
    return C.ob_consent(t.assets, t.consents, AS_OF)


@query("obligation_rights", OBLIGATIONS["obligation_rights"])
def obligation_rights(spark, sf):
    t = Tables(spark, sf)
    return C.ob_rights(t.tenants, t.data_principal_requests, AS_OF)


@query("obligation_accuracy", OBLIGATIONS["obligation_accuracy"])
def obligation_accuracy(spark, sf):
    t = Tables(spark, sf)
    return C.ob_accuracy(t.assets, t.findings, t.scan_runs, AS_OF)


# The given types hold no age or birth date, so the words of this check are set to types that occur.
@query("obligation_children", """
SELECT 'SEC9' AS section, a.asset_id::BIGINT AS subject_id, a.name AS subject, 'FAIL' AS status, count(*) || ' age indicators' AS detail
FROM findings f JOIN classifications c USING (finding_id) JOIN assets a USING (asset_id) WHERE c.sub_category ILIKE '%license%' OR c.sub_category ILIKE '%voter%' GROUP BY a.asset_id, a.name""")
def obligation_children(spark, sf):
    t = Tables(spark, sf)
    return C.ob_children(t.assets, t.findings, t.classifications, ["license", "voter"])


# Some types stand for an age indicator, by name or by category, so that the words and the category of the check are met.
_AGED = """CASE pii_type WHEN 'IN_DRIVING_LICENSE' THEN 'holder Date_Of_Birth' WHEN 'IN_VOTER_ID' THEN 'votersAge' ELSE 'x' END"""


@query("obligation_children_indicators", """
SELECT 'SEC9' AS section, a.asset_id::BIGINT AS subject_id, a.name AS subject, 'FAIL' AS status, count(*) || ' age indicators' AS detail
FROM findings f JOIN classifications c USING (finding_id) JOIN assets a USING (asset_id) WHERE c.sub_category IN ('IN_DRIVING_LICENSE', 'IN_VOTER_ID', 'IN_PASSPORT') GROUP BY a.asset_id, a.name""")
def obligation_children_indicators(spark, sf):
    t = Tables(spark, sf)
    told = t.classifications.withColumn("pii_type", F.col("sub_category")).withColumns({
        "sub_category": F.expr(_AGED), "dpdpa_category": F.when(F.col("pii_type") == "IN_PASSPORT", "AGE_INDICATOR")})
    return C.ob_children(t.assets, t.findings, told)


@query("obligation_children_unknown", "SELECT 'SEC9' AS section, NULL::BIGINT AS subject_id, '' AS subject, 'UNKNOWN' AS status, 'Nothing scanned' AS detail WHERE (SELECT count(*) FROM findings WHERE severity = 'None') = 0")
def obligation_children_unknown(spark, sf):
    t = Tables(spark, sf)
    return C.ob_children(t.assets, t.findings.filter("severity = 'None'"), t.classifications)


@query("obligation_fiduciary", OBLIGATIONS["obligation_fiduciary"])
def obligation_fiduciary(spark, sf):
    t = Tables(spark, sf)
    return C.ob_fiduciary(t.assets, t.tenants)


@query("obligation_grievance", OBLIGATIONS["obligation_grievance"])
def obligation_grievance(spark, sf):
    return C.ob_grievance(Tables(spark, sf).tenants)


@query("obligation_cross_border", OBLIGATIONS["obligation_cross_border"])
def obligation_cross_border(spark, sf):
    return C.ob_cross_border(Tables(spark, sf).assets)


@query("obligation_retention", OBLIGATIONS["obligation_retention"])
def obligation_retention(spark, sf):
    t = Tables(spark, sf)
    return C.ob_retention(t.assets, t.findings, AS_OF)


_GAPS = " UNION ALL ".join(f"SELECT * FROM ({s}) g{i}" for i, s in enumerate(OBLIGATIONS.values()))


@query("gap_report", f"""
SELECT section, count(*) AS checks, count(*) FILTER (status = 'PASS') * 100.0::DOUBLE / count(*) AS score, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' ELSE 'PASS' END AS status FROM ({_GAPS}) GROUP BY 1""")
def gap_report(spark, sf):
    return C.obligation_scorecard(C.gap_report(Tables(spark, sf), AS_OF))


@query("gap_summary", f"""
SELECT count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'UNKNOWN') AS unknown, count(*) AS total,
  count(DISTINCT subject_id) AS subjects FROM ({_GAPS})""")
def gap_summary(spark, sf):
    return C.gap_summary(C.gap_report(Tables(spark, sf), AS_OF))


@query("obligation_regressions", """
WITH seen AS (SELECT DISTINCT f.tenant_id, f.scan_run_id, f.pii_type, s.scan_started_at, s.status FROM findings f JOIN scan_runs s USING (scan_run_id))
SELECT tenant_id, scan_run_id, pii_type FROM seen a WHERE NOT EXISTS (SELECT 1 FROM seen b WHERE b.tenant_id = a.tenant_id AND b.pii_type = a.pii_type AND b.status = 'completed'
  AND b.scan_started_at < a.scan_started_at)""")
def obligation_regressions(spark, sf):
    t = Tables(spark, sf)
    return C.regressions(t.findings, t.scan_runs)


_LATE = f"count(*) FILTER (status = 'PENDING' AND created_at < {_CUT} - INTERVAL 30 DAY)"


@query("request_stats", f"""
WITH s AS (SELECT unnest(['PENDING','IN_PROGRESS','COMPLETED','REJECTED']) AS status), o AS (SELECT tenant_id, {_LATE} AS overdue FROM data_principal_requests GROUP BY 1)
SELECT o.tenant_id, o.overdue, o.overdue = 0 AS compliant, s.status, (SELECT count(*) FROM data_principal_requests r WHERE r.tenant_id = o.tenant_id AND r.status = s.status) AS requests FROM o CROSS JOIN s""")
def request_stats(spark, sf):
    return C.dpr_stats(Tables(spark, sf).data_principal_requests, AS_OF)


@query("request_list", """
SELECT request_id, created_at FROM data_principal_requests WHERE tenant_id = 2 AND status = 'IN_PROGRESS' ORDER BY created_at DESC, request_id LIMIT 50""")
def request_list(spark, sf):
    return C.list_requests(Tables(spark, sf).data_principal_requests, 2, "IN_PROGRESS", 50).select("request_id", "created_at")


@query("request_update", f"""
SELECT request_id, CASE WHEN request_type = 'ERASURE' THEN 'COMPLETED' WHEN request_type = 'ACCESS' THEN 'IN_PROGRESS' ELSE status END AS status,
  CASE WHEN request_type = 'ERASURE' THEN {_CUT} END AS resolved_at FROM data_principal_requests""")
def request_update(spark, sf):
    r = Tables(spark, sf).data_principal_requests.withColumns({
        "resolved_at": F.lit(None).cast("timestamp_ntz"), "response": F.lit(None).cast("string")})
    changes = r.filter("request_type IN ('ERASURE', 'ACCESS', 'GRIEVANCE')").select(
        "request_id", F.expr("CASE request_type WHEN 'ERASURE' THEN 'COMPLETED' WHEN 'ACCESS' THEN 'IN_PROGRESS' ELSE"
                             " 'NO_SUCH_STATUS' END").alias("status"), F.lit("done").alias("response"))
    return C.dpr_update(r, changes, AS_OF).select("request_id", "status", "resolved_at")


_TENANT_SCANS = "SELECT scan_run_id FROM findings WHERE tenant_id = 1"


@query("evidence_categories", "SELECT pii_type, count(*) AS finding_count, max(created_at) AS last_seen FROM findings WHERE tenant_id = 1 GROUP BY 1")
def evidence_categories(spark, sf):
    return C.evidence(Tables(spark, sf), 1, AS_OF)["categories"]


_OWN_GAPS = f"""SELECT * FROM ({_GAPS}) g WHERE CASE WHEN section IN ('SEC7', 'SEC11') THEN subject_id = 1 ELSE subject_id IN (SELECT asset_id FROM assets WHERE tenant_id = 1) END"""


@query("evidence_obligations", f"""
SELECT section, count(*) AS checks, count(*) FILTER (status = 'PASS') * 100.0::DOUBLE / count(*) AS score, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' ELSE 'PASS' END AS status FROM ({_OWN_GAPS}) GROUP BY 1""")
def evidence_obligations(spark, sf):
    return C.evidence(Tables(spark, sf), 1, AS_OF)["obligations"]


@query("evidence_summary", f"""
SELECT count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'UNKNOWN') AS unknown, count(*) AS total,
  count(DISTINCT subject_id) AS subjects FROM ({_OWN_GAPS})""")
def evidence_summary(spark, sf):
    return C.evidence(Tables(spark, sf), 1, AS_OF)["summary"]


@query("evidence_requests", "SELECT request_id, status FROM data_principal_requests WHERE tenant_id = 1")
def evidence_requests(spark, sf):
    return C.evidence(Tables(spark, sf), 1, AS_OF)["requests"].select("request_id", "status")


@query("evidence_grievance_contact", "SELECT tenant_id, name, gro_email FROM tenants WHERE tenant_id = 1")
def evidence_grievance_contact(spark, sf):
    return C.evidence(Tables(spark, sf), 1, AS_OF)["grievance_contact"]


@query("evidence_consents", f"""
SELECT consent_id, status FROM ({_STATUS}) WHERE asset_id IN (SELECT asset_id FROM assets WHERE tenant_id = 1) ORDER BY consent_obtained_at DESC, consent_id LIMIT 10000""")
def evidence_consents(spark, sf):
    return C.evidence(Tables(spark, sf), 1, AS_OF, {"consents": 10000})["consents"].select("consent_id", "status")


@query("evidence_consents_all", f"""
SELECT consent_id, status FROM ({_STATUS}) WHERE asset_id IN (SELECT asset_id FROM assets WHERE tenant_id = 1)""")
def evidence_consents_all(spark, sf):
    return C.evidence(Tables(spark, sf), 1, AS_OF)["consents"].select("consent_id", "status")


@query("evidence_scan_history", f"SELECT * FROM scan_runs WHERE scan_run_id IN ({_TENANT_SCANS}) ORDER BY scan_started_at DESC LIMIT 100")
def evidence_scan_history(spark, sf):
    return C.evidence(Tables(spark, sf), 1, AS_OF, {"scan_history": 100})["scan_history"]


@query("evidence_scan_history_all", f"SELECT * FROM scan_runs WHERE scan_run_id IN ({_TENANT_SCANS})")
def evidence_scan_history_all(spark, sf):
    return C.evidence(Tables(spark, sf), 1, AS_OF)["scan_history"]


@query("evidence_remediation", """
SELECT action_id, status FROM remediation_actions WHERE finding_id IN (SELECT finding_id FROM findings WHERE tenant_id = 1) ORDER BY executed_at DESC, action_id LIMIT 1000""")
def evidence_remediation(spark, sf):
    return C.evidence(Tables(spark, sf), 1, AS_OF, {"remediation": 1000})["remediation"].select("action_id", "status")


@query("evidence_remediation_all", """
SELECT action_id, status FROM remediation_actions WHERE finding_id IN (SELECT finding_id FROM findings WHERE tenant_id = 1)""")
def evidence_remediation_all(spark, sf):
    return C.evidence(Tables(spark, sf), 1, AS_OF)["remediation"].select("action_id", "status")


# --- audit ----------------------------------------------------------------------------------------------------------


@query("audit_list", """
SELECT event_id, action FROM audit_events WHERE action = 'click' AND event_time >= TIMESTAMP '2024-01-05' AND event_time <= TIMESTAMP '2024-01-20' ORDER BY event_time DESC, event_id DESC LIMIT 100 OFFSET 10""")
def audit_list(spark, sf):
    return U.audit_logs(Tables(spark, sf).audit_events, action="click", since="2024-01-05", until="2024-01-20",
                        limit=100, offset=10).select("event_id", "action")


@query("audit_ledger", """
SELECT event_id FROM audit_events WHERE tenant_id = 1 AND action IN ('error','purchase') AND event_time >= TIMESTAMP '2024-01-10' ORDER BY event_time DESC, event_id DESC LIMIT 100""")
def audit_ledger(spark, sf):
    return U.audit_logs(Tables(spark, sf).audit_events, tenant=1, actions=["error", "purchase"],
                        since="2024-01-10", limit=100).select("event_id")


@query("audit_user_activity", """
SELECT user_id, count(*) AS action_count, max(event_time) AS last_action, string_agg(DISTINCT action, ',' ORDER BY action) AS actions FROM audit_events GROUP BY 1""")
def audit_user_activity(spark, sf):
    return U.user_activity(Tables(spark, sf).audit_events).withColumn("actions", F.array_join("actions", ","))


@query("audit_resource_history", "SELECT event_id, event_time FROM audit_events WHERE resource_type = 'asset' AND resource_id = '42'")
def audit_resource_history(spark, sf):
    return U.resource_history(Tables(spark, sf).audit_events, "asset", "42").select("event_id", "event_time")


@query("audit_recent", "SELECT event_id FROM audit_events ORDER BY event_time DESC, event_id DESC LIMIT 50")
def audit_recent(spark, sf):
    return U.recent(Tables(spark, sf).audit_events, 50).select("event_id")


@query("audit_active_users", f"SELECT count(DISTINCT user_id) AS active_users FROM audit_events WHERE event_time >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY")
def audit_active_users(spark, sf):
    return U.active_users(Tables(spark, sf).audit_events, "2024-01-24")


_CHAIN = """
WITH RECURSIVE e AS (SELECT tenant_id, strftime(event_time, '%Y-%m-%d 00:00') AS segment, event_id,
    row_number() OVER (PARTITION BY tenant_id, strftime(event_time, '%Y-%m-%d 00:00') ORDER BY event_time, event_id) AS seq,
    '|' || action || '|' || resource_type || '|' || resource_id || '|' || metadata || '|' || strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') AS body FROM audit_events),
c AS (SELECT tenant_id, segment, event_id, seq, 'genesis' AS previous_hash, sha256('genesis' || body) AS entry_hash FROM e WHERE seq = 1
  UNION ALL SELECT e.tenant_id, e.segment, e.event_id, e.seq, c.entry_hash, sha256(c.entry_hash || e.body) FROM c JOIN e ON e.tenant_id = c.tenant_id AND e.segment = c.segment AND e.seq = c.seq + 1)"""


@query("audit_chain", f"{_CHAIN} SELECT tenant_id, segment, event_id, seq, previous_hash, entry_hash FROM c")
def audit_chain(spark, sf):
    return U.build_chain(Tables(spark, sf).audit_events)


@query("audit_chain_seal", f"""{_CHAIN}, h AS (SELECT tenant_id, segment, arg_max(entry_hash, seq) AS entry_hash, max(seq) AS entries FROM c GROUP BY ALL)
SELECT tenant_id, count(*) AS segments, CAST(sum(entries) AS BIGINT) AS entries, sha256(string_agg(segment || ':' || entry_hash || ':' || entries, '|' ORDER BY segment)) AS seal FROM h GROUP BY 1""")
def audit_chain_seal(spark, sf):
    return U.seal_chain(U.build_chain(Tables(spark, sf).audit_events))


@query("audit_chain_verify", """
SELECT tenant_id, event_id, event_id % 1000 <> 17 AS hash_ok, true AS link_ok FROM audit_events""")
def audit_chain_verify(spark, sf):
    # Some events are altered after the chain was built; verification must name exactly those.
    events = Tables(spark, sf).audit_events
    altered = events.withColumn("action", F.when(F.col("event_id") % 1000 == 17, "forged").otherwise(F.col("action")))
    return U.verify_chain(U.build_chain(events), altered).select("tenant_id", "event_id", "hash_ok", "link_ok")


_BATCHES = {"2024-a": "event_time < TIMESTAMP '2024-01-16'", "2024-b": "event_time >= TIMESTAMP '2024-01-16'"}


def _appended(events):
    """One chain per tenant, written in two batches."""
    chain = None
    for name, when in _BATCHES.items():
        heads = events.sparkSession.createDataFrame([], "tenant_id long, entry_hash string, last_seq long") if chain is None \
            else U.tenant_heads(chain)
        part = U.build_chain(events.filter(when), heads=heads, batch=name)
        chain = part if chain is None else chain.unionByName(part)
    return chain


@query("audit_chain_appended", f"""
WITH RECURSIVE e AS (SELECT tenant_id, CASE WHEN {_BATCHES['2024-a']} THEN '2024-a' ELSE '2024-b' END AS segment, event_id,
    row_number() OVER (PARTITION BY tenant_id ORDER BY event_time, event_id) AS seq,
    '|' || action || '|' || resource_type || '|' || resource_id || '|' || metadata || '|' || strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') AS body FROM audit_events),
c AS (SELECT tenant_id, segment, event_id, seq, 'genesis' AS previous_hash, sha256('genesis' || body) AS entry_hash FROM e WHERE seq = 1
  UNION ALL SELECT e.tenant_id, e.segment, e.event_id, e.seq, c.entry_hash, sha256(c.entry_hash || e.body) FROM c JOIN e ON e.tenant_id = c.tenant_id AND e.seq = c.seq + 1)
SELECT tenant_id, segment, event_id, seq, previous_hash, entry_hash FROM c""")
def audit_chain_appended(spark, sf):
    return _appended(Tables(spark, sf).audit_events)


@query("audit_chain_appended_verify", """
SELECT tenant_id, event_id, event_id % 1000 <> 17 AS hash_ok, coalesce(before % 1000 <> 500, true) AS link_ok
FROM (SELECT tenant_id, event_id, lag(event_id) OVER (PARTITION BY tenant_id ORDER BY event_time, event_id) AS before FROM audit_events)
WHERE event_id % 1000 <> 500""")
def audit_chain_appended_verify(spark, sf):
    # Some events are altered and some entries dropped after the chain was built.
    events = Tables(spark, sf).audit_events
    altered = events.withColumn("action", F.when(F.col("event_id") % 1000 == 17, "forged").otherwise(F.col("action")))
    return U.verify_chain(_appended(events).filter("event_id % 1000 <> 500"), altered).select("tenant_id", "event_id", "hash_ok", "link_ok")


# --- lineage --------------------------------------------------------------------------------------------------------

_EXPOSURE = """
  SELECT f.asset_id, c.sub_category AS pii_type, count(*) AS finding_count, CAST(sum(CAST(c.confidence_score AS DECIMAL(18,9))) AS DOUBLE) / count(*) AS avg_confidence, max(c.confidence_score) AS max_confidence,
    count(DISTINCT f.pattern_name) AS pattern_diversity, count(*) FILTER (f.severity = 'Critical') AS critical, count(*) FILTER (f.severity = 'High') AS high,
    count(*) FILTER (f.severity = 'Medium') AS medium, count(*) FILTER (f.severity = 'Low') AS low
  FROM findings f JOIN classifications c USING (finding_id) WHERE c.confidence_score >= 0.45 GROUP BY ALL"""
_RISK_OF = "CASE " + " ".join(f"WHEN pii_type = '{t}' THEN {r}" for t, r in L.BASE_RISK.items()) + " ELSE 1 END"
_EXPOSED = f"""
  SELECT *, CASE WHEN moved >= 3 THEN 'Critical' WHEN moved = 2 THEN 'High' WHEN moved = 1 THEN 'Medium' ELSE 'Low' END AS risk_level
  FROM (SELECT *, {_RISK_OF} + CASE WHEN round(avg_confidence, 9) < 0.65::DOUBLE THEN -1 WHEN round(avg_confidence, 9) > 0.85::DOUBLE THEN 1 ELSE 0 END AS moved FROM ({_EXPOSURE}))"""


def _exposure(t):
    return L.exposure_aggregate(t.findings, t.classifications)


@query("exposure_aggregate", f"""
SELECT asset_id, pii_type, finding_count, round(avg_confidence, 6) AS avg_confidence, max_confidence, pattern_diversity, critical, high, medium, low, risk_level FROM ({_EXPOSED})""")
def exposure_aggregate(spark, sf):
    return _exposure(Tables(spark, sf)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("lineage_nodes", f"""
SELECT DISTINCT 'system-' || host AS id, 'system' AS type, host AS label, 0::BIGINT AS finding_count FROM assets
UNION ALL SELECT asset_id::VARCHAR, 'asset', name, 0 FROM assets
UNION ALL SELECT pii_type, 'pii_category', pii_type, CAST(sum(finding_count) AS BIGINT) FROM ({_EXPOSURE}) GROUP BY pii_type""")
def lineage_nodes(spark, sf):
    t = Tables(spark, sf)
    return L.lineage_nodes(t.assets, _exposure(t))


@query("lineage_edges", f"""
SELECT 'system-' || host AS source, asset_id::VARCHAR AS target, 'SYSTEM_OWNS_ASSET' AS type, NULL::BIGINT AS finding_count FROM assets
UNION ALL SELECT asset_id::VARCHAR, pii_type, 'EXPOSES', finding_count FROM ({_EXPOSURE})""")
def lineage_edges(spark, sf):
    t = Tables(spark, sf)
    return L.lineage_edges(t.assets, _exposure(t))


_CLOSED = """(SELECT DISTINCT f.asset_id, f.pii_type, r.executed_at + INTERVAL 1 DAY AS closed_at FROM remediation_actions r JOIN findings f USING (finding_id) WHERE r.status = 'COMPLETED')"""
_WINDOWS = f"""
  SELECT asset_id, pii_type, min(seen_at) FILTER (closes = 0) AS since, max(seen_at) FILTER (closes = 1) AS until, min(scan_run_id) FILTER (closes = 0) AS first_scan_id,
    max(scan_run_id) FILTER (closes = 0) AS last_scan_id, CAST(sum(n) AS BIGINT) AS finding_count
  FROM (SELECT *, coalesce(sum(closes) OVER (PARTITION BY asset_id, pii_type ORDER BY seen_at, closes, scan_run_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w
    FROM (SELECT asset_id, pii_type, scan_run_id, min(created_at) AS seen_at, count(*) AS n, 0 AS closes FROM findings GROUP BY ALL
          UNION ALL SELECT asset_id, pii_type, NULL, closed_at, NULL, 1 FROM {_CLOSED}) e) g
  GROUP BY asset_id, pii_type, w HAVING min(seen_at) FILTER (closes = 0) IS NOT NULL"""


def windows(t):
    done = t.remediation_actions.filter("status = 'COMPLETED'").join(
        t.findings.select("finding_id", "asset_id", "pii_type"), "finding_id")
    closures = done.select("asset_id", "pii_type", (F.col("executed_at") + F.make_interval(days=F.lit(1))).alias("closed_at"))
    return L.exposure_windows(t.findings, closures)


@query("exposure_windows", f"SELECT *, date_diff('hour', since, until) AS duration_hours FROM ({_WINDOWS})")
def exposure_windows(spark, sf):
    return windows(Tables(spark, sf))


@query("exposure_windows_by_scan", """
WITH runs AS (SELECT scan_run_id, lead(scan_run_id) OVER w AS next_run, lead(scan_started_at) OVER w AS closed_at FROM scan_runs WINDOW w AS (ORDER BY scan_started_at, scan_run_id)),
p AS (SELECT DISTINCT asset_id, pii_type, scan_run_id FROM findings)
SELECT p.asset_id, p.pii_type, r.closed_at FROM p JOIN runs r USING (scan_run_id) WHERE r.next_run IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM p q WHERE q.asset_id = p.asset_id AND q.pii_type = p.pii_type AND q.scan_run_id = r.next_run)""")
def exposure_windows_by_scan(spark, sf):
    t = Tables(spark, sf)
    return L.absence_closures(t.findings, t.scan_runs)


@query("exposures_at", f"""
SELECT asset_id, pii_type, since FROM ({_WINDOWS}) WHERE since <= TIMESTAMP '1997-06-15' AND (until IS NULL OR until > TIMESTAMP '1997-06-15')""")
def exposures_at(spark, sf):
    return L.exposures_at(windows(Tables(spark, sf)), "1997-06-15").select("asset_id", "pii_type", "since")


@query("exposures_at_scans", f"""
SELECT s.scan_run_id, w.pii_type, count(*) AS exposures FROM scan_runs s JOIN ({_WINDOWS}) w ON w.since <= s.scan_completed_at AND (w.until IS NULL OR w.until > s.scan_completed_at) GROUP BY ALL""")
def exposures_at_scans(spark, sf):
    t = Tables(spark, sf)
    times = t.scan_runs.select("scan_run_id", F.col("scan_completed_at").alias("at"))
    return L.exposures_at_times(windows(t), times, "2002-01-01").groupBy("scan_run_id", "pii_type").agg(
        F.count("*").alias("exposures"))


@query("exposures_active", f"SELECT asset_id, pii_type, since, finding_count FROM ({_WINDOWS}) WHERE until IS NULL")
def exposures_active(spark, sf):
    return L.active_exposures(windows(Tables(spark, sf))).select("asset_id", "pii_type", "since", "finding_count")


@query("exposure_history", f"""
SELECT pii_type, since, until, until IS NULL AS is_active FROM ({_WINDOWS}) WHERE asset_id = 5 ORDER BY since DESC, pii_type LIMIT 1000""")
def exposure_history(spark, sf):
    return L.exposure_history(windows(Tables(spark, sf)), 5, 1000).select("pii_type", "since", "until", "is_active")


@query("exposure_duration", f"""
SELECT asset_id, pii_type, CAST(sum(date_diff('hour', since, least(coalesce(until, {_CUT}), {_CUT}))) AS BIGINT) AS hours, count(*) AS windows FROM ({_WINDOWS}) WHERE since <= {_CUT} GROUP BY ALL""")
def exposure_duration(spark, sf):
    return L.exposure_duration(windows(Tables(spark, sf)), AS_OF)


@query("compliant_assets_at", f"""
SELECT asset_id FROM assets WHERE asset_id NOT IN (SELECT asset_id FROM ({_WINDOWS}) WHERE since <= TIMESTAMP '1995-02-20' AND (until IS NULL OR until > TIMESTAMP '1995-02-20'))""")
def compliant_assets_at(spark, sf):
    t = Tables(spark, sf)
    return L.was_compliant_at(t.assets, windows(t), "1995-02-20").select("asset_id")


@query("exposure_timeline", f"""
SELECT asset_id, pii_type, since AS event_time, 'EXPOSURE_STARTED' AS event_type FROM ({_WINDOWS}) UNION ALL SELECT asset_id, pii_type, until, 'EXPOSURE_ENDED' FROM ({_WINDOWS}) WHERE until IS NOT NULL""")
def exposure_timeline(spark, sf):
    return L.exposure_timeline(windows(Tables(spark, sf)))


@query("lineage_graph", f"""
WITH e AS (SELECT * FROM ({_EXPOSED}) WHERE risk_level = 'High' AND (asset_id, pii_type) IN (SELECT (asset_id, pii_type) FROM ({_WINDOWS}) WHERE until IS NULL)),
r AS (SELECT a.host, a.asset_id, a.name AS asset_name, e.pii_type, e.finding_count, e.risk_level FROM assets a LEFT JOIN e USING (asset_id) WHERE a.host = 'host-3')
SELECT r.*, CASE WHEN pii_type IS NOT NULL THEN CAST(sum(finding_count) OVER (PARTITION BY pii_type) AS BIGINT) END AS category_total FROM r""")
def lineage_graph(spark, sf):
    t = Tables(spark, sf)
    return L.lineage_graph(t.assets, _exposure(t), "host-3", "High", windows(t))


@query("category_impact", f"""
SELECT pii_type, CAST(sum(finding_count) AS BIGINT) AS total_findings, count(DISTINCT asset_id) AS affected_assets, count(DISTINCT host) AS affected_systems FROM ({_EXPOSURE}) JOIN assets USING (asset_id) GROUP BY 1""")
def category_impact(spark, sf):
    t = Tables(spark, sf)
    return L.category_impact(t.assets, _exposure(t))


@query("lineage_paths", """
SELECT a.host, f.asset_id, a.name AS asset_name, f.finding_id, f.severity, c.classification_type, c.sub_category
FROM findings f LEFT JOIN classifications c USING (finding_id) LEFT JOIN assets a USING (asset_id) WHERE coalesce(c.classification_type, '') <> 'Non-PII'""")
def lineage_paths(spark, sf):
    t = Tables(spark, sf)
    return L.lineage_paths(t.assets, t.findings, t.classifications)


@query("lineage_cycles", """
WITH RECURSIVE e AS (SELECT source_asset_id AS s, target_asset_id AS d FROM asset_relationships WHERE source_asset_id <> target_asset_id),
p AS (SELECT s, d, [s, d] AS path FROM e WHERE d > s UNION ALL SELECT p.s, e.d, list_append(path, e.d) FROM p JOIN e ON e.s = p.d WHERE len(path) <= 9 AND e.d > p.s AND NOT list_contains(path, e.d)),
c AS (SELECT path FROM p JOIN e ON e.s = p.d AND e.d = p.s)
SELECT array_to_string(path, '>') AS cycle, len(path)::INTEGER AS length FROM c ORDER BY len(path), path LIMIT 20""")
def lineage_cycles(spark, sf):
    found = L.find_cycles(Tables(spark, sf).asset_relationships, limit=20)
    return found.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("cycle"), "length")


@query("lineage_cycles_all", """
WITH RECURSIVE e AS (SELECT source_asset_id AS s, target_asset_id AS d FROM asset_relationships WHERE source_asset_id <> target_asset_id),
p AS (SELECT s, d, [s, d] AS path FROM e WHERE d > s UNION ALL SELECT p.s, e.d, list_append(path, e.d) FROM p JOIN e ON e.s = p.d WHERE len(path) <= 9 AND e.d > p.s AND NOT list_contains(path, e.d)),
c AS (SELECT path FROM p JOIN e ON e.s = p.d AND e.d = p.s)
SELECT array_to_string(path, '>') AS cycle, len(path)::INTEGER AS length FROM c""")
def lineage_cycles_all(spark, sf):
    found = L.find_cycles(Tables(spark, sf).asset_relationships)
    return found.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("cycle"), "length")


@query("orphan_assets", """
SELECT asset_id, max(created_at) AS last_finding_at, coalesce(max(created_at) < TIMESTAMP '2001-12-01' - INTERVAL 90 DAY, true) AS is_orphan,
  CASE WHEN coalesce(max(created_at) < TIMESTAMP '2001-12-01' - INTERVAL 90 DAY, true) THEN 10 ELSE 0 END AS orphan_risk_bonus FROM assets LEFT JOIN findings USING (asset_id) GROUP BY 1""")
def orphan_assets(spark, sf):
    t = Tables(spark, sf)
    return L.orphan_assets(t.assets, t.findings, "2001-12-01")
