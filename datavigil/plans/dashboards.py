"""Queries over findings lists, dashboards, ingestion and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from datavigil.functions import masking as M
from datavigil.functions import patterns as P
from datavigil.functions import scoring as S
from datavigil.functions import similarity as Y
from datavigil.functions import text as T
from datavigil.operators import analytics as A
from datavigil.operators import detect as D
from datavigil.operators import feedback as B
from datavigil.operators import findings as Q
from datavigil.operators import ingest as I
from datavigil.plans.detection import entropy_sql, findings_sql
from datavigil.plans.registry import query
from datavigil.plans.scores import (
    CLASS, LENIENT_SQL, RULE, SECRET, case_sql, diversity_sql, env_score_sql, map_sql, word_sql,
)
from datavigil.plans.views import AS_OF, Tables
from datavigil.session import staged

# --- lists ----------------------------------------------------------------------------------------------------------

_KEEP = "NOT EXISTS (SELECT 1 FROM classifications c WHERE c.finding_id = f.finding_id AND c.classification_type = 'Non-PII')"
_LIST_FILTERS = Q.Filters(severity="Critical,High", search="card", review_status="Active")
_LIST_SQL = f"""
  FROM findings f LEFT JOIN assets a USING (asset_id) LEFT JOIN review_states r USING (finding_id)
  WHERE f.tenant_id = 1 AND {_KEEP} AND f.severity IN ('Critical','High')
    AND (a.name ILIKE '%card%' OR a.path ILIKE '%card%' OR f.pattern_name ILIKE '%card%') AND (r.status IS NULL OR r.status = 'pending')"""


def _list_args(t):
    return t.findings, t.classifications, t.assets, t.review_states, 1


@query("findings_list", f"""
SELECT f.finding_id, f.severity, f.pattern_name, a.name AS asset_name, f.created_at, f.confidence_score {_LIST_SQL}
ORDER BY f.confidence_score DESC, f.finding_id LIMIT 50 OFFSET 20""")
def findings_list(spark, sf):
    rows = Q.list_findings(*_list_args(Tables(spark, sf)), _LIST_FILTERS, sort_by="confidence", limit=50, offset=20)
    return rows.select("finding_id", "severity", "pattern_name", "asset_name", "created_at", "confidence_score")


@query("findings_count", f"SELECT count(DISTINCT f.finding_id) AS total {_LIST_SQL}")
def findings_count(spark, sf):
    return Q.count_findings(*_list_args(Tables(spark, sf)), _LIST_FILTERS)


@query("findings_suppressed", f"""
SELECT f.finding_id, f.asset_id FROM findings f JOIN review_states r USING (finding_id) JOIN assets a USING (asset_id)
WHERE f.tenant_id = 2 AND {_KEEP} AND r.status = 'false_positive' AND a.data_source = 'Brand#1' AND f.pattern_name ILIKE '%pa%'""")
def findings_suppressed(spark, sf):
    t = Tables(spark, sf)
    return Q.filtered(t.findings, t.classifications, t.assets, t.review_states, 2, Q.Filters(
        review_status="Suppressed", data_source="Brand#1", pattern_name="pa")).select("finding_id", "asset_id")


@query("findings_newest_of_scan", """
SELECT finding_id, created_at FROM findings WHERE scan_run_id = 199703 ORDER BY created_at DESC, finding_id LIMIT 100""")
def findings_newest_of_scan(spark, sf):
    return Q.findings_by_scan(Tables(spark, sf).findings, 199703, 100).select("finding_id", "created_at")


@query("findings_newest_of_asset", """
SELECT finding_id, created_at FROM findings WHERE asset_id = 7 ORDER BY created_at DESC, finding_id LIMIT 100""")
def findings_newest_of_asset(spark, sf):
    return Q.findings_by_asset(Tables(spark, sf).findings, 7, 100).select("finding_id", "created_at")


@query("findings_newest_global", f"""
SELECT finding_id, tenant_id, created_at FROM findings f WHERE {_KEEP} ORDER BY created_at DESC, finding_id LIMIT 100""")
def findings_newest_global(spark, sf):
    t = Tables(spark, sf)
    return Q.findings_global(t.findings, t.classifications, 100).select("finding_id", "tenant_id", "created_at")


@query("findings_masked", """
SELECT finding_id, CASE WHEN is_masked THEN 'TOKEN_' || upper(substr(sha256(matched_value), 1, 16)) ELSE matched_value END AS shown
FROM findings JOIN assets USING (asset_id)""")
def findings_masked(spark, sf):
    t = Tables(spark, sf)
    rows = t.findings.withColumns({"matches": F.array("matched_value"), "masked_value": M.token("matched_value")})
    return Q.findings_masked(rows, t.assets).select("finding_id", F.get("matches", F.lit(0)).alias("shown"))


@query("findings_details", """
SELECT f.finding_id, a.name AS asset_name, a.path AS asset_path, coalesce(r.status, 'pending') AS review_status,
       c.classification_type || '/' || c.sub_category AS classes
FROM findings f LEFT JOIN assets a USING (asset_id) LEFT JOIN review_states r USING (finding_id) LEFT JOIN classifications c USING (finding_id)""")
def findings_details(spark, sf):
    t = Tables(spark, sf)
    rows = Q.finding_details(t.findings, t.classifications, t.assets, t.review_states)
    names = F.transform("classifications", lambda c: F.concat_ws("/", c["classification_type"], c["sub_category"]))
    return rows.select("finding_id", "asset_name", "asset_path", "review_status",
                       F.when(F.col("classifications").isNotNull(), F.array_join(names, ",")).alias("classes"))


@query("findings_facets", """
SELECT DISTINCT 'pattern' AS facet, pattern_name AS value FROM findings
UNION ALL SELECT DISTINCT 'asset', name FROM assets WHERE asset_id IN (SELECT asset_id FROM findings)""")
def findings_facets(spark, sf):
    t = Tables(spark, sf)
    return Q.facets(t.findings, t.assets)


_ASSET_RISK = """
  SELECT a.asset_id, coalesce(n, 0) AS total_findings, CASE WHEN worst >= 4 THEN 95 WHEN worst = 3 AND n > 3 THEN 85 WHEN worst = 3 THEN 75
      WHEN n > 10 THEN 60 WHEN n > 0 THEN 40 ELSE 10 END AS risk_score
  FROM assets a LEFT JOIN (SELECT asset_id, count(*) AS n, max(CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END) AS worst
    FROM findings GROUP BY asset_id) s USING (asset_id)"""


def _asset_risk(t):
    return I.asset_risk(t.findings, t.assets)


@query("asset_risk", _ASSET_RISK)
def asset_risk(spark, sf):
    return _asset_risk(Tables(spark, sf))


@query("assets_high_risk", f"""
SELECT asset_id, risk_score FROM ({_ASSET_RISK}) WHERE risk_score >= 75 ORDER BY risk_score DESC, asset_id LIMIT 100""")
def assets_high_risk(spark, sf):
    return Q.high_risk_assets(_asset_risk(Tables(spark, sf)), 75, 100).select("asset_id", "risk_score")


@query("assets_masked", "SELECT asset_id, path FROM assets WHERE is_masked")
def assets_masked(spark, sf):
    return Q.masked_assets(Tables(spark, sf).assets).select("asset_id", "path")


@query("assets_by_stable_id", """
SELECT asset_id, sha256(lower(path)) AS stable_id FROM assets WHERE sha256(lower(path)) IN (sha256('/shared/export.csv'))""")
def assets_by_stable_id(spark, sf):
    from hashlib import sha256

    rows = Tables(spark, sf).assets.withColumn("stable_id", T.stable_id(F.lit("filesystem"), "host", "path"))
    return Q.assets_by_stable_id(rows, [sha256(b"/shared/export.csv").hexdigest()]).select("asset_id", "stable_id")


@query("active_assets", "SELECT asset_id FROM assets WHERE retention_policy_days IS NULL")
def active_assets(spark, sf):
    rows = Tables(spark, sf).assets.withColumn("deleted_at", F.col("retention_policy_days"))
    return Q.active(rows).select("asset_id")


@query("scan_latest", "SELECT * FROM scan_runs ORDER BY scan_started_at DESC, scan_run_id DESC LIMIT 1")
def scan_latest(spark, sf):
    return Q.latest_scan(Tables(spark, sf).scan_runs)


@query("scan_list", "SELECT * FROM scan_runs ORDER BY scan_started_at DESC, scan_run_id DESC LIMIT 20 OFFSET 5")
def scan_list(spark, sf):
    return Q.list_scans(Tables(spark, sf).scan_runs, 20, 5)


@query("scan_pii_summary", """
SELECT f.scan_run_id, c.sub_category AS pii_type, count(*) AS findings, round(CAST(sum(CAST(c.confidence_score AS DECIMAL(18,9))) AS DOUBLE) / count(*), 6) AS avg_confidence
FROM findings f JOIN classifications c USING (finding_id) GROUP BY ALL""")
def scan_pii_summary(spark, sf):
    t = Tables(spark, sf)
    return Q.scan_pii_summary(t.findings, t.classifications).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("scan_delta", """
WITH prev AS (SELECT s.scan_run_id, (SELECT p.scan_run_id FROM scan_runs p WHERE p.status = 'completed' AND p.scan_started_at < s.scan_started_at
                ORDER BY p.scan_started_at DESC LIMIT 1) AS previous_scan_id FROM scan_runs s),
cnt AS (SELECT f.scan_run_id, c.sub_category AS pii_type, count(*) AS n FROM findings f JOIN classifications c USING (finding_id) GROUP BY ALL),
pairs AS (SELECT p.scan_run_id, p.previous_scan_id, u.pii_type FROM prev p, (SELECT DISTINCT pii_type FROM cnt) u WHERE previous_scan_id IS NOT NULL)
SELECT p.scan_run_id, p.previous_scan_id, p.pii_type, greatest(coalesce(a.n,0) - coalesce(b.n,0), 0) AS new_findings,
       greatest(coalesce(b.n,0) - coalesce(a.n,0), 0) AS gone_findings, coalesce(a.n,0) - coalesce(b.n,0) AS net_change
FROM pairs p LEFT JOIN cnt a ON a.scan_run_id = p.scan_run_id AND a.pii_type = p.pii_type
LEFT JOIN cnt b ON b.scan_run_id = p.previous_scan_id AND b.pii_type = p.pii_type WHERE a.n IS NOT NULL OR b.n IS NOT NULL""")
def scan_delta(spark, sf):
    t = Tables(spark, sf)
    return Q.scan_delta(t.scan_runs, t.findings, t.classifications)


@query("classification_summary", f"""
WITH pii AS (SELECT * FROM classifications WHERE classification_type <> 'Non-PII'), kept AS (SELECT * FROM findings f WHERE {_KEEP})
SELECT 'type' AS section, classification_type AS name, count(*) AS count, round(CAST(sum(CAST(confidence_score AS DECIMAL(18,9))) AS DOUBLE) / count(*), 6) AS average,
       round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM pii), 6) AS percent FROM pii GROUP BY classification_type
UNION ALL SELECT 'severity', severity, count(*), NULL, NULL FROM kept GROUP BY severity
UNION ALL SELECT 'review', status, count(*), NULL, NULL FROM review_states GROUP BY status
UNION ALL SELECT 'consent', 'required', count(*), NULL, NULL FROM pii WHERE classification_type IN ('Personal Data','Sensitive Personal Data')
UNION ALL SELECT 'assets', 'hit', count(DISTINCT asset_id), NULL, NULL FROM kept
UNION ALL SELECT 'total', 'classifications', count(*), NULL, NULL FROM pii""")
def classification_summary(spark, sf):
    t = Tables(spark, sf)
    s = Q.classification_summary(t.findings, t.classifications, t.review_states)
    return s.withColumns({"average": F.round("average", 6), "percent": F.round("percent", 6)})


# --- dashboards -----------------------------------------------------------------------------------------------------

@query("pii_heatmap", f"""
WITH cnt AS (SELECT a.asset_type, c.sub_category AS pii_type, count(*) AS n,
    max(CASE f.severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END) AS worst
  FROM findings f JOIN assets a USING (asset_id) JOIN classifications c USING (finding_id) GROUP BY ALL),
rows AS (SELECT asset_type, CAST(sum(n) AS BIGINT) AS total, max(n) AS fullest FROM cnt GROUP BY asset_type),
types AS (SELECT unnest([{', '.join(f"'{t}'" for t in A.HEATMAP_TYPES)}]) AS pii_type)
SELECT r.asset_type, r.total, t.pii_type, coalesce(c.n, 0) AS finding_count,
  CASE coalesce(c.worst, 1) WHEN 4 THEN 'Critical' WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS risk_level,
  CAST(floor(coalesce(c.n, 0) * 100 / r.fullest) AS INTEGER) AS intensity
FROM rows r CROSS JOIN types t LEFT JOIN cnt c ON c.asset_type = r.asset_type AND c.pii_type = t.pii_type""")
def pii_heatmap(spark, sf):
    t = Tables(spark, sf)
    return A.pii_heatmap(t.findings, t.assets, t.classifications)


@query("risk_distribution", """
SELECT severity, count(*) AS findings, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM findings GROUP BY severity""")
def risk_distribution(spark, sf):
    return A.risk_distribution(Tables(spark, sf).findings)


@query("risk_trend", f"""
WITH days AS (SELECT CAST(unnest(generate_series(DATE '{AS_OF}' - 89, DATE '{AS_OF}', INTERVAL 1 DAY)) AS DATE) AS day),
cnt AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS total, count(*) FILTER (severity = 'Critical') AS critical,
  count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low FROM findings GROUP BY 1),
f AS (SELECT day, coalesce(total,0) AS total, coalesce(critical,0) AS critical, coalesce(high,0) AS high, coalesce(medium,0) AS medium, coalesce(low,0) AS low
  FROM days LEFT JOIN cnt USING (day))
SELECT *, coalesce(greatest(total - lag(total) OVER (ORDER BY day), 0), 0) AS newly_exposed,
  coalesce(greatest(lag(total) OVER (ORDER BY day) - total, 0), 0) AS resolved FROM f""")
def risk_trend(spark, sf):
    return A.risk_trend(Tables(spark, sf).findings, AS_OF, 90)


@query("dashboard_metrics", """
SELECT count(*) AS total_pii, count(*) FILTER (severity = 'Critical') AS high_risk_findings, count(DISTINCT asset_id) AS assets_hit,
  (SELECT count(*) FROM findings f WHERE environment = 'PROD' AND severity IN ('Critical','High') AND NOT EXISTS
     (SELECT 1 FROM review_states r WHERE r.finding_id = f.finding_id AND r.status IN ('confirmed','false_positive','remediated'))) AS actions_required,
  (SELECT max(scan_completed_at) FROM scan_runs WHERE status = 'completed') AS last_scan
FROM findings WHERE environment = 'PROD'""")
def dashboard_metrics(spark, sf):
    t = Tables(spark, sf)
    return A.dashboard_metrics(t.findings, t.review_states, t.scan_runs, "PROD")


@query("scan_risk_trend", f"""
SELECT CAST(scan_started_at AS DATE) AS day, CAST(CASE WHEN count(f.finding_id) > 0 THEN floor(sum(CASE severity WHEN 'Critical' THEN 8 WHEN 'High' THEN 5
    WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END) * 100 / (count(f.finding_id) * 8)) ELSE 0 END AS INTEGER) AS score, count(DISTINCT s.scan_run_id) AS scan_count
FROM scan_runs s LEFT JOIN findings f USING (scan_run_id)
WHERE s.status = 'completed' AND scan_started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1000 DAY GROUP BY 1""")
def scan_risk_trend(spark, sf):
    t = Tables(spark, sf)
    return A.scan_risk_trend(t.scan_runs, t.findings, AS_OF, 1000)


# --- ingestion ------------------------------------------------------------------------------------------------------

_INGEST_TYPES = ["PAN", "AADHAAR", "EMAIL", "PHONE", "CREDIT_CARD", "GST", "UPI", "DRIVING_LICENSE", "GENERIC_API_KEY"]
_PNAME = "lower(replace(pattern_name, ' ', '_'))"
_FPATH = ("CASE k % 5 WHEN 0 THEN '/prod/customer/' WHEN 1 THEN '/srv/test/' WHEN 2 THEN '/dev/billing/' WHEN 3 THEN '/users/live/' "
          "ELSE '/data/' END || (k % 200) || CASE k % 17 WHEN 0 THEN '.test.json' ELSE '.csv' END")
_META = "CASE k % 6 WHEN 0 THEN 'staging' WHEN 1 THEN 'prod' END"
_SEVERITY = "CASE k % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Critical' WHEN 2 THEN 'Low' ELSE 'Medium' END"
_RAW_SQL = f"""
  SELECT *, {_FPATH} AS fpath, {_PNAME} AS pname, '' AS cname, {_META} AS env, {_SEVERITY} AS sev FROM (
    SELECT pattern_name, matched_value, CAST(split_part(source_path, '.', 3) AS BIGINT) AS k
    FROM ({findings_sql(P.select_patterns(_INGEST_TYPES), "(SELECT * FROM records WHERE source_path LIKE 'crm.%')")}) d) e"""


def raw_hits(spark, sf):
    """Scanner hits over the customer texts, spread over paths and environments."""
    records = Tables(spark, sf).crm_records
    hits = D.detect(records, _INGEST_TYPES).withColumn("k", F.substring_index("source_path", ".", -1).cast("long"))
    return hits.select(
        F.expr(_PNAME).alias("pattern_name"), F.expr(_FPATH).alias("file_path"), F.lit("").alias("column_name"),
        F.array("matched_value").alias("matches"), F.col("matched_value").alias("sample_text"),
        F.expr(_SEVERITY).alias("severity"), F.lit("filesystem").alias("data_source"), F.lit("nas").alias("host"),
        F.create_map(F.lit("environment"), F.expr(_META)).alias("metadata"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(secs=F.col("k"))).alias("detected_at"))


_NORM = "trim(regexp_replace(matched_value, '\\s+', ' ', 'g'))"
_TYPE_OF = case_sql([(f"regexp_matches(pname, '{w}')", f"'{t}'") for w, t in (
    ("aadhaar|aadhar", "IN_AADHAAR"), ("pan", "IN_PAN"), ("credit", "CREDIT_CARD"), ("email", "EMAIL_ADDRESS"), ("phone", "IN_PHONE"),
    ("passport", "IN_PASSPORT"), ("upi", "IN_UPI"), ("ifsc", "IN_IFSC"), ("voter", "IN_VOTER_ID"),
    ("driving|license|licence", "IN_DRIVING_LICENSE"), ("bank|account", "IN_BANK_ACCOUNT"))], "''")
_LOWPATH = "lower(fpath || ' ' || cname)"
_SEM = ("greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((" + " + ".join(f"{word_sql(_LOWPATH, [w])}::INT" for w in S.HIGH_RISK_WORDS)
        + ") * 15 - (" + " + ".join(f"{word_sql(_LOWPATH, [w])}::INT" for w in S.LOW_RISK_WORDS) + ") * 25) / 100.0::DOUBLE))")
_ENV = case_sql([(word_sql("lower(fpath)", w), f"'{n}'") for n, w, _ in S.ENVIRONMENTS], "'unknown'")
_TESTPATH = ("(regexp_matches(lower(fpath), '/(" + "|".join(S.TEST_FOLDERS) + ")/') OR regexp_matches(lower(fpath), '("
             + "|".join(e.replace(".", "\\.") for e in S.TEST_ENDINGS) + ")$') OR regexp_matches(lower(matched_value), 'john doe|example|test@')"
             " OR contains(matched_value, '1234567890'))")
_VALID = "CASE t " + " ".join(f"WHEN '{t}' THEN {r}" for t, r in LENIENT_SQL.items()) + " ELSE true END"
_INGEST_SQL = f"""
  SELECT *, min(k) OVER u AS first_k, row_number() OVER (PARTITION BY fpath, pname, value_key ORDER BY k, fpath) AS rn,
         count(*) OVER u AS occurrences
  FROM (SELECT *, CASE WHEN {SECRET} THEN (rule * 0.4::DOUBLE + enr * 0.3::DOUBLE + ent_sig * 0.1::DOUBLE) / (0.4::DOUBLE + 0.3::DOUBLE + 0.1::DOUBLE)
            ELSE (rule * 0.4::DOUBLE + enr * 0.3::DOUBLE) / (0.4::DOUBLE + 0.3::DOUBLE) END AS final,
          sha256(lower(replace(replace(matched_value, ' ', ''), '-', ''))) AS value_key, {_TESTPATH} AS test,
          coalesce(env NOT IN ('staging'), true) AS prod
        FROM (SELECT *, {RULE} AS rule, {CLASS} AS cls,
                greatest(0.0::DOUBLE, least(1.0::DOUBLE, sem * 0.4::DOUBLE + {env_score_sql('envname')} * 0.3::DOUBLE
                  + least(ent / 5.0::DOUBLE, 1.0::DOUBLE) * 0.2::DOUBLE + div * 0.1::DOUBLE)) AS enr,
                least(ent / 5.0::DOUBLE, 1.0::DOUBLE) * 0.7::DOUBLE + div * 0.3::DOUBLE AS ent_sig
              FROM (SELECT *, {_SEM} AS sem, {_ENV} AS envname, {entropy_sql('v')} AS ent, {diversity_sql('v')} AS div
                    FROM (SELECT *, {_NORM} AS v, {_TYPE_OF} AS t FROM ({_RAW_SQL}) r) n WHERE t = '' OR {_VALID}) m) s) z
  WHERE cls <> 'Non-PII' AND final >= 0.45 WINDOW u AS (PARTITION BY fpath, pname, value_key)"""


@query("ingest_findings", f"""
SELECT sha256(lower(fpath)) AS asset_id, pname AS pattern_name, value_key, occurrences, cls AS classification, round(final, 6) AS confidence_score,
  CASE cls WHEN 'Sensitive Personal Data' THEN CASE WHEN final >= 0.85 AND prod THEN 'Critical' WHEN final >= 0.85 OR prod THEN 'High' ELSE 'Medium' END
    WHEN 'Personal Data' THEN CASE WHEN final >= 0.85 AND prod THEN 'Medium' ELSE 'Low' END
    ELSE CASE WHEN final >= 0.85 AND prod THEN 'Critical' WHEN prod THEN 'High' ELSE 'Medium' END END AS severity,
  CASE WHEN test THEN 'TEST' ELSE 'PROD' END AS environment, CASE WHEN test THEN 'ignored' ELSE 'pending' END AS review_status
FROM ({_INGEST_SQL}) i WHERE rn = 1""")
def ingest_findings(spark, sf):
    done = I.ingest(raw_hits(spark, sf), 202401)
    return done.findings.select("asset_id", "pattern_name", "value_key", "occurrences", "classification",
                                F.round("confidence_score", 6).alias("confidence_score"), "severity", "environment",
                                "review_status")


@query("ingest_assets", f"""
SELECT sha256(lower(fpath)) AS asset_id, fpath AS path, list_extract(string_split(fpath, '/'), -1) AS name,
  CASE arg_min(sev, k) WHEN 'Critical' THEN 95 WHEN 'High' THEN 80 WHEN 'Medium' THEN 60 ELSE 30 END AS risk_score,
  TIMESTAMP '2024-01-01' + to_seconds(min(k)) AS created_at FROM ({_RAW_SQL}) r GROUP BY fpath""")
def ingest_assets(spark, sf):
    return I.ingest(raw_hits(spark, sf), 202401).assets.select("asset_id", "path", "name", "risk_score", "created_at")


@query("ingest_scan_totals", f"""
SELECT 202401 AS scan_run_id, count(*) AS total_findings, count(DISTINCT fpath) AS total_assets, count(DISTINCT pname) AS patterns_found,
  (SELECT count(DISTINCT fpath) FROM ({_RAW_SQL}) r) AS assets_created FROM ({_INGEST_SQL}) i WHERE rn = 1""")
def ingest_scan_totals(spark, sf):
    # findings and assets both start from the hits, so these are written and the texts searched once
    done = I.ingest(staged(raw_hits(spark, sf)), 202401)
    return I.scan_totals(done.findings, done.assets)


@query("ingest_type_counts", f"""
SELECT sha256(lower(fpath)) AS asset_id, string_agg(pname || '=' || n, ',' ORDER BY pname) AS type_counts
FROM (SELECT fpath, pname, count(*) AS n FROM ({_INGEST_SQL}) i WHERE rn = 1 GROUP BY ALL) GROUP BY fpath""")
def ingest_type_counts(spark, sf):
    counts = I.asset_type_counts(I.ingest(raw_hits(spark, sf), 202401).findings)
    pairs = F.transform(F.map_entries("type_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return counts.select("asset_id", F.array_join(F.array_sort(pairs), ",").alias("type_counts"))


_VERIFIED_SQL = f"""
  SELECT * FROM (SELECT source_path, pii_type, pattern_name, matched_value AS v, score / 100.0::DOUBLE AS conf, k % 3 AS nv, k % 12 AS nk FROM (
    SELECT *, CAST(split_part(source_path, '.', 3) AS BIGINT) AS k
    FROM ({findings_sql(P.BUILTIN, "(SELECT * FROM records WHERE source_path LIKE 'crm.%')")}) d) e) x
  WHERE pii_type IN ('IN_PAN','IN_PASSPORT','IN_AADHAAR','CREDIT_CARD','IN_UPI','IN_IFSC','IN_BANK_ACCOUNT','IN_PHONE','EMAIL_ADDRESS','IN_VOTER_ID','IN_DRIVING_LICENSE','IN_GST')
    AND CASE pii_type {' '.join(f"WHEN '{t}' THEN {r}" for t, r in LENIENT_SQL.items())} ELSE true END"""


@query("ingest_verified", f"""
SELECT source_path AS asset_name, pattern_name, pii_type AS sub_category, sha256(v) AS stored, {map_sql(1, "'Personal Data'")} AS classification_type,
  {map_sql(2, "'General Personal Data'")} AS regulation_category, {map_sql(3, 'false')} AS requires_consent, {map_sql(4, "'High'")} AS severity,
  round(CASE WHEN nv > 0 THEN greatest(conf, 0.85::DOUBLE) ELSE conf END * 0.6::DOUBLE + least(nk * 0.1::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE + 0.15::DOUBLE, 6) AS final_score,
  floor(round((CASE {map_sql(1, "'Personal Data'")} WHEN 'Personal Data' THEN 0.5 ELSE 1.0 END * 0.4 + conf * 0.2 + 0.2 + 0.1) * 100, 6) + 0.5)::DOUBLE AS risk_score
FROM ({_VERIFIED_SQL}) y""")
def ingest_verified(spark, sf):
    k = F.substring_index("source_path", ".", -1).cast("long")
    found = D.detect(Tables(spark, sf).crm_records).withColumns({
        "confidence": F.col("score") / 100.0, "data_source": F.lit("filesystem"), "host": F.lit("nas"),
        "validators": F.array_repeat(F.lit("luhn"), (k % 3).cast("int")),
        "keywords": F.array_repeat(F.lit("kw"), (k % 12).cast("int"))})
    rows = I.ingest_verified(found, 202401, mode="none")
    return rows.select("asset_name", "pattern_name", "sub_category", F.get("matches", F.lit(0)).alias("stored"),
                       "classification_type", "regulation_category", "requires_consent", "severity",
                       F.round("final_score", 6).alias("final_score"), "risk_score")


@query("store_modes", """
SELECT finding_id, '****-****-****-' || right(lpad(digits, 8, '0'), 4) AS masked, sha256(lpad(digits, 8, '0')) AS hashed, '[MASKED]' AS sample
FROM (SELECT finding_id, substr(matched_value, 2) AS digits FROM findings)""")
def store_modes(spark, sf):
    rows = Tables(spark, sf).findings.withColumn("m", F.array(F.lpad(F.substring("matched_value", 2, 9), 8, "0")))
    return rows.select("finding_id", F.get(M.store_mode("m", "mask"), F.lit(0)).alias("masked"),
                       F.get(M.store_mode("m", "none"), F.lit(0)).alias("hashed"),
                       M.store_sample("matched_value", "mask").alias("sample"))


@query("encrypt_samples", "SELECT finding_id, matched_value AS opened, true AS hidden FROM findings")
def encrypt_samples(spark, sf):
    key = "0123456789abcdef"
    rows = Tables(spark, sf).findings.withColumn("sealed", M.encrypt("matched_value", key))
    return rows.select("finding_id", M.decrypt("sealed", key).alias("opened"),
                       (F.col("sealed") != F.col("matched_value")).alias("hidden"))


@query("apply_tags", """
SELECT asset_id, 'dept=' || CASE WHEN asset_id % 3 = 0 AND asset_id % 2 = 0 THEN 'old' WHEN asset_id % 2 = 0 THEN 'new' ELSE 'old' END
  || CASE WHEN asset_id % 2 = 0 THEN ',level=' || tenant_id ELSE '' END || ',owner=' || data_source AS tags FROM assets""")
def apply_tags(spark, sf):
    a = Tables(spark, sf).assets.withColumns({
        "tags": F.create_map(F.lit("dept"), F.lit("old"), F.lit("owner"), F.col("data_source")),
        "manual_keys": F.when(F.col("asset_id") % 3 == 0, F.array(F.lit("dept")))})
    new = a.filter("asset_id % 2 = 0").select("asset_id", F.create_map(
        F.lit("dept"), F.lit("new"), F.lit("level"), F.col("tenant_id").cast("string")).alias("tags"))
    out = I.apply_tags(a, new)
    pairs = F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("asset_id", F.array_join(F.array_sort(pairs), ",").alias("tags"))


# --- feedback -------------------------------------------------------------------------------------------------------

_PRECISION = """
  SELECT tenant_id, pattern_code, count(*) FILTER (correction_type = 'confirmed') AS confirmed,
    count(*) FILTER (correction_type = 'false_positive') AS false_positives FROM corrections GROUP BY ALL"""


@query("pattern_precision", f"""
SELECT *, CASE WHEN confirmed + false_positives = 0 THEN 1.0 ELSE confirmed / (confirmed + false_positives) END AS precision,
  round((CASE WHEN confirmed + false_positives = 0 THEN 1.0 ELSE confirmed / (confirmed + false_positives) END - 0.7) * 100, 6) AS confidence_delta FROM ({_PRECISION})""")
def pattern_precision(spark, sf):
    return B.pattern_precision(Tables(spark, sf).corrections).withColumn(
        "confidence_delta", F.round("confidence_delta", 6))


@query("threshold_overrides", f"""
SELECT pattern_code, CAST(least(greatest(floor(confirmed / (confirmed + false_positives) * 100), 30), 90) AS INTEGER) AS min_confidence_score
FROM (SELECT pattern_code, CAST(sum(confirmed) AS BIGINT) AS confirmed, CAST(sum(false_positives) AS BIGINT) AS false_positives FROM ({_PRECISION}) GROUP BY 1) WHERE confirmed + false_positives >= 10""")
def threshold_overrides(spark, sf):
    one = Tables(spark, sf).corrections.withColumn("tenant_id", F.lit(0))
    return B.threshold_overrides(one).drop("tenant_id")


@query("apply_feedback", """
WITH fb AS (SELECT finding_id, CASE WHEN l_linestatus = 'F' THEN 'FALSE_POSITIVE' ELSE 'CONFIRMED' END AS kind FROM findings WHERE severity = 'High')
SELECT finding_id, CASE fb.kind WHEN 'FALSE_POSITIVE' THEN 'false_positive' WHEN 'CONFIRMED' THEN 'confirmed' ELSE r.status END AS status
FROM review_states r FULL OUTER JOIN fb USING (finding_id)""")
def apply_feedback(spark, sf):
    t = Tables(spark, sf)
    high = t.findings.filter("severity = 'High'")
    last = F.when(F.col("l_linestatus") == "F", "FALSE_POSITIVE").otherwise("CONFIRMED")
    first = F.when(F.col("l_linestatus") == "F", "CONFIRMED").otherwise("FALSE_POSITIVE")
    later = F.col("created_at") + F.make_interval(days=F.lit(1))
    feedback = high.select("finding_id", first.alias("feedback_type"), "created_at").unionByName(
        high.select("finding_id", last.alias("feedback_type"), later.alias("created_at")))
    return B.apply_feedback(t.review_states, feedback)


@query("pattern_false_positives", """
SELECT pattern_name AS pattern_id, m AS match_count, n AS false_positive_count, n / greatest(m, 1) AS false_positive_rate,
  n / greatest(m, 1) > 0.30 AS auto_deactivated, NOT (n / greatest(m, 1) > 0.30) AS is_active
FROM (SELECT pattern_name, count(*) FILTER (severity <> 'Low') AS m,
        (SELECT count(*) FROM findings g JOIN review_states r USING (finding_id) WHERE g.pattern_name = f.pattern_name AND r.status = 'false_positive') AS n
      FROM findings f GROUP BY pattern_name)""")
def pattern_false_positives(spark, sf):
    t = Tables(spark, sf)
    patterns = t.findings.groupBy(F.col("pattern_name").alias("pattern_id")).agg(
        F.count_if(F.col("severity") != "Low").alias("match_count")).withColumn("is_active", F.lit(True))
    reports = t.findings.join(t.review_states.filter("status = 'false_positive'"), "finding_id", "left_semi").select(
        F.col("pattern_name").alias("pattern_id"))
    return B.pattern_fp(patterns, reports).select(
        "pattern_id", "match_count", "false_positive_count", "false_positive_rate", "auto_deactivated", "is_active")


@query("pattern_stats", """
SELECT pattern_name, count(*) AS total_matches, max(created_at) AS last_matched_at,
  round(count(*) / greatest((SELECT count(*) FROM scan_runs WHERE status = 'completed'), 1), 6) AS match_rate_per_scan FROM findings GROUP BY 1""")
def pattern_stats(spark, sf):
    t = Tables(spark, sf)
    patterns = t.findings.select("pattern_name").distinct()
    return B.pattern_stats(patterns, t.findings, t.scan_runs).withColumn(
        "match_rate_per_scan", F.round("match_rate_per_scan", 6))


@query("active_patterns", """
SELECT DISTINCT pattern_name FROM findings WHERE tenant_id = 3 AND pattern_name <> 'gst'""")
def active_patterns(spark, sf):
    rows = Tables(spark, sf).findings.select("tenant_id", "pattern_name").distinct().withColumn(
        "is_active", F.col("pattern_name") != "gst")
    return B.active_patterns(rows, 3).select("pattern_name")


@query("pattern_regex_status", """
SELECT status, count(*) AS patterns FROM (SELECT CASE item_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'nested_quantifier' WHEN 2 THEN 'unbounded_alternation'
   WHEN 3 THEN 'too_long' WHEN 4 THEN 'invalid' ELSE 'ok' END AS status FROM benchmark) GROUP BY 1""")
def pattern_regex_status(spark, sf):
    regex = F.expr(r"CASE item_id % 6 WHEN 0 THEN 'EMP-\\d{6}' WHEN 1 THEN '(a+)+b' WHEN 2 THEN '(a|b)*c' WHEN 3 THEN"
                   r" repeat('a', 501) WHEN 4 THEN '(abc' ELSE '\\(\\d{3}\\) [a-z(]+' END")
    rows = Tables(spark, sf).raw("benchmark").select(regex.alias("regex"))
    return D.validate_patterns(rows).groupBy("status").agg(F.count("*").alias("patterns"))


@query("pattern_tests", """
SELECT pattern_id, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, count(*) AS total, round(count(*) FILTER (ok) / count(*), 6) AS pass_rate
FROM (SELECT o_custkey % 3 AS pattern_id, regexp_matches(o_orderpriority, CASE o_custkey % 3 WHEN 0 THEN '^[12]-' WHEN 1 THEN 'H|M' ELSE 'LOW$' END)
        = (o_orderstatus = 'O') AS ok FROM orders) GROUP BY 1""")
def pattern_tests(spark, sf):
    table = spark.createDataFrame([(0, "^[12]-"), (1, "H|M"), (2, "LOW$")], "pattern_id long, regex string")
    cases = Tables(spark, sf).raw("orders").select(
        (F.col("o_custkey") % 3).alias("pattern_id"), F.col("o_orderpriority").alias("input"),
        (F.col("o_orderstatus") == "O").alias("should_match"))
    return D.test_patterns(table, cases).withColumn("pass_rate", F.round("pass_rate", 6))


@query("evaluate_detection", f"""
WITH lab AS (SELECT CAST(c_custkey AS BIGINT) AS case_id, 'IN_PAN' AS expected_type, c_custkey % 2 = 0 AS should FROM customer),
found AS (SELECT DISTINCT CAST(split_part(source_path, '.', 3) AS BIGINT) AS case_id FROM ({findings_sql(P.select_patterns(['PAN']), "(SELECT * FROM records WHERE source_path LIKE 'crm.%')")}) d),
j AS (SELECT should, f.case_id IS NOT NULL AS hit FROM lab LEFT JOIN found f USING (case_id)),
c AS (SELECT count(*) FILTER (should AND hit) AS tp, count(*) FILTER (NOT should AND hit) AS fp, count(*) FILTER (NOT should AND NOT hit) AS tn, count(*) FILTER (should AND NOT hit) AS fn FROM j)
SELECT tp, fp, tn, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, 2 * tp / (2 * tp + fp + fn) >= 0.9 AS passed_gate FROM c""")
def evaluate_detection(spark, sf):
    t = Tables(spark, sf)
    labelled = t.raw("customer").select(F.col("c_custkey").alias("case_id"), F.lit("IN_PAN").alias("expected_type"),
                                        (F.col("c_custkey") % 2 == 0).alias("should_detect"))
    found = D.detect(t.crm_records, ["PAN"]).select(
        F.substring_index("source_path", ".", -1).cast("long").alias("case_id"), "pii_type")
    e = D.evaluate(labelled, found)
    return e.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


# --- false-positive learning ----------------------------------------------------------------------------------------

def _sim(a, b):
    return f"(CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein(lower({a}), lower({b})) / greatest(length({a}), length({b})) END)"


@query("value_similarity", f"""
SELECT a.doc_id, round({_sim('a.source', 'a.lang')}, 6) AS value_similarity,
  round(CASE WHEN lower(a.source) = lower('x.' || a.source) THEN 1.0 WHEN list_extract(string_split(lower(a.source), '.'), -1) = list_extract(string_split(lower('x.' || a.source), '.'), -1) THEN 0.9 ELSE 0 END, 6) AS path_similarity,
  round({_sim("a.lang || '_' || a.n_chars", "a.lang || '-' || (a.n_chars + 1)")}, 6) AS near FROM documents a""")
def value_similarity(spark, sf):
    d = Tables(spark, sf).raw("documents")
    return d.select("doc_id", F.round(Y.similarity("source", "lang"), 6).alias("value_similarity"),
                    F.round(Y.path_similarity(F.col("source"), F.concat(F.lit("x."), F.col("source"))), 6).alias("path_similarity"),
                    F.round(Y.similarity(F.expr("lang || '_' || n_chars"), F.expr("lang || '-' || (n_chars + 1)")), 6).alias("near"))


def shape_sql(v, t):
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    generic = (f"'generic:' || (length(regexp_replace({v}, '[^\\p{{L}}]', '', 'g')) % 10) || 'a-' || (length(regexp_replace({v}, '[^\\p{{Nd}}]', '', 'g')) % 10)"
               f" || 'd-' || (length(regexp_replace({v}, '[\\p{{L}}\\p{{Nd}}\\s]', '', 'g')) % 10) || 's'")
    return (f"CASE WHEN lower({t}) IN ('email','email_address') THEN CASE WHEN len(string_split({v}, '@')) = 2 AND contains(split_part({v}, '@', 2), '.') "
            f"THEN 'email:*@*.' || list_extract(string_split({v}, '.'), -1) ELSE 'email:invalid' END "
            f"WHEN lower({t}) IN ('phone','phone_number') THEN 'phone:' || length({d}) || 'digits' "
            f"WHEN lower({t}) = 'aadhaar' THEN CASE WHEN length({d}) = 12 THEN 'aadhaar:****-****-' || right({d}, 4) ELSE 'aadhaar:invalid' END "
            f"WHEN lower({t}) = 'pan' THEN CASE WHEN length({v}) = 10 THEN 'pan:' || upper(substr({v}, 4, 1)) || '-type' ELSE 'pan:invalid' END ELSE {generic} END")


_SHAPE_TYPES = "CASE piece WHEN 1 THEN 'aadhaar' WHEN 2 THEN 'pan' WHEN 7 THEN 'email' WHEN 8 THEN 'phone' ELSE pii_type END"


def _register_shapes():
    from datavigil.plans.scores import _VALUES, identity_values

    @query("value_patterns", f"""
    SELECT c_custkey, piece, {shape_sql('trim(v)', 't')} AS value_pattern FROM (SELECT *, {_SHAPE_TYPES} AS t FROM ({_VALUES}) x) y""")
    def value_patterns(spark, sf):
        rows = identity_values(spark, sf).withColumn("t", F.expr(_SHAPE_TYPES))
        return rows.select("c_custkey", "piece", Y.value_pattern("v", "t").alias("value_pattern"))


_register_shapes()

_FP_SQL = f"""
  SELECT finding_id, max(CASE WHEN f.matched_value = l.matched_value THEN 1.0 WHEN {shape_sql('f.matched_value', 'f.pii_type')} = {shape_sql('l.matched_value', 'f.pii_type')} THEN 0.95::DOUBLE
      ELSE 0.3::DOUBLE + 0.7::DOUBLE * {_sim('l.matched_value', 'f.matched_value')} END) AS similarity
  FROM findings f JOIN learned l USING (tenant_id, asset_id, pattern_name, pii_type)
  WHERE f.matched_value = l.matched_value OR {shape_sql('f.matched_value', 'f.pii_type')} = {shape_sql('l.matched_value', 'f.pii_type')}
    OR 0.3 + 0.7 * {_sim('l.matched_value', 'f.matched_value')} >= 0.85
  GROUP BY finding_id"""


def _fp_inputs(t):
    paths = t.assets.select("asset_id", F.col("path").alias("field_path"))
    learned = t.learned.withColumn("learned_id", F.concat_ws("|", "asset_id", "pattern_name", "matched_value"))
    return t.findings.join(paths, "asset_id"), learned


@query("fp_matches", f"""
SELECT finding_id, round(similarity, 6) AS similarity, CASE WHEN similarity = 1.0 THEN 'exact' WHEN similarity = 0.95 THEN 'pattern' ELSE 'fuzzy' END AS match_type FROM ({_FP_SQL})""")
def fp_matches(spark, sf):
    m = B.fp_match(*_fp_inputs(Tables(spark, sf)))
    return m.select("finding_id", F.round("similarity", 6).alias("similarity"), "match_type")


@query("fp_suppressed", f"SELECT finding_id FROM findings WHERE finding_id NOT IN (SELECT finding_id FROM ({_FP_SQL}))")
def fp_suppressed(spark, sf):
    return B.suppress(*_fp_inputs(Tables(spark, sf))).select("finding_id")


_LEARNED = """
  SELECT f.tenant_id, f.pii_type, f.asset_id, r.status AS learning_type, f.created_at, f.finding_id FROM findings f JOIN review_states r USING (finding_id) WHERE f.severity <> 'Low'"""


def _learnings(t):
    return t.findings.join(t.review_states, "finding_id").select(
        "tenant_id", "pii_type", "asset_id", F.col("status").alias("learning_type"), "created_at",
        F.col("finding_id").alias("learned_id"), (F.col("severity") != "Low").alias("is_active"))


@query("fp_learning_stats", f"""
SELECT tenant_id, pii_type, asset_id, count(*) AS patterns, count(*) FILTER (learning_type = 'false_positive') AS false_positives,
  count(*) FILTER (learning_type = 'confirmed') AS confirmed, max(created_at) AS latest_learning_at,
  CASE WHEN pii_type IS NOT NULL THEN 'type' WHEN asset_id IS NOT NULL THEN 'asset' ELSE 'total' END AS level
FROM ({_LEARNED}) GROUP BY GROUPING SETS ((tenant_id, pii_type), (tenant_id, asset_id), (tenant_id))""")
def fp_learning_stats(spark, sf):
    return B.fp_stats(_learnings(Tables(spark, sf)))


@query("fp_learning_list", f"""
SELECT finding_id AS learned_id, created_at FROM ({_LEARNED}) WHERE tenant_id = 4 AND pii_type = 'IN_PHONE' ORDER BY created_at DESC, finding_id LIMIT 25 OFFSET 5""")
def fp_learning_list(spark, sf):
    return B.list_learned(_learnings(Tables(spark, sf)), 4, "IN_PHONE", limit=25, offset=5).select(
        "learned_id", "created_at")
