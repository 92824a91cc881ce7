"""Governance tables as projections of the star schema, in SQL for the check and as DataFrames for the queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1999-01-01"
EVENTS_AS_OF = "2024-01-31"
SNAPSHOT_A = "1998-01-01"

# Type | pattern name, in the order the projections index them.
TYPES = [
    ("IN_AADHAAR", "aadhaar"), ("IN_PAN", "pan"), ("IN_PASSPORT", "passport"), ("CREDIT_CARD", "credit_card"),
    ("IN_UPI", "upi"), ("IN_IFSC", "ifsc"), ("IN_BANK_ACCOUNT", "bank_account"), ("IN_PHONE", "phone"),
    ("EMAIL_ADDRESS", "email"), ("IN_VOTER_ID", "voter_id"), ("IN_DRIVING_LICENSE", "driving_license"),
    ("IN_GST", "gst"),
]

_SENSITIVE = "('IN_AADHAAR','IN_PAN','IN_PASSPORT')"
_FINANCIAL = "('CREDIT_CARD','IN_UPI','IN_IFSC','IN_BANK_ACCOUNT')"
_GOVERNMENT = "('IN_VOTER_ID','IN_DRIVING_LICENSE')"
_CONSENT = "('IN_AADHAAR','IN_PAN','IN_PASSPORT','CREDIT_CARD','IN_DRIVING_LICENSE')"

# One text per customer that holds an identifier of every kind, so that every pattern meets matching, failing and
# near-miss values and the work grows with the table. The expressions mean the same in Spark SQL and in DuckDB.
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(({k}) % 26 AS INTEGER) + 1, 1)"


def _pad(expr, n):
    return f"lpad(CAST({expr} AS VARCHAR(40)), {n}, '0')"


def _letters(*seeds):
    return " || ".join(_LETTER.format(k=s) for s in seeds)


# The key is reduced first, so that the products below stay inside 64 bits at any scale.
_K = "(c_custkey % 1000003)"
IDENTITY_TEXT = " || ' | ' || ".join([
    f"'aadhaar ' || CAST(2 + {_K} % 8 AS VARCHAR(40)) || {_pad(f'({_K} * 7919) % 1000', 3)} || CASE {_K} % 3 WHEN 0"
    f" THEN ' ' WHEN 1 THEN '-' ELSE '' END || {_pad(f'({_K} * 104729) % 10000', 4)} || CASE {_K} % 3 WHEN 0 THEN ' '"
    f" WHEN 1 THEN '-' ELSE '' END || {_pad(f'({_K} * 31 + 7) % 10000', 4)} || ','",
    f"'PAN ' || {_letters(_K, _K + ' * 3', _K + ' * 5', _K + ' * 7', _K + ' * 11')} || "
    f"{_pad(f'{_K} % 10000', 4)} || {_letters(_K + ' * 13')}",
    f"'card 4' || {_pad(f'({_K} * 7919) % 10000000', 7)} || {_pad(f'({_K} * 104729) % 100000000', 8)}",
    f"'card 5' || CAST(1 + {_K} % 5 AS VARCHAR(40)) || {_pad(f'({_K} * 1299709) % 10000000', 7)} || "
    f"{_pad(f'({_K} * 15485863) % 10000000', 7)}",
    f"'card 3' || CASE {_K} % 2 WHEN 0 THEN '4' ELSE '7' END || {_pad(f'({_K} * 32452843) % 10000000000', 10)} || "
    f"{_pad(f'{_K} % 1000', 3)}",
    f"'card 6011' || {_pad(f'({_K} * 49979687) % 1000000000000', 12)}",
    f"'mail ' || CASE {_K} % 5 WHEN 0 THEN 'test' ELSE 'user.' || CAST({_K} AS VARCHAR(40)) END || '@' || "
    f"CASE {_K} % 4 WHEN 0 THEN 'example.com' WHEN 1 THEN 'mail-server.io' WHEN 2 THEN 'corp.co.in' ELSE 'Site.org' END",
    f"'mobile ' || CASE {_K} % 3 WHEN 0 THEN '91' WHEN 1 THEN '0' ELSE '' END || CAST(6 + {_K} % 4 AS VARCHAR(40)) || "
    f"{_pad(f'({_K} * 611953) % 1000000000', 9)}",
    f"'call +91' || CASE {_K} % 3 WHEN 0 THEN ' ' WHEN 1 THEN '-' ELSE '' END || CAST(5 + {_K} % 5 AS VARCHAR(40)) || "
    f"{_pad(f'({_K} * 7368787) % 1000000000', 9)}",
    f"'gst ' || {_pad(f'{_K} % 40', 2)} || {_letters(_K, _K + ' * 3', _K + ' * 5', _K + ' * 7', _K + ' * 11')} || "
    f"{_pad(f'{_K} % 10000', 4)} || {_letters(_K + ' * 17')} || '1Z' || CAST({_K} % 10 AS VARCHAR(40))",
    f"'pay name' || CAST({_K} AS VARCHAR(40)) || '@' || CASE {_K} % 4 WHEN 0 THEN 'okaxis' WHEN 1 THEN 'ybl' "
    f"WHEN 2 THEN 'ab' ELSE 'some.very.long.provider.domain' END",
    f"'ifsc ' || {_letters(_K, _K + ' * 3', _K + ' * 9', _K + ' * 5')} || CASE {_K} % 3 WHEN 0 THEN '1' ELSE '0' END || "
    f"{_pad(f'({_K} * 37) % 1000000', 6)}",
    f"'passport ' || {_letters(_K + ' * 7')} || {_pad(f'({_K} * 6151) % 10000000', 7)}",
    f"'voter ' || {_letters(_K, _K + ' * 5', _K + ' * 3')} || {_pad(f'({_K} * 12289) % 10000000', 7)}",
    f"'licence ' || CASE {_K} % 4 WHEN 0 THEN 'MH' WHEN 1 THEN 'KA' WHEN 2 THEN 'XX' ELSE 'DL' END || '-' || "
    f"{_pad(f'{_K} % 100', 2)} || ' ' || {_pad(f'({_K} * 3079) % 10000000', 7)}",
    f"'acct ' || CASE {_K} % 10 WHEN 0 THEN '777777777' ELSE {_pad(f'({_K} * 86028121) % 100000000000', 11)} END",
    f"'key AKIA' || {_letters(*[f'{_K} * {m}' for m in (1, 3, 5, 7, 9, 11, 15, 17, 19, 21, 23, 25)])} || "
    f"{_pad(f'{_K} % 10000', 4)}",
    "'-----BEGIN RSA PRIVATE KEY-----'",
    f"'api_key: ' || md5(CAST({_K} AS VARCHAR(40)))",
    f"'Secret=\"x\" secret: ' || substr(md5(CAST({_K} + 1 AS VARCHAR(40))), 1, CAST(12 + {_K} % 10 AS INTEGER))",
    f"'eyJ' || md5(CAST({_K} AS VARCHAR(40))) || '.eyJ' || md5(CAST({_K} + 2 AS VARCHAR(40))) || '.' || "
    f"substr(md5(CAST({_K} + 3 AS VARCHAR(40))), 1, 20)",
    f"'Authorization: bearer ' || substr(md5(CAST({_K} + 4 AS VARCHAR(40))), 1, 24) || '='",
    f"'host 10.' || CAST({_K} % 300 AS VARCHAR(40)) || '.' || CAST({_K} % 256 AS VARCHAR(40)) || '.' || "
    f"CAST({_K} % 99 AS VARCHAR(40))",
    f"'mac ' || substr(md5(CAST({_K} AS VARCHAR(40))), 1, 2) || ':1b:2C:' || "
    f"substr(md5(CAST({_K} AS VARCHAR(40))), 3, 2) || ':4d:' || substr(md5(CAST({_K} AS VARCHAR(40))), 5, 2)",
    f"'born ' || {_pad(f'{_K} % 35', 2)} || '/' || {_pad(f'{_K} % 14', 2)} || '/' || "
    f"CAST(1950 + {_K} % 60 AS VARCHAR(40))",
    f"'uan ' || {_pad(f'({_K} * 982451653) % 1000000000000', 12)}",
    f"'esic 31' || {_pad(f'({_K} * 472882027) % 10000000000', 10)} || {_pad(f'({_K} * 7919) % 100000', 5)}",
    f"'Blood Group: ' || CASE {_K} % 4 WHEN 0 THEN 'A+' WHEN 1 THEN 'B-' WHEN 2 THEN 'O+' ELSE 'AB+' END",
    f"'ICD-10 code' || CAST({_K} % 90 AS VARCHAR(40))",
    f"'call +1 (' || CAST(200 + {_K} % 700 AS VARCHAR(40)) || ') ' || {_pad(f'{_K} % 1000', 3)} || '-' || "
    f"{_pad(f'({_K} * 17) % 10000', 4)}",
])

# Records scanned by the detection queries: texts, messages and the identity texts, with one path per record.
RECORDS_SQL = f"""
  SELECT text AS value, 'text' AS field_name, 'public.documents.' || CAST(doc_id AS VARCHAR(40)) AS source_path FROM documents
  UNION ALL
  SELECT text, 'message', 'chat://' || CAST(conv_id AS VARCHAR(40)) || '/' || CAST(turn AS VARCHAR(40)) FROM conversations
  UNION ALL
  SELECT {IDENTITY_TEXT}, CASE c_custkey % 2 WHEN 0 THEN 'account_details' ELSE 'profile' END,
         'crm.customer.' || CAST(c_custkey AS VARCHAR(40)) FROM customer"""

SQL_VIEWS = {
    "type_dim": "SELECT * FROM (VALUES " + ",".join(
        f"({i},'{t}','{p}')" for i, (t, p) in enumerate(TYPES)) + ") t(k, pii_type, pattern_name)",
    "records": RECORDS_SQL,
    "identity": f"SELECT c_custkey, {IDENTITY_TEXT} AS text FROM customer",
    "tenants": """
  SELECT r_regionkey AS tenant_id, r_name AS name, r_regionkey % 2 = 1 AS is_significant_data_fiduciary,
         CASE WHEN r_regionkey IN (0,2) THEN NULL ELSE 'gro@' || lower(r_name) || '.in' END AS gro_email FROM region""",
    "assets": """
  SELECT p_partkey AS asset_id, p_partkey % 5 AS tenant_id, p_name || '-' || p_partkey AS name,
         CASE WHEN p_partkey % 50 = 0 THEN '/shared/export.csv'
              ELSE '/' || CASE p_size % 4 WHEN 0 THEN 'prod/customer' WHEN 1 THEN 'staging/billing'
                          WHEN 2 THEN 'dev' ELSE 'test/fixtures' END
                   || '/' || lower(p_type) || '/t' || p_partkey END AS path,
         p_type AS asset_type, p_brand AS data_source, 'host-' || (p_partkey % 20) AS host,
         CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'purpose-' || p_brand END AS declared_purpose,
         CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'dpo-' || (p_partkey % 4) END AS dpo_assigned,
         CASE WHEN p_size % 9 = 0 THEN 'US' ELSE 'IN' END AS data_residency_country,
         CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size * 30 END AS retention_policy_days,
         p_partkey % 11 = 0 AS is_masked, CAST(p_size AS BIGINT) AS total_findings FROM part""",
    "scan_runs": """
  SELECT year(o_orderdate) * 100 + month(o_orderdate) AS scan_run_id,
         min(o_orderdate) AS scan_started_at, max(o_orderdate) AS scan_completed_at,
         CASE (year(o_orderdate) * 12 + month(o_orderdate)) % 7
              WHEN 6 THEN 'failed' WHEN 5 THEN 'partial' ELSE 'completed' END AS status,
         count(*) AS total_findings FROM orders GROUP BY ALL""",
    "findings": """
  SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                       CAST(round(l_extendedprice * 100) AS BIGINT))) AS finding_id,
         year(l_shipdate) * 100 + month(l_shipdate) AS scan_run_id,
         l_partkey AS asset_id, l_partkey % 5 AS tenant_id, t.pii_type, t.pattern_name,
         'v' || (l_orderkey % 500) AS matched_value,
         CASE WHEN l_quantity > 45 THEN 'Critical' WHEN l_quantity > 30 THEN 'High'
              WHEN l_quantity > 15 THEN 'Medium' ELSE 'Low' END AS severity,
         round(1 - 5 * l_discount, 2) AS confidence_score,
         CASE WHEN l_linenumber = 1 THEN 'TEST' ELSE 'PROD' END AS environment,
         l_shipdate AS created_at, l_returnflag, l_linestatus
  FROM lineitem JOIN type_dim t ON t.k = (l_partkey * 7 + l_suppkey) % 12""",
    "classifications": f"""
  SELECT finding_id, pii_type AS sub_category, confidence_score,
         CASE WHEN pii_type IN {_SENSITIVE} THEN 'Sensitive Personal Data'
              WHEN pii_type IN {_FINANCIAL} THEN 'Financial Data'
              WHEN pii_type IN {_GOVERNMENT} THEN 'Government Identifier'
              WHEN pii_type = 'IN_GST' THEN 'Non-PII' ELSE 'Personal Data' END AS classification_type,
         pii_type IN {_CONSENT} AS requires_consent
  FROM findings WHERE environment = 'PROD'""",
    "review_states": """
  SELECT finding_id, CASE l_returnflag WHEN 'R' THEN 'false_positive' ELSE 'confirmed' END AS status
  FROM findings WHERE l_returnflag IN ('R','A')""",
    "consents": """
  SELECT c_custkey AS consent_id, c_custkey AS asset_id, t.pii_type,
         TIMESTAMP '1996-01-01' + to_days(c_nationkey * 40) AS consent_obtained_at,
         CASE WHEN c_custkey % 4 = 0 THEN NULL
              ELSE TIMESTAMP '1998-10-01' + to_days(CAST(c_custkey % 200 AS INTEGER)) END AS consent_expires_at,
         CASE WHEN c_custkey % 10 = 0 THEN TIMESTAMP '1998-06-01' END AS consent_withdrawn_at
  FROM customer JOIN type_dim t ON t.k = (c_custkey * 5 + c_nationkey) % 12""",
    "data_principal_requests": """
  SELECT o_orderkey AS request_id, o_custkey % 5 AS tenant_id, o_orderdate AS created_at,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'ERASURE' WHEN '2-HIGH' THEN 'ACCESS' WHEN '3-MEDIUM' THEN 'CORRECTION'
              WHEN '4-NOT SPECIFIED' THEN 'NOMINATION' ELSE 'GRIEVANCE' END AS request_type,
         CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'IN_PROGRESS' ELSE 'COMPLETED' END AS status
  FROM orders""",
    "audit_events": """
  SELECT event_id, user_id % 5 AS tenant_id, user_id, event_type AS action, 'asset' AS resource_type,
         CAST(event_id % 97 AS VARCHAR) AS resource_id, ts AS event_time, props AS metadata FROM events""",
    "corrections": """
  SELECT l.doc_id, l.doc_id % 5 AS tenant_id, t.pattern_name AS pattern_code,
         CASE WHEN quality = 1 THEN 'confirmed' WHEN toxic = 1 THEN 'false_negative' ELSE 'false_positive' END AS correction_type
  FROM labels l JOIN type_dim t ON t.k = l.doc_id % 12""",
    "remediation_actions": """
  SELECT 'a-' || finding_id AS action_id, finding_id, created_at AS executed_at,
         CASE l_linestatus WHEN 'F' THEN 'MASK' ELSE 'DELETE' END AS action_type,
         CASE WHEN confidence_score < 0.6 THEN 'FAILED' ELSE 'COMPLETED' END AS status
  FROM findings WHERE l_returnflag = 'A'""",
    "asset_relationships": """
  SELECT asset_id AS source_asset_id, (asset_id * 3 + 1) % (SELECT count(*) FROM assets) AS target_asset_id FROM assets""",
    "agent_batches": """
  SELECT 'agent-' || (user_id % 10) AS agent_id, year(ts) * 10000 + month(ts) * 100 + day(ts) AS scan_job_id,
         event_id % 5 AS batch_seq, ts AS received_at, event_id FROM events""",
    "inventory": f"""
  SELECT a.tenant_id, a.asset_id, a.name AS asset_name, a.data_source AS source, s.classification, s.sensitivity,
         s.finding_count
  FROM assets a JOIN (
    SELECT asset_id, pattern_name AS classification, count(*) AS finding_count,
           max(CASE severity WHEN 'Critical' THEN 100 WHEN 'High' THEN 80 WHEN 'Medium' THEN 50 ELSE 20 END) AS sensitivity,
           row_number() OVER (PARTITION BY asset_id ORDER BY count(*) DESC, pattern_name) AS rn
    FROM findings GROUP BY asset_id, pattern_name) s ON s.asset_id = a.asset_id AND s.rn = 1""",
    "learned": """
  SELECT DISTINCT f.tenant_id, f.asset_id, f.pattern_name, f.pii_type, a.path AS field_path, f.matched_value
  FROM findings f JOIN review_states r USING (finding_id) JOIN assets a USING (asset_id)
  WHERE r.status = 'false_positive'""",
}


class Tables:
    """The given tables and the governance projections of one scale, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def records(self) -> DataFrame:
        from datavigil.sources.records import spread_small

        docs = spread_small(self.raw("documents")).selectExpr(
            "text AS value", "'text' AS field_name", "'public.documents.' || doc_id AS source_path")
        return docs.union(self.chat_records).union(self.crm_records)

    @cached_property
    def chat_records(self) -> DataFrame:
        return self.raw("conversations").selectExpr(
            "text AS value", "'message' AS field_name", "'chat://' || conv_id || '/' || turn AS source_path")

    @cached_property
    def crm_records(self) -> DataFrame:
        return self.identity.selectExpr(
            "text AS value", "IF(c_custkey % 2 = 0, 'account_details', 'profile') AS field_name",
            "'crm.customer.' || c_custkey AS source_path")

    @cached_property
    def identity(self) -> DataFrame:
        from datavigil.sources.records import spread_small

        return spread_small(self.raw("customer").select("c_custkey")).selectExpr("c_custkey", f"{IDENTITY_TEXT} AS text")

    @cached_property
    def tenants(self) -> DataFrame:
        return self.raw("region").selectExpr(
            "r_regionkey AS tenant_id", "r_name AS name", "r_regionkey % 2 = 1 AS is_significant_data_fiduciary",
            "IF(r_regionkey IN (0, 2), NULL, 'gro@' || lower(r_name) || '.in') AS gro_email")

    @cached_property
    def assets(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey AS asset_id", "p_partkey % 5 AS tenant_id", "p_name || '-' || p_partkey AS name",
            "CASE WHEN p_partkey % 50 = 0 THEN '/shared/export.csv' ELSE '/' || element_at(array('prod/customer',"
            " 'staging/billing', 'dev', 'test/fixtures'), p_size % 4 + 1) || '/' || lower(p_type) || '/t' || p_partkey"
            " END AS path",
            "p_type AS asset_type", "p_brand AS data_source", "'host-' || (p_partkey % 20) AS host",
            "IF(p_size % 5 = 0, NULL, 'purpose-' || p_brand) AS declared_purpose",
            "IF(p_size % 3 = 0, NULL, 'dpo-' || (p_partkey % 4)) AS dpo_assigned",
            "IF(p_size % 9 = 0, 'US', 'IN') AS data_residency_country",
            "IF(p_size % 10 = 0, NULL, p_size * 30) AS retention_policy_days",
            "p_partkey % 11 = 0 AS is_masked", "CAST(p_size AS BIGINT) AS total_findings")

    @cached_property
    def scan_runs(self) -> DataFrame:
        months = self.raw("orders").groupBy(
            F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")
        ).agg(F.min("o_orderdate").alias("scan_started_at"), F.max("o_orderdate").alias("scan_completed_at"),
              F.count("*").alias("total_findings"))
        return months.selectExpr(
            "y * 100 + m AS scan_run_id", "scan_started_at", "scan_completed_at",
            "CASE (y * 12 + m) % 7 WHEN 6 THEN 'failed' WHEN 5 THEN 'partial' ELSE 'completed' END AS status",
            "total_findings")

    @cached_property
    def findings(self) -> DataFrame:
        k = F.expr("CAST((l_partkey * 7 + l_suppkey) % 12 AS INT)")
        return self.raw("lineitem").select(
            F.expr("md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,"
                   " CAST(round(l_extendedprice * 100) AS BIGINT)))").alias("finding_id"),
            F.expr("year(l_shipdate) * 100 + month(l_shipdate)").alias("scan_run_id"),
            F.col("l_partkey").alias("asset_id"), F.expr("l_partkey % 5").alias("tenant_id"),
            F.get(F.array(*[F.lit(t) for t, _ in TYPES]), k).alias("pii_type"),
            F.get(F.array(*[F.lit(p) for _, p in TYPES]), k).alias("pattern_name"),
            F.expr("'v' || (l_orderkey % 500)").alias("matched_value"),
            F.expr("CASE WHEN l_quantity > 45 THEN 'Critical' WHEN l_quantity > 30 THEN 'High'"
                   " WHEN l_quantity > 15 THEN 'Medium' ELSE 'Low' END").alias("severity"),
            F.expr("round(1 - 5 * l_discount, 2)").alias("confidence_score"),
            F.expr("IF(l_linenumber = 1, 'TEST', 'PROD')").alias("environment"),
            F.col("l_shipdate").alias("created_at"), "l_returnflag", "l_linestatus")

    @cached_property
    def classifications(self) -> DataFrame:
        return self.findings.filter("environment = 'PROD'").selectExpr(
            "finding_id", "pii_type AS sub_category", "confidence_score",
            f"CASE WHEN pii_type IN {_SENSITIVE} THEN 'Sensitive Personal Data' WHEN pii_type IN {_FINANCIAL} THEN"
            f" 'Financial Data' WHEN pii_type IN {_GOVERNMENT} THEN 'Government Identifier' WHEN pii_type = 'IN_GST'"
            " THEN 'Non-PII' ELSE 'Personal Data' END AS classification_type",
            f"pii_type IN {_CONSENT} AS requires_consent")

    @cached_property
    def review_states(self) -> DataFrame:
        return self.findings.filter("l_returnflag IN ('R', 'A')").selectExpr(
            "finding_id", "IF(l_returnflag = 'R', 'false_positive', 'confirmed') AS status")

    @cached_property
    def consents(self) -> DataFrame:
        types = F.array(*[F.lit(t) for t, _ in TYPES])
        return self.raw("customer").select(
            F.col("c_custkey").alias("consent_id"), F.col("c_custkey").alias("asset_id"),
            F.get(types, F.expr("CAST((c_custkey * 5 + c_nationkey) % 12 AS INT)")).alias("pii_type"),
            F.expr("timestamp_ntz'1996-01-01' + make_dt_interval(c_nationkey * 40)").alias("consent_obtained_at"),
            F.expr("IF(c_custkey % 4 = 0, NULL, timestamp_ntz'1998-10-01' +"
                   " make_dt_interval(CAST(c_custkey % 200 AS INT)))").alias("consent_expires_at"),
            F.expr("IF(c_custkey % 10 = 0, timestamp_ntz'1998-06-01', NULL)").alias("consent_withdrawn_at"))

    @cached_property
    def data_principal_requests(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS request_id", "o_custkey % 5 AS tenant_id", "o_orderdate AS created_at",
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'ERASURE' WHEN '2-HIGH' THEN 'ACCESS' WHEN '3-MEDIUM' THEN"
            " 'CORRECTION' WHEN '4-NOT SPECIFIED' THEN 'NOMINATION' ELSE 'GRIEVANCE' END AS request_type",
            "CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'IN_PROGRESS' ELSE 'COMPLETED' END AS status")

    @cached_property
    def audit_events(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id", "user_id % 5 AS tenant_id", "user_id", "event_type AS action", "'asset' AS resource_type",
            "CAST(event_id % 97 AS STRING) AS resource_id", "ts AS event_time", "props AS metadata")

    @cached_property
    def corrections(self) -> DataFrame:
        names = F.array(*[F.lit(p) for _, p in TYPES])
        return self.raw("labels").select(
            "doc_id", F.expr("doc_id % 5").alias("tenant_id"),
            F.get(names, F.expr("CAST(doc_id % 12 AS INT)")).alias("pattern_code"),
            F.expr("CASE WHEN quality = 1 THEN 'confirmed' WHEN toxic = 1 THEN 'false_negative' ELSE 'false_positive'"
                   " END").alias("correction_type"))

    @cached_property
    def remediation_actions(self) -> DataFrame:
        return self.findings.filter("l_returnflag = 'A'").selectExpr(
            "'a-' || finding_id AS action_id", "finding_id", "created_at AS executed_at",
            "IF(l_linestatus = 'F', 'MASK', 'DELETE') AS action_type",
            "IF(confidence_score < 0.6, 'FAILED', 'COMPLETED') AS status")

    @cached_property
    def asset_relationships(self) -> DataFrame:
        total = self.assets.select(F.count("*").alias("n")).scalar()
        return self.assets.select(
            F.col("asset_id").alias("source_asset_id"), ((F.col("asset_id") * 3 + 1) % total).alias("target_asset_id"))

    @cached_property
    def agent_batches(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "'agent-' || (user_id % 10) AS agent_id",
            "year(ts) * 10000 + month(ts) * 100 + day(ts) AS scan_job_id", "event_id % 5 AS batch_seq",
            "ts AS received_at", "event_id")

    @cached_property
    def inventory(self) -> DataFrame:
        from datavigil.operators import discovery

        return discovery.refresh_inventory(discovery.asset_summaries(self.assets, self.findings))

    @cached_property
    def learned(self) -> DataFrame:
        return (
            self.findings.join(self.review_states.filter("status = 'false_positive'"), "finding_id", "left_semi")
            .join(self.assets.select("asset_id", F.col("path").alias("field_path")), "asset_id")
            .select("tenant_id", "asset_id", "pattern_name", "pii_type", "field_path", "matched_value").distinct())
