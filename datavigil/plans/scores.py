"""Queries over normalization, enrichment, classification and risk expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from datavigil.functions import scoring as S
from datavigil.functions import text as T
from datavigil.functions import validators as V
from datavigil.operators import detect as D
from datavigil.operators import ingest as I
from datavigil.plans.detection import _q, entropy_sql, findings_sql, strict_sql
from datavigil.functions import patterns as P
from datavigil.plans.registry import query
from datavigil.plans.views import Tables


def word_sql(text, words):
    return f"regexp_matches({text}, '(^|[^a-zA-Z])({'|'.join(words)})([^a-zA-Z]|$)')"


def case_sql(branches, default):
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {default} END"


# --- normalization --------------------------------------------------------------------------------------------------

_MAIL = "'User.' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '@Mail.Example.Org' ELSE '@a@b.c' END"
_RAW = "'  ' || c_name || '-' || c_mktsegment || '_x.' || chr(9) || ' ' || c_custkey || '  '"


@query("normalize_values", f"""
SELECT c_custkey,
       lower(regexp_replace({_RAW}, '[\\s\\-_.]', '', 'g')) AS dedup_form,
       trim(regexp_replace({_RAW}, '\\s+', ' ', 'g')) AS spaced,
       regexp_replace({_RAW}, '[^0-9]', '', 'g') AS digits,
       lower(CASE WHEN len(string_split({_MAIL}, '@')) = 2
             THEN replace(split_part({_MAIL}, '@', 1), '.', '') || '@' || split_part({_MAIL}, '@', 2)
             ELSE {_MAIL} END) AS mail,
       sha256(lower(replace(replace({_RAW}, ' ', ''), '-', ''))) AS finding_key
FROM customer""")
def normalize_values(spark, sf):
    c = Tables(spark, sf).raw("customer").selectExpr(
        "c_custkey", f"{_RAW.replace('chr(9)', 'char(9)')} AS raw", f"{_MAIL} AS mail")
    return c.select(
        "c_custkey", T.norm_dedup("raw").alias("dedup_form"), T.norm_space("raw").alias("spaced"),
        T.digits("raw").alias("digits"), T.norm_email("mail").alias("mail"), T.finding_key("raw").alias("finding_key"))


@query("normalize_severity", """
SELECT label, CASE WHEN lower(trim(label)) IN ('highest','critical') THEN 'Critical' WHEN lower(trim(label)) = 'high' THEN 'High'
  WHEN lower(trim(label)) IN ('medium','moderate') THEN 'Medium' WHEN lower(trim(label)) = 'low' THEN 'Low' ELSE label END AS severity,
  count(*) AS n
FROM (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN ' HIGHEST' WHEN '2-HIGH' THEN 'high ' WHEN '3-MEDIUM' THEN 'moderate'
        WHEN '4-NOT SPECIFIED' THEN 'info' ELSE 'LOW' END AS label FROM orders) GROUP BY ALL""")
def normalize_severity(spark, sf):
    label = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN ' HIGHEST' WHEN '2-HIGH' THEN 'high ' WHEN '3-MEDIUM' THEN"
                   " 'moderate' WHEN '4-NOT SPECIFIED' THEN 'info' ELSE 'LOW' END")
    return Tables(spark, sf).raw("orders").select(label.alias("label")).groupBy(
        "label", T.norm_severity("label").alias("severity")).agg(F.count("*").alias("n"))


@query("sanitize_nul", """
SELECT doc_id, md5(replace(text, ' ', '')) AS clean, CAST((length(text) - length(replace(text, ' ', '')) > 0)::INT AS BIGINT) AS nul_matches
FROM documents""")
def sanitize_nul(spark, sf):
    # Blanks are turned into NUL characters first, as the given texts hold none.
    raw = Tables(spark, sf).raw("documents").select(
        "doc_id", F.array(F.replace("text", F.lit(" "), F.lit("\x00"))).alias("matches"), F.lit("").alias("sample_text"))
    return I.sanitize(raw).select("doc_id", F.md5(F.get("matches", F.lit(0))).alias("clean"),
                                  F.col("nul_matches").cast("long").alias("nul_matches"))


# --- enrichment -----------------------------------------------------------------------------------------------------

_LOW = "lower(concat_ws(' ', path, asset_type))"
SEMANTICS = (
    "greatest(0.0, least(1.0, ((" + " + ".join(f"{word_sql(_LOW, [w])}::INT" for w in S.HIGH_RISK_WORDS) + ") * 15 - ("
    + " + ".join(f"{word_sql(_LOW, [w])}::INT" for w in S.LOW_RISK_WORDS) + ") * 25) / 100.0::DOUBLE))")
ENVIRONMENT = case_sql([(word_sql("lower(path)", w), f"'{n}'") for n, w, _ in S.ENVIRONMENTS], "'unknown'")


def env_score_sql(env):
    return case_sql([(f"{env} = '{n}'", f"{s}::DOUBLE") for n, _, s in S.ENVIRONMENTS], "0.5::DOUBLE")


def diversity_sql(v):
    return "(" + " + ".join(f"regexp_matches({v}, '{k}')::INT" for k in ("[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9]")) + \
        ") / 4.0::DOUBLE"


def enrichment_sql(semantics, env, entropy, diversity):
    return (f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {semantics} * 0.4::DOUBLE + {env_score_sql(env)} * 0.3::DOUBLE + "
            f"least({entropy} / 5.0::DOUBLE, 1.0::DOUBLE) * 0.2::DOUBLE + {diversity} * 0.1::DOUBLE))")


@query("enrich_assets", f"""
SELECT asset_id, environment, round(semantics, 4) AS semantics, diversity, shape, round(entropy, 6) AS entropy,
       round({enrichment_sql('semantics', 'environment', 'entropy', 'diversity')}, 6) AS enrichment_score
FROM (SELECT asset_id, {ENVIRONMENT} AS environment, {SEMANTICS} AS semantics, {diversity_sql('name')} AS diversity,
        {entropy_sql('name')} AS entropy,
        regexp_replace(regexp_replace(regexp_replace(substr(path, 1, 50), '[a-z]', 'l', 'g'), '[A-Z]', 'L', 'g'), '[0-9]', 'd', 'g')
          || CASE WHEN length(path) > 50 THEN '...' ELSE '' END AS shape
      FROM assets) e""")
def enrich_assets(spark, sf):
    a = Tables(spark, sf).assets
    e = I.enrich(a, value="name", path="path", column="asset_type")
    return e.select("asset_id", F.col("environment_name").alias("environment"),
                    F.round("asset_semantics", 4).alias("semantics"), F.col("charset_diversity").alias("diversity"),
                    T.token_shape("path").alias("shape"), F.round("entropy", 6).alias("entropy"),
                    F.round("enrichment_score", 6).alias("enrichment_score"))


@query("entropy_of_values", f"""
SELECT source_path, pattern_name, sha256(matched_value) AS value_hash, round({entropy_sql('matched_value')}, 6) AS entropy,
       {diversity_sql('matched_value')} AS diversity
FROM ({findings_sql(P.select_patterns(['JWT_TOKEN', 'GENERIC_SECRET', 'BEARER_TOKEN', 'EMAIL']))}) f""")
def entropy_of_values(spark, sf):
    found = D.detect(Tables(spark, sf).records, ["JWT_TOKEN", "GENERIC_SECRET", "BEARER_TOKEN", "EMAIL"])
    return found.select("source_path", "pattern_name", "value_hash",
                        F.round(T.shannon_entropy("matched_value"), 6).alias("entropy"),
                        T.charset_diversity("matched_value").alias("diversity"))


@query("historical_counts", """
SELECT finding_id, row_number() OVER (PARTITION BY pattern_name, matched_value ORDER BY created_at, finding_id) - 1 AS historical_count
FROM findings""")
def historical_counts(spark, sf):
    f = Tables(spark, sf).findings.withColumn("value_hash", T.value_hash("matched_value"))
    return I.historical_count(f).select("finding_id", "historical_count")


_TEST_PATH = ("(regexp_matches(lower(path), '/(" + "|".join(S.TEST_FOLDERS) + ")/') OR regexp_matches(lower(path), '("
              + "|".join(e.replace(".", "\\.") for e in S.TEST_ENDINGS) + ")$'))")


@query("flag_test_data", f"""
SELECT asset_id, CASE WHEN test THEN 'TEST' ELSE 'PROD' END AS environment, CASE WHEN test THEN 'ignored' ELSE 'pending' END AS review_status
FROM (SELECT asset_id, {_TEST_PATH} OR regexp_matches(lower(name), 'john doe|example|test@') OR contains(name, '1234567890') AS test FROM assets)""")
def flag_test_data(spark, sf):
    return I.flag_test_data(Tables(spark, sf).assets, "path", "name").select("asset_id", "environment", "review_status")


_HOST = ("CASE c_custkey % 4 WHEN 0 THEN 'user=u password=p dbname=db' || c_custkey || ' host=pg' || c_nationkey || ' port=5432' "
         "WHEN 1 THEN 'host=my' || c_nationkey || ' sslmode=off' WHEN 2 THEN 'ac-1-shard-00-01.cl' || c_nationkey || '.net' "
         "ELSE 'files-' || c_nationkey END")
_SOURCE = "CASE c_custkey % 4 WHEN 0 THEN 'postgresql' WHEN 1 THEN 'mysql' WHEN 2 THEN 'mongodb' ELSE 'filesystem' END"


@query("clean_hosts", f"""
SELECT c_custkey, clean, CASE WHEN src IN ('postgresql','mysql') AND regexp_extract(raw, 'dbname=(\\S+)', 1) <> ''
    THEN clean || '/' || regexp_extract(raw, 'dbname=(\\S+)', 1)
  WHEN src = 'mongodb' AND contains(clean, '.') THEN substr(clean, strpos(clean, '.') + 1) ELSE clean END AS shown,
  sha256(lower(CASE WHEN src IN ('postgresql','mysql') THEN src || '::' || clean || '::' || c_name ELSE c_name END)) AS stable_id,
  list_extract(string_split(c_mktsegment || '.' || c_name || '.' || c_custkey, '.'), -2) AS table_name
FROM (SELECT *, CASE WHEN regexp_extract(raw, 'host=(\\S+)', 1) = '' THEN raw
        WHEN regexp_extract(raw, 'port=(\\d+)', 1) = '' THEN regexp_extract(raw, 'host=(\\S+)', 1)
        ELSE regexp_extract(raw, 'host=(\\S+)', 1) || ':' || regexp_extract(raw, 'port=(\\d+)', 1) END AS clean
      FROM (SELECT *, {_HOST} AS raw, {_SOURCE} AS src FROM customer))""")
def clean_hosts(spark, sf):
    c = Tables(spark, sf).raw("customer").selectExpr("*", f"{_HOST} AS raw", f"{_SOURCE} AS src")
    return c.select("c_custkey", T.clean_host("raw").alias("clean"), T.display_name("src", "raw").alias("shown"),
                    T.stable_id("src", T.clean_host("raw"), "c_name").alias("stable_id"),
                    T.table_of(F.concat_ws(".", "c_mktsegment", "c_name", "c_custkey")).alias("table_name"))


@query("file_names", """
SELECT asset_id, list_extract(string_split(path, '/'), -1) AS file_name,
  CASE WHEN regexp_matches(lower(label), 'email|phone|ssn|passport|license|aadhaar|aadhar|pan') THEN 'pii'
       WHEN regexp_matches(lower(label), 'key|token|secret|password|api|aws') THEN 'secret'
       WHEN regexp_matches(lower(label), 'credit|card|account|bank') THEN 'financial' ELSE 'other' END AS category
FROM (SELECT *, CASE asset_id % 4 WHEN 0 THEN 'Email' WHEN 1 THEN 'API_Key' WHEN 2 THEN 'Bank' ELSE name END AS label FROM assets)""")
def file_names(spark, sf):
    label = F.expr("CASE asset_id % 4 WHEN 0 THEN 'Email' WHEN 1 THEN 'API_Key' WHEN 2 THEN 'Bank' ELSE name END")
    return Tables(spark, sf).assets.select("asset_id", T.file_name("path").alias("file_name"),
                                           S.pattern_category(label).alias("category"))


_META = ("CASE p_partkey % 6 WHEN 0 THEN 'Prod-EU' WHEN 1 THEN 'Staging' WHEN 2 THEN 'QA-2' WHEN 3 THEN 'sandbox' END",
         "CASE p_partkey % 7 WHEN 0 THEN 'test_db' WHEN 1 THEN 'sales' WHEN 2 THEN 'DevOps' END")


@query("production_flag", f"""
SELECT p_partkey, NOT (coalesce(regexp_matches(lower({_META[0]}), 'test|dev|staging|qa|sandbox'), false)
  OR coalesce(regexp_matches(lower({_META[1]}), 'test|dev'), false)) AS production FROM part""")
def production_flag(spark, sf):
    meta = F.create_map(F.lit("environment"), F.expr(_META[0]), F.lit("database"), F.expr(_META[1]))
    return Tables(spark, sf).raw("part").select("p_partkey", S.is_production(meta).alias("production"))


# --- classification -------------------------------------------------------------------------------------------------

# Pattern, path and column names that meet every rule.
NAMED = """
  SELECT finding_id, confidence_score, matched_value, severity, environment,
    CASE asset_id % 14 WHEN 0 THEN 'aadhaar' WHEN 1 THEN 'pan' WHEN 2 THEN 'credit_card' WHEN 3 THEN 'email' WHEN 4 THEN 'Phone'
      WHEN 5 THEN 'aws_key' WHEN 6 THEN 'gst' WHEN 7 THEN 'span_id' WHEN 8 THEN 'auth_token' WHEN 9 THEN 'passport'
      WHEN 10 THEN 'Credit Card Visa' WHEN 11 THEN 'company' WHEN 12 THEN 'api_key' ELSE 'upi' END AS pname,
    CASE asset_id % 5 WHEN 0 THEN '/srv/users/export' WHEN 1 THEN '/test/billing/a' WHEN 2 THEN '/data/spec' WHEN 3 THEN '/userdata/x'
      ELSE '/prod/live' END AS fpath,
    CASE asset_id % 9 WHEN 0 THEN 'apikey' WHEN 1 THEN 'pan' WHEN 2 THEN 'e-mail' WHEN 3 THEN 'mobile' ELSE 'col' END AS cname
  FROM findings"""


def rule_sql(rules, value, default):
    return case_sql([
        (word_sql("lower(pname)", r[0]) + (f" OR {word_sql('lower(cname)', r[1])}" if r[1] else ""), value(r))
        for r in rules], default)


_RISKY, _TEST = word_sql("lower(fpath)", S.RISKY_PATH), word_sql("lower(fpath)", S.TEST_PATH)
RULE = (f"least({rule_sql(S.RULES, lambda r: f'{r[2]}::DOUBLE', '0.3::DOUBLE')} * CASE WHEN {_RISKY} THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END"
        f" * CASE WHEN {_TEST} THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END, 1.0::DOUBLE)")
SECRET = f"regexp_matches(lower(pname), '{'|'.join(S.SECRET_WORDS)}')"
CLASS = case_sql([(word_sql("lower(pname)", w), f"'{c}'") for w, c in S.CLASS_WORDS], "'Non-PII'")


def named(spark, sf):
    return Tables(spark, sf).findings.selectExpr(
        "finding_id", "confidence_score", "matched_value", "severity", "environment",
        "CASE asset_id % 14 WHEN 0 THEN 'aadhaar' WHEN 1 THEN 'pan' WHEN 2 THEN 'credit_card' WHEN 3 THEN 'email' WHEN 4 THEN"
        " 'Phone' WHEN 5 THEN 'aws_key' WHEN 6 THEN 'gst' WHEN 7 THEN 'span_id' WHEN 8 THEN 'auth_token' WHEN 9 THEN"
        " 'passport' WHEN 10 THEN 'Credit Card Visa' WHEN 11 THEN 'company' WHEN 12 THEN 'api_key' ELSE 'upi' END AS pname",
        "CASE asset_id % 5 WHEN 0 THEN '/srv/users/export' WHEN 1 THEN '/test/billing/a' WHEN 2 THEN '/data/spec' WHEN 3"
        " THEN '/userdata/x' ELSE '/prod/live' END AS fpath",
        "CASE asset_id % 9 WHEN 0 THEN 'apikey' WHEN 1 THEN 'pan' WHEN 2 THEN 'e-mail' WHEN 3 THEN 'mobile' ELSE 'col' END"
        " AS cname")


_ENT = entropy_sql("matched_value")
_SIG = f"""
  SELECT *, {RULE} AS rule_signal, confidence_score AS context_signal,
    CASE WHEN {SECRET} THEN least({_ENT} / 5.0::DOUBLE, 1.0::DOUBLE) * 0.7::DOUBLE + {diversity_sql('matched_value')} * 0.3::DOUBLE
         ELSE 0.0::DOUBLE END AS entropy_signal, {SECRET} AS secret
  FROM ({NAMED}) n"""
_SCORED = f"""
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN secret
    THEN (rule_signal * 0.4::DOUBLE + context_signal * 0.3::DOUBLE + entropy_signal * 0.1::DOUBLE) / (0.4::DOUBLE + 0.3::DOUBLE + 0.1::DOUBLE)
    ELSE (rule_signal * 0.4::DOUBLE + context_signal * 0.3::DOUBLE) / (0.4::DOUBLE + 0.3::DOUBLE) END)) AS final_score
  FROM ({_SIG}) s"""


@query("classify_signals", f"""
SELECT finding_id, round(rule_signal, 6) AS rule_signal, context_signal, round(entropy_signal, 6) AS entropy_signal,
       round(final_score, 6) AS final_score,
       CASE WHEN final_score >= 0.85 THEN 'CONFIRMED' WHEN final_score >= 0.65 THEN 'HIGH_CONFIDENCE'
            WHEN final_score >= 0.45 THEN 'VALIDATED' ELSE 'NEEDS_REVIEW' END AS tier,
       {CLASS} AS classification FROM ({_SCORED}) x""")
def classify_signals(spark, sf):
    rows = named(spark, sf).withColumns({
        "enrichment_score": F.col("confidence_score"), "environment_name": F.col("environment"),
        "asset_semantics": F.lit(0.0), "entropy": T.shannon_entropy("matched_value"),
        "charset_diversity": T.charset_diversity("matched_value")})
    c = I.classify_multi(rows, "pname", "fpath", "cname")
    return c.select("finding_id", F.round("rule_signal", 6).alias("rule_signal"), "context_signal",
                    F.round("entropy_signal", 6).alias("entropy_signal"), F.round("final_score", 6).alias("final_score"),
                    F.col("confidence_tier").alias("tier"), "classification")


@query("classify_decisions", f"""
SELECT pname, cname, fpath, classification, CASE classification WHEN 'Secrets' THEN 'API Keys & Secrets'
    WHEN 'Sensitive Personal Data' THEN 'Government ID / Financial Data' WHEN 'Personal Data' THEN 'Contact Information' ELSE 'Other' END AS sub_category,
  CASE WHEN classification IN ('Sensitive Personal Data','Personal Data') THEN classification ELSE 'N/A' END AS category,
  classification IN ('Sensitive Personal Data','Personal Data') AS consent, explanation, count(*) AS findings
FROM (SELECT *, {CLASS} AS classification, 'Rules: ' || {rule_sql(S.RULES, lambda r: _q(r[3]), _q(S.NO_RULE[1]))}
        || CASE WHEN {_RISKY} THEN ' + high-risk path context' ELSE '' END
        || CASE WHEN {_TEST} THEN ' (reduced: test data)' ELSE '' END AS explanation FROM ({NAMED}) n) c GROUP BY ALL""")
def classify_decisions(spark, sf):
    cls = S.class_of_pattern("pname")
    return named(spark, sf).withColumn("classification", cls).groupBy(
        "pname", "cname", "fpath", "classification", S.sub_category("classification").alias("sub_category"),
        S.regulation_category("classification").alias("category"),
        S.class_needs_consent("classification").alias("consent"),
        S.rule_explanation("pname", "fpath", "cname").alias("explanation")).agg(F.count("*").alias("findings"))


def _simple(i, default, value=None):
    return rule_sql(S.SIMPLE_RULES, lambda r: (value or _q)(r[i]), default)


@query("classify_single_pass", f"""
SELECT finding_id, classification, sub_category, round(least((score + CASE WHEN {_RISKY} THEN 0.05 ELSE 0 END)
    * CASE WHEN {_TEST} THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END, 1.0), 6) AS score, requires_consent,
  why || CASE WHEN {_RISKY} THEN ' + Found in high-risk context' ELSE '' END || CASE WHEN {_TEST} THEN ' (Reduced: Test Data)' ELSE '' END AS justification
FROM (SELECT *, {_simple(2, "'Non-PII'")} AS classification, {_simple(3, "'Other'")} AS sub_category,
        {_simple(4, '0.5::DOUBLE', lambda v: f'{v}::DOUBLE')} AS score, {_simple(5, 'false', lambda v: str(v).lower())} AS requires_consent,
        {_simple(6, "''")} AS why FROM ({NAMED}) n) s""")
def classify_single_pass(spark, sf):
    r = named(spark, sf).withColumn("r", S.classify_simple("pname", "fpath", "cname"))
    return r.select("finding_id", "r.classification", "r.sub_category", F.round("r.score", 6).alias("score"),
                    "r.requires_consent", "r.justification")


def map_sql(i, default):
    return case_sql([(f"pii_type = '{r[0]}'", _q(r[i]) if isinstance(r[i], str) else str(r[i]).lower())
                     for r in S.TYPE_MAP], default)


@query("type_attributes", f"""
SELECT pii_type, {map_sql(1, "'Personal Data'")} AS classification, {map_sql(2, "'General Personal Data'")} AS category,
  {map_sql(3, 'false')} AS requires_consent, {map_sql(4, "'High'")} AS severity,
  CASE WHEN {map_sql(3, 'false')} THEN '7 years (financial/tax compliance)' ELSE '3 years (general data retention)' END AS retention,
  count(*) AS findings FROM findings GROUP BY ALL""")
def type_attributes(spark, sf):
    f = Tables(spark, sf).findings.groupBy("pii_type").agg(F.count("*").alias("findings"))
    return f.withColumn("a", S.type_attributes("pii_type")).select("pii_type", "a.*", "findings")


@query("risk_scores", f"""
SELECT finding_id, floor(round((class_w * 0.4 + least(1, greatest(0, confidence_score)) * 0.2 + (l_q % 11) / 10.0::DOUBLE * 0.2
    + CASE WHEN environment = 'PROD' THEN 1.0 ELSE 0.5 END * 0.2) * 100, 6) + 0.5)::DOUBLE AS score,
  CASE WHEN floor(round((class_w * 0.4 + least(1, greatest(0, confidence_score)) * 0.2 + (l_q % 11) / 10.0::DOUBLE * 0.2
    + CASE WHEN environment = 'PROD' THEN 1.0 ELSE 0.5 END * 0.2) * 100, 6) + 0.5) >= 80 THEN 'Critical'
   WHEN floor(round((class_w * 0.4 + least(1, greatest(0, confidence_score)) * 0.2 + (l_q % 11) / 10.0::DOUBLE * 0.2
    + CASE WHEN environment = 'PROD' THEN 1.0 ELSE 0.5 END * 0.2) * 100, 6) + 0.5) >= 60 THEN 'High'
   WHEN floor(round((class_w * 0.4 + least(1, greatest(0, confidence_score)) * 0.2 + (l_q % 11) / 10.0::DOUBLE * 0.2
    + CASE WHEN environment = 'PROD' THEN 1.0 ELSE 0.5 END * 0.2) * 100, 6) + 0.5) >= 40 THEN 'Medium' ELSE 'Low' END AS tier,
  least(greatest(floor(round(class_w * 60 + CASE WHEN confidence_score >= 0.85 THEN 1.0 WHEN confidence_score >= 0.65 THEN 0.75
    WHEN confidence_score >= 0.45 THEN 0.5 ELSE 0.3 END * 20 + CASE WHEN environment = 'PROD' THEN 1.0 ELSE 0.3 END * 20, 6)), 0), 100)::INT AS comprehensive
FROM (SELECT f.*, f.asset_id AS l_q, CASE WHEN c IN ('Sensitive Personal Data','Financial Data','Government Identifier') THEN 1.0::DOUBLE
        WHEN c = 'Personal Data' THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END AS class_w
      FROM (SELECT *, {map_sql(1, "'Personal Data'")} AS c FROM findings) f) w""")
def risk_scores(spark, sf):
    f = Tables(spark, sf).findings.withColumn("c", S.type_attributes("pii_type")["classification"])
    prod = F.col("environment") == "PROD"
    density = (F.col("asset_id") % 11) / F.lit(10.0)
    s = f.withColumn("score", S.risk_score("c", "confidence_score", density, F.when(prod, 1.0).otherwise(0.5)))
    return s.select("finding_id", "score", S.risk_tier("score").alias("tier"),
                    S.comprehensive_risk("c", S.confidence_tier("confidence_score"), prod).alias("comprehensive"))


@query("dynamic_severities", """
SELECT finding_id, CASE class WHEN 'Sensitive Personal Data' THEN CASE WHEN sure AND prod THEN 'Critical' WHEN sure OR prod THEN 'High' ELSE 'Medium' END
   WHEN 'Personal Data' THEN CASE WHEN sure AND prod THEN 'Medium' ELSE 'Low' END
   WHEN 'Secrets' THEN CASE WHEN sure AND prod THEN 'Critical' WHEN prod THEN 'High' ELSE 'Medium' END ELSE 'Info' END AS new_severity,
   CASE severity WHEN 'Critical' THEN 95 WHEN 'High' THEN 80 WHEN 'Medium' THEN 60 WHEN 'Low' THEN 30 ELSE 10 END AS severity_score
FROM (SELECT finding_id, severity, confidence_score >= 0.85 AS sure, environment = 'PROD' AS prod,
        CASE pattern_name WHEN 'aadhaar' THEN 'Sensitive Personal Data' WHEN 'pan' THEN 'Sensitive Personal Data' WHEN 'email' THEN 'Personal Data'
          WHEN 'phone' THEN 'Personal Data' WHEN 'upi' THEN 'Secrets' ELSE 'Non-PII' END AS class FROM findings)""")
def dynamic_severities(spark, sf):
    cls = F.expr("CASE pattern_name WHEN 'aadhaar' THEN 'Sensitive Personal Data' WHEN 'pan' THEN 'Sensitive Personal Data'"
                 " WHEN 'email' THEN 'Personal Data' WHEN 'phone' THEN 'Personal Data' WHEN 'upi' THEN 'Secrets' ELSE"
                 " 'Non-PII' END")
    return Tables(spark, sf).findings.select(
        "finding_id", S.dynamic_severity(cls, S.confidence_tier("confidence_score"), F.col("environment") == "PROD")
        .alias("new_severity"), S.severity_score("severity").alias("severity_score"))


_BACKFILL = case_sql([(f"regexp_matches(lower(pattern_name), '{'|'.join(w)}')", f"{v}::DOUBLE") for w, v in S.BACKFILL],
                     f"{S.BACKFILL_DEFAULT}::DOUBLE")


@query("confidence_backfill", f"""
SELECT f.finding_id, f.new_score AS finding_score, CASE WHEN c.confidence_score IN (0.5, 0.66, 1.0) AND NOT (f.asset_id % 3 = 0) THEN f.new_score ELSE c.confidence_score END AS class_score
FROM (SELECT *, CASE WHEN (confidence_score IS NULL OR confidence_score = 0.5) AND NOT (asset_id % 3 = 0) THEN {_BACKFILL} ELSE confidence_score END AS new_score FROM findings) f
JOIN classifications c USING (finding_id)""")
def confidence_backfill(spark, sf):
    t = Tables(spark, sf)
    reviewed = t.findings.withColumn("manually_reviewed", F.col("asset_id") % 3 == 0)
    classes = t.classifications.join(reviewed.select("finding_id", "manually_reviewed"), "finding_id")
    fixed, children = I.backfill_confidence(reviewed, classes)
    return fixed.select("finding_id", F.col("confidence_score").alias("finding_score")).join(
        children.select("finding_id", F.col("confidence_score").alias("class_score")), "finding_id")


# --- validators -----------------------------------------------------------------------------------------------------

_PIECES = [("IN_AADHAAR", 1), ("IN_PAN", 2), ("CREDIT_CARD", 3), ("CREDIT_CARD", 5), ("EMAIL_ADDRESS", 7), ("IN_PHONE", 8),
           ("IN_PHONE", 9), ("IN_GST", 10), ("IN_UPI", 11), ("IN_IFSC", 12), ("IN_PASSPORT", 13), ("IN_VOTER_ID", 14),
           ("IN_DRIVING_LICENSE", 15), ("IN_BANK_ACCOUNT", 16)]
# The values after the label of each piece of the identity text; the licence and phone pieces keep their separators.
_VALUES = " UNION ALL ".join(
    f"SELECT c_custkey, '{t}' AS pii_type, {i} AS piece, regexp_replace(list_extract(string_split(text, ' | '), {i}), '^[^ ]+ |,$', '', 'g') AS v FROM identity"
    for t, i in _PIECES)


def identity_values(spark, sf):
    parts = F.split("text", r" \| ")
    cells = F.array(*[F.struct(F.lit(t).alias("pii_type"), F.lit(i).alias("piece"), F.regexp_replace(
        F.get(parts, F.lit(i - 1)), r"^[^ ]+ |,\z", "").alias("v")) for t, i in _PIECES])
    return Tables(spark, sf).identity.select("c_custkey", F.inline(cells))


def _strict_case():
    rules = strict_sql("v")
    return "CASE pii_type " + " ".join(f"WHEN '{t}' THEN {r}" for t, r in rules.items()) + " END"


@query("validate_strict", f"SELECT c_custkey, pii_type, piece, v, {_strict_case()} AS valid FROM ({_VALUES}) x")
def validate_strict(spark, sf):
    return identity_values(spark, sf).withColumn("valid", V.validate_strict("pii_type", "v"))


_LOCAL = "regexp_extract(v, '(?s)^(.*)@', 1)"
_DOMAIN = "list_extract(string_split(v, '@'), -1)"
LENIENT_SQL = {
    "CREDIT_CARD": strict_sql("v")["CREDIT_CARD"],
    "IN_AADHAAR": strict_sql("v")["IN_AADHAAR"],
    "IN_PAN": "regexp_full_match(upper(trim(v)), '[A-Z]{5}[0-9]{4}[A-Z]')",
    "EMAIL_ADDRESS": f"(contains(v, '@') AND length({_LOCAL}) BETWEEN 1 AND 64 AND length({_DOMAIN}) >= 3 AND contains({_DOMAIN}, '.') "
                     f"AND NOT regexp_matches({_DOMAIN}, '^[.-]|[.-]$'))",
    "IN_PHONE": "regexp_full_match(regexp_replace(v, '[^0-9]', '', 'g'), '(91)?[6-9][0-9]{9}')",
    "IN_UPI": "regexp_full_match(v, '[a-zA-Z0-9._-]+@[a-zA-Z][a-zA-Z0-9]*')",
    "IN_IFSC": "regexp_full_match(upper(v), '[A-Z]{4}0[A-Z0-9]{6}')",
    "IN_PASSPORT": "regexp_full_match(upper(v), '[A-Z][0-9]{7}')",
    "IN_VOTER_ID": "regexp_full_match(upper(v), '[A-Z]{3}[0-9]{7}')",
    "IN_DRIVING_LICENSE": "(length(translate(upper(v), '- ', '')) BETWEEN 13 AND 16 AND regexp_full_match(upper(v), '[A-Z]{2}[\\s-]?[0-9]{2}[\\s-]?[0-9]{4}[\\s-]?[0-9]{7}'))",
    "IN_BANK_ACCOUNT": "length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 9 AND 18",
}
_LENIENT_CASE = "CASE pii_type " + " ".join(f"WHEN '{t}' THEN {r}" for t, r in LENIENT_SQL.items()) + " ELSE true END"


@query("validate_lenient", f"""
SELECT c_custkey, pii_type, piece, {_LENIENT_CASE} AS valid, pii_type IN ({', '.join(_q(t) for t in V.ACCEPTED_TYPES)}) AS accepted
FROM (SELECT c_custkey, pii_type, piece, CASE WHEN c_custkey % 2 = 0 THEN lower(v) ELSE v END AS v FROM ({_VALUES}) x) y""")
def validate_lenient(spark, sf):
    v = identity_values(spark, sf).withColumn("v", F.expr("IF(c_custkey % 2 = 0, lower(v), v)"))
    return v.select("c_custkey", "pii_type", "piece", V.validate_lenient("pii_type", "v").alias("valid"),
                    V.accepted_type("pii_type").alias("accepted"))


_NAMES = case_sql([(f"regexp_matches(lower(pname), '{'|'.join(w)}')", f"'{t}'") for w, t in V._NAME_WORDS], "''")


@query("pattern_types", f"SELECT pname, {_NAMES} AS pii_type, count(*) AS findings FROM ({NAMED}) n GROUP BY ALL")
def pattern_types(spark, sf):
    return named(spark, sf).groupBy("pname", V.pattern_to_type("pname").alias("pii_type")).agg(
        F.count("*").alias("findings"))
