"""Detection, validation and pattern queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from datavigil.functions import patterns as P
from datavigil.functions import text as T
from datavigil.functions import validators as V
from datavigil.operators import detect as D
from datavigil.plans.registry import query
from datavigil.plans.views import Tables

CUSTOM = [
    P.custom_pattern("Hex token", "CUSTOM_TOKEN", 'token = "[0-9a-f]{20,}"', ("token",), ("sandbox", "dummy")),
    P.custom_pattern("US phone", "USR_US_PHONE", r"\+1 \(\d{3}\) \d{3}-\d{4}", ("call", "phone"), ("fax", "the")),
    # Same type as the built-in mail pattern, so equal hits of one record must be merged.
    P.custom_pattern("Corporate mail", "EMAIL_ADDRESS", r"[a-z.0-9]+@corp\.co\.in"),
]


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_list(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


_D_ROWS = str(V._VERHOEFF_D)
_P_ROWS = str(V._VERHOEFF_P)


def verhoeff_sql(v):
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    fold = "0"
    for pos in range(12):
        digit = f"CAST(substr({d}, {12 - pos}, 1) AS INTEGER)"
        fold = f"{_D_ROWS}[{fold} + 1][{_P_ROWS}[{pos % 8 + 1}][{digit} + 1] + 1]"
    return f"(CASE WHEN length({d}) = 12 AND {d} >= '2' THEN {fold} = 0 ELSE false END)"


def luhn_sql(v):
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    doubled = "CASE WHEN (length(dg) - i) % 2 = 1 THEN CASE WHEN x * 2 > 9 THEN x * 2 - 9 ELSE x * 2 END ELSE x END"
    return (
        f"(length({d}) BETWEEN 13 AND 19 AND (SELECT sum({doubled}) % 10 = 0 FROM (SELECT {d} AS dg, "
        f"unnest(generate_series(1, length({d}))) AS i) s, LATERAL (SELECT CAST(substr(dg, i, 1) AS INTEGER) AS x) t))"
    )


def strict_sql(v):
    """Every strict rule, as one boolean expression per type."""
    domains = " OR ".join(f"ends_with(lower({v}), '@{d}')" for d in V.TEST_DOMAINS)
    handles = "|".join(V.UPI_HANDLES)
    provider = f"lower(split_part({v}, '@', 2))"
    bank = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    return {
        "IN_AADHAAR": verhoeff_sql(v),
        "IN_PAN": f"(regexp_full_match({v}, '[A-Z]{{5}}[0-9]{{4}}[A-Z]') AND substr({v}, 4, 1) IN {_sql_list(V.PAN_ENTITIES)})",
        "CREDIT_CARD": luhn_sql(v),
        "EMAIL_ADDRESS": f"(regexp_full_match({v}, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{{2,}}') AND NOT ({domains})"
                         f" AND split_part(lower({v}), '@', 1) NOT IN {_sql_list(V.TEST_LOCAL_PARTS)})",
        "IN_PHONE": f"regexp_full_match(regexp_replace({v}, '[^0-9+]', '', 'g'), '\\+?(?:91)?[6-9][0-9]{{9}}')",
        "IN_PASSPORT": f"regexp_full_match({v}, '[A-Z][0-9]{{7}}')",
        "IN_VOTER_ID": f"regexp_full_match({v}, '[A-Z]{{3}}[0-9]{{7}}')",
        "IN_DRIVING_LICENSE": f"(regexp_full_match({v}, '[A-Z]{{2}}[- ]?[0-9]{{2}}[- ]?[0-9]{{4,7}}')"
                              f" AND substr({v}, 1, 2) IN {_sql_list(V.LICENCE_STATES)})",
        "IN_BANK_ACCOUNT": f"(length({bank}) BETWEEN 9 AND 18 AND replace({bank}, substr({bank}, 1, 1), '') <> '')",
        "IN_IFSC": f"regexp_full_match({v}, '[A-Z]{{4}}0[A-Z0-9]{{6}}')",
        "IN_GST": f"(regexp_full_match({v}, '[0-3][0-9][A-Z]{{5}}[0-9]{{4}}[A-Z][0-9A-Z]Z[0-9A-Z]')"
                  f" AND CAST(substr({v}, 1, 2) AS INTEGER) BETWEEN 1 AND 38)",
        "IN_UPI": f"(regexp_full_match({v}, '[a-zA-Z0-9.\\-_]{{3,256}}@[a-zA-Z0-9.\\-_]+')"
                  f" AND (regexp_matches({provider}, '{handles}') OR length({provider}) BETWEEN 3 AND 20))",
    }


def entropy_sql(v):
    return (f"(SELECT -sum(n / length({v}) * log2(n / length({v}))) FROM (SELECT count(*)::DOUBLE AS n FROM "
            f"(SELECT unnest(string_split({v}, '')) AS ch) u GROUP BY ch) e)")


def _hits_sql(patterns, source="records"):
    return " UNION ALL ".join(
        f"SELECT {i} AS rk, {_q(p.name)} AS pattern_name, {_q(p.pii_type)} AS pii_type, source_path, field_name, value, "
        f"unnest(list_distinct(regexp_extract_all(value, {_q(p.regex)}, 0))) AS matched_value FROM {source}"
        for i, p in enumerate(patterns))


def findings_sql(patterns, source="records"):
    """Hits of the patterns, scored and gated the way the scanner does it."""
    m = "matched_value"
    rules = strict_sql(m)
    used = [t for t in rules if any(p.pii_type == t for p in patterns)]
    heuristic = any(p.pii_type not in rules for p in patterns)
    base = "CASE pii_type " + " ".join(
        [f"WHEN '{t}' THEN CASE WHEN {rules[t]} THEN 100 ELSE 0 END" for t in used] or ["WHEN '' THEN 0"])
    if heuristic:
        base += (f" ELSE CASE WHEN regexp_matches(lower({m}), '{'|'.join(D.TEST_WORDS)}') THEN 0 ELSE 50 + "
                 f"CASE WHEN {entropy_sql(m)} > 3.0 THEN 20 ELSE 0 END END END")
    else:
        base += " ELSE 0 END"
    effects = "base"
    for p in patterns:
        if p.custom:
            ctx = "lower(substr(value, greatest(strpos(value, matched_value) - 100, 1), " \
                  "strpos(value, matched_value) + length(matched_value) + 100 - " \
                  "greatest(strpos(value, matched_value) - 100, 1)))"
            bonus = " + ".join([f"CASE WHEN contains({ctx}, {_q(k)}) THEN 5 ELSE 0 END" for k in p.context_keywords]
                               or ["0"])
            mine = f"CASE WHEN base > 0 AND pii_type NOT IN {_sql_list(rules)} THEN least(base + {bonus}, 100) ELSE base END"
            for k in p.negative_keywords:
                mine = f"(SELECT CASE WHEN contains({ctx}, {_q(k)}) THEN CAST(floor(sc * 0.85::DOUBLE) AS INTEGER) " \
                       f"ELSE sc END FROM (SELECT {mine} AS sc) z)"
            effects = f"CASE WHEN pattern_name = {_q(p.name)} THEN {mine} ELSE {effects} END"
        elif p.context_keywords:
            seen = " OR ".join(f"contains(lower(field_name || ' ' || source_path), {_q(k)})" for k in p.context_keywords)
            effects = f"CASE WHEN pattern_name = {_q(p.name)} AND base >= 50 AND NOT ({seen}) THEN base - 40 " \
                      f"ELSE {effects} END"
    return (
        f"SELECT * FROM (SELECT *, {effects} AS score FROM (SELECT *, {base} AS base FROM "
        f"({_hits_sql(patterns, source)}) h) b) s WHERE score >= 50")


def excerpt_sql(width=50):
    at = "strpos(value, matched_value)"
    return (f"substr(value, greatest({at} - {width}, 1), {at} + length(matched_value) + {width} - "
            f"greatest({at} - {width}, 1))")


_MATH = _sql_list(V.STRICT)
_ROW = f"""source_path, field_name, pii_type, pattern_name, sha256(matched_value) AS value_hash, score,
  CASE WHEN pii_type IN {_MATH} THEN 'math' ELSE 'regex' END AS detector_type"""
_ROW_COLS = ["source_path", "field_name", "pii_type", "pattern_name", "value_hash", "score", "detector_type"]


def _register_patterns():
    for p in P.BUILTIN:
        key = "detect_" + p.name.lower().replace("+", "plus_").replace(" ", "_")

        def run(spark, sf, p=p):
            return D._run(Tables(spark, sf).records, [p], []).select(*_ROW_COLS)

        query(key, f"SELECT {_ROW} FROM ({findings_sql([p])}) f")(run)


_register_patterns()


@query("detect_summary", f"""
SELECT split_part(source_path, ':', 1) = 'chat' AS is_chat, pii_type, pattern_name, count(*) AS findings,
       count(DISTINCT source_path) AS records, CAST(sum(score) AS BIGINT) AS score_sum
FROM ({findings_sql(P.BUILTIN)}) f GROUP BY ALL""")
def detect_summary(spark, sf):
    found = D.detect(Tables(spark, sf).records)
    return found.groupBy(F.col("source_path").startswith("chat:").alias("is_chat"), "pii_type", "pattern_name").agg(
        F.count("*").alias("findings"), F.count_distinct("source_path").alias("records"),
        F.sum("score").alias("score_sum"))


_SELECTED = ["PAN", "EMAIL", "CREDIT_CARD", "IP_ADDRESS"]


@query("detect_selected_types", f"SELECT {_ROW} FROM ({findings_sql(P.select_patterns(_SELECTED))}) f")
def detect_selected_types(spark, sf):
    return D.detect(Tables(spark, sf).records, _SELECTED).select(*_ROW_COLS)


@query("detect_custom_patterns", f"""
SELECT {_ROW} FROM (
  SELECT *, row_number() OVER (PARTITION BY source_path, pii_type, matched_value ORDER BY rk) AS rn
  FROM ({findings_sql(P.select_patterns(['EMAIL']) + CUSTOM)}) f) g WHERE rn = 1""")
def detect_custom_patterns(spark, sf):
    return D.detect(Tables(spark, sf).records, ["EMAIL"], CUSTOM).select(*_ROW_COLS)


@query("detect_custom_table", f"""
SELECT {_ROW} FROM (
  SELECT *, row_number() OVER (PARTITION BY source_path, pii_type, matched_value ORDER BY rk) AS rn
  FROM ({findings_sql(CUSTOM)}) f) g WHERE rn = 1""")
def detect_custom_table(spark, sf):
    table = spark.createDataFrame(
        [(c.name, c.pii_type, c.regex, list(c.context_keywords), list(c.negative_keywords)) for c in CUSTOM],
        "name string, pii_type string, regex string, context_keywords array<string>, negative_keywords array<string>")
    return D.detect(Tables(spark, sf).records, [], table).select(*_ROW_COLS)


_RECORD_SELECTION = {"chat": ["EMAIL", "IP_ADDRESS"], "crm": ["PAN", "IFSC"]}


@query("detect_types_per_source", f"""
SELECT {_ROW} FROM ({findings_sql(P.select_patterns(_RECORD_SELECTION['chat']), "(SELECT * FROM records WHERE field_name = 'message')")}) a
UNION ALL
SELECT {_ROW} FROM ({findings_sql(P.select_patterns(_RECORD_SELECTION['crm']), "(SELECT * FROM records WHERE source_path LIKE 'crm.%')")}) b""")
def detect_types_per_source(spark, sf):
    from datavigil.sources.scan import Source, scan_all

    t = Tables(spark, sf)
    found, _ = scan_all(spark, [
        Source("chat", "chat-host", lambda s: t.chat_records, _RECORD_SELECTION["chat"]),
        Source("crm", "crm-host", lambda s: t.crm_records),
    ], pii_types=_RECORD_SELECTION["crm"])
    return found.select(*_ROW_COLS)


@query("detect_excerpts", f"""
SELECT source_path, pattern_name, sha256(matched_value) AS value_hash, {excerpt_sql()} AS context_excerpt,
       replace({excerpt_sql()}, matched_value, '[REDACTED]') AS redacted
FROM ({findings_sql(P.select_patterns(['EMAIL', 'CREDIT_CARD', 'IP_ADDRESS']))}) f""")
def detect_excerpts(spark, sf):
    found = D.detect(Tables(spark, sf).records, ["EMAIL", "CREDIT_CARD", "IP_ADDRESS"])
    return found.select("source_path", "pattern_name", "value_hash", "context_excerpt",
                        T.redact("context_excerpt", "matched_value").alias("redacted"))


@query("detect_global_dedup", f"""
SELECT pii_type, source_path, sha256(matched_value) AS value_hash, min(rk) = 0 AS from_first_source
FROM (SELECT 0 AS rk, pii_type, split_part(source_path, '.', 1) AS source_path, matched_value
      FROM ({findings_sql(P.select_patterns(['BEARER_TOKEN', 'HEALTH_RECORD', 'EMAIL']))}) f WHERE field_name = 'profile'
      UNION ALL
      SELECT 1, pii_type, split_part(source_path, '.', 1), matched_value
      FROM ({findings_sql(P.select_patterns(['BEARER_TOKEN', 'HEALTH_RECORD', 'EMAIL']))}) f) u GROUP BY ALL""")
def detect_global_dedup(spark, sf):
    found = D.detect(Tables(spark, sf).records, ["BEARER_TOKEN", "HEALTH_RECORD", "EMAIL"])
    coarse = found.withColumn("source_path", F.substring_index("source_path", ".", 1))
    both = coarse.filter("field_name = 'profile'").withColumn("source_rank", F.lit(0)).unionByName(
        coarse.withColumn("source_rank", F.lit(1)))
    return D.global_dedup(both, "source_rank", "field_name", "context_excerpt").select(
        "pii_type", "source_path", "value_hash", (F.col("source_rank") == 0).alias("from_first_source"))


@query("detect_decorated", f"""
SELECT source_path, sha256(matched_value) AS value_hash, 'crm' AS data_source, 'db-1' AS host,
       list_extract(string_split(source_path, '.'), -2) AS table_name
FROM ({findings_sql(P.select_patterns(['EMAIL']))}) f WHERE contains(source_path, '.')""")
def detect_decorated(spark, sf):
    found = D.detect(Tables(spark, sf).records.filter(F.contains("source_path", F.lit("."))), ["EMAIL"])
    return D.decorate(found, "crm", "db-1").select("source_path", "value_hash", "data_source", "host", "table_name")


def _recognizer_sql():
    parts = []
    for p in P.RECOGNIZERS:
        words = " OR ".join(f"contains(lower(field_name), {_q(w)})" for w in p.context_keywords)
        parts.append(
            f"SELECT source_path, field_name, '{p.pii_type}' AS pii_type, {int(p.base_score * 100)} AS score, "
            f"({words}) AS context_match, unnest(list_distinct(regexp_extract_all(value, {_q(p.regex)}, 0))) AS mv "
            f"FROM records WHERE length(value) >= 10")
    return "SELECT source_path, pii_type, score, context_match, sha256(mv) AS value_hash FROM (" + \
        " UNION ALL ".join(parts) + ") r"


@query("detect_recognizers", _recognizer_sql())
def detect_recognizers(spark, sf):
    return D.detect_recognizers(Tables(spark, sf).records).select(
        "source_path", "pii_type", "score", "context_match", "value_hash")
