"""Raw and verified findings to assets, findings, classifications and review states."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datavigil.functions import masking as M
from datavigil.functions import scoring as S
from datavigil.functions import text as T
from datavigil.functions import validators as V
from datavigil.operators.grouping import earlier_count, pick_first

UNIQUE_IN_SCAN = ["asset_id", "pattern_name", "value_key", "scan_run_id"]


@dataclass
class Ingested:
    """Outputs of one ingest. All but `assets` are projections of `findings`: write that once and derive the rest."""

    assets: DataFrame
    findings: DataFrame
    classifications: DataFrame
    review_states: DataFrame


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with these columns, generated instead of projected: a filter on a projection would compute all of it again."""
    return df.drop(*columns).select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def enrich(raw: DataFrame, value: str = "match", path: str = "file_path", column: str = "column_name") -> DataFrame:
    """Context signals of a hit and their combined score."""
    signals = once(raw, {
        "asset_semantics": S.asset_semantics(path, column),
        "environment_name": S.environment(path),
        "entropy": T.shannon_entropy(value),
        "charset_diversity": T.charset_diversity(value),
    })
    return signals.withColumns({
        "token_shape": T.token_shape(value),
        "value_hash": T.value_hash(value),
        "enrichment_score": S.enrichment_score("asset_semantics", "environment_name", "entropy", "charset_diversity"),
    })


def historical_count(findings: DataFrame, order: str = "created_at", tie: str = "finding_id") -> DataFrame:
    """How often the same pattern and value was seen before, counted by day so that a common value stays spread."""
    return earlier_count(findings, ["pattern_name", "value_hash"], F.to_date(order), order, tie, name="historical_count")


def classify_multi(enriched: DataFrame, pattern: str = "pattern_name", path: str = "file_path",
                   column: str = "column_name") -> DataFrame:
    """Signals, weighted score, tier, class and the text that explains the decision."""
    signals = enriched.withColumns({
        "rule_signal": S.rule_signal(pattern, path, column),
        "context_signal": F.col("enrichment_score"),
        "entropy_signal": S.entropy_signal(pattern, "entropy", "charset_diversity"),
    })
    scored = once(signals, {
        "final_score": S.final_score("rule_signal", "context_signal", "entropy_signal", pattern),
        "classification": S.class_of_pattern(pattern)})
    tiered = scored.withColumn("confidence_tier", S.confidence_tier("final_score"))
    secret = S.is_secret_pattern(pattern)
    why = F.format_string(
        "%s (Score: %.2f, Level: %s). Signals: %s | Context: Enrichment score %.2f (env: %s, semantics: %.2f) | %s",
        "classification", "final_score", "confidence_tier", S.rule_explanation(pattern, path, column),
        "enrichment_score", "environment_name", "asset_semantics",
        F.when(secret, F.format_string("Stats: Entropy %.2f, Diversity %.2f", "entropy", "charset_diversity"))
        .otherwise("Entropy N/A for non-secrets"))
    return tiered.withColumns({
        "sub_category": S.sub_category("classification"),
        "regulation_category": S.regulation_category("classification"),
        "requires_consent": S.class_needs_consent("classification"),
        "justification": why,
        "signals": F.struct(
            *[F.struct(F.col(s).alias("raw"), (F.col(s) * w).alias("weighted"), F.lit(w).alias("weight")).alias(n)
              for s, n, w in (("rule_signal", "rule", S.WEIGHT_RULES), ("context_signal", "context", S.WEIGHT_CONTEXT),
                              ("entropy_signal", "entropy", S.WEIGHT_ENTROPY))]),
    })


def sanitize(df: DataFrame, matches: str = "matches", sample: str = "sample_text") -> DataFrame:
    """NUL characters removed from matches and sample; `nul_matches` counts the matches that held one."""
    nul = F.lit("\x00")
    return df.withColumns({
        "nul_matches": F.size(F.filter(matches, lambda m: F.contains(m, nul))),
        matches: F.transform(matches, T.strip_nul),
        sample: T.strip_nul(sample),
    })


def flag_test_data(df: DataFrame, path: str = "file_path", sample: str = "sample_text") -> DataFrame:
    """TEST environment and `ignored` status for test paths and test texts."""
    test = S.is_test_path(path) | S.is_test_text(sample)
    return df.withColumns({"environment": F.when(test, "TEST").otherwise("PROD"),
                           "review_status": F.when(test, "ignored").otherwise("pending")})


def build_assets(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One asset per stable id, described by its first row; an asset that already exists keeps its row."""
    found = rows.select(
        "asset_id", F.lit("file").alias("asset_type"), T.file_name("file_path").alias("name"),
        F.col("file_path").alias("path"), "data_source", "host",
        F.coalesce(F.col("metadata")["owner"], F.lit("Platform Team")).alias("owner"),
        S.severity_score("severity").alias("risk_score"), F.col("detected_at").alias("created_at"))
    first = pick_first(found, ["asset_id"], "created_at", "path", "risk_score")
    if existing is None:
        return first.withColumn("is_new", F.lit(True))
    known = existing.select(*first.columns).withColumn("is_new", F.lit(False))
    return known.unionByName(first.join(existing, "asset_id", "left_anti").withColumn("is_new", F.lit(True)))


def dedup_findings(findings: DataFrame) -> DataFrame:
    """One finding per asset, pattern, value and scan: the first by time, with the number of occurrences."""
    counted = findings.groupBy(*UNIQUE_IN_SCAN).agg(
        F.count("*").alias("occurrences"),
        F.min_by(F.struct(*[c for c in findings.columns if c not in UNIQUE_IN_SCAN]),
                 F.struct("detected_at", "file_path", "column_name")).alias("_first"))
    return counted.select(*UNIQUE_IN_SCAN, "occurrences", "_first.*")


def ingest(raw: DataFrame, scan_run_id, existing_assets: DataFrame | None = None,
           key: str | None = None) -> Ingested:
    """Full ingest of raw hits.

    `raw` holds `pattern_name`, `file_path`, `column_name`, `matches`, `sample_text`, `severity`, `data_source`, `host`,
    `metadata` (map) and `detected_at`. Hits that fail the format of their type, are Non-PII or score below 0.45 are left
    out of the findings, but their assets are kept.
    """
    keyed = sanitize(raw).withColumns({
        "asset_id": T.stable_id("data_source", "host", "file_path"),
        "match": T.norm_space(F.coalesce(F.get("matches", F.lit(0)), F.lit(""))),
        "scan_run_id": F.lit(scan_run_id),
    })
    named = keyed.withColumn("pii_type", V.pattern_to_type("pattern_name"))
    valid = named.filter((F.col("pii_type") == "") | V.validate_lenient("pii_type", "match"))
    decided = classify_multi(enrich(valid)).filter(
        (F.col("classification") != "Non-PII") & (F.col("final_score") >= S.MIN_CLASSIFIED))
    production = S.is_production("metadata")
    scored = flag_test_data(decided).withColumns({
        "value_key": T.finding_key(F.coalesce(F.get("matches", F.lit(0)), F.lit(""))),
        "severity": S.dynamic_severity("classification", "confidence_tier", production),
        "risk_score": S.risk_score("classification", "final_score", "enrichment_score",
                                   F.when(production, 1.0).otherwise(0.5)),
        "sample_text": M.encrypt("sample_text", key),
    })
    unique = dedup_findings(scored).withColumn("finding_id", F.sha2(F.concat_ws("|", *UNIQUE_IN_SCAN), 256))
    return Ingested(
        assets=build_assets(keyed, existing_assets),
        findings=unique.select(
            "finding_id", "scan_run_id", "asset_id", "pattern_name", "value_key", "matches", "sample_text", "severity",
            "risk_score", F.col("final_score").alias("confidence_score"), "environment", "signals", "justification",
            "enrichment_score", "token_shape", "entropy", "occurrences", F.col("detected_at").alias("created_at"),
            "classification", "sub_category", "regulation_category", "requires_consent", "review_status"),
        classifications=unique.select(
            "finding_id", F.col("classification").alias("classification_type"), "sub_category",
            F.col("final_score").alias("confidence_score"), "justification", "regulation_category", "requires_consent"),
        review_states=unique.select("finding_id", F.col("review_status").alias("status")),
    )


def ingest_verified(found: DataFrame, scan_run_id, mode: str = "full") -> DataFrame:
    """Scanner findings mapped to finding, asset key and classification in one row.

    `found` holds `pii_type`, `pattern_name`, `matched_value`, `context_excerpt`, `source_path`, `data_source`, `host`,
    `confidence`, `validators` (array) and `keywords` (array). Types out of scope and values of the wrong format go.
    """
    evidence = F.when(F.col("matched_value") != "", F.col("matched_value")).otherwise(F.col("context_excerpt"))
    accepted = found.withColumn("evidence", evidence).filter(
        V.accepted_type("pii_type") & ((F.col("evidence") == "") | V.validate_lenient("pii_type", "evidence")))
    attributes = accepted.withColumn("_t", S.type_attributes("pii_type"))
    return attributes.select(
        F.lit(scan_run_id).alias("scan_run_id"),
        T.stable_id("data_source", T.clean_host("host"), "source_path").alias("asset_id"),
        F.when(F.col("source_path") != "", F.col("source_path")).otherwise(T.display_name("data_source", "host"))
        .alias("asset_name"),
        "pattern_name", F.col("pii_type").alias("sub_category"),
        M.store_mode(F.array("evidence"), mode).alias("matches"), M.store_sample("evidence", mode).alias("sample_text"),
        F.col("_t.severity").alias("severity"),
        S.risk_score(F.col("_t.classification"), "confidence", F.lit(1.0), F.lit(0.5)).alias("risk_score"),
        F.col("confidence").alias("confidence_score"), F.col("_t.classification").alias("classification_type"),
        F.col("_t.category").alias("regulation_category"), F.col("_t.requires_consent").alias("requires_consent"),
        F.col("_t.retention").alias("retention_period"),
        S.verified_score("confidence", F.size("validators"), F.size("keywords")).alias("final_score"),
    )


def scan_totals(findings: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Findings, assets and patterns per scan, and with `assets` (`is_new`) the number of new ones in all."""
    totals = findings.groupBy("scan_run_id").agg(
        F.count("*").alias("total_findings"), F.count_distinct("asset_id").alias("total_assets"),
        F.count_distinct("pattern_name").alias("patterns_found"))
    if assets is None:
        return totals
    return totals.withColumn("assets_created", assets.select(F.count_if("is_new").alias("n")).scalar())


def asset_risk(findings: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Risk of an asset from its worst severity and its volume."""
    stats = findings.groupBy("asset_id").agg(
        F.count("*").alias("total_findings"), F.max(S.severity_rank(T.norm_severity("severity"))).alias("_worst"))
    if assets is not None:
        stats = assets.select("asset_id").join(stats, "asset_id", "left").fillna(0, ["total_findings", "_worst"])
    n, worst = F.col("total_findings"), F.col("_worst")
    score = (
        F.when(worst >= 4, 95).when((worst == 3) & (n > 3), 85).when(worst == 3, 75)
        .when(n > 10, 60).when(n > 0, 40).otherwise(10))
    return stats.select("asset_id", "total_findings", score.alias("risk_score"))


def asset_type_counts(findings: DataFrame) -> DataFrame:
    """Map of type counts per asset, aggregated before it is collected."""
    counts = findings.groupBy("asset_id", "pattern_name").agg(F.count("*").alias("n"))
    return counts.groupBy("asset_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("pattern_name", "n")))).alias("type_counts"))


def apply_tags(assets: DataFrame, tags: DataFrame, mode: str = "merge", manual_override: bool = False) -> DataFrame:
    """Tags set on assets: `merge` adds keys, `replace` drops the old ones.

    Keys with the prefix `_manual_` and keys listed in `manual_keys` keep their value unless overridden.
    """
    old = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    new = F.col("_new")
    manual = F.coalesce("manual_keys", F.array().cast("array<string>"))
    kept = F.map_filter(old, lambda k, _: k.startswith("_manual_") | F.array_contains(manual, k))
    base = old if mode == "merge" or manual_override else F.create_map().cast("map<string,string>")

    def put(a, b):
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)

    result = put(base, new)
    if not manual_override:
        result = put(result, kept)
    return (
        assets.join(tags.select("asset_id", F.col("tags").alias("_new")), "asset_id", "left")
        .withColumn("tags", F.when(new.isNull(), F.col("tags")).otherwise(result)).drop("_new"))


def backfill_confidence(findings: DataFrame, classifications: DataFrame, skip_reviewed: bool = True):
    """Old confidence values recomputed from the pattern name, then copied to the classifications.

    With `skip_reviewed` a row whose `manually_reviewed` flag is set stays as it is.
    """
    stale = F.col("confidence_score").isNull() | (F.col("confidence_score") == 0.5)
    copied = F.col("confidence_score").isin(0.5, 0.66, 1.0)
    if skip_reviewed and "manually_reviewed" in findings.columns:
        stale = stale & ~F.col("manually_reviewed")
    if skip_reviewed and "manually_reviewed" in classifications.columns:
        copied = copied & ~F.col("manually_reviewed")
    fixed = findings.withColumn("confidence_score", F.when(stale, S.backfilled_confidence("pattern_name"))
                                .otherwise(F.col("confidence_score")))
    scores = fixed.select("finding_id", F.col("confidence_score").alias("_score"))
    children = (
        classifications.join(scores, "finding_id", "left")
        .withColumn("confidence_score", F.when(copied & F.col("_score").isNotNull(), F.col("_score"))
                    .otherwise(F.col("confidence_score"))).drop("_score"))
    return fixed, children
