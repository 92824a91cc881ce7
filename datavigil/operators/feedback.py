"""Feedback on findings, pattern quality and false-positive learning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datavigil.functions import similarity as Y
from datavigil.functions import text as T
from datavigil.operators.grouping import page, pick_first, pick_latest
from datavigil.session import staged

MIN_JUDGEMENTS, MIN_THRESHOLD, MAX_THRESHOLD, TARGET_PRECISION, MAX_FP_RATE = 10, 30, 90, 0.7, 0.30
FEEDBACK_STATUS = {"FALSE_POSITIVE": "false_positive", "CONFIRMED": "confirmed"}

# A pair can reach the overall threshold only if its values are at least this similar, as a path adds 0.3 at most.
_NEED = (Y.MIN_SIMILARITY - Y.PATH_WEIGHT) / Y.VALUE_WEIGHT
# Characters of a gram.
GRAM = 3
LEARNED_KEYS = ["asset_id", "tenant_id", "pattern_name", "pii_type"]  # that of most values first, as sorts compare by it
_SPOT = [*LEARNED_KEYS, "field_path", "matched_value"]
# Learned values of the same keys up to which a finding is held against each of them.
FEW = 32


def pattern_precision(corrections: DataFrame) -> DataFrame:
    """Confirmed and false-positive judgements per pattern, precision (1.0 without any) and distance from 0.7."""
    judged = F.col("confirmed") + F.col("false_positives")
    return corrections.groupBy("tenant_id", "pattern_code").agg(
        F.count_if(F.col("correction_type") == "confirmed").alias("confirmed"),
        F.count_if(F.col("correction_type") == "false_positive").alias("false_positives"),
    ).withColumn("precision", F.coalesce(F.try_divide("confirmed", judged), F.lit(1.0))).withColumn(
        "confidence_delta", (F.col("precision") - TARGET_PRECISION) * 100)


def threshold_overrides(corrections: DataFrame) -> DataFrame:
    """Minimum confidence per pattern once ten judgements exist: precision in percent, within 30 to 90."""
    enough = pattern_precision(corrections).filter(F.col("confirmed") + F.col("false_positives") >= MIN_JUDGEMENTS)
    percent = F.floor(F.col("precision") * 100)
    return enough.select("tenant_id", "pattern_code", F.least(
        F.greatest(percent, F.lit(MIN_THRESHOLD)), F.lit(MAX_THRESHOLD)).cast("int").alias("min_confidence_score"))


def apply_feedback(reviews: DataFrame, feedback: DataFrame) -> DataFrame:
    """Review status per finding after feedback (`finding_id`, `feedback_type`, `created_at`); the latest wins."""
    status = F.col("feedback_type")
    for name, value in FEEDBACK_STATUS.items():
        status = F.when(F.col("feedback_type") == name, value).otherwise(status)
    changes = feedback.filter(F.col("feedback_type").isin(list(FEEDBACK_STATUS))).select(
        "finding_id", status.alias("status"), F.col("created_at").alias("_at"), F.lit(1).alias("_new"))
    old = reviews.select("finding_id", "status", F.lit(None).cast("timestamp_ntz").alias("_at"), F.lit(0).alias("_new"))
    return pick_latest(old.unionByName(changes), ["finding_id"], "_new", "_at", "status").select("finding_id", "status")


def pattern_fp(patterns: DataFrame, false_positives: DataFrame) -> DataFrame:
    """False-positive count and rate per pattern; above 0.30 an active pattern is switched off.

    `patterns`: `pattern_id`, `is_active`, `match_count`; `false_positives`: `pattern_id` per report.
    """
    counted = false_positives.groupBy("pattern_id").agg(F.count("*").alias("false_positive_count"))
    rate = F.col("false_positive_count") / F.greatest("match_count", F.lit(1))
    off = F.col("is_active") & (F.col("false_positive_rate") > MAX_FP_RATE)
    return (
        patterns.join(counted, "pattern_id", "left").fillna(0, ["false_positive_count"])
        .withColumn("false_positive_rate", rate)
        .withColumn("auto_deactivated", off)
        .withColumn("is_active", F.col("is_active") & ~F.col("auto_deactivated")))


def pattern_stats(patterns: DataFrame, findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Matches, matches per completed scan (at least one) and last match per pattern."""
    completed = scans.filter("status = 'completed'").select(F.greatest(F.count("*"), F.lit(1)).alias("n")).scalar()
    seen = findings.groupBy("pattern_name").agg(
        F.count("*").alias("total_matches"), F.max("created_at").alias("last_matched_at"))
    return patterns.join(seen, "pattern_name", "left").fillna(0, ["total_matches"]).withColumn(
        "match_rate_per_scan", F.col("total_matches") / completed)


def active_patterns(patterns: DataFrame, tenant) -> DataFrame:
    return patterns.filter((F.col("tenant_id") == tenant) & F.col("is_active"))


def fp_match(findings: DataFrame, learned: DataFrame) -> DataFrame:
    """Findings that resemble a learned false positive of the same tenant, asset, pattern and type; best match each.

    `findings` has `finding_id`, `field_path`, `matched_value`; `learned` has `learned_id`, `field_path`,
    `matched_value`. Same path and value outrank the same generalized value, and that a fuzzy match (see `_judged`).
    """
    judged, crowded = _judged(findings.select("finding_id", *_SPOT), learned)
    own = judged.filter("_match IS NOT NULL").select("finding_id", "_match.*")
    return own if crowded is None else own.unionByName(crowded.select("finding_id", "_match.*"))


def _judged(findings: DataFrame, learned: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """All findings with their `_match` among the learned values of their keys where these are FEW at most, and, if some keys
    have more, the findings that match those, as rows of their own.

    A few learned values travel as one array to the findings of their keys, so findings are not shuffled by value and no pair
    is shuffled. The group limit cuts a long list before any array is made; its keys are met by equal keys (see `_indexed`).
    The arrays are staged, so that the learned values are gathered once.
    """
    known = learned.select("learned_id", *_SPOT)
    shape = Y.value_pattern("matched_value", "pii_type")
    of_keys = Window.partitionBy(*LEARNED_KEYS)
    place = F.row_number().over(of_keys.orderBy("learned_id"))
    first_of_spot = lambda e, i: F.array_position(F.col("_known")["spot"], e["spot"]) == i + 1
    entry = F.struct("learned_id", F.struct("field_path", "matched_value").alias("spot"), shape.alias("shape"))
    lists = staged(known.withColumn("_place", place).filter(F.col("_place") <= FEW + 1)
                   .withColumn("_known", F.collect_list(entry).over(of_keys)).filter("_place = 1")
                   .select(*LEARNED_KEYS, F.sort_array("_known").alias("_known"))
                   .select(*LEARNED_KEYS, F.size("_known").alias("_n"), F.filter("_known", first_of_spot).alias("_known")))
    # partitioned as the findings are if they come from a join with their assets
    few = lists.filter(F.col("_n") <= FEW).drop("_n").repartition("asset_id")
    judged = findings.join(few, LEARNED_KEYS, "left").withColumn("_match", _best_of("_known", shape)).drop("_known")
    many = lists.filter(F.col("_n") > FEW).select(*LEARNED_KEYS)
    if many.isEmpty():
        return judged, None
    crowded = _indexed(findings.select("finding_id", *_SPOT).join(many, LEARNED_KEYS, "left_semi"),
                       pick_first(known.join(many, LEARNED_KEYS, "left_semi"), _SPOT, "learned_id"))
    return judged, crowded.select("finding_id", F.struct("learned_id", "similarity", "match_type").alias("_match"))


def _best_of(known: str, shape: Column) -> Column:
    """The best match of a finding in an array of learned values, which is sorted by their ids; null without one."""
    def match(learned_id, similarity, match_type):
        return F.struct(learned_id.alias("learned_id"), similarity.alias("similarity"), match_type.alias("match_type"))

    def first(part, value, similarity, match_type):
        return T.let(F.array_position(F.col(known)[part], value), lambda at: F.when(
            at > 0, match(F.get(F.col(known)["learned_id"], at.cast("int") - 1), F.lit(similarity), F.lit(match_type))))

    def near(e):
        value = e["spot"]["matched_value"]
        longest = F.greatest(F.length("matched_value"), F.length(value))
        return F.call_function("levenshtein", F.lower("matched_value"), F.lower(value), _edits(longest)) >= 0

    def scored(e):
        spot = e["spot"]
        return F.struct(Y.overall(spot["field_path"], F.col("field_path"), spot["matched_value"], F.col("matched_value")).alias("similarity"),
                        e["learned_id"].alias("learned_id"))

    pairs = F.filter(F.transform(F.filter(known, near), scored), lambda p: p["similarity"] >= Y.MIN_SIMILARITY)
    fuzzy = T.let(F.array_max(pairs), lambda best: F.when(
        best.isNotNull(), match(best["learned_id"], best["similarity"], F.lit("fuzzy"))))
    whole = F.col(known).isNotNull() & F.col("field_path").isNotNull() & F.col("matched_value").isNotNull()
    return F.when(whole, F.coalesce(
        first("spot", F.struct("field_path", "matched_value"), 1.0, "exact"), first("shape", shape, Y.SAME_PATTERN, "pattern"), fuzzy))


def _indexed(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Matches on equal keys at every stage: same path and value, same generalized value, and for the fuzzy
    stage equal grams (see `_similar_pairs`). Only distinct values are compared, never all pairs of a group.
    """
    cells = findings.select(*_SPOT).distinct()
    shape = Y.value_pattern("matched_value", "pii_type")

    spot = _SPOT
    same = known.withColumnRenamed("learned_id", "_same")
    shapes = pick_first(known.withColumn("_shape", shape).select("learned_id", *LEARNED_KEYS, "_shape"),
                        [*LEARNED_KEYS, "_shape"], "learned_id").withColumnRenamed("learned_id", "_alike")
    looked_up = cells.join(same, spot, "left").withColumn("_shape", shape).join(shapes, [*LEARNED_KEYS, "_shape"], "left")
    exact = F.col("_same").isNotNull()
    settled = looked_up.filter(exact | F.col("_alike").isNotNull()).select(
        *spot, F.coalesce("_same", "_alike").alias("learned_id"),
        F.when(exact, 1.0).otherwise(Y.SAME_PATTERN).alias("similarity"),
        F.when(exact, "exact").otherwise("pattern").alias("match_type"))
    # Exact and pattern matches outrank fuzzy ones, so only the cells they leave over are compared by edits.
    rest = looked_up.filter(~exact & F.col("_alike").isNull()).select(*spot)
    fuzzy = pick_latest(_similar_pairs(rest, known).select(*spot, "learned_id", "similarity"), spot,
                        "similarity", "learned_id").withColumn("match_type", F.lit("fuzzy"))
    best = settled.unionByName(fuzzy)
    return findings.select("finding_id", *spot).join(best, spot).select(
        "finding_id", "learned_id", "similarity", "match_type")


def _edits(longest: Column) -> Column:
    """Edits to texts of this length, the longer of the two, that can still match."""
    return F.floor(longest * (1 - _NEED) + 1e-9).cast("int")


def _similar_pairs(cells: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs whose overall similarity reaches the threshold, found by shared grams.

    An edit changes at most GRAM grams of a text, so two texts within k edits share all but GRAM * k of them. If the grams of
    each are put in one order, the first GRAM * k + 1 of the two must meet. The order is that of a hash, so it needs no counts
    and no key is met more than its share. A text sends that many keys, about four fifths of its length. Pairs that meet must agree in length and place of the gram
    as k allows; they are then held against each other within k edits, and the score is taken of what is left.
    """
    low = F.lower("matched_value")
    padded = F.concat(F.lit("\x01" * (GRAM - 1)), low, F.lit("\x02" * (GRAM - 1)))
    most = F.floor(F.length(low) * ((1 - _NEED) / _NEED) + 1e-9).cast("int")  # edits to the longest text that can still match
    grams = F.transform(F.sequence(F.lit(1), F.length(low) + GRAM - 1), lambda i: F.struct(
        F.xxhash64(F.substr(padded, i, F.lit(GRAM))).alias("_gram"), i.alias("_at")))
    keys = F.inline(F.slice(F.sort_array(grams), F.lit(1), GRAM * most + 1))
    left = cells.select(*LEARNED_KEYS, "field_path", "matched_value", keys)
    right = known.select(*LEARNED_KEYS, "learned_id", F.col("field_path").alias("_path"), F.col("matched_value").alias("_value"),
                         keys.alias("_gram", "_place"))
    n, m = F.length("matched_value"), F.length("_value")
    edits = _edits(F.greatest(n, m))
    near = (left.join(right, [*LEARNED_KEYS, "_gram"]).filter((F.abs(n - m) <= edits) & (F.abs(F.col("_at") - F.col("_place")) <= edits))
            .select(*cells.columns, "learned_id", "_path", "_value").distinct())
    within = F.call_function("levenshtein", low, F.lower("_value"), edits)
    return near.filter(within >= 0).select(
        *cells.columns, "learned_id", Y.overall("_path", "field_path", "_value", "matched_value").alias("similarity")).filter(
        F.col("similarity") >= Y.MIN_SIMILARITY)


def suppress(findings: DataFrame, learned: DataFrame) -> DataFrame:
    """Findings without those whose id matches a learned false positive; those without an id stay."""
    judged, crowded = _judged(findings, learned)
    rows = judged if crowded is None else judged.unionByName(crowded.filter("finding_id IS NOT NULL"), allowMissingColumns=True)
    spread = F.when(F.col("finding_id").isNull(), F.xxhash64("field_path", "matched_value"))  # no id is no group
    matched = F.count("_match").over(Window.partitionBy("finding_id", spread))
    return rows.withColumn("_n", matched).filter((F.col("_n") == 0) | F.col("finding_id").isNull()).select(*findings.columns)


def fp_stats(learned: DataFrame) -> DataFrame:
    """Active learnings by type and by asset with the latest, and in all, in one pass over the table."""
    counts = F.grouping_id()
    return learned.filter("is_active").groupingSets(
        [["tenant_id", "pii_type"], ["tenant_id", "asset_id"], ["tenant_id"]], "tenant_id", "pii_type", "asset_id"
    ).agg(
        counts.alias("_g"), F.count("*").alias("patterns"),
        F.count_if(F.col("learning_type") == "false_positive").alias("false_positives"),
        F.count_if(F.col("learning_type") == "confirmed").alias("confirmed"),
        F.max("created_at").alias("latest_learning_at"),
    ).withColumn("level", F.when(F.col("_g") == 1, "type").when(F.col("_g") == 2, "asset").otherwise("total")).drop("_g")


def list_learned(learned: DataFrame, tenant, pii_type: str | None = None, asset_id=None, limit: int | None = None,
                 offset: int = 0) -> DataFrame:
    rows = learned.filter((F.col("tenant_id") == tenant) & F.col("is_active"))
    if pii_type:
        rows = rows.filter(F.col("pii_type") == pii_type)
    if asset_id is not None:
        rows = rows.filter(F.col("asset_id") == asset_id)
    return page(rows, [F.desc("created_at"), "learned_id"], limit, offset)


def longest_similar(length: int) -> int:
    """Longest text that can still match one of this length; used by tests of the segment rule."""
    return math.floor(length / _NEED + 1e-9)
