"""Detection: every pattern over every value in one pass, scored, gated and deduplicated."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from datavigil.functions import patterns as P
from datavigil.functions import text as T
from datavigil.functions import validators as V
from datavigil.operators.grouping import pick_first

# Words that mark a heuristic hit as test data.
TEST_WORDS = ["test", "example", "sample", "dummy", "placeholder", "12345", "00000"]

MIN_SCORE = 50
RECOGNIZER_MIN_LENGTH = 10

FINDING_COLUMNS = [
    "pii_type", "pattern_name", "matched_value", "value_hash", "score", "detector_type",
    "source_path", "field_name", "context_excerpt",
]


def detect(
    records: DataFrame,
    pii_types: list[str] | None = None,
    custom: Iterable[P.Pattern] | DataFrame = (),
    keep: list[str] = (),
) -> DataFrame:
    """Findings in field records (`value`, `field_name`, `source_path`, optional `row_context`).

    `pii_types` None runs all built-ins and an empty list runs none; custom patterns always run. `keep` carries
    record columns to the findings. Narrow apart from one case: if a custom pattern shares its type with another
    pattern, equal hits of one record are merged, which shuffles the hits (not the texts) by the whole record, the kept
    columns included; keep the row key of a source with many equal records, so that they do not meet in one task.
    Keywords look at `row_context`, or where that is null at 100 characters around the hit.
    """
    builtin = P.select_patterns(pii_types)
    if isinstance(custom, DataFrame):
        return _detect_with_table(records, builtin, custom, keep)
    return _run(records, builtin + list(custom), keep)


def detect_recognizers(
    records: DataFrame, entities: list[str] | None = None, custom: Iterable[P.Pattern] = (), keep: list[str] = ()
) -> DataFrame:
    """Recognizer pack over values of at least ten characters: fixed base score, and a flag for context words in the
    field name."""
    chosen = P.select_recognizers(entities, list(custom))
    long_enough = records.filter(F.length("value") >= RECOGNIZER_MIN_LENGTH)
    hits = _hits(long_enough, chosen, [*keep, "source_path", "field_name", "value"])
    score = _by_pattern(chosen, lambda p: F.lit(int(p.base_score * 100)))
    context = _by_pattern(chosen, lambda p: _mentions(F.lower("field_name"), p.context_keywords))
    return hits.select(
        *keep, "pii_type", "pattern_name", "matched_value", T.value_hash("matched_value").alias("value_hash"),
        score.alias("score"), F.lit("recognizer").alias("detector_type"), "source_path", "field_name",
        T.excerpt("value", "matched_value").alias("context_excerpt"), context.alias("context_match"),
    )


def global_dedup(findings: DataFrame, *order: str) -> DataFrame:
    """One finding per (type, path, hash) across sources; the first in `order` wins."""
    return pick_first(findings, ["pii_type", "source_path", "value_hash"], *order)


def decorate(findings: DataFrame, source_type: str, host: str) -> DataFrame:
    """Where a finding came from: source type, host and table."""
    return findings.withColumns({
        "data_source": F.lit(source_type),
        "host": F.lit(host),
        "table_name": T.table_of("source_path"),
    })


def score_text(value, pii_type, context=None, context_keywords=(), negative_keywords=()) -> Column:
    """Score of one value: 100 or 0 with a strict rule, else 50 plus entropy and keyword bonuses."""
    value = F.col(value) if isinstance(value, str) else value
    pii_type = F.lit(pii_type) if isinstance(pii_type, str) else pii_type
    context = F.lit("") if context is None else context
    return _keyword_effects(_base_score(value, pii_type), pii_type, context, context_keywords, negative_keywords)


def validate_patterns(table: DataFrame, regex_col: str = "regex") -> DataFrame:
    """Acceptance status of each user pattern."""
    return table.withColumn("status", P.regex_status(F.col(regex_col)))


def test_patterns(table: DataFrame, cases: DataFrame) -> DataFrame:
    """Labelled inputs run against their pattern: `pattern_id`, `regex` and `pattern_id`, `input`, `should_match`."""
    matched = F.regexp_like(F.col("input"), F.col("regex"))
    return (
        cases.join(table, "pattern_id")
        .withColumn("passed", matched == F.col("should_match"))
        .groupBy("pattern_id")
        .agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
             F.count("*").alias("total"))
        .withColumn("pass_rate", F.col("passed") / F.col("total"))
    )


def evaluate(labelled: DataFrame, findings: DataFrame, gate: float = 0.90) -> DataFrame:
    """Quality of detection against `case_id`, `expected_type`, `should_detect`; findings carry `case_id`, `pii_type`.

    A positive case is met by a finding of the expected type, a negative case fails on any finding.
    """
    found = findings.groupBy("case_id").agg(F.collect_set("pii_type").alias("types"))
    judged = labelled.join(found, "case_id", "left").select(
        "should_detect",
        F.coalesce(F.array_contains("types", F.col("expected_type")), F.lit(False)).alias("right"),
        F.coalesce(F.size("types") > 0, F.lit(False)).alias("any"),
    )
    counts = judged.agg(
        F.count_if(F.col("should_detect") & F.col("right")).alias("tp"),
        F.count_if(~F.col("should_detect") & F.col("any")).alias("fp"),
        F.count_if(~F.col("should_detect") & ~F.col("any")).alias("tn"),
        F.count_if(F.col("should_detect") & ~F.col("right")).alias("fn"),
    )
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return (
        counts.withColumns({"precision": F.coalesce(precision, F.lit(0.0)), "recall": F.coalesce(recall, F.lit(0.0))})
        .withColumn("f1", F.coalesce(F.try_divide(
            2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
        .withColumn("passed_gate", F.col("f1") >= gate)
    )


def _detect_with_table(records, builtin, table, keep):
    """Custom patterns from a table of the user's patterns, compiled into the one pass over the records."""
    rows = [
        P.custom_pattern(r["name"], r["pii_type"], r["regex"], r["context_keywords"] or (),
                         r["negative_keywords"] or ())
        for r in table.select("name", "pii_type", "regex", "context_keywords", "negative_keywords").toLocalIterator()
    ]
    return _run(records, builtin + rows, keep)


def _run(records, chosen, keep):
    """All patterns in one pass over the records, whatever their number; equal hits of one record become one finding."""
    scored = _scored(records, chosen, keep)
    types = Counter(p.pii_type for p in chosen)
    if any(p.custom and types[p.pii_type] > 1 for p in chosen):
        return _merge_equal_hits(scored, keep)
    # Two built-ins of one type never match the same text, so nothing is left to merge.
    return scored.drop("_rank", "_record")


def _merge_equal_hits(scored, keep):
    """The first pattern of each (record, type, value). Which one that is follows from the record alone, so records that
    are equal in everything agree on it and each keeps its own finding."""
    first = F.min("_rank").over(Window.partitionBy("_record", "pii_type", "value_hash"))
    return scored.withColumn("_first", first).filter("_rank = _first").select(*keep, *FINDING_COLUMNS)


def _scored(records, chosen, keep):
    """Kept hits with their score, plus `_rank` (pattern order) and `_record` (what makes a record itself)."""
    context = T.excerpt("value", "matched_value", 100)
    if "row_context" in records.columns:  # readers of texts leave it null
        context = F.coalesce("row_context", context)
    carry = [*keep, "source_path", "field_name", "value"]
    if "row_context" in records.columns:
        carry.append("row_context")
    identity = [c for c in carry if not isinstance(records.schema[c].dataType, MapType)]  # maps cannot be hashed
    # The scores pass a generator before they are filtered: a filter would be pushed below their projection and each computed
    # twice. They are not computed inside it, where Spark interprets them or puts them all into one method too large to be
    # compiled. Digits, which rules look at many times, are a column.
    types = {p.pii_type for p in chosen}
    hits, digits = _hits(records, chosen, carry), None
    if types & set(V.OF_DIGITS):
        hits, digits = hits.withColumn("_digits", V.digits_of_strict("pii_type", "matched_value")), F.col("_digits")
    based = hits.withColumn("_based", _base_score(F.col("matched_value"), F.col("pii_type"), types, digits))
    scored = based.withColumn("_base", F.explode(F.array("_based"))).filter(F.col("_base") >= MIN_SCORE)
    base = F.col("_base")
    score = base
    gated = [p for p in chosen if p.context_keywords and not p.custom]
    if gated:
        where = F.lower(F.concat(F.coalesce("field_name", F.lit("")), F.lit(" "),
                                 F.coalesce("source_path", F.lit(""))))
        for p in gated:
            score = score - F.when((F.col("pattern_name") == p.name) & ~_mentions(where, p.context_keywords), 40).otherwise(0)
    # one flat choice: nested ones would be as deep as there are patterns
    choice = F
    for rank, p in enumerate(chosen):
        if p.custom and (p.context_keywords or p.negative_keywords):
            mine = _keyword_effects(base, F.col("pii_type"), context, p.context_keywords, p.negative_keywords)
            choice = choice.when(F.col("_rank") == rank, mine)
    score = score if choice is F else choice.otherwise(score)
    return (
        scored.withColumn("_score", score.cast("int"))
        .withColumn("score", F.explode(F.array("_score")))
        .filter(F.col("score") >= MIN_SCORE)
        .select(
            *keep, "pii_type", "pattern_name", "matched_value", T.value_hash("matched_value").alias("value_hash"),
            "score", F.when(F.col("pii_type").isin(list(V.STRICT)), "math").otherwise("regex").alias("detector_type"),
            "source_path", "field_name", T.excerpt("value", "matched_value").alias("context_excerpt"),
            F.col("_rank"), F.xxhash64(*identity).alias("_record"),
        )
    )


def _hits(records: DataFrame, chosen: list[P.Pattern], carry: list[str]) -> DataFrame:
    """One row per distinct hit of a pattern in a record.

    Guards are computed first, one column each from one lower-cased text; a pattern whose guard fails costs nothing. Patterns
    of whole words share one scan for words of any of their shapes, and each word found is then held against their bodies.
    Patterns become rows of inline arrays, so the projections hold no lambda and stay in generated code.
    """
    if not chosen:
        return records.select(*carry).filter(F.lit(False)).withColumns({
            "_rank": F.lit(0), "pattern_name": F.lit(""), "pii_type": F.lit(""), "matched_value": F.lit("")})
    worded = [(rank, p) for rank, p in enumerate(chosen) if p.word]
    if len(worded) < 2:
        worded = []
    value, low = F.col("value"), F.col("_low")
    guards = sorted({p.guard for p in chosen if p.guard})
    tests = {g: P.GUARDS[g](value, low) for g in guards}
    flags = [(F.when(F.col("_digit"), test).otherwise(False) if g in P.NEED_DIGIT else test).alias(f"_g_{g}") for g, test in tests.items()]
    first = [F.lower(value).alias("_low"), *([value.rlike("[0-9]").alias("_digit")] if P.NEED_DIGIT & set(guards) else [])]
    flagged = records.select(*carry, *first).select(*carry, *flags)
    none = F.array().cast("array<string>")

    def guarded(found, names):
        if None in names:
            return found
        return F.when(reduce(lambda a, b: a | b, [F.col(f"_g_{g}") for g in sorted(names)]), found).otherwise(none)

    branches = []
    for rank, p in enumerate(chosen):
        if (rank, p) in worded:
            continue
        found = F.regexp_extract_all("value", F.lit(p.spark_regex()), F.lit(p.spark_group()))
        branches.append(F.struct(F.lit(rank).alias("_rank"), F.lit(p.name).alias("pattern_name"),
                                 F.lit(p.pii_type).alias("pii_type"), guarded(found, {p.guard}).alias("_found")))
    if worded:
        found = F.regexp_extract_all("value", F.lit(P.words_regex([p.word for _, p in worded])), F.lit(0))
        branches.append(F.struct(F.lit(-1).alias("_rank"), F.lit("").alias("pattern_name"), F.lit("").alias("pii_type"),
                                 guarded(found, {p.guard for _, p in worded}).alias("_found")))
    hits = (
        flagged.select(*carry, F.inline(F.array(*branches)))
        .filter(F.size("_found") > 0)
        .withColumn("matched_value", F.explode(F.array_distinct("_found")))
        .drop("_found")
    )
    if not worded:
        return hits
    own = F.when(F.col("_rank") >= 0, F.struct("_rank", "pattern_name", "pii_type"))
    of_words = [
        F.when((F.col("_rank") < 0) & F.col("matched_value").rlike(f"^(?:{p.word})\\z"), F.struct(
            F.lit(rank).alias("_rank"), F.lit(p.name).alias("pattern_name"), F.lit(p.pii_type).alias("pii_type")))
        for rank, p in worded]
    return hits.select(*carry, "matched_value", F.inline(F.array(own, *of_words))).filter("_rank IS NOT NULL").select(
        *carry, "_rank", "pattern_name", "pii_type", "matched_value")


def _base_score(value: Column, pii_type: Column, types=None, digits: Column | None = None) -> Column:
    valid = V.validate_strict(pii_type, value, types, digits)
    heuristic = F.when(F.lower(value).rlike("|".join(TEST_WORDS)), 0).otherwise(
        F.lit(50) + F.when(T.shannon_entropy(value) > 3.0, 20).otherwise(0))
    if types is not None and not types - set(V.STRICT):
        return F.when(valid, 100).otherwise(0)
    if types is not None and not types & set(V.STRICT):
        return heuristic
    return F.when(pii_type.isin(list(V.STRICT)), F.when(valid, 100).otherwise(0)).otherwise(heuristic)


def _keyword_effects(base: Column, pii_type: Column, context: Column, wanted, unwanted) -> Column:
    """+5 per context keyword on the heuristic path, then x 0.85 rounded down per negative keyword."""
    low = F.lower(context)
    bonus = reduce(lambda a, kw: a + F.when(F.contains(low, F.lit(kw.lower())), 5).otherwise(0), wanted, F.lit(0))
    heuristic = ~pii_type.isin(list(V.STRICT))
    score = F.when(heuristic & (base > 0), F.least(base + bonus, F.lit(100))).otherwise(base)
    if not unwanted:
        return score
    present = F.filter(F.array(*[F.lit(k.lower()) for k in unwanted]), lambda k: F.contains(low, k))
    return F.aggregate(present, score.cast("int"), lambda acc, _: F.floor(acc * F.lit(0.85)).cast("int"))


def _by_pattern(chosen, make) -> Column:
    out = F.lit(None)
    for p in chosen:
        out = F.when(F.col("pattern_name") == p.name, make(p)).otherwise(out)
    return out


def _mentions(c: Column, words) -> Column:
    return reduce(lambda a, w: a | F.contains(c, F.lit(w)), words, F.lit(False))
