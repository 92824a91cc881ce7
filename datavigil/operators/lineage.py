"""Exposure aggregates, the lineage graph and exposure over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from datavigil.operators.grouping import exact_avg, page
from datavigil.session import staged

MIN_CONFIDENCE = 0.45
STALE_DAYS, ORPHAN_BONUS = 90, 10

# Base risk of a type (3 critical, 2 high, 1 medium); confidence moves it by one.
BASE_RISK = {
    "IN_AADHAAR": 3,
    "IN_PAN": 3,
    "IN_PASSPORT": 3,
    "CREDIT_CARD": 3,
    "IN_BANK_ACCOUNT": 3,
    "IN_DRIVING_LICENSE": 2,
    "IN_VOTER_ID": 2,
    "IN_UPI": 2,
    "IN_IFSC": 1,
    "IN_PHONE": 2,
    "EMAIL_ADDRESS": 2,
}
LOW_CONFIDENCE, HIGH_CONFIDENCE = 0.65, 0.85
SEVERITIES = ["Critical", "High", "Medium", "Low"]


def _at(t: str):
    return F.lit(t).cast("timestamp_ntz")


def category_risk(pii_type, confidence):
    """Risk level of a type, one step down below 0.65 confidence and one step up above 0.85.

    The mean is rounded first, so that one computed elsewhere from doubles does not tip over a threshold.
    """
    base = F.lit(1)
    for name, risk in BASE_RISK.items():
        base = F.when(F.col(pii_type) == name, risk).otherwise(base)
    c = F.round(confidence, 9)
    moved = base + F.when(c < LOW_CONFIDENCE, -1).when(c > HIGH_CONFIDENCE, 1).otherwise(0)
    return F.when(moved >= 3, "Critical").when(moved == 2, "High").when(moved == 1, "Medium").otherwise("Low")


def exposure_aggregate(findings: DataFrame, classifications: DataFrame) -> DataFrame:
    """Per asset and type: findings, mean and top confidence, pattern diversity, severities and risk level."""
    first = classifications.groupBy("finding_id").agg(
        F.max(F.struct("confidence_score", "sub_category")).alias("_c")).filter(
        (F.col("_c.confidence_score") >= MIN_CONFIDENCE) & (F.col("_c.sub_category") != ""))
    rows = findings.select("finding_id", "asset_id", "pattern_name", "severity").join(first, "finding_id")
    agg = rows.groupBy("asset_id", F.col("_c.sub_category").alias("pii_type")).agg(
        F.count("*").alias("finding_count"), exact_avg("_c.confidence_score").alias("avg_confidence"),
        F.max("_c.confidence_score").alias("max_confidence"),
        F.count_distinct("pattern_name").alias("pattern_diversity"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])
    return agg.withColumn("risk_level", category_risk("pii_type", "avg_confidence"))


def lineage_nodes(assets: DataFrame, exposure: DataFrame) -> DataFrame:
    """System, asset and category nodes; a category carries the sum of its edges."""
    systems = assets.select(F.concat(F.lit("system-"), F.col("host")).alias("id"), F.lit("system").alias("type"),
                            F.col("host").alias("label")).distinct()
    items = assets.select(F.col("asset_id").cast("string").alias("id"), F.lit("asset").alias("type"),
                          F.col("name").alias("label"))
    zero = F.lit(0).cast("long").alias("finding_count")
    categories = exposure.groupBy("pii_type").agg(F.sum("finding_count").alias("finding_count")).select(
        F.col("pii_type").alias("id"), F.lit("pii_category").alias("type"), F.col("pii_type").alias("label"),
        "finding_count")
    return systems.select("*", zero).unionByName(items.select("*", zero)).unionByName(categories)


def lineage_edges(assets: DataFrame, exposure: DataFrame) -> DataFrame:
    """System owns asset, asset exposes category."""
    owns = assets.select(
        F.concat(F.lit("system-"), F.col("host")).alias("source"), F.col("asset_id").cast("string").alias("target"),
        F.lit("SYSTEM_OWNS_ASSET").alias("type"), F.lit(None).cast("long").alias("finding_count"))
    exposes = exposure.select(F.col("asset_id").cast("string").alias("source"), F.col("pii_type").alias("target"),
                              F.lit("EXPOSES").alias("type"), "finding_count")
    return owns.unionByName(exposes)


def lineage_graph(assets: DataFrame, exposure: DataFrame, host: str = "", risk_level: str = "",
                  open_windows: DataFrame | None = None) -> DataFrame:
    """System, asset and category per row, filtered by host, risk level and open exposure; totals of the category."""
    own = assets.select("asset_id", "host", F.col("name").alias("asset_name"))
    if host:
        own = own.filter(F.col("host") == host)
    edges = exposure.filter(F.col("risk_level") == risk_level) if risk_level else exposure
    if open_windows is not None:
        live = open_windows.filter("until IS NULL").select("asset_id", "pii_type").distinct()
        edges = edges.join(live, ["asset_id", "pii_type"], "left_semi")
    rows = own.join(edges.select("asset_id", "pii_type", "finding_count", "risk_level"), "asset_id", "left")
    totals = rows.filter("pii_type IS NOT NULL").groupBy("pii_type").agg(F.sum("finding_count").alias("category_total"))
    return rows.join(totals, "pii_type", "left").select(
        "host", "asset_id", "asset_name", "pii_type", "finding_count", "risk_level", "category_total")


def category_impact(assets: DataFrame, exposure: DataFrame) -> DataFrame:
    """Findings, affected assets and systems per category."""
    return exposure.join(assets.select("asset_id", "host"), "asset_id").groupBy("pii_type").agg(
        F.sum("finding_count").alias("total_findings"), F.count_distinct("asset_id").alias("affected_assets"),
        F.count_distinct("host").alias("affected_systems"))


def lineage_paths(assets, findings, classifications) -> DataFrame:
    """System, asset, finding and class of every finding that is not Non-PII."""
    classes = classifications.select("finding_id", "classification_type", "sub_category")
    return (
        findings.select("finding_id", "asset_id", "severity").join(classes, "finding_id", "left")
        .filter(F.coalesce("classification_type", F.lit("")) != "Non-PII")
        .join(assets.select("asset_id", "host", F.col("name").alias("asset_name")), "asset_id", "left")
        .select("host", "asset_id", "asset_name", "finding_id", "severity", "classification_type", "sub_category"))


def absence_closures(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Closures seen from scans: a type found in one scan of an asset's history and missing from the next scan run."""
    order = W.orderBy("scan_started_at", "scan_run_id")  # scan headers only
    runs = scans.select("scan_run_id", F.lead("scan_run_id").over(order).alias("next_run"),
                        F.lead("scan_started_at").over(order).alias("closed_at"))
    present = findings.select("asset_id", "pii_type", "scan_run_id").distinct()
    following = present.select("asset_id", "pii_type", F.col("scan_run_id").alias("next_run"))
    return present.join(runs.filter("next_run IS NOT NULL"), "scan_run_id").join(
        following, ["asset_id", "pii_type", "next_run"], "left_anti").select("asset_id", "pii_type", "closed_at")


def exposure_windows(findings: DataFrame, closures: DataFrame) -> DataFrame:
    """Intervals in which an asset exposed a type: opened by the first sighting, closed by the next closure.

    Sightings are first reduced to one row per scan, so the ordered walk of one (asset, type) has as many rows as there
    are scans and closing times, whatever the number of findings.
    """
    seen = findings.groupBy("asset_id", "pii_type", "scan_run_id").agg(
        F.min("created_at").alias("at"), F.count("*").alias("n"), F.max("created_at").alias("last_at"))
    ends = closures.select("asset_id", "pii_type", F.col("closed_at").alias("at")).distinct()
    events = seen.withColumn("closes", F.lit(0)).unionByName(
        ends.withColumn("closes", F.lit(1)), allowMissingColumns=True)
    before = W.partitionBy("asset_id", "pii_type").orderBy("at", "closes", "scan_run_id").rowsBetween(
        W.unboundedPreceding, -1)
    numbered = events.withColumn("_window", F.coalesce(F.sum("closes").over(before), F.lit(0)))
    return numbered.groupBy("asset_id", "pii_type", "_window").agg(
        F.min(F.when(F.col("closes") == 0, F.col("at"))).alias("since"),
        F.max(F.when(F.col("closes") == 1, F.col("at"))).alias("until"),
        F.min(F.when(F.col("closes") == 0, F.col("scan_run_id"))).alias("first_scan_id"),
        F.max(F.when(F.col("closes") == 0, F.col("scan_run_id"))).alias("last_scan_id"),
        F.sum("n").alias("finding_count"),
    ).filter("since IS NOT NULL").drop("_window").withColumn("duration_hours", _hours(F.col("until")))


def _hours(until):
    return F.floor((F.unix_seconds(until.cast("timestamp")) - F.unix_seconds(F.col("since").cast("timestamp"))) / 3600)


def exposures_at(windows: DataFrame, at: str) -> DataFrame:
    t = _at(at)
    return windows.filter((F.col("since") <= t) & (F.col("until").isNull() | (F.col("until") > t)))


def exposures_at_times(windows: DataFrame, times: DataFrame, horizon: str) -> DataFrame:
    """Windows open at each of many `at` times: both sides meet on the month, then the interval is tested."""
    month = F.date_trunc("month", F.col("at")).cast("date")
    last = F.least(F.coalesce("until", _at(horizon)), _at(horizon))
    spread = windows.filter(F.col("since") <= last).withColumn("_month", F.explode(F.sequence(
        F.date_trunc("month", "since").cast("date"), F.date_trunc("month", last).cast("date"),
        F.expr("interval 1 month"))))
    return times.withColumn("_month", month).join(spread, "_month").filter(
        (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("until") > F.col("at")))).drop("_month")


def active_exposures(windows: DataFrame) -> DataFrame:
    return windows.filter("until IS NULL")


def exposure_history(windows: DataFrame, asset_id, limit: int | None = None) -> DataFrame:
    rows = windows.filter(F.col("asset_id") == asset_id).withColumn("is_active", F.col("until").isNull())
    return page(rows, [F.desc("since"), "pii_type"], limit)


def exposure_duration(windows: DataFrame, as_of: str) -> DataFrame:
    """Hours a type was exposed on an asset in all; an open window runs to `as_of`."""
    end = F.coalesce("until", _at(as_of))
    return windows.filter(F.col("since") <= _at(as_of)).groupBy("asset_id", "pii_type").agg(
        F.sum(_hours(F.least(end, _at(as_of)))).alias("hours"), F.count("*").alias("windows"))


def was_compliant_at(assets: DataFrame, windows: DataFrame, at: str) -> DataFrame:
    """Assets without any open exposure at a time."""
    return assets.join(exposures_at(windows, at).select("asset_id").distinct(), "asset_id", "left_anti")


def exposure_timeline(windows: DataFrame) -> DataFrame:
    started = windows.select("asset_id", "pii_type", F.col("since").alias("event_time"),
                             F.lit("EXPOSURE_STARTED").alias("event_type"))
    ended = windows.filter("until IS NOT NULL").select("asset_id", "pii_type", F.col("until").alias("event_time"),
                                                       F.lit("EXPOSURE_ENDED").alias("event_type"))
    return started.unionByName(ended)


def _core(e: DataFrame, neighbours: int, rounds: int = 10) -> DataFrame:
    """Edges between vertices that edges enter and leave and that have so many different neighbours, again and again until
    none goes, or for `rounds` rounds; what is left over then costs time only."""
    left = None
    for _ in range(rounds):
        ends = e.select(F.col("src").alias("v"), F.col("dst").alias("w"), F.lit(1).alias("out")).union(
            e.select(F.col("dst").alias("v"), F.col("src").alias("w"), F.lit(0).alias("out")))
        # of many edges of one vertex a few numbers are enough, so they are combined on the map side
        alive = ends.groupBy("v").agg(F.min("out").alias("least"), F.max("out").alias("most"), F.min("w").alias("low"), F.max("w").alias("high"))
        alive = alive.filter("least = 0 AND most = 1" + (" AND low < high" if neighbours > 1 else "")).select("v")
        e = staged(e.join(alive.withColumnRenamed("v", "src"), "src", "left_semi").join(alive.withColumnRenamed("v", "dst"), "dst", "left_semi"))
        now = e.count()
        if now == left or not now:
            break
        left = now
    return e


def find_cycles(edges: DataFrame, max_length: int = 10, limit: int | None = None) -> DataFrame:
    """Cycles of 2 to `max_length` edges, shortest first.

    Cycles of two are pairs of opposite edges. A longer one needs, at each vertex, two different neighbours, so vertices with
    fewer are taken away first, which leaves nothing of stars and trees, however many edges their hubs have. A path starts at
    its smallest vertex and never visits a smaller one, so each cycle is found once. How far each vertex is from a start is
    worked out backwards (a row per start and vertex, not per path), and a path goes on only where it can still be back in time.
    """
    e = edges.select(F.col("source_asset_id").alias("src"), F.col("target_asset_id").alias("dst")).filter("src <> dst").distinct()
    e = _core(e, 1)
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = e.filter("src < dst").join(back, ["src", "dst"], "left_semi").select(F.array("src", "dst").alias("path"))
    e = _core(e, 2)
    if max_length > 2 and not e.isEmpty():
        # (start, at, steps): a way back from `at` over vertices above start
        ways = staged(e.filter("src > dst").select(F.col("dst").alias("start"), F.col("src").alias("at"), F.lit(1).alias("steps")))
        newest = ways
        for steps in range(2, max_length):
            grown = newest.join(e.select("src", F.col("dst").alias("at")), "at").filter("src > start").select("start", F.col("src").alias("at")).distinct()
            newest = staged(grown.join(ways, ["start", "at"], "left_anti").withColumn("steps", F.lit(steps)))
            if newest.isEmpty():
                break
            ways = ways.unionByName(newest)
        step = e.select(F.col("src").alias("last"), F.col("dst").alias("next"))
        paths = e.filter("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"))
        for length in range(2, max_length + 1):
            # length edges with the next one; the way back from there must fit in what is left
            near = ways.filter(F.col("steps") <= max_length - length + 1).select("start", F.col("at").alias("last"))
            paths = staged(paths.join(near, ["start", "last"], "left_semi"))
            if paths.isEmpty():
                break
            grown = paths.join(step, "last")
            if length > 2:
                found = found.unionByName(grown.filter("next = start").select("path"))
            paths = grown.filter((F.col("next") > F.col("start")) & ~F.array_contains("path", F.col("next"))).select(
                "start", F.col("next").alias("last"), F.concat("path", F.array("next")).alias("path"))
    return page(found.select("path", F.size("path").alias("length")), ["length", "path"], limit)


def orphan_assets(assets: DataFrame, findings: DataFrame, as_of: str, stale_days: int = STALE_DAYS) -> DataFrame:
    """Orphan flag and risk bonus of every asset: no findings, or none for the given days."""
    last = findings.groupBy("asset_id").agg(F.max("created_at").alias("last_finding_at"))
    limit = _at(as_of) - F.make_interval(days=F.lit(stale_days))
    orphan = F.coalesce(F.col("last_finding_at") < limit, F.lit(True))
    return assets.join(last, "asset_id", "left").select(
        "asset_id", "last_finding_at", orphan.alias("is_orphan"),
        F.when(orphan, ORPHAN_BONUS).otherwise(0).alias("orphan_risk_bonus"))


