"""Continuous detection, idempotent intake, late data and running totals.

State is kept in `checkpointLocation`; batch size is set on the source (`maxOffsetsPerTrigger`, `maxFilesPerTrigger`).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from datavigil.functions.patterns import Pattern
from datavigil.operators import detect as D

DEFAULT_WINDOW, DEFAULT_BATCH = "60 seconds", 500
DEFAULT_TIMEOUT_MINUTES, STALL_HOURS = 30, 2

# Scan states and the ones that may follow them.
TRANSITIONS = {
    "pending": ["running", "cancelled", "failed"],
    "running": ["completed", "partial", "failed", "cancelled", "timeout"],
    "completed": [],
    "partial": [],
    "failed": [],
    "cancelled": [],
    "timeout": [],
}
_STATUSES = list(TRANSITIONS)
# Whether the state of a row may be followed by that of a column.
_FOLLOWS = np.array([[b in after for b in _STATUSES] for after in TRANSITIONS.values()])
# Groups of scans whose states are kept together.
STATE_BUCKETS = 1024
FINISHED = ["completed", "cancelled"]
DEDUP_KEYS = ["agent_id", "scan_job_id", "batch_seq"]


def stream_kafka(spark: SparkSession, brokers: str, topics: str, max_offsets: int = DEFAULT_BATCH) -> DataFrame:
    """Topic messages as records, path with partition and offset. Needs the Kafka connector package."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topics)
        .option("maxOffsetsPerTrigger", max_offsets).option("startingOffsets", "earliest").load())
    return kafka_records(raw)


def kafka_records(raw: DataFrame) -> DataFrame:
    place = F.format_string("kafka://%s/%d/%d", "topic", "partition", "offset")
    return raw.select(F.col("value").cast("string").alias("value"), F.coalesce(F.col("key").cast("string"),
                      F.lit("message")).alias("field_name"), place.alias("source_path"), F.col("timestamp").alias("ts"))


def stream_kinesis(spark: SparkSession, stream: str, region: str, **options: str) -> DataFrame:
    """Stream records with shard and sequence number in the path. Needs a Kinesis source on the class path."""
    raw = spark.readStream.format("kinesis").options(streamName=stream, region=region, **options).load()
    place = F.concat_ws("/", F.lit(f"kinesis:/{stream}"), "shardId", "sequenceNumber")
    return raw.select(F.col("data").cast("string").alias("value"), F.col("partitionKey").alias("field_name"),
                      place.alias("source_path"), F.col("approximateArrivalTimestamp").alias("ts"))


def stream_files(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(folder)


def detect_stream(stream: DataFrame, pii_types: list[str] | None = None, custom: Iterable[Pattern] = (),
                  keep: list[str] = ()) -> DataFrame:
    """Findings of a stream of records. Detection is narrow, so it needs no state and no watermark."""
    return D.detect(stream, pii_types, custom, keep)


def start(df: DataFrame, path: str, checkpoint: str, trigger: str | None = DEFAULT_WINDOW, mode: str = "append",
          fmt: str = "parquet") -> DataStreamWriter:
    """Start a query that resumes from its checkpoint; trigger None works off what is there and stops."""
    writer = df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).option("path", path)
    writer = writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)
    return writer.start()


def dedup_batches(stream: DataFrame, event_time: str = "received_at", delay: str = "1 day") -> DataFrame:
    """Each (agent, job, batch) once within the watermark. A repeat after that is caught by `not_seen` on the table."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(DEDUP_KEYS)


def not_seen(batches: DataFrame, log: DataFrame, order: str = "received_at") -> DataFrame:
    """Batch twin: the first of each key, without keys that the permanent log holds."""
    rest = [c for c in batches.columns if c not in DEDUP_KEYS]
    first = batches.groupBy(*DEDUP_KEYS).agg(F.min_by(F.struct(*rest), F.struct(order, *rest)).alias("_f")).select(
        *DEDUP_KEYS, "_f.*")
    return first.join(log.select(*DEDUP_KEYS), DEDUP_KEYS, "left_anti")


def mark_late(batches: DataFrame, scans: DataFrame) -> DataFrame:
    """`arrived_late` for a batch whose scan has finished, `received` otherwise; works on streams as well."""
    state = scans.select(F.col("scan_run_id").alias("scan_job_id"), F.col("status").alias("_status"))
    late = F.coalesce(F.col("_status").isin(FINISHED), F.lit(False))
    return batches.join(state, "scan_job_id", "left").withColumn(
        "batch_status", F.when(late, "arrived_late").otherwise("received")).drop("_status")


def stream_totals(found: DataFrame) -> DataFrame:
    """Running findings and records per source; write in `update` or `complete` mode."""
    return found.groupBy("data_source").agg(
        F.count("*").alias("findings"), F.approx_count_distinct("source_path").alias("records"))


def window_counts(rows: DataFrame, length: str = DEFAULT_WINDOW, event_time: str = "ts", by: str = "pii_type",
                  delay: str | None = None) -> DataFrame:
    """Rows per tumbling window and type, in a stream (give `delay`) or a batch."""
    if delay:
        rows = rows.withWatermark(event_time, delay)
    return rows.groupBy(F.window(event_time, length), by).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("window_start"), by, "n")


def transitions(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Every requested step (`scan_run_id`, `seq`, `status`, `at`) with the state it met and whether it was allowed.

    A scan is `pending` at first, or in the state that `before` (`scan_run_id`, `status`) has for it.

    A refused step leaves the state as it was. A scan leaves `pending` with the first step allowed there, and `running`
    with the first allowed one after that, so the state at any step follows from two minimums per scan.
    """
    place = F.struct("at", "seq")
    if before is not None:
        events = events.join(before.select("scan_run_id", F.col("status").alias("_before")), "scan_run_id", "left")
    began = F.coalesce(F.col("_before") if before is not None else F.lit(None).cast("string"), F.lit("pending"))
    events = events.withColumn("_began", began)
    first = events.filter((F.col("_began") == "pending") & F.col("status").isin(TRANSITIONS["pending"])).groupBy("scan_run_id").agg(
        F.min(F.struct(place.alias("place"), F.col("status").alias("to"))).alias("_first"))
    met = events.join(first, "scan_run_id", "left")
    second = met.filter(
        ((F.col("_began") == "running") | (F.col("_first.to") == "running") & (place > F.col("_first.place")))
        & F.col("status").isin(TRANSITIONS["running"])).groupBy("scan_run_id").agg(
        F.min(F.struct(place.alias("place"), F.col("status").alias("to"))).alias("_second"))
    state = (
        F.when(place > F.col("_second.place"), F.col("_second.to")).when(place > F.col("_first.place"), F.col("_first.to"))
        .otherwise(F.col("_began")))
    allowed = F.lit(False)
    for old, following in TRANSITIONS.items():
        if following:
            allowed = allowed | ((F.col("from_status") == old) & F.col("status").isin(following))
    return met.join(second, "scan_run_id", "left").withColumn("from_status", state).select(
        "scan_run_id", "seq", "from_status", F.col("status").alias("to_status"), allowed.alias("allowed"))


def apply_transitions(stream: DataFrame, buckets: int = STATE_BUCKETS) -> DataFrame:
    """Streaming life cycle: the state of each scan is kept, refused steps leave it as it was.

    Scans are kept together in buckets of a hash of their id, all scans of a bucket in arrays that one call advances, as a call
    for each scan costs about a millisecond. A micro-batch reads and writes the buckets of its scans. The number of buckets is
    part of the state: a stream must be resumed with the one it was started with.
    """
    bucket = F.when(F.col("scan_run_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("scan_run_id"), F.lit(buckets)))
    rows = stream.select(
        bucket.alias("bucket"), F.coalesce(F.col("scan_run_id").cast("long"), F.lit(0)).alias("scan"), "at",
        F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), F.col("seq").isNull().alias("unnumbered"), "status")
    return rows.groupBy("bucket").applyInPandasWithState(
        _advance, "scan_run_id long, seq long, from_status string, to_status string, allowed boolean",
        "scans binary, statuses binary", "append", GroupStateTimeout.NoTimeout)


def _advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Steps of the scans of one bucket in one micro-batch; steps without a scan are those of one scan, in a bucket of its own."""
    rows = pd.concat(list(batches)).sort_values(["scan", "at", "unnumbered", "seq"], ignore_index=True)
    wanted = pd.Categorical(rows["status"], categories=_STATUSES).codes  # -1 for what is no status
    scans, start, place = np.unique(rows["scan"].to_numpy(), return_index=True, return_inverse=True)
    ids, statuses = np.empty(0, "<i8"), np.empty(0, np.int8)
    if state.exists:
        ids, statuses = (np.frombuffer(part, kind) for part, kind in zip(state.get, ("<i8", np.int8), strict=True))
    known = np.isin(scans, ids)
    before = np.full(len(scans), _STATUSES.index("pending"), np.int8)
    before[known] = statuses[np.searchsorted(ids, scans[known])]

    # A scan changes its state twice at most; each round settles one change of every scan.
    n = len(rows)
    current, at, allowed, live = before[place], np.arange(n), np.zeros(n, bool), np.ones(n, bool)
    while True:
        may = np.flatnonzero(live & (wanted >= 0) & _FOLLOWS[current, wanted])
        if not len(may):
            break
        first = np.full(len(scans), n)
        np.minimum.at(first, place[may], may)
        taken = first[first < n]
        allowed[taken] = True
        live = at > first[place]  # scans without a change are settled too
        target = np.zeros(len(scans), np.int8)
        target[place[taken]] = wanted[taken]
        current = np.where(live, target[place], current)
    ends = np.append(start[1:], n) - 1
    after = np.where(allowed, wanted, current)[ends]
    rest = ~np.isin(ids, scans)
    ids, statuses = np.concatenate((ids[rest], scans)), np.concatenate((statuses[rest], after))
    order = np.argsort(ids)
    state.update((ids[order].astype("<i8").tobytes(), statuses[order].astype(np.int8).tobytes()))
    unnamed = np.full(n, key[0] < 0)
    yield pd.DataFrame({
        "scan_run_id": rows["scan"].astype("Int64").mask(unnamed), "seq": rows["seq"].astype("Int64").mask(rows["unnumbered"]),
        "from_status": np.array(_STATUSES, dtype=object)[current], "to_status": rows["status"], "allowed": allowed})


def stale_scans(scans: DataFrame, as_of: str) -> DataFrame:
    """Scans to stop: no end after their timeout (30 minutes unless `timeout_minutes` says more), or two hours idle."""
    now = F.lit(as_of).cast("timestamp_ntz")
    limit = F.coalesce("timeout_minutes", F.lit(DEFAULT_TIMEOUT_MINUTES))
    out_of_time = F.col("status").isin("running", "pending") & F.col("scan_completed_at").isNull() & (
        F.col("scan_started_at") < now - F.make_interval(mins=limit))
    stalled = (F.col("status") == "running") & (F.col("updated_at") < now - F.make_interval(hours=F.lit(STALL_HOURS)))
    return scans.select(
        "scan_run_id", "status", F.when(stalled, "failed").when(out_of_time, "timeout").alias("new_status")
    ).filter("new_status IS NOT NULL")


def completion_state(chunks: DataFrame) -> DataFrame:
    """State of an ingest from its chunks (`scan_run_id`, `ok`)."""
    failed = F.count_if(~F.col("ok"))
    return chunks.groupBy("scan_run_id").agg(
        F.count("*").alias("chunks"), failed.alias("failed_chunks"),
        F.when(failed == F.count("*"), "failed").when(failed > 0, "partial").otherwise("completed").alias("status"))
