"""Exactly-once results of streams: micro-batches as rows of tables that a repeated batch writes again instead of twice.

Spark hands a micro-batch that did not commit out again with the same number. Here everything a batch leaves behind lies under
its number, so a repeat replaces it, and what a batch reads of the past is that of smaller numbers only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from datavigil.sources.versions import VersionedTable
from datavigil.streaming.streams import transitions


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Starts a stream, or resumes it where its checkpoint says; trigger None works off what is there and stops."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)).start()


def _earlier(spark: SparkSession, folder: str, schema: str, batch: int | None) -> DataFrame:
    """Rows that batches before this one have left, of all batches if none is named; none at first."""
    spark.createDataFrame([], schema.replace(", batch int", "")).write.mode("ignore").parquet(f"{folder}/batch=-1")
    rows = spark.read.schema(schema).parquet(folder)
    return rows if batch is None else rows.filter(F.col("batch") < batch)


_COUNTS = "data_source string, findings bigint, batch int"
_KEYS = "data_source string, source_path string, batch int"


def totals_of(folder: str) -> Callable[[DataFrame, int], None]:
    """Batches of findings (data_source, source_path) -> findings of each source in the batch, and the records not seen before."""

    def each(found: DataFrame, batch: int) -> None:
        spark = found.sparkSession
        counts = found.groupBy("data_source").agg(F.count("*").alias("findings"))
        counts.write.mode("overwrite").parquet(f"{folder}/counts/batch={batch}")
        seen = _earlier(spark, f"{folder}/keys", _KEYS, batch).drop("batch")
        fresh = found.select("data_source", "source_path").filter("source_path IS NOT NULL").distinct()
        # a null source is a source like others
        same = F.col("f.data_source").eqNullSafe(F.col("s.data_source")) & (F.col("f.source_path") == F.col("s.source_path"))
        fresh.alias("f").join(seen.alias("s"), same, "left_anti").write.mode("overwrite").parquet(f"{folder}/keys/batch={batch}")

    return each


def read_totals(spark: SparkSession, folder: str) -> DataFrame:
    """(data_source, findings, records, windows): findings and different records of each source so far, and how many batches
    held any of it. Exact, however often batches were repeated."""
    counts = _earlier(spark, f"{folder}/counts", _COUNTS, None).groupBy("data_source").agg(
        F.sum("findings").alias("findings"), F.count_distinct("batch").alias("windows"))
    records = _earlier(spark, f"{folder}/keys", _KEYS, None).groupBy(F.col("data_source").alias("_source")).agg(F.count("*").alias("records"))
    joined = counts.join(records, F.col("data_source").eqNullSafe(F.col("_source")), "left")
    return joined.select("data_source", "findings", F.coalesce("records", F.lit(0)).alias("records"), "windows")


STATES = "scan_run_id bigint, status string, batch int"


def life_cycle_of(spark: SparkSession, folder: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Batches of requested steps (scan_run_id, seq, status, at) -> steps/batch=n: what `transitions` says of each, given the
    state that the scan had before the batch. States are a table of versions, one a batch, of which only the buckets with
    scans of the batch are read and written."""
    table = VersionedTable(spark, f"{folder}/states", ["scan_run_id"], buckets)

    def each(events: DataFrame, batch: int) -> None:
        session = events.sparkSession
        table.spark = session
        if batch == 0:
            table.create_once(session.createDataFrame([], STATES))
        events = events.persist()
        try:
            before = table.read(STATES, batch, events.select("scan_run_id"))
            steps = transitions(events, before.select("scan_run_id", "status"))
            steps.write.mode("overwrite").parquet(f"{folder}/steps/batch={batch}")
            done = session.read.parquet(f"{folder}/steps/batch={batch}")
            # an allowed step's target is the state after it; the last one stands
            rank = F.when(F.col("to_status") == "running", 1).otherwise(2)
            after = done.filter("allowed").groupBy("scan_run_id").agg(F.max_by("to_status", rank).alias("status"), F.lit(batch + 1).alias("batch"))
            table.upsert(after, "batch", batch)
        finally:
            events.unpersist()

    return each


def read_steps(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/steps").drop("batch")
