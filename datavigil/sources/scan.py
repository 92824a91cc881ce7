"""Scan of several sources, each by itself, so that one that fails leaves the others alone."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datavigil.functions.patterns import Pattern
from datavigil.operators import detect as D
from datavigil.session import checkpoint_dir

STATUS = "source_type string, host string, status string, findings bigint, error string"


@dataclass
class Source:
    """A reader of field records. `pii_types` set here override the scan's selection."""

    source_type: str
    host: str
    read: Callable[[SparkSession], DataFrame]
    pii_types: list[str] | None = None


def _found(spark: SparkSession, src: Source, rank: int, pii_types, custom) -> DataFrame:
    chosen = pii_types if src.pii_types is None else src.pii_types
    found = D.decorate(D.detect(src.read(spark), chosen, custom), src.source_type, src.host)
    return found.withColumn("_source", F.lit(rank))


def _merged(parts: list[DataFrame]) -> DataFrame:
    return D.global_dedup(reduce(DataFrame.unionByName, parts), "_source", "field_name", "pattern_name").drop("_source")


def scan_all(
    spark: SparkSession, sources: list[Source], pii_types: list[str] | None = None, custom: Iterable[Pattern] = (),
) -> tuple[DataFrame, DataFrame]:
    """Findings of all sources in one plan, deduplicated, and a status row per source.

    A source whose reader cannot be planned (missing path, unknown format) is skipped and reported; the others run. One that
    fails while it is read fails the plan; scan_each keeps sources apart at run time too.
    """
    parts, status = [], []
    for rank, src in enumerate(sources):
        try:
            parts.append(_found(spark, src, rank, pii_types, custom))
            status.append((src.source_type, src.host, "ok", None, None))
        except Exception as e:  # noqa: BLE001 - any failure of one source must not stop the scan
            status.append((src.source_type, src.host, "failed", None, str(e)[:500]))
    if not parts:
        raise ValueError("no source could be read: " + "; ".join(str(s[4]) for s in status))
    return _merged(parts), spark.createDataFrame(status, STATUS).select("source_type", "host", "status", "error")


def scan_each(
    spark: SparkSession, sources: list[Source], pii_types: list[str] | None = None, custom: Iterable[Pattern] = (),
    folder: str | None = None, at_once: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """The same with a job for each source, at_once of them at a time: its findings are written to a folder of its own.

    The write commits when the source has been read to its end, so one that fails on the way leaves nothing behind, and its
    status says why. If folder names that of an earlier scan of the same sources, those that were committed are taken over
    and only the others run. Null findings counts are those of failed sources; without any findings the table is empty.
    """
    if folder is None:
        folder = f"{checkpoint_dir(spark).rstrip('/')}/scan-{spark.sparkContext.applicationId}-{id(sources)}"

    def place(rank: int) -> str:
        return f"{folder}/{rank:05}-{sources[rank].source_type}"

    def committed(rank: int) -> DataFrame | None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{place(rank)}/_SUCCESS")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return spark.read.parquet(place(rank))

    def run(rank: int):
        src = sources[rank]
        try:
            if committed(rank) is None:
                _found(spark, src, rank, pii_types, custom).write.mode("overwrite").parquet(place(rank))
            return committed(rank), (src.source_type, src.host, "ok", committed(rank).count(), None)
        except Exception as e:  # noqa: BLE001 - any failure of one source must not stop the scan
            return None, (src.source_type, src.host, "failed", None, str(e)[:500])

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        done = list(pool.map(run, range(len(sources))))
    status = spark.createDataFrame([row for _, row in done], STATUS)
    parts = [found for found, _ in done if found is not None]
    if not parts:
        raise ValueError("no source could be read: " + "; ".join(str(row[4]) for _, row in done))
    return _merged(parts), status
