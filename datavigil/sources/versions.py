"""Tables in buckets of keys with versions: an upsert writes only the buckets that it touches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datavigil.operators.grouping import upsert

BUCKETS = 256


class VersionedTable:
    """A table in a folder, its rows in buckets by a hash of their keys.

    `data` holds written buckets, a version in `versions` is one small file that says in which write each bucket lies (one row
    a bucket). It appears as a whole when an upsert is done, so a write that is killed leaves the version before it as it was,
    and readers of an older version are not disturbed. Two upserts that begin from the same version cannot both commit.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _versions(self) -> DataFrame:
        return self.spark.read.schema("bucket int, write string, version int").parquet(f"{self.folder}/versions")

    def version(self) -> int:
        return self._versions().agg(F.max("version")).first()[0]

    def _places(self, version: int) -> dict[int, str]:
        """Bucket -> write; as many entries as there are buckets at most."""
        return {r["bucket"]: r["write"] for r in self._versions().filter(F.col("version") == version).collect() if r["bucket"] is not None}

    def _commit(self, version: int, places: dict[int, str]) -> None:
        rows = [(b, w) for b, w in sorted(places.items())] or [(None, None)]
        self.spark.createDataFrame(rows, "bucket int, write string").coalesce(1).write.parquet(f"{self.folder}/versions/version={version}")

    def _write(self, df: DataFrame) -> dict[int, str]:
        name = uuid.uuid4().hex
        # the rows of a bucket are spread over files of one task each at most; AQE splits a bucket that is much too large
        marked = df.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket")
        marked.write.partitionBy("_bucket").parquet(f"{self.folder}/data/{name}")
        written = self.spark.read.schema("_bucket int").parquet(f"{self.folder}/data/{name}").distinct()
        return {r[0]: name for r in written.collect()}

    def _read(self, places: dict[int, str], schema) -> DataFrame:
        paths = [f"{self.folder}/data/{write}/_bucket={bucket}" for bucket, write in sorted(places.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def create(self, df: DataFrame) -> None:
        """Version 0."""
        self._commit(0, self._write(df))

    def has(self, version: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions/version={version}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def create_once(self, df: DataFrame) -> None:
        """Version 0, if there is none yet."""
        if not self.has(0):
            self.create(df)

    def read(self, schema, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named; with keys only those of the buckets that hold any of them."""
        places = self._places(self.version() if version is None else version)
        if keys is not None:
            wanted = {r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()}  # buckets, not keys
            places = {b: w for b, w in places.items() if b in wanted}
        return self._read(places, schema)

    def upsert(self, changes: DataFrame, version_col: str, now: int | None = None) -> list[int]:
        """A new version with the changes merged by key, the newest `version_col` winning; the buckets that were rewritten.

        It follows the last version, or version `now`; if that has been followed already, nothing is done.
        """
        if now is None:
            now = self.version()
        elif self.has(now + 1):
            return []
        places = self._places(now)
        touched = {r[0] for r in changes.select(self._bucket().alias("b")).distinct().collect()}  # buckets, not keys
        old = self._read({b: w for b, w in places.items() if b in touched}, changes.schema)
        self._commit(now + 1, {**places, **self._write(upsert(old, changes, self.keys, version_col))})
        return sorted(touched)
