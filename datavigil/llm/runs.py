"""Places of rows inside groups that may be larger than a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datavigil.llm.components import stored


def numbered(df: DataFrame, by: str, order: list[Column], pos: str = "pos", ranges: int | None = None) -> DataFrame:
    """df with pos: the place, from 0, of each row among those with the same value (not null) of the integer column `by`.

    Rows are sorted by ranges of (by, order), as many as the session has shuffle partitions if not said otherwise, so a group
    of any size is spread over tasks. Rows equal in all of it stay together, in any order. What a task needs of the tasks before it is the number of rows of one group in each range.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("__run", T.LongType()), T.StructField("__part", T.IntegerType())])
    place = df.columns.index(by)

    def run(batches):
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(place).to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.concatenate(([last is None or key[0] != last], key[1:] != key[:-1])))
            begin = np.zeros(len(key), np.int64)
            begin[new] = new
            at = np.arange(len(key)) - np.maximum.accumulate(begin)
            first = new[0] if len(new) else len(key)
            at[:first] += count  # the group that the batch before has begun
            last, count = key[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(np.full(len(key), part, np.int32))],
                                             [*batch.schema.names, "__run", "__part"])

    keys = [F.col(by), *order]
    ranged = df.repartitionByRange(*keys) if ranges is None else df.repartitionByRange(ranges, *keys)
    swept = stored(ranged.sortWithinPartitions(*keys).mapInArrow(run, schema))
    # of each range the last group only can go on in the next one
    tails = swept.groupBy("__part").agg(F.max(by).alias("last"), F.min(by).alias("head"), F.count("*").alias("n"))
    ends = (swept.join(F.broadcast(tails.select("__part", "last")), "__part").where(F.col(by) == F.col("last"))
            .groupBy("__part").agg(F.count("*").alias("tail")))
    before, carry = [], (None, 0)
    for r in tails.join(ends, "__part").orderBy("__part").collect():  # one row a range
        if carry[0] == r["head"]:
            before.append((r["__part"], r["head"], carry[1]))
        goes_on = carry[1] if r["head"] == r["last"] == carry[0] else 0
        carry = (r["last"], r["tail"] + goes_on)
    shift = df.sparkSession.createDataFrame(before, "__part int, __head bigint, __before bigint")
    joined = swept.join(F.broadcast(shift), "__part", "left")
    more = F.when(F.col(by) == F.col("__head"), F.col("__before")).otherwise(0)
    return joined.withColumn(pos, F.col("__run") + F.coalesce(more, F.lit(0))).select(*df.columns, pos)
