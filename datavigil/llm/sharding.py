"""Operator 3: shards by proportional stratified interleaving.

The rows of each source are put in a seeded random order; the row of rank r among n gets the place (r - 1/2) / n; all rows
are sorted by place and cut into equal pieces. So every piece holds every source in its share, and the counts of two
pieces differ by one at most.

Ranks are exact and no window holds a whole source: rows are sorted by ranges of (source, random number), and a task needs of
those before it only how many rows of its first source they have. The sort by place is numbered in the same way. Sources with
a third of all rows, many sources with the same places and rows that are repeated are spread over as many ranges as their
rows need; the ranges do not change the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datavigil.llm.components import stored
from datavigil.llm.runs import numbered

#: Rows that a range holds, about.
BUCKET_ROWS = 4096


def interleave(docs: DataFrame, shards: int, stratum: Column, order: list[Column], seed: int = 0,
               bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs with shard (0 to shards - 1) and slot (0, 1, ... within the shard).

    stratum is the source of a row, null is a source of its own; order names what tells rows apart: rows equal in all of it
    are ranked in any order, which shows only in columns outside of it. Of rows with the same place that of the smaller hash
    of source and place comes first. An empty table gives no rows; with fewer rows than shards some shards stay empty.
    Columns of docs named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    names = docs.columns
    # the sources are told apart by a hash; rows get a number of their own, which is kept as they are written once
    rows = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64(stratum.isNull(), F.coalesce(stratum.cast("string"), F.lit(""))).alias("stratum"),
                              F.xxhash64(F.lit(seed), *order).alias("h"), F.xxhash64(F.lit(seed + 1), *order).alias("tie"), F.monotonically_increasing_id().alias("own")))
    total = rows.count()
    ranges = max(1, -(-total // bucket_rows))
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("size"))
    ranked = numbered(rows, "stratum", [F.col("h"), F.col("tie"), F.col("own")], "rank", ranges).join(sizes, "stratum")
    placed = ranked.select("row", "own", ((F.col("rank") + 0.5) / F.col("size")).alias("place"), "stratum", F.lit(0).alias("all"))
    mixed = placed.withColumn("by", F.xxhash64("stratum", "place"))
    rows = numbered(mixed, "all", [F.col("place"), F.col("by"), F.col("own")], "at", ranges)
    shard = F.expr(f"at * {shards}L div {max(total, 1)}L")
    first = F.expr(f"((at * {shards}L div {max(total, 1)}L) * {total}L + {shards - 1}L) div {shards}L")
    return rows.select("row.*", shard.cast("int").alias("shard"), (F.col("at") - first).alias("slot"))
