"""Connected components of an edge table by least labels, hooking and pointer jumping; nothing is collected."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datavigil.session import checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder and read again. Unlike a checkpoint it does not hand the constraints of
    its plan on, which in a loop double from round to round."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of long ids -> (v, label): for each end of an edge the smallest id that it reaches.

    In each round a vertex takes the least label among its neighbours and hands it to the vertex that its own label names;
    then every label is replaced by that label's label. Whole groups move at once, so chains and stars end after few rounds.
    A vertex with many edges is combined on the map side. Each round is written to the shared folder. Loops and repeated
    edges do no harm; nulls are ignored; no edges give no rows.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")))
    while True:
        near = (both.join(labels.select(F.col("v").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m")))
        known = labels.join(near, "v")
        offers = known.select(F.explode(F.array("v", "label")).alias("v"), "m").groupBy("v").agg(F.min("m").alias("m"))
        lower = labels.join(offers, "v").select("v", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jumped = lower.join(lower.select(F.col("v").alias("label"), F.col("label").alias("far")), "label")
        step = stored(jumped.select("v", "old", F.least("label", "far").alias("label")))
        labels = step.select("v", "label")
        if step.where("label < old").isEmpty():
            return labels
