"""Audit lists, user activity and the hash chain."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datavigil.operators.grouping import page

GENESIS = "genesis"
CHAIN_FIELDS = ["action", "resource_type", "resource_id", "metadata", "event_time"]


def audit_logs(events: DataFrame, tenant=None, user=None, action: str | None = None, resource_type: str | None = None,
               resource_id: str | None = None, since: str | None = None, until: str | None = None,
               actions: list[str] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Events that meet the filters that are set, newest first. With `actions` and a time range this is the ledger."""
    rows = events
    for col, value in (("tenant_id", tenant), ("user_id", user), ("action", action), ("resource_type", resource_type),
                       ("resource_id", resource_id)):
        if value is not None:
            rows = rows.filter(F.col(col) == value)
    if actions:
        rows = rows.filter(F.col("action").isin(actions))
    if since:
        rows = rows.filter(F.col("event_time") >= F.lit(since).cast("timestamp_ntz"))
    if until:
        rows = rows.filter(F.col("event_time") <= F.lit(until).cast("timestamp_ntz"))
    return page(rows, [F.desc("event_time"), F.desc("event_id")], limit, offset)


def user_activity(events: DataFrame) -> DataFrame:
    """Events, last event and distinct actions per user."""
    return events.groupBy("user_id").agg(
        F.count("*").alias("action_count"), F.max("event_time").alias("last_action"),
        F.sort_array(F.collect_set("action")).alias("actions"))


def resource_history(events: DataFrame, resource_type: str, resource_id: str) -> DataFrame:
    return events.filter((F.col("resource_type") == resource_type) & (F.col("resource_id") == resource_id))


def recent(events: DataFrame, limit: int | None = None) -> DataFrame:
    return page(events, [F.desc("event_time"), F.desc("event_id")], limit)


def active_users(events: DataFrame, since: str) -> DataFrame:
    return events.filter(F.col("event_time") >= F.lit(since).cast("timestamp_ntz")).agg(
        F.count_distinct("user_id").alias("active_users"))


def entry_text(previous):
    """What an entry's hash covers, with its time to the second."""
    fields = [F.coalesce(c, F.lit("")) for c in CHAIN_FIELDS[:-1]]
    return F.concat_ws("|", previous, *fields, F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def build_chain(events: DataFrame, segment: str = "day", heads: DataFrame | None = None, batch: str = "batch") -> DataFrame:
    """Hash chain of each tenant's events, one chain per segment of time.

    Each hash needs the one before it, so a chain can only be computed in order. Cutting it by `segment` (a `date_trunc`
    unit) lets segments run side by side; `seal_chain` then ties the segments together. Rows are streamed in order
    through a task with the last hash as its only state, so a segment of any length takes constant memory; a tenant with
    very long days takes a finer unit.

    `heads` (`tenant_heads` of the chain so far) continues the chains of an earlier batch instead: the batch is then one
    segment named `batch`, and the result is the single chain of the tenant, appended to batch by batch. Names of batches
    must grow in order of text; one that does not follow the last batch of every tenant fails. Places go on from `last_seq`; without that column they start at 1 and `verify_chain`
    cannot tie the batch to the one before.
    """
    if heads is not None and "last_batch" in heads.columns and not heads.filter(F.col("last_batch") >= F.lit(batch)).isEmpty():
        raise ValueError(f"batch {batch!r} does not follow the last batch of every tenant")
    cut = F.lit(batch) if heads is not None else F.date_format(F.date_trunc(segment, "event_time"), "yyyy-MM-dd HH:mm")
    rows = events.withColumns({"segment": cut, "_text": entry_text(F.lit(""))})
    if heads is not None:
        last = F.col("last_seq") if "last_seq" in heads.columns else F.lit(0)
        rows = rows.join(heads.select("tenant_id", F.col("entry_hash").alias("_head"), last.cast("long").alias("_from")),
                         "tenant_id", "left").withColumn("_from", F.coalesce("_from", F.lit(0)))
    else:
        rows = rows.withColumns({"_head": F.lit(None).cast("string"), "_from": F.lit(0).cast("long")})
    ordered = rows.select("tenant_id", "segment", "event_id", "event_time", "_text", "_head", "_from").repartition(
        "tenant_id", "segment").sortWithinPartitions("tenant_id", "segment", "event_time", "event_id")
    chained = ordered.mapInPandas(
        _link, "tenant_id long, segment string, event_id long, seq long, previous_hash string, entry_hash string")
    return chained


def _link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, last, seq = None, GENESIS, 0
    for batch in batches:
        before, after, places = [], [], []
        for tenant, segment, text, head, start in zip(batch["tenant_id"], batch["segment"], batch["_text"], batch["_head"],
                                                      batch["_from"]):
            if (tenant, segment) != key:
                key, last, seq = (tenant, segment), head if isinstance(head, str) else GENESIS, int(start)
            before.append(last)
            last = hashlib.sha256((last + text).encode()).hexdigest()
            seq += 1
            after.append(last)
            places.append(seq)
        yield pd.DataFrame({"tenant_id": batch["tenant_id"], "segment": batch["segment"], "event_id": batch["event_id"],
                            "seq": places, "previous_hash": before, "entry_hash": after})


def chain_heads(chain: DataFrame) -> DataFrame:
    """Last hash and length of every segment."""
    return chain.groupBy("tenant_id", "segment").agg(
        F.max_by("entry_hash", "seq").alias("entry_hash"), F.count("*").alias("entries"))


def tenant_heads(chain: DataFrame) -> DataFrame:
    """Last hash and place of every tenant's chain: what the next batch is appended to."""
    ends = chain.groupBy("tenant_id", "segment").agg(
        F.max_by("entry_hash", "seq").alias("entry_hash"), F.max("seq").alias("last_seq"))
    return ends.groupBy("tenant_id").agg(F.max_by("entry_hash", "segment").alias("entry_hash"),
                                         F.max_by("last_seq", "segment").alias("last_seq"), F.max("segment").alias("last_batch"))


def seal_chain(chain: DataFrame) -> DataFrame:
    """One digest per tenant over its segment heads in order; segments are as many as there are days or hours."""
    heads = chain_heads(chain)
    line = F.sort_array(F.collect_list(F.concat_ws(":", "segment", "entry_hash", F.col("entries").cast("string"))))
    return heads.groupBy("tenant_id").agg(
        F.count("*").alias("segments"), F.sum("entries").alias("entries"),
        F.sha2(F.concat_ws("|", line), 256).alias("seal"))


def verify_chain(chain: DataFrame, events: DataFrame) -> DataFrame:
    """Each entry checked on its own: its hash is recomputed and its link compared with the entry before it.

    The entry before the first of an appended batch is the last one of the tenant's segment before, so a lost or misplaced
    batch breaks a link. Both joins are on keys of one row each, and only segment ends are put in order, so verification
    runs in parallel whatever the length of a chain.
    """
    inside = chain.select("tenant_id", "segment", (F.col("seq") + 1).alias("seq"), F.col("entry_hash").alias("_linked"))
    in_order = Window.partitionBy("tenant_id").orderBy("segment")
    ends = chain.groupBy("tenant_id", "segment").agg(
        F.min("seq").alias("seq"), F.max("seq").alias("_last"), F.max_by("entry_hash", "seq").alias("_hash"))
    across = ends.select("tenant_id", "segment", "seq", F.lag("_hash").over(in_order).alias("_linked"),
                         F.lag("_last").over(in_order).alias("_before"))
    across = across.filter((F.col("seq") > 1) & (F.col("_before") + 1 == F.col("seq"))).drop("_before")
    before = inside.unionByName(across)
    rows = chain.join(events.select("tenant_id", "event_id", *CHAIN_FIELDS), ["tenant_id", "event_id"], "left").join(
        before, ["tenant_id", "segment", "seq"], "left")
    return rows.select(
        "tenant_id", "segment", "seq", "event_id",
        F.coalesce(F.sha2(entry_text("previous_hash"), 256) == F.col("entry_hash"), F.lit(False)).alias("hash_ok"),
        F.coalesce(F.when(F.col("seq") == 1, F.col("previous_hash") == GENESIS)
                   .otherwise(F.col("previous_hash") == F.col("_linked")), F.lit(False)).alias("link_ok"))
