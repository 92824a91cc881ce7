"""Operator 11: documents are packed into sequences of a fixed number of tokens by bulk-synchronous best-fit.

Pieces of documents (items) have lengths up to the capacity, open sequences have gaps. As many sequences are opened as the
sum of the lengths needs at least; then, round by round:

1. Of the unplaced items those of the largest lengths that still fit somewhere take part, down to half of the largest.
   A gap that holds several items of the largest length offers that many slots. Items and slots are sorted together by
   range of their sizes; equal sizes are spread by a hash, so a length that a third of all rows share is no hot range.
2. Each task sweeps over its range: an item asks for its successor, the smallest slot that holds it. Where several ask for
   the same slot the one of highest rank, the longest, has it and the others go on to the next one, which is the matching of
   brackets. What a range cannot match among itself goes on to the ranges above it: the numbers of items and slots left over
   in each range (one row a range) give every left-over row the level at which it meets its partner.
3. Matched items leave, gaps shrink by what they took. If no gap holds any item, new sequences are opened for the rest.

The number of rounds depends on the capacity and the spread of lengths, not on the number of items (13 to 20 were seen).
Each round is written to the shared folder, nothing but counts is collected.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datavigil.llm import bpe
from datavigil.llm import pretokens as P
from datavigil.llm.components import stored

CAPACITY = 4096
#: Share of the largest length down to which items take part in a round.
SPREAD = 0.5
END_ID = 1


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of docs.

    The ids are those of the tokenizer of the library `tokenizers` without special tokens (their names in a text are ordinary
    text), then end_id. A document of more than capacity ids is cut into pieces of capacity, the last may be shorter; start
    is the number of its ids before the piece. A null or empty text has end_id only. Repeated rows have pieces each, an empty
    table none. The tokenizer must drop white space, not look across it, lower-case, and keep runs of letters, digits and
    other marks apart, as that of word_bpe_49k.json does: each distinct word is then encoded once for the whole table.
    """
    with open(tokenizer_path, "rb") as file:
        data = file.read()
    if len(data) > bpe.MAX_TABLE_BYTES:
        raise ValueError(f"the tokenizer has {len(data)} bytes, more than the {bpe.MAX_TABLE_BYTES} that may be broadcast")
    spread = docs.sparkSession.sparkContext.broadcast(data)

    def encoder():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        tokenizer = tokenizers.Tokenizer.from_buffer(spread.value)
        tokenizer.encode_special_tokens = True
        merge = tokenizer.model.tokenize

        def encode_words(words: list[bytes]) -> list[list[int]]:
            texts = [w.decode() for w in words]
            # runs of ASCII letters pass the steps before the model as they are
            out = [[t.id for t in merge(w)] if w.isascii() and w.isalpha() else None for w in texts]
            rest = [i for i, ids in enumerate(out) if ids is None]
            for i, e in zip(rest, tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = e.ids
            return out

        return encode_words

    def finish(rows: pa.Table, ids: np.ndarray, bounds: np.ndarray) -> pa.Table:
        out: list[list[int]] = [[], [], [], [], []]
        end = np.array([end_id], "<u4")
        for doc, a, b in zip(rows.column(0).to_pylist(), bounds[:-1], bounds[1:], strict=True):
            whole = np.concatenate((ids[a:b].astype("<u4"), end))
            for no, start in enumerate(range(0, len(whole), capacity)):
                part = whole[start:start + capacity]
                for column, value in zip(out, (doc, no, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                    column.append(value)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)],
                                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    fields = T.StructType.fromDDL("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint").fields
    return bpe.by_words(picked, lambda: P.Block(None, lower=True), encoder, finish, fields)


def brackets(is_slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items and slots in order of size: the places of matched items and of their slots.

    A slot takes the last item before it that is still free.
    """
    depth = np.cumsum(np.where(is_slot, -1, 1))
    level = depth + is_slot
    order = np.argsort(level, kind="stable")
    here, there = order[:-1], order[1:]
    pair = (level[here] == level[there]) & ~is_slot[here] & is_slot[there]
    return here[pair], there[pair]


def _swept(rows: DataFrame) -> DataFrame:
    """(size, slot, id) -> (part, slot, id, size, seq, turn) by ranges of sizes: items with the sequence that they get in
    their range, and the rows left over, which have no seq, with their turn among those of their kind."""

    def run(batches):
        found = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if not found:
            return
        size, slot, own = (np.concatenate(column) for column in zip(*found, strict=True))
        slot = slot.astype(bool)
        item, to = brackets(slot)
        left = np.ones(len(size), bool)
        left[item] = left[to] = False
        rest = np.flatnonzero(left)
        turn = np.where(slot[rest], np.cumsum(slot[rest]), np.cumsum(~slot[rest])) - 1
        part = np.full(len(item) + len(rest), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([
            pa.array(part), pa.array(np.concatenate((slot[item], slot[rest])).astype(np.int32)),
            pa.array(np.concatenate((own[item], own[rest]))), pa.array(np.concatenate((size[item], size[rest]))),
            pa.array(np.concatenate((own[to], np.zeros(len(rest), np.int64))), mask=np.arange(len(part)) >= len(item)),
            pa.array(np.concatenate((np.zeros(len(item), np.int64), turn)))], ["part", "slot", "id", "size", "seq", "turn"])

    ranged = rows.select("size", "slot", "id", F.xxhash64("id", "no").alias("tie")).repartitionByRange("size", "slot", "tie")
    ordered = ranged.sortWithinPartitions("size", "slot", "tie").select("size", "slot", "id")
    return ordered.mapInArrow(run, "part int, slot int, id bigint, size bigint, seq bigint, turn bigint")


def _matched(rows: DataFrame) -> DataFrame:
    """(size, slot, id, no) -> (id, size, seq): every item with its sequence, or null."""
    swept = stored(_swept(rows))
    left = swept.where("seq IS NULL")
    # one row a range: how far the rows left over in it raise or lower the level
    counts = left.groupBy("part").agg(F.sum("slot").alias("slots"), F.count("*").alias("n")).orderBy("part").collect()
    begins, level = [], 0
    for r in counts:
        begins.append((r["part"], level, r["slots"]))
        level += r["n"] - 2 * r["slots"]
    ranges = rows.sparkSession.createDataFrame(begins, "part int, base bigint, slots bigint")
    # in a range the slots left over come before the items left over
    level_of = F.when(F.col("slot") == 1, F.col("base") - F.col("turn")).otherwise(F.col("base") - F.col("slots") + F.col("turn") + 1)
    levels = left.join(F.broadcast(ranges), "part").withColumn("level", level_of)
    over = Window.partitionBy("level").orderBy("part", F.col("slot").desc())  # two rows of a range at most
    pairs = levels.withColumn("seq", F.when(F.lead("slot").over(over) == 1, F.lead("id").over(over)))
    return swept.where("seq IS NOT NULL").select("id", "size", "seq").union(pairs.where("slot = 0").select("id", "size", "seq"))


def pack(items: DataFrame, length_col: str = "length", capacity: int = CAPACITY, spread: float = SPREAD) -> DataFrame:
    """items with sequence_id and offset: the sequence that each row lies in, and its place there.

    Lengths must be from 1 to capacity; a null or other length fails. The rows of a sequence lie one after the other from
    offset 0 on, their lengths add up to capacity at most. Every row is placed by itself, repeated rows too; which of equal
    rows gets which place is open. An empty table gives no rows. Columns with these names are replaced.
    """
    names = [c for c in items.columns if c not in ("sequence_id", "offset")]
    rows = stored(items.select(F.monotonically_increasing_id().alias("id"), F.col(f"`{length_col}`").cast("long").alias("size"),
                               *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]))
    bad = rows.where(F.col("size").isNull() | ~F.col("size").between(1, capacity))
    if not bad.isEmpty():
        raise ValueError(f"lengths must be from 1 to {capacity}")
    spark = items.sparkSession
    free = rows.where(F.col("size") < capacity).select("id", "size")
    bins, opened, placed = spark.range(0).select("id", F.lit(0).cast("long").alias("gap")), 0, []
    while True:
        left = free.agg(F.count("*").alias("n"), F.sum("size").alias("sum"), F.min("size").alias("least")).first()
        if not left["n"]:
            break
        # gaps that hold nothing any more are closed
        bins = bins.where(F.col("gap") >= left["least"])
        widest = bins.agg(F.max("gap")).first()[0]
        if widest is None:
            more = -(-left["sum"] // capacity)
            bins, widest = spark.range(opened, opened + more).select("id", F.lit(capacity).cast("long").alias("gap")), capacity
            opened += more
        longest = free.where(F.col("size") <= widest).agg(F.max("size")).first()[0]
        lowest = max(1, int(np.ceil(spread * longest)))
        active = F.col("size").between(lowest, longest)
        slots = (bins.where(F.col("gap") >= lowest).withColumn("many", F.greatest(F.lit(1).cast("long"), F.floor(F.col("gap") / longest)))
                 .select(F.floor(F.col("gap") / F.col("many")).alias("size"), F.lit(1).alias("slot"), "id",
                         F.explode(F.sequence(F.lit(1).cast("long"), F.col("many"))).alias("no")))
        asking = free.where(active).select("size", F.lit(0).alias("slot"), "id", F.lit(0).cast("long").alias("no"))
        met = stored(_matched(asking.union(slots)))
        done = met.where("seq IS NOT NULL")
        placed.append(done.select("id", "seq", F.lit(len(placed)).alias("round")))
        free = free.where(~active).union(met.where("seq IS NULL").select("id", "size"))
        taken = done.select(F.col("seq").alias("id"), (-F.col("size")).alias("gap"))
        bins = stored(bins.union(taken).groupBy("id").agg(F.sum("gap").alias("gap")))
        if len(placed) % 8 == 0:
            free = stored(free)
    whole = rows.where(F.col("size") == capacity).select("id", (2 * F.col("id") + 1).alias("sequence_id"), F.lit(0).alias("round"))
    where = whole
    for part in placed:
        where = where.union(part.select("id", (2 * F.col("seq")).alias("sequence_id"), "round"))
    found = rows.join(where, "id")
    before = Window.partitionBy("sequence_id").orderBy("round", "id").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "sequence_id", "offset")
