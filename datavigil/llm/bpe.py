"""Operator 1: byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Each task cuts its texts into pre-tokens, block by block (a block is about 4 million characters), and numbers the
   distinct ones of a block by frequency. A text becomes the list of these numbers: its words by position.
2. The words of a block go out once each, packed by hash bucket, and are shuffled by bucket. All blocks' copies of a word
   meet in one task, which merges it once and sends the ids back to every block that asked. A word that stands in every
   text is a few bytes per block, so no key is hot.
3. Number lists and word ids meet by block, and each text's ids are put together by position. Texts are not shuffled.
4. Decoding joins the ids with the token-byte table, which is as large as the vocabulary; its size is checked before it
   is broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datavigil.llm import arrays as A
from datavigil.llm import pretokens as P

BLOCK_CHARS = 1 << 22
BUCKETS = 256
MAX_TABLE_BYTES = 1 << 26


def _spread(spark, ranks: dict[bytes, int]):
    """The vocabulary as a broadcast variable; it is bounded by the tokenizer, and checked."""
    size = sum(map(len, ranks)) + 16 * len(ranks)
    if size > MAX_TABLE_BYTES:
        raise ValueError(f"the token table has {size} bytes, more than the {MAX_TABLE_BYTES} that may be broadcast")
    return spark.sparkContext.broadcast(ranks)


def _blocks(batches, make, block_chars: int):
    """(block id, block, rows of the block as batches without the text, which is the last column)."""
    part = TaskContext.get().partitionId()
    block, rows, serial = make(), [], 0
    for batch in A.pieces(batches):
        _, offsets = A.byte_view(batch.column(batch.num_columns - 1))
        weight = offsets + 64 * np.arange(len(offsets))
        start = 0
        while start < batch.num_rows:
            # up to the row that fills the block
            stop = min(int(np.searchsorted(weight, weight[start] + block_chars - block.size)), batch.num_rows)
            stop = max(stop, start + 1)
            rows.append(batch.slice(start, stop - start))
            block.extend(rows[-1].column(batch.num_columns - 1))
            start = stop
            if block.size >= block_chars:
                yield (part << 32) + serial, block, rows
                block, rows, serial = make(), [], serial + 1
    if rows:
        yield (part << 32) + serial, block, rows


#: Factors of the bytes of a word by their place, for its bucket.
_PLACES = A.constants(256, 29)


def _bucket_of(words: pa.Array, buckets: int) -> np.ndarray:
    """The bucket of each word, by a hash of its bytes and their places."""
    data, offsets = A.byte_view(words)
    chars, bounds = data[int(offsets[0]):int(offsets[-1])], offsets - offsets[0]
    place = np.arange(len(chars)) - np.repeat(bounds[:-1], np.diff(bounds))
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars + np.uint64(1)) * _PLACES[place & 255], out=sums[1:])
    return (A.mix(sums[bounds[1:]] - sums[bounds[:-1]]) % np.uint64(buckets)).astype(np.uint16)


def _distinct_words(docs: DataFrame, make, block_chars: int, buckets: int) -> DataFrame:
    """(block, bucket, lengths, words): the distinct words of each block, packed by bucket."""

    def run(batches):
        for no, block, _ in _blocks(batches, make, block_chars):
            words = pa.array(block.numbered()[0], pa.string())
            bucket = _bucket_of(words, buckets)
            order = np.argsort(bucket, kind="stable")
            used, starts = np.unique(bucket[order], return_index=True)
            bounds = np.append(starts, len(order))
            data, offsets = A.byte_view(words.take(pa.array(order)))
            yield pa.RecordBatch.from_arrays([
                pa.array([no] * len(used), pa.int64()), pa.array(used.astype(np.int32)),
                A.binary_array(*P.pack_ragged(np.diff(offsets), bounds)), A.binary_array(data, offsets[bounds]),
            ], ["block", "bucket", "lengths", "words"])

    return docs.mapInArrow(run, "block bigint, bucket int, lengths binary, words binary")


def _word_ids(words: DataFrame, encoder) -> DataFrame:
    """(block, bucket, lengths, ids): every distinct word is encoded once, in the task of its bucket."""

    def run(batches):
        encode_words, known, of = encoder(), {}, None
        for batch in A.pieces(batches):
            bucket = batch.column(1).to_numpy()
            for run_start, run_stop in zip(*_runs(bucket), strict=True):
                if bucket[run_start] != of:
                    known, of = {}, bucket[run_start]
                rows = batch.slice(run_start, run_stop - run_start)
                lengths, bounds = P.unpack_ragged(rows.column(2))
                data, offsets = A.byte_view(rows.column(3))
                coded = A.binary_array(data[int(offsets[0]):int(offsets[-1])], np.concatenate(([0], np.cumsum(lengths)))).dictionary_encode()
                asked = coded.dictionary.to_pylist()
                fresh = [w for w in asked if w not in known]
                known.update(zip(fresh, encode_words(fresh), strict=True))
                found = [known[w] for w in asked]
                size = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.fromiter((x for ids in found for x in ids), np.int64, int(size.sum()))
                codes = coded.indices.to_numpy()
                sizes = size[codes]
                ends = np.concatenate(([0], np.cumsum(sizes)))
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), rows.column(1), A.binary_array(*P.pack_ragged(sizes, bounds)),
                    A.binary_array(*P.pack_ragged(flat[A.ragged((np.cumsum(size) - size)[codes], sizes)], ends[bounds])),
                ], ["block", "bucket", "lengths", "ids"])

    return (words.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(run, "block bigint, bucket int, lengths binary, ids binary"))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start and stop."""
    edges = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate(([0], edges)), np.concatenate((edges, [len(values)]))


def _number_lists(docs: DataFrame, make, block_chars: int, buckets: int, schema: T.StructType) -> DataFrame:
    """Per text its words' numbers; the first row of a block also has the bucket of each of its words."""

    def run(batches):
        for no, block, rows in _blocks(batches, make, block_chars):
            words, numbers, bounds = block.numbered()
            kept = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            count = kept.num_rows
            places = [_bucket_of(pa.array(words, pa.string()), buckets).tobytes()] + [None] * (count - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(count, no, np.int64)), pa.array(places, pa.binary()),
                 A.binary_array(*P.pack_ragged(numbers, bounds)), *kept.columns[:-1]], names)

    full = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket_of", T.BinaryType()),
                         T.StructField("numbers", T.BinaryType()), *schema.fields])
    names = [f.name for f in full.fields]
    return docs.mapInArrow(run, full)


def by_words(docs: DataFrame, make, encoder, finish, fields: list[T.StructField], block_chars: int = BLOCK_CHARS,
             buckets: int = BUCKETS) -> DataFrame:
    """Whole texts, the last column of docs, as the ids of their words, each distinct word encoded once.

    make() gives an empty pretokens.Block, encoder() (in the task) a function from words to their ids, and
    finish(rows, ids, bounds) the result, with the given fields, of a block's rows: their other columns, the ids of all texts
    one after the other, and where each text's begin. The rows of docs are read twice and must come in the same order each
    time, as those of a table do; if they don't, the job fails instead of mixing words.
    """
    schema = T.StructType(docs.schema.fields[:-1])
    names = [f.name for f in schema.fields]
    word_ids = _word_ids(_distinct_words(docs.select(docs.columns[-1]), make, block_chars, buckets), encoder)
    lists = _number_lists(docs, make, block_chars, buckets, schema)

    def assemble(words: pa.Table, texts: pa.Table) -> pa.Table:
        places = [x for x in texts.column("bucket_of").to_pylist() if x is not None]
        bucket_of = np.frombuffer(places[0] if places else b"", np.uint16)
        words = words.sort_by("bucket")
        counts, flat = (P.unpack_ragged(words.column(c).combine_chunks())[0] for c in ("lengths", "ids"))
        if len(places) != 1 or len(counts) != len(bucket_of) or len(flat) != counts.sum():
            raise RuntimeError("the texts came in another order or with other words when they were read again")
        order = np.argsort(bucket_of, kind="stable")  # the words in the order in which their ids have come
        first, length = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        first[order], length[order] = np.cumsum(counts) - counts, counts
        flat = flat.astype(np.int32)
        numbers, bounds = P.unpack_ragged(texts.column("numbers").combine_chunks())
        sizes = length[numbers]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return finish(texts.select(names), flat[A.ragged(first[numbers], sizes)], ends[bounds])

    out = word_ids.groupBy("block").cogroup(lists.groupBy("block"))
    return out.applyInArrow(lambda a, b: assemble(a, b), T.StructType(fields))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "ids",
           block_chars: int = BLOCK_CHARS, buckets: int = BUCKETS) -> DataFrame:
    """docs without the text, and the array of its token ids.

    Every match of pattern is encoded by itself, no special tokens. A null or empty text has no ids. Repeated rows are
    encoded each, other columns are carried along under their own names (a column named like ids_col is replaced). An
    empty table gives no rows. docs must come in the same order each time it is read, see by_words. A pre-token of any
    length is merged in n log n.
    """
    spread = _spread(docs.sparkSession, ranks)
    others = [c for c in docs.columns if c not in (text_col, ids_col)]
    # their own names could clash with the columns used here
    carried = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(f"`{text_col}`").alias("text"))

    def finish(rows: pa.Table, ids: np.ndarray, bounds: np.ndarray) -> pa.Table:
        column = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
        return pa.Table.from_arrays([*rows.columns, column], names=[*rows.column_names, "ids"])

    fields = [*carried.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    result = by_words(carried, lambda: P.Block(pattern), lambda: lambda words: [P.merge(w, spread.value) for w in words], finish,
                      fields, block_chars, buckets)
    return result.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], F.col("ids").alias(ids_col))


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", bytes_col: str = "decoded",
           digest_col: str = "ids_sha256") -> DataFrame:
    """encoded, the bytes that its ids stand for, and the SHA-256 (lowercase hex) of the ids as little-endian unsigned 32-bit
    integers. Null ids give nulls, none give no bytes; an id without a token fails. Columns with these names are replaced."""
    spread = _spread(encoded.sparkSession, ranks)
    others = [c for c in encoded.columns if c not in (bytes_col, digest_col)]
    place = others.index(ids_col)
    safe = encoded.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    schema = T.StructType([*safe.schema.fields, T.StructField("decoded", T.BinaryType()), T.StructField("digest", T.StringType())])

    def run(batches):
        table = spread.value
        size = max(table.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in table.items():
            tokens[rank] = token
        length = np.full(size, -1, np.int64)
        length[list(table.values())] = [len(t) for t in table]
        first = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
        blob = np.frombuffer(b"".join(tokens), np.uint8)
        for batch in A.pieces(batches):
            column = batch.column(place)
            done, sums = [], []
            for row in column:
                if not row.is_valid:
                    done.append(None)
                    sums.append(None)
                    continue
                ids = row.values.to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= size or length[ids].min() < 0):
                    raise ValueError("an id has no token")
                done.append(blob[A.ragged(first[ids], length[ids])].tobytes())
                sums.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.binary()), pa.array(sums, pa.string())],
                                             [*batch.schema.names, "decoded", "digest"])

    out = safe.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], F.col("decoded").alias(bytes_col),
                      F.col("digest").alias(digest_col))
