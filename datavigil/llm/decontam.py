"""Operator 9: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

1. Longer test items are cut into passages of 256 words that overlap by half, the last one up to the item's end, so that
   every run of 128 words lies whole in a passage. They are read in blocks of a bounded number of words; the word hashes of
   a block are collected and broadcast. However many items there are, each block is one pass over the documents.
2. A first pass counts in how many documents each 3-gram of the items stands. In every three neighbouring 3-grams of an
   item the rarest is a seed, so an item has seeds all along and a copy with some words changed keeps some of them.
3. A second pass looks the 3-grams of every document up among the seeds. Around the seeds of one item that lie on nearby
   diagonals the document's words and the item's are aligned (match 2, mismatch -1, gap -1). The score is the best
   alignment's value over that of a perfect copy; from `threshold` on the document is contaminated by the item, if the value
   is also that of LEAST_WORDS words in a row or of the whole item.

Documents are read where they are: no shuffle but of counts per seed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datavigil.llm import arrays as A

SEED_WORDS = 3
PASSAGE_WORDS = 256
WINDOW = 3
BLOCK_WORDS = 1 << 21
THRESHOLD = 0.5
#: A few common words in a row are no copy: shorter items must be there whole, others with the value of so many words.
LEAST_WORDS = 6
MATCH, MISMATCH, GAP = 2, -1, -1


@dataclass
class Passages:
    """A block of items: their ids, passages as word hashes with the number of their item, and their seeds sorted by hash."""

    ids: list
    items: np.ndarray
    words: list[np.ndarray]
    grams: np.ndarray
    gram_passage: np.ndarray
    gram_place: np.ndarray


def _grams(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 3-grams inside the texts, and the place of their first words."""
    if len(words) < SEED_WORDS:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    factors = A.constants(SEED_WORDS, 909)
    n = len(words) - SEED_WORDS + 1
    codes = A.mix(sum(words[k:n + k] * factors[k] for k in range(SEED_WORDS)))
    ends = np.repeat(bounds[1:], np.diff(bounds))[:n]
    inside = np.flatnonzero(np.arange(n) + SEED_WORDS <= ends)
    return codes[inside], inside


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words): the hashed words of each passage of each item; shorter than three words, none."""

    def run(batches):
        for batch in A.pieces(batches):
            data, offsets = A.byte_view(batch.column(1))
            ids, parts = [], []
            for i, j in A.slices(offsets):
                words, bounds = A.word_hashes(data, offsets[i:j + 1], A.PUNCTUATION)
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    if b - a < SEED_WORDS:
                        continue
                    last = max(a, b - PASSAGE_WORDS)  # the last passage reaches back
                    for start in [*range(a, last, PASSAGE_WORDS // 2), last]:
                        ids.append(batch.column(0)[i + k].as_py())
                        parts.append(words[start:min(start + PASSAGE_WORDS, b)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.binary())], ["item_id", "words"])

    picked = items.select(F.col(id_col).cast("long").alias("item_id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    return picked.mapInArrow(run, "item_id bigint, words binary")


def _collect(rows: list) -> Passages:
    words = [np.frombuffer(r["words"], np.uint64) for r in rows]
    bounds = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    codes, places = _grams(np.concatenate(words) if words else np.empty(0, np.uint64), bounds)
    passage = np.searchsorted(bounds, places, side="right") - 1
    number: dict = {}
    items = np.array([number.setdefault(r["item_id"], len(number)) for r in rows], np.int64)
    return Passages(list(number), items, words, codes, passage, places - bounds[passage])


def _rarest(block: Passages, counts: dict[int, int]) -> Passages:
    """The block with seeds only: of every WINDOW neighbouring 3-grams of a passage the one in the fewest documents."""
    df = np.array([counts.get(int(g), 0) for g in block.grams], np.int64)
    keep = np.zeros(len(df), bool)
    edges = np.flatnonzero(np.diff(block.gram_passage, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        for start in range(a, max(b - WINDOW, a) + 1):
            keep[start + int(np.argmin(df[start:min(start + WINDOW, b)]))] = True
    seeds = np.flatnonzero(keep)
    seeds = seeds[np.argsort(block.grams[seeds], kind="stable")]
    return Passages(block.ids, block.items, block.words, block.grams[seeds], block.gram_passage[seeds], block.gram_place[seeds])


def _document_counts(texts: DataFrame, grams: np.ndarray) -> dict[int, int]:
    """Over all documents: in how many each of the block's 3-grams stands."""
    shared = texts.sparkSession.sparkContext.broadcast(np.unique(grams))

    def run(batches):
        wanted = shared.value
        total = np.zeros(len(wanted), np.int64)
        for batch in A.pieces(batches):
            data, offsets = A.byte_view(batch.column(0))
            for i, j in A.slices(offsets):
                words, bounds = A.word_hashes(data, offsets[i:j + 1], A.PUNCTUATION)
                codes, places = _grams(words, bounds)
                at = np.minimum(np.searchsorted(wanted, codes), len(wanted) - 1)
                hit = np.flatnonzero(wanted[at] == codes)
                doc = np.searchsorted(bounds, places[hit], side="right") - 1
                pairs = np.unique(doc * len(wanted) + at[hit])
                total += np.bincount(pairs % len(wanted), minlength=len(wanted))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["seed", "n"])

    sums = texts.mapInArrow(run, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n")).collect()  # one row per seed
    return {int(shared.value[r["seed"]]): r["n"] for r in sums}


def align(item: np.ndarray, doc: np.ndarray) -> int:
    """Value of the best local alignment of two word sequences."""
    n = len(doc)
    slope = np.arange(n + 1) * -GAP
    above, best = np.zeros(n + 1, np.int64), 0
    for word in item:
        row = np.zeros(n + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(doc == word, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope) - slope  # gaps along the row
        best = max(best, int(row.max()))
        above = row
    return best


def _found(words: np.ndarray, bounds: np.ndarray, block: Passages, threshold: float) -> list[tuple[int, int, float]]:
    """(text, number of the item, score) for texts of a slice; per pair the best passage."""
    codes, places = _grams(words, bounds)
    if not len(block.grams) or not len(codes):
        return []
    low, high = np.searchsorted(block.grams, codes, "left"), np.searchsorted(block.grams, codes, "right")
    times = high - low
    some = np.flatnonzero(times)
    if not len(some):
        return []
    seed = A.ragged(low[some], times[some])
    place = np.repeat(places[some], times[some])
    doc = np.searchsorted(bounds, place, side="right") - 1
    passage = block.gram_passage[seed]
    diagonal = place - block.gram_place[seed]
    order = np.lexsort((diagonal, passage, doc))
    doc, passage, diagonal = doc[order], passage[order], diagonal[order]
    lengths = np.array([len(w) for w in block.words], np.int64)
    slack = lengths[passage] // 2 + 4
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (passage[1:] != passage[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(doc)) - 1
    best: dict[tuple[int, int], float] = {}
    for a, b in zip(firsts, lasts, strict=True):
        d, p = int(doc[a]), int(passage[a])
        item = block.words[p]
        key, perfect = (d, int(block.items[p])), MATCH * len(item)
        if best.get(key, -1.0) >= 1.0:
            continue
        start = max(int(bounds[d]), int(diagonal[a]) - int(slack[a]))
        stop = min(int(bounds[d + 1]), int(diagonal[b]) + len(item) + int(slack[a]))
        for at in range(start, stop, 4 * PASSAGE_WORDS):  # a long run of seeds is aligned piece by piece, pieces overlap
            value = align(item, words[at:min(stop, at + 4 * PASSAGE_WORDS + 2 * len(item))])
            if value >= MATCH * min(len(item), LEAST_WORDS):
                best[key] = max(best.get(key, -1.0), value / perfect)
    return [(d, item, score) for (d, item), score in best.items() if score >= threshold]


def _blocks(docs: DataFrame, items: DataFrame, item_col: str, item_text: str, text_col: str, block_words: int):
    """Broadcast blocks of items with their seeds; each holds about block_words words."""
    passages = item_words(items, item_col, item_text)
    total = passages.agg(F.sum(F.length("words"))).first()[0] or 0
    parts = max(1, -(-total // (8 * block_words)))
    texts = docs.select(F.lower(F.col(text_col).cast("string")).alias("text"))
    for part in range(parts):
        rows = passages.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id", "words").collect()
        block = _collect(rows)
        if len(block.grams):
            yield docs.sparkSession.sparkContext.broadcast(_rarest(block, _document_counts(texts, block.grams)))


def contaminations(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text: str = "text", threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score): documents that hold an item whole or edited, score from threshold to 1.

    Words are lower-cased and cut at white space and ASCII punctuation. Items of fewer than three words, null or empty
    ones match nothing, as do null or empty texts; a null item id is an id like others. Items with one id are one item, equal documents
    each give a row. An item longer than 256 words counts by its best passage, so 128 of its words in a row are found wherever they are
    cut out. Items of at most six words match as a whole only, edited ones of at most eleven with the value of six words in a row. No items or no documents give no rows.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    schema = "doc_id bigint, item_id bigint, score double"
    out = docs.sparkSession.createDataFrame([], schema)
    for shared in _blocks(docs, items, item_col, item_text, text_col, block_words):
        def run(batches, shared=shared):
            for batch in A.pieces(batches):
                data, offsets = A.byte_view(batch.column(1))
                ids, rows = [], []
                for i, j in A.slices(offsets):
                    words, bounds = A.word_hashes(data, offsets[i:j + 1], A.PUNCTUATION)
                    for d, item, score in _found(words, bounds, shared.value, threshold):
                        ids.append(i + d)
                        rows.append((shared.value.ids[item], score))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(ids, pa.int64())), pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.float64())], ["doc_id", "item_id", "score"])

        out = out.union(picked.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
          threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item; see contaminations."""
    names = docs.columns
    place = len(names)
    out = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
                      F.lower(F.col(f"`{text_col}`").cast("string")).alias("low"))
    for shared in _blocks(docs, items, item_col, item_text, text_col, block_words):
        def run(batches, shared=shared):
            for batch in A.pieces(batches):
                data, offsets = A.byte_view(batch.column(place))
                keep = np.ones(batch.num_rows, bool)
                for i, j in A.slices(offsets):
                    words, bounds = A.word_hashes(data, offsets[i:j + 1], A.PUNCTUATION)
                    for d, _, _ in _found(words, bounds, shared.value, threshold):
                        keep[i + d] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, T.StructType(out.schema.fields))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
