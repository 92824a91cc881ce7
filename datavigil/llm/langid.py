"""Operator 7: language by string kernels.

A text is the set of its character n-grams of lengths 1 to 3 (presence, hashed, whole text, lower case). The kernel of two
texts is the mean over the lengths of shared n-grams divided by the geometric mean of the two set sizes. Nyström landmarks
(a bounded number of training texts per language) turn it into features, one ridge regression per language against the
rest is solved on them, and all texts are scored by products of batches with the landmarks.

The regressions only tell the learnt languages from each other. Whether a text is of the language that wins is told by its
kernel with that language's nearest landmark: a bound for each language and size of text, below which nearly no training
row of the language lies. It does not depend on the other languages.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datavigil.llm import arrays as A


#: Hash places of the n-grams of each length.
PLACES = (1 << 9, 1 << 12, 1 << 13)
#: Bounds of the training sample.
LANDMARKS_PER_LANG = 24
ROWS_PER_LANG = 1500
#: Languages whose training rows are on the driver at a time.
LANGS_AT_ONCE = 32
RIDGE = 1e-2
SLICE_CHARS = 1 << 20
#: Beginnings of training rows that the bounds of short texts are calibrated on: rows per language, and beginnings of each.
BEGUN_ROWS, BEGINNINGS = 500, 2
#: Share of a language's calibration rows that the bound may reject, the least number of them for a bound, and sizes per octave.
LOST_OWN = 0.002
LEAST_ROWS = 50
STEPS, SIZES = 2, 28
_STARTS = np.concatenate(([0], np.cumsum(PLACES)))


def presence(texts: list[str]) -> np.ndarray:
    """0/1 rows of hashed n-grams; a text without n-grams of a length has zeros there."""
    out = np.zeros((len(texts), int(_STARTS[-1])), np.uint8)
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    code = np.zeros(len(chars), np.uint64)
    for k, places in enumerate(PLACES):
        if len(chars) <= k:
            break
        code = code[:len(chars) - k] * np.uint64(0x100000001B3) + chars[k:] + np.uint64(1)
        same = owner[:len(code)] == owner[k:]
        spots = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(places).bit_length() + 1)
        out[owner[:len(code)][same], spots[same].astype(np.int64) + _STARTS[k]] = 1
    return out


def normalized(rows: np.ndarray) -> np.ndarray:
    """Rows so that the product of two is their kernel."""
    out = rows.astype(np.float32)
    for a, b in zip(_STARTS[:-1], _STARTS[1:], strict=True):
        out[:, a:b] /= np.sqrt(np.maximum(out[:, a:b].sum(axis=1, keepdims=True), 1) * len(PLACES))
    return out


def _slices(texts: list):
    """Texts in runs of bounded length; rows of a run are bounded too, as each has a row of all hash places."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if chars > SLICE_CHARS or i - start >= 256:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


@dataclass
class Model:
    """Landmarks in order of languages, one column of weights per language, the languages, the place of each one's first
    landmark, and the least kernel of each with its texts by size. Without languages everything is `und`."""

    landmarks: np.ndarray
    weights: np.ndarray
    langs: list[str]
    firsts: np.ndarray
    bounds: np.ndarray


def _beginnings(texts: list[str], ids: list[int], ranks: list[int]) -> list[tuple[int, str]]:
    """(row, beginning) with lengths of 4 to 1,024 characters that follow from the id."""
    out = []
    for i, (text, own, rank) in enumerate(zip(texts, ids, ranks, strict=True)):
        for k in range(BEGINNINGS if rank <= BEGUN_ROWS else 0):
            cut = int(2 ** (2 + 8 * zlib.crc32(f"{own} {k}".encode()) / 2 ** 32))
            if cut < len(text) and any(map(str.isalpha, text[:cut])):
                out.append((i, text[:cut]))
    return out


def _size(rows: np.ndarray) -> np.ndarray:
    """Step of the number of n-grams of each row."""
    return np.minimum(np.log2(np.maximum(rows.sum(axis=1, dtype=np.int64), 1)) * STEPS, SIZES - 1).astype(np.int64)


def _bounds(kernel: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bound for each size from a language's calibration rows of that size and the one below, and of smaller ones (whose
    kernels are smaller) if those are too few; 0, which rejects nothing, if all are too few."""
    out = np.zeros(SIZES)
    for k in range(SIZES):
        for low in range(k - 1, -2, -1):
            own = kernel[(size <= k) & (size >= low)]
            if len(own) >= LEAST_ROWS:
                out[k] = np.quantile(own, LOST_OWN, method="lower")
                break
    return out


def held_out(id_col: Column) -> Column:
    """Rows that are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          landmarks_per_lang: int = LANDMARKS_PER_LANG, rows_per_lang: int = ROWS_PER_LANG,
          langs_at_once: int = LANGS_AT_ONCE, seed: int = 7) -> Model:
    """Learns every language, from at most rows_per_lang rows of each, picked by a hash of the id.

    Rows without an id, a text with a letter or a language, and held-out rows are not learnt from. Of rows with the same id
    one is learnt from, and rows are counted by distinct ids.
    """
    usable = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    usable = usable.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id")))
    order = F.xxhash64(F.lit(seed), "doc_id")
    narrow = usable.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    # first within parts of a language, then among the parts' best, so that no task gets all rows of a language
    picked = narrow.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(64)))
    for by in (["lang", "part"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(order, "doc_id"))
        picked = picked.withColumn("rank", rank).where(F.col("rank") <= rows_per_lang)
    sample = usable.join(F.broadcast(picked.select("doc_id", "lang", "rank")), ["doc_id", "lang"]).withColumn("key", F.xxhash64("text"))

    def vectors(batches):
        for batch in A.pieces(batches):
            texts = batch.column("text").to_pylist()
            for i, j in _slices(texts):
                own = batch.slice(i, j - i)
                letters = pa.array([any(map(str.isalpha, t)) for t in texts[i:j]])
                begun: list[list[bytes]] = [[] for _ in range(i, j)]
                cuts = _beginnings(texts[i:j], own.column("doc_id").to_pylist(), own.column("rank").to_pylist())
                for start in range(0, len(cuts), 256):
                    part = cuts[start:start + 256]
                    for (at, _), row in zip(part, np.packbits(presence([t for _, t in part]), axis=1), strict=True):
                        begun[at].append(row.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("lang"), own.column("rank"), letters,
                     pa.array([r.tobytes() for r in np.packbits(presence(texts[i:j]), axis=1)], pa.binary()),
                     pa.array(begun, pa.list_(pa.binary())), own.column("key")], ["doc_id", "lang", "rank", "letters", "bits", "begun", "key"])

    found = sample.mapInArrow(vectors, "doc_id bigint, lang string, rank int, letters boolean, bits binary, begun array<binary>, key bigint")
    # copies of an id are put together in their tasks before they are sent
    one = F.min_by(F.struct("lang", "rank", "bits", "begun"), "key").alias("one")
    found = found.where("letters").groupBy("doc_id").agg(one).select("doc_id", "one.*").persist(StorageLevel.DISK_ONLY)
    try:
        return _fit(found, landmarks_per_lang, langs_at_once)
    finally:
        found.unpersist()


def _unpacked(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(packed, axis=1, count=int(_STARTS[-1]))


def _matrix(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)


def _fit(found: DataFrame, landmarks_per_lang: int, langs_at_once: int) -> Model:
    """The model of the training rows. The driver holds those of langs_at_once languages and sums over all of them."""
    def ordered(rows: DataFrame):
        return rows.toPandas().sort_values(["lang", "rank", "doc_id"])

    listed = ordered(found.select("lang", "rank", "doc_id"))
    names = sorted(listed["lang"].unique())
    if not names:
        return Model(np.zeros((0, int(_STARTS[-1])), np.float32), np.zeros((0, 0)), [], np.zeros(0, np.int64), np.zeros((0, SIZES)))
    heads = listed.groupby("lang").head(landmarks_per_lang)
    ids = found.sparkSession.createDataFrame([(int(i),) for i in heads["doc_id"]], "doc_id bigint")
    heads = ordered(found.drop("begun").join(F.broadcast(ids), "doc_id"))
    place_of = {i: k for k, i in enumerate(heads["doc_id"])}
    landmarks = normalized(_unpacked(_matrix(list(heads["bits"]))))
    firsts = np.searchsorted(heads["lang"].to_numpy(), names)
    stops = [*firsts[1:], len(heads)]
    values, vectors_ = np.linalg.eigh((landmarks @ landmarks.T).astype(float))
    root = vectors_ / np.sqrt(np.maximum(values, 1e-6))  # features z = k(x, landmarks) root
    squares, sums, bounds = np.zeros((len(heads) + 1, len(heads) + 1)), np.zeros((len(heads) + 1, len(names))), []
    for at in range(0, len(names), langs_at_once):
        group = ordered(found.where(F.col("lang").isin(names[at:at + langs_at_once])))
        for k, name in enumerate(names[at:at + langs_at_once], at):
            members = group[group["lang"] == name]
            begun = [(i, b) for i, found_ in enumerate(members["begun"]) for b in found_]
            owner = np.array([*range(len(members)), *(i for i, _ in begun)])
            place = np.array([place_of.get(i, -1) for i in members["doc_id"]])[owner]
            packed = _matrix([*members["bits"], *(b for _, b in begun)])
            kernels, sizes = [], []
            for part in np.array_split(np.arange(len(owner)), len(owner) // 512 + 1):
                marks = _unpacked(packed[part])
                kernel = normalized(marks) @ landmarks.T
                whole = kernel[part < len(members)].astype(float)
                z = np.column_stack((whole @ root, np.ones(len(whole))))
                squares += z.T @ z / len(members)  # languages weigh alike
                sums[:, k] += z.sum(axis=0) / len(members)
                # the bound is of the kernels with the other landmarks of the language
                near = kernel[:, firsts[k]:stops[k]]
                near[place[part][:, None] == np.arange(firsts[k], stops[k])[None, :]] = 0
                kernels.append(near.max(axis=1))
                sizes.append(_size(marks))
            bounds.append(_bounds(np.concatenate(kernels), np.concatenate(sizes)))
    targets = 2 * sums - sums.sum(axis=1, keepdims=True)  # 1 for the rows of a language, -1 for all others
    solved = np.linalg.solve(squares + RIDGE * np.diag([1.0] * root.shape[1] + [0.0]), targets)
    weights = np.vstack((root @ solved[:-1], solved[-1:]))
    return Model(landmarks, weights, names, firsts, np.array(bounds))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1: half of one plus the regression's value, cut to that range) and lang_known.

    lang_known is false where the text's kernel with the nearest landmark of lang_pred lies below the bound for texts of its
    size, as in a language that was not learnt, and for `und`.

    Only the text is looked at. A text that is null or has no letter is `und` with score 0; so is everything if nothing was
    learnt. Of equal values the first language in order of text wins. Columns of docs with these names are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_known")
    names = docs.columns
    place = names.index(text_col)
    safe = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in A.pieces(batches):
            texts = batch.column(place).to_pylist()
            langs, scores, known = [], [], []
            for i, j in _slices(texts):
                own = [t or "" for t in texts[i:j]]
                letters = [any(map(str.isalpha, t)) for t in own]
                if not model.langs:
                    langs += ["und"] * len(own)
                    scores += [0.0] * len(own)
                    known += [False] * len(own)
                    continue
                marks = presence(own)
                kernel = normalized(marks) @ model.landmarks.T
                values = kernel.astype(float) @ model.weights[:-1] + model.weights[-1]
                best = values.argmax(axis=1)
                near = np.maximum.reduceat(kernel, model.firsts, axis=1)[np.arange(len(own)), best]
                known += list((near >= model.bounds[best, _size(marks)]) & np.array(letters))
                top = np.clip((values[np.arange(len(own)), best] + 1) / 2, 0, 1)
                langs += [model.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                scores += [float(t) if ok else 0.0 for t, ok in zip(top, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                                              pa.array(known, pa.bool_())], [*batch.schema.names, "lang_pred", "lang_score", "lang_known"])

    schema = T.StructType([*safe.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()),
                           T.StructField("lang_known", T.BooleanType())])
    out = safe.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "lang_pred", "lang_score", "lang_known")
