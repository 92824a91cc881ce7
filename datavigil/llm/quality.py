"""Operator 4: quality classifier by co-training of two views.

The text view sees measures of the whole text (kinds of characters, repeated words and lines), the metadata view sees
source, language and length as recorded. Both learn from a bounded sample of labelled rows; in each round each view labels
a bounded pool of unlabelled rows and hands its most confident answers to the other. Both are then calibrated on labelled
rows kept apart, and a last regression joins the two calibrated scores. All rows are scored where they are, no shuffle.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datavigil.llm import arrays as A

#: Bounds of the samples that the driver learns from.
MAX_LABELLED = 20_000
MAX_POOL = 10_000
ROUNDS = 4
CONFIDENT = 0.97
PER_ROUND = 500
#: Share of good rows of the calibration part that the threshold may reject.
LOST_GOOD = 0.002
SOURCES, LANGS = 64, 16

_CLASS = np.full(256, 7, np.int64)  # other control and punctuation bytes
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[range(0x61, 0x7B)] = 1
_CLASS[range(0x41, 0x5B)] = 2
_CLASS[range(0x30, 0x3A)] = 3
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 4
_CLASS[ord("!")] = 5
_CLASS[[ord(c) for c in "#$%&*@^~_+=<>/\\|{}[]`"]] = 6
_CLASS[128:] = 8
N_CLASSES = 9
N_TEXT = N_CLASSES + 6
_IS_LINE_END = np.zeros(256, bool)
_IS_LINE_END[0x0A] = True


def text_measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of N_TEXT measures of the texts; an empty text has zeros and its own mark."""
    first, bounds = int(offsets[0]), offsets - offsets[0]
    chars, n = data[first:int(offsets[-1])], len(offsets) - 1
    size = np.diff(bounds)
    owner = np.repeat(np.arange(n), size)
    shares = np.bincount(owner * N_CLASSES + _CLASS[chars], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    out = np.zeros((n, N_TEXT))
    out[:, :N_CLASSES] = np.log(shares / np.maximum(size, 1)[:, None] + 1e-3)
    words, starts = A.word_hashes(data, offsets)
    lines, line_starts = A.word_hashes(data, offsets, _IS_LINE_END)
    counts, line_counts = np.diff(starts), np.diff(line_starts)
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    if len(words):
        again[starts[:-1][counts > 0]] = False
    sums = np.concatenate(([0], np.cumsum(again)))
    repeated = (sums[starts[1:]] - sums[starts[:-1]]) / np.maximum(counts, 1)
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(starts[:-1], starts[1:], strict=True)], float)
    distinct_lines = np.array([len(np.unique(lines[a:b])) for a, b in zip(line_starts[:-1], line_starts[1:], strict=True)], float)
    out[:, N_CLASSES] = np.log(repeated + 1e-3)
    out[:, N_CLASSES + 1] = np.log((distinct + 1) / (np.sqrt(counts * 40.0) + 1))
    out[:, N_CLASSES + 2] = (distinct_lines + 1) / (line_counts + 1)
    out[:, N_CLASSES + 3] = np.log1p(size / np.maximum(counts, 1))
    out[:, N_CLASSES + 4] = np.log1p(size)
    out[:, N_CLASSES + 5] = size == 0
    return out


def metadata_measures(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Rows of marks for the hashed source and language (one place for null each) and the recorded length."""
    out = np.zeros((len(lang), SOURCES + LANGS + 4))
    for i, (own_lang, own_source, chars) in enumerate(zip(lang, source, n_chars, strict=True)):
        out[i, SOURCES if own_source is None else zlib.crc32(own_source.encode()) % SOURCES] = 1
        out[i, SOURCES + 1 + (LANGS if own_lang is None else zlib.crc32(own_lang.encode()) % LANGS)] = 1
        out[i, -2] = 0.0 if chars is None else np.log1p(max(chars, 0)) / 10
        out[i, -1] = chars is None
    return out


@dataclass
class Logistic:
    """Logistic regression with a ridge, on scaled columns, by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            curve = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(curve, z.T @ (y - p) - penalty * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        return Logistic(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.column_stack(((x - self.mean) / self.scale, np.ones(len(x)))) @ self.weights, -30, 30)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


@dataclass
class Model:
    """Two calibrated views and their combination. Without both labels in the sample every row scores `prior`."""

    text: Logistic | None
    metadata: Logistic | None
    calibrate: tuple[Logistic, Logistic] | None
    combine: Logistic | None
    threshold: float
    prior: float

    def views(self, x_text: np.ndarray, x_meta: np.ndarray) -> np.ndarray:
        return np.column_stack([c.logit(v.logit(x)[:, None]) for c, v, x in zip(
            self.calibrate, (self.text, self.metadata), (x_text, x_meta), strict=True)])

    def score(self, x_text: np.ndarray, x_meta: np.ndarray) -> np.ndarray:
        if self.combine is None:
            return np.full(len(x_text), self.prior)
        return self.combine.score(self.views(x_text, x_meta))


def _measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_chars, label, text) -> doc_id, label, text measures, metadata measures; of rows with the same
    doc_id one, by a hash of what is measured."""

    def run(batches):
        for batch in A.pieces(batches):
            data, offsets = A.byte_view(batch.column("text"))
            for i, j in A.slices(offsets):
                rows = batch.slice(i, j - i)
                x = text_measures(data, offsets[i:j + 1])
                m = metadata_measures(*(rows.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), pa.array(list(x)), pa.array(list(m)),
                                                  rows.column("key")], ["doc_id", "label", "x", "m", "key"])

    found = docs.select("doc_id", "lang", "source", "n_chars", "label", "text", F.xxhash64("text", "lang", "source", "n_chars").alias("key")).mapInArrow(
        run, "doc_id bigint, label int, x array<double>, m array<double>, key bigint")
    # copies of an id are put together in their tasks before they are sent
    return found.groupBy("doc_id").agg(F.min_by(F.struct("label", "x", "m"), "key").alias("one")).select("doc_id", "one.*")


def _columns(docs: DataFrame) -> DataFrame:
    """docs with the columns that are read in their kinds; a column that is not there counts as null."""
    kinds = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = MAX_LABELLED,
          max_pool: int = MAX_POOL, rounds: int = ROUNDS, seed: int = 4) -> Model:
    """Learns from at most max_labelled labelled rows and max_pool others, picked by a hash of doc_id.

    Labels are 0 or 1; null ids, null labels and ids with both labels are left out. If either label is missing, the model
    knows nothing and keeps all rows.
    """
    docs = _columns(docs)
    order = F.xxhash64(F.lit(seed), "doc_id")
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
             .where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id")
             .agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other"))
    present = docs.select("doc_id")
    picked = known.join(present, "doc_id", "left_semi").orderBy(order, "doc_id").limit(max_labelled)
    others = (present.where("doc_id IS NOT NULL").join(labels.select(F.col("doc_id").cast("bigint").alias("doc_id")), "doc_id", "left_anti")
              .distinct().orderBy(order, "doc_id").limit(max_pool).withColumn("label", F.lit(-1)))
    sample = picked.union(others)  # at most max_labelled + max_pool narrow rows
    rows = _measured(docs.join(F.broadcast(sample), "doc_id")).toPandas().sort_values("doc_id")
    label, ids = rows["label"].to_numpy(int), rows["doc_id"].to_numpy(np.int64)
    apart = A.mix(ids.astype(np.uint64) + np.uint64(seed)) % np.uint64(10) < 3
    learn, check, pool = np.flatnonzero((label >= 0) & ~apart), np.flatnonzero((label >= 0) & apart), np.flatnonzero(label < 0)
    if any(len(np.unique(label[part])) < 2 for part in (learn, check)):
        return Model(None, None, None, None, 0.0, float(label[label >= 0].mean()) if (label >= 0).any() else 0.5)
    x, m = (np.array(list(rows[c]), float) for c in ("x", "m"))
    views, inputs = [None, None], (x, m)
    given: list[dict[int, int]] = [{}, {}]  # pseudo-labels that each view has got from the other
    for _ in range(max(rounds, 0) + 1):
        for k in (0, 1):
            more = np.array(sorted(given[k]), np.int64)
            places = np.concatenate((learn, more))
            y = np.concatenate((label[learn], [given[k][i] for i in more])).astype(float)
            views[k] = Logistic.fit(inputs[k][places], y)
        for k in (0, 1):
            free = np.array([i for i in pool if i not in given[1 - k]], np.int64)
            if not len(free):
                continue
            p = views[k].score(inputs[k][free])
            for answer, sure in ((1, p), (0, 1 - p)):
                best = np.argsort(-sure, kind="stable")[:PER_ROUND]
                given[1 - k].update({int(free[i]): answer for i in best if sure[i] >= CONFIDENT})
    y = label[check].astype(float)
    calibrate = tuple(Logistic.fit(v.logit(z[check])[:, None], y, 0.1) for v, z in zip(views, inputs, strict=True))
    model = Model(views[0], views[1], calibrate, None, 0.5, float(y.mean()))
    model.combine = Logistic.fit(model.views(x[check], m[check]), y, 0.1)
    good = model.score(x[check], m[check])[y == 1]
    model.threshold = float(min(0.5, np.quantile(good, LOST_GOOD)))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with quality_score (0 to 1) and quality_kept.

    Every row is scored from its whole text and its lang, source and n_chars, null or missing ones included; a null text
    counts as empty. Columns of docs with these names are replaced.
    """
    docs = docs.drop("quality_score", "quality_kept")
    names = docs.columns
    safe = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    place = {c: names.index(c) for c in ("text", "lang", "source", "n_chars") if c in names}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in A.pieces(batches):
            def column(name, kind, batch=batch):
                return batch.column(place[name]).cast(kind) if name in place else pa.nulls(batch.num_rows, kind)

            data, offsets = A.byte_view(column("text", pa.string()))
            lang, source, n_chars = column("lang", pa.string()), column("source", pa.string()), column("n_chars", pa.int64())
            scores = [np.empty(0)]
            for i, j in A.slices(offsets):
                m = metadata_measures(*(c.slice(i, j - i).to_pylist() for c in (lang, source, n_chars)))
                scores.append(model.score(text_measures(data, offsets[i:j + 1]), m))
            scores = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array(scores >= model.threshold)],
                                             [*batch.schema.names, "quality_score", "quality_kept"])

    schema = T.StructType([*safe.schema.fields, T.StructField("quality_score", T.DoubleType()), T.StructField("quality_kept", T.BooleanType())])
    out = safe.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "quality_score", "quality_kept")
