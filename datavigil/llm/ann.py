"""Operator 2: approximate nearest neighbours with a hierarchical k-means tree, searched best bin first.

A bounded sample is split by k-means again and again into a tree; every vector is put into the leaf that it reaches.
A query walks the tree through a priority queue: the branch whose centre promises the largest inner product goes first,
whichever level it hangs on. How many leaves a query visits is calibrated: a bounded number of queries is answered exactly
against all vectors, the place of the true neighbours' leaves in the queue's order is noted, and visits are widened
until the wanted share of true neighbours is met.

Queries meet vectors by a shuffle on (cell, vector part, query part). A cell is a run of neighbouring leaves of about 4,096
rows, so a query has one answer per cell, not per leaf. A larger leaf, such as one of many equal vectors, is dealt over as
many parts as its rows need, and so are the queries that visit a cell; no task holds more than one part of each.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SAMPLE = 50_000
BRANCHES = 8
LEAF_ROWS = 256
PART_ROWS = 4096
CALIBRATION = 200
RECALL = 0.96


@dataclass
class Tree:
    """children[i] is empty for a leaf; leaf numbers count the leaves in order of nodes."""

    centers: np.ndarray
    children: list[list[int]]
    leaf_of: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.leaf_of >= 0).sum())

    def cells(self, sizes: dict[int, int], cell_rows: int) -> tuple[np.ndarray, dict[int, int]]:
        """Neighbouring leaves put together until a cell has cell_rows rows: the cell of each leaf, and the cells' rows."""
        cell, rows, todo = np.zeros(self.leaves, np.int64), {0: 0}, [0]
        while todo:
            node = todo.pop()
            todo += self.children[node]
            if (leaf := self.leaf_of[node]) >= 0:
                last = len(rows) - 1
                if rows[last] and rows[last] + sizes.get(int(leaf), 0) > cell_rows:
                    last += 1
                    rows[last] = 0
                cell[leaf] = last
                rows[last] += sizes.get(int(leaf), 0)
        return cell, rows

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the tree to the nearest centre."""
        node = np.zeros(len(vectors), np.int64)
        while True:
            moving = np.flatnonzero(self.leaf_of[node] < 0)
            if not len(moving):
                return self.leaf_of[node]
            for parent in np.unique(node[moving]):
                own = moving[node[moving] == parent]
                kids = np.array(self.children[parent])
                node[own] = kids[_nearest(vectors[own], self.centers[kids])]

    def walk(self, query: np.ndarray, visits: int, sizes: np.ndarray | None = None, need: int = 0) -> list[int]:
        """The first leaves in best-bin-first order, and further ones until they hold `need` rows, if sizes are given."""
        promise = self.centers @ query
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < visits or sizes is not None and held < need):
            _, node = heapq.heappop(queue)
            if (leaf := int(self.leaf_of[node])) >= 0:
                out.append(leaf)
                held += 0 if sizes is None else int(sizes[leaf])
            for child in self.children[node]:
                heapq.heappush(queue, (-promise[child], child))
        return out


def _nearest(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (vectors @ centers.T - (centers * centers).sum(axis=1) / 2).argmax(axis=1)


def grow(sample: np.ndarray, leaf_rows: int, branches: int = BRANCHES, seed: int = 2, rounds: int = 8) -> Tree:
    """k-means on the sample, then on each part of more than leaf_rows; equal vectors stay together."""
    random = np.random.default_rng(seed)
    centers, children, todo = [sample.mean(axis=0)], [[]], [(0, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= leaf_rows:
            continue
        own = sample[rows]
        found = own[random.choice(len(rows), min(branches, len(rows)), replace=False)]
        part = np.zeros(len(rows), np.int64)
        for _ in range(rounds):
            part = _nearest(own, found)
            found = np.array([own[part == k].mean(axis=0) if (part == k).any() else found[k] for k in range(len(found))])
        used = [k for k in range(len(found)) if (part == k).any()]
        if len(used) < 2:
            continue
        for k in used:
            centers.append(found[k])
            children.append([])
            children[node].append(len(centers) - 1)
            todo.append((len(centers) - 1, rows[part == k]))
    is_leaf = np.array([not c for c in children])
    return Tree(np.array(centers), children, np.where(is_leaf, np.cumsum(is_leaf) - 1, -1))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows with an id and a vector of finite components that are not all zero."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products added up in one fixed order, so that equal vectors always score the same."""
    return np.add.reduce(queries * vectors, axis=-1)


def _best(q_ids: np.ndarray, queries: np.ndarray, v_ids: np.ndarray, vectors: np.ndarray, k: int,
          visited: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of the k best per query among the rows that it visits, other than the query's own; ties to
    the smaller vec_id. A matrix product finds those that can be among the best, the exact measure orders them."""
    parts = []
    for start in range(0, len(q_ids), 256):
        own = slice(start, start + 256)
        rough = queries[own] @ vectors.T
        rough[q_ids[own][:, None] == v_ids[None, :]] = -np.inf
        if visited is not None:
            rough[~visited[own]] = -np.inf
        near = rough > -np.inf
        if rough.shape[1] > k:
            least = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
            near &= rough >= np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), -np.inf)[:, None]
        q, v = np.nonzero(near)
        score = np.concatenate([_scores(queries[start + q[i:i + 65536]], vectors[v[i:i + 65536]])
                                for i in range(0, len(q), 65536)] or [np.empty(0)])
        order = np.lexsort((v_ids[v], -score, q))
        q, v, score = q[order], v[order], score[order]
        first = np.searchsorted(q, q, side="left")
        best = np.arange(len(q)) - first < k
        parts.append((q_ids[start + q[best]], v_ids[v[best]], score[best]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (
        np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _batch(rows: tuple) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=["query_id", "vec_id", "score"])


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact(good: DataFrame, queries: list, k: int) -> DataFrame:
    """The k best of a bounded list of (vec_id, v) against all rows, with partial answers per task."""
    ids, matrix = np.array([q[0] for q in queries]), np.array([q[1] for q in queries])
    shared = good.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches):
        ids, matrix = shared.value
        for batch in batches:
            if batch.num_rows:
                yield from _batch(_best(ids, matrix, batch.column(0).to_numpy(), _matrix(batch.column(1)), k)).to_batches()

    return _top(good.mapInArrow(run, "query_id bigint, vec_id bigint, score double"), k)


def calibrate(good: DataFrame, tree: Tree, is_query: Column, k: int, recall: float, queries: int) -> int:
    """Leaf visits that reach the recall on a bounded sample of queries, answered exactly."""
    sample = (good.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
              .orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(queries).collect())
    sample = [(r["vec_id"], r["v"]) for r in sample]
    if not sample or tree.leaves < 2:
        return tree.leaves
    truth = exact(good, sample, k).groupBy("query_id", "vec_id").agg(F.count("*").alias("n"))  # at most queries * k rows
    asked = good.sparkSession.createDataFrame(sample, "query_id bigint, q array<double>")
    # of the rows of an id the one nearest to the query, picked in the tasks before it is sent
    product = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x)
    neighbours = (good.join(F.broadcast(truth), "vec_id").join(F.broadcast(asked), "query_id").groupBy("query_id", "vec_id", "n")
                  .agg(F.min_by("v", F.struct(-product, "v")).alias("v")).collect())
    if not neighbours:
        return tree.leaves
    leaf = tree.assign(np.array([r["v"] for r in neighbours]))
    places = {q: {leaf: i for i, leaf in enumerate(tree.walk(np.array(v), tree.leaves))} for q, v in sample}
    at = np.sort(np.repeat([places[r["query_id"]][int(leaf[i])] for i, r in enumerate(neighbours)], [r["n"] for r in neighbours]).astype(int))
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            recall: float = RECALL, leaf_rows: int = LEAF_ROWS, part_rows: int = PART_ROWS, max_sample: int = MAX_SAMPLE,
            calibration: int = CALIBRATION) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query row (is_query on vec_id).

    Vectors that are null, zero or hold null or non-finite components, and rows without an id, take no part; vectors of one
    length are searched among themselves. A row is no candidate for queries of its own id. Repeated rows are candidates
    each; as queries they are answered once for each length, with the smallest vector of the id. Ties go to the smaller
    vec_id. A query gets k rows wherever there are k candidates. No usable rows give no rows. A tree is fitted on at most
    max_sample rows (picked by a hash of the id); every row is in the index.
    """
    good = usable(vectors, id_col, vector_col)
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").collect()  # a row per length
    found = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for length in lengths:
        own = good.where(F.size("v") == length["n"]) if len(lengths) > 1 else good
        found = found.union(_nearest_of(own, length["count"], is_query, k, recall, leaf_rows, part_rows, max_sample, calibration))
    return found


def _nearest_of(good: DataFrame, total: int, is_query: Column, k: int, recall: float, leaf_rows: int, part_rows: int, max_sample: int,
                calibration: int) -> DataFrame:
    sample = good.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(max_sample).select("v").collect()
    sample = np.array([r["v"] for r in sample])
    tree = grow(sample, max(8, leaf_rows * len(sample) // total))
    visits = calibrate(good, tree, is_query, k, recall, calibration)
    spark = good.sparkSession
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.assign(_matrix(batch.column(1))))],
                                                 ["vec_id", "v", "leaf"])

    index = good.mapInArrow(place, "vec_id bigint, v array<double>, leaf bigint")
    # a row per leaf, so at most as many as the sample has rows
    sizes = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}
    cell_of, rows = tree.cells(sizes, part_rows)
    cells = spark.sparkContext.broadcast((cell_of, np.array([sizes.get(i, 0) for i in range(tree.leaves)])))

    def route(batches):
        for batch in batches:
            ids, places, cell, leaves = batch.column(0), [], [], []
            own_rows = batch.column(2).to_pylist()
            for i, q in enumerate(_matrix(batch.column(1)) if batch.num_rows else ()):
                walk = np.array(shared.value.walk(q, visits, cells.value[1], k + own_rows[i]))
                own = cells.value[0][walk]
                for c in np.unique(own):
                    places.append(i)
                    cell.append(c)
                    leaves.append(walk[own == c])
            at = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), batch.column(1).take(at), pa.array(cell, pa.int64()),
                                              pa.array(leaves, pa.list_(pa.int64()))], ["query_id", "q", "cell", "leaves"])

    probes = (good.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"), F.count("*").alias("n"))
              .mapInArrow(route, "query_id bigint, q array<double>, cell bigint, leaves array<bigint>"))
    asked = {r["cell"]: r["count"] for r in probes.groupBy("cell").count().collect()}  # a row per cell
    parts = F.broadcast(spark.createDataFrame(
        [(c, -(-n // part_rows), -(-asked[c] // part_rows)) for c, n in rows.items() if c in asked and n] or [(-1, 1, 1)],
        "cell bigint, v_parts int, q_parts int"))
    leaf_cells = F.broadcast(spark.createDataFrame([(i, int(c)) for i, c in enumerate(cell_of)], "leaf bigint, cell bigint"))
    index = index.join(leaf_cells, "leaf").join(parts, "cell").select(
        "cell", "leaf", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.col("v_parts")).cast("int").alias("v_part"),
        F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)).alias("q_part"))
    probes = probes.join(parts, "cell").select(
        "cell", "leaves", "query_id", "q", F.pmod(F.xxhash64("query_id"), F.col("q_parts")).cast("int").alias("q_part"),
        F.explode(F.sequence(F.lit(0), F.col("v_parts") - 1)).alias("v_part"))

    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return _batch(([], [], []))
        q, v = queries.combine_chunks(), rows.combine_chunks()
        used, leaf = np.unique(v.column("leaf").to_numpy(), return_inverse=True)
        visits = np.array([np.isin(used, walk) for walk in q.column("leaves").to_pylist()])
        return _batch(_best(q.column("query_id").to_numpy(), _matrix(q.column("q").combine_chunks()), v.column("vec_id").to_numpy(),
                            _matrix(v.column("v").combine_chunks()), k, visits[:, leaf]))

    keys = ["cell", "v_part", "q_part"]
    found = probes.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
