"""Operator 12: ranked lexical search of items in documents by a dual tree.

1. One pass over the texts gives per document its number of terms and, for the terms of the items only, how often each
   stands in it. Texts are cut into runs as an Arrow dictionary, so each distinct term of a slice is looked up once.
2. Document counts of the terms, the number of documents and of all terms are sums over that table. They make the weights.
3. Items form a tree (parted again and again along the direction in which they differ most), and so do the documents of each run of
   a task. A node holds the maximum over its members for each term: of an item node whether any member has it, of a document
   node the largest contribution to a score. The product of two nodes bounds the score of every pair below them. Level by level
   the bounds of all pairs of nodes that are left are one matrix product, and pairs below the weakest kth score of the
   node's items go, whole batches at a time. Leaves are scored in order of their bounds, so kth scores rise early.
4. Each task hands on the k best documents of each item; the best of these are the result. Pruned is only what lies strictly
   below k documents already found, so nothing is lost.
"""

from __future__ import annotations

import heapq
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datavigil.llm import arrays as A
from datavigil.llm import pretokens as P
from datavigil.llm.components import stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Items per block; each block is a pass over the texts, its terms are broadcast.
BLOCK_ITEMS = 2048
MAX_BLOCK_BYTES = 1 << 26
#: Documents and postings of a run, and members of a leaf.
RUN_DOCS, RUN_POSTINGS = 512, 1 << 18
DOC_LEAF, ITEM_LEAF = 16, 8
SLICE_BYTES = 1 << 22
_EXACT = 1 << 53

_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_CASE = {i: i + 32 for i in range(0x41, 0x5B)}


def terms(text: str | None) -> list[str]:
    """The terms of a text, A-Z lower-cased."""
    return re.findall(TERM, (text or "").translate(_CASE))


@dataclass
class Items:
    """A block of items: ids, the terms and which of them each item has, as (item, term) pairs in order of items."""

    ids: list
    vocabulary: dict[str, int]
    owner: np.ndarray
    term: np.ndarray


def _blocks(items: DataFrame, item_col: str, text_col: str, block_items: int):
    """Items in blocks of about block_items; of rows with one id the least text counts, items without terms are left out."""
    one = (items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
           .groupBy("item_id").agg(F.min("text").alias("text")).where("text IS NOT NULL"))
    parts = max(1, -(-one.count() // block_items))
    for part in range(parts):
        rows = one.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id").collect()
        vocabulary: dict[str, int] = {}
        ids, owner, term = [], [], []
        for r in rows:
            own = sorted(set(terms(r["text"])))
            if own:
                owner += [len(ids)] * len(own)
                term += [vocabulary.setdefault(t, len(vocabulary)) for t in own]
                ids.append(r["item_id"])
        size = sum(map(len, vocabulary)) + 80 * len(vocabulary) + 16 * len(owner)
        if size > MAX_BLOCK_BYTES:
            raise ValueError(f"the terms of a block of items have {size} bytes, more than the {MAX_BLOCK_BYTES} that may be broadcast; set block_items lower")
        if ids:
            yield Items(ids, vocabulary, np.array(owner, np.int64), np.array(term, np.int64))


def _postings(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, text) -> (doc_id, n, terms, tfs): number of terms, and the vocabulary's terms in it with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        vocabulary = shared.value
        for batch in A.pieces(batches):
            _, offsets = A.byte_view(batch.column(1))
            for i, j in A.slices(offsets, SLICE_BYTES):
                rows = batch.slice(i, j - i)
                runs, codes, bounds = P.runs(rows.column(1), _IS_TERM, lower=True)
                is_term = np.fromiter((_IS_TERM[r.encode()[0]] for r in runs), bool, len(runs))
                place = np.fromiter((vocabulary.get(r, -1) for r in runs), np.int64, len(runs))
                count = np.concatenate(([0], np.cumsum(is_term[codes])))
                n = count[bounds[1:]] - count[bounds[:-1]]
                own = place[codes]
                hit = np.flatnonzero(own >= 0)
                doc = np.searchsorted(bounds, hit, side="right") - 1
                pairs, tf = np.unique(doc * len(vocabulary) + own[hit], return_counts=True)
                cuts = np.searchsorted(pairs, np.arange(j - i + 1) * len(vocabulary))
                term = pairs % len(vocabulary)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(n, pa.int64()),
                     *(pa.array([P.pack_numbers(x[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for x in (term, tf))],
                    ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, terms binary, tfs binary")


def _statistics(postings: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and the number of documents of each term, over all documents."""

    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            for own in batch.column(0).to_pylist():
                df[P.unpack_numbers(own)] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], ["term", "df"])

    sums = postings.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("all")).first()
    df = np.zeros(size, np.int64)
    for r in postings.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]  # one row for each term of the block
    return sums["docs"], sums["all"] or 0, df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m), m = 10 + (90 n N) div L, for postings with their documents' numbers of terms."""
    if len(n) and 90 * int(n.max()) * n_docs >= 1 << 63:
        n = n.astype(object)
    m = (10 + 90 * n * n_docs // max(n_terms, 1)).astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _spread(rows: np.ndarray, steps: int = 4) -> np.ndarray:
    """Places of rows along the direction in which they differ most, by a few steps of the power method."""
    apart = (rows - rows.mean(axis=0)).astype(np.float32)
    along = apart[int(np.argmax((apart * apart).sum(axis=1)))]
    for _ in range(steps):
        places = apart @ along
        length = np.abs(places).max()
        if not length:
            break
        along = (places / length) @ apart
    return apart @ along


class Tree:
    """Rows of a matrix, parted along the direction in which they differ most, at the widest step of the middle half, until a
    node has at most `leaf` rows.

    levels[k] has (start, stop) into `order` for the nodes of depth k; every node of the last level is a leaf, a leaf that
    comes earlier is repeated. parents[k] names the node of depth k - 1 above.
    """

    def __init__(self, rows: np.ndarray, leaf: int):
        self.order = np.arange(len(rows))
        self.levels, self.parents = [np.array([[0, len(rows)]])], [np.zeros(1, np.int64)]
        while (self.levels[-1][:, 1] - self.levels[-1][:, 0]).max() > leaf:
            below, parents = [], []
            for no, (a, b) in enumerate(self.levels[-1]):
                parents.append(no)
                if b - a <= leaf:
                    below.append((a, b))
                    continue
                own = self.order[a:b]
                places = _spread(rows[own])
                by = np.argsort(places, kind="stable")
                self.order[a:b] = own[by]
                steps = np.diff(places[by])[(b - a) // 4:(b - a) - (b - a) // 4]
                mid = a + (b - a) // 4 + int(np.argmax(steps)) + 1
                below += [(a, mid), (mid, b)]
                parents.append(no)
            self.levels.append(np.array(below))
            self.parents.append(np.array(parents))

    def maxima(self, rows: np.ndarray) -> list[np.ndarray]:
        """For each level the maximum of each column over the rows of each node."""
        out = [np.maximum.reduceat(rows[self.order], self.levels[-1][:, 0], axis=0)]
        for parents in self.parents[:0:-1]:
            out.append(np.maximum.reduceat(out[-1], np.flatnonzero(np.diff(parents, prepend=-1)), axis=0))
        return out[::-1]


class Best:
    """The k best documents of each item, and the score that a further one must reach."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.heaps: list[list] = [[] for _ in range(items)]
        self.least = np.ones(items)  # scores are whole numbers above 0

    def offer(self, item: int, score: int, order: int, doc) -> None:
        heap, entry = self.heaps[item], (score, -order, doc)
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry[:2] > heap[0][:2]:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.least[item] = heap[0][0]


def search_run(members: np.ndarray, item_tree: Tree, docs: np.ndarray, ids: list, best: Best) -> int:
    """Offers the documents (rows of contributions by term) to the items (0/1 rows over the same terms); the number of pairs
    of an item and a document that were scored."""
    tree = Tree(docs, DOC_LEAF)
    item_max, doc_max = item_tree.maxima(members), tree.maxima(docs)
    depth = max(len(item_max), len(doc_max))
    alive = np.ones((1, 1), bool)
    for level in range(depth):
        il, dl = min(level, len(item_max) - 1), min(level, len(doc_max) - 1)
        if 0 < level < len(item_max):
            alive = alive[item_tree.parents[level]]
        if 0 < level < len(doc_max):
            alive = alive[:, tree.parents[level]]
        weakest = np.minimum.reduceat(best.least[item_tree.order], item_tree.levels[il][:, 0])
        rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(rows):
            return 0
        bounds = np.zeros(alive.shape)
        bounds[np.ix_(rows, columns)] = item_max[il][rows] @ doc_max[dl][columns].T
        alive = alive & (bounds >= weakest[:, None])
    scored = 0
    pairs = np.argwhere(alive)
    for i, d in pairs[np.argsort(-bounds[alive], kind="stable")]:
        (a, b), (c, e) = item_tree.levels[-1][i], tree.levels[-1][d]
        items, rows = item_tree.order[a:b], tree.order[c:e]
        if bounds[i, d] < best.least[items].min():
            continue
        used = np.flatnonzero(item_max[-1][i])
        scores = docs[np.ix_(rows, used)] @ members[np.ix_(items, used)].T
        scored += scores.size
        for x, y in np.argwhere(scores >= best.least[items]):
            best.offer(int(items[y]), int(scores[x, y]), *ids[rows[x]])
    return scored


def _search(postings: DataFrame, block: Items, n_docs: int, n_terms: int, df: np.ndarray, k: int) -> DataFrame:
    """(item_id, doc_id, score): of every task the k best documents of each item."""
    size = len(block.vocabulary)
    weight = weights(n_docs, df)
    most = int(np.bincount(block.owner).max()) * int(weight.max(initial=0)) * 1_000_000
    kind = np.float64 if most < _EXACT else np.int64  # sums stay whole numbers
    shared = postings.sparkSession.sparkContext.broadcast((block.ids, block.owner, block.term, weight))

    def run(batches):
        ids, owner, term, weight = shared.value
        members = np.zeros((len(ids), size), np.int8)
        members[owner, term] = 1
        tree = Tree(members.astype(np.float32) * weight, ITEM_LEAF)
        best = Best(len(ids), k)
        waiting: list[tuple] = []

        def search():
            own = [P.unpack_numbers(w[2]) for w in waiting]
            tf = np.concatenate([P.unpack_numbers(w[3]) for w in waiting])
            counts = np.array([len(x) for x in own])
            flat = np.concatenate(own)
            used, column = np.unique(flat, return_inverse=True)  # terms that stand in these documents
            if not len(used):
                return
            n = np.repeat(np.array([w[1] for w in waiting], np.int64), counts)
            docs = np.zeros((len(waiting), len(used)), kind)
            docs[np.repeat(np.arange(len(waiting)), counts), column] = weight[flat] * impacts(tf, n, n_docs, n_terms)
            search_run(members[:, used].astype(kind), tree, docs, [(w[4], w[0]) for w in waiting], best)

        held = 0
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for doc, n, own, tfs in zip(docs, *(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                if own:
                    waiting.append((doc, n, own, tfs, (1 << 63) if doc is None else doc))
                    held += len(own)
                if len(waiting) >= RUN_DOCS or held >= RUN_POSTINGS:
                    search()
                    waiting.clear()
                    held = 0
        if waiting:
            search()
        found = [(ids[i], doc, score) for i, heap in enumerate(best.heaps) for score, _, doc in heap]
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], ["item_id", "doc_id", "score"])

    return postings.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 of each item, equal scores by ascending doc_id.

    Terms are runs of letters and digits of ASCII and of all other characters, A-Z lower-cased, of whole texts; a null text has none.
    The score sums, over an item's distinct terms, floor(1000 ln((2N + 2) / (2 df + 1))) times (10^9 tf) div (1000 tf + 8 m) with
    m = 10 + (90 n N) div L. Items without terms, and empty tables, give no rows. Of items with one id the least text counts; a null
    item id is an id like others. Every row of docs is a document, so repeated rows stand for themselves; a null doc_id comes
    last among equal scores. Other columns are not read.
    """
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    for block in _blocks(items, item_col, item_text, block_items):
        postings = stored(_postings(picked, block.vocabulary))
        n_docs, n_terms, df = _statistics(postings, len(block.vocabulary))
        if n_docs:
            out = out.union(_search(postings, block, n_docs, n_terms, df, k))
    best = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return out.withColumn("rank", best).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search_sql(k: int = 10) -> str:
    upper = "".join(map(chr, range(0x41, 0x5B)))
    return f"""
WITH own AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '{TERM}')) AS term FROM documents),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '{TERM}')) AS term FROM benchmark),
sizes AS (SELECT doc_id, count(*) AS n FROM own GROUP BY doc_id),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
tfs AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM own WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
ws AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, whole GROUP BY term, docs),
scored AS (
  SELECT item_id, tfs.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * docs) // terms)))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN ws USING (term) JOIN sizes ON sizes.doc_id = tfs.doc_id, whole GROUP BY item_id, tfs.doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""
