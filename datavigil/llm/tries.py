"""Operator 13: prefix trie of conversations by adaptive radix trees.

1. A turn is known by a digest of 16 bytes of its role and text, a fixed-width big-endian id; a conversation is the bytes of
   its turns' ids. Equal conversations are one key with a count before anything is sorted.
2. Keys are sorted by range. Each task feeds runs of its keys to an adaptive radix tree (nodes of 4, 16, 48 or 256 children
   that grow as needed, common bytes kept as a path) and walks it upwards; only byte depths that end a turn emit nodes.
   A node that no key before or behind the run can share is complete there. Those on the paths of a run's first and last
   key are open: their shares, a few rows a run, are summed over all runs.
3. Long conversations are cut into segments of `SEGMENT` turns, which are keys behind the digest of all turns before them.
   Segments that one conversation has for itself are plain chains and need no tree. Trees of deeper segments come first and
   hand their sums up.
4. The ids of conversations that end in a node are sorted by range, joined to strings in their tasks, and only these meet
   where their node's digest is made.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datavigil.llm.components import stored
from datavigil.llm.runs import numbered

WIDTH = 16
SEGMENT = 64
RUN_KEYS = 20_000
ROOT = bytes(WIDTH)
#: What a row of ids joined to a string may hold.
JOINED_IDS = 50_000


class Node:
    """A node of an adaptive radix tree: the bytes that lead to it from its parent's child byte on, and its children.

    Up to 4 and up to 16 children are kept in order of their bytes, up to 48 by an index of 256 places, more by 256 places.
    """

    __slots__ = ("path", "keys", "kids", "index", "value")

    def __init__(self, path: bytes, value=None):
        self.path, self.value = path, value
        self.keys: bytearray | None = bytearray()
        self.index: bytearray | None = None
        self.kids: list = []

    @property
    def layout(self) -> int:
        if self.keys is not None:
            return 4 if len(self.keys) <= 4 else 16
        return 48 if self.index is not None else 256

    def child(self, byte: int) -> Node | None:
        if self.keys is not None:
            at = bisect_left(self.keys, byte)
            return self.kids[at] if at < len(self.keys) and self.keys[at] == byte else None
        if self.index is not None:
            return self.kids[self.index[byte]] if self.index[byte] != 255 else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Adds or replaces a child; a full layout grows to the next one."""
        if self.keys is not None:
            at = bisect_left(self.keys, byte)
            if at < len(self.keys) and self.keys[at] == byte:
                self.kids[at] = kid
                return
            if len(self.keys) < 16:
                self.keys.insert(at, byte)
                self.kids.insert(at, kid)
                return
            self.index = bytearray(b"\xff" * 256)
            for i, own in enumerate(self.keys):
                self.index[own] = i
            self.keys = None
        if self.index is not None:
            if self.index[byte] != 255:
                self.kids[self.index[byte]] = kid
                return
            if len(self.kids) < 48:
                self.index[byte] = len(self.kids)
                self.kids.append(kid)
                return
            wide = [None] * 256
            for own in range(256):
                if self.index[own] != 255:
                    wide[own] = self.kids[self.index[own]]
            self.kids, self.index = wide, None
        self.kids[byte] = kid

    def children(self) -> list[Node]:
        if self.keys is not None:
            return self.kids
        if self.index is not None:
            return [self.kids[i] for i in self.index if i != 255]
        return [k for k in self.kids if k is not None]


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def insert(root: Node, key: bytes, value) -> None:
    """Puts a value at a key; the root's own path is empty."""
    node, parent, came, at = root, None, 0, 0
    while True:
        rest = key[at:at + len(node.path)]
        shared = _common(node.path, rest)
        if shared < len(node.path):  # the path is split
            upper = Node(node.path[:shared])
            upper.put(node.path[shared], node)
            node.path = node.path[shared + 1:]
            parent.put(came, upper)
            node = upper
        at += shared
        if at == len(key):
            node.value = value
            return
        kid = node.child(key[at])
        if kid is None:
            node.put(key[at], Node(key[at + 1:], value))
            return
        parent, came, node = node, key[at], kid
        at += 1


def _walk(root: Node, first: bytes, last: bytes) -> list[list]:
    """Rows of a run's tree, children before parents: [id, depth, conv_id, n, children, leaves, saved, sha, size, open, parent
    conv_id, parent id, ids of the open path]. Depth counts turns behind the base. Of open nodes (those on the paths to the
    first and last key, and the base) the row has only what closed children and the node's own key give."""
    rows: list[list] = []
    # (n, least conv, closed children, their leaves and saved, rows waiting for their parent, some value below)
    results: list = []
    stack = [(root, 0, False)]  # node, bytes above it, whether its children are done
    while stack:
        node, start, ready = stack.pop()
        kids = node.children()
        if not ready:
            stack.append((node, start, True))
            stack.extend((kid, start + len(node.path) + 1, False) for kid in kids)
            continue
        n = children = leaves = saved = 0
        least, waiting, some = None, [], None
        for _ in kids:
            kn, kleast, kchildren, kleaves, ksaved, kwaiting, some = results.pop()
            n, children, leaves, saved = n + kn, children + kchildren, leaves + kleaves, saved + ksaved
            least = kleast if least is None else min(least, kleast)
            if len(kwaiting) > len(waiting):
                waiting, kwaiting = kwaiting, waiting
            waiting.extend(kwaiting)
        end, sha = start + len(node.path), None
        if node.value is not None:
            some = node.value
            n += some["n"]
            least = some["least"] if least is None else min(least, some["least"])
            children, leaves, saved = children + some["more_children"], leaves + some["more_leaves"], saved + some["more_saved"]
            sha = some["sha"]
        # the byte that leads here stands before start and belongs to this node's stretch
        for depth in range(end - end % WIDTH, max(start - 1, 0), -WIDTH):
            prefix = some["key"][:depth]
            turns = depth // WIDTH - 1
            is_open = turns == 0 or first.startswith(prefix) or last.startswith(prefix)
            size = some["sizes"][turns - 1] if turns else 0
            row = [_node_id(prefix), turns, least, n, children, leaves, saved, sha if depth == end else None, size, is_open, None, None, None]
            for w in waiting:
                if is_open:
                    rows[w][11] = row[0]
                else:
                    rows[w][10] = least
            if is_open:
                row[12] = [_node_id(prefix[:k]) for k in range(WIDTH, depth + 1, WIDTH)]
                if turns:
                    row[11] = row[12][-2]
                children = leaves = saved = 0
                waiting = []
            else:
                if not children:
                    leaves = row[5] = 1
                saved = row[6] = saved + (n - 1) * size
                children, waiting = 1, [len(rows)]
            rows.append(row)
        results.append((n, least, children, leaves, saved, waiting, some))
    return rows


def _node_id(prefix: bytes) -> bytes:
    """Of a base and turns behind it; of a base alone the base."""
    return prefix if len(prefix) == WIDTH else hashlib.md5(prefix, usedforsecurity=False).digest()


_ROW = ("id binary, turns int, conv_id bigint, n bigint, children bigint, leaves bigint, saved bigint, sha string, size bigint, open boolean, "
        "parent_conv bigint, parent binary, path array<binary>")


def _trees(keys: DataFrame, run_keys: int) -> DataFrame:
    """Rows of _walk for runs of sorted keys; a key holds its base."""

    def run(batches):
        rows: list[dict] = []

        def done():
            root = Node(b"")
            for r in rows:
                insert(root, r["key"], r)
            found = _walk(root, rows[0]["key"], rows[-1]["key"])
            kinds = (pa.binary(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.list_(pa.binary()))
            names = [f.split()[0] for f in _ROW.split(", ")]
            for start in range(0, len(found), 10_000):
                columns = zip(*found[start:start + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for r in batch.to_pylist():
                rows.append(r)
                if len(rows) >= run_keys:
                    yield from done()
                    rows = []
        if rows:
            yield from done()

    ordered = keys.repartitionByRange("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, _ROW)


_NODE = ["id", "depth", "conv_id", "n", "children", "leaves", "saved", "sha", "parent_conv"]


def _forest(keys: DataFrame, depth: int, run_keys: int) -> tuple[DataFrame, DataFrame]:
    """Nodes behind bases at this depth, and what each base gets from them (base, children, leaves, saved).

    Nodes whose parent is a base have no parent_conv and their base in `parent`."""
    rows = stored(_trees(keys, run_keys))
    shared = (rows.where("open").groupBy("id").agg(
        F.first("turns").alias("turns"), F.first("parent").alias("parent"), F.first("path").alias("path"), F.min("conv_id").alias("conv_id"),
        F.sum("n").alias("n"), F.sum("children").alias("closed"), F.sum("leaves").alias("closed_leaves"), F.sum("saved").alias("closed_saved"),
        F.max("sha").alias("sha"), F.first("size").alias("size")))
    kids = shared.where("turns > 0").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    shared = stored(shared.join(kids, "id", "left").withColumn("children", F.col("closed") + F.coalesce("kids", F.lit(0))))
    own = F.col("turns") > 0
    given = shared.select(F.explode("path").alias("id"),
                          (F.col("closed_leaves") + (own & (F.col("children") == 0)).cast("long")).alias("leaves"),
                          (F.col("closed_saved") + F.when(own, (F.col("n") - 1) * F.col("size")).otherwise(0)).alias("saved"))
    sums = given.groupBy("id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    shared = stored(shared.drop("path").join(sums, "id"))
    parents = shared.where("turns > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("found"))
    nodes = (rows.where("NOT open").select("id", "turns", "conv_id", "n", "children", "leaves", "saved", "sha", "parent_conv", "parent")
             .union(shared.where("turns > 0").select("id", "turns", "conv_id", "n", "children", "leaves", "saved", "sha",
                                                     F.lit(None).cast("bigint"), "parent")))
    # most nodes have their parent's conversation already; the others ask the open nodes
    asking = nodes.where("parent IS NOT NULL").join(parents, "parent", "left").withColumn("parent_conv", F.col("found")).drop("found")
    nodes = nodes.where("parent IS NULL").unionByName(asking).withColumn("depth", (F.col("turns") + depth).cast("long"))
    return nodes.select(*_NODE, "parent"), shared.where("turns = 0").select(F.col("id").alias("base"), "children", "leaves", "saved")


def _ends(finished: DataFrame) -> DataFrame:
    """(id, conv_id) -> (id, sha): SHA-256 of the ids of conversations that end in a node, ascending and joined by commas."""

    def joined(batches):
        node, ids, no = None, [], 0

        def out():
            return pa.RecordBatch.from_pylist([{"id": node, "first": ids[0], "joined": ",".join(map(str, ids))}],
                                              pa.schema([("id", pa.binary()), ("first", pa.int64()), ("joined", pa.string())]))

        for batch in batches:
            for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (own != node or len(ids) >= JOINED_IDS):
                    yield out()
                    ids = []
                node = own
                ids.append(conv)
        if ids:
            yield out()

    def digest(batches):
        node, state = None, None
        for batch in batches:
            done = []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own == node:
                    state.update(b"," + text.encode())
                    continue
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = own, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["id", "sha"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["id", "sha"])

    pieces = (finished.repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id")
              .mapInArrow(joined, "id binary, first bigint, joined string"))
    return pieces.repartition("id").sortWithinPartitions("id", "first").mapInArrow(digest, "id binary, sha string")


def turn_ids(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, pos, turn_id, size): turns in order, null first, of equal ones by role and
    text. A null role or text counts as empty, rows without a conv_id are left out; size is the number of code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    rows = numbered(rows, "conv_id", [F.col("turn").isNotNull(), F.col("turn"), F.col("role"), F.col("text")])
    mark = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.select("conv_id", "pos", F.unhex(F.md5(mark.cast("binary"))).alias("turn_id"), F.length("text").cast("long").alias("size"))


def rebuilt(turns: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """turn_ids rows of conversations that begin with turns of another one: the first h of conversation c - c % group, h being
    crc32 of decimal c modulo most + 1, then c's own ones after its first h."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("long")
    head = (F.col("conv_id") - F.col("conv_id") % group).alias("head")
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < most))
    lengths = heads.groupBy(F.col("conv_id").alias("head")).agg(F.count("*").alias("has"))  # up to `most`
    convs = turns.select("conv_id").distinct().select("conv_id", head, h.alias("h"))
    lent = convs.join(heads.withColumnRenamed("conv_id", "head"), "head").where("pos < h").select("conv_id", "pos", "turn_id", "size")
    own = turns.select("*", head, h.alias("h")).where("pos >= h").join(lengths, "head", "left")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("has", F.lit(0)))).alias("pos"), "turn_id", "size")
    return lent.union(own)


def _segments(turns: DataFrame, segment: int) -> DataFrame:
    """(conv_id, no, sizes, base, key, end): segments of conversations; base is the id of the node before, end of the last node."""
    parts = stored(turns.groupBy("conv_id", F.floor(F.col("pos") / segment).alias("no"))
                   .agg(F.sort_array(F.collect_list(F.struct("pos", "turn_id", "size"))).alias("own"))
                   .select("conv_id", "no", F.col("own.size").alias("sizes"),
                           F.expr("aggregate(own, cast('' as binary), (a, x) -> concat(a, x.turn_id))").alias("ids")))
    schema = pa.schema([("conv_id", pa.int64()), ("no", pa.int64()), ("sizes", pa.list_(pa.int64())), ("base", pa.binary()), ("key", pa.binary()), ("end", pa.binary())])

    def chained(batches):
        conv, base = None, ROOT
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                r["base"] = base if r["conv_id"] == conv else ROOT
                conv, r["key"] = r["conv_id"], r["base"] + r.pop("ids")
                base = r["end"] = _node_id(r["key"])
            yield pa.RecordBatch.from_pylist(rows, schema)

    several = parts.where("no > 0").select("conv_id").distinct()
    key = F.concat(F.lit(ROOT), "ids")
    short = parts.join(several, "conv_id", "left_anti").select("conv_id", "no", "sizes", F.lit(ROOT).alias("base"), key.alias("key"), F.unhex(F.md5(key)).alias("end"))
    # of a long conversation one row per `segment` turns streams by in order
    long = parts.join(several, "conv_id", "left_semi").repartition("conv_id").sortWithinPartitions("conv_id", "no")
    long = long.mapInArrow(chained, "conv_id bigint, no bigint, sizes array<bigint>, base binary, key binary, end binary")
    return stored(short.union(long.select(*short.columns)))


def _chains(alone: DataFrame, ends: DataFrame, segment: int) -> DataFrame:
    """Nodes of segments that one conversation has for itself."""
    tails = alone.groupBy("conv_id").agg((F.max("no") * segment).alias("before"), F.max(F.struct("no", F.size("sizes").alias("n"))).getField("n").alias("n_last"))
    turns = alone.select("conv_id", "no", "key", F.posexplode("sizes").alias("at", "size")).join(tails, "conv_id")
    depth = F.col("no") * segment + F.col("at") + 1
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    nodes = turns.select(
        F.unhex(F.md5(F.expr(f"substring(key, 1, {WIDTH} * (at + 2))"))).alias("id"), depth.alias("depth"), "conv_id", one.alias("n"),
        F.when(depth == F.col("before") + F.col("n_last"), none).otherwise(one).alias("children"), one.alias("leaves"), none.alias("saved"),
        F.col("conv_id").alias("parent_conv"))
    return nodes.join(ends, "id", "left").select(*_NODE)


def prefix_nodes(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT, run_keys: int = RUN_KEYS) -> DataFrame:
    """The nodes of the prefix trie of conversations.

    turns has (conv_id, pos, turn_id, size) as turn_ids gives them, with places 0, 1, 2, ... in each conversation; convs has the
    conv_ids, also of conversations without turns; repeated and null ones count for nothing. Per node: conv_id (smallest member),
    depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (summed over the subtree) and
    ends_sha256. Without conversations there are no nodes.
    """
    convs = convs.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    total = convs.agg(F.min("conv_id").alias("least"), F.count("*").alias("n")).first()
    rows = _segments(turns, segment)
    last = rows.groupBy("conv_id").agg(F.max(F.struct("no", "end")).getField("end").alias("id"))
    ends = stored(_ends(convs.join(last, "conv_id", "left").select(F.coalesce("id", F.lit(ROOT)).alias("id"), "conv_id")))

    # who is there where a segment is full
    full = stored(rows.where(F.size("sizes") == segment).groupBy(F.col("end").alias("base"))
                  .agg(F.count("*").alias("members"), F.min("conv_id").alias("before_conv")))
    deeper = stored(rows.where("no > 0").join(full, "base"))
    alone, shared = deeper.where("members = 1"), deeper.where("members > 1")
    nodes = _chains(alone, ends, segment)
    below = alone.select("base", *[F.lit(v).cast("long").alias(f"more_{c}") for c, v in (("children", 1), ("leaves", 1), ("saved", 0))])
    for no in range(shared.agg(F.max("no")).first()[0] or 0, -1, -1):
        level = (shared if no else rows).where(F.col("no") == no)
        keys = level.groupBy("key", "end").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("sizes").alias("sizes"))
        keys = keys.join(ends.withColumnRenamed("id", "end"), "end", "left").join(below.withColumnRenamed("base", "end"), "end", "left")
        keys = keys.select("key", "n", "least", "sha", "sizes", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("more_children", "more_leaves", "more_saved")])
        found, bases = _forest(keys, no * segment, run_keys)
        if no:
            found = found.join(full.select(F.col("base").alias("parent"), "before_conv"), "parent", "left")
            sums = bases.select("base", *[F.col(c).alias(f"more_{c}") for c in ("children", "leaves", "saved")])
            below = stored(below.union(sums))
        else:
            found = found.withColumn("before_conv", F.lit(total["least"]).cast("long"))
        nodes = nodes.union(found.withColumn("parent_conv", F.coalesce("parent_conv", "before_conv")).select(*_NODE))
    root = turns.sparkSession.createDataFrame([(ROOT, 0, total["least"], total["n"])] if total["n"] else [], "id binary, depth bigint, conv_id bigint, n bigint")
    root = root.join(bases.withColumnRenamed("base", "id"), "id", "left").join(ends, "id", "left")
    root = root.select("id", "depth", "conv_id", "n", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("leaves", F.lit(1)).alias("leaves"),
                       F.coalesce("saved", F.lit(0)).alias("saved"), "sha", F.lit(None).cast("bigint").alias("parent_conv"))
    empty = hashlib.sha256(b"").hexdigest()
    return nodes.union(root).select(
        "conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(empty)).alias("ends_sha256"))


def rebuilt_nodes_sql(group: int = 100, most: int = 5) -> str:
    """prefix_nodes of rebuilt conversations, over a table conversations."""
    return f"""
WITH RECURSIVE bits AS (
  SELECT b, b AS v, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
steps AS (SELECT b, v FROM bits WHERE k = 8),
sums AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR AS s, 0 AS done, 4294967295::BIGINT AS crc FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT conv_id, s, done + 1, xor(crc >> 8, v) FROM sums JOIN steps ON b = xor(crc, ascii(s[done + 1])::BIGINT) & 255 WHERE done < length(s)),
convs AS (SELECT conv_id AS c, conv_id - conv_id % {group} AS head, xor(crc, 4294967295) % {most + 1} AS h FROM sums WHERE done = length(s)),
placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT c, 0 AS src, pos, role, text FROM convs JOIN placed ON placed.conv_id = head WHERE pos < h
  UNION ALL SELECT c, 1, pos, role, text FROM convs JOIN placed ON placed.conv_id = c WHERE pos >= h),
members AS (
  SELECT c, row_number() OVER o AS d, length(text) AS size, md5(string_agg(md5(length(role) || ':' || role || text), '') OVER o) AS id
  FROM turns WINDOW o AS (PARTITION BY c ORDER BY src, pos)
  UNION ALL SELECT c, 0, 0, '' FROM convs),
nodes AS (SELECT id, d, min(c) AS least, count(*) AS n, min(size) AS size FROM members GROUP BY id, d),
linked AS (
  SELECT nodes.*, up.id AS parent, above.least AS parent_least
  FROM nodes LEFT JOIN members up ON up.c = nodes.least AND up.d = nodes.d - 1 LEFT JOIN nodes above ON above.id = up.id),
kids AS (SELECT parent AS id, count(*) AS k FROM linked WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT m.id, sum((kids.k IS NULL)::INT) AS leaves, sum((n - 1) * x.size) AS saved
  FROM nodes x JOIN members m ON m.c = x.least AND m.d <= x.d LEFT JOIN kids ON kids.id = x.id GROUP BY m.id),
lasts AS (SELECT c, arg_max(id, d) AS id FROM members GROUP BY c),
ends AS (SELECT id, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM lasts GROUP BY id)
SELECT least AS conv_id, d::BIGINT AS depth, parent_least AS parent_conv_id, n::BIGINT AS n_convs, coalesce(k, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM linked JOIN below USING (id) LEFT JOIN kids USING (id) LEFT JOIN ends USING (id)"""
