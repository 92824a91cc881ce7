"""Operator 10: near-duplicates by a multi-index Hamming join of b-bit MinHash signatures, links confirmed on full sets.

1. One pass over the texts gives per row the number of distinct shingles, a 128-bit fingerprint of the whole set and 100
   MinHash symbols of b = 16 bits. Equal sets are one class; only classes go on, so exact copies never meet in pairs.
2. The first 50 symbols are cut into 10 chunks of 5. By the pigeonhole principle two signatures that differ in at most
   19 of these symbols have a chunk with at most one error. The allowed error is enumerated by leaving out each place
   of a chunk in turn: 50 keys per class, each of 4 symbols. A pair of similarity 0.75 shares a key with a probability
   of 1 - 4e-5, of 0.85 with 1 - 1e-9.
3. Every key links its members to its least member (a star, so a bucket makes no more pairs than rows). Pairs whose
   signatures differ in more than 47 of 100 symbols go (at similarity 0.75 the mean is 25, the deviation 4.3), the
   others are confirmed on the full sets. Confirmed links give components.
4. What a star may have missed lies in buckets that still hold several components. There the members of different
   components are compared by their signatures inside the task; members with a close partner get their full sets, and a
   second task confirms their links. No pairs leave the tasks, only rows and links. A bucket above `bucket_rows` is cut
   into parts and compared tile by tile, a tile being two parts, so no task holds more than that and nothing is capped.
   Rows of the largest component of a bucket meet only the others. Where tiles would still make more copies of the rows
   than there are keys, the bucket is first split by keys of the second 50 symbols (the same guarantee again).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datavigil.llm import arrays as A
from datavigil.llm.components import components
from datavigil.session import cut

CHUNKS, WIDTH, BLOCK = 10, 5, 50
SYMBOLS = 2 * BLOCK
FAR = 47
BUCKET_ROWS = 1000


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, distinct shingle hashes and their offsets, slice by slice; the text is the second column."""
    data, offsets = A.byte_view(batch.column(1))
    for i, j in A.slices(offsets):
        hashes, starts = A.word_hashes(data, offsets[i:j + 1])
        values, bounds = A.distinct_sets(*A.shingle_hashes(hashes, starts, words))
        yield batch.slice(i, j - i), values, bounds


def _signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows of 16-bit symbols, one row for each text; zeros for a text without shingles."""
    out = np.zeros((len(bounds) - 1, SYMBOLS), dtype="<u2")
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for k, (factor, shift) in enumerate(zip(A.constants(SYMBOLS, 202), A.constants(SYMBOLS, 303), strict=True)):
            least = np.minimum.reduceat(values * factor + shift, bounds[full])
            out[full, k] = A.mix(least).astype("<u2")
    return out


def _fingerprints(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    view = memoryview(np.ascontiguousarray(values)).cast("B")
    return [hashlib.blake2b(view[8 * a:8 * b], digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def sketch(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, text, key) -> (doc_id, key, n_shingles, fp, sig); no shuffle."""

    def run(batches):
        for batch in A.pieces(batches):
            for rows, values, bounds in _sets(batch, words):
                sig = _signatures(values, bounds)
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), rows.column(2), pa.array(np.diff(bounds), pa.int64()), pa.array(_fingerprints(values, bounds), pa.binary()),
                    pa.array([row.tobytes() for row in sig], pa.binary())], ["doc_id", "key", "n_shingles", "fp", "sig"])

    return docs.mapInArrow(run, "doc_id bigint, key bigint, n_shingles bigint, fp binary, sig binary")


def shingle_sets(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, text) -> (fp, shingles): sorted 64-bit hashes of the whole set as binary."""

    def run(batches):
        for batch in A.pieces(batches):
            for _, values, bounds in _sets(batch, words):
                yield pa.RecordBatch.from_arrays([
                    pa.array(_fingerprints(values, bounds), pa.binary()), A.binary_array(values, bounds)], ["fp", "shingles"])

    return docs.mapInArrow(run, "fp binary, shingles binary")


def _keys(block: int, salt=None):
    """Array of the 50 keys of a block: a chunk without one of its places, tagged with chunk and place."""
    out = []
    for no in range(BLOCK):
        chunk, place = divmod(no, WIDTH)
        start = 2 * (block * BLOCK + chunk * WIDTH) + 1
        parts = [F.lit(no)] + ([salt] if salt is not None else [])
        if place:
            parts.append(F.substring("sig", start, 2 * place))
        if place < WIDTH - 1:
            parts.append(F.substring("sig", start + 2 * place + 2, 2 * (WIDTH - 1 - place)))
        out.append(F.xxhash64(*parts))
    return F.array(*out)


def _first_key(equal: np.ndarray) -> np.ndarray:
    """For rows of 50 equal / different places the first key that both signatures share, -1 if none."""
    errors = WIDTH - equal.reshape(len(equal), CHUNKS, WIDTH).sum(axis=2)
    good = errors <= 1
    chunk = good.argmax(axis=1)
    own = equal.reshape(len(equal), CHUNKS, WIDTH)[np.arange(len(equal)), chunk]
    place = np.where(own.all(axis=1), 0, (~own).argmax(axis=1))
    return np.where(good.any(axis=1), chunk * WIDTH + place, -1)


def _close_star(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) those that can reach the threshold by their sizes and signatures."""
    one, two = (classes.select(F.col("vid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    wide = (pairs.join(one, "a").join(two, "b")
            .where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num).select("a", "b", "sig_a", "sig_b"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, SYMBOLS) for i in (2, 3))
            near = pa.array((left != right).sum(axis=1) <= FAR)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    return wide.mapInArrow(run, "a bigint, b bigint")


def _tile_pairs(t: dict[str, np.ndarray], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Close pairs (i, j) of rows of one (bucket, tile) and of different components, each in the first bucket that its
    signatures share, and in how many symbols they differ; at most 100,000 at a time."""
    n = len(t["bucket"])
    live, step = np.arange(n), 0
    while True:
        step += 1
        live = live[live + step < n]
        live = live[(t["bucket"][live] == t["bucket"][live + step]) & (t["tile"][live] == t["tile"][live + step])]
        if not len(live):
            return
        for i in np.array_split(live, len(live) // 100_000 + 1):
            j = i + step
            keep = t["comp"][i] != t["comp"][j]
            keep &= (t["across"][i] == 0) | (t["part"][i] != t["part"][j])
            keep &= np.minimum(t["n"][i], t["n"][j]) * den >= np.maximum(t["n"][i], t["n"][j]) * num
            i, j = i[keep], j[keep]
            equal = t["sig"][i] == t["sig"][j]
            apart = SYMBOLS - equal.sum(axis=1)
            near = apart <= FAR
            i, j, equal, apart = i[near], j[near], equal[near], apart[near]
            own = _first_key(equal[:, :BLOCK]) == t["no"][i]
            own &= (t["sub"][i] < 0) | (_first_key(equal[:, BLOCK:]) == t["sub"][i])
            if own.any():
                yield i[own].astype(np.int32), j[own].astype(np.int32), apart[own].astype(np.int8)


def _tile_links(t: dict[str, np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Of the pairs of one tile, nearest first, those whose sets reach the threshold and that join two components."""
    found = list(_tile_pairs(t, num, den))
    if not found:
        return []
    i, j, apart = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    order = np.argsort(apart, kind="stable")
    i, j = i[order], j[order]
    used, place = np.unique(np.concatenate((i, j)), return_inverse=True)
    values = [np.frombuffer(t["shingles"][k], "<u8") for k in used]
    _, codes = np.unique(np.concatenate(values), return_inverse=True) if values else (None, np.empty(0, np.int64))
    sizes = np.array([len(v) for v in values], np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 0, dtype=bool)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x] = root.get(root[x], root[x])
        return x

    links, shared = [], {}
    many = np.bincount(place, minlength=len(used)) if len(place) else np.empty(0, int)
    for x, y in zip(place[:len(i)], place[len(i):], strict=True):
        cx, cy = find(int(t["comp"][used[x]])), find(int(t["comp"][used[y]]))
        if cx == cy:
            continue
        if many[y] > many[x]:
            x, y = y, x
        if many[x] > 16:  # against all of the tile at once
            if x not in shared:
                mark[codes[bounds[x]:bounds[x + 1]]] = True
                shared[x] = np.add.reduceat(mark[codes].astype(np.int32), bounds[:-1])
                mark[codes[bounds[x]:bounds[x + 1]]] = False
            both = int(shared[x][y])
        else:
            both = len(np.intersect1d(values[x], values[y], assume_unique=True))
        if den * both >= num * (sizes[x] + sizes[y] - both):
            root[cx] = cy
            links.append((int(t["vid"][used[x]]), int(t["vid"][used[y]])))
    return links


def _by_tile(rows: DataFrame, work, schema: str) -> DataFrame:
    """work(whole tiles as arrays) -> a record batch, over rows brought together by (bucket, tile)."""

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = {}
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                if name == "sig":
                    t[name] = np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SYMBOLS)
                else:
                    t[name] = column.to_numpy(zero_copy_only=False)
            if rest is not None:
                t = {k: np.concatenate((rest[k], t[k])) for k in t}
            last = np.flatnonzero((t["bucket"] != t["bucket"][-1]) | (t["tile"] != t["tile"][-1]))
            end = int(last[-1]) + 1 if len(last) else 0
            rest = {k: v[end:] for k, v in t.items()}  # the last tile may go on in the next batch
            if end:
                yield work({k: v[:end] for k, v in t.items()})
        if rest is not None:
            yield work(rest)

    return rows.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "vid").mapInArrow(run, schema)


def _in_close_pairs(tiled: DataFrame, num: int, den: int) -> DataFrame:
    """The rows that have a close partner of another component in their tile."""

    def work(t):
        close = np.zeros(len(t["bucket"]), dtype=bool)
        for i, j, _ in _tile_pairs(t, num, den):  # a tile may hold very many pairs, only their rows are kept
            close[i] = close[j] = True
        live = np.flatnonzero(close)
        return pa.RecordBatch.from_arrays([
            pa.array([row.tobytes() for row in v[live]], pa.binary()) if k == "sig" else pa.array(v[live]) for k, v in t.items()
        ], names=list(t))

    return _by_tile(tiled, work, tiled.schema)


def _tile_confirm(live: DataFrame, num: int, den: int) -> DataFrame:
    """Links between the rows of each tile, checked on full sets inside the task; only links leave it."""

    def work(t):
        edges = np.unique(np.stack((t["bucket"], t["tile"])), axis=1, return_index=True)[1]
        edges = np.append(np.sort(edges), len(t["bucket"]))
        links = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            links += _tile_links({k: v[a:b] for k, v in t.items()}, num, den)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _by_tile(live, work, "a bigint, b bigint")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than one component, with the number of rows and shingles of the bucket."""
    sizes = (rows.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"),
                                        F.sum("n").alias("weight"))
             .where("low < high").select("bucket", "size", "weight"))
    return rows.join(sizes, "bucket")


def _parts(size, weight, bucket_rows: int):
    """Number of parts that rows of this number and sum of shingles are cut into; at least one."""
    return F.greatest(F.lit(1), F.ceil(size / bucket_rows), F.ceil(weight / (1000 * bucket_rows))).cast("int")


def _shaped(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """Rows of large buckets with the largest component of the bucket (main), the numbers of parts that its rows (mains)
    and all other rows (others) make, and the number of rows that tiles of these parts hold together (sent)."""
    each = rows.groupBy("bucket", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    whole = each.groupBy("bucket").agg(F.max(F.struct("size", "weight", "comp")).alias("top"), F.sum("size").alias("size"),
                                       F.sum("weight").alias("weight"))
    rest = F.col("size") - F.col("top.size")
    shape = whole.select(
        "bucket", "size", F.col("top.comp").alias("main"), F.col("top.size").alias("main_size"), rest.alias("rest"),
        _parts(F.col("top.size"), F.col("top.weight"), bucket_rows).alias("mains"),
        _parts(rest, F.col("weight") - F.col("top.weight"), bucket_rows).alias("others"))
    sent = F.col("main_size") * F.col("others") + F.col("rest") * (F.col("mains") + F.col("others"))
    return rows.drop("size", "weight").join(shape.withColumn("sent", sent).drop("main_size", "rest"), "bucket")


TILE = ["bucket", "tile", "across", "part", "no", "sub", "vid", "comp", "n", "sig"]


def _whole(rows: DataFrame) -> DataFrame:
    """Each bucket as one tile."""
    zero = F.lit(0)
    return rows.withColumns({"tile": zero, "across": zero, "part": zero}).select(*TILE)


def _grid(shaped: DataFrame) -> DataFrame:
    """Every row once for each tile, that is each pair of parts of its bucket, that it belongs to.

    Rows of the main component are never compared with each other, so they meet the parts of the other rows only: a bucket
    that one component fills sends each of its rows once, however large it is.
    """
    main = F.col("comp") == F.col("main")
    rows = shaped.withColumn("part", F.when(main, F.col("others") + F.pmod(F.xxhash64("vid"), F.col("mains")))
                             .otherwise(F.pmod(F.xxhash64("vid"), F.col("others"))).cast("int"))
    parts = F.col("others") + F.col("mains")
    met = F.explode(F.sequence(F.lit(0), F.when(main, F.col("others")).otherwise(parts) - 1)).alias("met")
    # tile (i, i): pairs inside part i; tile (i, j): pairs across
    low, high = F.least("part", "met"), F.greatest("part", "met")
    return rows.select("*", met).withColumns({"tile": (low * parts + high).cast("int"), "across": (low != high).cast("int")}).select(*TILE)


def _tiles(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """Tiles of small and large buckets, where no bucket is split by more keys."""
    many = _parts(F.col("size"), F.col("weight"), bucket_rows) > 1
    return _whole(rows.where(~many)).union(_grid(_shaped(rows.where(many), bucket_rows)))


def _sets_of(vids: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(vid) -> (vid, shingles), read again from the text of one document of each class."""
    wanted = cut(vids.distinct().join(classes.select("vid", "fp", "head"), "vid"))
    heads = wanted.select(F.col("head").alias("want")).distinct()
    texts = docs.join(heads, docs["doc_id"].eqNullSafe(heads["want"]), "left_semi")
    found = shingle_sets(texts, words).join(wanted.select("fp", "vid"), "fp").select("vid", "shingles")
    return cut(found)


def _confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets reach the threshold."""
    one, two = (sets.select(F.col("vid").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                left, right = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(den * both >= num * (len(left) + len(right) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b")
    return cut(joined.mapInArrow(run, "a bigint, b bigint").distinct())


def _linked(docs: DataFrame, words: int, num: int, den: int, bucket_rows: int) -> DataFrame:
    """(doc_id, text, key) -> (doc_id, key, n_shingles, component_id, kept, first) per row; first marks the rows with the
    smallest (doc_id, key) of each component, null ids last, and every row without shingles."""
    rows = cut(sketch(docs, words))
    classes = cut(rows.where("n_shingles > 0").groupBy("fp")
                  .agg(F.min("doc_id").alias("head"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig"),
                       F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
                  .withColumn("vid", F.monotonically_increasing_id()))
    keys = classes.select("vid", F.explode(_keys(0)).alias("bucket"))
    heads = keys.groupBy("bucket").agg(F.min("vid").alias("a"), F.count("*").alias("size")).where("size > 1").drop("size")
    star = keys.join(heads, "bucket").where("vid > a").select("a", F.col("vid").alias("b")).distinct()
    star = cut(_close_star(star, classes, num, den))
    ends = star.select(F.explode(F.array("a", "b")).alias("vid"))
    links = _confirm(star, _sets_of(ends, classes, docs, words), num, den)
    labels = components(links)

    known = classes.join(labels.withColumnRenamed("v", "vid"), "vid", "left").select(
        "vid", "n", "sig", F.coalesce("label", "vid").alias("comp"))
    light = known.select("vid", "comp", "n", F.posexplode(_keys(0)).alias("no", "bucket"))
    mixed = cut(_mixed(light).join(known.select("vid", "sig"), "vid").withColumn("sub", F.lit(-1)))
    many = _parts(F.col("size"), F.col("weight"), bucket_rows) > 1
    hot = cut(_shaped(mixed.where(many), bucket_rows))
    crowded = F.col("sent") > BLOCK * F.col("size")  # tiles would hold more rows than the keys of the second block make
    split = _mixed(hot.where(crowded).select("vid", "n", "sig", "comp", "no", F.posexplode(_keys(1, F.col("bucket"))).alias("sub", "bucket")))
    tiles = _whole(mixed.where(~many)).union(_grid(hot.where(~crowded))).union(_tiles(split, bucket_rows))
    live = cut(_in_close_pairs(tiles, num, den))
    if not live.isEmpty():
        sets = _sets_of(live.select("vid"), classes, docs, words)
        links = links.union(cut(_tile_confirm(live.join(sets, "vid"), num, den)))
        labels = components(links)

    named = classes.join(labels.withColumnRenamed("v", "vid"), "vid", "left").select(
        "fp", "head", "first", F.coalesce("label", "vid").alias("comp"))
    least = named.groupBy("comp").agg(F.min("head").alias("component_id"), F.min("first").alias("first"))
    found = named.drop("first").join(least, "comp").select("fp", "component_id", "first")
    empty = F.col("n_shingles") == 0
    out = rows.drop("sig").join(found, "fp", "left")
    component = F.when(empty, F.col("doc_id")).otherwise(F.col("component_id"))
    first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.key") == F.col("key"))
    return out.select("doc_id", "key", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), (empty | first).alias("first"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 75,
                    den: int = 100, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs.

    Documents are linked if den * |common shingles| >= num * |all shingles|; component_id is the smallest doc_id that
    links reach. A null, empty or blank text has no shingles and stands alone. Equal rows are copies of each other, so
    rows with the kept doc_id are all kept. A null doc_id never names a component unless all of the component are null;
    then component_id is null and the rows are kept. An empty table gives no rows. Other columns are not read. The work
    is for thresholds of about 0.75 and up; a lower one needs other chunks.
    """
    return _linked(_keyed(docs, id_col, text_col), words, num, den, bucket_rows).drop("key", "first")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 75, den: int = 100,
                    bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row of docs, with all its columns, of each group of near-duplicates, and every row without shingles.

    It is the row with the smallest id (null ids last), of equal ids that with the smallest hash of the text. Rows equal in
    both are copies; the one with the smallest hash of all columns stays. An empty table gives no rows. docs is read several
    times and must hold the same rows each time.
    """
    linked = _linked(_keyed(docs, id_col, text_col), words, num, den, bucket_rows).where("first")
    # copies of a row are counted on the map side; few rows have any
    chosen = cut(linked.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.max("n_shingles").alias("size")))
    id_, key = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`"))

    def of(wanted: DataFrame) -> DataFrame:
        wanted = wanted.select(F.col("doc_id").alias("__want_id"), F.col("key").alias("__want_key"))
        return docs.join(wanted, id_.eqNullSafe(F.col("__want_id")) & (key == F.col("__want_key")), "left_semi")

    several = F.expr("n > 1 AND size > 0")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    copies = (of(chosen.where(several)).select(id_.alias("__id"), key.alias("__key"), row.alias("__row"))
              .groupBy("__id", "__key").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row")))
    return of(chosen.where(~several)).union(copies.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]))
