"""Packing, dual-tree search and prefix trie against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import tokenizers
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datavigil.llm import ann, bpe, decontam, dualtree, packing, pretokens, queries, runs, sharding, token_counts, tries

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


# ---- op11

def check_packed(rows, capacity):
    """Rows of (length, sequence_id, offset): gapless sequences within the capacity; their number."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fits = [(g, i) for i, g in enumerate(gaps) if g >= length]
        if fits:
            gaps[min(fits)[1]] -= length
        else:
            gaps.append(capacity - length)
    return len(gaps)


def plain_pieces(texts):
    tokenizer = tokenizers.Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    out = []
    for doc, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out += [(doc, no, start, len(ids[start:start + 4096]), zlib.crc32(ids[start:start + 4096].tobytes()))
                for no, start in enumerate(range(0, len(ids), 4096))]
    return sorted(out, key=str)


def test_op11_whole_table(spark):
    out = queries.op11_best_fit_packing(spark, SF).collect()
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:5] for r in out), key=str) == plain_pieces(texts)
    lengths = [r["length"] for r in out]
    used = check_packed(out, 4096)
    assert used <= best_fit_decreasing(lengths, 4096) + 2 and used <= 1.02 * math.ceil(sum(lengths) / 4096) + 1


def test_op11_odd_texts(spark):
    rnd = random.Random(11)
    parts = ["a", "The", "'", "'LL", "'s", " ", "  ", "\n", " \n", "12", "!", "É", "é", "　", "\x85", "😀", "\x1c", "İ", "<|endoftext|>", "don't", "ſ"]
    texts = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))) for i in range(300)]
    texts += [(1000, None), (1001, ""), (None, "x"), (5, "x"), (5, "x"), (1002, "word " * 9000), (1003, "y" * 20_000)]
    docs = spark.createDataFrame([(d, t, "c", 1) for d, t in texts], "doc_id bigint, text string, piece string, id int")
    found = packing.pieces(docs, WORDS).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_pieces(texts)
    assert packing.pieces(docs.limit(0), WORDS).count() == 0


@pytest.mark.parametrize("kind", ["hot length", "mixed", "halves", "small", "full"])
def test_op11_packing_of_lengths(spark, kind):
    rnd = random.Random(2)
    lengths = {"hot length": [37] * 400 + [rnd.randint(1, 100) for _ in range(800)], "mixed": [rnd.randint(1, 100) for _ in range(900)],
               "halves": [rnd.randint(50, 52) for _ in range(101)], "small": [rnd.randint(1, 4) for _ in range(700)], "full": [100] * 5 + [1]}[kind]
    items = spark.createDataFrame([(n, i % 7, "z") for i, n in enumerate(lengths)], "length int, id int, offset string").repartition(3)
    out = packing.pack(items, capacity=100).collect()
    assert sorted(r["length"] for r in out) == sorted(lengths)
    used = check_packed(out, 100)
    assert used <= max(1.03 * best_fit_decreasing(lengths, 100), best_fit_decreasing(lengths, 100) + 1)


def test_op11_edges(spark):
    empty = spark.createDataFrame([], "length bigint, name string")
    assert packing.pack(empty, capacity=8).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(9,), (None,)], "length bigint"), capacity=8)


def test_op11_brackets():
    rnd = random.Random(4)
    for _ in range(200):
        kinds = np.array([rnd.random() < 0.5 for _ in range(rnd.randint(0, 20))], bool)
        stack, wanted = [], set()
        for i, is_slot in enumerate(kinds):
            if not is_slot:
                stack.append(i)
            elif stack:
                wanted.add((stack.pop(), i))
        assert set(zip(*(x.tolist() for x in packing.brackets(kinds)), strict=True)) == wanted


# ---- op12

def plain_search(docs, items, k=10):
    texts = [(d, Counter(dualtree.terms(t))) for d, t in docs]
    texts = [(d, c) for d, c in texts if c]
    n_docs, n_terms = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = {}
    for item, text in items:
        found = []
        for d, c in texts:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in set(dualtree.terms(text)) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        for rank, (score, _, _, d) in enumerate(sorted(found)[:k], 1):
            out[item, rank] = (d, -score)
    return out


def result(df):
    return {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in df.collect()}


def test_op12_terms():
    odd = "".join(map(chr, range(0x250))) + "中文 ＡB İx"
    want = [m.group().translate({i: i + 32 for i in range(65, 91)}) for m in re.finditer(dualtree.TERM, odd)]
    assert dualtree.terms(odd) == want
    import pyarrow as pa

    found, codes, bounds = pretokens.runs(pa.array([odd, None, "", "A a"]), dualtree._IS_TERM, lower=True)
    assert [found[c] for c in codes[bounds[0]:bounds[1]] if found[c].encode()[0] in np.flatnonzero(dualtree._IS_TERM)] == want
    assert [found[c] for c in codes[bounds[3]:]] == ["a", " ", "a"] and bounds[1] == bounds[2] == bounds[3]


def test_op12_against_all_pairs(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert result(queries.op12_dual_tree_search(spark, SF)) == plain_search(docs, items)


@pytest.mark.parametrize("block_items", [2048, 3])
def test_op12_hot_documents_and_ties(spark, block_items):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30)))) for i in range(400)]
    docs += [(1000 + i, "w1 W2, w3") for i in range(300)] + [(None, "w1 w2 w3"), (5, None), (6, ""), (7, " .,"), (1000, "w1 w2 w3")]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 8)))) for i in range(12)] + [(50, "W1 w2-w3 w3"), (51, None), (52, "zzz"), (None, "w9")]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, score string").repartition(4)
    asked = spark.createDataFrame([*items, (50, "zz w1")], "item_id bigint, text string")
    got = result(dualtree.search(frame, asked, block_items=block_items))
    items = [(i, min(t for j, t in [*items, (50, "zz w1")] if j == i and t is not None) if i == 50 else t) for i, t in items]
    assert got == plain_search(docs, items)
    assert dualtree.search(frame.limit(0), asked).count() == 0 and dualtree.search(frame, asked.limit(0)).count() == 0


def test_op12_prunes():
    rnd = np.random.default_rng(3)
    members = np.zeros((64, 400), np.int8)
    members[np.repeat(np.arange(64), 6), (np.repeat(np.arange(64), 6) // 8 * 50 + rnd.integers(0, 50, 384))] = 1
    tree = dualtree.Tree(members.astype(float), dualtree.ITEM_LEAF)
    best, docs, scored = dualtree.Best(64, 3), [], 0
    for run in range(6):
        rows = np.zeros((256, 400))
        topic = rnd.integers(0, 8, 256)
        rows[np.repeat(np.arange(256), 10), np.repeat(topic, 10) * 50 + rnd.integers(0, 50, 2560)] = rnd.integers(1, 100, 2560)
        docs.append(rows)
        scored += dualtree.search_run(members.astype(float), tree, rows, [(run * 256 + i, run * 256 + i) for i in range(256)], best)
    scores = members @ np.concatenate(docs).T
    for i in range(64):
        want = sorted((-s, d) for d, s in enumerate(scores[i]) if s > 0)[:3]
        assert sorted((-s, -o) for s, o, _ in best.heaps[i]) == want
    assert scored < 0.5 * scores.size


# ---- op13

def plain_trie(convs):
    """{conv: turns} -> the rows of the trie."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        below = [sums[k] for k in kids[node]]
        sums[node] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    rows = []
    for node, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(node))))
        rows.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids[node]), *sums[node],
                     hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in sorted(((c, (t is not None, t or 0), r or "", x or "") for c, t, r, x in rows if c is not None)):
        own[c].append((role, text))
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
    return out


@pytest.mark.parametrize(("segment", "run_keys"), [(64, 20_000), (64, 5), (2, 7), (1, 1)])
def test_op13_against_plain_trie(spark, segment, run_keys):
    rnd = random.Random(13)
    rows = []
    for c in [*range(0, 60), *range(100, 130), 260, 299, 1000]:
        kind = rnd.random()
        n = rnd.randint(0, 12) if c % 100 else rnd.randint(0, 4)
        for t in range(n):
            text = "same" if kind < 0.4 else rnd.choice(["same", "other", "é" * 3, ""])
            rows.append((c, t if rnd.random() < 0.9 else None, rnd.choice(["user", "bot", None]) if kind > 0.4 else "user", text if rnd.random() < 0.9 else None))
    rows += [(7, 0, "x", "y"), (7, 0, "x", "y"), (None, 1, "a", "b")] + [(700, i, "u", str(i % 3)) for i in range(150)]
    frame = spark.createDataFrame([(*r, 0, "k") for r in rows], "conv_id bigint, turn bigint, role string, text string, pos int, id string").repartition(3)
    out = tries.prefix_nodes(tries.rebuilt(tries.turn_ids(frame)), frame.select("conv_id"), segment, run_keys).collect()
    assert sorted((tuple(r) for r in out), key=str) == plain_trie(plain_rebuilt(rows))


def test_op13_hot_copies_and_edges(spark):
    rows = [(c, t, "u", f"t{t}") for c in range(1, 400) for t in range(3)] + [(5000 + c, 0, "u", "t0") for c in range(50)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    turns = tries.turn_ids(frame)
    convs = defaultdict(list)
    for c, _, role, text in sorted(rows):
        convs[c].append((role, text))
    convs[9999] = []
    every = frame.select("conv_id").union(spark.createDataFrame([(9999,), (None,)], "conv_id bigint"))
    joined, tries.JOINED_IDS = tries.JOINED_IDS, 7
    try:
        out = tries.prefix_nodes(turns, every).collect()
    finally:
        tries.JOINED_IDS = joined
    assert sorted((tuple(r) for r in out), key=str) == plain_trie(convs)
    assert tries.prefix_nodes(turns.limit(0), every.limit(0)).count() == 0
    only = tries.prefix_nodes(turns.limit(0), every).collect()
    assert len(only) == 1 and only[0]["n_convs"] == 450 and only[0]["n_leaves"] == 1


def test_op13_layouts_grow():
    root, keys = tries.Node(b""), [bytes([7, i, *divmod(i * 37 % 1000, 256), *[0] * 12]) for i in range(256)]
    seen = set()
    for i, key in enumerate(keys):
        tries.insert(root, key, i)
        seen.add(root.kids[0].layout if root.kids[0].path == b"" or root.kids[0].kids else 0)
    assert seen >= {4, 16, 48, 256}

    def values(node):
        return ([node.value] if node.value is not None else []) + [v for kid in node.children() for v in values(kid)]

    assert values(root) == list(range(256))


def test_op13_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = queries.op13_prefix_trie(spark, SF)
    want = con.execute(queries.ORACLE["op13_prefix_trie"]).fetchall()
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_numbered_groups_over_ranges(spark):
    frame = spark.range(3000).select(F.when(F.col("id") < 2000, 5).otherwise(F.col("id") % 7).alias("g"), (F.col("id") * 7919 % 3001).alias("v")).repartition(6)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = runs.numbered(frame, "g", [F.col("v")]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    by = defaultdict(list)
    for r in rows:
        by[r["g"]].append((r["pos"], r["v"]))
    assert all([p for p, _ in sorted(own)] == list(range(len(own))) and [v for _, v in sorted(own)] == sorted(v for _, v in own) for own in by.values())


# ---- earlier operators

RANKS = pretokens.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
ENC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_op6_leaves_stay_bounded_and_trees_are_kept():
    rnd = random.Random(66)
    find = regex.compile(public_tokenizers.PATTERN).findall
    parts = ["a", "the", "'", "'ll", " ", "  ", "\n", "1", "!", "é", "l", "s"]

    def count(w):
        return len(pretokens.merge(w.encode(), RANKS))

    for _ in range(25):
        text = "".join(rnd.choice(parts) for _ in range(rnd.choice([0, 5, 400, 3000])))
        tree = token_counts.CountTree(find(text), find, count)
        for _ in range(8):
            a = rnd.randint(0, len(text))
            b = rnd.randint(a, min(len(text), a + rnd.choice([0, 2, 1500])))
            new = "".join(rnd.choice(parts) for _ in range(rnd.choice([0, 1, 4, 5000])))
            text = text[:a] + new + text[b:]
            tree.replace(a, b, new)
            assert max(map(len, (tree.leaf(i) for i in range(len(tree.leaves))))) <= token_counts.LEAF
            assert tree.text() == text and tree.total == len(ENC.encode_ordinary(text))
            if rnd.random() < 0.5:
                tree = token_counts.CountTree.load(text, tree.dump(), find, count)


def test_op6_second_batch_costs_what_it_touches(spark):
    texts = [None, "", "x" * 4000 + " end", "word 12 and more. " * 6000, "It's  the\n end "]
    docs = spark.createDataFrame([(i, t, [(0, 0, "new ")] if i != 2 else None, "c") for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, edits array<struct<start:int,stop:int,new:string>>, pieces string")
    built = token_counts.trees(docs, RANKS, public_tokenizers.PATTERN)
    first = token_counts.edit(built, RANKS, public_tokenizers.PATTERN)
    again = F.array(F.struct(F.lit(40_000).cast("int").alias("start"), F.lit(40_003).cast("int").alias("stop"), F.lit("Z 9").alias("new")))
    second = token_counts.edit(first.drop("n_edits", "n_encoded_again").withColumn("edits", again), RANKS, public_tokenizers.PATTERN)
    for r in second.collect():
        old = (texts[r["doc_id"]] or "") if r["doc_id"] == 2 else "new " + (texts[r["doc_id"]] or "")
        new = old[:40_000] + "Z 9" + old[40_003:]
        assert r["text"] == new and r["n_tokens"] == len(ENC.encode_ordinary(new)) and r["n_encoded_again"] < 60 and r["pieces"] == "c"
    empty = docs.limit(0)
    assert token_counts.edit(token_counts.trees(empty, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).count() == 0


def test_op9_null_item_ids(spark):
    words = [f"w{i}x" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words), "k")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(None, " ".join(words[:20])), (-1, " ".join(words[30:50]))], "item_id bigint, text string")
    assert {r["item_id"] for r in decontam.contaminations(docs, items).collect()} == {None, -1}


def test_op2_all_queries_get_k_rows_and_lengths_are_apart(spark):
    rnd = np.random.default_rng(22)
    tight = [(i, [float(x) for x in 10 + 0.01 * rnd.normal(size=6)]) for i in range(3000)]
    far = [(5000 + i, [float(x) for x in rnd.normal(size=6) * 100]) for i in range(30)]
    short = [(9000 + i, [1.0, float(i)]) for i in range(25)]
    hot = [(7777, [0.0, 0.0, 0.0, 0.0, 0.0, 50.0])] * 500
    frame = spark.createDataFrame([*tight, *far, *short, *hot], "vec_id bigint, embedding array<double>").repartition(4)
    rows = ann.nearest(frame, F.col("vec_id") % 7 == 0, leaf_rows=8, part_rows=256).collect()
    got = Counter(r["query_id"] for r in rows)
    for i, v in [*tight, *far, *short, *hot[:1]]:
        if i % 7 == 0:
            assert got[i] == 20
    assert all((r["query_id"] >= 9000) == (r["vec_id"] >= 9000) for r in rows)


def test_op2_recall_outside_the_calibration(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x, ids = np.array(frame.toPandas().embedding.tolist(), float), frame.toPandas().vec_id.to_numpy()
    good = ann.usable(frame, "vec_id", "embedding")
    tree = ann.grow(x[np.argsort(ids)], 64)
    visits = ann.calibrate(good, tree, (F.col("vec_id") % 20 == 0) & (F.col("vec_id") % 50 != 0), 20, ann.RECALL, 200)
    leaf, found, wanted = tree.assign(x), 0, 0
    for i in np.flatnonzero(ids % 50 == 0):
        scores = x @ x[i]
        scores[i] = -np.inf
        best = np.lexsort((ids, -scores))[:20]
        found, wanted = found + int(np.isin(leaf[best], tree.walk(x[i], visits)).sum()), wanted + 20
    print(f"recall {found / wanted:.3f} with {visits} of {tree.leaves} leaves")
    assert found >= 0.9 * wanted


def test_op3_places_as_in_pandas(spark):
    docs = spark.createDataFrame([(i, None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 200}", i % 5) for i in range(900)] + [(4, "s4", 4)] * 40,
                                 "doc_id bigint, source string, size bigint").repartition(5)
    order = [F.col("doc_id"), F.col("size")]
    out = sharding.interleave(docs, 4, F.col("source"), order, bucket_rows=50).toPandas()
    keys = docs.select("doc_id", F.xxhash64(F.lit(0), *order).alias("h"), F.xxhash64(F.lit(1), *order).alias("t"),
                       F.xxhash64(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("s")).toPandas()
    keys = keys.sort_values(["s", "h", "t"])
    keys["rank"] = keys.groupby("s").cumcount()
    keys["place"] = (keys["rank"] + 0.5) / keys.groupby("s")["rank"].transform("size")
    by = spark.createDataFrame([(int(s), float(p)) for s, p in zip(keys.s, keys.place, strict=True)], "s bigint, p double").select("s", "p", F.xxhash64("s", "p").alias("by")).distinct().toPandas()
    keys = keys.merge(by, left_on=["s", "place"], right_on=["s", "p"]).sort_values(["place", "by"])
    keys["shard"] = np.arange(len(keys)) * 4 // len(keys)
    assert Counter(zip(keys.doc_id, keys.shard, strict=True)) == Counter(zip(out.doc_id, out.shard, strict=True))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_words_of_many_blocks_are_encoded_once_each(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("aébc€1'") for _ in range(rng.randint(1, 400 if i % 50 == 0 else 9))) for i in range(300)]
    lists = [[rng.choice(words) for _ in range(rng.randint(0, 60))] for _ in range(200)]
    calls = spark.sparkContext.accumulator(0)

    class Words:  # texts are lists of words without a pattern
        def __init__(self):
            self.rows, self.size = [], 0

        def extend(self, texts):
            self.rows += texts.to_pylist()
            self.size += 100 * len(texts)

        def numbered(self):
            own = [r.split(" ") if r else [] for r in self.rows]
            names = sorted({w for r in own for w in r})
            number = {w: i for i, w in enumerate(names)}
            return names, np.array([number[w] for r in own for w in r], np.int32), np.cumsum([0, *map(len, own)])

    def encoder():
        def encode(asked):
            calls.add(len(asked))
            return [[len(w)] + list(w) if len(w) % 3 else [] for w in asked]
        return encode

    def finish(rows, ids, bounds):
        return pa.Table.from_arrays([rows.column(0), pa.array([ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
                                                              pa.list_(pa.int64()))], names=["no", "ids"])

    docs = spark.createDataFrame([(i, " ".join(r) or None) for i, r in enumerate(lists)], "no bigint, text string").repartition(3, "no")
    fields = T.StructType.fromDDL("no bigint, ids array<bigint>").fields
    got = {r["no"]: r["ids"] for r in bpe.by_words(docs, Words, encoder, finish, fields, 1000, 5).collect()}
    code = lambda w: [len(w.encode())] + list(w.encode()) if len(w.encode()) % 3 else []
    assert got == {i: [x for w in r for x in code(w)] for i, r in enumerate(lists)}
    assert calls.value == len({w for r in lists for w in r})


def test_buckets_of_words_follow_from_their_bytes_alone():
    words = [f"w{i}" for i in range(20000)] + ["", "a" * 1000, "é"]
    whole = bpe._bucket_of(pa.array(words), 256)
    assert (bpe._bucket_of(pa.array(words[::-1]), 256)[::-1] == whole).all()
    assert (bpe._bucket_of(pa.array(["x", *words]).slice(1), 256) == whole).all()
    counts = np.bincount(whole, minlength=256)
    assert counts.min() > 40 and counts.max() < 130
