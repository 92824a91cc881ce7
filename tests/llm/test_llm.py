"""The ten operators and the pipeline against brute force, on small cases and on the smallest table set."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from datavigil.llm import ann, bpe, components, decontam, langid, neardup, pretokens, quality, queries, sharding, token_counts, urls, warc

SF = "/root/testdata/sf0.001"
RANKS = pretokens.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
ENC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
EDGE_TEXTS = [None, "", " ", "a", "  \n x", "It's  the\n end ", "äöü é", "x" * 5000, "one two three four five six", "one two three four five six"]


def edge_docs(spark, empty=False):
    """Null ids and texts, repeated rows, a very long text, and columns whose names the operators use themselves."""
    rows = [(i if i != 3 else None, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}", None, "b", i, "k", 1.0)
            for i, t in enumerate([*EDGE_TEXTS, "long " * 30_000])]
    rows.append(rows[-2])
    schema = ("doc_id bigint, text string, lang string, source string, n_chars bigint, block string, bucket int, ids_x string, score double")
    return spark.createDataFrame([] if empty else rows, schema)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def near_brute(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_word_hashes_are_those_of_the_words():
    import pyarrow as pa

    from datavigil.llm import arrays as A

    texts = ["The cat", None, "", "cat the\tCAT\n", "é É"]
    hashes, starts = A.word_hashes(*A.byte_view(pa.array(texts)))
    got = [list(hashes[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert [len(g) for g in got] == [2, 0, 0, 3, 2]
    assert got[0] == [got[3][1], got[3][0]] and got[3][0] == got[3][2] and got[4][0] != got[4][1]


def test_op1_encodes_as_the_library_does(spark):
    out = queries.op1_byte_bpe(spark, SF).toPandas().set_index("doc_id")
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    assert len(out) == len(texts)
    for doc, text in zip(texts.doc_id, texts.text, strict=True):
        ids = ENC.encode_ordinary(text)
        assert out.n_tokens[doc] == len(ids)
        assert out.ids_sha256[doc] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert out.decoded_sha256[doc] == hashlib.sha256(text.encode()).hexdigest()


def test_op1_edges(spark):
    encoded = bpe.encode(edge_docs(spark).repartition(1), RANKS, public_tokenizers.PATTERN, block_chars=6000)
    rows = bpe.decode(encoded, RANKS).collect()
    wanted = sorted([t or "" for t in EDGE_TEXTS] + ["long " * 30_000, EDGE_TEXTS[-1]])
    assert sorted(bytes(r["decoded"]).decode() for r in rows) == wanted
    assert all(r["ids"] == ENC.encode_ordinary(bytes(r["decoded"]).decode()) and r["block"] == "b" for r in rows)
    assert bpe.decode(bpe.encode(edge_docs(spark, True), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_merges_and_cuts_of_odd_texts():
    rnd = random.Random(5)
    parts = ["a", "the", "'", "'ll", "'s", " ", "  ", "\n", " \n", "1", "!", "é", "　", "\x85", "😀", "\x1c"]
    for _ in range(300):
        texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(3)] + ["q" * rnd.randint(0, 300)]
        block = pretokens.Block(public_tokenizers.PATTERN)
        for t in texts:
            block.add(t)
        words, lists = block.close()
        for t, numbers in zip(texts, lists, strict=True):
            numbers = pretokens.unpack_numbers(pretokens.pack_numbers(numbers))
            assert [i for n in numbers for i in pretokens.merge(words[n].encode(), RANKS)] == ENC.encode_ordinary(t)


def test_op6_counts_follow_random_edits():
    rnd = random.Random(6)
    find = regex.compile(public_tokenizers.PATTERN).findall
    parts = ["a", "the", "'", "'ll", " ", "  ", "\n", "1", "!", "é", "l", "s"]
    for _ in range(300):
        text = "".join(rnd.choice(parts) for _ in range(rnd.choice([5, 40, 400])))
        tree = token_counts.CountTree(find(text), find, lambda w: len(pretokens.merge(w.encode(), RANKS)))
        for _ in range(5):
            a = rnd.randint(0, len(text))
            b, new = rnd.randint(a, min(len(text), a + rnd.choice([0, 2, 50]))), "".join(rnd.choice(parts) for _ in range(3))
            text = text[:a] + new + text[b:]
            tree.replace(a, b, new)
            assert tree.text() == text and tree.total == len(ENC.encode_ordinary(text))


def test_op6_over_documents(spark):
    out = queries.op6_edit_aware_token_counts(spark, SF).toPandas().set_index("doc_id")
    pattern = regex.compile(r"([\w.%+-]+@[\w-]+(?:\.[\w-]+)+)|([0-9]{4,})")
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        text, n = pattern.subn(lambda m: "<mail>" if m[1] else "<number>", r["text"])
        own = out.loc[r["doc_id"]]
        assert (own.n_tokens, own.n_edits) == (len(ENC.encode_ordinary(r["text"])), n)
        assert own.n_tokens_edited == len(ENC.encode_ordinary(text))


def test_op6_edges(spark):
    docs = edge_docs(spark).withColumn("edits", F.expr(
        "array(named_struct('start', 0, 'stop', 2, 'new', string(null)), named_struct('start', 99999999, 'stop', int(null), 'new', 'z'))"))
    rows = token_counts.count_tokens(docs, RANKS, public_tokenizers.PATTERN).collect()
    wanted = [len(ENC.encode_ordinary((t or "")[2:] + "z")) for t in [*EDGE_TEXTS, "long " * 30_000, EDGE_TEXTS[-1]]]
    assert sorted(r["n_tokens_edited"] for r in rows) == sorted(wanted)
    none = docs.withColumn("edits", F.lit(None).cast("array<struct<start:int,stop:int,new:string>>"))
    assert all(r["n_tokens"] == r["n_tokens_edited"] for r in token_counts.count_tokens(none, RANKS, public_tokenizers.PATTERN).collect())


def test_op2_recall_and_order(spark):
    out = queries.op2_kmeans_tree_search(spark, SF).toPandas()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.array(list(rows.embedding), float), rows.vec_id.to_numpy()
    found = wanted = 0
    for i in np.flatnonzero(ids % 20 == 0):
        own = out[out.query_id == ids[i]].sort_values("rank")
        scores = x @ x[i]
        scores[i] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        found, wanted = found + len(set(best) & set(own.vec_id)), wanted + len(best)
        assert list(own["rank"]) == list(range(1, len(own) + 1)) and ids[i] not in set(own.vec_id)
        assert list(zip(-own.score, own.vec_id, strict=True)) == sorted(zip(-own.score, own.vec_id, strict=True))
        np.testing.assert_allclose(own.score, [scores[np.flatnonzero(ids == v)[0]] for v in own.vec_id], rtol=1e-12)
    assert found >= 0.9 * wanted


def test_op2_edges_and_hot_vector(spark):
    nan, schema = float("nan"), "vec_id bigint, embedding array<float>, leaf int"
    odd = [(1, None, 0), (2, [0.0, 0.0], 0), (3, [nan, 1.0], 0), (4, [None, 1.0], 0), (None, [1.0, 0.0], 0), (5, [1.0], 0)]
    same = [(i, [1.0, 0.5], 0) for i in range(100, 400)]
    table = spark.createDataFrame([*odd, *same, (0, [1.0, 0.0], 0)], schema)
    rows = ann.nearest(table, F.col("vec_id") == 0, leaf_rows=8, part_rows=64).orderBy("rank").collect()
    assert [r["vec_id"] for r in rows] == list(range(100, 120))  # ties go to the smaller ids, over all parts of the leaf
    assert ann.nearest(spark.createDataFrame(odd[:4], schema), F.lit(True)).count() == 0
    assert ann.nearest(spark.createDataFrame([], schema), F.lit(True)).count() == 0


def test_op3_shares_and_sizes(spark):
    out = queries.op3_stratified_shards(spark, SF).toPandas()
    texts = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    assert sorted(out.doc_id) == sorted(texts.index)
    counts = out.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and len(counts) == 8
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    mixture = out.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (mixture.max(axis=1) - mixture.min(axis=1)).max() <= 2
    for r in out.itertuples():
        data = texts.text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))


def test_op3_does_not_depend_on_buckets(spark):
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else "hot" if i % 3 else f"s{i % 5}", i, "x") for i in range(500)],
                                 "doc_id int, source string, slot int, bucket string")
    cuts = [sharding.interleave(docs, 3, F.col("source"), [F.col("doc_id")], bucket_rows=n).orderBy("doc_id").collect() for n in (16, 4096)]
    assert cuts[0] == cuts[1] and len(cuts[0]) == 500
    assert sharding.interleave(docs.limit(0), 3, F.col("source"), [F.col("doc_id")]).count() == 0
    assert sharding.interleave(edge_docs(spark), 3, F.col("source"), [F.col("doc_id"), F.col("text")]).count() == 12


def test_op4_separates_the_labelled(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op4_cotrained_quality(spark, sf).toPandas()
    both = out.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert len(out) == 1000 and out.quality_score.between(0, 1).all()
    assert both[both.quality == 1].quality_kept.mean() > 0.97 and both[both.quality == 0].quality_kept.mean() < 0.2


def test_op4_edges(spark):
    docs = edge_docs(spark)
    nothing = spark.createDataFrame([(None, 1), (5, None)], "doc_id bigint, quality int")
    rows = quality.score(docs, quality.train(docs, nothing)).collect()
    assert len(rows) == 12 and all(r["quality_kept"] for r in rows)
    assert quality.score(edge_docs(spark, True), quality.train(edge_docs(spark, True), nothing)).count() == 0


def test_samples_of_a_hot_id_reach_the_driver_once(spark, monkeypatch):
    texts = spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL AND length(text) > 20")
    hot = next(r["doc_id"] for r in texts.orderBy("doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2)
    docs = texts.union(texts.where(F.col("doc_id") == hot).crossJoin(spark.range(400)).drop("id")).cache()
    ids = texts.select("doc_id").distinct().count()
    labels = texts.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    rnd = np.random.default_rng(4)
    points = [(i, [float(x) for x in rnd.normal(size=8)]) for i in range(400)]
    vectors = spark.createDataFrame(points + [points[7]] * 400, "vec_id bigint, embedding array<double>")
    sent, kind = [], type(docs)
    whole, rows = kind.toPandas, kind.collect
    monkeypatch.setattr(kind, "toPandas", lambda self: sent.append(len(out := whole(self))) or out)
    quality.train(docs, labels)
    plain, seen = langid.train(texts), len(sent)
    again = langid.train(docs)
    assert max(sent) <= ids and np.allclose(plain.weights, again.weights, atol=1e-6)
    monkeypatch.setattr(kind, "toPandas", whole)
    assert langid.train(docs, rows_per_lang=20).langs == plain.langs and seen
    good = ann.usable(vectors, "vec_id", "embedding")
    sent.clear()
    tree = ann.grow(np.array([p[1] for p in points]), 8)
    monkeypatch.setattr(kind, "collect", lambda self: sent.append(len(out := rows(self))) or out)
    ann.calibrate(good, tree, F.col("vec_id") % 20 == 0, 20, 0.96, 200)
    assert max(sent) <= 20 * 20


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no host/en/", "", "", None, "allow"),
    ("http://A.Example.NET/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net", "example.net", "", None, "allow"), ("http://example.net/xx", "example.net", "/xx", "net/", "block"),
    ("http://casino.org/fr/1", "casino.org", "/fr/1", "org/fr/", "allow"), ("http://casino.org/en", "casino.org", "/en", None, "block"),
    ("http://casinos.org/en", "casinos.org", "/en", None, "allow"), ("http://free.org/free", "free.org", "/free", None, "allow"),
    ("http://free.org/BETS#a/b", "free.org", "/BETS", None, "block"), ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
])
def test_op5_cases(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "x", "y")], "page_id int, url string, host string, strict string")
    row = urls.judge(pages, queries.URL_RULES).first()
    assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, rule, verdict)


def test_op7_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op7_string_kernel_language(spark, sf).toPandas()
    both = out.merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id").dropna()
    assert len(out) == 1000 and out.score.between(0, 1).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out.itertuples())
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95


def test_op7_edges(spark):
    docs = edge_docs(spark)
    rows = langid.predict(docs, langid.train(docs)).collect()
    assert len(rows) == 12
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or ""))) for r in rows)
    nobody = langid.train(edge_docs(spark, True))
    assert {r["lang_pred"] for r in langid.predict(docs, nobody).collect()} == {"und"}


def test_op7_learns_every_language(spark):
    rnd = random.Random(7)
    alphabets = {f"l{k:02}": [chr(0x4E00 + 20 * k + i) for i in range(20)] for k in range(70)}
    rows = [(100 * k + i, "".join(rnd.choice([*letters, " "]) for _ in range(60)), name)
            for k, (name, letters) in enumerate(alphabets.items()) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs)
    assert model.langs == list(alphabets)
    assert all(r["lang_pred"] == r["lang"] for r in langid.predict(docs, model).collect())
    parted = langid.train(docs, langs_at_once=9)
    assert np.allclose(model.weights, parted.weights, atol=1e-6) and np.array_equal(model.bounds, parted.bounds)


@pytest.mark.parametrize("learnt", [["en"], ["en", "de"], ["de", "en", "fr"]])
def test_language_filter_rejects_unlearned_languages(spark, learnt):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.where(F.col("lang").isin(*learnt, "es")).withColumn("told", F.col("lang"))
    docs = docs.withColumn("lang", F.when(F.col("lang") != "es", F.col("lang")))
    other = spark.createDataFrame([(10**6 + i, "Это русский текст о погоде в городе, номер " + str(i)) for i in range(20)], "doc_id bigint, text string")
    docs = docs.unionByName(other.withColumn("told", F.lit("ru")), allowMissingColumns=True)
    kept = {r["told"]: r["count"] for r in corpus_pipeline.language_filter(spark, docs, SF).groupBy("told").count().collect()}
    whole = {r["told"]: r["count"] for r in docs.groupBy("told").count().collect()}
    assert all(kept[name] >= 0.98 * whole[name] for name in learnt)
    assert kept.get("es", 0) <= 0.2 * whole["es"] and "ru" not in kept


def test_op8_records(spark):
    html = "<html><head><title> A &amp; B</title><script>x<p>y</script></head><body><p>One<br>two &lt;3</p><!-- no --><a href=\"/z\">z</a></body>"
    pages = spark.createDataFrame([(1, "http://h/", html, "m"), (2, None, None, "m"), (1, "http://h/", html, "m")],
                                  "page_id int, url string, html string, block string")
    found = warc.responses(pages)
    rows = warc.derivatives(found).collect()
    assert len(rows) == 6
    text = next(r for r in rows if r["page_id"] == 1 and r["warc_type"] == "conversion")
    assert text["block"] == "A & B\nOne\ntwo <3\nz"
    response = found.where("page_id = 1").first()
    assert (text["refers_to"], text["payload_digest"]) == (response["record_id"], response["payload_digest"])
    assert text["http_headers"] == response["http_headers"] and text["content_length"] == len(text["block"].encode())
    meta = next(r for r in rows if r["page_id"] == 1 and r["warc_type"] == "metadata")
    assert meta["block"] == "title: A &amp; B\r\nlinks: 1\r\noutlink: /z\r\n"
    value = warc.record_text(warc.derivatives(found).where("page_id = 1 AND warc_type = 'conversion'")).first()["value"]
    head, body = value.split("\r\n\r\n", 1)
    assert head.startswith("WARC/1.0\r\nWARC-Type: conversion") and body == text["block"]
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_op9_exact_and_edited_copies(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    item = [rnd.choice(words) for _ in range(30)]
    edited = [w if i % 7 else "other" for i, w in enumerate(item)]
    clean = [rnd.choice(words) for _ in range(300)]
    docs = spark.createDataFrame([
        (1, " ".join(clean[:100] + item + clean[100:])), (2, " ".join(edited)), (3, " ".join(clean)), (4, None), (5, ""),
        (6, ", ".join(item).upper()), (7, " ".join(clean[:50] + item[:8] + clean[50:])), (2, " ".join(edited))], "doc_id int, text string")
    items = spark.createDataFrame([(10, " ".join(item), "x"), (11, None, "x"), (12, "two words", "x")], "item_id int, text string, doc_id string")
    rows = decontam.contaminations(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(1, 10), (2, 10), (2, 10), (6, 10)]
    assert {r["doc_id"]: r["score"] for r in rows}[1] == 1.0
    assert sorted(r["doc_id"] for r in decontam.clean(docs, items).collect()) == [3, 4, 5, 7]
    small = decontam.contaminations(docs, items.union(spark.createDataFrame([(13, " ".join(clean[:20]), "x")], items.schema)), block_words=16)
    assert {(r["doc_id"], r["item_id"]) for r in small.collect()} >= {(1, 10), (3, 13)}
    assert decontam.contaminations(docs, items.limit(0)).count() == 0 and decontam.contaminations(docs.limit(0), items).count() == 0


def test_op9_long_and_short_items(spark):
    rnd = random.Random(19)

    def some(n):
        return ["".join(rnd.choice("abcdefgh") for _ in range(8)) for _ in range(n)]

    long, rest, short, mid = some(700), some(257), some(5), some(9)
    cuts = {100 + k: long[at:at + 128] for k, at in enumerate([0, 1, 127, 128, 129, 192, 255, 256, 400, 571, 572])}
    texts = {**cuts, 1: rest[-3:], 2: rest[100:250], 3: short[:3], 4: short, 5: mid[:5], 6: [mid[0], "other", *mid[2:]], 7: long[300:400],
             8: short[:4]}
    docs = spark.createDataFrame([(i, " ".join(some(40) + t + some(40))) for i, t in texts.items()], "doc_id int, text string")
    items = spark.createDataFrame([(10, " ".join(long)), (11, " ".join(rest)), (12, " ".join(short)), (13, " ".join(mid))], "item_id int, text string")
    rows = decontam.contaminations(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == sorted([(2, 11), (4, 12), (6, 13), *((d, 10) for d in cuts)])
    assert sorted(r["doc_id"] for r in decontam.clean(docs, items).collect()) == [1, 3, 5, 7, 8]


def test_op9_alignment_against_plain_recursion():
    rnd = random.Random(1)
    for _ in range(60):
        a, b = (np.array([rnd.randint(0, 5) for _ in range(rnd.randint(1, 12))]) for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontam.align(a, b) == h.max()


def test_op9_finds_every_whole_item(spark):
    rows = {(r["doc_id"], r["item_id"]) for r in queries.op9_seeded_alignment(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()

    def plain(text):
        return " " + " ".join(re.findall(r"[^\W_]+", text.lower())) + " "

    texts = {r["doc_id"]: plain(r["text"]) for r in docs}
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        assert {(d, item["item_id"]) for d, t in texts.items() if plain(item["text"]) in t} <= rows


def test_op10_against_all_pairs(spark):
    out = queries.op10_minhash_near_dedup(spark, SF).collect()
    wanted = near_brute({r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()})
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == wanted
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_op10_hot_groups_and_splits(spark):
    """A chain of small edits, a large group of near copies around the threshold, exact copies, a shared passage."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = [rnd.choice(words) for _ in range(120)]
    texts, chain = {}, base[:]
    for i in range(60):
        own = base[:]
        for _ in range(rnd.randint(0, 6)):
            own[rnd.randrange(120)] = rnd.choice(words)
        texts[i] = " ".join(own)
    for i in range(60, 90):
        chain[rnd.randrange(120)] = rnd.choice(words)
        chain[rnd.randrange(120)] = rnd.choice(words)
        texts[i] = " ".join(chain)
    for i in range(90, 120):
        texts[i] = " ".join(base[:60] + [rnd.choice(words) for _ in range(60)])
    for i in range(120, 150):
        texts[i] = "The same text here"
    docs = spark.createDataFrame([(i, t, "b", 1) for i, t in texts.items()], "doc_id bigint, text string, bucket string, sig int")
    wanted = near_brute(texts)
    for size in (1, 16, 1000):  # split by keys, cut into tiles, whole
        out = neardup.near_duplicates(docs, bucket_rows=size).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == wanted


def test_op10_edges(spark):
    rows = neardup.near_duplicates(edge_docs(spark)).collect()
    assert len(rows) == 12
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in rows if r["n_shingles"] == 0)
    group = [r for r in rows if r["doc_id"] in (8, 9)]
    assert len(group) == 3 and {r["component_id"] for r in group} == {8} and sum(r["kept"] for r in group) == 1
    assert neardup.near_duplicates(edge_docs(spark, True)).count() == 0


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200), (None, 3)]
    got = {r["v"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 200}


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after and after <= before, name
        before = after
        if name != "tokenize":
            assert docs.columns == names
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in docs.collect())
