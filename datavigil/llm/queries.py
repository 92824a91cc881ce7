"""Queries of this subpackage over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datavigil.llm import ann, bpe, decontam, dualtree, langid, neardup, packing, pretokens, quality, sharding, token_counts, tries, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks() -> dict[bytes, int]:
    return pretokens.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query
def op1_byte_bpe(spark, sf_dir):
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks(), public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks()).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_kmeans_tree_search(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op3_stratified_shards(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    cut = sharding.interleave(docs, 8, F.col("source"), [F.col("doc_id"), F.col("size"), F.col("text_crc32")])
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "source")


@query
def op4_cotrained_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "quality_score", "quality_kept")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op5_url_vocabulary(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES).drop("url")


ORACLE["op5_url_vocabulary"] = urls.judge_sql(URL_RULES)


@query
def op6_edit_aware_token_counts(spark, sf_dir):
    edited = token_counts.redactions(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return token_counts.count_tokens(edited, ranks(), public_tokenizers.PATTERN)


@query
def op7_string_kernel_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query
def op8_warc_derivatives(spark, sf_dir):
    found = warc.responses(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.derivatives(found).drop("block", "content_type")


ORACLE["op8_warc_derivatives"] = warc.derivatives_sql()


@query
def op9_seeded_alignment(spark, sf_dir):
    return decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_minhash_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op11_best_fit_packing(spark, sf_dir):
    pieces = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op12_dual_tree_search(spark, sf_dir):
    return dualtree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op12_dual_tree_search"] = dualtree.search_sql()


@query
def op13_prefix_trie(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return tries.prefix_nodes(tries.rebuilt(tries.turn_ids(conversations)), conversations.select("conv_id"))


ORACLE["op13_prefix_trie"] = tries.rebuilt_nodes_sql()
