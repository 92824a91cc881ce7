"""Training-data pipeline over `documents`: each stage works on all rows that its predecessor kept.

Quality classifier, language ID, near-duplicates, benchmark decontamination, tokens. The first four return the columns of
documents, the last the token ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datavigil.llm import bpe, decontam, langid, neardup, pretokens, quality
from datavigil.session import checkpoint_dir

#: Columns of documents that the classifiers look at.
READ = ("doc_id", "text", "lang", "source", "n_chars")

def _judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], mark: str) -> DataFrame:
    """The rows that judge marks, with their own columns, also where these have names that judge adds."""
    own = [c for c in docs.columns if c not in READ]
    hidden = docs.withColumnsRenamed({c: f"__own{i}" for i, c in enumerate(own)})
    return judge(hidden).where(mark).withColumnsRenamed({f"__own{i}": c for i, c in enumerate(own)}).select(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Rows with nulls anywhere, empty and very long texts are scored like others; repeated rows share their fate; ties with the
    threshold stay; an empty table, or one without both labels, keeps all its rows. Other columns are handed on unread.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _judged(docs, lambda rows: quality.score(rows, model), "quality_kept")


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or that lie further from the language that wins than its labelled rows do, go.

    So do null and empty texts; of equal languages the first in order of text wins; repeated rows share their fate. An empty
    table, or one without a known language, keeps nothing. Other columns are handed on unread.
    """
    model = langid.train(docs)
    return _judged(docs, lambda rows: langid.predict(rows, model), "lang_known")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one with the smallest doc_id, see representatives.

    Rows without words (null, empty, blank) all stay; exact copies and repeated rows are near-duplicates too. An empty table
    keeps nothing. Other columns are handed on.
    """
    return neardup.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, whole or edited, go.

    Null and empty texts hold none; repeated rows share their fate; without items all rows stay, an empty table keeps nothing.
    Other columns are handed on.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids, their number, and whether they decode to the text.

    A null or empty text has no ids; repeated rows are encoded each; an empty table gives no rows.
    """
    ranks = pretokens.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    picked = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    tokens = bpe.decode(bpe.encode(picked, ranks, public_tokenizers.PATTERN), ranks)
    return tokens.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids",
                         (F.sha2("decoded", 256) == F.col("sha")).alias("round_trip"))


STAGES = [("quality_filter", quality_filter), ("language_filter", language_filter), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("tokenize", tokenize)]
#: No SQL: learnt classifiers, MinHash and byte-pair merges are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written as Parquet in the folder spark.checkpoint.dir names and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    for no, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{no}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
