"""Corpus pipeline: documents to token ids in five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the
last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import bpe, langid, mixing, neardup, repeats
from evidentia.llm.queries import TOKENIZER
from evidentia.llm.tables import free_name, table, written

#: A document whose best language has a smaller share of its words is rejected.
LEAST_SCORE = 0.5


def _added(done: DataFrame, docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """The result of an operator with names for its new columns that the documents do not have."""
    free = [free_name(docs, n) for n in names]
    return done.toDF(*docs.columns, *free), free


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a language: not undetermined, and one language has half the words.

    Null and empty texts, and texts without a letter, have none and go; repeated rows fare alike.
    """
    judged, (pred, score, _) = _added(langid.predict(docs, langid.train(docs)), docs, "pred", "score", "words")
    return judged.where((F.col(pred) != langid.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group of near copies: similarity 0.8 over five words.

    Texts without words are copies of nothing; rows that repeat an id and a text become one, and
    different texts under one id are documents of their own (``neardup.keep_one``).
    """
    return neardup.keep_one(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words of repeated passages; untouched texts (null and empty ones too) stay as they are, documents cut to nothing go."""
    cut, (_, removed, kept) = _added(repeats.remove_repeats(docs), docs, "words", "removed", "kept")
    touched = F.col(removed) > 0
    left = cut.where(~touched | (F.col(kept) != "")).withColumn("text", F.when(touched, F.col(kept)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(touched, F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: documents as often as their source's target draws them, in shuffled shards.

    Rows without words are never drawn; a null source is a source, the last one.
    """
    return _added(mixing.mix(docs, weights=(5, 2, 1), cap=3), docs, "shard", "pass")[0].select(docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every drawn document, and whether decoding them gives the text back; a null text is an empty one."""
    import public_tokenizers

    path = public_tokenizers.path(TOKENIZER)
    done = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, decoded_col="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
