"""A corpus from raw documents to packed sequences: language, quality, near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next stage's docs. All but the last return the columns of documents.

Cases, for all stages: columns beside doc_id, text, lang and source are carried along and may have any name, since
a stage's own columns never stand beside them; a null doc_id is an id like others; very long texts are read whole;
an empty table gives no rows. Scratch tables of a stage live until the session ends or common.release is called, so
stages may be taken in any order and read at any time; run() deletes those of each stage once its result is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import common, jaccard, langid, mixing, packing, quality, tokens

#: Predictions below this score are no language that the model knows.
LEAST_LANGUAGE_SCORE = 0.25
#: Near duplicates share so many per cent of their shingles of so many words.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; texts that are null or without letters, or have a score under LEAST_LANGUAGE_SCORE, go. Repeated rows are judged each."""
    common.ready(spark)
    scored = langid.score_with(docs, langid.learn(langid.train_rows(docs)), docs.columns)
    return scored.filter((F.col("lang_pred") != langid.NONE) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good: a score of 0.5 or more. Null and empty texts have the score of no words; repeated rows are judged each."""
    common.ready(spark)
    scored = quality.score_with(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), docs.columns)
    return scored.filter("quality_score >= 0.5").select("row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the least doc_id, rows without one last, then with the least row key.

    A row's key is the hash of its doc_id and text: rows that repeat both are one; rows that share an id but not their
    text, and rows without doc_id, are decided by their texts like others. Texts without words are near nothing."""
    common.ready(spark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    groups = jaccard.link(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), NEAR_WIDTH, NEAR_PERCENT, links=False).select(F.col("doc_id").alias("key"), "component_id").distinct()
    ids = rows.select("key", F.col("row.doc_id").alias("doc_id"))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("m")
    kept = groups.join(ids, "key").groupBy("component_id").agg(least).select("m.key")
    out = rows.join(kept, "key", "left_semi")
    repeats = rows.groupBy("key").count().filter("count > 1")
    return (out if repeats.isEmpty() else out.dropDuplicates(["key"])).select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them, at most three times; a null source is a source."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; a document that the mix repeats is packed as often; null and empty texts are one id."""
    common.ready(spark)
    return packing.pack(docs, tokens.tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("quality classifier", good),
    ("n-gram Jaccard join", distinct),
    ("mixing sources to target weights", mixture),
    ("packing", packed),
]

#: Learned models and byte-pair tokens can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over all documents; the results of the other stages are deleted once they are read."""
    docs, before = common.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with common.scratch(spark) as made:
            out = common.written(stage(spark, docs, sf_dir), "pipeline")
        docs = out
        result = made.pop()  # the last table written is the stage's result
        common.delete(spark, made + before)
        before = [result]
    return docs
