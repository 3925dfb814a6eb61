"""The corpus pipeline: language ID, quality, near-duplicates, benchmark decontamination, byte-pair encoding.

Every stage looks at rows: a row without doc_id, or one that shares it with others, is judged by its own text. Rows equal in
doc_id and text stay or go together. Columns of documents keep their values whatever their names; null, empty and long texts
are as the operators' docstrings say, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waywright.llm import bpe, decontamination, langid, near_duplicates, quality_classifier
from waywright.llm.common import quoted, staged, unused


def same(docs: DataFrame) -> list:
    return [F.col(quoted(c)) for c in docs.columns]


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id and text hash aren't among gone (two columns, in this order)."""
    key, text = unused(docs.columns, "gone_id"), unused(docs.columns, "gone_text")
    gone = gone.toDF(key, text).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(text)), "left_anti")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language can't be told: no text, no letter."""
    lang, score = unused(docs.columns, "lang_pred"), unused(docs.columns, "lang_score")
    found = langid.identify(docs, langid.train(docs), names=(lang, score))
    return found.where(F.col(lang) != "und").select(*same(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose quality score is below a half."""
    score, predicted = unused(docs.columns, "quality_score"), unused(docs.columns, "predicted")
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score(docs, model, names=(score, predicted)).where(F.col(predicted) == 1).select(*same(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays, and of a group without ids all stay."""
    found = near_duplicates.near_duplicates(docs, text_hash="hash")
    return without(docs, found.where(~F.col("kept")).select("doc_id", "hash"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a benchmark item."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("key"), "text")
    leaks = decontamination.leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    return without(docs, leaks.select("key.doc_id", "key.hash"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the remaining documents are as token ids, and that they decode to themselves: digests of both."""
    return bpe.digest(docs.select("doc_id", "text"), keep_text=False)


STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: The learned stages have no SQL form; tests compare each stage with a plain version of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
