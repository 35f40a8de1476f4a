"""A training corpus from `documents`, in stages that are each written and read again.

language        documents whose language can't be told go (null, without a letter, or below LEAST_SCORE)
near_duplicates of each group of near duplicates, one row stays, of the smallest doc_id
decontaminate   contaminated documents go
pii             personal data in texts is replaced by its kind
mix             documents are drawn to the target weights; topic, expected and copies are added
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common, decontaminate, jaccard_join, language_id, mixing, pii

#: Below what four languages of equal probability and some noise reach: such a text tells nothing.
LEAST_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.filter(~language_id.default_held_out()))
    told = language_id.predict(docs, model, docs.columns, ("__lang_pred", "__score"))
    return told.filter((F.col("__lang_pred") != "und") & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated), ("pii", private), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID and near duplicates can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None
