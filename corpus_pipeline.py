"""A corpus pipeline: quality, language, near duplicates, personal data, packing.

Each stage is a function of (spark, docs, sf_dir); all but the last return the columns of ``documents``. Every stage takes nulls in
any column, empty and very long texts, repeated rows and ids, empty tables and further columns of any names; what each gives for them is stated with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import language, near_dedup, packing, quality, surrogates
from tessera.llm.common import free_name, materialise
from tessera.session import table

#: Documents of a lower score are rejected.
LEAST_QUALITY = 0.7
#: Documents whose language is less sure are rejected.
LEAST_LANGUAGE = 0.5
#: The secret that surrogates depend on; a user passes their own.
SURROGATE_KEY = "corpus-pipeline"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on the labelled ones, rejects.

    A null text is scored as an empty one; with no labels, all stay, with labels of one class alone, all have its share as their score.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "quality")
    return quality.score(docs, model, score_col=name).where(F.col(name) >= LEAST_QUALITY).select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language that the labelled documents teach; where none is taught, all stay.

    Null texts, texts without letters and texts in which no word or n-gram is known are in no such language (unless a single one is taught).
    """
    model = language.fit(docs.where(F.col("doc_id").isNotNull() & ~quality.held_out()))
    if not model.langs:
        return docs
    pred, sure = free_name(docs, "pred"), free_name(docs, "sure")
    found = language.predict(docs, model, pred_col=pred, score_col=sure)
    return found.where((F.col(pred) != language.UNKNOWN) & (F.col(sure) >= LEAST_LANGUAGE)).select(docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the smallest id (null ids last), and one of rows that repeat an id and text.

    Rows go by id and text: other texts under the id of a duplicate stay. Null and empty texts are duplicates of nothing but their repeated rows.
    """
    return near_dedup.deduplicate(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; a null text stays null, and n_chars counts the new text."""
    fresh = surrogates.replace_personal_data(docs, SURROGATE_KEY)
    return fresh.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else fresh


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all remaining documents into sequences; a null or empty text is its end id alone."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_stage),
    ("language id", language_stage),
    ("near duplicates", near_duplicates_stage),
    ("personal data", personal_data_stage),
    ("packing", packing_stage),
]

#: Models and tokens aren't expressible in SQL; tests/llm/test_pipeline.py holds each stage and the whole run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each leaves is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
