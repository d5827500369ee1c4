"""The corpus pipeline: language ID, near-duplicate removal, decontamination, secret redaction, packing.

Each stage takes (spark, documents, folder of the tables) and works on all that its predecessor kept.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import discard, in_fold, stored
from docloom.llm.decontamination import find_leaks, read_items
from docloom.llm.language_id import UNDETERMINED, fit, identify
from docloom.llm.near_dedup import without_near_duplicates
from docloom.llm.queries import packed
from docloom.llm.secret_scan import redact

#: Texts of which fewer n-grams belong to any one language are not in a known language.
LEAST_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in no learned language: null, without letters, or with few known n-grams."""
    model = fit(docs.where(~in_fold("doc_id", 4, 2)))
    found = identify(docs, model)
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8)."""
    return without_near_duplicates(docs, words=5, percent=80, texts_apart=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = read_items(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return find_leaks(docs, items).where(F.size("leaks") == 0).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; all documents stay, with ``n_chars`` as it then is."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packed(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: SQL can't express the stages: tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again in the shared folder and deleted after the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = stored(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
