"""From raw documents to a training mix: each stage works on all rows that its predecessor kept.

Stages take ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``. ``run`` writes what a stage
returns as Parquet into the shared folder and gives the next one the table that it reads back.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens.llm import circulant, curriculum, edit_decontam, kn_quality, pseudonyms
from incidentlens.llm.frames import read
from incidentlens.llm.queries import PSEUDONYM_KEY
from incidentlens.plans.materialize import materialize, remove, scratch, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their language's perplexity band accept."""
    return kn_quality.quality_rules(docs, measures=False, labels=read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return circulant.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return edit_decontam.drop_leaked(docs, read(spark, sf_dir, "benchmark"))


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data, and their new lengths in characters."""
    out = pseudonyms.pseudonymize(docs, PSEUDONYM_KEY, count_col=None)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with what the mix takes of each, in the order of training."""
    return curriculum.mix(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pseudonymize", pseudonymize),
    ("mix_sources", mix_sources),
]

ORACLE_SQL = None  # the perplexity model, pseudonyms and hash orders have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. What a stage writes on its way is removed once its result is written, and that result
    once the next stage's is."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), folder=folder)
        if before:
            remove(spark, before)
        before = folder
    return docs
