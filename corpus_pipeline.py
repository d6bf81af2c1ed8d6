"""Corpus pipeline over `documents`: toxicity, line dedup, near dedup, decontamination, mixing to target weights.

Each stage works on all rows its predecessor kept and returns the columns of documents (the last one adds the copy's
number and its place in the global order). Whatever other columns documents have, they are carried along. In every stage
an empty table gives an empty one, and a text is one row that fits a worker's memory, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.decontaminate import drop_overlapping
from pixelloom.llm.linededup import dedup_lines
from pixelloom.llm.mixing import mix_sources
from pixelloom.llm.neardup import keep_one
from pixelloom.llm.tables import free_shuffles, keep
from pixelloom.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Null and empty texts are scored as texts without words, repeated rows alike."""
    free_shuffles(spark)
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, of each group all but the first by id and line; n_chars follows the text.

    Null texts stay null, rows with a null id stay whole, rows of one id lose lines of the same numbers; a text may become empty.
    """
    free_shuffles(spark)
    out = dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id: five-word shingles, similarity 0.8 or more.

    Texts without words and rows with a null id all stay; of rows that repeat an id one stays.
    """
    free_shuffles(spark)
    return keep_one(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go. Null and empty texts stay, repeated rows go or stay together."""
    free_shuffles(spark)
    return drop_overlapping(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks, in a global random order.

    A null source is a source of its own, a null id is drawn as the text 'null'; rows that repeat an id are drawn alike.
    """
    free_shuffles(spark)
    return mix_sources(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: Several stages can't be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stage's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
