"""Corpus pipeline: quality filter, line dedup, near-dedup, decontamination, tokenisation.

Each stage takes what the one before it kept, as Parquet written to the shared folder and read
again; what a stage read is deleted once its own result is written. All stages but the last return the columns of documents.

Defined results, for every stage: an empty table gives an empty table of the same columns; rows with a null id or a null or empty text
stay as they are in all stages but the last, which gives them null or no tokens; of rows equal in id and text one stays, of rows that share
an id but not the text each is filtered for itself, the one with the smallest text stands for the id among copies, and they stay or go
together there; further columns, whatever their names, are carried along to the last stage; a stage that keeps nothing leaves the rest
empty tables; without labels of two classes, or without benchmark items, the stage concerned keeps everything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, classifier, decontaminate, linededup, minhash
from quillon.session import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects as low in quality or toxic go."""
    return classifier.without_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document holds are cut; documents of which nothing is left go."""
    return linededup.without_shared_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays."""
    return minhash.without_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each remaining document, their count and the text decoded from them."""
    return bpe.encoded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_tokens", bpe_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of sf_dir."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        kept = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = kept
    return docs


#: The classifier is trained by stochastic gradient descent, which SQL can't express.
ORACLE_SQL: str | None = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
