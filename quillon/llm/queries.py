"""Queries over the training-data tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, classifier, credentials, decontaminate, htmltext, linededup, minhash, sharding, urlrules, webp


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.filtered(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.decoded(webp.drawn(_table(spark, sf_dir, "embeddings")))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(_table(spark, sf_dir, "pages"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.findings(_table(spark, sf_dir, "documents"))


def op4_secrets_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scope_findings(_table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op6_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit(docs, _table(spark, sf_dir, "labels")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(_table(spark, sf_dir, "documents"))


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_media": op2_media,
    "op3_html": op3_html,
    "op4_secrets": op4_secrets,
    "op4_secrets_scope": op4_secrets_scope,
    "op5_minhash": op5_minhash,
    "op6_classifier": op6_classifier,
    "op7_sharding": op7_sharding,
    "op8_bpe": op8_bpe,
    "op9_linededup": op9_linededup,
    "op10_decontaminate": op10_decontaminate,
}

ORACLES: dict[str, str] = {
    "op1_url_filter": urlrules.SQL,
    "op2_media": webp.SQL,
    "op3_html": htmltext.SQL,
    "op4_secrets": credentials.SQL,
    "op7_sharding": sharding.SQL,
}
