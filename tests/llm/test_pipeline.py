"""The pipeline over odd, empty and wholly rejected tables."""

from __future__ import annotations

from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, a string, `odd.name` string"


def _plain(number: int) -> str:
    return " ".join(f"plain{number}w{k}" for k in range(18))


def _folder(spark: SparkSession, path: Path, docs: DataFrame, labels: list[tuple], items: list[tuple]) -> str:
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def _docs(spark: SparkSession, texts: list[tuple[int | None, str | None]]) -> DataFrame:
    return spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t), 1, "x", "o") for k, t in texts], DOCS)


def test_odd_rows(spark: SparkSession, tmp_path: Path) -> None:
    long = " ".join(f"word{k % 5000}" for k in range(60_000))
    line = " ".join(f"w{k}" for k in range(60))
    texts = [(0, _plain(0)), (1, _plain(1)), (1, _plain(1)), (2, None), (3, ""), (4, "x"), (5, long), (6, line), (7, "own words first\n" + line), (None, line), (None, None), (8, "before some benchmark item text after it all")]
    sf_dir = _folder(spark, tmp_path, _docs(spark, texts), [(None, 0, 1), (0, None, 0)], [(1, "some benchmark item text"), (2, None), (None, "x")])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), DOCS)
        assert docs.columns == [c.strip("`") for c in ("doc_id", "text", "lang", "source", "n_chars", "id", "a", "odd.name")], name
    left = sorted((str(r.doc_id), r.text) for r in docs.collect() if r.text is not None)
    assert left == sorted([("0", texts[0][1]), ("1", texts[1][1]), ("3", ""), ("4", "x"), ("5", long), ("6", line), ("7", "own words first"), ("None", line)])
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in got if r.decoded is not None) == left
    assert {str(r.doc_id) for r in got if r.decoded is None} == {"2", "None"}


@pytest.mark.parametrize("case", ["empty", "nothing kept"])
def test_nothing_left(spark: SparkSession, tmp_path: Path, case: str) -> None:
    texts = [] if case == "empty" else [(k, f"some benchmark item text stands here {k}") for k in range(5)]
    sf_dir = _folder(spark, tmp_path, _docs(spark, texts), [], [(1, "some benchmark item text")])
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "tokens", "decoded"] and got.count() == 0
