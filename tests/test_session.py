"""The shared folder, written tables, and spreading."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import SparkSession

from quillon import session


def _session(master: str, named: str | None, told: str | None = None) -> SimpleNamespace:
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: told)
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: named or d))


def test_shared_folder() -> None:
    assert session.shared_folder(_session("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    assert session.shared_folder(_session("yarn", None, "hdfs:///told/1")) == "hdfs:///told/1"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_folder(_session(master, None))


def test_written_tables(spark: SparkSession) -> None:
    scratch = session.Scratch(spark)
    before = spark.conf.get(session._CLEANUP)
    one = scratch.keep(spark.range(10).groupBy("id").count(), "one")
    assert one.count() == 10 and one.columns == ["id", "count"] and spark.conf.get(session._CLEANUP) == before
    two = scratch.keep(one.where("id < 3"), "two")
    folder = Path(scratch.folder.removeprefix("file:"))
    assert len(list(folder.iterdir())) == 2
    scratch.drop(one)
    assert [p.name[:3] for p in folder.iterdir()] == ["two"] and two.count() == 3
    scratch.drop(one, spark.range(1))  # what isn't there, or isn't a written table, is no matter
    with pytest.raises(Exception, match="broken"):
        scratch.keep(spark.range(1).selectExpr("raise_error('broken') as x"), "bad")
    assert spark.conf.get(session._CLEANUP) == before


def test_spread(spark: SparkSession) -> None:
    cores = spark.sparkContext.defaultParallelism
    few, many = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, cores + 3)
    assert session.spread(few).rdd.getNumPartitions() == cores and session.spread(many) is many
