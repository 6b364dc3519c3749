from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory: pytest.TempPathFactory):
    from quillon.session import local_session

    spark = local_session(cpus=4, shuffle_partitions=4)
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    environment = spark.sparkContext.environment
    environment["PYTHONPATH"] = str(Path(__file__).resolve().parent.parent)
    yield spark
    spark.stop()
