"""The driver's contract, with and without the training-data subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import SparkSession

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent


def test_entry(spark: SparkSession) -> None:
    df = entry.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "n_hits", "lang", "source", "n_chars"] and df.count() > 0


def test_every_sql_has_a_query() -> None:
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_subpackage(tmp_path: Path) -> None:
    shutil.copytree(REPO / "quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"], cwd=tmp_path, capture_output=True, text=True, check=True)
    count, rest = said.stdout.split(" ", 1)
    assert int(count) > 50 and rest.strip() == "[]"


def test_nothing_else_imports_the_subpackage() -> None:
    for path in (REPO / "quillon").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "quillon.llm" not in path.read_text(), path
