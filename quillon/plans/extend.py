"""What users add: modules of their own, functions over batches, and hooks around steps and streams."""

from __future__ import annotations

import importlib.util
import sys
from collections.abc import Callable, Iterator
from pathlib import Path
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


def use_module(spark: SparkSession, path: str) -> ModuleType:
    """Loads a user's Python file, which registers its steps, and sends it to the workers under its name."""
    name = Path(path).stem
    if not name.isidentifier():
        raise ValueError(f"{name!r} can't be the name of a module")
    if name in sys.modules and getattr(sys.modules[name], "__file__", None) != str(Path(path)):
        raise ValueError(f"there is a module {name} already")
    spark.sparkContext.addPyFile(path)
    found = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(found)
    sys.modules[name] = module
    try:
        found.loader.exec_module(module)
    except BaseException:
        del sys.modules[name]
        raise
    return module


def batched(function: Callable[[pa.Table], pa.Table], size: int, schema: str) -> Callable[[DataFrame], DataFrame]:
    """A step that calls a function with tables of exactly `size` rows, the last of each partition being smaller; every row is passed on."""
    if size <= 0:
        raise ValueError("the batch size must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= size:
                table = pa.Table.from_batches(held)
                yield from function(table.slice(0, size)).to_batches()
                rest = table.slice(size)
                held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield from function(pa.Table.from_batches(held)).to_batches()

    return lambda df: df.mapInArrow(run, schema)


def hooked(step: Callable[..., DataFrame], before: Callable[..., None] | None = None, after: Callable[[DataFrame], None] | None = None) -> Callable[..., DataFrame]:
    """A step with functions that are called with its inputs and with its result, when the plan is made."""

    def run(*inputs: DataFrame) -> DataFrame:
        if before:
            before(*inputs)
        out = step(*inputs)
        if after:
            after(out)
        return out

    return run


def counted(step: Callable[..., DataFrame], name: str, *metrics: Column) -> tuple[Callable[..., DataFrame], Observation]:
    """A step whose result is measured as it is computed, without a pass of its own; the observation has the values after the first action."""
    seen = Observation(name)
    return (lambda *inputs: step(*inputs).observe(seen, *metrics)), seen


class Progress(StreamingQueryListener):
    """Calls a function with the name and the JSON of each progress of a stream; add it with spark.streams.addListener."""

    def __init__(self, function: Callable[[str | None, str], None]) -> None:
        self.function = function

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.function(event.progress.name, event.progress.json)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass
