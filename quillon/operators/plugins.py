"""Typed places for models and codecs that this repository doesn't bring along.

A slot names its input and output columns; `bind` gives it a function over Arrow batches, which runs
in the workers. A slot that nothing is bound to says so when it is applied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Slot:
    name: str
    needs: tuple[str, ...]
    gives: str
    function: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None

    def bind(self, function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Slot:
        return replace(self, function=function)

    def __call__(self, rows: DataFrame) -> DataFrame:
        f = self.function
        if f is None:
            raise NotImplementedError(f"{self.name} needs a function; give it one with bind()")
        if missing := [c for c in self.needs if c not in rows.columns]:
            raise ValueError(f"{self.name} needs the columns {', '.join(missing)}")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield f(batch)

        return rows.select(*self.needs).mapInArrow(run, self.gives)


_CHUNK = "doc_id long, offset int, weight double, "
_VECTOR = "doc_id long, offset int, embedding array<double>"
_RAW, _PIXELS, _TEXT = ("doc_id", "raw"), ("doc_id", "offset", "pixels"), ("doc_id", "offset", "text")

SLOTS: dict[str, Slot] = {
    s.name: s
    for s in (
        Slot("remote_call", _RAW, "doc_id long, raw binary"),
        Slot("image_decode", _RAW, "doc_id long, height int, width int, channels int, pixels array<int>"),
        Slot("image_segment", _RAW, "doc_id long, score double, x0 double, y0 double, x1 double, y1 double, width double, height double"),
        Slot("audio_decode", _RAW, "doc_id long, rate int, samples array<double>"),
        Slot("video_decode", _RAW, _CHUNK + "height int, width int, channels int, pixels array<int>"),
        Slot("video_encode", ("doc_id", "offset", "height", "width", "channels", "pixels"), "doc_id long, offset int, raw binary"),
        Slot("gif_encode", ("doc_id", "offset", "height", "width", "channels", "pixels"), "doc_id long, offset int, raw binary"),
        Slot("media_probe", _RAW, "doc_id long, seconds double, frames long, width int, height int"),
        Slot("word_segment", _TEXT, "doc_id long, offset int, token string, start int, end int"),
        Slot("text_transformer", _TEXT, _VECTOR),
        Slot("text_contextual", _TEXT, _VECTOR),
        Slot("image_network", _PIXELS, _VECTOR),
        Slot("image_onnx", _PIXELS, _VECTOR),
        Slot("image_variational", _PIXELS, _VECTOR),
        Slot("video_network", _PIXELS, _VECTOR),
        Slot("video_mixture", _PIXELS, _VECTOR),
        Slot("video_features", _PIXELS, _VECTOR),
        Slot("audio_network", ("doc_id", "offset", "samples"), _VECTOR),
    )
}
