"""Picture, sound and frame operators over arrays: windows, weights, histograms, shots, boxes, silence, log-mel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# windows over pictures


def sliding_windows(pictures: DataFrame, window: int = 64, stride: int = 64, weighted: bool = False) -> DataFrame:
    """(doc_id, offset, x, y, cell, weight, pixels) of pictures (doc_id, height, width, channels, pixels), filled with 0 at the far edges.

    `cell` is the place of the window's middle in a grid of 3 by 3. Weights are even, or by how uneven
    the windows' histograms are.
    """
    schema = "doc_id long, offset int, x int, y int, cell array<int>, weight double, pixels array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if not r["pixels"]:
                    continue
                x = np.array(r["pixels"]).reshape(r["height"], r["width"], r["channels"])
                h, w = (max(window, window + -(-(n - window) // stride) * stride) for n in x.shape[:2])
                full = np.zeros((h, w, x.shape[2]), x.dtype)
                full[: x.shape[0], : x.shape[1]] = x
                places = [(i, j) for i in range(0, h - window + 1, stride) for j in range(0, w - window + 1, stride)]
                cut = [full[i : i + window, j : j + window] for i, j in places]
                weights = picture_weights(cut) if weighted else np.full(len(cut), 1 / len(cut))
                cells = [[min(2, int((j + window / 2) * 3 / w)), min(2, int((i + window / 2) * 3 / h))] for i, j in places]
                columns = [[r["doc_id"]] * len(cut), list(range(len(cut))), [j for _, j in places], [i for i, _ in places], cells, list(weights), [c.ravel().tolist() for c in cut]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.list_(pa.int32())), strict=True)], ["doc_id", "offset", "x", "y", "cell", "weight", "pixels"])

    return pictures.select("doc_id", "height", "width", "channels", F.col("pixels").cast("array<int>").alias("pixels")).mapInArrow(run, schema)


def picture_weights(pictures: list[np.ndarray]) -> np.ndarray:
    """Softmax of minus ten times the share of the histogram's variance, summed over channels."""
    spread = np.array([sum(np.bincount(p[..., c].ravel().astype(np.int64), minlength=256).var() for c in range(p.shape[-1])) for p in pictures])
    x = np.exp(-10 * spread / max(spread.max(), 1e-12)) if len(spread) else spread
    return x / x.sum()


def histogram_weights(values: DataFrame, group: str, item: str, bin_of: Column) -> DataFrame:
    """(group, item, weight): the same weights from rows of values, in plain aggregations; 256 bins, empty ones included."""
    n = values.groupBy(group, item, bin_of.alias("bin")).agg(F.count("*").alias("n"))
    stats = n.groupBy(group, item).agg(F.sum("n").cast("double").alias("s"), F.sum(F.col("n") * F.col("n")).cast("double").alias("q"))
    spread = stats.withColumn("var", F.col("q") / 256 - (F.col("s") / 256) * (F.col("s") / 256))
    w = Window.partitionBy(group)
    e = spread.withColumn("e", F.exp(F.lit(-10.0) * F.col("var") / F.greatest(F.max("var").over(w), F.lit(1e-12))))
    return e.select(group, item, (F.col("e") / F.sum("e").over(w)).alias("weight"))


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes; 0 where both are empty."""
    both = area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    union = area(*a) + area(*b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def detected_chunks(boxes: DataFrame, least: float = 0.5, digits: int | None = None) -> DataFrame:
    """Detector boxes (doc_id, score, x0, y0, x1, y1, width, height) of at least a score as chunks, with area share and the grid cell of greatest overlap.

    With `digits`, overlaps are rounded before cells are compared, so that equal ones tie whatever the rounding error; the first cell wins.
    A box without one of its bounds has no overlap and no share, and stands in the first cell.
    """
    own = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))
    w, h = F.col("width"), F.col("height")
    bounded = own[0].isNotNull() & own[1].isNotNull() & own[2].isNotNull() & own[3].isNotNull()
    # nine columns of plain arithmetic, which compile, in place of an array of structs
    settled = (lambda x: x) if digits is None else (lambda x: F.round(x, digits))
    each = {f"__iou{3 * j + i}": settled(overlap(own, (w * i / 3, h * j / 3, w * (i + 1) / 3, h * (j + 1) / 3))) for j in range(3) for i in range(3)}
    out = boxes.where(F.col("score") >= least).withColumns(each).withColumn("iou", F.when(bounded, F.greatest(*each)))
    cell = F.coalesce(*(F.when(F.col(c) == F.col("iou"), F.lit(k)) for k, c in enumerate(each)), F.lit(0))
    out = out.withColumn("__cell", cell).withColumn("cell", F.array((F.col("__cell") % 3).cast("int"), F.floor(F.col("__cell") / 3).cast("int")))
    kept = [F.col(f"`{c}`") for c in boxes.columns if c not in ("cell", "iou", "weight")]
    return out.select(*kept, "cell", "iou", F.when(bounded, area(*own) / (w * h)).alias("weight"))


# frames


def selected_frames(frames: Column, wanted: int) -> Column:
    """One: the middle frame; at least twice as many as wanted: every ceil(n / wanted)-th; fewer: all, in between the first ones evenly."""
    n = F.size(frames)
    if wanted == 1:
        return F.when(n == 0, frames).otherwise(F.slice(frames, F.floor(n / 2).cast("int") + 1, 1))
    step = F.ceil(n / wanted).cast("int")
    some = F.filter(frames, lambda _, i: F.floor((i + 1) * wanted / n) > F.floor(i * wanted / n))
    return F.when(n >= 2 * wanted, F.filter(frames, lambda _, i: i % step == 0)).when(n > wanted, some).otherwise(frames)


def cut_by_frame(position: Column, interval: int) -> Column:
    """The number of the segment of a frame: every `interval` frames; -1 leaves one segment."""
    return F.lit(0) if interval == -1 else F.floor(position / interval).cast("int")


def cut_by_number(position: Column, n_frames: Column, wanted: int) -> Column:
    """The number of the segment when a video is cut into about `wanted`; short ones have a segment for each frame."""
    return F.floor(position / F.greatest(F.floor(n_frames / max(wanted - 1, 1)), F.lit(1))).cast("int")


def _pair_sum(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def histogram_distance(a: Column, b: Column, metric: str) -> Column:
    """A comparison of two histograms of doubles of equal length."""
    n = F.size(a).cast("double")
    if metric == "correlation":
        ma, mb = _sum(a) / n, _sum(b) / n
        top = _pair_sum(a, b, lambda x, y: (x - ma) * (y - mb))
        below = F.sqrt(_pair_sum(a, a, lambda x, _: (x - ma) * (x - ma)) * _pair_sum(b, b, lambda y, _: (y - mb) * (y - mb)))
        return F.when(below > 0, top / below).otherwise(F.lit(1.0))
    if metric == "chisqr":
        return _pair_sum(a, b, lambda x, y: F.when(x != 0, (x - y) * (x - y) / x).otherwise(F.lit(0.0)))
    if metric == "chisqr_alt":
        return _pair_sum(a, b, lambda x, y: F.when(x + y != 0, F.lit(2.0) * (x - y) * (x - y) / (x + y)).otherwise(F.lit(0.0)))
    if metric == "intersection":
        return _pair_sum(a, b, lambda x, y: F.least(x, y))
    if metric in ("hellinger", "bhattacharya"):
        scale = F.sqrt(_sum(a) * _sum(b))
        shared = _pair_sum(a, b, lambda x, y: F.sqrt(x * y))
        return F.sqrt(F.greatest(F.lit(1.0) - F.when(scale > 0, shared / scale).otherwise(F.lit(1.0)), F.lit(0.0)))
    if metric == "kl_div":
        return _pair_sum(a, b, lambda x, y: F.when(x > 0, x * F.ln(x / F.when(y > 0, y).otherwise(F.lit(1e-10)))).otherwise(F.lit(0.0)))
    raise ValueError(f"unknown metric {metric!r}")


def smoothed(series: DataFrame, group: str, at: str, value: str, rounds: int = 1) -> DataFrame:
    """The greatest of each value and its neighbours, `rounds` times; the rows at either end go each time."""
    w = Window.partitionBy(group).orderBy(at)
    for _ in range(rounds):
        series = series.withColumns({"__a": F.lag(value).over(w), "__b": F.lead(value).over(w)}).where("__a is not null and __b is not null")
        series = series.withColumn(value, F.greatest("__a", value, "__b")).drop("__a", "__b")
    return series


def shots(series: DataFrame, group: str, at: str, value: str, threshold: float) -> DataFrame:
    """(group, shot, first, last, n, weight): runs of rows, cut where the value changes by more than the threshold."""
    w = Window.partitionBy(group).orderBy(at)
    change = F.abs(F.col(value) - F.lag(value).over(w)) > F.lit(threshold)
    cut = series.withColumn("__cut", F.when(change, 1).otherwise(0))
    numbered = cut.withColumn("shot", F.sum("__cut").over(w).cast("int"))
    by = numbered.groupBy(group, "shot").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    return by.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


# sound


def sounding_spans(samples: DataFrame, group: str, at: str, level: str, silence: float = 1e-3, least: int = 3) -> DataFrame:
    """(group, first, last): spans between runs of at least `least` silent samples; gaps and islands by windows."""
    w = Window.partitionBy(group).orderBy(at)
    quiet = F.abs(F.col(level)) <= F.lit(silence)
    runs = samples.withColumn("__q", quiet.cast("int")).withColumn("__turn", F.when(F.col("__q") != F.lag("__q").over(w), 1).otherwise(0))
    runs = runs.withColumn("__run", F.sum("__turn").over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(group, "__run")))
    marked = runs.withColumn("__gap", ((F.col("__q") == 1) & (F.col("__n") >= least)).cast("int"))
    marked = marked.withColumn("__span", F.sum(F.when(F.col("__gap") != F.lag("__gap").over(w), 1).otherwise(0)).over(w))
    return marked.where("__gap = 0").groupBy(group, "__span").agg(F.min(at).alias("first"), F.max(at).alias("last")).drop("__span")


def sound_chunks(spans: DataFrame, group: str) -> DataFrame:
    """(group, offset, first, last, weight): sounding spans as chunks in their order, of even weight."""
    w = Window.partitionBy(group)
    return spans.select(group, (F.row_number().over(w.orderBy("first")) - 1).alias("offset"), "first", "last", (F.lit(1.0) / F.count("*").over(w)).alias("weight"))


def framed(samples: np.ndarray, length: int, hop: int) -> np.ndarray:
    """Overlapping frames of a signal, whole ones only."""
    if len(samples) < length:
        return np.zeros((0, length))
    return np.lib.stride_tricks.sliding_window_view(samples, length)[::hop]


def mel_matrix(bands: int, bins: int, rate: float, low: float = 125.0, high: float = 7500.0) -> np.ndarray:
    """Triangles on the mel scale, from spectrum bins to bands; the constant bin has no weight."""
    mel = lambda hz: 1127.0 * np.log1p(np.asarray(hz, float) / 700.0)
    at = mel(np.linspace(0, rate / 2, bins))
    edges = np.linspace(mel(low), mel(high), bands + 2)
    rise = (at[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - at[:, None]) / (edges[2:] - edges[1:-1])
    out = np.maximum(0, np.minimum(rise, fall))
    out[0] = 0
    return out


def log_mel(samples: np.ndarray, rate: int = 16000, window: float = 0.025, hop: float = 0.01, bands: int = 64) -> np.ndarray:
    """The logarithm of the mel spectrum of a signal, frame by frame, with a periodic Hann window."""
    n, step = round(rate * window), round(rate * hop)
    size = 1 << (n - 1).bit_length()
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    spectrum = np.abs(np.fft.rfft(framed(samples, n, step) * hann, size, axis=1))
    return np.log(spectrum @ mel_matrix(bands, size // 2 + 1, rate) + 0.01)


def log_mel_examples(samples: Column, rate: int = 16000, frames: int = 96, bands: int = 64) -> Column:
    """Examples of `frames` frames of a mono signal, each flat."""

    @F.arrow_udf("array<array<double>>")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else framed_examples(log_mel(np.array(v, float), rate, bands=bands), frames) for v in x.to_pylist()], pa.list_(pa.list_(pa.float64())))

    return run(samples)


def framed_examples(mel: np.ndarray, frames: int) -> list[list[float]]:
    return [mel[k : k + frames].ravel().tolist() for k in range(0, len(mel) - frames + 1, frames)]


def silence_times(logs: DataFrame, key: str = "doc_id", log: str = "log") -> DataFrame:
    """(key, start, end) in seconds of each silence that a detector's log lists; one that doesn't end has a null end."""
    starts = F.regexp_extract_all(F.col(log), F.lit(r"silence_start:\s*(-?[0-9.]+)"), F.lit(1))
    ends = F.regexp_extract_all(F.col(log), F.lit(r"silence_end:\s*(-?[0-9.]+)"), F.lit(1))
    each = logs.select(key, F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("x")).where("x.a is not null")
    return each.select(key, F.greatest(F.col("x.a").cast("double"), F.lit(0.0)).alias("start"), F.col("x.b").cast("double").alias("end"))
