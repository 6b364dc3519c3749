"""Score expressions: modifiers, combinations, normalisers, chunk and document scores, explanations.

All are built-in column expressions. Where a formula has no value (the logarithm of a number of 0 or
less, a division by 0, the root of a negative number) the score is null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _log(f: Callable[[Column], Column], shift: int) -> Callable[[Column], Column]:
    return lambda x: F.when(x + F.lit(shift) > 0, f(x + F.lit(shift)))


MODIFIERS: dict[str, Callable[[Column], Column]] = {
    "none": lambda x: x,
    "log": _log(F.log10, 0),
    "log1p": _log(F.log10, 1),
    "log2p": _log(F.log10, 2),
    "ln": _log(F.ln, 0),
    "ln1p": _log(F.ln, 1),
    "ln2p": _log(F.ln, 2),
    "square": lambda x: x * x,
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
    "reciprocal": lambda x: F.try_divide(F.lit(1.0), x),
    "reciprocal1p": lambda x: F.try_divide(F.lit(1.0), x + F.lit(1.0)),
    "abs": F.abs,
    "invert": lambda x: -x,
    "invert1p": lambda x: F.lit(1.0) - x,
}

COMBINATIONS: dict[str, Callable[..., Column]] = {
    "multiply": lambda *x: reduce(lambda a, b: a * b, x),
    "sum": lambda *x: reduce(lambda a, b: a + b, x),
    "max": lambda *x: F.greatest(*x) if len(x) > 1 else x[0],
    "min": lambda *x: F.least(*x) if len(x) > 1 else x[0],
    "avg": lambda *x: reduce(lambda a, b: a + b, x) / F.lit(float(len(x))),
}

REDUCTIONS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "multiply": F.product, "max": F.max, "min": F.min, "avg": F.avg}


def modified(x: Column, modifier: str = "none", factor: float = 1.0) -> Column:
    """A modifier applied to factor * x."""
    if modifier not in MODIFIERS:
        raise ValueError(f"unknown modifier {modifier!r}; known are {', '.join(MODIFIERS)}")
    return MODIFIERS[modifier](x if factor == 1.0 else x * F.lit(factor))


def combined(mode: str, *scores: Column) -> Column:
    if mode not in COMBINATIONS:
        raise ValueError(f"unknown mode {mode!r}; known are {', '.join(COMBINATIONS)}")
    return COMBINATIONS[mode](*scores)


def reduction(mode: str) -> Callable[[Column], Column]:
    if mode not in REDUCTIONS:
        raise ValueError(f"unknown reduction {mode!r}; known are {', '.join(REDUCTIONS)}")
    return REDUCTIONS[mode]


def normalizer1(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.sqrt(x))


def normalizer2(x: Column, dims: int) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + x / F.lit(float(dims)))


def normalizer3(x: Column, dims: int) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.sqrt(x) / F.lit(float(dims)))


def normalizer4(x: Column, n_bytes: int) -> Column:
    return F.lit(1.0) - x / F.lit(float(n_bytes))


def normalizer5(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.sqrt(F.abs(x)))


# chunk scores


def weighted_chunk(relevance: Column, query_weight: Column, weight: Column, mode: str = "multiply") -> Column:
    return combined(mode, relevance, query_weight, weight)


def offset_weight(query_offset: Column, offset: Column, query_place: Column | None = None, place: Column | None = None) -> Column:
    """How far two chunks stand apart: by their two-dimensional places where both have one, else by their ordinals."""
    flat = F.abs(query_offset - offset).cast("double")
    if query_place is None or place is None:
        return flat
    far = F.sqrt(F.pow(F.get(query_place, F.lit(0)) - F.get(place, F.lit(0)), F.lit(2)) + F.pow(F.get(query_place, F.lit(1)) - F.get(place, F.lit(1)), F.lit(2)))
    return F.when((F.size(query_place) > 1) & (F.size(place) > 1), F.lit(1.0) / (F.lit(1.0) + far)).otherwise(flat)


def weighted_offset(relevance: Column, query_weight: Column, weight: Column, query_offset: Column, offset: Column, mode: str = "multiply") -> Column:
    return combined(mode, relevance, query_weight, weight, offset_weight(query_offset, offset))


def _of_query(first_chunk_only: bool, query: tuple[str, ...], own: tuple[str, ...], value: Column, hits: DataFrame) -> Column:
    """A windowed count over the hits of the own query chunk, or of the first chunk of the query document."""
    if not first_chunk_only:
        return F.sum(value).over(Window.partitionBy(*query, *own))
    head = F.col(query[1]) == F.min(query[1]).over(Window.partitionBy(query[0]))
    return F.sum(F.when(head, value).otherwise(0)).over(Window.partitionBy(query[0], *own))


def coord_chunk(hits: DataFrame, chunks_in_doc: DataFrame, first_chunk_only: bool = False) -> DataFrame:
    """Relevance times the share of a document's chunks that the query chunk's hits hold.

    hits: (query_id, query_offset, doc_id, relevance, ...); chunks_in_doc: (doc_id, n_chunks). With
    first_chunk_only all query chunks of a document use the counts of its first.
    """
    counted = hits.withColumn("n_hits", _of_query(first_chunk_only, ("query_id", "query_offset"), ("doc_id",), F.lit(1), hits))
    return counted.join(chunks_in_doc, "doc_id", "left").withColumn("score", F.col("relevance") * F.col("n_hits") / F.coalesce(F.col("n_chunks"), F.lit(1)))


def _with_frequency(hits: DataFrame, threshold: float, first_chunk_only: bool) -> DataFrame:
    near = F.when(F.col("relevance") >= F.lit(threshold), 1).otherwise(0)
    return hits.withColumn("tf", _of_query(first_chunk_only, ("query_id", "query_offset"), (), near, hits))


def tfidf_chunk(hits: DataFrame, n_chunks: int | Column, threshold: float = 0.8, first_chunk_only: bool = False) -> DataFrame:
    """tf * idf**2 with tf the hits of at least the threshold and idf = log10(chunks / (tf + 1))."""
    n = n_chunks if isinstance(n_chunks, Column) else F.lit(float(n_chunks))
    idf = F.log10(n / (F.col("tf") + 1))
    return _with_frequency(hits, threshold, first_chunk_only).withColumn("score", F.col("tf") * idf * idf)


def bm25_chunk(hits: DataFrame, chunks_in_doc: DataFrame, n_chunks: Column, n_docs: Column, threshold: float = 0.8, k1: float = 1.2, b: float = 0.75, first_chunk_only: bool = False) -> DataFrame:
    """BM25 over chunks: document length is its number of chunks, against the mean over documents."""
    tf = F.col("tf")
    idf = F.log10(F.lit(1.0) + (n_chunks - tf + F.lit(0.5)) / (tf + F.lit(0.5)))
    length = F.col("n_chunks") * n_docs / n_chunks
    score = idf * tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * length))
    return _with_frequency(hits, threshold, first_chunk_only).join(chunks_in_doc, "doc_id", "left").withColumn("score", score)


# document scores


def coord_doc(score: Column, n_matched: Column, n_chunks: Column) -> Column:
    """A document's score times the share of its chunks that matched; 1 for a document without chunks."""
    return score * F.coalesce(F.try_divide(n_matched.cast("double"), n_chunks.cast("double")), F.lit(1.0))


def weighted_doc(score: Column, weight: Column, mode: str = "multiply") -> Column:
    return combined(mode, score, weight)


# explanations


def explained(value: Column, name: str, operands: list[Column] | Column | None = None, **more: Column) -> Column:
    """JSON of how a score came about; operands are explanations themselves and are nested as they are."""
    head = F.to_json(F.struct(value.alias("value"), F.lit(name).alias("name"), *(c.alias(k) for k, c in sorted(more.items()))))
    if operands is None:
        return head
    inside = F.array(*operands) if isinstance(operands, list) else operands
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"operands":['), F.array_join(inside, ","), F.lit("]}"))
