"""The operators under the names that flows and their configurations use. A factory takes options and gives a step of DataFrames, or an estimator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import scores
from quillon.operators import encode, frames, knn, reduce, split, video
from quillon.plans.flow import register


def _simple(name: str, operator: Callable[..., DataFrame]) -> None:
    """An operator whose DataFrames come first and whose options are keywords."""

    @register(name)
    def factory(**options: object) -> Callable[..., DataFrame]:
        return lambda *inputs: operator(*inputs, **options)


for _name, _operator in {
    "sentences": split.sentences, "sentence_places": split.sentence_places, "json_documents": split.json_documents, "unary": split.unary, "corpus_counts": split.corpus_counts, "chunks_in_doc": split.chunks_in_doc,
    "nearest": knn.nearest, "equal_codes": knn.equal_codes, "bucketed": knn.bucketed, "approximate": knn.approximate, "lsh": knn.lsh, "exact_first": knn.exact_first, "with_documents": knn.with_documents, "chunk_of_document": knn.chunk_of_document, "by_ordinal": knn.by_ordinal, "stored": knn.stored,
    "chunks_to_docs": reduce.chunks_to_docs, "explained_docs": reduce.explained_docs, "batches": reduce.batches, "merged_routes": reduce.merged_routes, "route_times": reduce.route_times, "ordered": reduce.ordered,
    "pooled": encode.pooled, "coord_chunk": scores.coord_chunk,
    "sliding_windows": frames.sliding_windows, "detected_chunks": frames.detected_chunks, "smoothed": frames.smoothed, "shots": frames.shots, "sounding_spans": frames.sounding_spans, "silence_times": frames.silence_times,
    "descriptors": video.descriptors, "neighbour_distances": video.neighbour_distances, "shot_chunks": video.shot_chunks, "shot_boundaries": video.shot_boundaries, "hashes": video.hashes, "without_repeats": video.without_repeats, "clustered_segments": video.clustered_segments, "resized_pictures": video.resized_pictures, "with_whole_pictures": video.with_whole_pictures,
}.items():
    _simple(_name, _operator)


@register("identity")
def identity() -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows


@register("select")
def select(columns: dict[str, str]) -> Callable[[DataFrame], DataFrame]:
    """Columns by SQL expressions."""
    return lambda rows: rows.select(*(F.expr(e).alias(n) for n, e in columns.items()))


@register("where")
def where(condition: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.where(condition)


@register("join")
def join(keys: list[str], how: str = "inner") -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda a, b: a.join(b, keys, how)


@register("union")
def union() -> Callable[..., DataFrame]:
    def step(first: DataFrame, *rest: DataFrame) -> DataFrame:
        for r in rest:
            first = first.unionByName(r)
        return first

    return step


@register("merged_docs")
def merged_docs(mode: str = "sum") -> Callable[..., DataFrame]:
    return lambda *shards: reduce.merged_docs(list(shards), mode)


@register("merged_chunks")
def merged_chunks(mode: str = "sum") -> Callable[..., DataFrame]:
    return lambda *shards: reduce.merged_chunks(list(shards), mode)


@register("joined_embeddings")
def joined_embeddings(mode: str = "concat") -> Callable[..., DataFrame]:
    return lambda *encoders: reduce.joined_embeddings(list(encoders), mode)


@register("filled")
def filled(keys: list[str], value: str) -> Callable[..., DataFrame]:
    return lambda *shards: reduce.filled(list(shards), tuple(keys), value)


def _vector_step(made: Callable[[Column], Column], column: str, to: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.withColumn(to, made(F.col(column)))


@register("hashed_vectors")
def hashed_vectors(column: str = "text", to: str = "vector", dims: int = 16) -> Callable[[DataFrame], DataFrame]:
    return _vector_step(lambda c: encode.hashed_means(c, dims), column, to)


@register("character_vectors")
def character_vectors(column: str = "text", to: str = "vector", dims: int = 128, seed: int = 0) -> Callable[[DataFrame], DataFrame]:
    return _vector_step(lambda c: encode.character_means(c, encode.character_table(dims, seed)), column, to)


@register("unit_vectors")
def unit_vectors(column: str = "vector", to: str = "vector") -> Callable[[DataFrame], DataFrame]:
    return _vector_step(encode.unit, column, to)


@register("normalized_score")
def normalized_score(number: int = 1, column: str = "distance", to: str = "score", **options: float) -> Callable[[DataFrame], DataFrame]:
    return _vector_step(lambda c: getattr(scores, f"normalizer{number}")(c, *options.values()), column, to)


@register("modified_score")
def modified_score(modifier: str = "none", factor: float = 1.0, column: str = "score", to: str = "score") -> Callable[[DataFrame], DataFrame]:
    return _vector_step(lambda c: scores.modified(c, modifier, factor), column, to)


@register("coord_doc")
def coord_doc(score: str = "score", hits: str = "n_hits", chunks: str = "n_chunks", to: str = "score") -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.withColumn(to, scores.coord_doc(F.col(score), F.col(hits), F.col(chunks)))


@dataclass
class Fitting:
    """An encoder that is fitted to a column of vectors; what `fit` gives is a step."""

    kind: type
    options: dict
    column: str = "vector"
    to: str = "vector"

    def fit(self, rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
        model = self.kind.fit(rows.select(F.col(self.column).alias("vector")), **self.options)
        return _vector_step(lambda c: model(c), self.column, self.to)


for _name, _kind in {"standardiser": encode.Standardiser, "principal_components": encode.PrincipalComponents, "product_quantiser": encode.ProductQuantiser, "hasher": encode.Hasher}.items():
    register(_name)(lambda kind=_kind, column="vector", to="vector", **options: Fitting(kind, options, column, to))
