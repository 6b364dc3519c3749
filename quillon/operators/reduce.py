"""Merging of result lists: chunk hits to documents, shards, embeddings of several encoders, batches, barriers."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scores import reduction


def by_key(hits: DataFrame, keys: tuple[str, ...], mode: str = "sum", score: str = "score") -> DataFrame:
    """One row a key with the reduced score and how many hits it has."""
    return hits.groupBy(*keys).agg(reduction(mode)(F.col(score)).alias("score"), F.count("*").alias("n_hits"))


def chunks_to_docs(hits: DataFrame, mode: str = "sum") -> DataFrame:
    """Hits (query_id, doc_id, score) to one row a query and document. No cut and no order."""
    return by_key(hits, ("query_id", "doc_id"), mode)


def merged_docs(shards: list[DataFrame], mode: str = "sum") -> DataFrame:
    """Result lists (query_id, doc_id, score) of several shards to one row a query and document."""
    return by_key(fold(DataFrame.unionByName, shards), ("query_id", "doc_id"), mode)


def merged_chunks(shards: list[DataFrame], mode: str = "sum") -> DataFrame:
    """The same by (query_id, doc_id, offset)."""
    return by_key(fold(DataFrame.unionByName, shards), ("query_id", "doc_id", "offset"), mode)


def explained_docs(hits: DataFrame) -> DataFrame:
    """Scores summed by document with the hits' explanations as a JSON list in order of chunk."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "explained")))
    return hits.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"), F.count("*").alias("n_hits"), F.concat(F.lit("["), F.array_join(F.transform(parts, lambda p: p["explained"]), ","), F.lit("]")).alias("explained"))


def filled(shards: list[DataFrame], keys: tuple[str, ...], value: str) -> DataFrame:
    """For each key the value of the first shard, in the order given, that has one; null where none has."""
    marked = [s.select(*keys, value).withColumn("shard", F.lit(k)) for k, s in enumerate(shards)]
    return fold(DataFrame.unionByName, marked).groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col("shard"))).alias(value))


def joined_embeddings(encoders: list[DataFrame], mode: str = "concat", keys: tuple[str, ...] = ("doc_id", "offset")) -> DataFrame:
    """The embeddings of several encoders, by chunk: one after the other, or their mean."""
    named = [e.select(*keys, F.col("embedding").alias(f"e{k}")) for k, e in enumerate(encoders)]
    joined = fold(lambda a, b: a.join(b, list(keys)), named)
    parts = [F.col(f"e{k}") for k in range(len(encoders))]
    if mode == "concat":
        made = F.concat(*parts)
    elif mode == "avg":
        total = fold(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)
        made = F.transform(total, lambda x: x / F.lit(float(len(parts))))
    else:
        raise ValueError("mode is concat or avg")
    return joined.select(*keys, made.alias("embedding"))


def batches(docs: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """The rows with part_id from 1 and num_parts, `size` rows to a part in order of key.

    Ordinals come from one small window over row counts by range of the key, not from a window over all rows.
    """
    if size <= 0:
        raise ValueError("the batch size must be positive")
    numbered = ordinals(docs, key)
    total = docs.agg(F.count("*").alias("__n"))
    return numbered.crossJoin(F.broadcast(total)).withColumns({"part_id": (F.floor(F.col("ordinal") / size) + 1).cast("int"), "num_parts": F.ceil(F.col("__n") / size).cast("int")}).drop("__n", "ordinal")


def ordinals(docs: DataFrame, key: str, start: int = 0, spread: int = 1 << 12) -> DataFrame:
    """The rows with `ordinal`: start, start + 1, ... in order of key.

    Two steps that scale: the key's range is cut into `spread` pieces whose counts are summed up in one
    small window; rows are ranked within their piece. A null key comes first.
    """
    low, high = docs.agg(F.min(key), F.max(key)).first()
    width = max(1, -(-(high - low + 1) // spread)) if low is not None else 1
    piece = F.coalesce(F.floor((F.col(key) - F.lit(low or 0)) / width), F.lit(-1)).cast("long")
    cut = docs.withColumn("__piece", piece)
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut.groupBy("__piece").agg(F.count("*").alias("__n")).select("__piece", before.alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__piece").orderBy(key))
    return cut.join(starts, "__piece").withColumn("ordinal", F.col("__before") + rank - 1 + start).drop("__piece", "__before")


def barrier(parts: DataFrame, expected: Column, key: str = "request_id") -> DataFrame:
    """(request, n_parts, num_parts, complete): which requests have all their parts; a part that came twice counts once."""
    return parts.groupBy(key).agg(F.countDistinct("part_id").alias("n_parts"), F.max(expected).alias("num_parts")).withColumn("complete", F.col("n_parts") >= F.col("num_parts"))


def merged_routes(routes: DataFrame) -> DataFrame:
    """Routes (request_id, service, identity, start_time, end_time): the last of each service and identity, in order of start."""
    last = routes.groupBy("request_id", "service", "identity").agg(F.max_by(F.struct("start_time", "end_time"), F.struct("start_time", "end_time")).alias("r"))
    return last.select("request_id", "service", "identity", "r.start_time", "r.end_time").orderBy("request_id", "start_time", "service", "identity")


def route_times(routes: DataFrame) -> DataFrame:
    """(service, seconds, share): time by service and its share of the whole."""
    seconds = (F.unix_micros("end_time") - F.unix_micros("start_time")) / F.lit(1e6)
    by = routes.groupBy("service").agg(F.sum(seconds).alias("seconds"))
    return by.withColumn("share", F.try_divide(F.col("seconds"), F.sum("seconds").over(Window.partitionBy())))


def ordered(results: DataFrame, greater_is_closer: bool, key: str = "doc_id") -> DataFrame:
    """The response in order of score, ties by key."""
    return results.orderBy(F.col("score").desc() if greater_is_closer else F.col("score").asc(), key)


def same_direction(*greater_is_closer: bool) -> bool:
    """The direction that chunk and document scores share; different ones are an error before anything runs."""
    if len(set(greater_is_closer)) != 1:
        raise ValueError("chunk and document scores must be sorted in the same direction")
    return greater_is_closer[0]
