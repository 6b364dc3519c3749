"""Nearest neighbours: exact block joins, code joins, bucketed joins, and their lookups.

An exact search compares all pairs, so it is written as a join of blocks: each side is cut into
blocks of rows, each pair of blocks is one unit of work that keeps its best k for each query, and a
window merges these. Neither side is broadcast, and what reaches the merge is k rows for each query
and block.

Distances are rounded to DIGITS digits before they are ranked, so that equal vectors tie; ties go
by id. Null vectors and vectors of another length than the first side's take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import Scratch

DIGITS = 9
BLOCK_ROWS = 1024
STRIP = 64


def _l1(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.abs(q[i : i + 8, None, :] - c[None]).sum(axis=2) for i in range(0, len(q), 8)]) / q.shape[1]


def _l2(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(axis=1)[:, None] - 2 * (q @ c.T) + (c * c).sum(axis=1)[None], 0)


def _cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        sim = (q @ c.T) / (np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((c * c).sum(axis=1))[None])
    return 1 - np.nan_to_num(sim)


def _angular(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    # rounded first, as the root would make a visible distance of the rounding error of equal vectors
    return np.sqrt(np.maximum(2 * np.round(_cosine(q, c), DIGITS), 0))


def _binary(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _bytes(q, c) / q.shape[1]


def _bytes(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(q[i : i + 8, None, :] != c[None]).sum(axis=2) for i in range(0, len(q), 8)]).astype(float)


METRICS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"l1": _l1, "l2": _l2, "cosine": _cosine, "angular": _angular, "binary": _binary, "bytes": _bytes}


def _blocks(side: DataFrame, n: int, name: str, *more: str) -> DataFrame:
    """Rows gathered in n blocks: (ids, values, further columns of lists), lists one after the other."""
    block = F.pmod(F.xxhash64(f"{name}_id"), F.lit(n)).alias(f"{name}_block")
    of = [f"{name}_{x}" for x in ("vector", *more)]
    gathered = side.groupBy(block).agg(F.collect_list(F.struct(f"{name}_id", *of)).alias("x"))
    return gathered.select(F.col(f"x.{name}_id").alias(f"{name}_ids"), F.flatten(F.col(f"x.{of[0]}")).alias(f"{name}_values"), *(F.flatten(F.col(f"x.{x}")).alias(x) for x in of[1:]))


def nearest(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "l1", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of the corpus for every query.

    Both sides are (id, vector); vectors that cost something to make should come from a stored table (see `stored`), as each side is read
    once for its count and once for its blocks. A corpus of fewer than k rows gives all of them.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    distance = METRICS[metric]
    # the length of the vectors is that of the query with the least id
    asked, dims = queries.where("id is not null and vector is not null").agg(F.count("*"), F.min_by(F.size("vector"), "id")).first()
    held = corpus.where("id is not null and vector is not null").count()
    sides = []
    for side, name, rows in ((queries, "q", asked), (corpus, "c", held)):
        side = side.where(F.col("id").isNotNull() & (F.size("vector") == (dims or 0))).select(F.col("id").alias(f"{name}_id"), F.col("vector").cast("array<double>").alias(f"{name}_vector"))
        sides.append(_blocks(side, -(-rows // block_rows) or 1, name))
    pairs = sides[0].crossJoin(sides[1])

    return top(pairs.mapInArrow(_searched(distance, k, dims or 0), _FOUND), k)


_FOUND = "query_id long, id long, distance double"


def _searched(distance: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best of each query of a block among the rows of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows if dims else 0):
                qi, ci = (batch.column(x)[r].values.to_numpy() for x in (0, 2))
                q, c = (batch.column(x)[r].values.to_numpy().reshape(-1, dims) for x in (1, 3))
                for at in range(0, len(q) if len(c) else 0, STRIP):
                    if distance is _l1:
                        strip = q[at : at + STRIP]
                        i, j, exact = _chosen(*_rough_l1(strip, c), lambda i, j, strip=strip: _l1_apart(strip[i], c[j]), ci, k)
                        yield pa.RecordBatch.from_arrays([pa.array(qi[at + i]), pa.array(ci[j]), pa.array(exact)], ["query_id", "id", "distance"])
                        continue
                    d = np.round(distance(q[at : at + STRIP], c), DIGITS) + 0.0
                    order = np.lexsort((np.broadcast_to(ci, d.shape), d), axis=1)[:, :k] if len(ci) <= k else _best(d, ci, k)
                    ids = np.repeat(qi[at : at + STRIP], order.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ci[order].ravel()), pa.array(np.take_along_axis(d, order, 1).ravel())], ["query_id", "id", "distance"])

    return run


def stored(vectors: DataFrame) -> DataFrame:
    """The same rows, made once on all cores and read from the shared folder from then on."""
    return Scratch(vectors.sparkSession).keep(vectors, "vectors")


def _best(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k least of each row, ties by id."""
    out = np.empty((len(d), k), np.int64)
    limit = np.partition(d, k - 1, axis=1)[:, k - 1]
    for r in range(len(d)):
        some = np.flatnonzero(d[r] <= limit[r])
        out[r] = some[np.lexsort((ids[some], d[r][some]))[:k]]
    return out


def top(found: DataFrame, k: int, ascending: bool = True) -> DataFrame:
    """The k best of each query with their ranks from 1; ties by id."""
    order = F.col("distance").asc() if ascending else F.col("distance").desc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def equal_codes(queries: DataFrame, corpus: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, id, distance): all rows whose code equals the query's, or those of the k least ids; both sides are (id, code)."""
    q, c = queries.select(F.col("id").alias("query_id"), "code"), corpus.select("id", "code")
    if k is not None:
        c = c.where("code is not null").withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k)
    return q.join(c, "code").select("query_id", "id", F.lit(0.0).alias("distance"))


def exact_first(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance, rank): equal rows first, then what an approximate search found at a distance, k of them in all; ties by id."""
    other = found.where("distance > 0").select("query_id", "id", "distance")
    return top(exact.select("query_id", "id", F.lit(0.0).alias("distance")).union(other).groupBy("query_id", "id").agg(F.min("distance").alias("distance")), k)


def bit_distance(a: Column, b: Column) -> Column:
    """The number of differing bits of two arrays of bytes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda n, x: n + x)


def _euclidean(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares of distances by products, and how far each of them may be off where distances are rounded to DIGITS."""
    d = _l2(q, c)
    off = 1e-12 * ((q * q).sum(axis=1).max(initial=0) + (c * c).sum(axis=1).max(initial=0))
    return d, 2 * 10.0**-DIGITS * np.sqrt(d + off) + off


def _apart(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to the rows of the same places."""
    return np.sqrt(((q - c) ** 2).sum(axis=1))


def _bits(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, c = (x.view(np.uint64) for x in (q, c))
    d = sum(np.bitwise_count(q[:, j, None] ^ c[None, :, j]).astype(np.int32) for j in range(q.shape[1]))
    return d, np.zeros_like(d)


def _rough_l1(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean absolute differences in single precision, place by place, and how far two of them may be off together."""
    with np.errstate(over="ignore", invalid="ignore"):  # what single precision can't hold is measured exactly
        a, b = q.astype(np.float32), np.ascontiguousarray(c.T, np.float32)
        d, one = np.zeros((len(q), len(c)), np.float32), np.empty((len(q), len(c)), np.float32)
        for j in range(q.shape[1]):
            np.subtract(a[:, j, None], b[j], out=one)
            np.abs(one, out=one)
            d += one
        d /= q.shape[1]
        off = 2.0**-22 * (q.shape[1] + 3) * (np.abs(q).max(initial=0) + np.abs(c).max(initial=0)) + 2 * 10.0**-DIGITS
        return d, np.float32(off)


def _l1_apart(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.abs(q - c).sum(axis=1) / q.shape[1]


def _chosen(d: np.ndarray, slack: np.ndarray, apart: Callable[[np.ndarray, np.ndarray], np.ndarray], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and exact distances of the k best of each row, ties by id: `apart` is asked for what the measure d and its slack leave."""
    if d.shape[1] > k:
        last = np.argpartition(d, k - 1, axis=1)[:, k - 1 : k]
        most = np.take_along_axis(d, last, 1) + (np.take_along_axis(slack, last, 1) if slack.ndim else slack)
        i, j = np.divmod(np.flatnonzero(~(d > most)), d.shape[1])
    else:
        i, j = (x.ravel() for x in np.indices(d.shape))
    exact = np.round(apart(i, j), DIGITS) + 0.0
    best = np.lexsort((ids[j], exact, i))
    i, j, exact = i[best], j[best], exact[best]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept], exact[kept]


def _bits_apart(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.bitwise_count(q.view(np.uint64) ^ c.view(np.uint64)).sum(axis=1).astype(float)


# of two sets of rows: a measure of all pairs with its slack, and the distance of chosen pairs
_WITHIN = {"euclidean": (_euclidean, _apart, "double", np.float64), "bits": (_bits, _bits_apart, "long", np.int64)}
_NO_QUERY, _NO_ROW = -(2**63), -(2**63) + 1


def sharing(queries: DataFrame, corpus: DataFrame, k: int, metric: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest among the rows that share a key with the query in any slot.

    Both sides are (id, keys, vector), one key for each slot. The blocks are those of `nearest`, of a bounded number of rows however
    the keys fall, so that a common key makes no large task; a pair of blocks measures what shares a key only, each pair of rows once, and gives k rows for each query.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    kind = _WITHIN[metric][2]
    usable = F.col("id").isNotNull() & F.col("vector").isNotNull()
    asked, dims, slots = queries.where(usable).agg(F.count("*"), F.min_by(F.size("vector"), "id"), F.max(F.size("keys"))).first()
    held = corpus.where(usable).count()
    sides = []
    # larger blocks of the corpus, as each of them gives k rows for each query
    for side, name, rows, size, missing in ((queries, "q", asked, block_rows, _NO_QUERY), (corpus, "c", held, 8 * block_rows, _NO_ROW)):
        keys = [F.coalesce(F.get("keys", F.lit(i)).cast("long"), F.lit(missing)) for i in range(max(slots or 0, 1))]
        side = side.where(usable & F.col("keys").isNotNull() & (F.size("vector") == (dims or 0)))
        side = side.select(F.col("id").alias(f"{name}_id"), F.col("vector").cast(f"array<{kind}>").alias(f"{name}_vector"), F.array(*keys).alias(f"{name}_keys"))
        sides.append(_blocks(side, -(-rows // size) or 1, name, "keys"))
    found = sides[0].crossJoin(sides[1]).mapInArrow(_shared(metric, k, dims or 0, max(slots or 0, 1)), _FOUND)
    return top(found, k)


def _shared(metric: str, k: int, dims: int, slots: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best of each query of a block among those rows of a block that share a key with it; queries of the same keys are measured together."""
    measure, apart, _, kind = _WITHIN[metric]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows if dims else 0):
                qi, ci = (batch.column(x)[r].values.to_numpy() for x in (0, 3))
                q, c = (batch.column(x)[r].values.to_numpy().astype(kind, copy=False).reshape(-1, dims) for x in (1, 4))
                qk, ck = (batch.column(x)[r].values.to_numpy().reshape(-1, slots) for x in (2, 5))
                sets, of = np.unique(qk, axis=0, return_inverse=True)
                order, to = np.argsort(of.ravel(), kind="stable"), np.cumsum(np.bincount(of.ravel()))
                out = []
                for s, own in enumerate(np.split(order, to[:-1])):
                    some = np.flatnonzero((ck == sets[s]).any(axis=1))
                    for at in range(0, len(own) if len(some) else 0, STRIP):
                        rows = own[at : at + STRIP]
                        d, slack = measure(q[rows], c[some])
                        i, j, exact = _chosen(d, slack, lambda i, j, rows=rows, some=some: apart(q[rows[i]], c[some[j]]), ci[some], k)
                        out.append((qi[rows[i]], ci[some[j]], exact))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "id", "distance"])

    return run


def bucketed(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance, rank): nearest by bits among rows that share a cluster with the query in any slot.

    Both sides are (id, clusters, code): one cluster for each slot, and bytes. A row that shares several counts once.
    """
    q, c = (s.select("id", F.col("clusters").alias("keys"), F.col("code").alias("vector")) for s in (queries, corpus))
    return sharing(q, c, k, "bits")


def approximate(queries: DataFrame, corpus: DataFrame, k: int, cells: int, probes: int, metric: str = "l2", seed: int = 1) -> DataFrame:
    """Nearest neighbours within the `probes` cells closest to each query, the corpus being clustered into `cells` by k-means.

    The join is on the cell. Every row is in one cell, so that no pair is found twice.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    own = corpus.where("id is not null and vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector"))
    model = KMeans(k=cells, seed=seed, featuresCol="f", maxIter=20).fit(own.select(array_to_vector("vector").alias("f")))
    centres = np.array(model.clusterCenters())
    measure = METRICS[metric]

    @F.arrow_udf("array<int>")
    def closest(vectors: pa.Array) -> pa.Array:
        x = vectors.values.to_numpy().reshape(len(vectors), -1)
        order = np.argsort(_l2(x, centres), axis=1, kind="stable")[:, :probes].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * order.shape[1]), pa.array(order.ravel()))

    asked = queries.where("id is not null and vector is not null").select(F.col("id").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    # a large cell is cut into blocks of rows, each of which meets all of the cell's query blocks
    c = own.withColumn("cell", F.get(closest("vector"), F.lit(0))).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-own.count() // (BLOCK_ROWS * cells))))))
    q = asked.withColumn("cell", F.explode(closest("vector"))).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked.count() * probes // (BLOCK_ROWS * cells))))))
    qb = q.groupBy("cell", "part").agg(F.collect_list(F.struct("query_id", "vector")).alias("x")).select("cell", F.col("x.query_id").alias("q_ids"), F.flatten(F.col("x.vector")).alias("q_values"))
    cb = c.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "vector")).alias("x")).select("cell", F.col("x.id").alias("c_ids"), F.flatten(F.col("x.vector")).alias("c_values"))
    return top(qb.join(cb, "cell").select("q_ids", "q_values", "c_ids", "c_values").mapInArrow(_searched(measure, k, centres.shape[1]), _FOUND), k)


def lsh(queries: DataFrame, corpus: DataFrame, k: int, bucket: float, tables: int = 8, seed: int = 3) -> DataFrame:
    """Nearest neighbours by Euclidean distance among rows that share a bucket of random projections in any table."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    sides = [s.where("id is not null and vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector")) for s in (queries, corpus)]
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(sides[1].select(array_to_vector("vector").alias("f")))
    hashed = [model.transform(s.withColumn("f", array_to_vector("vector"))) for s in sides]
    keys = F.array(*(F.get(vector_to_array(F.get("h", F.lit(i))), F.lit(0)).cast("long") for i in range(tables)))
    return sharing(*(s.select("id", keys.alias("keys"), "vector") for s in hashed), k, "euclidean")


def with_documents(results: DataFrame, docs: DataFrame, keep_missing: bool = True) -> DataFrame:
    """Each result with the document of its doc_id; results without one stay unless keep_missing is off."""
    return results.join(docs, "doc_id", "left" if keep_missing else "inner")


def chunk_of_document(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each result (doc_id, offset, ...) with the chunk that has that offset in its document."""
    return results.join(chunks, ["doc_id", "offset"], "left")


def by_ordinal(positions: DataFrame, keys: DataFrame) -> DataFrame:
    """What stands at each insertion ordinal `seq`: (seq, doc_id, offset, weight)."""
    return positions.join(keys, "seq", "left")


def quantised_weight(weight: Column) -> Column:
    """A weight of 0 to 1 in 16 bits and back."""
    return F.floor(weight * F.lit(65535.0)) / F.lit(65535.0)
