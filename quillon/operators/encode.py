"""Encoders from chunks to vectors: fitted parameters are small arrays, applied as expressions or on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JITTER = 1e-10


# helpers


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list array without nulls as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    to = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(to), pa.array(np.ascontiguousarray(values).ravel(), kind))


def applied(f, vector: Column, kind: str = "array<double>") -> Column:
    """f from a matrix to a matrix, over a column of vectors; nulls stay null."""
    inner = pa.float64() if "double" in kind else pa.int32()

    @F.arrow_udf(kind)
    def run(x: pa.Array) -> pa.Array:
        return lists(f(matrix(x)), inner) if len(x) else pa.array([], pa.list_(inner))

    return run(vector)


def moments(rows: DataFrame, vector: str = "vector") -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, population variance and count, by one aggregation over positions."""
    each = rows.where(F.col(vector).isNotNull()).select(F.posexplode(F.col(vector).cast("array<double>")).alias("k", "x"))
    got = each.groupBy("k").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.count("*").alias("n")).orderBy("k").collect()
    return np.array([r.m for r in got]), np.array([r.v for r in got]), got[0].n if got else 0


# text


def character_table(dims: int = 128, seed: int = 0) -> np.ndarray:
    """One row for each printing ASCII character from blank on, and a last row for all others."""
    return np.random.default_rng(seed).uniform(-1, 1, (97, dims))


SLICE = 1 << 20


def _counts(texts: pa.Array, place: Callable[[np.ndarray], np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """How often the characters of each text fall on each place below `width`, and how many they are; a null as an empty text.

    Worked on in slices of about SLICE characters, a longer text in parts, so that memory doesn't follow the batch.
    """
    counts = np.zeros((len(texts), width))

    def add(pieces: list[tuple[int, str]]) -> None:
        points = np.frombuffer("".join(x for _, x in pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        of = np.repeat(np.arange(len(pieces)), [len(x) for _, x in pieces])
        made = np.bincount(of * width + place(points), minlength=len(pieces) * width).reshape(-1, width)
        np.add.at(counts, [row for row, _ in pieces], made)

    held, size = [], 0
    for row, scalar in enumerate(texts):
        text = scalar.as_py() or ""
        for at in range(0, len(text), SLICE):
            part = text[at : at + SLICE]
            if held and size + max(len(part), 256) > SLICE:
                add(held)
                held, size = [], 0
            held.append((row, part))
            size += max(len(part), 256)  # short texts take rows of counts
    if held:
        add(held)
    return counts, counts.sum(axis=1)


def _with_nulls(values: np.ndarray, texts: pa.Array) -> pa.Array:
    made = lists(values, pa.float64())
    if not texts.null_count:
        return made
    return pa.array([None if n else v for n, v in zip(texts.is_null().to_pylist(), made.to_pylist(), strict=True)], pa.list_(pa.float64()))


def character_means(text: Column, table: np.ndarray) -> Column:
    """The mean of the rows of a text's characters; an empty text has zeros, a null text null."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        counts, n = _counts(texts, lambda points: np.where((points >= 32) & (points < 128), points - 32, 96), 97)
        return _with_nulls(counts @ table / np.maximum(n, 1)[:, None], texts)

    return run(text)


def hashed_means(text: Column, dims: int = 16) -> Column:
    """A seedless text vector that any SQL engine can follow: how often characters fall on each of `dims` places, as shares; zeros for an empty text, null for null."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        counts, n = _counts(texts, lambda points: points * 31 % dims, dims)
        return _with_nulls(counts / np.maximum(n, 1)[:, None], texts)

    return run(text)


def word_vectors(tokens: DataFrame, vocabulary: DataFrame, dims: int) -> DataFrame:
    """(doc_id, embedding): the mean over (doc_id, token) rows of their vectors (token, vector), zeros for unknown tokens."""
    each = tokens.join(vocabulary, "token", "left").select("doc_id", F.posexplode(F.coalesce("vector", F.array_repeat(F.lit(0.0), dims))).alias("k", "x"))
    means = each.groupBy("doc_id", "k").agg((F.sum("x") / (F.count("*") + F.lit(JITTER))).alias("x"))
    return means.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("a")).select("doc_id", F.col("a.x").alias("embedding"))


def padded(ids: Column, length: int) -> tuple[Column, Column]:
    """Token ids cut or filled with 0 to a length, and their mask."""
    n = F.least(F.size(ids), F.lit(length))
    return F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(0), F.lit(length) - n)), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))


# pooling


def pooled(rows: DataFrame, keys: tuple[str, ...], mode: str = "mean", vector: str = "vector") -> DataFrame:
    """(keys, embedding): mean, greatest, or both one after the other, of the vectors of a group, by position."""
    each = rows.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("k", "x"))
    made = each.groupBy(*keys, "k").agg((F.sum("x") / (F.count("*") + F.lit(JITTER))).alias("mean"), F.max("x").alias("most"))
    both = made.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "mean", "most"))).alias("a"))
    parts = {"mean": [F.col("a.mean")], "max": [F.col("a.most")], "mean_max": [F.col("a.mean"), F.col("a.most")]}
    if mode not in parts:
        raise ValueError("mode is mean, max or mean_max")
    return both.select(*keys, F.concat(*parts[mode]).alias("embedding"))


def means(rows: DataFrame, keys: tuple[str, ...], vector: str = "vector") -> DataFrame:
    """(keys, embedding): the plain mean of the vectors of a group, by position."""
    each = rows.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("k", "x"))
    by = each.groupBy(*keys, "k").agg(F.avg("x").alias("x")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("a"))
    return by.select(*keys, F.col("a.x").alias("embedding"))


def sequences(rows: DataFrame, key: str, order: str, vector: str, length: int, dims: int) -> DataFrame:
    """(key, sequence, mask): the vectors of each group in their order, cut or filled with zeros to `length` of them, and which are its own; null vectors don't count."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order))
    first = rows.where(F.col(vector).isNotNull()).withColumn("__at", at).where(F.col("__at") <= length)
    held = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__at", F.col(vector).cast("array<double>").alias("v")))).alias("a"))
    n = F.size("a")
    filled = F.concat(F.col("a.v"), F.array_repeat(F.array_repeat(F.lit(0.0), dims), F.lit(length) - n))
    return held.select(key, filled.alias("sequence"), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n)).alias("mask"))


def whitened(vector: Column, mean: np.ndarray, values: np.ndarray, offset: float = 1e-4) -> Column:
    """A vector less the mean, each place divided by the root of its eigenvalue and an offset."""
    return applied(lambda x: (x - mean) / np.sqrt(values + offset), vector)


# numbers


@dataclass
class Standardiser:
    """Zero mean and unit (population) deviation by position; a position without spread becomes 0."""

    mean: np.ndarray
    deviation: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame, vector: str = "vector") -> Standardiser:
        mean, variance, _ = moments(rows, vector)
        return cls(mean, np.sqrt(variance))

    def __call__(self, vector: Column) -> Column:
        centre, scale = (F.array(*(F.lit(float(x)) for x in a)) for a in (self.mean, np.where(self.deviation > 0, self.deviation, 1.0)))
        return F.zip_with(F.zip_with(vector.cast("array<double>"), centre, lambda a, b: a - b), scale, lambda a, b: a / b)


def gram(rows: DataFrame, vector: str = "vector") -> tuple[np.ndarray, np.ndarray, int]:
    """Sum of outer products, sum and count; each task sends one matrix."""

    def run(batches):  # noqa: ANN001, ANN202
        total, one, n = None, None, 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                total = x.T @ x + (0 if total is None else total)
                one, n = x.sum(axis=0) + (0 if one is None else one), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64())), pa.array([one], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["g", "s", "n"])

    parts = rows.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>")).mapInArrow(run, "g array<double>, s array<double>, n long")
    flat = parts.select(F.posexplode(F.concat("g", "s", F.array(F.col("n").cast("double")))).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"))
    x = np.array([r.x for r in flat.orderBy("k").collect()])
    if not len(x):
        raise ValueError("no rows to fit on")
    d = int((np.sqrt(4 * len(x) - 3) - 1) / 2)
    return x[: d * d].reshape(d, d), x[d * d : -1], int(x[-1])


@dataclass
class PrincipalComponents:
    """Principal components; each has its greatest coefficient positive, so that signs are settled."""

    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    whiten: bool = False

    @classmethod
    def fit(cls, rows: DataFrame, dims: int, whiten: bool = False, vector: str = "vector") -> PrincipalComponents:
        g, s, n = gram(rows, vector)
        mean = s / n
        values, vectors = np.linalg.eigh((g - n * np.outer(mean, mean)) / max(n - 1, 1))
        order = np.argsort(-values, kind="stable")[:dims]
        c = vectors[:, order].T
        c *= np.sign(c[np.arange(len(c)), np.abs(c).argmax(axis=1)])[:, None]
        return cls(mean, c, np.maximum(values[order], 0), whiten)

    def balanced(self, groups: int) -> PrincipalComponents:
        """The same with components permuted so that `groups` equal runs have like products of variance."""
        order = balanced_groups(self.variance, groups)
        return PrincipalComponents(self.mean, self.components[order], self.variance[order], self.whiten)

    def matrix(self, x: np.ndarray) -> np.ndarray:
        out = (x - self.mean) @ self.components.T
        return out / np.sqrt(np.maximum(self.variance, JITTER)) if self.whiten else out

    def __call__(self, vector: Column) -> Column:
        return applied(self.matrix, vector)


def balanced_groups(variance: np.ndarray, groups: int) -> list[int]:
    """A permutation: the greatest first, each to the group with the least sum of logarithms that has room."""
    if len(variance) % groups:
        raise ValueError("the groups must divide the dimensions")
    room, sums, members = len(variance) // groups, [0.0] * groups, [[] for _ in range(groups)]
    for k in np.argsort(-variance, kind="stable"):
        g = min((g for g in range(groups) if len(members[g]) < room), key=lambda g: (sums[g], g))
        members[g].append(int(k))
        sums[g] += float(np.log(variance[k] + JITTER))
    return [k for m in members for k in m]


def _kmeans(rows: DataFrame, vector: Column, k: int, seed: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, featuresCol="f", maxIter=20).fit(rows.select(array_to_vector(vector).alias("f")))
    return np.array(model.clusterCenters())


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the first of ties."""
    return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)


@dataclass
class ProductQuantiser:
    """Each of n_bytes equal runs of a vector as the number, from 1, of its nearest centre."""

    centres: list[np.ndarray]

    @classmethod
    def fit(cls, rows: DataFrame, n_bytes: int, clusters: int = 16, vector: str = "vector", seed: int = 1) -> ProductQuantiser:
        if clusters > 255:
            raise ValueError("a byte holds at most 255 clusters")
        rows = rows.where(F.col(vector).isNotNull())
        first = rows.select(F.size(vector)).first()
        if first is None or first[0] % n_bytes:
            raise ValueError("the bytes must divide the dimensions")
        d = first[0] // n_bytes
        return cls([_kmeans(rows, F.slice(F.col(vector).cast("array<double>"), 1 + k * d, d), clusters, seed) for k in range(n_bytes)])

    def matrix(self, x: np.ndarray) -> np.ndarray:
        d = self.centres[0].shape[1]
        return np.stack([closest(x[:, k * d : (k + 1) * d], c) + 1 for k, c in enumerate(self.centres)], axis=1).astype(np.int32)

    def __call__(self, vector: Column) -> Column:
        return applied(self.matrix, vector, "array<int>")


def grid_quantiser(low: float, high: float, dims_per_byte: int, clusters: int = 255) -> np.ndarray:
    """Centres that don't look at data: the first `clusters` of an even grid of points within bounds."""
    if not low < high:
        raise ValueError("the bounds must ascend")
    points = max(2, int(np.floor(clusters ** (1 / dims_per_byte) + 1e-9)))
    axis = low + (high - low) * (np.arange(points) + 0.5) / points
    grid = np.stack(np.meshgrid(*[axis] * dims_per_byte, indexing="ij"), axis=-1).reshape(-1, dims_per_byte)
    return grid[:clusters]


def quantised(vector: Column, centres: np.ndarray, dims: int) -> Column:
    """Codes from 1 by the nearest of the same centres for each run of a vector; built-in expressions."""
    d = centres.shape[1]
    table = F.array(*(F.struct(F.lit(k + 1).alias("code"), F.array(*(F.lit(float(v)) for v in c)).alias("c")) for k, c in enumerate(centres)))
    far = lambda part, c: F.aggregate(F.zip_with(part, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    one = lambda i: F.array_min(F.transform(table, lambda t: F.struct(far(F.slice(vector, i * d + 1, d), t["c"]).alias("d"), t["code"].alias("code"))))["code"]
    return F.transform(F.sequence(F.lit(0), F.lit(dims // d - 1)), one)


@dataclass
class Hasher:
    """A cluster for each of n slots and n_bytes of signs of projections, over (x - mean) / variance."""

    mean: np.ndarray
    variance: np.ndarray
    centres: list[np.ndarray]
    projection: np.ndarray = field(repr=False)

    @classmethod
    def fit(cls, rows: DataFrame, n_bytes: int = 8, slots: int = 2, clusters: int = 16, method: str = "uniform", vector: str = "vector", seed: int = 5) -> Hasher:
        mean, variance, _ = moments(rows, vector)
        variance = np.where(variance > 0, variance, 1.0)
        d = len(mean)
        if d % slots:
            raise ValueError("the slots must divide the dimensions")
        run = d // slots
        x = F.col("x")
        scaled = rows.where(F.col(vector).isNotNull()).select(applied(lambda m: (m - mean) / variance, F.col(vector).cast("array<double>")).alias("x"))
        centres = [_kmeans(scaled, F.slice(x, 1 + k * run, run), clusters, seed + k) for k in range(slots)]
        return cls(mean, variance, centres, projections(d, 8 * n_bytes, method, seed))

    def matrix(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.mean) / self.variance
        run = x.shape[1] // len(self.centres)
        slots = [closest(x[:, k * run : (k + 1) * run], c) for k, c in enumerate(self.centres)]
        bits = (x @ self.projection > 0).reshape(len(x), -1, 8)
        return np.concatenate([np.stack(slots, axis=1), (bits << np.arange(8)).sum(axis=2)], axis=1).astype(np.int32)

    def __call__(self, vector: Column) -> Column:
        """Clusters of the slots, then bytes."""
        return applied(self.matrix, vector, "array<int>")


def projections(dims: int, n: int, method: str = "uniform", seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    if method == "uniform":
        return rng.uniform(-1, 1, (dims, n))
    if method == "product_uniform":
        return rng.uniform(-1, 1, (dims, n)) * rng.uniform(0, 1, (dims, n))
    if method == "ortho_uniform":
        blocks = [np.linalg.qr(rng.uniform(-1, 1, (dims, dims)))[0] for _ in range(-(-n // dims))]
        return np.concatenate(blocks, axis=1)[:, :n]
    raise ValueError("method is uniform, product_uniform or ortho_uniform")


def vlad(frames: DataFrame, centres: np.ndarray, keys: tuple[str, ...], vector: str = "vector", farthest: bool = False) -> DataFrame:
    """(keys, embedding): sums of residuals to the nearest centre, centre after centre, of length 1.

    `farthest` takes the farthest centre instead, as some published code does.
    """
    d = centres.shape[1]

    def residual(x: np.ndarray) -> np.ndarray:
        far = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
        at = far.argmax(axis=1) if farthest else far.argmin(axis=1)
        out = np.zeros((len(x), len(centres), d))
        out[np.arange(len(x)), at] = x - centres[at]
        return out.reshape(len(x), -1)

    rows = frames.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(applied(residual, F.col(vector).cast("array<double>"))).alias("k", "x"))
    sums = rows.groupBy(*keys, "k").agg(F.sum("x").alias("x")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("a"))
    norm = F.sqrt(F.aggregate(F.col("a.x"), F.lit(0.0), lambda s, x: s + x * x))
    return sums.select(*keys, F.transform(F.col("a.x"), lambda x: x / F.when(norm > 0, norm).otherwise(F.lit(1.0))).alias("embedding"))


def unit(vector: Column) -> Column:
    """A vector at length 1; zeros stay."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: x / F.when(norm > 0, norm).otherwise(F.lit(1.0)))


def clipped_bytes(vector: Column, low: float = -2.0, high: float = 2.0) -> Column:
    """Values clipped to bounds and spread over 0 to 255."""
    return F.transform(vector, lambda x: F.floor((F.greatest(F.lit(low), F.least(F.lit(high), x)) - low) * F.lit(255.0 / (high - low))).cast("int"))


def code_hex(codes: Column) -> Column:
    """Bytes as one hexadecimal string."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")), "")


def scaled_pixels(values: Column) -> Column:
    """0..255 to -1..1."""
    return F.transform(values, lambda v: v * F.lit(2.0) / F.lit(255.0) - F.lit(1.0))


def chained(rows: DataFrame, *encoders, vector: str = "vector") -> DataFrame:
    """Applies fitted encoders one after the other."""
    for e in encoders:
        rows = rows.withColumn(vector, e(F.col(vector)))
    return rows
