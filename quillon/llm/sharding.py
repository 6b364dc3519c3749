"""Hilbert-curve ordering: shards whose files can be pruned by several metadata columns at once.

Each dimension is quantised to 2**BITS - 1 cells that hold about as many rows each, cell 0 being kept
for nulls. The cells come from a histogram of the whole table: for a string by its values, for a
number by a scale that is linear between powers of two (its bit length and the BITS_BELOW bits after
the leading one, at most 2,016 steps, exact in integers) above the least value of the table. Cells
keep the order, so that a file's least and greatest values, which Parquet records, are close
together. String dimensions are meant for categories: their distinct values are ranked in one task.

The cells' Hilbert index orders the rows. The curve has (2**BITS)**dimensions places, 32,768 with
the defaults, however large the table: byte counts by place are one aggregation, and running totals
over the places fit one small task. The curve is cut every TARGET_CHARS characters; a place with
more than that takes several shards, over which its rows go by their id.

Cells and places are joined to the rows by broadcast as long as they have at most BROADCAST_ROWS rows,
which only the distinct values of a string can exceed; these are then joined by a shuffle. One exchange sends the rows of each
shard to a partition of its own (up to MAX_PARTITIONS; beyond that to as few as may be, in order), so that a task reads about TARGET_CHARS
however large the table. Within a partition rows are sorted by shard, curve index and id. Whole rows travel, as the files are
to be rewritten in the new order: `write_shards` writes one file a shard, whose Parquet statistics bound every dimension.

Defined results: a null dimension, or a number that isn't finite or reaches 2**62, has cell 0; a null id goes to the first shard of its place; a null
text counts as no characters; repeated rows stay and lie beside one another; ties in the curve index
are in order of id; an empty table gives no rows. Columns named like the ones that are added
(curve, shard) are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, NumericType

from quillon.session import cut_lineage

BITS = 5
BITS_BELOW = 5
TARGET_CHARS = 16_000_000
BROADCAST_ROWS = 100_000
MAX_PARTITIONS = 100_000
DIMENSIONS = ("source", "lang", "n_chars")


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of `cells` (Skilling 2004, on arrays)."""
    x = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0]) ^ swap
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ t) >> b) & 1)
    return out


def _curve(columns: list[Column], bits: int) -> Column:
    @F.arrow_udf("long")
    def index(*cells: pa.Array) -> pa.Array:
        return pa.array(hilbert(np.stack([c.to_numpy(zero_copy_only=False) for c in cells], axis=1), bits))

    return index(*columns)


def _scale(value: Column) -> Column:
    """Rank of a whole number of 0 at least on a scale that is linear between powers of two; exact."""
    length = F.length(F.bin(value)) - 1
    below = F.when(length >= BITS_BELOW, F.lit(0)).otherwise(F.lit(BITS_BELOW) - length)
    top = F.call_function("shiftright", F.call_function("shiftleft", value, below), F.greatest(length - BITS_BELOW, F.lit(0)))
    return F.when(value == 0, F.lit(0)).otherwise(length * (1 << BITS_BELOW) + (top - F.lit(1 << BITS_BELOW)) + 1)


def small(side: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A table of a few narrow columns, made once; it is broadcast where it has at most so many rows, else joined as any other."""
    side = cut_lineage(side)
    return F.broadcast(side) if side.count() <= most else side


def with_cells(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> tuple[DataFrame, list[str]]:
    """The rows with a cell for each dimension, and the cells' column names."""
    top, names = (1 << bits) - 1, []
    for k, d in enumerate(dimensions):
        names.append(name := f"__quillon_cell{k}")
        column, level = F.col(f"`{d}`"), f"__quillon_level{k}"
        if isinstance(docs.schema[d].dataType, NumericType):
            if isinstance(docs.schema[d].dataType, FractionalType):
                column = F.when(F.abs(column) < F.lit(2.0**62), column)
            low = docs.agg(F.min(F.floor(column)).cast("long")).first()[0]
            column = _scale(F.floor(column).cast("long") - F.lit(low if low is not None else 0))
        docs = docs.withColumn(level, column)
        counts = docs.where(F.col(level).isNotNull()).groupBy(level).agg(F.count("*").alias("__quillon_rows"))
        before = F.coalesce(F.sum("__quillon_rows").over(Window.orderBy(level).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        total = F.sum("__quillon_rows").over(Window.partitionBy())
        cells = counts.select(F.col(level).alias("__quillon_of"), (F.lit(1) + F.call_function("div", before * top, total)).cast("int").alias(name))
        docs = docs.join(small(cells), F.col(level) == F.col("__quillon_of"), "left").drop(level, "__quillon_of").withColumn(name, F.coalesce(name, F.lit(0)))
    return docs, names


def sharded(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, target: int = TARGET_CHARS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows with `curve` and `shard`, in order of shard, curve index and id."""
    kept = [c for c in docs.columns if c not in ("curve", "shard")]
    celled, names = with_cells(docs.select(*(F.col(f"`{c}`") for c in kept)), dimensions, bits)
    grid = celled.groupBy(*names).agg(F.sum(F.coalesce(F.length(F.col(text)), F.lit(0)).cast("long")).alias("__quillon_chars"))
    places = grid.withColumn("curve", _curve([F.col(c) for c in names], bits))
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("__quillon_chars").over(before), F.lit(0))
    own = F.greatest(F.ceil(F.col("__quillon_chars") / F.lit(target)), F.lit(1))
    places = places.select(*names, "curve", total.alias("__quillon_before"), own.cast("long").alias("__quillon_own"))
    # a place that fits one shard belongs to the one where it begins; a larger one has shards of its own
    extra = F.sum(F.when(F.col("__quillon_own") > 1, F.col("__quillon_own")).otherwise(0)).over(before)
    first = F.call_function("div", F.col("__quillon_before"), F.lit(target).cast("long")) + F.coalesce(extra, F.lit(0))
    places = places.withColumn("__quillon_first", first + F.when(F.col("__quillon_own") > 1, 1).otherwise(0))
    places = cut_lineage(places)
    last = places.agg(F.max(F.col("__quillon_first") + F.col("__quillon_own"))).first()[0] or 1
    placed = celled.join(F.broadcast(places), names)
    turn = F.coalesce(F.pmod(F.col(key), F.col("__quillon_own")), F.lit(0))
    out = placed.withColumn("shard", (F.col("__quillon_first") + turn).cast("long")).select(*(F.col(f"`{c}`") for c in kept), "curve", "shard")
    parts = min(last, MAX_PARTITIONS)
    target_part = F.call_function("div", F.col("shard") * F.lit(parts).cast("long"), F.lit(last).cast("long")).cast("int")
    return out.repartitionById(parts, target_part).sortWithinPartitions("shard", "curve", key)


def write_shards(rows: DataFrame, path: str) -> None:
    """One Parquet file for each shard of `sharded` rows, under shard=<number>."""
    rows.write.partitionBy("shard").parquet(path)


#: The same rows in DuckDB: the curve by Skilling's algorithm over lists, five bits and three dimensions.
SQL = """
WITH RECURSIVE
shifted AS (SELECT *, n_chars - min(n_chars) OVER () AS v FROM documents),
levels AS (
  SELECT * EXCLUDE (v), CASE WHEN v = 0 THEN 0 ELSE l * 32 + ((v << greatest(5 - l, 0)::INT) >> greatest(l - 5, 0)::INT) - 32 + 1 END AS level
  FROM (SELECT *, CASE WHEN v > 0 THEN length(ltrim(bin(v), '0')) - 1 END AS l FROM shifted)
),
sources AS (SELECT source, 1 + coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 31 // sum(n) OVER () AS c FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source)),
langs AS (SELECT lang, 1 + coalesce(sum(n) OVER (ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 31 // sum(n) OVER () AS c FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)),
sizes AS (SELECT level, 1 + coalesce(sum(n) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 31 // sum(n) OVER () AS c FROM (SELECT level, count(*) AS n FROM levels WHERE level IS NOT NULL GROUP BY level)),
celled AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, coalesce(s.c, 0)::BIGINT AS c0, coalesce(l.c, 0)::BIGINT AS c1, coalesce(z.c, 0)::BIGINT AS c2
  FROM levels d LEFT JOIN sources s ON d.source = s.source LEFT JOIN langs l ON d.lang = l.lang LEFT JOIN sizes z ON d.level = z.level
),
cells AS (SELECT DISTINCT c0, c1, c2 FROM celled),
walk AS (
  SELECT c0, c1, c2, c0 AS x0, c1 AS x1, c2 AS x2, 16 AS q, 0 AS i FROM cells
  UNION ALL
  SELECT c0, c1, c2,
    CASE WHEN i = 0 THEN CASE WHEN x0 & q <> 0 THEN xor(x0, q - 1) ELSE x0 END
         WHEN i = 1 THEN CASE WHEN x1 & q <> 0 THEN xor(x0, q - 1) ELSE xor(x0, xor(x0, x1) & (q - 1)) END
         ELSE CASE WHEN x2 & q <> 0 THEN xor(x0, q - 1) ELSE xor(x0, xor(x0, x2) & (q - 1)) END END,
    CASE WHEN i = 1 AND x1 & q = 0 THEN xor(x1, xor(x0, x1) & (q - 1)) ELSE x1 END,
    CASE WHEN i = 2 AND x2 & q = 0 THEN xor(x2, xor(x0, x2) & (q - 1)) ELSE x2 END,
    CASE WHEN i = 2 THEN q // 2 ELSE q END, CASE WHEN i = 2 THEN 0 ELSE i + 1 END
  FROM walk WHERE q > 1
),
gray AS (SELECT c0, c1, c2, x0 AS y0, xor(x0, x1) AS y1, xor(xor(x0, x1), x2) AS y2 FROM walk WHERE q = 1),
turned AS (
  SELECT *, xor(xor(xor(CASE WHEN y2 & 16 <> 0 THEN 15 ELSE 0 END, CASE WHEN y2 & 8 <> 0 THEN 7 ELSE 0 END), CASE WHEN y2 & 4 <> 0 THEN 3 ELSE 0 END), CASE WHEN y2 & 2 <> 0 THEN 1 ELSE 0 END) AS t FROM gray
),
curves AS (
  SELECT c0, c1, c2, list_sum(list_transform([0, 1, 2, 3, 4], lambda b: (((xor(y0, t) >> b) & 1) * 4 + ((xor(y1, t) >> b) & 1) * 2 + ((xor(y2, t) >> b) & 1)) << (3 * b)))::BIGINT AS curve FROM turned
),
placed AS (SELECT d.*, u.curve FROM celled d JOIN curves u USING (c0, c1, c2)),
grid AS (SELECT curve, sum(coalesce(length(text), 0))::BIGINT AS chars FROM placed GROUP BY curve),
own AS (SELECT *, greatest((chars + 15999999) // 16000000, 1) AS own FROM grid),
firsts AS (
  SELECT curve, own, coalesce(sum(chars) OVER b, 0)::BIGINT // 16000000 + coalesce(sum(CASE WHEN own > 1 THEN own ELSE 0 END) OVER b, 0)::BIGINT + CASE WHEN own > 1 THEN 1 ELSE 0 END AS first
  FROM own WINDOW b AS (ORDER BY curve ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT doc_id, text, lang, source, n_chars, curve, (first + coalesce(doc_id % own, 0))::BIGINT AS shard FROM placed JOIN firsts USING (curve)
"""
