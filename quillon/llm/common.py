"""Shared pieces of the training-data operators: hashing of text in numpy, batching, row identity.

Texts reach Python as Arrow batches. Hashes are computed over the batch's UTF-8 buffer with
array operations, so that no Python object is made for a word or a line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))

_CLASS = np.zeros(256, bool)
_CLASS[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True
_SINGLE = np.zeros(256, bool)
_SINGLE[[*range(0xE3, 0xEE), *range(0xF0, 0xF5)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2**64, of an odd base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        made = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers = made[0], made[1]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) of a string array, in runs of about `limit` bytes; a longer text is a run of its own."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    edges = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + limit, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array, nulls as empty texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]; equal bytes have equal hashes wherever they stand."""
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the first word of each row (one more entry than rows).

    A word is a run of ASCII letters and digits and non-ASCII characters; each character from the
    CJK planes upwards is a word of its own. Words end at row ends.
    """
    word = _CLASS[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    single = _SINGLE[data]
    if single.any():
        begin |= single
        after = np.flatnonzero(single) + np.where(data[single] >= 0xF0, 4, 3)
        after = after[after < len(data)]
        begin[after] |= word[after]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begin[edge] |= word[edge]
    starts = np.flatnonzero(begin)
    stop = ~word
    stop[starts] = True
    stop[edge] = True
    stops = np.append(np.flatnonzero(stop), len(data))
    ends = stops[np.searchsorted(stops, starts, "right")]
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and the first word of each row."""
    data, offsets = raw(pc.utf8_lower(texts))
    starts, ends, first = word_spans(data, offsets)
    return spans_hash(data, starts, ends), first


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `width` words within rows; a row with fewer words has one shingle of all its words."""
    count = np.diff(first)
    made = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
    to = np.concatenate([[0], np.cumsum(made)])
    row = np.repeat(np.arange(len(count)), made)
    at = first[:-1][row] + np.arange(to[-1]) - to[:-1][row]
    padded = np.append(words, np.zeros(width, np.uint64))
    left = first[1:][row] - at
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        factor = np.uint64((_BASE * (2 * k + 3)) % (1 << 64) | 1)
        out += np.where(left > k, padded[at + k] * factor, np.uint64(k + 1))
    return mix(out), to


def one_row_per_id(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows with a null id go; of rows that share an id the one with the smallest text stays.

    The check for shared ids reads the id column alone; only where there are any is the table shuffled.
    """
    docs = docs.where(F.col(key).isNotNull())
    if not shared_ids(docs, key):
        return docs
    rank = Window.partitionBy(key).orderBy(F.col(text).asc_nulls_last(), *other_columns(docs, (key, text)))
    return docs.withColumn("__quillon_rank", F.row_number().over(rank)).where("__quillon_rank = 1").drop("__quillon_rank")


def shared_ids(docs: DataFrame, key: str = "doc_id") -> bool:
    """Whether any non-null id stands on more than one row."""
    return not docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty()


def kept_rows(docs: DataFrame, keep: Callable[[], Callable[[pa.Array], pa.Array]], text: str = "text") -> DataFrame:
    """The rows that the function made by `keep`, once a task, says yes to; columns as they were, names of any form."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = keep()
        for batch in batches:
            yield batch.filter(decide(as_array(batch.column(at))))

    schema = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(names, docs.schema, strict=True)])
    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns)


def other_columns(docs: DataFrame, taken: tuple[str, ...]) -> list:
    """The remaining columns as strings, for a total order of rows."""
    return [F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) for c in docs.columns if c not in taken]


def code_points(texts: pa.Array) -> tuple[str, np.ndarray, np.ndarray]:
    """All rows as one string, its code points, and the row offsets in characters; nulls as empty texts."""
    data, offsets = raw(texts)
    joined = data.tobytes().decode()
    if len(joined) == len(data):
        return joined, data.astype(np.uint32), offsets
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return joined, np.frombuffer(joined.encode("utf-32-le"), np.uint32), chars[offsets]


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each length, one after the other."""
    to = np.cumsum(lengths)
    return np.arange(to[-1] if len(to) else 0) + np.repeat(starts - to + lengths, lengths)
