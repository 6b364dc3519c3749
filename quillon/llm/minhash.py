"""Near-duplicate grouping by MinHash with tensored banding.

Plain banding with L tables of K minhashes computes L*K minhashes a document. Here two smaller
collections of `m` bands of K/2 minhashes are computed, and every pair (one band of each) is a
table key: L = m*m tables for 2*m*K/2 = sqrt(L)*K minhashes. With the defaults, 81 tables of four
minhashes take 36 minhashes instead of 324. Two documents of Jaccard similarity s share a key with
probability (1-(1-s^2)^m)^2: 0.92 at the threshold 0.55, 0.99 at 0.65, above 0.999 at 0.75.

The threshold lies in the gap between near copies and other pairs: one edited word changes three
shingles, so that copies with a tenth of their words edited have a similarity of about 0.6.

Every candidate group is verified with exact Jaccard similarity over all word shingles.
No bucket, partner or candidate is capped. A bucket's least document comes from an aggregation with
map-side combining and is joined back, so that no bucket is gathered in one task and a hot one can be
split. Nothing is broadcast. Documents are linked in rounds, each of which leaves
to the next only pairs that are not yet in one group, so that a group of n copies costs about n
verifications and not n*n/2:

1. each document against the least document that it shares any bucket with;
2. each document against the least document of each of its buckets;
3. within each bucket all remaining pairs across groups.

Every pair of documents that shares a table key is thus verified or already in one group, and the
groups equal those of verifying all candidate pairs.

Defined results: a null id takes no part; of rows that share an id the one with the smallest text
stands for it; a text that is null or without words is in a group of its own; texts of the same
shingles (equal texts, or texts that differ in case, punctuation and repetitions) are one group at
once; a text with fewer words than the shingle has one shingle. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import as_array, mix, one_row_per_id, shared_ids, shingles, slices, word_hashes
from quillon.llm.components import forest_roots, merged_roots
from quillon.session import Scratch

THRESHOLD = 0.55
BANDS = 9
ROWS = 2
WIDTH = 3
SEED = 20_240_229


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def band_hashes(items: np.ndarray, to: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """2*bands hashes a document, each of `rows` minhashes: the two collections, one after the other."""
    a, b = _coefficients(2 * bands * rows)
    full = np.flatnonzero(np.diff(to))
    out = np.zeros((2 * bands, len(to) - 1), np.uint64)
    if len(full):
        at = to[:-1][full]
        for k in range(2 * bands * rows):
            x = items * a[k]
            x += b[k]
            least = np.minimum.reduceat(x, at)
            out[k // rows, full] = mix(out[k // rows, full] * np.uint64(31) + least)
    return out


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """(id, n, f1, f2, u0.., v0..): shingle count, fingerprint of the shingle set and the two collections."""
    names = [*(f"u{i}" for i in range(bands)), *(f"v{i}" for i in range(bands))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(as_array(batch.column(1))):
                words, first = word_hashes(part)
                items, to = shingles(words, first, width)
                items, to = _distinct(items, to)
                sums = [_sums(x, to) for x in (items, mix(items ^ np.uint64(0x5851F42D4C957F2D)))]
                columns = [batch.column(0).slice(at, len(part)), pa.array(np.diff(to).astype(np.int64))]
                columns += [pa.array(x.view(np.int64)) for x in (*sums, *band_hashes(items, to, bands, rows))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "f1", "f2", *names])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, n long, f1 long, f2 long, " + ", ".join(f"{x} long" for x in names))


def _distinct(items: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct items of each row, in ascending order."""
    row = np.repeat(np.arange(len(to) - 1), np.diff(to))
    order = np.lexsort((items, row)) if len(to) > 2 else np.argsort(items)
    items = items[order]
    new = np.ones(len(items), bool)
    new[1:] = (items[1:] != items[:-1]) | (row[1:] != row[:-1])
    return items[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(to) - 1))]).astype(np.int64)


def _sums(items: np.ndarray, to: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(items)])
    return total[to[1:]] - total[to[:-1]]


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, items): the distinct shingles of each document as sorted 32-bit numbers, in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(as_array(batch.column(1))):
                words, first = word_hashes(part)
                items, to = shingles(words, first, width)
                items, to = _distinct(items >> np.uint64(32), to)
                items = items.astype(np.uint32)
                made = [items[i:j].tobytes() for i, j in zip(to[:-1], to[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(made, pa.binary())], ["id", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, items binary")


def jaccard(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similar) of document pairs (a, b) by the exact similarity of their shingle sets (id, items)."""
    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")).hint("merge"), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")).hint("merge"), "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                if min(len(p), len(q)) < threshold * max(len(p), len(q)) - 1e-9:
                    continue
                joint = np.concatenate([p, q])
                joint.sort(kind="stable")
                common = int(np.count_nonzero(joint[1:] == joint[:-1]))
                out[k] = len(joint) > 0 and common >= threshold * (len(joint) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["a", "b", "similar"])

    return both.mapInArrow(run, "a long, b long, similar boolean")


def near_duplicate_groups(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """(doc_id, group_id, group_size, kept) for every document with an id; group_id is the least id of its group, which is kept."""
    grouped = _grouped(one_row_per_id(docs.select("doc_id", "text")), threshold, bands, rows, width)
    sizes = grouped.groupBy("group_id").agg(F.count("*").alias("group_size")).hint("merge")
    return grouped.join(sizes, "group_id").select(F.col("id").alias("doc_id"), "group_id", "group_size", (F.col("id") == F.col("group_id")).alias("kept"))


def _grouped(docs: DataFrame, threshold: float, bands: int, rows: int, width: int) -> DataFrame:
    """(id, group_id) of `docs`, which has one row an id."""
    scratch = Scratch(docs.sparkSession)
    sketched = scratch.keep(sketch(docs, bands, rows, width), "sketch")
    signature = [*(f"u{i}" for i in range(bands)), *(f"v{i}" for i in range(bands))]
    worded = sketched.where("n > 0")
    distinct = scratch.keep(worded.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), *(F.first(x).alias(x) for x in signature)), "distinct")
    tables = F.array(*(F.xxhash64(F.lit(i * bands + j), f"u{i}", f"v{j}") for i in range(bands) for j in range(bands)))
    keys = distinct.select("rep", F.explode(tables).alias("key"))
    pivots = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("last > pivot").select("key", "pivot")
    buckets = scratch.keep(keys.join(pivots.hint("merge"), "key").where("rep > pivot").select("key", "rep", "pivot"), "buckets")
    nearest = buckets.groupBy("rep").agg(F.min("pivot").alias("a")).select("a", F.col("rep").alias("b"))
    ids = buckets.select(F.col("rep").alias("id")).union(buckets.select("pivot")).distinct()
    sets = scratch.keep(shingle_sets(docs.join(ids.hint("merge"), docs.doc_id == ids.id, "left_semi"), width), "sets")
    first = scratch.keep(jaccard(nearest, sets, threshold), "first")
    roots = scratch.keep(forest_roots(first.where("similar").select("a", "b")), "roots")
    stars = buckets.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    for step in (2, 3):
        if step == 2:
            pairs = _apart(stars, roots).join(first.where("not similar").select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        else:
            pairs = _across(buckets, roots).join(stars.hint("merge"), ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs, "pairs")
        if not pairs.isEmpty():
            more = scratch.keep(jaccard(pairs, sets, threshold).where("similar").select("a", "b"), "more")
            if not more.isEmpty():
                roots = scratch.keep(merged_roots(roots, more), "roots")
        scratch.drop(pairs)
    scratch.drop(sets, buckets, first)
    members = worded.select("id", "f1", "f2", "n").join(distinct.select("f1", "f2", "n", "rep").hint("merge"), ["f1", "f2", "n"])
    grouped = members.join(roots.hint("merge"), members.rep == roots.node, "left").select("id", F.coalesce("root", "rep").alias("group_id"))
    grouped = scratch.keep(grouped.union(sketched.where("n = 0").select("id", F.col("id").alias("group_id"))), "grouped")
    scratch.drop(sketched, distinct, roots)
    return grouped


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that aren't in one group so far."""
    ra, rb = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")).hint("merge") for x in "ab")
    return pairs.join(ra, "a", "left").join(rb, "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")


def _across(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """All pairs of a bucket whose members aren't in one group."""
    of = roots.select(F.col("node").alias("rep"), "root").hint("merge")
    member = buckets.select("key", "rep").union(buckets.select("key", "pivot").distinct())
    member = member.join(of, "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    split = member.groupBy("key").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p <> q").select("key")
    left = member.join(split.hint("merge"), "key", "left_semi")
    x, y = (left.select("key", F.col("rep").alias(a), F.col("root").alias(f"r{a}")) for a in "ab")
    return x.join(y.hint("merge"), "key").where("a < b and ra <> rb").select("a", "b").distinct()


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """The documents without those that are near copies of one with a lesser id; columns as they were.

    Rows with a null id stay. Of rows that share id and text one stays; rows that share an id but not the text stay or go together.
    """
    known = docs.where("doc_id is not null")
    if shared_ids(docs):
        known = known.dropDuplicates(["doc_id", "text"])
    grouped = _grouped(one_row_per_id(docs.select("doc_id", "text")), threshold, bands, rows, width)
    gone = grouped.where("id <> group_id").select(F.col("id").alias("__quillon_gone")).hint("merge")
    kept = known.join(gone, known.doc_id == F.col("__quillon_gone"), "left_anti")
    return kept.unionByName(docs.where("doc_id is null"))
