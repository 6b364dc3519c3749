"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel edit distance.

A test item of m characters may differ in k = floor(RATE * m) insertions, deletions and
substitutions. Cut into k + 1 pieces, one piece at least survives k edits unchanged. So all
pieces of all items go into one Aho-Corasick automaton, documents are scanned once for exact piece
hits, and only the surroundings of hits (k characters to either side of where the item would lie)
are verified, with the distance of the item to its best place there. The result is exact: every
item that lies in a document within its budget is found with its least distance.

Items and documents are compared in a normal form: lower case, runs of ASCII characters that are
neither letters nor digits as one space. Budgets and distances count its characters.

The items are sent to the workers in chunks of at most CHUNK_CHARS characters, so that the automaton of a worker is
bounded however large the benchmark (some 100 bytes a character). A larger benchmark takes one scan of the documents for each chunk, one
after the other, and what a scan leaves is written to the shared folder: no worker holds two automata at once.

Defined results: null ids, null or empty texts and items without letters or digits match nothing; a
document is reported once for each item that it holds, with the least distance over all its places
and all rows that share its id; items that share an id count as one item, the nearest of its texts; an item of fewer than 1 / RATE characters must be
held exactly. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import as_array, kept_rows, raw, slices
from quillon.session import Scratch

RATE = 0.08
CHUNK_CHARS = 1_000_000

_FORM = np.full(256, 32, np.uint8)
_FORM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]


def normal_forms(texts: pa.Array) -> list[str]:
    """The normal form of each text."""
    data, offsets = raw(pc.utf8_lower(texts))
    data = _FORM[data]
    keep = data != 32
    keep[1:] |= keep[:-1]
    inner = offsets[1:-1][offsets[1:-1] < len(data)]
    keep[inner] = data[inner] != 32
    to = np.concatenate([[0], np.cumsum(keep)])[offsets]
    joined = data[keep].tobytes()
    return [joined[i:j].decode().strip() for i, j in zip(to[:-1], to[1:], strict=True)]


def best_distance(pattern: str, text: str, masks: dict[str, int]) -> int:
    """The least edit distance between the pattern and any part of the text (Myers 1999, on Python's long integers)."""
    m = len(pattern)
    top, every = 1 << (m - 1), (1 << m) - 1
    up, down, score, best = every, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        x = eq | down
        d0 = (((eq & up) + up) ^ up) | x
        plus = down | (every & ~(d0 | up))
        minus = up & d0
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    break
        plus <<= 1
        up = ((minus << 1) | ~(d0 | plus)) & every
        down = plus & d0 & every
    return best


class Matcher:
    """Finds all items within their budgets in normal forms."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE) -> None:
        self.items = [(i, x, int(rate * len(x) + 1e-9), _masks(x)) for i, x in items if x]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, x, k, _) in enumerate(self.items):
            cut = [len(x) * j // (k + 1) for j in range(k + 2)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                pieces.setdefault(x[i:j], []).append((n, j))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """item id: least distance, for the items within their budgets."""
        out: dict[int, int] = {}
        if not self.items or not text:
            return out
        starts: dict[int, list[int]] = {}
        for end, places in self.automaton.iter(text):
            for n, to in places:
                starts.setdefault(n, []).append(end + 1 - to)
        for n, found in starts.items():
            item, x, k, masks = self.items[n]
            if out.get(item) == 0:
                continue
            best, low, high = len(x), None, 0
            if x in text:
                best = 0
            else:
                for at in [*sorted(found), None]:
                    if low is not None and (at is None or at - k > high):
                        best = min(best, best_distance(x, text[max(0, low) : high], masks))
                        low = None
                    if at is not None:
                        low, high = at - k if low is None else low, at + len(x) + k
            if best <= k:
                out[item] = min(best, out.get(item, best))
        return out


def _masks(x: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(x):
        out[c] = out.get(c, 0) | 1 << k
    return out


def _chunks(items: DataFrame, size: int) -> Iterator[list[tuple[int, str]]]:
    """The items in normal form, in chunks of about `size` characters; at least one chunk."""
    items = items.where("item_id is not null and text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = total // size + 1
    for c in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == c).collect()
        forms = normal_forms(pa.array([r.text for r in rows], pa.string()))
        yield sorted({(r.item_id, x) for r, x in zip(rows, forms, strict=True) if x})


def contaminations(docs: DataFrame, items: DataFrame, rate: float = RATE, size: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance) for each item that lies in a document within its budget."""
    scratch, parts = Scratch(docs.sparkSession), []
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    for chunk in _chunks(items, size):
        if parts:
            parts[-1] = scratch.keep(parts[-1], "found")
        parts.append(_found(docs, chunk, rate))
    return reduce(DataFrame.union, parts).groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def _found(docs: DataFrame, chunk: list[tuple[int, str]], rate: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, rate)
        for batch in batches:
            ids, hits = batch.column(0), ([], [], [])
            for at, part in slices(as_array(batch.column(1))):
                for k, text in enumerate(normal_forms(part), at):
                    for item, distance in matcher.find(text).items():
                        for column, x in zip(hits, (k, item, distance), strict=True):
                            column.append(x)
            columns = [ids.take(pa.array(hits[0], pa.int64())), pa.array(hits[1], pa.int64()), pa.array(hits[2], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "distance"])

    return docs.mapInArrow(run, "doc_id long, item_id long, distance int")


def without_contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, size: int = CHUNK_CHARS) -> DataFrame:
    """The documents that hold no item within its budget, columns as they were; decided row by row, without a shuffle."""
    scratch, names, first = Scratch(docs.sparkSession), docs.columns, True
    for chunk in _chunks(items, size):
        if not first:
            # odd or clashing column names don't matter to a table of numbered columns
            docs = scratch.keep(docs.toDF(*(f"c{k}" for k in range(len(names)))), "left").toDF(*names)
        first = False
        sent = docs.sparkSession.sparkContext.broadcast(chunk)

        def clean(sent=sent):  # noqa: ANN001, ANN202
            matcher = Matcher(sent.value, rate)
            return lambda texts: pa.array([not matcher.find(x) for _, part in slices(texts) for x in normal_forms(part)], pa.bool_())

        docs = kept_rows(docs, clean)
    return docs
