"""Line deduplication by pairwise alignment.

Documents overlap where they share the hash of a line, or of a passage. Passages carry what lines can't: common text in the
middle of a longer or an edited line, or over several short ones. Of the hashes of all runs of RUN words those are
selected that are least in any RUN consecutive ones (winnowing), so that two documents with a common run of
2 * RUN - 1 words have a selected hash in common. Lines and runs are compared as sequences of words: punctuation and
white space between words don't count, case does.

A line is rare where RARE documents at most hold it, whatever its length. A rare line pairs each document that holds it with
every earlier one (of lesser id) that does: RARE - 1 pairs a document at most. A line that more documents hold, and a run, pair
each document with the earliest holder alone. This is exact for them: what any earlier document holds of such a hash, the
earliest holder holds, too. So no group of copies is expanded into pairs, and none is left out for its size. The earliest
holder comes from an aggregation with map-side combining that is joined back, so that no hash is gathered in one task.

Each pair is aligned by patience: common lines and runs that continue each other in both documents are one block, the blocks
that rise in both documents are aligned along the longest such sequence, and what it leaves (moved or repeated blocks) is aligned
block by block. A block is then extended at both ends, word by word as long as the two documents agree, by RUN - 1
words at most, and goes from the later document if it has BLOCK words at least. So of a line that is common by chance (a word
or two) nothing goes, while a run of 2 * RUN - 1 words, or a line of BLOCK words, that any earlier document holds never stays whole.
Earlier documents count with their whole text.

What follows a cut word on its line, up to the next word, goes with it; a line of which no word is left goes. The kept lines
are rejoined unchanged, and a document that loses nothing keeps its exact text.

Whole texts are shuffled twice, once to look up the surroundings of blocks and once to cut; all else are hashes and places.

Defined results: rows with a null id take no part and (in the pipeline) stay as they are; rows that
share an id are one document, for which the smallest text stands (in the pipeline further texts of the same id stay as they are,
and of rows that share both one stays); null and empty texts and texts without words share nothing
and stay; equal texts of BLOCK words or more: the earliest stays, the rest are left empty; repeats within one document
stay unless an earlier document holds them. Empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import as_array, mix, one_row_per_id, powers, raw, shared_ids, slices, spans_hash, word_spans
from quillon.session import Scratch

RARE = 8
BLOCK = 8
RUN = 25

_LINE = np.uint64(0xA0761D6478BD642F)


def run_hashes(words: np.ndarray, run: int = RUN) -> np.ndarray:
    """Hashes of all runs of `run` words."""
    n = len(words)
    return sequence_hashes(words, np.arange(n + 1 - run), np.arange(run, n + 1)) if n >= run else np.zeros(0, np.uint64)


def sequence_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words[start:end]; equal sequences have equal hashes wherever they stand."""
    power, inverse = powers(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[: len(words)])])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def _least(x: np.ndarray, window: int) -> np.ndarray:
    """The least of each `window` consecutive values."""
    done = 1
    while done < window:
        step = min(done, window - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def selected(hashes: np.ndarray, valid: np.ndarray, window: int = RUN) -> np.ndarray:
    """The places of the valid hashes that are the least of any `window` consecutive ones."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    x = np.full(len(hashes) + 2 * (window - 1), top)
    x[window - 1 : window - 1 + len(hashes)] = np.where(valid, hashes, top)
    return np.flatnonzero(valid & (~_least(~_least(x, window), window) == hashes)) if len(hashes) else np.zeros(0, np.int64)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit hashes of the words of all rows, the first word of each row, and the first word of each line."""
    data, offsets = raw(texts)
    starts, ends, first = word_spans(data, offsets)
    line = np.union1d(np.searchsorted(starts, np.flatnonzero(data == 10)), first[:-1])
    return spans_hash(data, starts, ends) >> np.uint64(32), first, line[line < len(starts)]


def prints_of(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(id, print, at, n, new): the hash of each line and selected run of a document, the word where it begins, its words (0 for a run), and whether it is the first of its kind in the document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = as_array(batch.column(0)).to_numpy(zero_copy_only=False)
            for at, part in slices(as_array(batch.column(1))):
                words, first, line = _words(part)
                hashes = run_hashes(words, run)
                # run - 1 invalid places at least stand between two rows, so that no window sees valid ones of both
                stop = np.repeat(first[1:], np.diff(first))[: len(hashes)]
                runs = selected(hashes, np.arange(len(hashes)) + run <= stop, run)
                ends = np.append(line[1:], len(words))
                prints = np.concatenate([hashes[runs], sequence_hashes(words, line, ends) ^ _LINE])
                place, n = np.concatenate([runs, line]), np.concatenate([np.zeros(len(runs), np.int64), ends - line])
                row = np.searchsorted(first, place, "right") - 1
                order = np.lexsort((place, prints, row))
                prints, place, n, row = prints[order], place[order], n[order], row[order]
                new = np.ones(len(row), bool)
                new[1:] = (prints[1:] != prints[:-1]) | (row[1:] != row[:-1])
                columns = [ids[at + row], prints.view(np.int64), (place - first[row]).astype(np.int32), n.astype(np.int32), new]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "print", "at", "n", "new"])

    return docs.select("doc_id", "text").mapInArrow(make, "id long, print long, at int, n int, new boolean")


def shared_prints(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(id, print, at, n, new, a, q, df): the prints of each document that an earlier one holds, with the earliest holder, its place there, and the number of holders."""
    prints = prints_of(docs, run)
    held = prints.where("new").groupBy("print").agg(F.count("*").alias("df"), F.min("id").alias("a"), F.min_by("at", "id").alias("q")).where("df > 1")
    return prints.join(held.hint("merge"), "print").where("id > a")


def matches(shared: DataFrame, rare: int = RARE) -> DataFrame:
    """(b, a, at, q, n, rare): equal lines and runs of the pairs (b, a) that are to be aligned."""
    own = shared.select(F.col("id").alias("b"), "a", "at", "q", "n", (F.col("n") > 0) & (F.col("df") <= rare))
    # the further holders of a rare line; each has been compared with the earliest already
    few = shared.where((F.col("n") > 0) & F.col("df").between(3, rare))
    x, y = few.where("new").select("print", F.col("id").alias("a"), F.col("at").alias("q")), few.select("print", F.col("id").alias("b"), "at", "n")
    return own.toDF("b", "a", "at", "q", "n", "rare").union(x.join(y.hint("merge"), "print").where("a < b").select("b", "a", "at", "q", "n", F.lit(True)))


def _rising(pairs: list[tuple[int, int]]) -> list[int]:
    """The longest subsequence, by index, of pairs ascending in the first, that ascends in the second."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        i = bisect_left(tails, y)
        before[k] = at[i - 1] if i else -1
        tails[i : i + 1] = [y]
        at[i : i + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def joined(pair: np.ndarray, at: np.ndarray, q: np.ndarray, n: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of matches that continue each other in both documents of a pair: (pair, start, end, start in the other, rare)."""
    order = np.lexsort((at, at - q, pair))
    pair, at, q, n, rare = pair[order], at[order], q[order], n[order], rare[order]
    if not len(pair):
        return pair, at, at, q, rare
    turn = np.ones(len(pair), bool)
    turn[1:] = (pair[1:] != pair[:-1]) | ((at - q)[1:] != (at - q)[:-1])
    reach = (np.cumsum(turn) - 1) * (1 << 40) + at + n
    reach = np.maximum.accumulate(reach)
    turn[1:] |= at[1:] > (reach[:-1] & ((1 << 40) - 1))
    first = np.flatnonzero(turn)
    last = np.append(first[1:], len(pair)) - 1
    return pair[first], at[first], reach[last] & ((1 << 40) - 1), q[first], np.logical_or.reduceat(rare, first)


def patience(blocks: list[tuple[int, int]]) -> list[bool]:
    """Whether each block (start, start in the other document) of one pair is on the longest sequence of blocks that rises in both documents."""
    order = sorted(range(len(blocks)), key=lambda k: (blocks[k][0], -blocks[k][1]))
    out = [False] * len(blocks)
    for k in _rising([blocks[k] for k in order]):
        out[order[k]] = True
    return out


def aligned(pair: np.ndarray, start: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each block is aligned in order; the others are moved or repeated and stand by themselves."""
    out = np.ones(len(pair), bool)
    order = np.lexsort((other, start, pair))
    p, s, o = pair[order], start[order], other[order]
    falls = (p[1:] == p[:-1]) & ((s[1:] == s[:-1]) | (o[1:] <= o[:-1]))
    for k in np.unique(p[1:][falls]):  # all other pairs rise in both documents as they are
        own = order[np.searchsorted(p, k) : np.searchsorted(p, k, "right")]
        out[own] = patience(list(zip(start[own].tolist(), other[own].tolist(), strict=True)))
    return out


def blocks_of(found: DataFrame, run: int = RUN, least: int = BLOCK) -> DataFrame:
    """(b, k, start, end, a, q): the common blocks of aligned pairs, numbered, as words of b and where they begin in a; those too short to go without an extension only with a rare line."""
    lists = found.groupBy("b").agg(*(F.collect_list(c).alias(c) for c in ("a", "at", "q", "n", "rare")))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(as_array(batch.column(1)).offsets.to_numpy())
            a, at, q, n, rare = (as_array(batch.column(k)).flatten().to_numpy(zero_copy_only=False) for k in range(1, 6))
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((a, row))
            turn = np.ones(len(row), bool)
            turn[1:] = (row[order][1:] != row[order][:-1]) | (a[order][1:] != a[order][:-1])
            number = np.cumsum(turn) - 1
            head = order[turn]
            n = np.where(n > 0, n, run).astype(np.int64)
            pair, start, end, other, rare = joined(number, at[order].astype(np.int64), q[order].astype(np.int64), n[order], rare[order])
            good = (end - start >= least) | rare
            pair, start, end, other = pair[good], start[good], end[good], other[good]
            by = np.lexsort((start, ~aligned(pair, start, other), row[head][pair]))
            pair, start, end, other = pair[by], start[by], end[by], other[by]
            of = row[head][pair]
            k = np.arange(len(of)) - np.searchsorted(of, of)
            columns = [batch.column(0).take(pa.array(of)), *(pa.array(x.astype(np.int32)) for x in (k, start, end)), pa.array(a[head][pair]), pa.array(other.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["b", "k", "start", "end", "a", "q"])

    return lists.mapInArrow(make, "b long, k int, start int, end int, a long, q int")


def surroundings(ends: DataFrame, docs: DataFrame, size: int = RUN - 1) -> DataFrame:
    """(a, q, left, words): for each end (a, q, left) of a block, the `size` words before it or from it on, as 32-bit hashes."""
    asked = ends.groupBy("a").agg(F.collect_list("q").alias("q"), F.collect_list("left").alias("left"))
    both = docs.select("doc_id", "text").join(asked.hint("shuffle_hash"), docs.doc_id == asked.a).select("a", "text", "q", "left")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(as_array(batch.column(1))):
                words, first, _ = _words(part)
                words = words.astype(np.uint32)
                asked = [as_array(batch.column(k)).slice(at, len(part)) for k in (2, 3)]
                sizes = np.diff(asked[0].offsets.to_numpy())
                q, left = (x.flatten().to_numpy(zero_copy_only=False) for x in asked)
                row = np.repeat(np.arange(len(part)), sizes)
                place = first[row] + q
                low, high = np.where(left, np.maximum(place - size, first[row]), place), np.where(left, place, np.minimum(place + size, first[row + 1]))
                made = [words[i:j].tobytes() for i, j in zip(low.tolist(), high.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + row)), pa.array(q), pa.array(left), pa.array(made, pa.binary())], ["a", "q", "left", "words"])

    return both.mapInArrow(make, "a long, q int, left boolean, words binary")


@dataclass
class Ends:
    """The ends of blocks, one after the other: the row of the text, the block's number in it, its words, which end, and the other document's words there."""

    row: np.ndarray
    k: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    words: pa.Array


def _agreement(words: np.ndarray, first: np.ndarray, e: Ends) -> np.ndarray:
    """How many words before a beginning, or from an end on, agree with the other document's."""
    to = np.frombuffer(e.words.buffers()[1], np.int32)[e.words.offset : e.words.offset + len(e.words) + 1].astype(np.int64) // 4
    data = e.words.buffers()[2]
    other = np.frombuffer(data, np.uint32, len(data) // 4) if data is not None and len(data) >= 4 else np.zeros(0, np.uint32)
    n = np.diff(to)
    at = first[e.row] + np.where(e.left, e.start - 1, e.end)
    room = np.where(e.left, e.start, first[e.row + 1] - at)
    n = np.minimum(n, room)
    j = np.arange(int(n.max()) if len(n) else 0)[None, :]
    valid = j < n[:, None]
    step = np.where(e.left, -1, 1)[:, None]
    mine = np.where(valid, at[:, None] + step * j, 0)
    theirs = np.where(valid, np.where(e.left, to[1:] - 1, to[:-1])[:, None] + step * j, 0)
    equal = valid.copy()
    equal[valid] = words[mine[valid]] == other[theirs[valid]]
    return np.cumprod(equal, axis=1, dtype=np.int8).sum(axis=1)


def cut(texts: pa.Array, e: Ends, least: int = BLOCK) -> tuple[pa.Array, np.ndarray]:
    """The texts without their blocks, each extended as far as both documents agree, and the number of lines that lost any words."""
    data, offsets = raw(texts)
    starts, ends, first = word_spans(data, offsets)
    words = (spans_hash(data, starts, ends) >> np.uint64(32)).astype(np.uint32)
    reach = _agreement(words, first, e)
    order = np.lexsort((~e.left, e.k, e.row))
    a, b = order[::2], order[1::2]  # each block has two ends
    low, high = e.start[a] - reach[a], e.end[b] + reach[b]
    good = high - low >= least
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, first[e.row[a]][good] + low[good], 1)
    np.add.at(gone, first[e.row[a]][good] + high[good], -1)
    return without_words(data, offsets, starts, ends, np.cumsum(gone)[:-1] > 0)


def without_words(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The rows without the words marked as gone, and the number of lines of each that lost any."""
    rows, size = len(offsets) - 1, len(data)
    line_end = np.sort(np.concatenate([np.flatnonzero(data == 10), offsets[1:]]), kind="stable")
    line = np.searchsorted(line_end, starts, "right")
    to = np.minimum(np.append(starts[1:], size)[: len(starts)], line_end[np.minimum(line, len(line_end) - 1)]) if len(starts) else ends
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts[gone], 1)
    np.add.at(change, to[gone], -1)
    lost = np.unique(line[gone])
    row_of = np.searchsorted(offsets, line_end[lost], "left") - 1  # a line with words ends after its row's beginning
    whole = lost[np.bincount(line, gone, len(line_end))[lost] == np.bincount(line, minlength=len(line_end))[lost]]
    row = np.searchsorted(offsets, line_end[whole], "left") - 1
    before = np.where(whole > 0, line_end[whole - 1], -1)
    inner = (before >= offsets[row]) & (data[np.clip(before, 0, max(size - 1, 0))] == 10) if size else before >= 0
    begin = np.where(inner, before + 1, offsets[row])
    stop = np.minimum(line_end[whole] + 1, offsets[row + 1])
    np.add.at(change, begin, 1)
    np.add.at(change, stop, -1)
    keep = np.cumsum(change)[:-1] == 0
    # a text whose last line went doesn't end with the line end before it
    last = row[line_end[whole] == offsets[row + 1]]
    kept = np.flatnonzero(keep)
    if len(kept) and len(last):
        at = np.searchsorted(kept, offsets[last + 1]) - 1
        at = kept[at[at >= 0]][kept[at[at >= 0]] >= offsets[last[at >= 0]]]
        keep[at[data[at] == 10]] = False
    to = np.concatenate([[0], np.cumsum(keep)])[offsets].astype(np.int64)
    made = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(to.tobytes()), pa.py_buffer(data[keep].tobytes()))
    return made.cast(pa.string()), np.bincount(row_of, minlength=rows).astype(np.int32)


_FOUND = ("k", "start", "end", "left", "words")


def cuts_of(docs: DataFrame, rare: int = RARE, least: int = BLOCK, run: int = RUN) -> DataFrame:
    """(id, k, start, end, left, words): lists of the ends of the blocks of each document that any are found in, with the earlier document's words there; `docs` has one row an id."""
    scratch = Scratch(docs.sparkSession)
    shared = scratch.keep(shared_prints(docs, run), "shared")
    blocks = scratch.keep(blocks_of(matches(shared, rare), run, least), "blocks")
    scratch.drop(shared)
    sides = F.explode(F.array(F.struct(F.col("q"), F.lit(True).alias("left")), F.struct((F.col("q") + F.col("end") - F.col("start")).alias("q"), F.lit(False).alias("left"))))
    ends = blocks.select("b", "k", "start", "end", "a", sides.alias("x")).select("b", "k", "start", "end", "a", "x.q", "x.left")
    around = scratch.keep(surroundings(ends.select("a", "q", "left").distinct(), docs, run - 1), "surroundings")
    lists = ends.join(around.hint("merge"), ["a", "q", "left"]).groupBy(F.col("b").alias("id")).agg(*(F.collect_list(c).alias(c) for c in _FOUND))
    cuts = scratch.keep(lists, "cuts")
    scratch.drop(blocks, around)
    return cuts


def _applied(joined: DataFrame, least: int) -> DataFrame:
    """The rows (doc_id, text, the lists of cuts, others), with the blocks cut: (doc_id, text, lines_removed, others)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lost = as_array(batch.column(1)), np.zeros(batch.num_rows, np.int32)
            touched = as_array(batch.column(2)).is_valid()
            some = np.flatnonzero(touched.to_numpy(zero_copy_only=False))
            if len(some):
                lists = [as_array(batch.column(k)).take(pa.array(some)) for k in range(2, 7)]
                to = lists[0].offsets.to_numpy()
                flat = [x.flatten() for x in lists]
                k, start, end, left = (x.to_numpy(zero_copy_only=False) for x in flat[:4])
                made = []
                for at, part in slices(text.take(pa.array(some))):
                    i, j = to[at] - to[0], to[at + len(part)] - to[0]
                    row = np.repeat(np.arange(len(part)), np.diff(to[at : at + len(part) + 1]))
                    new, n = cut(part, Ends(row, k[i:j], start[i:j].astype(np.int64), end[i:j].astype(np.int64), left[i:j], flat[4][i:j]), least)
                    made.append(new)
                    lost[some[at : at + len(part)]] = n
                text = pc.replace_with_mask(text, touched, pa.concat_arrays(made))
            yield pa.RecordBatch.from_arrays([batch.column(0), text, pa.array(lost), *batch.columns[7:]], ["doc_id", "text", "lines_removed", *batch.schema.names[7:]])

    return joined.mapInArrow(make, "doc_id long, text string, lines_removed int" + (", others " + joined.schema["others"].dataType.simpleString() if "others" in joined.columns else ""))


def deduplicated(docs: DataFrame, rare: int = RARE, least: int = BLOCK, run: int = RUN) -> DataFrame:
    """(doc_id, text, lines_removed) of every document with an id, without the blocks that earlier documents hold.

    lines_removed counts the lines that went, whole or in part.
    """
    docs = one_row_per_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    cuts = cuts_of(docs, rare, least, run)
    both = docs.join(cuts.hint("shuffle_hash"), docs.doc_id == cuts.id, "left").select("doc_id", "text", *_FOUND)
    return _applied(both, least)


def without_shared_lines(docs: DataFrame, rare: int = RARE, least: int = BLOCK, run: int = RUN) -> DataFrame:
    """The documents with shared blocks cut and n_chars, where there is such a column, renewed for those that lost any.

    A document of which nothing but white space is left after a cut goes; all others stay.
    """
    known = docs.where("doc_id is not null")
    more = None
    if shared_ids(docs):
        first = one_row_per_id(docs)
        more = known.dropDuplicates(["doc_id", "text"]).join(first.select(F.col("doc_id").alias("__quillon_id"), F.col("text").alias("__quillon_text")).hint("merge"), (F.col("doc_id") == F.col("__quillon_id")) & F.col("text").eqNullSafe(F.col("__quillon_text")), "left_anti")
        known = first
    cuts = cuts_of(known.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rare, least, run)
    names = [f"c{k}" for k in range(len(docs.columns))]
    others = F.struct(*(F.col(n) for n in names))
    both = known.toDF(*names)
    key, text = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    both = both.join(cuts.hint("shuffle_hash"), both[key] == cuts.id, "left").select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *_FOUND, others.withField(text, F.lit(None).cast("string")).alias("others"))
    done = _applied(both, least)
    touched = F.col("lines_removed") > 0
    done = done.where(~touched | (F.length(F.regexp_replace("text", r"\s+", "")) > 0))
    columns = []
    for name, c in zip(names, docs.columns, strict=True):
        column = F.col(f"others.{name}")
        if c == "text":
            column = F.col("text")
        elif c == "n_chars":
            column = F.when(touched, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(column)
        columns.append(column)
    out = done.select(*(x.alias(n) for x, n in zip(columns, names, strict=True))).toDF(*docs.columns)
    for rest in (more, docs.where("doc_id is null")):
        if rest is not None:
            out = out.unionByName(rest)
    return out
