"""Line dedup against comparing all words of all pairs of documents."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession

from quillon.llm import linededup
from quillon.llm.common import raw, word_spans

DOCS = "doc_id long, text string"


def _words(text: str) -> list[str]:
    return re.findall(r"[0-9A-Za-z]+", text)


def _equal_runs(b: list[str], a: list[str]) -> list[int]:
    """For each word of b, the length of the longest run around it that stands in a, too."""
    longest = [0] * len(b)
    for shift in range(-len(a), len(b)):
        k = max(0, shift)
        while k < len(b) and k - shift < len(a):
            n = k
            while n < len(b) and n - shift < len(a) and b[n] == a[n - shift]:
                n += 1
            for i in range(k, n):
                longest[i] = max(longest[i], n - k)
            k = n + 1
    return longest


def _corpus(seed: int) -> list[str]:
    rng = random.Random(seed)

    def some(n: int) -> list[str]:
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    lines = [" ".join(some(rng.randint(8, 20))) for _ in range(12)] + ["a b c", "x", "", "  "]
    hot = " ".join(some(15))
    passages = [some(rng.randint(49, 80)) for _ in range(4)]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 7)):
            kind = rng.random()
            if kind < 0.35:
                parts.append(rng.choice(lines))
            elif kind < 0.5:
                parts.append(hot)
            elif kind < 0.7:
                parts.append(" ".join(some(5) + rng.choice(passages) + some(6)))
            else:
                parts.append(" ".join(some(rng.randint(1, 30))))
        texts.append("\n".join(parts))
    return [*texts, texts[3], texts[7]]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark: SparkSession, seed: int) -> None:
    texts = _corpus(seed)
    got = {r.doc_id: r for r in linededup.deduplicated(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    words = [_words(t) for t in texts]
    held: set[str] = set()
    for k, text in enumerate(texts):
        longest = [max(x) for x in zip(*(_equal_runs(words[k], words[a]) for a in range(k)), strict=True)] if k else [0] * len(words[k])
        must, place = [n >= 2 * linededup.RUN - 1 for n in longest], 0
        for line in text.split("\n"):
            n = len(_words(line))
            if n >= linededup.BLOCK and line in held:
                must[place : place + n] = [True] * n
            place += n
        left = _words(got[k].text)
        # the words that stay are those of the text, in order, without any that had to go and with all that mustn't
        i = 0
        for w, gone, n in zip(words[k], must, longest, strict=True):
            if i < len(left) and left[i] == w and not gone:
                i += 1
            else:
                assert n >= linededup.BLOCK, (k, w, n)
        assert i == len(left)
        assert (got[k].text == text) == (got[k].lines_removed == 0)
        held.update(x for x in text.split("\n"))


def test_rare_short_line_leads_to_its_block(spark: SparkSession) -> None:
    common = "\n".join(["one two three", "four five six"])
    others = [f"{common}\nown line number {k} of this text" for k in range(12)]
    block = f"Heading\n{common}\nEnding"
    texts = [*others, f"first text\n{block}", f"second text here\n{block}\nrest", "Heading\nalone", "no common line but Ending"]
    got = {r.doc_id: r.text for r in linededup.deduplicated(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert got[13] == "second text here\nrest"  # eight words around two rare lines
    assert all(got[k] == texts[k] for k in (*range(13), 14, 15))  # six common words, or one word by chance, are no block


def test_moved_and_repeated_blocks_go(spark: SparkSession) -> None:
    one, two = (" ".join(f"{x}{k}" for k in range(10)) for x in "pq")
    texts = [f"{one}\nmiddle\n{two}", f"{two}\nother words\n{one}\nmore\n{one}\n{two}"]
    got = {r.doc_id: (r.text, r.lines_removed) for r in linededup.deduplicated(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert got == {0: (texts[0], 0), 1: ("other words\nmore", 4)}


def test_group_of_copies_takes_a_few_pairs_a_copy(spark: SparkSession) -> None:
    line = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(k, f"{line}\nown{k}") for k in range(300)], DOCS)
    found = linededup.matches(linededup.shared_prints(docs))
    # which runs are selected at the end depends on the own words, so that a copy can have two or three earliest holders
    assert 299 <= found.select("b", "a").distinct().count() < 3 * 299
    got = linededup.deduplicated(docs)
    assert got.where("doc_id > 0 and text <> concat('own', doc_id)").count() == 0 and got.count() == 300


def test_rows_that_share_an_id_are_not_lost(spark: SparkSession) -> None:
    line = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, line), (2, line + " x"), (2, "another text"), (2, "another text"), (None, line)], DOCS)
    got = sorted((str(r.doc_id), r.text) for r in linededup.without_shared_lines(docs).collect())
    assert got == [("1", line), ("2", "another text"), ("2", line + " x"), ("None", line)]


def test_cut_texts_in_one_go() -> None:
    texts = pa.array(["  a b\nc d\n", "", None, "\n-x y-\nkeep", "x\n\n(y z)"])
    data, offsets = raw(texts)
    starts, ends, _ = word_spans(data, offsets)
    words = [bytes(data[i:j]).decode() for i, j in zip(starts, ends, strict=True)]

    def left(gone: str) -> tuple[list[str], list[int]]:
        made, n = linededup.without_words(data, offsets, starts, ends, np.array([w in gone for w in words]))
        return made.to_pylist(), n.tolist()

    assert left("") == (["  a b\nc d\n", "", "", "\n-x y-\nkeep", "x\n\n(y z)"], [0] * 5)
    assert left("abxyz") == (["c d\n", "", "", "\nkeep", ""], [1, 0, 0, 1, 2])  # a text whose last line went doesn't end with a line end
    assert left("acy") == (["  b\nd\n", "", "", "\n-x \nkeep", "x\n\n(z)"], [2, 0, 0, 1, 1])
    assert left("cdz") == (["  a b\n", "", "", "\n-x y-\nkeep", "x\n\n(y "], [1, 0, 0, 0, 1])
