"""What the operators left undone before: small cases of each."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import SparkSession

from quillon.llm import credentials, htmltext, linededup, minhash

DOCS = "doc_id long, text string"


def test_lightly_edited_copies_are_grouped(spark: SparkSession) -> None:
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(60):
        x = [rng.choice(words) for _ in range(248)]
        y = [rng.choice(words) if k % 16 == 5 else w for k, w in enumerate(x)]
        texts += [" ".join(x), " ".join(y)]
    group = {r.doc_id: r.group_id for r in minhash.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert sum(group[k] == group[k + 1] == k for k in range(0, 120, 2)) >= 54
    assert len({group[k] for k in range(0, 120, 2)}) == 60


def test_passages_inside_longer_lines_are_cut(spark: SparkSession) -> None:
    rng = random.Random(7)

    def some(n: int) -> list[str]:
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    passage, own = some(60), [some(30) for _ in range(9)]
    texts = [
        " ".join(own[0] + passage + own[1]),  # the earliest holder
        " ".join(own[2] + passage + own[3]),  # inside one line
        " ".join(own[4]) + "\n" + "\n".join(" ".join(passage[k : k + 3]) for k in range(0, 60, 3)) + "\n" + " ".join(own[5]),  # over short lines
        " ".join(own[6] + passage[5:55] + own[7]),  # a run of 50 words
        " ".join(own[8] + passage[10:30]),  # too short a run
    ]
    got = {r.doc_id: (r.text, r.lines_removed) for r in linededup.deduplicated(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert got[0] == (texts[0], 0) and got[4] == (texts[4], 0)
    assert got[1] == (" ".join(own[2] + own[3]), 1) and got[3] == (" ".join(own[6] + own[7]), 1)
    assert got[2] == (" ".join(own[4]) + "\n" + " ".join(own[5]), 20)


_TEXT = "A long paragraph of running text that goes on. " * 8


@pytest.mark.parametrize("page", ["<head><title>x</title><body><p>{}", "<head><title>x</title><p>{}", "<body><nav><p>{}", "<body><p>y<aside><p>{}", "<div><select><p>{}", "<head></head><nav>a</nav><nav><p>{}"])
def test_html_unclosed_tags_lose_nothing_after_them(page: str) -> None:
    assert _TEXT.strip() in htmltext.main_text(page.format(_TEXT))[0]
    assert htmltext.main_text("<script>" + page.format(_TEXT))[0] == ""


def test_secrets_are_linked_within_the_whole_scope(spark: SparkSession) -> None:
    secret = 'token = "0123456789abcdef0123456789abcdef01234567'
    texts = [f'ann@example.com {"x " * 150}{secret}"', f'ann@example.com\n\n{secret}"', f'{secret}" {"x " * 300}10.1.2.3:80 ann@example.com', None, secret]
    got = sorted(tuple(r) for r in credentials.scope_findings(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect())
    assert got == [(0, 316, "weak", "0123", 40, 1, 0, "identifier@0", 301), (2, 0, "weak", "0123", 40, 1, 1, f"endpoint@{len(secret) + 602}", 602)]
