"""The classifier's scores against a plain loop over features, and its gradients against finite differences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quillon.llm import classifier
from quillon.llm.common import _BASE, mix

TEXTS = ["Die Die Katze saß", "a b a b", "", "one  two\n\ttwo two TWO", "Ünï coded wörds", "x" * 40]


def _sum(points: list[int]) -> int:
    return sum((p + 1) * pow(_BASE, k, 1 << 64) for k, p in enumerate(points)) % (1 << 64)


def _mixed(x: int) -> int:
    return int(mix(np.array([x % (1 << 64)], np.uint64))[0])


def _features(text: str) -> list[int]:
    """Word by word: the word's own bucket, those of its n-grams between marks, and bucket 0 for a word that repeats the one before it."""
    out, before = [], None
    for word in text.split():
        out.append(_mixed(_sum([ord(c) for c in word]) + len(word)) % classifier.BUCKETS)
        marked = [ord(c) for c in f"<{word.lower()}>"]
        for n in classifier.NGRAMS:
            out += [_mixed(_sum(marked[k : k + n]) + n) % classifier.BUCKETS + classifier.BUCKETS for k in range(len(marked) - n + 1)]
        if word == before:
            out.append(0)
        before = word
    return out


def test_scores_against_a_plain_loop() -> None:
    rng = np.random.default_rng(2)
    model = classifier.Model(rng.normal(size=(2 * classifier.BUCKETS, 3)).astype(np.float32), np.array([0.3, -0.2, 0.1]))
    got = model.probabilities(pa.array(TEXTS))
    for text, p in zip(TEXTS, got, strict=True):
        logits = model.bias.copy()
        if found := _features(text):
            logits = logits + sum(model.table[f].astype(float) for f in found) / len(found)
        expected = np.exp(logits) / np.exp(logits).sum()
        assert np.allclose(p, expected, atol=1e-6), text


def test_gradients_against_finite_differences() -> None:
    rng = np.random.default_rng(3)
    texts = [t for t in TEXTS if t]
    b = classifier._batch(texts, np.array([0, 1, 2, 1, 0]), np.arange(len(texts)))
    parts = [rng.normal(size=(len(b.used), classifier.DIMENSIONS)), rng.normal(size=(classifier.DIMENSIONS, 3)), rng.normal(size=3)]
    _, of_layer, of_bias, of_used = classifier.gradients(b, *parts)
    for k, gradient in ((0, of_used), (1, of_layer), (2, of_bias)):
        for _ in range(30):
            at = tuple(rng.integers(n) for n in parts[k].shape)
            values = []
            for step in (1e-5, -1e-5):
                moved = [p.copy() for p in parts]
                moved[k][at] += step
                values.append(classifier.gradients(b, *moved)[0])
            assert abs((values[0] - values[1]) / 2e-5 - gradient[at]) < 1e-6
