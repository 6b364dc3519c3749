"""Byte-level BPE encoding and decoding.

A text is cut into pretokens by the vocabulary's pattern (contractions; letters, digits or other
signs with at most one space before; white space). Each pretoken's bytes are a doubly linked list
of symbols. A priority queue holds the merge rank of every adjacent pair; the least rank, leftmost
first, is merged, its neighbours are relinked and the new pairs are queued. Entries whose symbols have changed
since are stale and skipped. Decoding concatenates the vocabulary's strings.

Pretokens are found by array operations on code points. Only distinct ones are encoded; a worker
keeps up to CACHE_SIZE of them. Every text is decoded again and compared with the original; should
two pretokens of a batch ever share a 64-bit hash, its text is encoded once more without hashes.

The vocabulary is a file of lines `base64 rank` with a token for each byte. Its path is a parameter;
the file is read on the driver and sent to the workers.

Defined results: a null text has null tokens, no count and null decoded text; an empty text has no
tokens; white space, signs, characters of any plane and texts of any length are encoded whole; null ids and repeated rows are
encoded as any other row. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillon.llm.common import as_array, code_points, raw, runs, slices, spans_hash

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_SIZE = 300_000

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
_WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_classes: np.ndarray | None = None


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The token strings in order of rank."""
    ranks: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if parts := line.split():
                ranks[int(parts[1])] = base64.b64decode(parts[0])
    return [ranks[k] for k in range(len(ranks))]


def classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    global _classes
    if _classes is None:
        major = {"L": _LETTER, "N": _NUMBER}
        made = np.fromiter((major.get(unicodedata.category(chr(p))[0], _OTHER) for p in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        made[list(_WHITE)] = _SPACE
        _classes = made
    return _classes


def pretokens(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pretokens of the rows; each ends where the next or its row's successor starts."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    change |= edge[:n]
    begin = np.flatnonzero(change)
    end = np.append(begin[1:], n)
    of = kind[begin]
    space = of == _SPACE
    blank = points == 32
    start = np.zeros(n, bool)
    # signs, letters and numbers take one space before them along
    solid = begin[~space]
    led = (solid > 0) & ~edge[solid] & blank[solid - 1]
    start[solid - led] = True
    # white space before something else leaves it the last character
    white, until = begin[space], end[space]
    start[white] = True
    start[(until - 1)[~edge[until]]] = True
    # contractions: an apostrophe alone that takes no space along, and the letters after it
    lone = (of == _OTHER) & (end - begin == 1) & (points[begin] == 39)
    lone &= ~((begin > 0) & ~edge[begin] & blank[begin - 1])
    quote = begin[lone]
    quote = quote[(quote + 1 < n)]
    quote = quote[~edge[quote + 1] & (kind[quote + 1] == _LETTER)]
    if len(quote):
        x = points[quote + 1]
        y = np.where((quote + 2 < n) & ~edge[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(x, [ord(c) for c in "stmd"])
        two = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        for some, size in ((quote[one], 2), (quote[~one & two], 3)):
            start[some + 1] = False
            after = some + size
            after = after[after < n]
            start[after] |= kind[after] == _LETTER
    return np.flatnonzero(start)


class Encoder:
    """Encodes pretokens with a priority queue over a linked list."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        self.vocabulary = vocabulary
        self.ranks = {x: k for k, x in enumerate(vocabulary)}
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int | None] = {}
        lengths = np.array([len(x) for x in vocabulary], np.int64)
        self.strings = np.frombuffer(b"".join(vocabulary), np.uint8)
        self.lengths, self.at = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat: list[int] = []
        self.to: list[int] = [0]
        self.pairs.clear()

    def merged(self, a: int, b: int) -> int | None:
        """The token of two adjacent tokens together, which is also the rank of the merge."""
        key = (a, b)
        if key not in self.pairs:
            self.pairs[key] = self.ranks.get(self.vocabulary[a] + self.vocabulary[b])
        return self.pairs[key]

    def piece(self, text: bytes) -> list[int]:
        """The tokens of one pretoken."""
        if text in self.ranks:
            return [self.ranks[text]]
        symbols: list[int] = [self.bytes[b] for b in text]
        n = len(symbols)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for k in range(n - 1):
            rank = self.merged(symbols[k], symbols[k + 1])
            if rank is not None:
                queue.append((rank, k, symbols[k], symbols[k + 1]))
        heapq.heapify(queue)
        while queue:
            rank, k, a, b = heapq.heappop(queue)
            j = following[k]
            if symbols[k] != a or j >= n or symbols[j] != b:
                continue  # stale: a symbol was merged meanwhile
            symbols[k], symbols[j] = rank, -1
            after = following[k] = following[j]
            if after < n:
                before[after] = k
                more = self.merged(rank, symbols[after])
                if more is not None:
                    heapq.heappush(queue, (more, k, rank, symbols[after]))
            i = before[k]
            if i >= 0:
                more = self.merged(symbols[i], rank)
                if more is not None:
                    heapq.heappush(queue, (more, i, symbols[i], rank))
        return [x for x in symbols if x >= 0]

    def _place(self, text: str) -> int:
        at = self.known.get(text)
        if at is None:
            at = self.known[text] = len(self.to) - 1
            self.flat += self.piece(text.encode())
            self.to.append(len(self.flat))
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all rows, and the first token of each row."""
        joined, points, offsets = code_points(texts)
        starts = pretokens(points, offsets)
        first = np.searchsorted(starts, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), first
        ends = np.append(starts[1:], len(points))
        if len(self.known) > CACHE_SIZE:
            self.forget()
        _, some, back = np.unique(spans_hash(points, starts, ends), return_index=True, return_inverse=True)
        place = np.array([self._place(joined[i:j]) for i, j in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
        to = np.array(self.to, np.int64)
        flat = np.array(self.flat, np.int32)
        at, many = to[place], to[place + 1] - to[place]
        tokens = flat[runs(at[back], many[back])]
        return tokens, np.concatenate([[0], np.cumsum(many[back])])[first]

    def encode_plainly(self, text: str) -> list[int]:
        """The tokens of one text, each pretoken for itself."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = pretokens(points, np.array([0, len(points)]))
        cut = [*starts.tolist(), len(points)]
        return [x for i, j in zip(cut[:-1], cut[1:], strict=True) for x in self.piece(text[i:j].encode())]

    def decode(self, tokens: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The concatenated strings of the tokens as bytes, and the first byte of each row."""
        sizes = self.lengths[tokens]
        return self.strings[runs(self.at[tokens], sizes)], np.concatenate([[0], np.cumsum(sizes)])[to]

    def encode_checked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens and bytes of all rows with their offsets; the bytes are those of the texts."""
        tokens, to = self.encode(texts)
        made, at = self.decode(tokens, to)
        data, offsets = raw(texts)
        if len(made) != len(data) or (made != data).any():
            lists = [self.encode_plainly(x or "") for x in texts.to_pylist()]
            tokens = np.array([x for row in lists for x in row], np.int32)
            to = np.concatenate([[0], np.cumsum([len(row) for row in lists])])
            made, at = self.decode(tokens, to)
        return tokens, to, made, at


_encoders: dict[str, Encoder] = {}


def encoded(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, tokens, decoded) of every row."""
    vocabulary = read_vocabulary(path)
    key = hashlib.sha256(b"".join(len(x).to_bytes(4, "little") + x for x in vocabulary)).hexdigest()  # the content, as a file can change
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:
            _encoders[key] = Encoder(sent.value)
        encoder = _encoders[key]
        for batch in batches:
            for at, part in slices(as_array(batch.column(1))):
                tokens, to, made, place = encoder.encode_checked(part)
                null = pa.array(np.asarray(part.is_null()))
                lists = pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(tokens, pa.int32()))
                texts = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(place.astype(np.int64)), pa.py_buffer(made)).cast(pa.string())
                counts = pa.array(np.diff(to).astype(np.int32))
                columns = [pc.if_else(null, pa.scalar(None, x.type), x) for x in (counts, lists, texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *columns], ["doc_id", "n_tokens", "tokens", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens int, tokens array<int>, decoded string")


def decoded(encodings: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, tokens): the vocabulary's strings one after the other, broken UTF-8 as replacement characters.

    Null tokens give a null text; a token outside the vocabulary is an error.
    """
    sent = encodings.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for batch in batches:
            texts = [None if x is None else b"".join([vocabulary[k] for k in x]).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encodings.select("doc_id", "tokens").mapInArrow(run, "doc_id long, text string")


