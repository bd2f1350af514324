"""Array code for Arrow batches of texts: blocks of bounded size, word hashes, character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18  # characters or bytes handled at once; longer texts are handled in pieces
SPACES = b" \t\n\r\x0b\x0c"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def row_blocks(batches, text: str, limit: int = BLOCK, most_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of ``most_rows`` at most, whose texts come to ``limit`` bytes at most or that hold one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(ends):
            base = ends[start - 1] if start else 0
            stop = min(start + most_rows, max(start + 1, int(np.searchsorted(ends, base + limit, "right"))))
            yield batch.slice(start, stop - start)
            start = stop


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables():
    byte = np.arange(256, dtype=np.uint64)
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return mix((byte + np.uint64(1)) * _ODD), space, lower


class WordHasher:
    """64-bit hashes of the words (runs without ASCII white space) of many texts at once.

    A word's hash is a polynomial in its bytes, taken from running sums over the whole block.
    """

    def __init__(self):
        self.value, self.space, self.lower = _tables()
        self.power = self.inverse = np.empty(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) >= n:
            return
        base = 0x5851F42D4C957F2D
        with np.errstate(over="ignore"):
            power = np.full(n, base, np.uint64)
            inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
            power[0] = inverse[0] = 1
            self.power = np.multiply.accumulate(power)
            self.inverse = np.multiply.accumulate(inverse)

    def _hash(self, data: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts of the words of ``data``."""
        codes = np.frombuffer(data, np.uint8)
        if fold:
            codes = self.lower[codes]
        gap = np.concatenate(([True], self.space[codes], [True]))
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edge[0::2], edge[1::2]
        self._grow(len(codes) + 1)
        with np.errstate(over="ignore"):
            run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.value[codes] * self.power[: len(codes)])))
            h = (run[end] - run[start]) * self.inverse[start]
            return mix(h + (end - start).astype(np.uint64) * _ODD), start

    def words(self, texts: list[bytes], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and for each text the number of words before it (one more entry at the end)."""
        parts, counts, small, at = [], np.zeros(len(texts) + 1, np.int64), [], 0

        def flush(upto: int) -> None:
            nonlocal small, at
            if small:
                sizes = np.array([len(t) + 1 for t in small])
                h, start = self._hash(b" ".join(small), fold)
                counts[at + 1 : upto + 1] = np.bincount(np.searchsorted(np.cumsum(sizes), start, "right"), minlength=len(small))
                parts.append(h)
            small, at = [], upto

        held = 0
        for i, text in enumerate(texts):
            if held + len(text) > BLOCK:
                flush(i)
                held = 0
            if len(text) > BLOCK:
                for piece in word_pieces(text):
                    h, _ = self._hash(piece, fold)
                    counts[i + 1] += len(h)
                    parts.append(h)
                at = i + 1
            else:
                small.append(text)
                held += len(text)
        flush(len(texts))
        return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.cumsum(counts)


def word_pieces(text: bytes, limit: int = BLOCK) -> Iterator[bytes]:
    """Pieces of a long text, cut only at ASCII white space."""
    start = 0
    while start < len(text):
        stop = start + limit
        if stop < len(text):
            cuts = [p for p in (text.find(bytes([s]), stop) for s in SPACES) if p >= 0]
            stop = min(cuts) if cuts else len(text)
        yield text[start:stop]
        start = stop


def char_blocks(texts: list[str], ahead: int, limit: int = BLOCK):
    """``codes, row, piece, own`` of texts in blocks: code points, the text and piece each belongs to, and whether
    an n-gram that starts there is counted (a piece of a long text also shows the ``ahead`` characters after it)."""
    rows, pieces, owns, held = [], [], [], 0

    def block():
        lens = np.array([len(p) for p in pieces])
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4")
        inside = np.arange(len(codes)) - np.repeat(np.cumsum(lens) - lens, lens)
        return codes, np.repeat(np.array(rows), lens), np.repeat(np.arange(len(lens)), lens), inside < np.repeat(np.array(owns), lens)

    for i, text in enumerate(texts):
        for start in range(0, len(text), limit):
            own = min(limit, len(text) - start)
            if held + own > limit and pieces:
                yield block()
                rows, pieces, owns, held = [], [], [], 0
            rows.append(i)
            pieces.append(text[start : start + own + ahead])
            owns.append(own)
            held += own
    if pieces:
        yield block()


def char_grams(codes, piece, own, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the ``n``-grams of a block and the places where they start."""
    last = len(codes) - n + 1
    if last <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.full(last, n * 0x85EBCA6B & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ codes[k : last + k].astype(np.uint32)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
    at = np.flatnonzero((piece[:last] == piece[n - 1 :]) & own[:last])
    return (h[at] >> np.uint32(32 - bits)).astype(np.int64), at


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 of a text column; null as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
