"""Packing: harmonic classes of pieces, each class's sequences filled with a fixed number of pieces."""

from __future__ import annotations

import re
import struct
import sys
import types
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.batches import row_blocks
from isotherm.llm.tables import number_within, staged

_USUAL = re.compile(r"[\t\n\r\x20-\x7e\xc0-ɏ]*")
_TWO_SPACES = re.compile(r"\s\s")
_CUTS = re.compile(r"(?<=\S)(?= )|(?= \S)")
_STEM = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]+)")
_HELD = 250_000  # remembered units of a Python worker
_WHOLE = 1 << 18  # characters of a text at most that is encoded at once


def units_of(text: str) -> list[str]:
    """A text cut before its spaces, where the tokenizer's pattern always starts a new match.

    Of several white-space characters the pattern splits off the last one before a word, so a cut needs a
    non-space on one side. A line feed between non-spaces stands alone.
    """
    if _TWO_SPACES.search(text):
        return [u for u in _CUTS.split(text) if u]
    out = []
    for line in text.split("\n"):
        first, *rest = line.split(" ")
        if first:
            out.append(first)
        out += [" " + r for r in rest]
        out.append("\n")
    return out[:-1]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of a byte-level BPE as little-endian unsigned 32-bit bytes.

    Texts of usual characters take the same ranks through the faster library where they are given. Others, and very
    long ones, are cut into units, which are encoded once and remembered for as long as the worker lives: units of
    usual characters by the faster library too, all others by the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        held = sys.modules.setdefault("_remembered_units", types.ModuleType("_remembered_units"))
        self.known: dict[str, bytes] = held.__dict__.setdefault(path, {})
        self.slow = Tokenizer.from_file(path)
        self.special = {t.content: _packed([i]) for i, t in self.slow.get_added_tokens_decoder().items()}
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None
        self.fast = _ranks(ranks, pattern) if ranks else None

    def learn(self, units: set[str]) -> None:
        known = self.known
        if len(known) > _HELD:
            known.clear()
        rare = []
        for u in units:
            if u in known:
                continue
            if m := _STEM.fullmatch(u):  # letters, then signs: two matches of the pattern
                known[u] = self._own(m[1]) + self._own(m[2])
            elif self.fast is not None and _USUAL.fullmatch(u):
                known[u] = self._own(u)
            else:
                rare.append(u)
        for u, e in zip(rare, self.slow.encode_batch(rare, add_special_tokens=False)):
            known[u] = _packed(e.ids)

    def _own(self, unit: str) -> bytes:
        found = self.known.get(unit)
        if found is None:
            plain = self.fast.encode_ordinary(unit) if self.fast is not None else self.slow.encode(unit, add_special_tokens=False).ids
            found = self.known[unit] = _packed(plain)
        return found

    def encode(self, text: str, piece: int = 1 << 20) -> bytes:
        """Ids of a text; the tokenizer's added tokens keep their own id and part the text."""
        if self.cut is None:
            return self._encode(text, piece)
        return b"".join(self.special[t] if i % 2 else self._encode(t, piece) for i, t in enumerate(self.cut.split(text)))

    def _encode(self, text: str, piece: int) -> bytes:
        if self.fast is not None and len(text) <= _WHOLE and _USUAL.fullmatch(text):
            return _packed(self.fast.encode_ordinary(text))
        units, parts = units_of(text), []
        for start in range(0, len(units), piece):
            some = units[start : start + piece]
            self.learn(set(some))
            parts.append(b"".join(map(self.known.__getitem__, some)))
        return b"".join(parts)


def _ranks(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def piece_sizes(capacity: int) -> list[int]:
    """The reciprocal sizes capacity // k, falling: a sequence holds exactly capacity // size pieces of one size."""
    return sorted({capacity // k for k in range(1, capacity + 1)}, reverse=True)


def cuts(length: int, sizes: list[int]) -> list[int]:
    """Piece sizes of a document: whole sequences, then always the largest reciprocal size that still fits."""
    out = [sizes[0]] * (length // sizes[0])
    rest = length % sizes[0]
    for size in sizes[1:]:
        out += [size] * (rest // size)
        rest %= size
    return out


def first_fit(left: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int, int, int]]:
    """``size, number, bin, offset`` of pieces (size, number from, number to), by falling size into the first bin with room."""
    room, out = [], []
    for size, start, stop in sorted(left, reverse=True):
        for number in range(start, stop):
            at = next((b for b, r in enumerate(room) if r >= size), len(room))
            if at == len(room):
                room.append(capacity)
            out.append((size, number, at, capacity - room[at]))
            room[at] -= size
    return out


def pieces_of(docs: DataFrame, tokenizer: str, ranks: str | None, pattern: str | None, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """One row per piece of each document, cut by its length alone, so every task cuts for itself."""
    sizes = piece_sizes(capacity)

    def cut(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(tokenizer, ranks, pattern)
        end = end_id.to_bytes(4, "little")
        for batch in row_blocks(batches, "text"):
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encoder.encode(text or "") + end
                start, total = 0, len(ids) // 4
                for length in cuts(total, sizes):
                    own = ids[4 * start : 4 * (start + length)]
                    out.append((doc, start, length, zlib.crc32(own), total, own if with_ids else None))
                    start += length
            columns = list(zip(*out))
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)
    return rows if with_ids else rows.drop("ids")


def pack(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None,
    capacity: int = 2048, end_id: int = 1, buckets: int = 64, with_ids: bool = False,
) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) with the sequence and the place in it that each takes.

    Documents are cut into pieces of reciprocal sizes (capacity // k), so a sequence of a class holds k pieces
    and wastes less than one piece. Pieces of a class are numbered by many workers (``number_within``); number
    div k is the sequence. What no class can fill, fewer than k pieces of each, is packed first-fit by the driver
    from the class counts alone (some 90 rows); those pieces are found again by class and number.
    A null text counts as empty: its document is the end id alone. Repeated rows are packed each. ``with_ids``
    adds the ids of a piece (little-endian unsigned 32-bit).
    """
    spark = docs.sparkSession
    rows = staged(pieces_of(docs, tokenizer, ranks, pattern, capacity, end_id, with_ids), "pieces")
    counts = sorted(((r["length"], r["n"]) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()), reverse=True)
    classes, left, base = [], [], 0
    for size, n in counts:
        k = capacity // size
        classes.append((size, k, base, n // k * k))
        left.append((size, n // k * k, n))
        base += n // k
    table = spark.createDataFrame(classes, "length long, _k long, _base long, _full long")
    plan = spark.createDataFrame(
        [(size, number, base + at, offset) for size, number, at, offset in first_fit(left, capacity)],
        "length long, _number long, _sequence long, _offset long",
    )
    order = [F.col(c) for c in ("doc_id", "start", "ids_crc32", "doc_tokens")]
    numbered = number_within(rows, "length", order, order, buckets, "_number")
    full = F.col("_number") < F.col("_full")
    sequence = F.when(full, F.col("_base") + F.floor(F.col("_number") / F.col("_k"))).otherwise(F.col("_sequence"))
    offset = F.when(full, F.col("_number") % F.col("_k") * F.col("length")).otherwise(F.col("_offset"))
    return (
        numbered.join(F.broadcast(table), "length")
        .join(F.broadcast(plan), ["length", "_number"], "left")
        .withColumn("sequence_id", sequence.cast("long")).withColumn("offset", offset.cast("long"))
        .select(*rows.columns, "sequence_id", "offset")
    )
