"""Fill-in-middle: a wavelet matrix over character classes counts token boundaries, bisection on its ranks finds the cuts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.llm.batches import row_blocks
from isotherm.llm.tables import fresh

MARKS = ("<P>", "<S>", "<M>")
# classes of the bytes of a text; the codes of those that start a token have the high bit
TAIL, INNER, INITIAL, SINGLE = 0, 1, 2, 3  # inside a character, letter after a letter, first letter of a run, any other character
LEVELS = 2
BLOCK = 1 << 21


class BitVector:
    """Bits with ranks: the number of ones before a place, from counts before each 64-bit word and one popcount."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        padded = np.zeros((self.size // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        padded[: len(packed)] = packed
        self.words = padded.view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place ``at`` (0 to size)."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Symbols below 2 ** levels, one bit vector per bit from the highest; each level is parted stably by the bit of the one above."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.bits, self.zeros = levels, [], []
        for level in range(levels):
            bit = (symbols >> (levels - 1 - level) & 1).astype(bool)
            vector = BitVector(bit)
            self.bits.append(vector)
            self.zeros.append(len(symbols) - int(vector.before[-1]))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    def count(self, symbol: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` in [start, stop): both ends are followed down the levels by ranks."""
        for level in range(self.levels):
            one = symbol >> (self.levels - 1 - level) & 1
            start, stop = (self._down(level, one, at) for at in (start, stop))
        return stop - start

    def _down(self, level: int, one: int, at: np.ndarray) -> np.ndarray:
        ones = self.bits[level].rank(at)
        return self.zeros[level] + ones if one else at - ones


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each byte of texts that lie one after another from ``starts``."""
    letter = ((data | 32) - 97 < 26) & (data < 128)
    after = np.zeros(len(data), bool)
    after[1:] = letter[:-1]
    after[starts[starts < len(data)]] = False
    return np.where(letter, np.where(after, INNER, INITIAL), np.where(data & 0xC0 == 0x80, TAIL, SINGLE)).astype(np.uint8)


class Boundaries:
    """Token and character counts of ranges of a block of texts."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.tree = WaveletMatrix(classes(data, starts), LEVELS)

    def tokens(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Tokens that begin in [start, stop): runs of letters, and single characters."""
        return self.tree.count(INITIAL, start, stop) + self.tree.count(SINGLE, start, stop)

    def characters(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return self.tokens(start, stop) + self.tree.count(INNER, start, stop)

    def cut(self, start: np.ndarray, stop: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Where the first ``tokens`` tokens of [start, stop) end: the last place with no more tokens before it, by bisection."""
        low, high = start.copy(), stop.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            fits = self.tokens(start, middle) <= tokens
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def cuts_of(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``n, prefix_chars, middle_chars`` of texts whose cuts lie after ``first % (n + 1)`` and ``second % (n + 1)`` tokens."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    codes = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
    start, stop = ends[:-1] - ends[0], ends[1:] - ends[0]
    counts = Boundaries(codes, start)
    n = counts.tokens(start, stop)
    cuts = np.sort(np.stack((first % (n + 1), second % (n + 1))), axis=0)
    left, right = (counts.cut(start, stop, c) for c in cuts)
    return n, counts.characters(start, left), counts.characters(left, right)


def digits(key: Column, seed: str, group: int) -> Column:
    """The ``group``-th eight hex digits of the SHA-256 of ``seed:key``, as a number."""
    whole = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(whole, 8 * group - 7, 8), 16, 10).cast("long")


def with_cuts(docs: DataFrame, names: dict[str, str], text: str) -> DataFrame:
    """``docs`` with the columns ``n``, ``prefix_chars`` and ``middle_chars`` of the draws ``h1`` and ``h2`` (``names`` says what they are called)."""
    schema = docs.drop(names["h1"], names["h2"])
    for c in ("n", "prefix_chars", "middle_chars"):
        schema = schema.withColumn(names[c], F.lit(0).cast("long"))
    order = schema.columns

    def cut(batches):
        for batch in row_blocks(batches, text, BLOCK):
            draws = [batch.column(names[c]).to_numpy(zero_copy_only=False) for c in ("h1", "h2")]
            found = dict(zip(("n", "prefix_chars", "middle_chars"), cuts_of(batch.column(text), *draws)))
            columns = {c: batch.column(c) for c in batch.schema.names} | {names[c]: pa.array(v, pa.int64()) for c, v in found.items()}
            yield pa.record_batch([columns[c] for c in order], names=order)

    return docs.mapInArrow(cut, schema.schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, by the marks alone."""
    p, s, m = (F.instr(output, mark) for mark in MARKS)
    part = lambda start, stop: F.substr(output, start + 3, stop - start - 3)
    rest = lambda start: F.substr(output, start + 3)
    return (
        F.when(form == "psm", F.concat(part(p, s), rest(m), part(s, m)))
        .when(form == "spm", F.concat(part(p, m), rest(m), part(s, p)))
        .otherwise(output)
    )


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1", apply: int = 90, spm: int = 20) -> DataFrame:
    """``docs`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and the string ``output``.

    A text's n tokens are its runs of ASCII letters and its other characters. Four draws come from the SHA-256 of
    ``seed:key``: two places among the n + 1 boundaries cut the text into prefix, middle and suffix; ``apply`` percent
    of the texts are transformed, of these ``spm`` percent with the suffix first. Texts that are empty or hold one
    of the marks stay plain. The places are found in tasks, a block of texts at a time: the bytes' classes form a
    wavelet matrix, its ranks count the tokens of any range, and bisection on them finds both cuts.

    A null text is empty, a null key the empty string; repeated rows get the same result each. Texts of any length
    are cut whole. Other columns are kept; columns with the new names are replaced.
    """
    taken = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = docs.drop(*(c for c in docs.columns if c.lower() in taken and c not in (key, text)))
    names = {}
    for c in ("h1", "h2", "n", "prefix_chars", "middle_chars", "whole"):
        names[c] = fresh(kept, f"_{c}")
    rows = kept.withColumn(names["whole"], F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn(names["h1"], digits(F.col(key), seed, 1)).withColumn(names["h2"], digits(F.col(key), seed, 2))
    rows = with_cuts(rows, names, names["whole"])
    whole, n, prefix, middle = (F.col(names[c]) for c in ("whole", "n", "prefix_chars", "middle_chars"))
    marked = reduce(lambda a, b: a | b, (F.contains(whole, F.lit(m)) for m in MARKS))
    plain = (n == 0) | marked | (digits(F.col(key), seed, 3) % 100 >= apply)
    form = F.when(plain, "plain").when(digits(F.col(key), seed, 4) % 100 < spm, "spm").otherwise("psm")
    one = F.lit(1)
    before, inside, after = F.substr(whole, one, prefix.cast("int")), F.substr(whole, (prefix + 1).cast("int"), middle.cast("int")), F.substr(whole, (prefix + middle + 1).cast("int"))
    p, s, m = map(F.lit, MARKS)
    made = F.when(F.col("form") == "plain", whole).when(F.col("form") == "psm", F.concat(p, before, s, after, m, inside)).otherwise(F.concat(s, after, p, before, m, inside))
    cut = lambda c: F.when(F.col("form") != "plain", c)
    return (
        rows.withColumn("form", form)
        .withColumn("output", made).withColumn("n", n).withColumn("prefix_chars", cut(prefix)).withColumn("middle_chars", cut(middle))
        .drop(*(names[c] for c in ("n", "prefix_chars", "middle_chars", "whole")))
    )
