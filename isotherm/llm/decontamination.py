"""Benchmark decontamination: CGK random walks turn edit into Hamming distance, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.batches import BLOCK, mix, row_blocks, texts_of

_WORDS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BITS = 20  # of the table that tells which runs of words stand in an item
_SHARE = 24  # words of a block at least, where an item has as many


class Items:
    """A block of benchmark items: their words as numbers, the runs of words that a near passage keeps, LSH tables.

    An item of n words may be changed by up to floor(ratio * n) word edits. Cut into blocks of 24 to 47 words (shorter
    items are one block), one block of m words has at most e = floor(ratio * m) of them, wherever they are; finding
    that block is enough. Cut into e + 1 runs, one of its runs is left intact, so only windows that hold an intact run
    of a block of their length are walked.

    Each of a number of walks (CGK) reads a window word by word; at every step it writes the word it is at, and a
    random bit of (step, word) says whether it moves on. Two windows near in edit distance write strings near in
    Hamming distance. An LSH key is what a walk wrote at ``samples`` random steps. There are ``least`` walks, and more
    where blocks of a length need them for the target ``recall``.
    """

    def __init__(self, items: list[tuple[int, str]], ratio: float, least: int, samples: int, recall: float = 0.99, seed: int = 7):
        self.vocabulary: dict[bytes, int] = {}
        self.items = []
        for item, text in items:
            words = words_of(text)
            if words:
                self.items.append((item, np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)))
        self.edits = [math.floor(ratio * len(w)) for _, w in self.items]
        self.masks = [masks(w) for _, w in self.items]
        self.ratio, self.least, self.samples, self.recall = ratio, least, samples, recall
        self.blocks = []  # item, first word, words
        for i, (_, words) in enumerate(self.items):
            n, parts = len(words), max(1, len(words) // _SHARE)
            self.blocks += [(i, n * b // parts, n * (b + 1) // parts - n * b // parts) for b in range(parts)]
        self._index_runs()
        self._index_walks(np.random.default_rng(seed))

    def _index_runs(self) -> None:
        self.runs: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for i, first, n in self.blocks:
            q = max(1, min(n // (math.floor(self.ratio * n) + 1), 4))
            table = self.runs.setdefault(q, {})
            for at, h in enumerate(run_hashes(self.items[i][1][first : first + n], q).tolist()):
                table.setdefault(h, []).append((n, at))
        for table in self.runs.values():
            for h, places in table.items():
                table[h] = sorted(set(places))
        self.held = {}
        for q, table in self.runs.items():
            held = np.zeros(1 << _BITS, bool)
            held[(np.array(list(table), np.uint64) >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.held[q] = held

    def _index_walks(self, rng) -> None:
        self.walks, self.tables = {}, {}
        for band in sorted({n for _, _, n in self.blocks}):
            self.walks[band] = random_walks(rng, band, max(self.least, repeats_for(band, math.floor(self.ratio * band), self.samples, self.recall)), self.samples)
            table: dict[int, set[tuple[int, int]]] = {}
            for i, first, n in self.blocks:
                if n == band:
                    for h in self.walk(self.items[i][1], np.array([first]), np.array([first + n]), band)[0].tolist():
                        table.setdefault(h, set()).add((i, first))
            self.tables[band] = (np.array(sorted(table), np.uint64), table)

    def walk(self, words: np.ndarray, start: np.ndarray, stop: np.ndarray, band: int) -> np.ndarray:
        """LSH keys (windows x walks) of the windows of ``band`` words that start at ``start``."""
        return walk_keys(words, start, np.minimum(start + band, stop), self.walks[band])

    def windows(self, words: np.ndarray, base: np.ndarray) -> dict[int, np.ndarray]:
        """For each band the starts of windows that may hold an item; texts begin at ``base``."""
        found: dict[int, set[int]] = {}
        for q, table in self.runs.items():
            h = run_hashes(words, q)
            places = np.flatnonzero(self.held[q][(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            begin = base[np.searchsorted(base, places, "right") - 1]
            for at, first, key in zip(places.tolist(), begin.tolist(), h[places].tolist()):
                for band, inside in table.get(key, ()):
                    found.setdefault(band, set()).add(max(at - inside, first))
        return {band: np.array(sorted(s), np.int64) for band, s in found.items()}

    def look_up(self, texts: list[np.ndarray], at_once: int = 4096) -> list[list[tuple[int, int, int, int, int]]]:
        """For each text ``item, edits, first word, end, item words`` of the nearest passage for each item that is within its distance."""
        gap = np.zeros(1, np.int64)  # an unknown word, so no run goes over the end of a text
        words = np.concatenate([part for t in texts for part in (t, gap)])
        end = np.cumsum([len(t) + 1 for t in texts]) - 1
        base = end - [len(t) for t in texts]
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        seen: set[tuple[int, int, int]] = set()  # text, item, where the item would begin
        for band, starts in self.windows(words, base).items():
            known, table = self.tables[band]
            for k in range(0, len(starts), at_once):
                some = starts[k : k + at_once]
                text = np.searchsorted(base, some, "right") - 1
                keys = self.walk(words, some, end[text], band)
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                for w, r in zip(*np.nonzero(known[place] == keys)):
                    for i, first in table[int(keys[w, r])]:
                        seen.add((int(text[w]), i, int(some[w]) - first))
        for text, i, low, high in self.regions(seen, base, end):
            own, part = best[text], words[low:high]
            most = own[i][0] - 1 if i in own else self.edits[i]
            stop = ends_within(self.masks[i], len(self.items[i][1]), part, most) if most >= 0 else None
            if stop is not None:
                begin = max(0, stop - len(self.items[i][1]) - self.edits[i])
                edits, first, last = nearest(self.items[i][1], part[begin:stop], most)
                own[i] = (edits, low + begin + first - int(base[text]), low + begin + last - int(base[text]))
        return [[(self.items[i][0], *own[i], len(self.items[i][1])) for i in sorted(own)] for own in best]

    def regions(self, seen: set[tuple[int, int, int]], base: np.ndarray, end: np.ndarray):
        """``text, item, low, high``: the parts of the texts to compare with an item, those that overlap as one."""
        held = None
        for text, i, start in sorted(seen):
            n, e = len(self.items[i][1]), self.edits[i]
            low, high = max(start - e, int(base[text])), min(start + n + 2 * e, int(end[text]))
            if held is not None and held[:2] == (text, i) and low <= held[3]:
                held = (text, i, held[2], max(high, held[3]))
                continue
            if held is not None:
                yield held
            held = (text, i, low, high)
        if held is not None:
            yield held


def random_walks(rng, band: int, repeats: int, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``repeats`` walks over ``band`` words: two random numbers and whether the word is taken, for each step."""
    steps = 2 * band
    odd = rng.integers(0, 1 << 63, (steps, repeats), np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, (steps, repeats), np.uint64)
    taken = np.zeros((steps, repeats), bool)
    for r in range(repeats):
        taken[rng.choice(steps, min(samples, steps), replace=False), r] = True
    return odd, shift, taken


def walk_keys(words: np.ndarray, start: np.ndarray, stop: np.ndarray, walks: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """LSH keys (windows x walks) of the windows from ``start`` to ``stop``."""
    odd, shift, taken = walks
    repeats, end = odd.shape[1], stop[:, None]
    at = np.repeat(start[:, None], repeats, 1)
    key = np.broadcast_to(np.arange(1, repeats + 1, dtype=np.uint64), at.shape) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for step in range(len(odd)):
            word = np.where(at < end, words[np.minimum(at, len(words) - 1)], -1).astype(np.uint64) + np.uint64(2)
            if taken[step].any():
                key = np.where(taken[step], mix(key * np.uint64(31) + word), key)
            at = at + ((word * odd[step] + shift[step]) >> np.uint64(63)).astype(np.int64)
    return key


@lru_cache(maxsize=256)
def repeats_for(band: int, edits: int, samples: int, recall: float, trials: int = 160, walks: int = 192) -> int:
    """Walks that find a window of ``band`` words with ``edits`` word edits with probability ``recall``.

    Measured on made windows: half have their edits all over, half within a part of twice as many words; the worse half counts.
    """
    if not edits:
        return 1
    rng = np.random.default_rng(band)
    made = random_walks(rng, band, walks, samples)
    texts, starts, stops, at = [], [], [], 0
    for t in range(trials):
        words = (np.arange(band) + t * 4 * band).tolist()
        near = list(words)
        reach = min(band, 2 * edits) if t % 2 else band
        first = int(rng.integers(band - reach + 1))
        for x in rng.choice(reach, edits, replace=False).tolist():
            at_word = words[first + x]
            place, kind = near.index(at_word), rng.random()
            if kind < 0.6:
                near[place] = at_word + 2 * band
            elif kind < 0.8:
                del near[place]
            else:
                near.insert(place, at_word + 3 * band)
        for own in (words, near[:band]):
            texts += own
            starts.append(at)
            at += len(own)
            stops.append(at)
    keys = walk_keys(np.array(texts), np.array(starts), np.array(stops), made)
    missed = 1 - (keys[::2] == keys[1::2]).mean(1)
    found = lambda repeats: min(1 - np.mean(missed[half::2] ** repeats) for half in (0, 1))
    repeats = 1
    while found(repeats) < recall and repeats < 1024:
        repeats += 1
    return repeats


def masks(words: np.ndarray) -> dict[int, int]:
    """For each word of an item the bits of its places."""
    found: dict[int, int] = {}
    for at, w in enumerate(words.tolist()):
        found[w] = found.get(w, 0) | 1 << at
    return found


def ends_within(places: dict[int, int], n: int, text: np.ndarray, most: int) -> int | None:
    """The first end of the part of ``text`` nearest to an item of ``n`` words, if within ``most`` edits (Myers' bit vectors)."""
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, edits, best, found = full, 0, n, most + 1, None
    for j, word in enumerate(text.tolist(), 1):
        same = places.get(word, 0)
        vertical = same | down
        level = (((same & up) + up) ^ up) | same
        more, less = down | ~(level | up) & full, up & level
        edits += bool(more & last) - bool(less & last)
        more, less = more << 1 & full, less << 1 & full
        up, down = less | ~(vertical | more) & full, more & vertical
        if edits < best:
            best, found = edits, j
    return found


def words_of(text: str) -> list[bytes]:
    """Case-folded runs of ASCII letters and digits and of all other non-ASCII characters."""
    return text.casefold().encode().translate(_WORDS).split()


def run_hashes(words: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of ``q`` known words; 0 where a word is unknown."""
    if len(words) < q:
        return np.empty(0, np.uint64)
    last = len(words) - q + 1
    h, known = np.zeros(last, np.uint64), np.ones(last, bool)
    with np.errstate(over="ignore"):
        for k in range(q):
            part = words[k : last + k]
            known &= part > 0
            h = h * np.uint64(0x5851F42D4C957F2D) + part.astype(np.uint64)
        h = mix(h)
    return np.where(known, h, np.uint64(0))


def nearest(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """``edits, start, end`` of the part of ``text`` nearest to ``item`` in word edits, if within ``most``.

    Column by column; each cell carries where its alignment starts. Ties go to the earliest end.
    """
    n = len(item)
    pattern = item.tolist()
    cost, origin = list(range(n + 1)), [0] * (n + 1)
    best = (cost[n], 0, 0)
    for j, word in enumerate(text.tolist(), 1):
        corner, from_corner = cost[0], origin[0]
        cost[0], origin[0] = 0, j
        for i, w in enumerate(pattern, 1):
            c, o = corner + (w != word), from_corner
            if cost[i] + 1 < c:
                c, o = cost[i] + 1, origin[i]
            if cost[i - 1] + 1 < c:
                c, o = cost[i - 1] + 1, origin[i - 1]
            corner, from_corner = cost[i], origin[i]
            cost[i], origin[i] = c, o
        if cost[n] < best[0]:
            best = (cost[n], origin[n], j)
    return best if best[0] <= most and best[2] else None


def item_blocks(benchmark: DataFrame, block_bytes: int):
    """The items in blocks of about ``block_bytes``: each is read by itself, so the driver holds one at a time."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield sorted((r["item_id"], r["text"]) for r in own.collect())


def numbered_words(text: str, vocabulary: dict[bytes, int]) -> np.ndarray:
    """A text's words as the items' numbers; 0 for all words that stand in no item."""
    parts = []
    for start, stop in pieces(text):
        words = words_of(text[start:stop])
        parts.append(np.fromiter(map(vocabulary.get, words, repeat(0)), np.int64, len(words)))
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def pieces(text: str, limit: int = BLOCK):
    """Bounds of the pieces of a long text, cut only at spaces."""
    start = 0
    while start < len(text):
        stop = text.find(" ", start + limit) if len(text) > start + limit else -1
        stop = len(text) if stop < 0 else stop
        yield start, stop
        start = stop


def leaks(docs: DataFrame, benchmark: DataFrame, ratio: float = 0.2, repeats: int = 24, samples: int = 3, block_bytes: int = 1 << 20, recall: float = 0.99) -> DataFrame:
    """``doc_id, item_id, edits, first_word, end_word, item_words``: each item that a row of ``docs`` (doc_id, text) holds.

    A document holds an item (item_id, text) if a part of it is within ``ratio`` x item words of word edits; words are
    case-folded runs of ASCII letters and digits and of all other non-ASCII characters. The nearest part counts, of equals the
    first that is found. Passages at the largest distance are found with probability ``recall``, whatever their length: at least
    ``repeats`` walks are made, and as many as blocks of a length need. Null or empty texts hold
    nothing, items without words or id are in nothing; repeated rows and items each give their rows. The benchmark is
    taken in blocks of ``block_bytes``, so what goes to the tasks is bounded; nothing is shuffled.
    """
    columns = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, item_id long, edits long, first_word long, end_word long, item_words long"

    def one(block):
        items = Items(block, ratio, repeats, samples, recall)  # bounded by block_bytes

        def find(batches):
            for batch in row_blocks(batches, "text"):
                out = [
                    (doc, *hit)
                    for doc, hits in zip(batch.column("doc_id").to_pylist(), items.look_up([numbered_words(t, items.vocabulary) for t in texts_of(batch, "text")]))
                    for hit in hits
                ]
                names = [f.strip().split()[0] for f in schema.split(",")]
                yield pa.record_batch([pa.array([r[k] for r in out], pa.int64()) for k in range(len(names))], names=names)

        return columns.mapInArrow(find, schema)

    found = None
    for block in item_blocks(benchmark, block_bytes):
        found = one(block) if found is None else found.unionByName(one(block))
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, ratio: float = 0.2, repeats: int = 24, samples: int = 3, block_bytes: int = 1 << 20, recall: float = 0.99) -> DataFrame:
    """``docs`` without the rows that hold an item; see ``leaks``. All columns are kept, nothing is shuffled."""

    def one(rows, block):
        items = Items(block, ratio, repeats, samples, recall)

        def clean(batches):
            for batch in row_blocks(batches, "text"):
                keep = [not hits for hits in items.look_up([numbered_words(t, items.vocabulary) for t in texts_of(batch, "text")])]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return rows.mapInArrow(clean, rows.schema)

    for block in item_blocks(benchmark, block_bytes):
        docs = one(docs, block)
    return docs
