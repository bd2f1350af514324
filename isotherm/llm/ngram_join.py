"""N-gram Jaccard join: count vectors of hashed shingle groups in an R-tree, bounds from summed minima, exact verification."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.batches import WordHasher, bytes_of, mix, row_blocks
from isotherm.llm.components import components, contract, hung
from isotherm.llm.tables import fresh, marked, staged

GROUPS = 128  # coordinates of a count vector
POPULAR = 21
SPARE = 2  # parts beyond those that differences can spoil
PARTS_FROM = 90  # percent from which a part holds enough shingles to tell sets apart
RUN = 64  # documents that share a key and are still taken pair by pair
FREQUENT = 32  # documents that count a shingle among their first ones and still take it for rare
FREQUENT_BITS = 26
ROUNDS = 3
SHARED = 4  # first shingles that two linked sets have in common
CHUNK = 400  # documents that one task compares with each other
CHUNK_SHINGLES = 4_000_000


def shingle_sets(texts: list[bytes], k: int, hasher: WordHasher) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``k``-word shingles; of fewer words the whole sequence as one."""
    h, ends = hasher.words(texts, fold=True)
    with np.errstate(over="ignore"):
        run = np.zeros(max(len(h) - k + 1, 0), np.uint64)
        for j in range(k):
            run = mix(run * np.uint64(0x100000001B3) + h[j : len(h) - k + 1 + j]) if len(run) else run
        out = []
        for start, stop in zip(ends[:-1], ends[1:]):
            n = stop - start
            if n >= k:
                out.append(np.unique(run[start : stop - k + 1]))
            elif n:
                whole = np.zeros(1, np.uint64)
                for w in h[start:stop]:
                    whole = mix(whole * np.uint64(0x100000001B3) + w)
                out.append(mix(whole + np.uint64(n)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def popularity(docs: DataFrame, k: int) -> np.ndarray:
    """For each of 2 ** POPULAR hashed groups of shingles how popular it is, over all documents, as a power of two.

    0 for groups up to twice the mean. A task hands on the groups that stand out in it, so few rows meet.
    """

    def count(batches):
        hasher, counts = WordHasher(), np.zeros(1 << POPULAR, np.int64)
        for batch in row_blocks(batches, "text"):
            counts += np.bincount((np.concatenate(shingle_sets(bytes_of(batch, "text"), k, hasher)) >> np.uint64(64 - POPULAR)).astype(np.int64), minlength=len(counts))
        at = np.flatnonzero(counts >= 2 * counts.mean() + 3)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], counts.sum()))], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = (found.column(c).to_numpy() for c in ("bucket", "n"))
    mean = max(n[bucket < 0].sum() / (1 << POPULAR), 1.0)
    out = np.zeros(1 << POPULAR, np.uint8)
    out[bucket[bucket >= 0]] = np.clip(np.floor(np.log2(np.maximum(n[bucket >= 0] / mean, 1.0))), 0, 15)
    return out


def prefix(s: np.ndarray, popular: np.ndarray, percent: int, frequent: np.ndarray | None = None, shared: int = SHARED) -> np.ndarray:
    """Keys of a set: its first shingles in one order for all sets, groups of little popularity first, ``frequent`` ones last.

    Sets that link overlap in percent / 100 of either one at least, so of the first n - ceil(n percent / 100) + ``shared``
    shingles of both they have that many in common, whatever the order is; sets that overlap in fewer have all of those.
    """
    n = len(s)
    if not n:
        return np.empty(0, np.int64)
    level = popular[(s >> np.uint64(64 - POPULAR)).astype(np.int64)].astype(np.uint64)
    rest = s >> np.uint64(4)
    if frequent is not None:
        place = (rest & np.uint64((1 << FREQUENT_BITS) - 1)).astype(np.int64)
        level[(frequent[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1] = 15
    keys = level << np.uint64(60) | rest
    first = n - least_overlap(n, percent) + shared
    return (np.partition(keys, first - 1)[:first] if first < n else keys).view(np.int64)


def frequent_shingles(docs: DataFrame, k: int, percent: int, popular) -> np.ndarray:
    """A bitmap of 2 ** FREQUENT_BITS hashed places (8 MB whatever the tables' size) of shingles that more than ``FREQUENT`` sets have among their first.

    Counted over all documents. With those moved to the end others become first ones, which the next round
    counts; only what is new in a set is counted again. The bitmap orders shingles, so no link depends on it.
    """
    held = [None, np.zeros(1 << FREQUENT_BITS - 3, np.uint8)]
    for turn in range(ROUNDS):
        sent = docs.sparkSession.sparkContext.broadcast(held[-2:])

        def count(batches, turn=turn, sent=sent):
            hasher, (before, now) = WordHasher(), sent.value
            for batch in row_blocks(batches, "text"):
                firsts = [np.empty(0, np.int64)]
                for s in shingle_sets(bytes_of(batch, "text"), k, hasher):
                    own = prefix(s, popular.value, percent, now)
                    firsts.append(np.setdiff1d(own, prefix(s, popular.value, percent, before), True) if turn else own)
                # The level of a shingle may change between rounds, its place does not.
                key, n = np.unique(np.concatenate(firsts), return_counts=True)
                yield pa.record_batch([pa.array(key & ((1 << 60) - 1)), pa.array(n)], names=["key", "n"])

        counts = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        place = F.col("key").bitwiseAND((1 << FREQUENT_BITS) - 1)
        marks = counts.where(F.col("n") > FREQUENT).select(F.shiftright(place, 15).alias("part"), place.bitwiseAND((1 << 15) - 1).alias("at"))
        found = marks.groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).toArrow()
        sent.unpersist()
        more = held[-1].copy()
        for part, bits in zip(found.column("part").to_pylist(), found.column("bits").to_pylist()):
            more[part << 12 : part + 1 << 12] |= np.frombuffer(bits, np.uint8)
        if not found.num_rows:
            break
        held.append(more)
    return held[-1]


def least_overlap(n, percent: int):
    """Shingles that a set of ``n`` and one it links with have in common at least."""
    return -(-n * percent // 100)


class Bands:
    """Size classes and partitions from which two linked sets always share one.

    Sets link when intersection / union >= percent / 100. If the smaller has at most m shingles, they differ in at
    most m (100 - percent) / percent shingles. Dealt by hash into that number + 1 parts, one part holds the same
    shingles in both. A class covers sizes from ``low`` to the next; a set also joins the class below if
    a smaller partner may be in it. An empty part says little, so there are ``SPARE`` parts more, and empty parts
    count only for sets that have more empty ones than that: two sets that share nothing but empty parts both do.
    Sets too small to differ at all link only if they are equal.
    """

    def __init__(self, percent: int):
        self.percent = percent
        low = math.ceil(percent / (100 - percent))
        self.low = [low]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, math.ceil(self.low[-1] * 1.5)))

    def parts(self, band: int) -> int:
        return (self.low[band + 1] - 1) * (100 - self.percent) // self.percent + 1 + SPARE

    def of(self, n: int) -> list[int]:
        band = int(np.searchsorted(self.low, n, "right")) - 1
        if band < 0:
            return []
        below = band > 0 and -(-n * self.percent // 100) < self.low[band]
        return [band, band - 1] if below else [band]

    def keys(self, s: np.ndarray) -> np.ndarray:
        """One key for each part of each band."""
        out = []
        with np.errstate(over="ignore"):
            for band in self.of(len(s)):
                parts = self.parts(band)
                h = mix(s + np.uint64(band + 1) * np.uint64(0x9E3779B97F4A7C15))
                part = (h % np.uint64(parts)).astype(np.int64)
                low = np.bincount(part, (s & np.uint64(0xFFFFFFFF)).astype(np.float64), parts).astype(np.uint64)
                high = np.bincount(part, (s >> np.uint64(32)).astype(np.float64), parts).astype(np.uint64)
                held = np.bincount(part, minlength=parts) > 0
                number = np.arange(parts, dtype=np.uint64) + np.uint64(band << 44)
                key = mix(mix(low + (high << np.uint64(32))) + mix(number))
                out.append(key if (~held).sum() > SPARE else key[held])
        return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


class CountTree:
    """R-tree over count vectors: packed by halving at the widest coordinate; a node knows the maxima of its points.

    For any point p below a node, sum(min(q, p)) <= sum(min(q, maxima)), which bounds the overlap of the sets.
    """

    LEAF = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.points, self.sizes, self.percent = points, sizes, percent
        self.order = np.arange(len(points))
        self.nodes: list[tuple[np.ndarray, int, tuple[int, int] | None, slice]] = []
        if len(points):
            self._build(0, len(points))

    def _build(self, start: int, stop: int) -> int:
        own = self.order[start:stop]
        at, some = len(self.nodes), self.points[own]
        self.nodes.append((some.max(0), int(self.sizes[own].min()), None, slice(start, stop)))
        if stop - start > self.LEAF:
            axis = int((some.max(0) - some.min(0)).argmax())
            self.order[start:stop] = own[np.argsort(some[:, axis], kind="stable")]
            half = (start + stop) // 2
            self.nodes[at] = (*self.nodes[at][:2], (self._build(start, half), self._build(half, stop)), slice(start, stop))
        return at

    def near(self, q: np.ndarray, size: int) -> np.ndarray:
        """Points whose bound does not rule out a link with ``q``."""
        out, todo = [], [0] if self.nodes else []
        while todo:
            top, least, below, own = self.nodes[todo.pop()]
            if int(np.minimum(q, top).sum()) * (100 + self.percent) < self.percent * (size + least):
                continue
            if below:
                todo += below
            else:
                at = self.order[own]
                bound = np.minimum(q, self.points[at]).sum(1) * (100 + self.percent)
                out.append(at[bound >= self.percent * (size + self.sizes[at])])
        return np.concatenate(out) if out else np.empty(0, np.int64)


def link(sets: list[np.ndarray], group: list[int], left: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join what ``group`` holds apart: pairs of places, as many as it takes to connect all that link.

    ``left`` tells the two sides of a comparison; all are compared with all where there is one side.
    """
    points = np.array([count_vector(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sides = bool(left.any()) and not bool(left.all())
    base = np.flatnonzero(~left) if sides else np.arange(len(sets))
    tree = CountTree(points[base], sizes[base], percent)
    out = []
    for i in np.flatnonzero(left) if sides else range(len(sets)):
        for j in base[tree.near(points[i], int(sizes[i]))]:
            if (sides or j < i) and (a := find(group[i])) != (b := find(group[j])):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    root[a] = b
                    out.append((int(i), int(j)))
    return out


def count_vector(s: np.ndarray) -> np.ndarray:
    """The set as a point: how many shingles fall into each hashed group."""
    return np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_shingles``, the set's fingerprint and its count vector."""

    def profile(batches):
        hasher = WordHasher()
        for batch in row_blocks(batches, "text"):
            sets = shingle_sets(bytes_of(batch, "text"), k, hasher)
            marks = [fingerprint(s) for s in sets]
            columns = [[len(s) for s in sets], [m[0] for m in marks], [m[1] for m in marks]]
            points = pa.array([count_vector(s).astype("<u4").tobytes() for s in sets], pa.binary())
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), points], names=["doc_id", "n_shingles", "_k1", "_k2", "_point"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(profile, "doc_id long, n_shingles long, _k1 long, _k2 long, _point binary")


def candidate_links(docs: DataFrame, k: int, percent: int, at_once: int = 500_000) -> DataFrame:
    """``a, b, sure``: pairs of documents whose sizes allow a link and that share ``SHARED`` keys, or all that they must.

    A pair that shares a single shingle by chance is told by 40 bytes, before its count vectors are fetched. Where more than ``RUN`` documents share a key, they are chained instead of paired: chains (``sure``) connect all of
    them, and grow with their number only. A task hands on one row of a key that more than ``RUN`` of its own documents have,
    so a key that very many share does not grow with them either.
    """
    schema = "key long, a long, n long, b long"
    send = docs.sparkSession.sparkContext.broadcast
    popular = send(popularity(docs, k))  # 2 MB
    frequent = send(frequent_shingles(docs, k, percent, popular))  # 8 MB

    def rows(key, a, n, b):
        return pa.record_batch([pa.array(c) for c in (key, a, n, b)], names=["key", "a", "n", "b"])

    def reduce(keys, ids, sizes):
        key, own, n = (np.concatenate(x) for x in (keys, ids, sizes))
        order = np.lexsort((own, key))
        key, own, n = key[order], own[order], n[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        run = np.cumsum(first) - 1
        many = np.bincount(run)[run] > RUN
        yield rows(key[~many], own[~many], n[~many], np.full((~many).sum(), -1))
        lead = own[np.flatnonzero(first)[run]]
        heads = many & first
        yield rows(key[heads], own[heads], n[heads], np.full(heads.sum(), -2))
        pairs = np.unique(np.stack([lead[many & ~first], own[many & ~first]], 1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        if len(pairs):
            yield rows(mix(pairs[:, 1].astype(np.uint64)).view(np.int64), pairs[:, 0], np.zeros(len(pairs), np.int64), pairs[:, 1])

    def emit(batches):
        hasher, known, keys, ids, sizes, held = WordHasher(), popular.value, [], [], [], 0
        for batch in row_blocks(batches, "text"):
            for doc, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(bytes_of(batch, "text"), k, hasher)):
                own = prefix(s, known, percent, frequent.value)
                keys.append(own)
                ids.append(np.full(len(own), doc, np.int64))
                sizes.append(np.full(len(own), len(s), np.int64))
                held += len(own)
            if held >= at_once:
                yield from reduce(keys, ids, sizes)
                keys, ids, sizes, held = [], [], [], 0
        if held:
            yield from reduce(keys, ids, sizes)

    def meet(batches):
        held = [np.empty(0, np.int64)] * 4
        for batch in batches:
            given = batch.column("n").to_numpy() == 0  # links that are ready; a key has the size of its set
            at = np.flatnonzero(given)
            if len(at):
                yield ready(batch.column("a").to_numpy()[at], batch.column("b").to_numpy()[at])
            held = [np.concatenate([h, batch.column(c).to_numpy()[~given]]) for h, c in zip(held, ("key", "a", "n", "b"))]
            if not len(held[0]):
                continue
            last = int(np.searchsorted(held[0], held[0][-1]))  # the run that may go on
            yield from paired(*(h[:last] for h in held))
            held = [h[last:] for h in held]
            if len(held[0]) > RUN or (held[3] == -2).any():
                yield from paired(held[0], held[1], held[2], np.full(len(held[3]), -2))
                held = [*(h[-1:] for h in held[:3]), np.full(1, -2)]
        yield from paired(*held)

    def paired(key, own, n, mark):
        if len(key) < 2:
            return
        first = np.concatenate(([True], key[1:] != key[:-1]))
        run = np.cumsum(first) - 1
        many = (np.bincount(run) > RUN)[run] | (np.bincount(run, mark == -2) > 0)[run]
        chained = np.flatnonzero(many[1:] & ~first[1:])
        if len(chained):
            yield ready(own[chained], own[chained + 1])
        key, own, n = key[~many], own[~many], n[~many]
        out = []
        for step in range(1, RUN):
            same = np.flatnonzero(key[step:] == key[:-step]) if step < len(key) else []
            if not len(same):
                break
            a, b = own[same], own[same + step]
            small, large = np.minimum(n[same], n[same + step]), np.maximum(n[same], n[same + step])
            near = (100 * small >= percent * large) & (a != b)
            need = np.minimum(least_overlap(large, percent), SHARED)
            out.append(np.stack([np.minimum(a, b)[near], np.maximum(a, b)[near], need[near]], 1))
        if out:
            pairs, times = np.unique(np.concatenate(out), axis=0, return_counts=True)
            yield links(*pairs.T, times)

    def links(a, b, need, times):
        return pa.record_batch([pa.array(np.ascontiguousarray(c, np.int64)) for c in (a, b, need, times)], names=["a", "b", "need", "times"])

    def ready(a, b):
        return links(a, b, np.zeros(len(a)), np.ones(len(a)))

    keyed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(emit, schema)
    met = keyed.repartition("key").sortWithinPartitions("key", "a").mapInArrow(meet, "a long, b long, need long, times long")
    pairs = met.groupBy("a", "b").agg(F.min("need").alias("least"), F.max("need").alias("need"), F.sum("times").alias("times"))
    return pairs.where("least = 0 OR times >= need").select("a", "b", (F.col("least") == 0).alias("sure"))


def bounded_links(candidates: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of the candidates that the bound of their count vectors lets pass, and of the sure ones; ``points`` is (id, n, point)."""

    def check(batches):
        for batch in batches:
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, GROUPS) for c in ("p", "q"))
            most = np.minimum(p, q).sum(1, dtype=np.int64) * (100 + percent)
            sizes = batch.column("m").to_numpy() + batch.column("n").to_numpy()
            yield batch.filter(pa.array(most >= percent * sizes)).select(["a", "b"])

    sure = candidates.where("sure").select("a", "b")
    left = points.select(F.col("id").alias("a"), F.col("n").alias("m"), F.col("point").alias("p"))
    right = points.select(F.col("id").alias("b"), "n", F.col("point").alias("q"))
    open_ones = candidates.where("NOT sure").select("a", "b").join(left, "a").join(right, "b")
    return sure.union(open_ones.mapInArrow(check, "a long, b long"))


def chained_links(docs: DataFrame, k: int, percent: int, at_once: int = 500_000) -> DataFrame:
    """``a, b``: links that connect all documents sharing a key. A task first links those among its own rows and hands
    on one row per key, so a key that many documents share does not grow with them."""
    schema = "key long, a long, b long"

    def rows(key, a, b=None):
        return pa.record_batch([pa.array(key), pa.array(a), pa.array(b if b is not None else np.zeros(len(key), np.int64), mask=np.full(len(key), b is None))], names=["key", "a", "b"])

    def reduce(keys, ids):
        key, own = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        lead = own[np.flatnonzero(first)[np.cumsum(first) - 1]]
        pairs = np.unique(np.stack([lead[~first], own[~first]], 1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        yield rows(key[first], own[first])
        if len(pairs):
            yield rows(mix(pairs[:, 1].astype(np.uint64)).view(np.int64), pairs[:, 0], pairs[:, 1])

    def emit(batches):
        hasher, bands, keys, ids, held = WordHasher(), Bands(percent), [], [], 0
        for batch in row_blocks(batches, "text"):
            for doc, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(bytes_of(batch, "text"), k, hasher)):
                own = bands.keys(s)
                keys.append(own)
                ids.append(np.full(len(own), doc, np.int64))
                held += len(own)
            if held >= at_once:
                yield from reduce(keys, ids)
                keys, ids, held = [], [], 0
        if held:
            yield from reduce(keys, ids)

    def chain(batches):
        last_key, last = None, None
        for batch in batches:
            linked = batch.column("b").is_valid().to_numpy(zero_copy_only=False)
            key, a = batch.column("key").to_numpy()[~linked], batch.column("a").to_numpy()
            own = a[~linked]
            if last_key is not None:
                key, own = np.concatenate(([last_key], key)), np.concatenate(([last], own))
            same = np.flatnonzero((key[1:] == key[:-1]) & (own[1:] != own[:-1]))
            if len(key):
                last_key, last = key[-1], own[-1]
            given = batch.filter(pa.array(linked))
            yield pa.record_batch(
                [pa.array(np.concatenate([own[same], given.column("a").to_numpy()])), pa.array(np.concatenate([own[same + 1], given.column("b").to_numpy()]))],
                names=["a", "b"],
            )

    keyed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(emit, schema)
    return keyed.repartition("key").sortWithinPartitions("key", "a").mapInArrow(lambda batches: contract(chain(batches)), "a long, b long")


def verified_links(docs: DataFrame, places: DataFrame, k: int, percent: int) -> DataFrame:
    """Links within each comparison: ``places`` is (id, comp, left, right, side, own), where own tells what is linked already."""

    def compare(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["id"], r["side"]))
        rows = [r for i, r in enumerate(rows) if not i or (r["id"], r["side"]) != (rows[i - 1]["id"], rows[i - 1]["side"])]
        sets = shingle_sets([(r["text"] or "").encode() for r in rows], k, WordHasher())
        found = link(sets, [r["own"] for r in rows], np.array([r["side"] for r in rows], bool), percent)
        a, b = hung(*(np.array([rows[p[side]]["id"] for p in found], np.int64) for side in (0, 1)))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    held = marked(texts, "id", places.select("id"), "_wanted").where("_wanted").drop("_wanted")
    return held.join(places, "id").groupBy("comp", "left", "right").applyInArrow(compare, "a long, b long")


def join(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs`` (doc_id, text).

    Documents link when 100 * intersection >= ``percent`` * union of their distinct ``k``-word shingles (words: runs
    without ASCII white space, A-Z lower-cased); component_id is the smallest doc_id that links reach. A text
    that is null or has no words has no shingles and is its own component. A row without doc_id links with nothing
    and has no component. Rows that repeat a doc_id must repeat its text; each gets the same result.

    1. Equal sets are one class, by fingerprint; its smallest doc_id stands for it.
    2. From ``PARTS_FROM`` percent on, linked sets share the key of a part (``Bands``), which few others do. Below, parts hold too few
       shingles; there linked sets share some of their first shingles (``prefix``), and of the pairs of classes that do, those stay whose
       count vectors' summed minima allow a link. Neither loses a link.
    3. In each group that these connect, chunks of at most about ``CHUNK`` documents, each with the group's first
       one, are compared in an R-tree over count vectors, and what its bounds let pass is verified exactly.
    4. Groups of several chunks: what does not hang together with the group's first document is compared with
       all other chunks. Only links that connect are handed on, never all pairs of a group.
    """
    rows = staged(profiles(docs, k), "profiles")
    classes = staged(
        rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "_k1", "_k2").agg(F.min("doc_id").alias("_first")), "classes"
    )
    if percent >= PARTS_FROM:
        groups = components(staged(chained_links(docs, k, percent), "candidates"))
    else:
        points = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.col("_point").alias("point"))
        one_each = marked(docs.select("doc_id", "text"), "doc_id", classes.select("_first"), "_one").where("_one")  # and few others
        candidates = staged(candidate_links(one_each, k, percent), "candidates")
        # Staged, so that no task holds two Python workers at once.
        groups = components(staged(bounded_links(candidates, points.dropDuplicates(["id"]), percent), "bounded"))
    members = staged(
        groups.join(classes.select(F.col("_first").alias("id"), "n_shingles"), "id").select("id", F.col("component").alias("comp"), "n_shingles"), "members"
    )
    sizes = members.groupBy("comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), F.min("id").alias("lead")).where("n > 1")
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("s") / CHUNK_SHINGLES)).cast("int")
    sizes = staged(sizes.select("comp", "lead", chunks.alias("chunks")), "groups")
    dealt = members.join(sizes, "comp")
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    nobody = F.lit(False).alias("side")
    own = dealt.where("id <> lead").select("id", "comp", chunk.alias("left"), chunk.alias("right"), nobody, F.col("id").alias("own"))
    lead = sizes.select(F.col("lead").alias("id"), "comp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("left"))
    lead = lead.select("id", "comp", "left", F.col("left").alias("right"), nobody, F.col("id").alias("own"))
    links = staged(verified_links(docs, staged(own.union(lead), "places"), k, percent), "links")

    split = sizes.where("chunks > 1")
    linked = components(links)
    if split.limit(1).count():
        more = cross_links(docs, members, split, linked, k, percent)
        linked = components(linked.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    found = classes.join(linked.withColumnRenamed("id", "_first"), "_first", "left").select(
        "n_shingles", "_k1", "_k2", F.coalesce("component", "_first").alias("_component")
    )
    found = staged(found, "found")
    return rows.join(found, ["n_shingles", "_k1", "_k2"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("doc_id"))).alias("component_id"),
    )


def cross_links(docs: DataFrame, members: DataFrame, split: DataFrame, so_far: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between chunks: documents linked with the group's first one (they need no comparison with each other)
    against all others, and the others among themselves, chunk by chunk."""
    state = members.join(split, "comp").join(so_far, "id", "left").select("id", "comp", "lead", "n_shingles", F.coalesce("component", "id").alias("own"))
    leads = state.where("id = lead").select("comp", F.col("own").alias("main"))
    state = staged(state.join(leads, "comp").withColumn("in_main", F.col("own") == F.col("main")), "state")
    size = lambda inside: F.greatest(
        F.ceil(F.count(F.when(inside, 1)) / CHUNK), F.ceil(F.sum(F.when(inside, F.col("n_shingles"))) / CHUNK_SHINGLES), F.lit(0)
    ).cast("int")
    counts = staged(state.groupBy("comp").agg(size(F.col("in_main")).alias("s"), size(~F.col("in_main")).alias("r")).where("r > 0"), "counts")
    dealt = state.join(counts, "comp").withColumn("h", F.xxhash64("id"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    # Main chunks are numbered after the others, so left < right; the two sides of such a comparison differ in side.
    main = dealt.where("in_main").withColumn("left", each(F.col("r"))).withColumn("right", (F.col("r") + F.pmod("h", F.col("s"))).cast("int")).withColumn("side", F.lit(True))
    others = dealt.where("NOT in_main").withColumn("c", F.pmod("h", F.col("r")).cast("int")).withColumn("d", each(F.col("r") + F.col("s")))
    others = others.withColumn("left", F.least("c", "d")).withColumn("right", F.greatest("c", "d")).withColumn("side", F.col("c") > F.col("d"))
    pick = ("id", "comp", "left", "right", "side", "own")
    return verified_links(docs, staged(main.select(*pick).union(others.select(*pick)), "cross-places"), k, percent)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest doc_id. Rows without doc_id stay.

    Only rows that may have to go (copies, and repeated rows) are shuffled; all others pass as they are.
    """
    found = staged(join(docs, k, percent).select("doc_id", "component_id"), "joined")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    twice = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    flag = fresh(docs, "_maybe")
    seen = marked(docs, "doc_id", gone.union(twice), flag)
    sure = seen.where(~F.col(flag) | F.col("doc_id").isNull()).drop(flag)
    maybe = seen.where(F.col(flag) & F.col("doc_id").isNotNull()).drop(flag)
    kept = maybe.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return sure.select(*docs.columns).unionByName(kept.select(*docs.columns))
