"""Suffix-array dedup: bytes covered by a string that also starts earlier are removed.

Every window of ``length`` bytes has an anchor, the substring of GRAM bytes with the smallest hash in it, so equal
windows have equal anchors at equal places. Tasks hand on one record per anchor; only anchors that recur are looked
at, and only in their contexts, the bytes of the windows they stand for. Contexts that are equal byte for byte count
once, so a group of copies is reduced where it is read. The different contexts of an anchor meet in one lot, whose
suffixes are sorted in two stages; adjacent common prefixes tell which windows are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.batches import bytes_of, mix, row_blocks
from isotherm.llm.suffix_sort import repeated_windows
from isotherm.llm.tables import fresh, marked, staged

GRAM = 32  # bytes of an anchor
BLOCK = 1 << 21  # bytes that a task looks at together; below 2 ** PLACE
PLACE = 24
SLOTS = 22  # bits of the hash by which popular anchors are counted
POPULAR = 1 << 16  # at most so many slots are popular
PER_BUCKET = 400_000  # anchors that a task decides together
LOT = 1 << 21  # bytes of contexts that are sorted together
LEAST_ID = -(1 << 63)
OPEN, SPAN, ASK = 0, 1, 2

_PLACE = [("doc", "<i8"), ("variant", "<i8"), ("start", "<u4"), ("n", "<u4")]
ANCHORS = np.dtype([("gram", "<u8"), ("context", "<u8"), *_PLACE])
WINDOWS = np.dtype(_PLACE)  # n windows from start on
ASKED = np.dtype([("gram", "<u8"), *_PLACE])
PARCEL = "bucket int, kind int, body binary"


class Hashes:
    """Hashes of any substring of a block, from running sums of a polynomial."""

    def __init__(self):
        self.value = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        base, most = 0x5851F42D4C957F2D, BLOCK + 1
        powers, inverses = np.full(most, base, np.uint64), np.full(most, pow(base, -1, 1 << 64), np.uint64)
        powers[0] = inverses[0] = 1
        self.power, self.inverse = np.multiply.accumulate(powers), np.multiply.accumulate(inverses)

    def load(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[: len(data)], out=self.sums[1:])

    def grams(self, size: int) -> np.ndarray:
        h = (self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h

    def parts(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64) * np.uint64(0x94D049BB133111EB))


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by doubling."""
    done, out = 1, values
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(out) - (width - done)], out[width - done :]) if width > done else out


def blocks(batches, overlap: int):
    """``doc, variant, place, data, ends``: texts of a batch in blocks; longer ones in parts that share ``overlap`` bytes."""
    for batch in row_blocks(batches, "text", BLOCK):
        ids = [batch.column(c).to_numpy() for c in ("doc", "variant")]
        texts = bytes_of(batch, "text")
        if len(texts) > 1 or len(texts[0]) <= BLOCK:
            yield *ids, np.zeros(len(texts), np.int64), np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
        else:
            for start in range(0, max(len(texts[0]) - overlap, 1), BLOCK - overlap):
                part = texts[0][start : start + BLOCK]
                yield *ids, np.array([start]), np.frombuffer(part, np.uint8), np.array([len(part)])


def anchored(hashes: Hashes, data: np.ndarray, ends: np.ndarray, length: int, popular: np.ndarray | None):
    """``text, start, n, gram, context`` of the anchors of a block: each stands for ``n`` windows from ``start`` on.

    Popular substrings are anchors only of windows that hold nothing else, and of equal ones the first is taken.
    """
    if len(data) < length:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    hashes.load(data)
    h = hashes.grams(GRAM)
    rank = h >> np.uint64(1)
    if popular is not None:
        rank |= popular[h >> np.uint64(64 - SLOTS)].astype(np.uint64) << np.uint64(63)
    low = np.uint64((1 << PLACE) - 1)
    rank = (rank & ~low) | np.arange(len(h), dtype=np.uint64)
    at = (least_in_windows(rank, length - GRAM + 1) & low).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(at)), "right")
    at[np.arange(len(at)) + length > ends[text]] = -1  # windows that cross into the next text
    start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    n = np.diff(np.append(start, len(at)))
    kept = at[start] >= 0
    start, n = start[kept], n[kept]
    return text[start], start, n, h[at[start]], hashes.parts(start, start + n + length - 1)


def parcels(bucket: np.ndarray, kind: int, records: np.ndarray) -> pa.RecordBatch:
    """One row per bucket that has records."""
    by = np.argsort(bucket, kind="stable")
    bucket, records = bucket[by], records[by]
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.empty(0, np.int64)
    return _parcel_rows(bucket[first], kind, records, np.append(first, len(bucket)))


def _sliced(records: np.ndarray, cuts: np.ndarray) -> pa.Array:
    offsets = (cuts * records.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(records.tobytes())])


def _parcel_rows(bucket, kind, records, cuts) -> pa.RecordBatch:
    columns = [pa.array(bucket.astype(np.int32)), pa.array(np.full(len(bucket), kind, np.int32)), _sliced(records, cuts)]
    return pa.record_batch(columns, names=["bucket", "kind", "body"])


def records_of(table: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    bodies = [b for k, b in zip(table.column("kind").to_pylist(), table.column("body").to_pylist()) if k == kind]
    return np.frombuffer(b"".join(bodies), dtype)


def places(records: np.ndarray) -> np.ndarray:
    out = np.empty(len(records), WINDOWS)
    for c in WINDOWS.names:
        out[c] = records[c]
    return out


def home(records: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(records["doc"].astype(np.uint64) ^ mix(records["variant"].astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)


def parted(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in the order of gram, context and place, without rows said twice; are gram and context those of the one before?"""
    records = records[np.lexsort([records[c] for c in ("start", "variant", "doc", "context", "gram")])]
    alike = lambda *names: np.concatenate((np.zeros(min(len(records), 1), bool), np.logical_and.reduce([records[c][1:] == records[c][:-1] for c in names])))
    once = ~alike("gram", "context", "doc", "variant", "start")
    records = records[once]
    return records, alike("gram"), alike("gram", "context")


def popular_slots(texts: DataFrame, length: int) -> tuple[np.ndarray, int]:
    """Which slots hold more than a POPULAR-th of all anchors, and the number of anchors.

    A task names its own slots above that share, so what is that frequent overall is named by one task at least; the
    choice only moves anchors and never changes which windows are found equal.
    """

    def count(batches):
        hashes, seen = Hashes(), np.zeros(1 << SLOTS, np.int64)
        for *_, data, ends in blocks(batches, length - 1):
            gram = anchored(hashes, data, ends, length, None)[3]
            seen += np.bincount((gram >> np.uint64(64 - SLOTS)).astype(np.int64), minlength=1 << SLOTS)
        at = np.flatnonzero(seen >= max(8, seen.sum() // POPULAR + 1))
        slot, n = np.append(at, -1), np.append(seen[at], seen.sum())
        yield pa.record_batch([pa.array(slot), pa.array(n)], names=["slot", "n"])

    named = staged(texts.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")), "slots")
    total = named.where("slot = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    table = np.zeros(1 << SLOTS, bool)
    table[[r["slot"] for r in named.where((F.col("slot") >= 0) & (F.col("n") >= max(8, total // POPULAR + 1))).select("slot").collect()]] = True
    return table, total


def decided(texts: DataFrame, length: int, popular: np.ndarray, buckets: int) -> DataFrame:
    """Parcels by the home of their document: windows known to start earlier elsewhere, and contexts to be sorted."""

    def opened(batches):
        hashes = Hashes()
        for doc, variant, place, data, ends in blocks(batches, length - 1):
            text, start, n, gram, context = anchored(hashes, data, ends, length, popular)
            found = np.empty(len(text), ANCHORS)
            found["gram"], found["context"], found["n"] = gram, context, n
            found["doc"], found["variant"], found["start"] = doc[text], variant[text], start + place[text] - np.concatenate(([0], ends[:-1]))[text]
            found, _, same = parted(found)
            first, again = found[~same], places(found[same])
            yield parcels((first["gram"] % np.uint64(buckets)).astype(np.int64), OPEN, first)
            yield parcels(home(again, buckets), SPAN, again)

    def decide(table: pa.Table) -> pa.Table:
        found, known = records_of(table, OPEN, ANCHORS), records_of(table, SPAN, WINDOWS)
        _, number, times = np.unique(found["gram"], return_inverse=True, return_counts=True)
        found, alike, same = parted(found[times[number] > 1])
        new = ~same
        contexts = np.bincount(np.cumsum(~alike)[new], minlength=len(found) + 1)
        several = new & (contexts[np.cumsum(~alike)] > 1)
        ask = np.empty(several.sum(), ASKED)
        for c in ASKED.names:
            ask[c] = found[c][several]
        spans = np.concatenate((known, places(found[same])))
        return pa.Table.from_batches([parcels(home(spans, buckets), SPAN, spans), parcels(home(ask, buckets), ASK, ask)])

    return texts.mapInArrow(opened, PARCEL).groupBy("bucket").applyInArrow(decide, PARCEL)


def by_document(parcels_: DataFrame, kind: int, dtype: np.dtype, fold, stored: np.dtype) -> DataFrame:
    """``doc, variant, body``: the records of each document in one row, as ``fold`` makes them."""

    def gather(table: pa.Table) -> pa.Table:
        found = records_of(table, kind, dtype)
        found = found[np.lexsort([found[c] for c in ("start", "variant", "doc")])]
        new = np.concatenate((np.ones(min(len(found), 1), bool), (found["doc"][1:] != found["doc"][:-1]) | (found["variant"][1:] != found["variant"][:-1])))
        own, kept, cuts = found[new], *fold(found, np.flatnonzero(new))
        return pa.table([pa.array(own["doc"]), pa.array(own["variant"]), _sliced(kept.astype(stored, copy=False), cuts)], names=["doc", "variant", "body"])

    return parcels_.where(F.col("kind") == kind).groupBy("bucket").applyInArrow(gather, "doc long, variant long, body binary")


def _as_they_are(found: np.ndarray, first: np.ndarray):
    kept = np.empty(len(found), QUESTIONS)
    for c in QUESTIONS.names:
        kept[c] = found[c]
    return kept, np.append(first, len(found))


QUESTIONS = np.dtype([("gram", "<u8"), ("start", "<u4"), ("n", "<u4")])
RUNS = np.dtype([("start", "<u4"), ("stop", "<u4")])


def merged(length: int):
    """Windows of each document as maximal runs of covered bytes."""

    def fold(found: np.ndarray, first: np.ndarray):
        start = found["start"].astype(np.int64)
        stop = start + found["n"] + length - 1
        text = np.zeros(len(found), np.int64)
        text[first] = 1
        text = np.cumsum(text)
        wide = 1 << 33
        reach = np.maximum.accumulate(stop + text * wide) - text * wide  # the furthest byte covered so far in the document
        opens = np.ones(len(found), bool)
        opens[1:] = (text[1:] != text[:-1]) | (start[1:] > reach[:-1])
        at = np.flatnonzero(opens)
        runs = np.empty(len(at), RUNS)
        runs["start"], runs["stop"] = start[at], reach[np.append(at[1:], len(found)) - 1] if len(at) else 0
        return runs, np.append(np.searchsorted(at, first), len(at))

    return fold


def sorted_windows(pieces: DataFrame, length: int, buckets: int) -> DataFrame:
    """Windows of the contexts of each lot that start earlier in another one, from the lot's suffix array."""

    def earlier(table: pa.Table) -> pa.Table:
        rows = np.empty(table.num_rows, WINDOWS)
        for c in ("doc", "variant", "start"):
            rows[c] = table.column(c).to_numpy()
        rows["n"] = 1
        _, once = np.unique(rows, return_index=True)  # repeated rows ask twice
        bodies = table.column("piece").to_pylist()
        piece, offset, group = repeated_windows([bodies[i] for i in once], length)
        found = rows[once][piece]
        found["start"] += offset.astype(np.uint32)
        by = np.lexsort([found[c] for c in ("start", "variant", "doc")] + [group])
        found, group = found[by], group[by]
        later = found[1:][group[1:] == group[:-1]]
        return pa.Table.from_batches([parcels(home(later, buckets), SPAN, later)])

    return pieces.groupBy("lot").applyInArrow(earlier, PARCEL)


def repeated_runs(keyed: DataFrame, length: int) -> DataFrame:
    """``doc, variant, body``: the runs (start, stop) to remove from each document of ``keyed`` (doc, variant, text)."""
    popular, total = popular_slots(keyed, length)
    buckets = 1 + total // PER_BUCKET
    first = staged(decided(keyed, length, popular, buckets), "decided")
    asked = staged(by_document(first, ASK, ASKED, _as_they_are, QUESTIONS), "asked")
    n_asked = asked.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0] // QUESTIONS.itemsize
    lots = 1 + n_asked * (length + (length - GRAM) // 2) // LOT

    def cut_out(batches):
        for batch in row_blocks(batches, "text", BLOCK):
            out = []
            for doc, variant, text, body in zip(*(batch.column(c).to_pylist() for c in ("doc", "variant")), bytes_of(batch, "text"), batch.column("body").to_pylist()):
                found = np.frombuffer(body, QUESTIONS)
                lot = (found["gram"] >> np.uint64(8)) % np.uint64(lots)
                out += [(b, doc, variant, s, text[s : s + n + length - 1]) for b, s, n in zip(lot.tolist(), found["start"].tolist(), found["n"].tolist())]
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lot", "doc", "variant", "start", "piece"])

    wanted = marked(keyed, "doc", asked.select("doc"), "wanted").where("wanted").drop("wanted").join(asked, ["doc", "variant"])
    pieces = wanted.mapInArrow(cut_out, "lot long, doc long, variant long, start long, piece binary")
    late = staged(sorted_windows(pieces, length, buckets), "sorted")
    return by_document(first.unionByName(late), SPAN, WINDOWS, merged(length), RUNS)


def drop_repeated(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` (doc_id, text) with ``kept`` (the remaining bytes), ``n_bytes``, ``n_removed`` and ``n_spans``.

    Removed is each byte covered by a string of ``length`` bytes (more than GRAM) that also starts earlier: in a
    document with a smaller doc_id, or further ahead in the same. Strings are judged on the input; they never cross
    documents.

    A null text is empty. A null doc_id is the smallest. Rows that repeat doc_id and text are one document and get
    the same result; of different texts under one doc_id the one with the smaller hash is the earlier. Texts of any
    length (up to 4 GB) are read whole, in blocks that overlap. Other columns are kept; columns with the new names
    are replaced.
    """
    kept = docs.drop(*(c for c in docs.columns if c.lower() in ("kept", "n_bytes", "n_removed", "n_spans")))
    doc, variant, body, odd, cut = (fresh(kept, n) for n in ("_doc", "_variant", "_body", "_odd", "_cut"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = kept.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)))
    hashes = rows.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("h")).groupBy("doc").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    rows = marked(rows, doc, staged(hashes.where("a <> b").select("doc"), "shared_ids"), odd)
    rows = rows.withColumn(variant, F.when(F.col(odd), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))).drop(odd)
    keyed = rows.select(F.col(doc).alias("doc"), F.col(variant).alias("variant"), text.alias("text"))
    runs = staged(repeated_runs(keyed, length), "runs")

    @F.arrow_udf("kept binary, n_removed long, n_spans long")
    def without(text: pa.Array, body: pa.Array) -> pa.Array:
        out = []
        for whole, held in zip(text.cast(pa.binary()).to_pylist(), body.to_pylist()):
            found = np.frombuffer(held or b"", RUNS)
            edges = [0, *np.column_stack((found["start"], found["stop"])).ravel().tolist(), len(whole)]
            rest = b"".join(whole[a:b] for a, b in zip(edges[0::2], edges[1::2]))
            out.append((rest, len(whole) - len(rest), len(found)))
        rest, removed, spans = zip(*out) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(rest, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], ["kept", "n_removed", "n_spans"])

    maybe = marked(rows, doc, runs.select("doc"), odd)
    hit = maybe.where(odd).drop(odd).join(runs.toDF(doc, variant, body), [doc, variant], "left").withColumn(cut, without(text, F.col(body)))
    hit = hit.withColumns({"kept": F.col(f"{cut}.kept"), "n_removed": F.col(f"{cut}.n_removed"), "n_spans": F.col(f"{cut}.n_spans")}).drop(body, cut)
    zero = F.lit(0).cast("long")
    clear = maybe.where(~F.col(odd)).drop(odd).withColumns({"kept": F.encode(text, "UTF-8"), "n_removed": zero, "n_spans": zero})
    out = hit.unionByName(clear).withColumn("n_bytes", F.octet_length(text).cast("long"))
    return out.select(*kept.columns, "n_bytes", "n_removed", "n_spans", "kept")
