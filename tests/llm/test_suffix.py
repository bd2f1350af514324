"""Two-stage suffix sorting and the removal of repeated strings against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotherm.llm import suffix_dedup, suffix_sort

from .conftest import EDGE

LENGTH = 40


def alphabets():
    return [b"a", b"ab", b"abc", bytes([0, 1, 0xF4]), bytes(range(0xF5))]


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array_and_windows(seed):
    rng = random.Random(seed)
    letters = alphabets()[seed % 5]
    pieces = [bytes(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 8))]
    pieces += pieces[:1] * rng.randrange(2)
    text, starts = suffix_sort.laid_out(pieces)
    words = suffix_sort.words_at(text)
    order = suffix_sort.suffix_array(text, words).tolist()
    assert sorted(order) == list(range(len(text)))
    rests = [(pieces[p][i - s :], i) for i in order if text[i] for p in [int(np.searchsorted(starts, i, "right")) - 1] for s in [int(starts[p])]]
    assert rests == sorted(rests)
    length = rng.randrange(1, 20)
    places = defaultdict(set)
    for p, piece in enumerate(pieces):
        for i in range(len(piece) - length + 1):
            places[piece[i : i + length]].add((p, i))
    found = defaultdict(set)
    for p, i, group in zip(*(x.tolist() for x in suffix_sort.repeated_windows(pieces, length))):
        found[group].add((p, i))
    assert {frozenset(v) for v in found.values()} == {frozenset(v) for v in places.values() if len(v) > 1}


def test_first_stage_sorts_rising_suffixes_only(monkeypatch):
    seen = []
    direct = suffix_sort.sorted_directly
    monkeypatch.setattr(suffix_sort, "sorted_directly", lambda words, at, most: seen.extend(at.tolist()) or direct(words, at, most))
    piece = b"mississippi"
    text, starts = suffix_sort.laid_out([piece])
    suffix_sort.suffix_array(text, suffix_sort.words_at(text))
    at = int(starts[0])
    assert sorted(i - at for i in seen) == [i for i in range(len(piece)) if piece[i:] < piece[i + 1 :]]


def plain(rows, length):
    """Kept bytes and number of spans of each (doc_id, text), in the order of ids and then of the texts as they are met."""
    known, out = set(), {}
    for doc, text in rows:
        whole = (text or "").encode()
        covered = np.zeros(len(whole), bool)
        for i in range(len(whole) - length + 1):
            window = whole[i : i + length]
            if window in known:
                covered[i : i + length] = True
            known.add(window)
        edges = np.diff(np.concatenate(([0], covered.astype(int))))
        out[doc, text] = bytes(np.frombuffer(whole, np.uint8)[~covered]), int((edges == 1).sum())
    return out


def result(df, length=LENGTH):
    rows = suffix_dedup.drop_repeated(df, length).collect()
    assert all(r["n_bytes"] == len((r["text"] or "").encode()) and r["n_removed"] == r["n_bytes"] - len(r["kept"]) for r in rows)
    return {(r["doc_id"], r["text"]): (bytes(r["kept"]), r["n_spans"]) for r in rows}


def passages(seed, n=300):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randrange(2, 8))) for _ in range(400)]
    some = [" ".join(rng.choices(words, k=rng.randrange(6, 30))) for _ in range(12)]
    out = []
    for doc in rng.sample(range(-n, n), n):
        parts = [" ".join(rng.choices(words, k=rng.randrange(0, 40))) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(some))
        out.append((doc, " ".join(parts)))
    out += [(n + 1, "ab" * 300), (n + 2, "ab" * 100 + "c"), (n + 3, "x" * 500), (n + 4, out[0][1]), (n + 5, out[1][1][5:] + "!")]
    return out


@pytest.mark.parametrize("seed, block, per_bucket, lot", [(1, 1 << 21, 400_000, 1 << 21), (2, 1500, 300, 4000), (3, 400, 50, 500)])
def test_removed_as_by_brute_force(spark, monkeypatch, seed, block, per_bucket, lot):
    """Blocks, buckets and lots of any size give the same bytes, also where texts are longer than a block."""
    for name, value in (("BLOCK", block), ("PER_BUCKET", per_bucket), ("LOT", lot)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = passages(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain(sorted(rows), LENGTH)
    assert sum(spans for _, spans in want.values()) > 100
    assert result(df) == want


def test_a_very_large_group_of_copies(spark):
    """Copies are decided where they are read; one row per task and context goes on."""
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(60))
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(text)).otherwise(F.concat(F.lit("only "), F.col("id"))).alias("text"))
    rows = suffix_dedup.drop_repeated(df.repartition(7)).collect()
    assert {r["n_removed"] for r in rows if r["doc_id"] % 3 == 0 and r["doc_id"]} == {len(text)}
    assert sum(r["n_removed"] for r in rows if r["doc_id"] % 3 or not r["doc_id"]) == 0


def test_edges(spark, edge, empty):
    found = suffix_dedup.drop_repeated(edge)
    assert found.columns == edge.columns + ["n_bytes", "n_removed", "n_spans", "kept"]
    rows = found.collect()
    assert len(rows) == len(EDGE)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_bytes"] == 0 and by[1]["kept"] == b""
    assert by[9]["kept"] == by[9]["text"].encode()[:17] and by[9]["n_spans"] == 1  # its period
    assert by[10]["n_removed"] == 1_500_000 - 1
    assert suffix_dedup.drop_repeated(empty).collect() == []


def test_repeated_rows_and_shared_ids(spark):
    a, b = "The first of two long texts under a single id, with some words. " * 1, "Another text that stands under that same id, and it is long as well."
    both = a + "|" + b
    df = spark.createDataFrame([(7, a), (7, a), (7, b), (8, both), (None, b)], "doc_id long, text string")
    rows = suffix_dedup.drop_repeated(df, LENGTH).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_removed"]) for r in rows if r["doc_id"]) == sorted(
        [(False, 7, 0), (False, 7, 0), (False, 7, len(b)), (False, 8, len(a) + len(b))]
    )
    assert [r["n_removed"] for r in rows if r["doc_id"] is None] == [0]
