"""Cuts by wavelet matrix against tokens of a regular expression; outputs and their way back."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from isotherm.llm import fill_middle

from .conftest import EDGE

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def digits(doc):
    whole = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    return [int(whole[i : i + 8], 16) for i in range(0, 32, 8)]


def plain(doc, text):
    text = text or ""
    tokens, h = TOKEN.findall(text), digits(doc)
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in fill_middle.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(rows):
    assert all((r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], r["text"]) for r in rows)


def test_ranks():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 4, size).astype(np.uint8)
        tree = fill_middle.WaveletMatrix(symbols, 2)
        start = rng.integers(0, size + 1, 50)
        stop = np.maximum(start, rng.integers(0, size + 1, 50))
        for s in range(4):
            assert tree.count(s, start, stop).tolist() == [int((symbols[a:b] == s).sum()) for a, b in zip(start, stop)]


@pytest.mark.parametrize("seed", range(20))
def test_cuts(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(["a", "Z", "bc", " ", "\n", "é", "漢", "😀", "7", "<", "\0"], k=rng.randrange(40))) for _ in range(30)] + [None, ""]
    first, second = (np.array([rng.randrange(1 << 32) for _ in texts]) for _ in range(2))
    found = fill_middle.cuts_of(pa.array(texts), first, second)
    for text, x, y, n, left, middle in zip(texts, first, second, *found):
        tokens = TOKEN.findall(text or "")
        a, b = sorted((x % (len(tokens) + 1), y % (len(tokens) + 1)))
        assert (n, left, middle) == (len(tokens), len("".join(tokens[:a])), len("".join(tokens[a:b])))


def test_documents(documents):
    rows = fill_middle.transform(documents).collect()
    check(rows)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"} and len(rows) == documents.count()


def test_edges(spark, edge, empty):
    made = fill_middle.transform(edge)
    assert made.columns[: len(edge.columns)] == edge.columns
    rows = made.collect()
    assert len(rows) == len(EDGE)
    check(rows)
    assert fill_middle.transform(empty).collect() == []


def test_the_way_back(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices(["<P", "<S", "<M", "<", ">", "P>", "word ", "é"], k=rng.randrange(1, 30)))) for i in range(3000)]
    made = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"))
    found = made.withColumn("back", fill_middle.restored(made["output"], made["form"])).collect()
    check(found)
    assert all(r["back"] == r["text"] for r in found)
    marked = [r for r in found if any(m in r["text"] for m in fill_middle.MARKS)]
    assert marked and all(r["form"] == "plain" for r in marked)
