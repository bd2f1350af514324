"""The filter audit against filters applied one by one, and Shapley values against their definition."""

import random
import re
from fractions import Fraction
from itertools import permutations

import pytest

from isotherm.llm import filter_audit

from .conftest import EDGE


def failed(rows):
    """``part, set of failed filters, doc_id`` of each row."""
    out = []
    for doc, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows),
        }
        out.append((part or "", {f for f in fails if fails[f]}, doc))
    return out


def plain(rows, good, toxic):
    found, out = failed(rows), {}
    for part in {p for p, *_ in found}:
        own = [(f, d) for p, f, d in found if p == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order):
                gone = [x for x in left if name in x[0]]
                left = [x for x in left if name not in x[0]]
                sums[name] += len(gone)
                out[part, "".join(order), step + 1] = [
                    len(left), len(gone), sum(name in f for f, _ in own) - len(gone), sum(f == {name} for f, _ in own),
                    sum(d in good for _, d in gone), sum(d in toxic for _, d in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(sums[order[step - 1]])
    return out


def result(docs, labels):
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in columns] for r in filter_audit.audit(docs, labels).collect()}


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_shapley_weights(n):
    rng = random.Random(n)
    value = [Fraction(0)] + [Fraction(rng.randrange(100)) for _ in range((1 << n) - 1)]
    want = [Fraction(0)] * n
    orders = list(permutations(range(n)))
    for order in orders:
        met = 0
        for i in order:
            want[i] += Fraction(value[met | 1 << i] - value[met], len(orders))
            met |= 1 << i
    assert [sum(w * v for w, v in zip(row, value)) for row in filter_audit.shapley_weights(n)] == want


def made(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["BIG", "Loud", "#", "50%"]
    texts = [" ".join(rng.sample(words, rng.randrange(60, 160))) for _ in range(30)] + [None, "", "A B C", "one " * 120, "|"]
    rows = [(rng.randrange(-5, 300), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(n)]
    return rows + [(None, "A B C", "en"), (None, None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_audit(spark, seed):
    """Copies, repeated ids with the same and with other texts, nulls, and labels said twice."""
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 200)] + [(4, 1, 1), (4, None, 0), (None, 1, 1)]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    assert result(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) == plain(rows, good, toxic)


def test_edges(edge, empty, labels, no_labels):
    found = result(edge, no_labels)
    assert found == plain([(d, t, lang) for d, t, lang, *_ in EDGE], set(), set())
    assert result(empty, labels) == {}
