"""Near copies, benchmark leaks and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from isotherm.llm import components, decontamination, line_dedup, ngram_join
from isotherm.llm.batches import WordHasher, row_blocks, word_pieces

from .conftest import EDGE, SF_DIR
from .test_counts import check_packing, dedup_lines

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def linked(texts, k, percent):
    """Smallest id of each component, from all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in where[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in sets[i]:
            where[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def joined(df, k=3, percent=90):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, k, percent).collect()}


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_join(spark, k, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = linked(texts, k, percent)
    assert sum(i != c for i, (_, c) in want.items()) > 50
    assert joined(docs, k, percent) == want


@pytest.mark.parametrize("ids", [range(1, 201), range(-200, 0), [-(1 << 63), *range(-99, 100)]])
def test_many_sharers_with_any_ids(spark, ids):
    """More near copies in one task than are taken pair by pair, whatever the sign of their ids."""
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[:n] + [f"x{n}"] + words[n + 1 :])) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert [r["doc_id"] for r in ngram_join.keep_one(df, k=5, percent=80).collect()] == [min(ids)]


def chains(rng, n=400):
    """A large group in which neighbours link but far ones do not, in several strands, and short texts."""
    out, words = {}, [f"w{i}" for i in range(5000)]
    for strand in range(4):
        text = rng.sample(words, 60)
        for i in range(n // 4):
            if i % 3:
                text[rng.randrange(60)] = rng.choice(words)
            out[len(out)] = " ".join(text)
    for i in range(200):
        out[len(out)] = " ".join(rng.choices(words[:4], k=rng.randrange(1, 16)))
    return out


@pytest.mark.parametrize("chunk", [400, 7])
def test_join_of_chains_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    texts = chains(random.Random(chunk))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert joined(df) == linked(texts, 3, 90)
    assert joined(df, 2, 70) == linked(texts, 2, 70)


def test_join_edges(edge, empty):
    rows = ngram_join.join(edge).collect()
    want = linked({e[0]: e[1] for e in EDGE if e[0] is not None}, 3, 90)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)
    assert got == Counter((e[0], *(want[e[0]] if e[0] is not None else (len(shingles(e[1], 3)), None))) for e in EDGE)
    assert ngram_join.join(empty).count() == 0
    kept = ngram_join.keep_one(edge)
    assert set(kept.columns) == set(edge.columns)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == sorted({e[0] or 0 for e in EDGE})


def test_bands_share_a_key():
    """Any two sets that link share a key, whatever the sizes; keys of parts that both lack are shared too."""
    rng, random_set = np.random.default_rng(2), lambda n: np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, np.uint64))
    for percent in (70, 80, 90):
        bands = ngram_join.Bands(percent)
        for n in [*range(4, 60), 100, 333, 1000]:
            a = random_set(n)
            for _ in range(5):
                drop = rng.integers(0, n * (100 - percent) // 100 + 1)
                b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, rng.integers(0, 3), np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                    assert np.intersect1d(bands.keys(a), bands.keys(b)).size, (percent, n)


def test_linked_sets_share_first_shingles():
    """Whatever the sizes, and whatever is taken for popular or frequent."""
    rng = np.random.default_rng(2)
    frequent = rng.integers(0, 256, 1 << ngram_join.FREQUENT_BITS - 3).astype(np.uint8)
    popular = rng.integers(0, 16, 1 << ngram_join.POPULAR).astype(np.uint8)
    for percent in (70, 80, 90):
        for n in [*range(1, 60), 100, 333, 1000]:
            a = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
            for _ in range(5):
                drop = rng.integers(0, n * (100 - percent) // 100 + 1)
                b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, rng.integers(0, 3), np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    for marks in (None, frequent):
                        keys = [ngram_join.prefix(x, popular, percent, marks) for x in (a, b)]
                        assert np.intersect1d(*keys).size >= min(ngram_join.SHARED, both), (percent, n)


def test_texts_around_a_passage_do_not_hang_together(spark):
    """A passage that more documents share than are paired is no key of theirs."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(d, " ".join(f"d{d}w{i}" for i in range(200)) + f" {passage} " + " ".join(f"d{d}v{i}" for i in range(40))) for d in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert ngram_join.candidate_links(df, 5, 80).count() == 0


def test_tree_loses_no_link():
    rng = np.random.default_rng(4)
    points = rng.poisson(3, (300, 16))
    points[150:] = np.maximum(points[:150] + rng.integers(-1, 2, (150, 16)) * (rng.random((150, 16)) < 0.1), 0)
    sizes = points.sum(1)
    tree = ngram_join.CountTree(points, sizes, 90)
    pruned = 0
    for q, n in zip(points, sizes):
        near = set(tree.near(q, int(n)).tolist())
        want = {j for j in range(300) if 190 * np.minimum(q, points[j]).sum() >= 90 * (n + sizes[j])}
        assert near == want
        pruned += 300 - len(near)
    assert pruned > 200 * 300


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(0, 300) if i % 50] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(5000, x) for x in range(5001, 5400)] + [(7, 7)]
    root = {x: x for e in links for x in e if e[0] != e[1]}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {x: find(x) for x in root} and len(got) == len(root)


def test_word_hashes_of_long_and_short_texts():
    texts = [b"", b" a ", b"b a\tc", ("é word " * 400_000).encode(), b"x" * 3_000_000 + b" a"]
    h, ends = WordHasher().words(texts)
    words = [t.split() for t in texts]
    assert np.diff(ends).tolist() == [len(w) for w in words]
    seen = {}
    for w, x in zip((w for t in words for w in t), h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    assert b"".join(word_pieces(texts[3], 1000)) == texts[3]
    batch = pa.record_batch([pa.array(["a" * 10] * 50 + [None] + ["b" * 100])], names=["text"])
    assert sum(b.num_rows for b in row_blocks([batch], "text", 35, 4)) == 52


# -- benchmark --------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").casefold())


def edits_within(item, text):
    """Least word edits from ``item`` to any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_leaks_against_brute_force(spark, documents, texts):
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    items = {r["item_id"]: words_of(r["text"]) for r in benchmark.collect()}
    some = {i: t for i, t in texts.items() if i < 60 and len(t) < 4000}
    some |= {r["doc_id"]: texts[r["doc_id"]] for r in decontamination.leaks(documents, benchmark).collect() if len(texts[r["doc_id"]]) < 9000}
    want = {(d, i): n for d, t in some.items() for i, w in items.items() if (n := edits_within(w, words_of(t))) <= int(0.2 * len(w))}
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.leaks(documents.where(F.col("doc_id").isin(list(some))), benchmark).collect()}
    assert want and got == want


def test_changed_passages_are_found(spark, documents, texts):
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    rng, rows, want = random.Random(9), [], {}
    for r in benchmark.collect():
        for share in (0, 0.1, 0.2):
            words = words_of(r["text"])
            n = int(share * len(words))
            for _ in range(n):
                k, kind = rng.randrange(len(words)), rng.random()
                if kind < 0.6:
                    words[k] = rng.choice(["zebra", *words])
                elif kind < 0.8:
                    del words[k]
                else:
                    words.insert(k, rng.choice(words))
            doc = len(rows)
            rows.append((doc, "Before it. " * rng.randrange(30) + ", ".join(words).upper() + " after it" * rng.randrange(30)))
            want[doc, r["item_id"]] = share
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    for share, least in ((0, 1.0), (0.1, 0.97), (0.2, 0.95)):
        mine = [k for k, s in want.items() if s == share]
        assert np.mean([k in got for k in mine]) >= least
    assert all(r["edits"] <= 0.2 * r["item_words"] for r in got.values())
    assert {k for k in got} <= set(want) | {k for k in got if got[k]["edits"] == 0}


@pytest.mark.parametrize("n", [47, 63, 95, 190, 400])
@pytest.mark.parametrize("clumped", [False, True])
def test_long_changed_passages_are_found(n, clumped):
    """A fifth of the words changed, all over or within the first two thirds."""
    rng, made, texts = random.Random(n), [], []
    for item in range(100):
        words = [f"w{rng.randrange(5000)}" for _ in range(n)]
        made.append((item, " ".join(words)))
        near = {k: [w] for k, w in enumerate(words)}
        for k in rng.sample(range(2 * n // 3 if clumped else n), n // 5):
            near[k] = rng.choice([[], [f"z{k}"], [f"z{k}"], [f"z{k}", words[k]]])
        texts.append(" ".join(["before it"] * 20 + [w for k in range(n) for w in near[k]] + ["after it"] * 20))
    items = decontamination.Items(made, 0.2, 24, 3)
    hits = items.look_up([decontamination.numbered_words(t, items.vocabulary) for t in texts])
    assert all(h[1] <= n // 5 for own in hits for h in own)
    assert np.mean([any(h[0] == k for h in own) for k, own in enumerate(hits)]) >= 0.97
    with_edits = [(k, own[0]) for k, own in enumerate(hits) if own][:5]
    for k, hit in with_edits:
        assert hit[1] == edits_within(words_of(made[k][1]), words_of(texts[k]))


def test_leak_edges(spark, edge, empty):
    benchmark = spark.createDataFrame(
        [(1, "same line", 0), (2, None, 0), (3, "", 0), (None, "same line", 0), (4, "?!", 0), (5, "one", 0), (6, "same line", 0), (7, "under the mit license", 0)],
        "item_id long, text string, doc_id int",
    )
    rows = decontamination.leaks(edge, benchmark).collect()
    want = Counter((e[0], i) for e in EDGE for i, w in ((1, "same line"), (6, "same line"), (5, "one"), (7, "under the mit license")) if f" {w} " in f" {' '.join(words_of(e[1]))} ")
    assert Counter((r["doc_id"], r["item_id"]) for r in rows) == want
    assert Counter((r["doc_id"], r["item_id"]) for r in decontamination.leaks(edge, benchmark, block_bytes=8).collect()) == want
    assert decontamination.leaks(empty, benchmark).count() == decontamination.leaks(edge, benchmark.limit(0)).count() == 0
    clean = decontamination.drop_leaks(edge, benchmark, block_bytes=8)
    assert clean.columns == edge.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(e[0] for e in EDGE if not any(k[0] == e[0] for k in want))


# -- pipeline ---------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read = lambda df: [tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()]
    before, kept = read(docs), None
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "packing":
            check_packing(docs.collect(), [(r[0], r[1]) for r in before])
            break
        after = read(docs)
        if name == "language_id":
            assert set(after) <= set(before) and len(after) >= 0.97 * len(before)
        elif name == "line_dedup":
            want = Counter((d, t) for (d, t, *_), n in dedup_lines(before).items())
            assert Counter((r[0], r[1]) for r in after) == want
            assert all(r[4] == len(r[1]) for r in after)
        elif name == "ngram_join":
            groups = linked({r[0]: r[1] for r in before}, 5, 80)
            assert sorted(after) == sorted(r for r in before if groups[r[0]][1] == r[0])
            assert len(after) < len(before)
        else:
            leaky = {r["doc_id"] for r in decontamination.leaks(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            assert leaky and sorted(after) == sorted(r for r in before if r[0] not in leaky)
        assert after and [f.dataType for f in docs.schema] == [f.dataType for f in spark.read.parquet(f"{sf_dir}/documents.parquet").schema]
        before = after


def test_one_of_many_equal_copies_reaches_the_end(spark):
    """Copies that hold a third of a source, or all of a small one, are reduced to one and not emptied."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    rows = [(i, f"{words('a')}\n{words('b')}", "en", "s", 0) for i in range(10)] + [(i, f"{words(i)}\nsite line", "en", "s", 0) for i in range(10, 30)]
    rows += [(i, words("c"), "en", "small", 0) for i in range(30, 33)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.without_near_copies(spark, corpus_pipeline.without_boilerplate(spark, docs, SF_DIR), SF_DIR)
    want = {0: rows[0][1], 30: words("c")} | {i: words(i) for i in range(10, 30)}
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == want


def test_stages_on_edges_and_empty_tables(spark, edge, empty):
    for docs in (edge, empty):
        for name, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, SF_DIR)
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS, name
            docs.collect()
