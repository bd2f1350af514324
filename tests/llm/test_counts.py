"""Quality rules, licence scan, line dedup, sharding and packing against plain counting."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from isotherm.llm import license_scan, line_dedup, packing, quality_rules, sharding
from isotherm.llm.queries import pack_documents

from .conftest import EDGE

SPACE = r"[^\x20\x09-\x0D]+"


def base_counts(text):
    words = re.findall(SPACE, text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    found = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(found),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_quality_rules(documents, labels, texts):
    rows = quality_rules.judge(documents, labels).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in rows} == {i: base_counts(t) for i, t in texts.items()}
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.5)


def test_quality_rules_on_unseen_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learned = labels.where("doc_id % 2 = 0")
    p = {r["doc_id"]: r["p_good"] for r in quality_rules.judge(docs, learned).collect()}
    unseen = labels.where("doc_id % 2 = 1").collect()
    assert np.mean([(p[r["doc_id"]] >= 0.5) == (r["quality"] == 1) for r in unseen]) > 0.93
    brier = np.mean([(p[r["doc_id"]] - r["quality"]) ** 2 for r in unseen])
    assert brier < 0.06


def test_quality_rules_edges(edge, empty, labels, no_labels):
    rows = quality_rules.judge(edge, labels).collect()
    assert Counter((r["doc_id"], *(r[c] for c in COUNTS)) for r in rows) == Counter((e[0], *base_counts(e[1])) for e in EDGE)
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (1, 2, 3, 4))
    assert quality_rules.judge(empty, no_labels).count() == 0
    assert all(r["p_good"] is None and r["kept"] == (not r["base_failed"]) for r in quality_rules.judge(edge, no_labels).collect())


def phrase_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for label, phrase in {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}.items():
        run = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(run)] == run]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


SCAN = ("n_words", "n_base", "first_word", "last_word", "base_labels")


def test_license_scan(documents, texts):
    rows = license_scan.scan(documents).collect()
    assert {r["doc_id"]: tuple(r[c] for c in SCAN) for r in rows} == {i: phrase_places(t) for i, t in texts.items()}
    assert any(r["n_base"] for r in rows)
    for r in rows:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        said = "gnu general public license" in " ".join(re.findall(r"[a-z0-9]+", texts[r["doc_id"]].lower()))
        assert ("gpl" in r["labels"].split(",")) == said


def test_license_scan_edges(spark, edge, empty):
    assert Counter((r["doc_id"], *(r[c] for c in SCAN)) for r in license_scan.scan(edge).collect()) == Counter((e[0], *phrase_places(e[1])) for e in EDGE)
    assert license_scan.scan(empty).count() == 0
    text = "CC BY NC, cc-by-nc; Apache License\nVersion 2 under THE Mit license under the mit license"
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(row[c] for c in SCAN) == phrase_places(text) and row["n_base"] == 5


def test_license_template_with_changes(spark):
    text = "Intro. Permission is hereby granted, free of charge, to any one person obtaining a copy of this software and its associated documentation files."
    other = "Permission to speak is granted. The charge is free of software and documentation files copy."
    rows = license_scan.scan(spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["labels"] for r in rows} == {1: "mit", 2: ""}


def dedup_lines(rows, ratio=0.1, least=3):
    hosts, seen = Counter(), Counter()
    for _, text, _, host, _ in rows:
        hosts[host or ""] += 1
        seen.update((host or "", x) for x in set((text or "").split("\n")) if x.strip(" "))
    drop = {k for k, n in seen.items() if n >= least and n > ratio * hosts[k[0]]}
    out = []
    for doc, text, _, host, _ in rows:
        lines = [] if text is None else text.split("\n")
        rest = [x for x in lines if (host or "", x) not in drop]
        out.append((doc, None if text is None else "\n".join(rest), len(lines), len(lines) - len(rest)))
    return Counter(out)


def test_line_dedup(documents, edge, empty):
    pick = lambda df: Counter(tuple(r) for r in line_dedup.drop_boilerplate(df).select("doc_id", "text", "n_lines", "n_dropped").collect())
    rows = [tuple(r) for r in documents.collect()]
    assert pick(documents) == dedup_lines(rows)
    assert pick(edge) == dedup_lines(EDGE)
    assert sum(n for (*_, n) in pick(edge)) > 0
    assert pick(empty) == Counter()
    kept = line_dedup.drop_boilerplate(edge)
    assert set(edge.columns) | {"n_lines", "n_dropped"} == set(kept.columns)
    assert {r["host"] for r in kept.collect()} == {"taken"}


def test_sharding(documents, edge, empty, texts):
    rows = sharding.shard(documents).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    check_shards(rows, {r["doc_id"]: texts[r["doc_id"]] for r in rows})
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) - min(loads.values()) <= 0.02 * sum(loads.values()) / 8
    rows = sharding.shard(edge).collect()
    assert len(rows) == len(EDGE)
    check_shards(rows, {e[0]: e[1] or "" for e in EDGE})
    assert sharding.shard(empty).count() == 0


def check_shards(rows, texts):
    shards, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        shards[texts[r["doc_id"]]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in shards.values()) and set(slots) <= set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_longest_first_is_the_plain_schedule():
    sizes = [(i, int(s)) for i, s in enumerate(np.random.default_rng(1).integers(1, 50, 300))]
    loads, want = [0] * 5, {}
    for unit, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        shard = loads.index(min(loads))
        loads[shard] += size
        want[unit] = shard
    assert sharding.longest_first(sizes, 5) == want


def ids_of(texts):
    import public_tokenizers as vocabularies
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    return [e.ids + [1] for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens(spark):
    """Texts that hold the tokenizer's added token get its id there, as the plain tokenizer says."""
    texts = ["a <|endoftext|>b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y\n<|endoftext|>", "<|endoftext", "é <|endoftext|>漢 z", "  <|endoftext|>  "]
    rows = list(enumerate(texts))
    assert any(50256 in ids for ids in ids_of(texts))
    check_packing(pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def check_packing(rows, texts):
    """``texts``: (doc_id, text) of every packed row."""
    want = Counter()
    for (doc, _), ids in zip(texts, ids_of([t or "" for _, t in texts])):
        start = 0
        for size in packing.cuts(len(ids), packing.piece_sizes(2048)):
            own = np.array(ids[start : start + size], "<u4").tobytes()
            want[doc, start, size, zlib.crc32(own), len(ids)] += 1
            start += size
        assert start == len(ids)
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    return sum(r["length"] for r in rows), 2048 * len(sequences)


def test_packing(documents, texts):
    held, room = check_packing(pack_documents(documents).collect(), sorted(texts.items()))
    assert held > 0.97 * room


def test_packing_edges(spark, empty):
    rows = [e for e in EDGE if e[0] not in (9, 10)] + [
        (20, "a  b   c\n\n d \n\n e\t f   g  h \u0085i \x1c j  ", "en", "a", 1), (21, " ", "en", "a", 1), (22, "<|endoftext|> x", "en", "a", 1),
        (23, "日本語 　 テキスト \U0001f600 emoji", "ja", "a", 1), (24, "word " * 3000, "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check_packing(pack_documents(df).collect(), [(r[0], r[1]) for r in rows])
    assert pack_documents(empty).count() == 0


def test_units_of_a_text_are_encoded_as_the_whole(documents):
    rng = np.random.default_rng(3)
    marks = list(" \t\n\r \x1c\u0085ab,.'é9_<") + ["  ", " \n", "n't", "'s "]
    made = ["".join(rng.choice(marks, 40)) for _ in range(3000)]
    import public_tokenizers as vocabularies

    encoder = packing.Encoder(vocabularies.path("byte_bpe_50k.json"), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)
    for text, ids in zip(made, ids_of(made)):
        assert encoder.encode(text) == np.array(ids[:-1], "<u4").tobytes(), repr(text)


def test_usual_texts_are_encoded_whole(documents):
    """Nothing of them is remembered, whatever white space and signs they hold; longer ones give the same ids by their units."""
    rng = np.random.default_rng(4)
    marks = list(" \t\n\rab,.'é9_<|ÀɏZ") + ["  ", " \n", "\n ", "   ", "n't", "'s ", "word ", " word", "<|endoftext|>"]
    made = ["".join(rng.choice(marks, 60)) for _ in range(1000)] + ["", " ", "\n\n", " \t "]
    import public_tokenizers as vocabularies

    encoder = packing.Encoder(vocabularies.path("byte_bpe_50k.json"), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)
    encoder.known.clear()
    found = [encoder.encode(t) for t in made]
    assert not encoder.known
    assert found == [np.array(ids[:-1], "<u4").tobytes() for ids in ids_of(made)]
    long = "".join(made)
    assert len(long) * 8 > packing._WHOLE and encoder.encode(long * 8) == np.array(ids_of([long * 8])[0][:-1], "<u4").tobytes()


def test_pieces_have_reciprocal_sizes():
    sizes = packing.piece_sizes(2048)
    assert sizes[0] == 2048 and sizes[-1] == 1 and all(2048 - s * (2048 // s) < s for s in sizes)
    for n in (1, 2, 45, 1023, 2047, 2048, 5000):
        assert sum(packing.cuts(n, sizes)) == n and set(packing.cuts(n, sizes)) <= set(sizes)
