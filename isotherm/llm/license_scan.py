"""License scans: a positional index of rare licence words, intersected by relative position, then key phrases verified."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.batches import bytes_of, row_blocks, word_pieces

# Phrases whose places are counted, and their labels.
BASE = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

# Label -> (opening words of the licence or its notice, phrases that must stand in it).
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    "apache-2": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license", "in compliance with the license"]),
    "gpl": ("this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    "gpl-2": ("gnu general public license version 2 or at your option any later version", ["gnu general public license version 2"]),
    "gpl-3": ("licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    "lgpl": ("licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    "agpl": ("licensed under the gnu affero general public license", ["gnu affero general public license"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "following conditions are met"]),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["distribute this software for any purpose with or without fee"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    "cc-by": ("licensed under a creative commons attribution 4 0 international license", ["creative commons attribution", "international license"]),
    "cc-by-sa": ("licensed under cc by sa 4 0", ["cc by sa"]),
    "cc-by-nc-4": ("licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    "cc0": ("the person who associated a work with this deed has dedicated the work to the public domain", ["dedicated the work to the public domain"]),
    "all-rights-reserved": ("all rights reserved", ["all rights reserved"]),
}

_NO_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all other non-ASCII characters."""
    return text.translate(_NO_WORD).split()


def corpus_counts(docs: DataFrame, vocabulary: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and in how many each licence word stands; over all documents.

    The vocabulary is fixed, so a task hands on one row per licence word and block.
    """

    def count(batches):
        for batch in row_blocks(batches, "text"):
            held, rows = Counter(), 0
            for text in bytes_of(batch, "text"):
                rows += 1
                held.update(vocabulary & set().union(*(words_of(p) for p in word_pieces(text))))
            items = [*held.items(), (b"", rows)]
            yield pa.record_batch([pa.array([w.decode() for w, _ in items]), pa.array([n for _, n in items], pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}
    return found.pop(b"", 0), found


class PositionalIndex:
    """Postings (rule, position) of the rare words of each rule.

    A rule is a run of words with phrases that must stand in it. Indexed are the rarest word of every phrase,
    without which no match can be verified, and the ``rare`` rarest words of the run, which vote for its place.
    """

    def __init__(self, rules: list[tuple[str, list[bytes], list[list[bytes]], bool]], idf: dict[bytes, float], rare: int = 4, slack: int = 3):
        self.rules, self.idf, self.slack = rules, idf, slack
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.anchors: dict[bytes, list[tuple[int, int, int]]] = defaultdict(list)
        self.weight = []
        for r, (_, run, phrases, _) in enumerate(rules):
            rank = sorted(range(len(run)), key=lambda i: (-idf[run[i]], i))[:rare]
            for i in rank:
                self.postings[run[i]].append((r, i))
            self.weight.append(sum(idf[run[i]] for i in rank))
            for p, phrase in enumerate(phrases):
                i = max(range(len(phrase)), key=lambda i: (idf[phrase[i]], -i))
                self.anchors[phrase[i]].append((r, p, i))
        self.words = frozenset(self.postings) | frozenset(self.anchors)

    def look_up(self, words: list[bytes]) -> tuple[list[int], set[str], dict[str, float]]:
        """Starts and labels of all base phrases, and each label found with the share of its rare words in place."""
        hits = [(i, w) for i, w in enumerate(words) if w in self.words]
        if not hits:
            return [], set(), {}
        verified: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, w in hits:
            for r, p, k in self.anchors.get(w, ()):
                phrase = self.rules[r][2][p]
                if i >= k and words[i - k : i - k + len(phrase)] == phrase:
                    verified[r][p].append(i - k)
        whole = {r for r in verified if len(verified[r]) == len(self.rules[r][2])}
        places, named, labels = [], set(), {}
        votes: dict[int, dict[int, dict[int, float]]] = defaultdict(lambda: defaultdict(dict))
        for i, w in hits:
            for r, k in self.postings.get(w, ()):
                if r in whole:
                    votes[r][i - k][k] = self.idf[w]
        for r in whole:
            label, _, _, base = self.rules[r]
            best = 0.0
            for offset in votes[r]:
                seen: dict[int, float] = {}
                for near in range(offset - self.slack, offset + self.slack + 1):
                    seen.update(votes[r].get(near, {}))
                best = max(best, sum(seen.values()) / self.weight[r])
            if base:
                places += verified[r][0]
                named.add(label)
            if base or best >= 0.5:
                labels[label] = max(labels.get(label, 0.0), 1.0 if base else best)
        return places, named, labels


def scan(docs: DataFrame, templates: dict = TEMPLATES, base: dict = BASE, rare: int = 4) -> DataFrame:
    """For each row of ``docs`` (doc_id, text) the licences it names, with the places of the base phrases.

    A template counts where all its phrases stand in the text and at least half of the weight of its rare words
    stands at one relative position. The weight of a word is its inverse document frequency over all of ``docs``.
    A null or empty text has no words and no labels (an empty string). Repeated rows are each scanned.
    """
    split = lambda s: s.encode().split()
    rules = [(label, split(p), [split(p)], True) for label, p in base.items()]
    rules += [(label, split(run), [split(p) for p in phrases], False) for label, (run, phrases) in templates.items()]
    vocabulary = {w for _, run, phrases, _ in rules for w in [*run, *(x for p in phrases for x in p)]}
    total, counts = corpus_counts(docs, vocabulary)
    idf = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1e-3 for w in vocabulary}
    index = PositionalIndex(rules, idf, rare)  # as small as the rules

    def find(batches):
        for batch in row_blocks(batches, "text"):
            out = []
            for text in bytes_of(batch, "text"):
                words: list[bytes] = []
                for piece in word_pieces(text):
                    words += words_of(piece)
                places, named, labels = index.look_up(words)
                out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(named)), ",".join(sorted(labels)), max(labels.values(), default=0.0)))
            columns = list(zip(*out))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", *names])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, schema)
