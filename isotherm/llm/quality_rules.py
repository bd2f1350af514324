"""Quality rules: base counts, and a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.batches import WordHasher, bytes_of, char_blocks, char_grams, mix, row_blocks
from isotherm.llm.tables import smallest_by_hash

BITS = 15  # buckets of each of the two feature families
ORDERS = (1, 2, 3)  # character n-grams
SCALE = 30.0
SYMBOLS = b"#*$%&|<>"


def word_grams(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of all texts, and their texts; pairs of a word with itself share a bucket."""
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    with np.errstate(over="ignore"):
        pair = np.where(h[:-1] == h[1:], np.uint64(0), mix(h[:-1] * np.uint64(3) + h[1:]))
    same = row[:-1] == row[1:]
    shift = np.uint64(64 - BITS)
    return (
        np.concatenate([h >> shift, pair[same] >> shift]).astype(np.int64),
        np.concatenate([row, row[:-1][same]]),
    )


def families(batch: pa.RecordBatch, hasher: WordHasher):
    """``family, buckets, rows`` in blocks: 0 character n-grams, 1 words and word pairs."""
    data = bytes_of(batch, "text")
    h, ends = hasher.words(data)
    if len(h):
        yield 1, *word_grams(h, ends)
    for codes, row, piece, own in char_blocks([t.decode() for t in data], max(ORDERS) - 1):
        for n in ORDERS:
            bucket, at = char_grams(codes, piece, own, n, BITS)
            yield 0, bucket, row[at]


def mean_weights(batch: pa.RecordBatch, hasher: WordHasher, weights: np.ndarray) -> np.ndarray:
    """For each text the mean weight of its features, summed over the two families."""
    total, count = np.zeros((2, batch.num_rows)), np.zeros((2, batch.num_rows))
    for family, bucket, row in families(batch, hasher):
        total[family] += np.bincount(row, weights[family][bucket], batch.num_rows)
        count[family] += np.bincount(row, minlength=batch.num_rows)
    return (total / np.maximum(count, 1)).sum(0)


def base_counts(data: list[bytes], h: np.ndarray, ends: np.ndarray, space: np.ndarray) -> dict[str, list[int]]:
    """Word, symbol and repetition counts of whole texts."""
    rows = len(data)
    row = np.repeat(np.arange(rows), np.diff(ends))
    repeated = np.zeros(rows, np.int64)
    if len(h) > 2:
        with np.errstate(over="ignore"):
            window = mix(mix(h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:]) ^ mix(row[:-2].astype(np.uint64))
        at = np.flatnonzero(row[:-2] == row[2:])
        order = at[np.argsort(window[at], kind="stable")]
        same = window[order][1:] == window[order][:-1]
        found = np.zeros(len(h), bool)
        for k in range(3):
            found[order[1:][same] + k] = True
            found[order[:-1][same] + k] = True
        repeated = np.bincount(row[found], minlength=rows)
    chars, symbols, lines = [], [], []
    for text in data:
        codes = np.frombuffer(text, np.uint8)
        chars.append(int(np.count_nonzero(~space[codes] & ((codes & 0xC0) != 0x80))))
        symbols.append(sum(text.count(s) for s in SYMBOLS))
        held = [line for line in text.split(b"\n") if line.strip()]
        lines.append(len(held) - len(set(held)))
    return {
        "n_words": np.diff(ends).tolist(), "word_chars": chars, "n_symbols": symbols,
        "n_dup_lines": lines, "n_repeat_words": repeated.tolist(),
    }


def feature_rows(docs: DataFrame) -> DataFrame:
    """Sparse features of labelled rows: buckets of both families with their shares."""

    def features(batches):
        hasher = WordHasher()
        for batch in row_blocks(batches, "text", most_rows=128):
            counts = np.zeros((batch.num_rows, 2 << BITS), np.float32)
            for family, bucket, row in families(batch, hasher):
                part = counts[:, family << BITS : (family + 1) << BITS]
                part += np.bincount(row << BITS | bucket, minlength=batch.num_rows << BITS).reshape(part.shape)
            for family in (0, 1):
                part = counts[:, family << BITS : (family + 1) << BITS]
                part /= np.maximum(part.sum(1, keepdims=True), 1)
            at = [np.flatnonzero(c) for c in counts]
            yield pa.record_batch(
                [batch.column("y"), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())),
                 pa.array([c[a] for c, a in zip(counts, at)], pa.list_(pa.float32()))],
                names=["y", "at", "share"],
            )

    return docs.select("y", "text").mapInArrow(features, "y int, at array<int>, share array<float>")


class Logistic:
    """Full-batch logistic regression (momentum on the gradient, L2), then Platt calibration on rows left out."""

    def __init__(self, steps: int = 150, rate: float = 0.1, l2: float = 1e-3):
        self.steps, self.rate, self.l2 = steps, rate, l2

    def fit(self, at: list[np.ndarray], share: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float, float]:
        """Weights, and slope and intercept of the calibration; every fifth row only calibrates."""
        test = np.arange(len(y)) % 5 == 4
        weights, bias = self._weights([a for a, t in zip(at, test) if not t], [s for s, t in zip(share, test) if not t], y[~test])
        raw = np.array([weights[a] @ (s * SCALE) + bias for a, s in zip(at, share)])
        fit = test if len(set(y[test])) == 2 else np.ones(len(y), bool)
        slope, cut = platt(raw[fit], y[fit])
        return weights * SCALE * slope, bias * slope + cut, slope

    def _weights(self, at, share, y) -> tuple[np.ndarray, float]:
        size = 2 << BITS
        row = np.repeat(np.arange(len(y)), [len(a) for a in at])
        index, value = np.concatenate(at).astype(np.int64), np.concatenate(share).astype(np.float64) * SCALE
        balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        weights, bias, speed, push = np.zeros(size), 0.0, np.zeros(size), 0.0
        for _ in range(self.steps):
            ahead = weights + 0.9 * speed
            z = np.bincount(row, ahead[index] * value, len(y)) + bias + 0.9 * push
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance / len(y)
            grad = np.bincount(index, error[row] * value, size) + self.l2 * ahead
            speed, push = 0.9 * speed - self.rate * grad, 0.9 * push - self.rate * error.sum()
            weights, bias = weights + speed, bias + push
        return weights, bias


def platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that make ``raw`` a calibrated logit, with Platt's smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    middle, width = raw.mean(), max(raw.std(), 1e-9)
    x = np.stack([(raw - middle) / width, np.ones(len(raw))], 1)
    loss = lambda w: np.logaddexp(0, x @ w).sum() - target @ (x @ w) + 1e-6 * w @ w
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slant = x.T @ (p - target) + 2e-6 * w
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), slant)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    slope = max(w[0] / width, 1e-6)
    return float(slope), float(w[1] - slope * middle)


def train(docs: DataFrame, labels: DataFrame, most_labels: int = 5000):
    """Fit on the ``most_labels`` labelled documents whose ids hash lowest (the bound of the sample).

    Labels that are null or that contradict each other are left out. Of rows that repeat a doc_id the smallest text
    counts. None without both classes.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
        .agg(F.min("quality").alias("y"), F.max("quality").alias("_y")).where("y = _y").select("doc_id", "y")
    )
    some = smallest_by_hash(known, "doc_id", most_labels)
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = feature_rows(sample).toArrow()
    y = np.array(rows.column("y").to_pylist(), np.float64)
    if len(set(y)) < 2:
        return None
    pick = lambda name: [np.asarray(x.values) for x in rows.column(name)]
    at, share = pick("at"), pick("share")
    order = np.lexsort(([a[0] if len(a) else -1 for a in at], [len(a) for a in at], y))  # the same whatever task ends first
    weights, bias, _ = Logistic().fit([at[i] for i in order], [share[i] for i in order], y[order])
    return weights.astype(np.float32).reshape(2, -1), bias


def judge(docs: DataFrame, labels: DataFrame, keep_from: float = 0.5, least_words: int = 50, repeat_percent: int = 50, most_labels: int = 5000) -> DataFrame:
    """Counts, base verdict and calibrated probability of good quality for each row of ``docs`` (doc_id, text).

    A null or empty text has no words and fails the base rules. Repeated rows are each judged. Without labels of
    both classes the probability is null and the base rules decide alone.
    """
    model = train(docs, labels, most_labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two tables of 2 ** BITS weights

    def score(batches):
        hasher, known = WordHasher(), sent.value
        for batch in row_blocks(batches, "text"):
            data = bytes_of(batch, "text")
            h, ends = hasher.words(data)
            base = base_counts(data, h, ends, hasher.space)
            if known is None:
                p = [None] * batch.num_rows
            else:
                p = (1 / (1 + np.exp(-np.clip(mean_weights(batch, hasher, known[0]) + known[1], -30, 30)))).tolist()
            yield pa.record_batch([batch.column("doc_id"), *map(pa.array, base.values()), pa.array(p, pa.float64())], names=["doc_id", *base, "p_good"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, p_good double"
    failed = (F.col("n_words") < least_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(repeat_percent) * F.col("n_words"))
    return (
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, schema)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("p_good", F.lit(1.0)) >= keep_from))
    )
