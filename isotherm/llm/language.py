"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams, by FTRL with elastic net."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.llm.batches import char_blocks, char_grams, row_blocks, texts_of
from isotherm.llm.tables import smallest_by_hash

BITS = 14
ORDERS = (1, 2, 3)
ROWS = 64  # texts whose dense counts are held at once


def gram_counts(batch: pa.RecordBatch) -> np.ndarray:
    """Counts of the hashed character n-grams of each text, lower-cased."""
    counts = np.zeros((batch.num_rows, 1 << BITS), np.float32)
    for codes, row, piece, own in char_blocks([t.lower() for t in texts_of(batch, "text")], max(ORDERS) - 1):
        for n in ORDERS:
            bucket, at = char_grams(codes, piece, own, n, BITS)
            counts += np.bincount(row[at] << BITS | bucket, minlength=counts.size).reshape(counts.shape)
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1; term frequencies enter by their square root."""
    x = np.sqrt(counts) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """IDF of each bucket over all of ``docs`` (text); a task hands on one row of 2 ** BITS counts."""

    def held(batches):
        seen, rows = np.zeros(1 << BITS, np.int64), 0
        for batch in row_blocks(batches, "text", most_rows=ROWS):
            seen += (gram_counts(batch) > 0).sum(0)
            rows += batch.num_rows
        yield pa.record_batch([pa.array(np.arange(1 << BITS)), pa.array(seen), pa.array(np.full(1 << BITS, rows))], names=["bucket", "n", "rows"])

    sums = docs.select("text").mapInArrow(held, "bucket long, n long, rows long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).collect()
    idf = np.ones(1 << BITS, np.float32)
    for r in sums:
        idf[r["bucket"]] = np.log((1 + r["rows"]) / (1 + r["n"])) + 1
    return idf


class Ftrl:
    """Follow the regularised leader (proximal) for a softmax over the languages; L1 and L2 per weight."""

    def __init__(self, size: int, classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = value[:, None] * (softmax(value @ w) - (np.arange(w.shape[1]) == label))
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(scores: np.ndarray, label: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm.

    The targets are smoothed as by one more row of each language, so rows that are all right don't cool it to 0.
    """
    spare = 1 / (len(label) + scores.shape[1])
    target = np.full(scores.shape, spare)
    target[np.arange(len(label)), label] += 1 - spare * scores.shape[1]
    loss = lambda t: -(target * np.log(softmax(scores / np.exp(t)) + 1e-300)).sum(1).mean()
    low, high, cut = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = high - cut * (high - low), low + cut * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, per_language: int = 800, epochs: int = 3):
    """``languages, idf, weights`` from ``docs`` (doc_id, text, lang), or None without a language.

    Fitted on the ``per_language`` documents of each language whose ids hash lowest (the bound of the sample; of rows
    that repeat a doc_id the smallest text counts); every fifth of them only sets the temperature. IDF is taken over all of ``docs``.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    idf = inverse_frequencies(known)
    some = smallest_by_hash(known.select("doc_id", "lang"), "doc_id", per_language, per="lang")

    def features(batches):
        for batch in row_blocks(batches, "text", most_rows=ROWS):
            x = weighted(gram_counts(batch), idf)
            at = [np.flatnonzero(r).astype(np.int32) for r in x]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("lang"), pa.array(at, pa.list_(pa.int32())), pa.array([r[a] for r, a in zip(x, at)], pa.list_(pa.float32()))],
                names=["doc_id", "lang", "at", "value"],
            )

    sample = known.select("doc_id", "lang", "text").join(F.broadcast(some), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = sample.mapInArrow(features, "doc_id long, lang string, at array<int>, value array<float>").toArrow()
    order = np.lexsort((rows.column("lang").to_numpy(), (rows.column("doc_id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64))) if rows.num_rows else []
    at = [np.asarray(x.values) for x in rows.column("at")]
    value = [np.asarray(x.values).astype(np.float64) for x in rows.column("value")]
    names = rows.column("lang").to_pylist()
    languages = sorted(set(names))
    if not languages:
        return None
    label = np.array([languages.index(n) for n in names])
    model = Ftrl(1 << BITS, len(languages))
    fit, test = [i for k, i in enumerate(order) if k % 5], [i for k, i in enumerate(order) if k % 5 == 0]
    for _ in range(epochs):
        for i in fit or order:
            model.learn(at[i], value[i], label[i])
    weights = model.weights()
    heat = temperature(np.array([value[i] @ weights[at[i]] for i in test]), label[test])
    return languages, idf, (weights / heat).astype(np.float32)


def keep_known(docs: DataFrame, least_score: float, per_language: int = 800) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with ``least_score`` or more, with all their columns.

    Learned from those of its rows that have a lang. Rows that ``identify`` calls ``und`` go; where no language
    could be learned, all rows with a letter stay.
    """
    model = train(docs.select(F.col("doc_id").cast("long"), "text", "lang"), per_language)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        known = sent.value
        for batch in row_blocks(batches, "text", most_rows=ROWS):
            stay = np.array([has_letter(t) for t in batch.column("text").to_pylist()], bool)
            if known:
                _, idf, weights = known
                stay &= softmax((weighted(gram_counts(batch), idf) @ weights).astype(np.float64)).max(1) >= least_score
            yield batch.filter(pa.array(stay))

    return docs.mapInArrow(keep, docs.schema)


def identify(docs: DataFrame, learn_from: Column, per_language: int = 800) -> DataFrame:
    """``docs`` (doc_id, text, lang) with ``lang_pred`` and the calibrated probability ``score`` of that language.

    Learned from the rows where ``learn_from`` holds and lang is not null; a prediction sees the text alone. A text
    that is null or has no letter is ``und`` with score 0, and so is every text where no language could be learned.
    Repeated rows are each predicted. Columns other than doc_id and text are left out.
    """
    model = train(docs.where(learn_from).select(F.col("doc_id").cast("long"), "text", "lang"), per_language)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS rows of weights

    def predict(batches):
        known = sent.value
        for batch in row_blocks(batches, "text", most_rows=ROWS):
            name, score = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            if known:
                languages, idf, weights = known
                p = softmax((weighted(gram_counts(batch), idf) @ weights).astype(np.float64))
                for i, text in enumerate(batch.column("text").to_pylist()):
                    if has_letter(text):
                        best = int(p[i].argmax())
                        name[i], score[i] = languages[best], float(p[i, best])
            yield pa.record_batch([*batch.columns, pa.array(name), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, "doc_id long, text string, lang_pred string, score double")
