"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.llm.batches import WordHasher, row_blocks
from isotherm.llm.quality_rules import BITS, families, platt
from isotherm.llm.tables import smallest_by_hash, staged

FEATURES = 2 << BITS  # buckets of both families
LEAST_SHARE = 1e-3  # added to every bucket's sum of shares


def held(batch: pa.RecordBatch, hasher: WordHasher):
    """``bucket, row, family`` of the hashed character n-grams (0) and words and word pairs (1), in blocks."""
    for family, bucket, row in families(batch, hasher):
        yield bucket + (family << BITS), row, family


def labelled(docs: DataFrame, labels: DataFrame, most_labels: int) -> DataFrame:
    """``y, text, part`` of the sample: the ``most_labels`` labelled documents whose ids hash lowest.

    Null and contradicting labels are left out. Of rows that repeat a doc_id the smallest text counts. Every fifth document (part 4) only calibrates.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
        .agg(F.min("quality").alias("y"), F.max("quality").alias("_y")).where("y = _y").select("doc_id", "y")
    )
    some = smallest_by_hash(known, "doc_id", most_labels)
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return staged(sample.select("y", "text", F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("part")), "sample")


def evidence_weights(sample: DataFrame) -> np.ndarray | None:
    """Log odds of each bucket between good and bad documents of the sample (y, text); None without both classes.

    Every document's features count as shares, so a long one weighs as much as a short one.
    """

    def shares(batches):
        hasher, total, seen = WordHasher(), np.zeros((2, FEATURES)), np.zeros(2, np.int64)
        for batch in row_blocks(batches, "text", most_rows=64):
            y = (batch.column("y").to_numpy() > 0).astype(np.int64)
            counts = np.zeros((batch.num_rows, FEATURES), np.float32)
            for bucket, row, _ in held(batch, hasher):
                counts += np.bincount(row * FEATURES + bucket, minlength=counts.size).reshape(counts.shape)
            for part in (counts[:, : 1 << BITS], counts[:, 1 << BITS :]):
                part /= np.maximum(part.sum(1, keepdims=True), 1)
            for k in (0, 1):
                total[k] += counts[y == k].sum(0, dtype=np.float64)
            seen += np.bincount(y, minlength=2)
        for k in (0, 1):
            at = np.flatnonzero(total[k])
            yield pa.record_batch([pa.array(np.full(len(at) + 1, k)), pa.array(np.append(at, -1)), pa.array(np.append(total[k][at], seen[k]))], names=["y", "bucket", "n"])

    sums = sample.mapInArrow(shares, "y long, bucket long, n double").groupBy("y", "bucket").agg(F.sum(F.round("n", 6).cast("decimal(20,6)")).alias("n")).collect()
    total, seen = np.zeros((2, FEATURES)), np.zeros(2)
    for r in sums:
        if r["bucket"] < 0:
            seen[r["y"]] = r["n"]
        else:
            total[r["y"], r["bucket"]] = r["n"]
    if not seen.all():
        return None
    odds = []
    for family in (total[:, : 1 << BITS], total[:, 1 << BITS :]):
        rate = (family + LEAST_SHARE) / (family.sum(1, keepdims=True) + LEAST_SHARE * (1 << BITS))
        odds.append(np.log(rate[1] / rate[0]))
    return np.concatenate(odds).astype(np.float32)


def raw_evidence(batch: pa.RecordBatch, hasher: WordHasher, weights: np.ndarray) -> np.ndarray:
    """Mean log odds of each family, added up."""
    total, count = np.zeros((2, batch.num_rows)), np.zeros((2, batch.num_rows))
    for bucket, row, family in held(batch, hasher):
        total[family] += np.bincount(row, weights[bucket], batch.num_rows)
        count[family] += np.bincount(row, minlength=batch.num_rows)
    return (total / np.maximum(count, 1)).sum(0)


def calibration(sample: DataFrame, weights: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn the mean log odds into calibrated log odds, from rows left out of the weights."""

    def raw(batches):
        hasher = WordHasher()
        for batch in row_blocks(batches, "text"):
            yield pa.record_batch([pa.array(raw_evidence(batch, hasher, weights)), batch.column("y")], names=["z", "y"])

    rows = sorted((r["z"], float(r["y"] > 0)) for r in sample.select("y", "text").mapInArrow(raw, "z double, y int").collect())
    z, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    return platt(z, y) if len(set(y)) == 2 else (1.0, 0.0)


def evidence(docs: DataFrame, weights: np.ndarray, slope: float, cut: float, host: str, path: str) -> DataFrame:
    """``doc_id, host, path, logit``: the calibrated log odds that the text alone gives; those of a text without words are ``cut``."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches):
        hasher, known = WordHasher(), sent.value
        for batch in row_blocks(batches, "text"):
            logit = np.clip(slope * raw_evidence(batch, hasher, known) + cut, -12, 12)
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "host", "path")), pa.array(logit)], names=["doc_id", "host", "path", "logit"])

    columns = docs.select(F.col("doc_id").cast("long"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "text")
    return columns.mapInArrow(score, "doc_id long, host string, path string, logit double")


def shrunk(groups: DataFrame, n: str, s: str, prior: Column, rate: str) -> DataFrame:
    """Posterior mean of each group's rate: its own sum ``s`` of ``n`` chances, shrunk towards ``prior``.

    The strength of the prior (in documents) is the same for all groups, estimated by moments: what the groups'
    rates vary beyond what chance within a group explains.
    """
    chance = prior * (1 - prior)
    m = groups.where(F.col(n) > 1).agg(
        F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - prior, 2)).alias("between"), F.sum(chance).alias("within"),
        F.sum(F.col(n) * chance).alias("chance"), F.sum(n).alias("n"),
    ).first()
    strength = 1e6
    if m["n"]:
        # E[between] = within + variance * n, and variance = mean chance / (strength + 1)
        variance = max((m["between"] - m["within"]) / m["n"], 1e-9)
        strength = min(max(m["chance"] / m["n"] / variance - 1, 1.0), 1e6)
    return groups.withColumn(rate, (F.col(s) + F.lit(strength) * prior) / (F.col(n) + F.lit(strength)))


def classify(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep_from: float = 0.5,
    most_labels: int = 5000,
) -> DataFrame:
    """Probability of good quality for each row of ``docs`` (doc_id, text, and its site in ``host`` and ``path``).

    Three levels: all documents, hosts, paths of a host. A level's posterior rate shrinks towards that of the level
    above, the more the fewer documents it has. A document's log odds are those of its text plus the log odds of its path against
    those of all documents. A null host or path counts as an empty one, a null text gives no evidence; repeated
    rows are documents of their own. Without labels of both classes all probabilities are null and all rows kept.
    """
    sample = labelled(docs, labels, most_labels)
    weights = evidence_weights(sample.where("part <> 4"))
    if weights is None:
        null = F.lit(None).cast("double")
        return docs.select(
            F.col("doc_id").cast("long"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"),
            null.alias("p_text"), null.alias("host_rate"), null.alias("path_rate"), null.alias("p_good"), F.lit(True).alias("kept"),
        )
    slope, cut = calibration(sample.where("part = 4"), weights)
    scored = staged(evidence(docs, weights, slope, cut, host, path), "evidence")
    p = 1 / (1 + F.exp(-F.col("logit")))
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("_n"), F.sum(F.round(p, 9).cast("decimal(20,9)")).cast("double").alias("_s"))
    paths = staged(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("_n").alias("_hn"), F.sum("_s").alias("_hs"))
    everywhere = F.lit(paths.agg(F.sum("_s") / F.sum("_n")).first()[0] or 0.5)
    hosts = shrunk(hosts, "_hn", "_hs", everywhere, "host_rate")
    rates = shrunk(paths.join(hosts, "host"), "_n", "_s", F.col("host_rate"), "path_rate")
    rates = staged(rates.select("host", "path", "host_rate", "path_rate"), "rates")
    odds = lambda c: F.log(F.greatest(c, F.lit(1e-6)) / F.greatest(1 - c, F.lit(1e-6)))
    return (
        scored.join(rates, ["host", "path"])
        .withColumn("p_good", 1 / (1 + F.exp(-(F.col("logit") + odds(F.col("path_rate")) - odds(everywhere)))))
        .select("doc_id", "host", "path", p.alias("p_text"), "host_rate", "path_rate", "p_good", (F.col("p_good") >= keep_from).alias("kept"))
    )
