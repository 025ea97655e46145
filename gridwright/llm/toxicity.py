"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import made_way, pieces, sample_below, widened

#: Hash bits of the features; labelled documents of a class that the fit takes at most; documents of a
#: shard; passes over it; the learning rate's alpha and beta; L1 by the root of the shard's documents,
#: as sums of chance gradients grow; L2.
BITS = 20
MAX_DOCS_PER_CLASS = 8000
SHARD_DOCS = 8000
PASSES = 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.2, 0.01

#: A-Z to a-z, other ASCII but digits and letters to a space; other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


class Features:
    """Distinct hashed features of a text: words, pairs of neighbours and pairs with one word between."""

    def __init__(self, bits: int = BITS) -> None:
        self.shift = np.uint64(64 - bits)

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().translate(_FOLD).split()
        if not words:
            return np.zeros(0, np.int64)
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        parts = [h * _A, (h[:-1] * _B) ^ (h[1:] * _C), (h[:-2] * _C) ^ (h[2:] * _D)]
        return np.unique((np.concatenate(parts) * _A) >> self.shift).astype(np.int64)


def ftrl(features: list[np.ndarray], labels: list[int], bits: int, passes: int = PASSES, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """Weights and summed squared gradients after ``passes`` of FTRL-proximal; the last place is the bias (without L1)."""
    size = 1 << bits
    z, n, l1 = np.zeros(size + 1), np.zeros(size + 1), l1 * len(labels) ** 0.5

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        least = np.where(at == size, 0.0, l1)
        return np.where(np.abs(zi) <= least, 0.0, -(zi - np.sign(zi) * least) / ((beta + np.sqrt(n[at])) / alpha + l2))

    whole = [np.append(x, size) for x in features]
    for _ in range(passes):
        for at, y in zip(whole, labels, strict=True):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    return weights(np.arange(size + 1)), n


def learn(labelled: DataFrame, bits: int = BITS, shard_docs: int = SHARD_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the features, from ``labelled`` (doc_id, text, toxic); the last is the bias.

    ``labelled`` is a bounded sample (see ``sampled``), dealt by a hash of the id over shards of about
    ``shard_docs`` that learn side by side; their weights are averaged by each coordinate's squared
    gradients. At most 2**``bits`` weights a shard are gathered, far fewer as L1 sets most to 0. The
    bias is moved to even odds of both classes, as label 1 is rare. Texts of any length become features
    where they lie; only those are dealt. Rows with a null id, text or label don't count, repeated rows
    count each. Without rows every score is 0.5.
    """
    known = labelled.where("doc_id is not null and text is not null and toxic in (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    of = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    shards = max(1, -(-sum(of.values()) // shard_docs))
    even = math.log(of[0] / of[1]) if len(of) == 2 else 0.0

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for part in pieces(batches):
            found = [features.of(t).astype(np.int32) for t in part.column(0).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([lists, part.column(1), part.column(2)], ["features", "toxic", "turn"])

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("turn", kind="stable")
        w, n = ftrl([np.asarray(x, np.int64) for x in frame["features"]], frame["toxic"].tolist(), bits)
        at = np.flatnonzero((w != 0) | (np.arange(len(w)) == 1 << bits))
        seen = n[at]
        return pd.DataFrame({"at": at.astype(np.int64), "w": w[at] * seen, "n": seen})

    merged = (
        known.select("text", "toxic", F.xxhash64("doc_id", F.lit(7)).alias("turn"))
        .mapInArrow(hashed, "features array<int>, toxic int, turn long")
        .withColumn("shard", F.pmod("turn", F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(fit, "at long, w double, n double")
        .groupBy("at")
        .agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
        .toPandas()
        .sort_values("at")
    )
    at, weights = merged["at"].to_numpy(np.int64), (merged["w"] / merged["n"].clip(lower=1e-12)).to_numpy(np.float64)
    return at, np.where(at == 1 << bits, weights + even, weights)


def sampled(labels: DataFrame, max_docs: int = MAX_DOCS_PER_CLASS) -> DataFrame:
    """About ``max_docs`` ids of each class of ``labels`` (doc_id, toxic), by a hash of the id; one label an id, 1 before 0."""
    one = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = one.groupBy("toxic").agg(F.least(F.lit(1.0), F.lit(float(max_docs)) / F.count("*")).alias("share"))
    return one.join(F.broadcast(share), "toxic").where(sample_below(F.col("doc_id"), F.col("share"))).select("doc_id", "toxic")


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` with score (0 to 1) and predicted (1 from 0.5).

    Whole texts of any length; null and empty texts have the bias's score, repeated rows one each. A
    column of ``docs`` called score or predicted comes back as _score or _predicted. An empty table
    gives an empty result.
    """
    weights = np.zeros((1 << bits) + 1, np.float32)
    weights[model[0]] = model[1]
    at = np.flatnonzero(weights).astype(np.int32)
    sparse = docs.sparkSession.sparkContext.broadcast((at, weights[at]))
    docs = made_way(docs, ("score", "predicted"))
    text_at, names = docs.columns.index("text"), [*docs.columns, "score", "predicted"]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << bits) + 1, np.float32)
        dense[sparse.value[0]] = sparse.value[1]
        hashed = Features(bits)
        for batch in pieces(batches):
            sums = np.array([float(dense[hashed.of(t)].sum()) for t in batch.column(text_at).to_pylist()]) + float(dense[-1])
            p = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names)

    return docs.mapInArrow(label, widened(docs, "score double, predicted int"))
