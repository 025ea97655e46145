"""Exact Shapley contributions of boosted trees."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A leaf's value, or a split: rows up to ``limit`` of ``feature`` go left, where ``share`` of the training rows went."""

    value: float = 0.0
    feature: int = -1
    limit: float = 0.0
    share: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def features(self) -> set[int]:
        return set() if self.left is None else {self.feature} | self.left.features() | self.right.features()

    def expected(self, x: np.ndarray, known: frozenset[int]) -> np.ndarray:
        """The value for each row of ``x`` if only the ``known`` features are; others go both ways, by shares."""
        if self.left is None:
            return np.full(len(x), self.value)
        a, b = self.left.expected(x, known), self.right.expected(x, known)
        if self.feature in known:
            return np.where(x[:, self.feature] <= self.limit, a, b)
        return self.share * a + (1 - self.share) * b


def trees_of(model: object) -> list[tuple[float, Node]]:
    """(weight, root) of a boosted Spark model's trees."""

    def read(node: object) -> Node:
        if node.getClass().getSimpleName().startswith("Leaf"):
            return Node(value=float(node.prediction()))
        left, right = node.leftChild(), node.rightChild()
        a, b = float(left.impurityStats().count()), float(right.impurityStats().count())
        return Node(feature=int(node.split().featureIndex()), limit=float(node.split().threshold()), share=a / (a + b), left=read(left), right=read(right))

    return [(float(w), read(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees, strict=True)]


def contributions(trees: list[tuple[float, Node]], x: np.ndarray) -> tuple[float, np.ndarray]:
    """The base value and each feature's share of each row's margin; together they are the margin.

    A tree of few levels has few features, so all their subsets are tried: no sampling.
    """
    out, base = np.zeros(x.shape), 0.0
    for weight, root in trees:
        own = sorted(root.features())
        n = len(own)
        subsets = [frozenset(f for k, f in enumerate(own) if m >> k & 1) for m in range(1 << n)]
        values = {s: root.expected(x, s) for s in subsets}
        base += weight * float(root.expected(x[:1] if len(x) else np.zeros((1, x.shape[1])), frozenset())[0])
        for s in subsets:
            for f in own:
                if f not in s:
                    share = math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n)
                    out[:, f] += weight * share * (values[s | {f}] - values[s])
    return base, out


def top_contributions(rows: DataFrame, trees: list[tuple[float, Node]], features: tuple[str, ...], limit: int = 4) -> DataFrame:
    """(site, rank, feature, value, contribution) of ``rows`` (site, features): the ``limit`` largest by size, ties in the features' order."""
    names = np.array(features)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = f[list(features)].to_numpy(float)
            shares = contributions(trees, x)[1]
            top = np.argsort(-np.abs(np.round(shares, 4)), axis=1, kind="stable")[:, :limit]
            at = np.arange(len(x))[:, None]
            yield pd.DataFrame(
                {
                    "site": np.repeat(f["site"].to_numpy(), top.shape[1]),
                    "rank": np.tile(np.arange(1, top.shape[1] + 1), len(x)),
                    "feature": names[top].ravel(),
                    "value": np.round(x[at, top].ravel(), 3),
                    "contribution": np.round(shares[at, top].ravel(), 4),
                }
            )

    schema = "site long, rank int, feature string, value double, contribution double"
    return rows.select("site", *[F.col(c).cast("double") for c in features]).mapInPandas(run, schema)
