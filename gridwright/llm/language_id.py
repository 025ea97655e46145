"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.common import made_way, pieces, sample_below, widened

#: Longest n-gram, n-grams of a profile, labelled documents that a profile learns from at most, and
#: languages at most; the last two bound what is gathered and broadcast.
MAX_N = 4
PROFILE_SIZE = 400
MAX_DOCS_PER_LANG = 2000
MAX_LANGS = 1000

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_EDGE = ord("_")
_SLICE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _grams(text: str, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the 1- to ``max_n``-grams of the words of ``text``, each word between edges.

    A gram has an edge only as its first or last sign. Long texts go slice by slice.
    """
    folded = "_" + _NOT_LETTERS.sub("_", text.lower()).strip("_") + "_"
    codes = np.frombuffer(folded.encode("utf-32-le"), dtype=np.uint32)
    keys, counts = [], []
    for start in range(0, len(codes), _SLICE):
        part = codes[start : start + _SLICE + max_n - 1]
        wide, inner, here = part.astype(np.uint64), part != _EDGE, min(_SLICE, len(part))
        found, value, ok = [], np.zeros(len(part), np.uint64), np.ones(len(part), bool)
        for n in range(1, max_n + 1):
            size = len(part) - n + 1
            if size <= 0:
                break
            value = (value[:size] + wide[n - 1 :]) * _MIX
            value ^= value >> np.uint64(29)
            if n > 2:
                ok = ok[:size] & inner[n - 2 : n - 2 + size]
            take = ok[: min(size, here)] & (inner[: min(size, here)] if n == 1 else True)
            if n == 2:
                take = take & (inner[: min(size, here)] | inner[1 : 1 + min(size, here)])
            found.append(value[: min(size, here)][take] + np.uint64(n))
        k, c = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keys.append(k)
        counts.append(c)
    if len(keys) == 1:
        return keys[0], counts[0]
    all_keys, place = np.unique(np.concatenate(keys), return_inverse=True)
    return all_keys, np.bincount(place, np.concatenate(counts), len(all_keys)).astype(np.int64)


def _ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent keys, most frequent first, ties by hash."""
    if len(keys) > size:
        least = np.partition(counts, -size)[-size]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))][:size]


def learn_profiles(
    labelled: DataFrame,
    max_n: int = MAX_N,
    size: int = PROFILE_SIZE,
    max_docs: int = MAX_DOCS_PER_LANG,
) -> dict[str, np.ndarray]:
    """The profile of each language in ``labelled`` (doc_id, text, lang): hashes of its n-grams by rank.

    Learns from about ``max_docs`` documents of a language, dealt by a hash of their id. Rows with a
    null lang, id or text don't count. The result has at most ``MAX_LANGS`` x ``size`` hashes; more
    languages raise a ValueError.
    """
    known = labelled.where("lang is not null and doc_id is not null and text is not null").select("doc_id", "text", "lang")
    shares = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(max_docs)) / F.count("*")).alias("share")).limit(MAX_LANGS + 1).collect()
    if len(shares) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} values of lang: profiles are held in memory")
    shares = labelled.sparkSession.createDataFrame(shares, known.select("lang", F.lit(1.0).alias("share")).schema)
    sample = known.join(F.broadcast(shares), "lang").where(sample_below(F.col("doc_id"), F.col("share"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            parts: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.setdefault(lang, []).append(_grams(text, max_n))
            for lang, found in parts.items():
                keys, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                n = np.bincount(place, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    grams = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = grams.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    profiles: dict[str, list] = {}
    for row in sorted(top.collect(), key=lambda r: (r.lang, r.rank)):
        profiles.setdefault(row.lang, []).append(row.gram)
    return {lang: np.array(v, np.int64).view(np.uint64) for lang, v in profiles.items()}


class Ranker:
    """Out-of-place distances of texts to profiles."""

    def __init__(self, profiles: dict[str, np.ndarray], max_n: int = MAX_N, size: int = PROFILE_SIZE) -> None:
        self.langs, self.max_n, self.size = sorted(profiles), max_n, size
        self.keys = np.unique(np.concatenate([profiles[x] for x in self.langs])) if self.langs else np.zeros(0, np.uint64)
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.keys, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, ties by name, and 1 - distance / largest distance; ``und``, 0 without a letter."""
        if not self.langs or not _has_letter(text):
            return "und", 0.0
        own = _ranked(*_grams(text, self.max_n), self.size)
        if not len(own):
            return "und", 0.0
        at = np.searchsorted(self.keys, own)
        at[at == len(self.keys)] = 0
        at = np.where(self.keys[at] == own, at, len(self.keys))
        there = self.ranks[at]
        apart = np.where(there < 0, self.size, np.abs(there - np.arange(len(own), dtype=np.int32)[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.langs[best], float(1 - apart[best] / (self.size * len(own)))


def _filtered(docs: DataFrame, good: Callable[[str | None], bool]) -> DataFrame:
    """The rows of ``docs`` with a ``good`` text, columns unchanged, whatever their names."""
    at = docs.columns.index("text")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.filter(pa.array([good(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(chosen, docs.schema)


def with_letter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a letter, columns unchanged."""
    return _filtered(docs, _has_letter)


def with_language(docs: DataFrame, profiles: dict[str, np.ndarray], max_n: int = MAX_N, size: int = PROFILE_SIZE) -> DataFrame:
    """The rows of ``docs`` that ``identify`` gives a language, columns unchanged."""
    ranker = docs.sparkSession.sparkContext.broadcast(Ranker(profiles, max_n, size))
    return _filtered(docs, lambda text: ranker.value.predict(text)[0] != "und")


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], max_n: int = MAX_N, size: int = PROFILE_SIZE) -> DataFrame:
    """The rows of ``docs`` with lang_pred and score.

    A null text, or one without a letter, is ``und`` with score 0, and so is everything where no
    language was learned. Only the text is looked at, all of it, slice by slice; equal distances go to
    the first language by name. Repeated rows are told each. A column of ``docs`` called lang_pred or
    score comes back as _lang_pred or _score. An empty table gives an empty one.
    """
    ranker = docs.sparkSession.sparkContext.broadcast(Ranker(profiles, max_n, size))
    docs = made_way(docs, ("lang_pred", "score"))
    at, names = docs.columns.index("text"), [*docs.columns, "lang_pred", "score"]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            said = [ranker.value.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in said], pa.string()), pa.array([y for _, y in said], pa.float64())], names)

    return docs.mapInArrow(label, widened(docs, "lang_pred string, score double"))
