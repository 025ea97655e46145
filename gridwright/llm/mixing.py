"""Mixing sources to target weights by balanced (cube-method) sampling."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import NON_SPACE, bounded_broadcast, broadcast_up_to, numbered, whole, written
from gridwright.operators.ordering import ordinal, running

#: Weights by the sources' order, the mix's size and a source's largest target, both by what is
#: there, and rows that one flight takes at once.
WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2.0
CHUNK = 4000
#: Sources whose targets are broadcast; those of more sources join by a shuffle.
MANY_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{NON_SPACE}+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): weights repeat over the sources by code point, null last.

    Targets are the water level at which sources filled to ``most`` times their size and weighted
    shares of the others make ``total``. Sources are put in order by ranges, so there may be as many as
    documents.
    """
    null_last = [F.col("source").isNull(), F.col("source")]
    per = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    turn = (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")
    weighed = ordinal(per, null_last, "place").select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("w"))
    capped = written(weighed.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("r", F.col("cap") / F.col("w")), "mix-caps")
    sums = capped.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))
    fill = [F.col("r"), *null_last]
    filled = running(running(capped, fill, "cap", "caps"), fill, "w", "ws").crossJoin(F.broadcast(sums))
    level = (F.lit(total) * F.col("all_size") - (F.col("caps") - F.col("cap"))) / (F.col("all_w") - (F.col("ws") - F.col("w")))
    filled = written(filled.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("w")), "mix-levels")
    first = filled.where("not full").agg(F.min(F.struct("r", "level")).alias("first"))
    return filled.crossJoin(F.broadcast(first)).select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("first.level") * F.col("w")).alias("target"))


def fly(sizes: list[float], chances: list[float], draws: list[float]) -> list[float]:
    """The flight phase for the constraints sum(p) and sum(p * size): at most two fractions are left.

    Three open units at a time move along the one direction that keeps both sums, up or down with
    chances that keep each unit's mean, until one of them is 0 or 1. With the largest units first,
    what is left to land is small.
    """
    p = list(chances)
    held: list[int] = []
    for k, chance in enumerate(p):
        if not 1e-12 < chance < 1 - 1e-12:
            p[k] = float(round(chance))
            continue
        held.append(k)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(held, u, strict=True) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(held, u, strict=True) if v)
        step = up if draws[k] * (up + down) < down else -down
        for i, v in zip(held, u, strict=True):
            p[i] = min(1.0, max(0.0, p[i] + step * v))
        held = [i for i in held if 1e-9 < p[i] < 1 - 1e-9]
    for k, chance in enumerate(p):
        if chance <= 1e-9 or chance >= 1 - 1e-9:
            p[k] = float(round(chance))
    return p


def land(sizes: list[float], chances: list[float], goal: float, count: float) -> list[float]:
    """The landing of the fractions that are left, near ``goal``, the sum of sizes, and ``count``, that of documents.

    What is off counts in documents: the words by the mean size, and the documents. The open units
    land where least is off; then one unit changes sides, or two swap, the best each time, while
    that brings the two totals nearer.
    """
    x, p = np.array(sizes, float), np.array(chances, float)
    each = max(1.0, float(x.mean())) if len(x) else 1.0
    open_ = np.flatnonzero((p > 0) & (p < 1))
    out = p >= 1

    def off(words: np.ndarray | float, documents: np.ndarray | float) -> np.ndarray | float:
        return abs(words) / each + abs(documents)

    over, more = float(x[out].sum()) - goal, float(out.sum()) - count
    best = min(range(1 << len(open_)), key=lambda m: (off(over + sum(x[k] for j, k in enumerate(open_) if m >> j & 1), more + m.bit_count()), m))
    out[[k for j, k in enumerate(open_) if best >> j & 1]] = True
    over, more = float(x[out].sum()) - goal, float(out.sum()) - count
    for _ in range(32):
        taken, left = np.flatnonzero(out), np.flatnonzero(~out)
        turns = [(float(c.min()), [int(at[c.argmin()])]) for at, sign in ((taken, -1), (left, 1)) if len(at) for c in (off(over + sign * x[at], more + sign),)]
        if len(taken) and len(left):
            by_size = left[np.argsort(x[left], kind="stable")]
            at = np.searchsorted(x[by_size], x[taken] - over)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(by_size) - 1)):
                c = off(over - x[taken] + x[by_size[near]], more)
                turns.append((float(c.min()), [int(taken[c.argmin()]), int(by_size[near[c.argmin()]])]))
        least, moved = min(turns, default=(np.inf, []))
        if least >= off(over, more) - 1e-9:
            break
        for k in moved:
            sign = -1 if out[k] else 1
            over, more, out[k] = over + sign * x[k], more + sign, not out[k]
    return out.astype(float).tolist()


def _flight(last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def take_off(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[["source", "unit", "row", "size", "p", "draw"]].sort_values(["size", "draw", "row"], ascending=[False, True, True], kind="stable")
        sizes = [float(x) for x in frame["size"]]
        p = fly(sizes, frame["p"].tolist(), frame["draw"].tolist())
        return frame.assign(p=land(sizes, p, float((frame["size"] * frame["p"]).sum()), float(frame["p"].sum())) if last else p)

    return take_off


def _draw(level: int) -> Column:
    return F.pmod(F.xxhash64("unit", F.lit(level)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies.

    A document's expected copies are its source's target / size. Whole copies are sure; the cube
    method draws the rest: each source's rows fly in chunks of about ``chunk`` that keep the sums of
    documents and of words, the few fractions that are left fly again, and the last two land. A
    source is never gathered: only fractions go on, at most two from a chunk.

    Draws come from hashes of the row and its number among equal ones, so reruns agree and repeated
    rows spread over chunks. A null text has no words, a null source is a source of its own; documents
    without words take nothing. Texts of any length are counted whole; other columns aren't looked at,
    whatever their names. An empty table gives an empty result.
    """
    read = written(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key"))
        .withColumn("equal", F.xxhash64("doc_id", "source", "text_key"))
        .withColumn("row", F.monotonically_increasing_id()),
        "mix-sizes",
    )
    rows = written(numbered(read, "equal", "row", "number").withColumn("unit", F.xxhash64("equal", "number")).drop("equal", "number"), "mix-units")
    targets = written(source_targets(rows, weights, total, most), "mix-targets")
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    joined = rows.join(broadcast_up_to(t, MANY_SOURCES), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = joined.withColumn("sure", F.when(F.col("size") > 0, F.floor(mean + 1e-12)).otherwise(0)).withColumn("p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), mean - F.col("sure"))).otherwise(0.0))
    schema = "source string, unit long, row long, size long, p double, draw double"
    open_ = planned.where("p > 0").select("source", "unit", "row", "size", "p")
    settled: list[DataFrame] = []
    for level in range(12):
        n = open_.groupBy("source").agg(F.max("p").alias("_"), F.count("*").alias("n"))
        deepest = n.agg(F.max("n")).first()[0] or 0
        if not deepest:
            break
        parts = broadcast_up_to(written(n.select(F.col("source").alias("s"), F.ceil(F.col("n") / chunk).alias("parts")), f"mix-parts-{level}"), MANY_SOURCES)
        last = deepest <= chunk
        dealt = open_.join(parts, F.col("source").eqNullSafe(F.col("s"))).withColumn("draw", _draw(level))
        flown = written(
            dealt.withColumn("part", F.floor(F.col("draw") * F.col("parts")))
            .groupBy("source", "part")
            .applyInPandas(_flight(last), schema),
            f"mix-flight-{level}",
        )
        settled.append(flown.where("p = 1").select("row"))
        if last:
            break
        open_ = flown.where("p > 0 and p < 1").drop("draw")
    else:
        raise RuntimeError("the flights did not come down to one chunk a source")
    if settled:
        extra = functools.reduce(DataFrame.unionByName, settled).select(F.col("row").alias("drawn"))
        full = planned.join(extra, F.col("row") == F.col("drawn"), "left").withColumn("extra", F.col("drawn").isNotNull().cast("long"))
    else:
        full = planned.withColumn("extra", F.lit(0))
    copies = (F.col("sure") + F.col("extra")).cast("long")
    return full.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "source", "text_key")


def mixed(docs: DataFrame, **how: object) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, columns unchanged, whatever their names.

    Rows that doc_id, source and text don't tell apart count as one that stands for all their copies.
    Nulls, empty and long texts and empty tables go as in ``mix``.
    """
    keys = mix(docs.select("doc_id", "source", "text"), **how).groupBy("doc_id", "source", "text_key").agg(F.sum("copies").alias("copies"), F.count("*").alias("twins"))
    plan = written(keys.where("copies > 0").select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("text_key").alias("k"), "copies", "twins"), "mix-plan")
    same = F.col("id").eqNullSafe(F.col("d")) & F.col("of").eqNullSafe(F.col("s")) & (F.col("key") == F.col("k"))
    taken = whole(docs, id=F.col("doc_id"), of=F.col("source"), key=F.xxhash64("text")).join(bounded_broadcast(plan, name="mix-side"), same)
    if not plan.where("twins > 1").isEmpty():
        taken = taken.where("twins = 1").unionByName(taken.where("twins > 1").dropDuplicates(["d", "s", "k"]))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")
