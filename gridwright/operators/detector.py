"""Edge anomaly detection: recursive baselines and the gated state machine, one ordered pass a site."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.schema import ALPHA, CONFIRM, CONFIRM_PERIOD, DISTANCE_LIMIT, DISTANCE_SOFT, MAX_LOSS, METRICS, MIN_THROUGHPUT, VAR_FLOOR, WARMUP, Z_LIMIT


def _folded(samples: DataFrame, order: list[str], columns: list[str], start: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """``samples`` in ``order`` by site through the step that ``start`` makes for each site; its tuples follow site and ``order``.

    Tasks read runs of sites from sorted batches, so a site costs no frame of its own and no site is
    held whole; the step is carried from batch to batch.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        site, step = object(), None
        for batch in batches:
            said = []
            for here, *values in zip(batch.column(0).to_pylist(), *(batch.column(1 + len(order) + k).to_pylist() for k in range(len(columns))), strict=True):
                if here != site:
                    site, step = here, start()
                said.append(step(*values))
            made = [pa.array(list(c)) for c in zip(*said, strict=True)] if said else [pa.array([]) for _ in names[1 + len(order) :]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + len(order)], *made], names)

    return samples.select("site", *order, *[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(columns)]).repartition("site").sortWithinPartitions("site", *order).mapInArrow(run, schema)


def ewma(samples: DataFrame, value: str = "value", alpha: float = ALPHA) -> DataFrame:
    """(site, t, event_id, x, mean, variance) before each sample is learned; a site's samples in (t, event_id) order.

    A linear recurrence over a site's history; it isn't a window frame, so sites are the parallelism.
    """

    def start() -> Callable[..., tuple]:
        mean, var = None, 1.0

        def step(x: float) -> tuple:
            nonlocal mean, var
            if mean is None:
                mean = x
                return x, x, 1.0
            out = x, mean, var
            d = x - mean
            mean, var = mean + alpha * d, (1 - alpha) * (var + alpha * d * d)
            return out

        return step

    return _folded(samples, ["t", "event_id"], [value], start, "site long, t double, event_id long, x double, mean double, variance double")


def distances(samples: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(site, t, max_z, distance) of each sample of six metrics to the ungated baseline before it: the largest z-score and the diagonal Mahalanobis distance."""

    def start() -> Callable[..., tuple]:
        mean, var = None, [1.0] * len(METRICS)

        def step(*x: float) -> tuple:
            nonlocal mean, var
            if mean is None:
                mean = list(x)
                return 0.0, 0.0
            z = [abs(a - m) / max(v, VAR_FLOOR) ** 0.5 for a, m, v in zip(x, mean, var, strict=True)]
            d = [a - m for a, m in zip(x, mean, strict=True)]
            var = [(1 - alpha) * (v + alpha * e * e) for v, e in zip(var, d, strict=True)]
            mean = [m + alpha * e for m, e in zip(mean, d, strict=True)]
            return max(z), sum(a * a for a in z) ** 0.5

        return step

    return _folded(samples, ["t"], list(METRICS), start, "site long, t double, max_z double, distance double")


@dataclass
class Detector:
    """State of one site's detector; picklable, so a stream can keep it."""

    mean: list[float] | None = None
    var: list[float] = field(default_factory=lambda: [1.0] * len(METRICS))
    seen: int = 0
    state: str = "healthy"
    pending: str | None = None
    streak: int = 0
    rewarming: bool = False
    reseed: bool = False
    flagged: bool = False

    def relearn(self) -> None:
        """After a repair: the next sample is the new mean, the spread stays, alarms wait for a new warm-up."""
        self.state, self.seen, self.reseed, self.rewarming = "healthy", 0, True, True
        self.pending, self.streak, self.flagged = None, 0, False

    def _learn(self, x: Sequence[float]) -> None:
        if self.mean is None or self.reseed:
            self.mean, self.reseed = list(x), False
            return
        d = [a - m for a, m in zip(x, self.mean, strict=True)]
        self.mean = [m + ALPHA * e for m, e in zip(self.mean, d, strict=True)]
        self.var = [(1 - ALPHA) * (v + ALPHA * e * e) for v, e in zip(self.var, d, strict=True)]

    def z_scores(self, x: Sequence[float]) -> list[float]:
        if self.mean is None:
            return [0.0] * len(METRICS)
        return [abs(a - m) / max(v, VAR_FLOOR) ** 0.5 for a, m, v in zip(x, self.mean, self.var, strict=True)]

    def observe(self, x: Sequence[float], confirm: Callable[[list[float]], bool] | None = None) -> tuple[str, bool, float, float]:
        """(state, changed, largest z, distance) after a sample; ``confirm`` looks at z every ``CONFIRM_PERIOD`` samples, or at once where the cheap tests are suspicious."""
        self.seen += 1
        dead = x[1] < MIN_THROUGHPUT or x[5] > MAX_LOSS
        z = self.z_scores(x)
        top, distance = max(z), sum(a * a for a in z) ** 0.5
        if self.seen <= WARMUP:
            self._learn(x)
            changed = dead and self.rewarming and self.state != "down"
            if dead and self.rewarming:
                self.state = "down"
            elif self.seen >= WARMUP:
                self.rewarming = False
            return self.state, changed, top, distance
        if confirm is not None and (self.seen % CONFIRM_PERIOD == 0 or top > Z_LIMIT or distance > DISTANCE_LIMIT):
            self.flagged = bool(confirm(z))
        odd = top > Z_LIMIT or distance > DISTANCE_LIMIT or (self.flagged and distance > DISTANCE_SOFT)
        now = "down" if dead else "degraded" if odd else "healthy"
        if now == self.state:
            self.pending, self.streak = None, 0
            if now == "healthy":
                self._learn(x)
            return self.state, False, top, distance
        self.streak = self.streak + 1 if now == self.pending else 1
        self.pending = now
        if self.streak < CONFIRM:
            return self.state, False, top, distance
        self.state, self.pending, self.streak = now, None, 0
        return self.state, True, top, distance


def detect(samples: DataFrame, confirm: Callable[[list[float]], bool] | None = None) -> DataFrame:
    """(site, t, state, changed, max_z, distance) for (site, t, six metrics), each site in order of t; ``confirm`` as in ``Detector``."""

    def start() -> Callable[..., tuple]:
        detector = Detector()
        return lambda *x: detector.observe(x, confirm)

    return _folded(samples, ["t"], list(METRICS), start, "site long, t double, state string, changed boolean, max_z double, distance double")


def healthy_scores(samples: DataFrame) -> DataFrame:
    """(site, t, six z-scores) of warmed-up, healthy samples: what a reconstruction learns from."""

    def start() -> Callable[..., tuple]:
        detector = Detector()

        def step(*x: float) -> tuple:
            z = detector.z_scores(x)
            state = detector.observe(x)[0]
            return (*z, state == "healthy" and detector.seen > WARMUP)

        return step

    schema = "site long, t double, " + ", ".join(f"{m} double" for m in METRICS) + ", good boolean"
    return _folded(samples, ["t"], list(METRICS), start, schema).where("good").drop("good")


@dataclass(frozen=True)
class Reconstruction:
    """A linear autoencoder of z-scores: their mean, principal axes, and the error from which a sample is strange."""

    mean: list[float]
    axes: list[list[float]]
    threshold: float = float("inf")

    def error(self, z: Sequence[float]) -> float:
        d = [a - m for a, m in zip(z, self.mean, strict=True)]
        for axis in self.axes:
            along = sum(a * b for a, b in zip(d, axis, strict=True))
            d = [a - along * b for a, b in zip(d, axis, strict=True)]
        return sum(a * a for a in d) / len(d)

    def __call__(self, z: Sequence[float]) -> bool:
        return self.error(z) > self.threshold


def train_reconstruction(scores: DataFrame, axes: int = 3, share: float = 0.995) -> Reconstruction | None:
    """The reconstruction of ``scores`` (six z-scores), its threshold the ``share`` percentile of their errors; None without rows.

    Only sums and products of six columns reach the driver.
    """
    names = list(METRICS)
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    sums = scores.agg(F.count("*").alias("n"), *[F.sum(a).alias(a) for a in names], *[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs]).first()
    if not sums.n:
        return None
    mean = np.array([sums[a] for a in names]) / sums.n
    spread = np.zeros((len(names), len(names)))
    for a, b in pairs:
        i, j = names.index(a), names.index(b)
        spread[i, j] = spread[j, i] = sums[f"{a}_{b}"] / sums.n - mean[i] * mean[j]
    model = Reconstruction(mean.tolist(), np.linalg.eigh(spread)[1].T[::-1][:axes].tolist())
    limit = scores.select(error(model).alias("error")).agg(F.percentile("error", F.lit(share)).alias("limit")).first().limit
    return Reconstruction(model.mean, model.axes, float(limit))


def error(model: Reconstruction) -> Column:
    """``Reconstruction.error`` over the columns of six z-scores."""
    d = [F.col(m) - float(mean) for m, mean in zip(METRICS, model.mean, strict=True)]
    whole = sum((x * x for x in d), F.lit(0.0))
    caught = sum(((sum((x * float(w) for x, w in zip(d, axis, strict=True)), F.lit(0.0))) ** 2 for axis in model.axes), F.lit(0.0))
    return F.greatest(F.lit(0.0), whole - caught) / len(METRICS)
