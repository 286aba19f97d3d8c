"""Many clusterings fitted at once.

A fit is a space (a preprocessing, or a subset of features), a model, k and its parameters. The points
of all spaces form one table (space, key, x). An iteration is one job for all fits that have not
settled: every task adds up its points' statistics for all of them in one pass, Spark adds the tasks'
sums, and the driver, which holds nothing but the parameters (some hundred numbers a fit), makes the
next ones. Neither rows nor jobs multiply with the number of fits.

* k-means: the first centre is the training point whose key has the largest seeded md5, each further
  one the point farthest from those before (ties: the larger md5), so the first k of them serve every
  k. Lloyd's steps follow until no centre moves. A cluster that loses its points keeps its centre.
* mixture: full covariances with ``reg`` on the diagonal, started from the k-means clusters; the sums
  of responsibilities, points and outer products (around the space's mean) are all that a step needs.
  Of ``n_init`` starts (seeds from ``seed`` on) the one with the largest likelihood stays.

Labels go by the smallest distance or the largest responsibility, the first on ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

SETTLED = 1e-9               # relative movement of a centre that counts as none
KMEANS, MIXTURE = "kmeans", "mixture"


@dataclass(frozen=True)
class Fit:
    """``name`` identifies the fit in the labelled rows; tol is the mixture's, of the mean log-likelihood."""
    name: str
    space: str
    kind: str = KMEANS
    k: int = 2
    seed: int = 0
    n_init: int = 1
    max_iter: int | None = None
    tol: float = 1e-3
    reg: float = 1e-6

    @property
    def steps(self) -> int:
        return self.max_iter if self.max_iter is not None else {KMEANS: 300, MIXTURE: 100}[self.kind]


@dataclass
class Model:
    """Fitted parameters: centres, and for mixtures log weights, covariances and mean log-likelihood."""
    fit: Fit
    centres: np.ndarray
    weights: np.ndarray | None = None
    covariances: np.ndarray | None = None
    likelihood: float = field(default=float("-inf"))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Rows of numbers of which the largest names the cluster."""
        if self.fit.kind == KMEANS:
            return -((x[:, None, :] - self.centres[None]) ** 2).sum(axis=2)
        out = np.empty((len(x), len(self.centres)))
        for j, (mean, cov) in enumerate(zip(self.centres, self.covariances)):
            low = np.linalg.cholesky(cov)
            z = np.linalg.solve(low, (x - mean).T)
            out[:, j] = np.log(max(self.weights[j], 1e-300)) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
        return out


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(space, row numbers, points) of a batch whose first columns are space and x."""
    for space in pc.unique(batch.column(0)).to_pylist():
        rows = np.flatnonzero(pc.equal(batch.column(0), space).to_numpy(zero_copy_only=False))
        x = batch.column(1).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float)
        yield space, rows, x.reshape(len(rows), -1)


def added(points: DataFrame, of_space: dict[str, list[tuple[int, Callable]]], size: int) -> np.ndarray:
    """Sums over all points of statistics: for each space (place, function of its points), the
    function's vector added from ``place`` on. One row per number and task is exchanged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for space, _, x in matrices(batch):
                for at, statistic in of_space.get(space, ()):
                    vector = statistic(x)
                    total[at:at + len(vector)] += vector
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], ["slot", "value"])

    out = np.zeros(size)
    sums = points.select("space", "x").mapInArrow(run, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value"))
    for r in sums.collect():                                   # the statistics of the grid, whatever the rows
        out[r.slot] = r.value
    return out


def farthest_first(points: DataFrame, k: int, seeds: Sequence[int]) -> dict[tuple[str, int], np.ndarray]:
    """(space, seed) -> the first ``k`` centres."""
    tie = lambda seed: F.md5(F.concat(F.lit(f"{seed}|"), F.col("key")))
    firsts = points.groupBy("space").agg(*[F.max_by("x", tie(s)).alias(f"s{s}") for s in seeds]).collect()
    chosen = {(r.space, s): [np.array(r[f"s{s}"], float)] for r in firsts for s in seeds}
    for _ in range(k - 1):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for (space, rows, x) in matrices(batch):
                    for i, s in enumerate(seeds):
                        d = np.min([((x - c) ** 2).sum(axis=1) for c in chosen[space, s]], axis=0)  # noqa: B023
                        ties = batch.column(2 + i).take(pa.array(rows)).to_pylist()
                        best = max(range(len(d)), key=lambda j: (d[j], ties[j]))  # noqa: B023
                        yield pa.RecordBatch.from_arrays([pa.array([space]), pa.array([s], pa.int64()), pa.array([d[best]]), pa.array([ties[best]]),
                                                          pa.array([x[best].tolist()], pa.list_(pa.float64()))], ["space", "seed", "d", "tie", "x"])

        rows = points.select("space", "x", *[tie(s).alias(f"t{s}") for s in seeds])
        found = rows.mapInArrow(run, "space string, seed long, d double, tie string, x array<double>")
        for r in found.groupBy("space", "seed").agg(F.max_by("x", F.struct("d", "tie")).alias("x")).collect():
            chosen[r.space, r.seed].append(np.array(r.x, float))
    return {key: np.array(c) for key, c in chosen.items()}


def _nearest(centres: np.ndarray) -> Callable:
    k, d = centres.shape

    def statistic(x: np.ndarray) -> np.ndarray:
        label = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        sums = np.zeros((k, d))
        np.add.at(sums, label, x)
        return np.concatenate([np.bincount(label, minlength=k), sums.ravel()])
    return statistic


def lloyd(points: DataFrame, fits: Sequence[Fit]) -> list[Model]:
    """All k-means fits at once."""
    start = farthest_first(points, max(f.k for f in fits), sorted({f.seed for f in fits}))
    models = [Model(f, start[f.space, f.seed][:f.k].copy()) for f in fits]
    moving = {i for i, m in enumerate(models) if m.fit.steps > 0}
    step = 0
    while moving:
        of_space, places, at = {}, {}, 0
        for i in sorted(moving):
            c = models[i].centres
            of_space.setdefault(models[i].fit.space, []).append((at, _nearest(c)))
            places[i], at = at, at + c.shape[0] * (1 + c.shape[1])
        total, step = added(points, of_space, at), step + 1
        for i, p in places.items():
            m, (k, d) = models[i], models[i].centres.shape
            n, sums = total[p:p + k], total[p + k:p + k + k * d].reshape(k, d)
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], m.centres)
            still = np.all(np.abs(new - m.centres) <= SETTLED * (1 + np.abs(m.centres)))
            m.centres = new
            if still or step >= m.fit.steps:
                moving.discard(i)
    return models


def _responsibilities(m: Model, centre: np.ndarray, hard: bool) -> Callable:
    k, d = m.centres.shape

    def statistic(x: np.ndarray) -> np.ndarray:
        s = m.scores(x)
        if hard:
            r, ll = np.eye(k)[s.argmax(axis=1)], 0.0
        else:
            top = s.max(axis=1, keepdims=True)
            norm = top[:, 0] + np.log(np.exp(s - top).sum(axis=1))
            r, ll = np.exp(s - norm[:, None]), norm.sum()
        y = x - centre
        return np.concatenate([[ll, len(x)], r.sum(axis=0), (r.T @ y).ravel(), np.einsum("nk,ni,nj->kij", r, y, y).ravel()])
    return statistic


def expectation_maximisation(points: DataFrame, fits: Sequence[Fit]) -> list[Model]:
    """All mixtures at once, each start a fit of its own; the best start of each is returned."""
    starts = [(i, replace(f, seed=f.seed + s)) for i, f in enumerate(fits) for s in range(f.n_init)]
    firsts = lloyd(points, [replace(f, kind=KMEANS, max_iter=None) for _, f in starts])
    models = [Model(f, m.centres) for (_, f), m in zip(starts, firsts)]
    dims = {m.fit.space: m.centres.shape[1] for m in models}
    places, at = {}, 0
    for space, d in dims.items():
        places[space], at = at, at + d + 1
    total = added(points, {s: [(p, lambda x: np.append(x.sum(axis=0), len(x)))] for s, p in places.items()}, at)
    mean = {s: total[p:p + dims[s]] / max(1.0, total[p + dims[s]]) for s, p in places.items()}
    open_, step = set(range(len(models))), 0
    while open_:
        of_space, places, at = {}, {}, 0
        for i in sorted(open_):
            m, (k, d) = models[i], models[i].centres.shape
            # the first step takes the k-means clusters as they are
            held = replace_kind(m) if step == 0 else m
            of_space.setdefault(m.fit.space, []).append((at, _responsibilities(held, mean[m.fit.space], step == 0)))
            places[i], at = at, at + 2 + k + k * d + k * d * d
        total = added(points, of_space, at)
        for i, p in places.items():
            m, (k, d) = models[i], models[i].centres.shape
            ll, rows = total[p:p + 2]
            n = total[p + 2:p + 2 + k] + 10 * np.finfo(float).eps
            first = total[p + 2 + k:][:k * d].reshape(k, d) / n[:, None]
            second = total[p + 2 + k + k * d:][:k * d * d].reshape(k, d, d) / n[:, None, None]
            if step:
                before, m.likelihood = m.likelihood, ll / rows
                if abs(m.likelihood - before) < m.fit.tol or step > m.fit.steps:
                    open_.discard(i)                 # the likelihood is that of the parameters at hand
                    continue
            m.weights, m.centres = n / n.sum(), first + mean[m.fit.space]
            m.covariances = second - np.einsum("ki,kj->kij", first, first) + m.fit.reg * np.eye(d)
        step += 1
    best: dict[int, Model] = {}
    for (i, _), m in zip(starts, models):
        if i not in best or m.likelihood > best[i].likelihood:
            best[i] = m
    return [best[i] for i in range(len(fits))]


def replace_kind(m: Model) -> Model:
    return Model(replace(m.fit, kind=KMEANS), m.centres)


def fit_all(points: DataFrame, fits: Sequence[Fit]) -> list[Model]:
    """Models of all fits on the points (space, key, x): two loops of scans, whatever their number.
    ``points`` is read once an iteration: pass a written table."""
    ship_package(points.sparkSession)
    if points.limit(1).count() == 0:
        raise ValueError("there are no points to fit on")
    made: dict[str, Model] = {}
    for kind, loop in ((KMEANS, lloyd), (MIXTURE, expectation_maximisation)):
        own = [f for f in fits if f.kind == kind]
        if own:
            made |= {m.fit.name if kind == KMEANS else f.name: m for f, m in zip(own, loop(points, own))}
    return [made[f.name] for f in fits]


def label_all(rows: DataFrame, models: Sequence[Model], names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Every row of ``rows`` (space, x, and the columns ``keep``) once for each model of its space, with
    the model's name (``fit``) and its label (``pred``)."""
    of_space: dict[str, list[tuple[str, Model]]] = {}
    for n, m in zip(names, models):
        of_space.setdefault(m.fit.space, []).append((n, m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for space, at, x in matrices(batch):
                for n, m in of_space.get(space, ()):
                    label = m.scores(x).argmax(axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(at)) for i in range(1, batch.num_columns)),
                                                      pa.array([n] * len(at)), pa.array(label)], ["x", *keep, "fit", "pred"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(["x array<double>", *(f"`{c}` {kinds[c]}" for c in keep), "fit string", "pred int"])
    return rows.select("space", "x", *keep).mapInArrow(run, schema)
