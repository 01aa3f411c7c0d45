"""Many penalised logistic regressions at once: every fold, feature set and penalty in the same passes.

Rows carry one wide feature array; a feature set is a choice of its places, and a fold a set of the
rows in its fit part. A Newton step needs the sums of each fit's gradients and curvatures: a pass
over the rows returns them for all fits together, one row per task, and a few tasks add those up
before the driver solves the small systems. So the number of jobs is that of the steps, not of the
fits. What travels is ``fits x width^2``, whatever the table's size.

The model is that of ``learn.Probe``: features standardised on the fit part (sample spread; constant
ones count as 0), class-balanced weights, an intercept without penalty, inverse penalty ``c``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.errors import ContractError
from tidewarden.operators.knn import matrix_of
from tidewarden.session import written

GRID = (0.001, 0.01, 0.1, 1.0, 10.0)
MERGE_TASKS = 4
STEPS, TOLERANCE = 60, 1e-9
SUMS = pa.schema([("fit", pa.int32()), ("sums", pa.list_(pa.float64()))])


def wide(df: DataFrame, sets: dict[str, list[str]]) -> tuple[DataFrame, dict[str, list[int]]]:
    """Add ``x``, all parts of the sets (scalars and arrays of one length) in a row, and the sets' places in it."""
    kinds = dict(df.dtypes)
    parts = list(dict.fromkeys(p for names in sets.values() for p in names))
    arrays = {p: F.col(p).cast("array<double>") if kinds[p].startswith("array") else F.array(F.col(p).cast("double")) for p in parts}
    sizes = df.agg(*[f(F.size(a)).alias(f"{n}_{p}") for p, a in arrays.items() for n, f in (("lo", F.min), ("hi", F.max))]).first()
    places, at = {}, 0
    for p in parts:
        if sizes[f"lo_{p}"] != sizes[f"hi_{p}"]:
            raise ContractError(f"{p}: arrays of {sizes[f'lo_{p}']}..{sizes[f'hi_{p}']} values")
        places[p] = list(range(at, at + (sizes[f"hi_{p}"] or 0)))
        at += sizes[f"hi_{p}"] or 0
    return df.withColumn("x", F.concat(*arrays.values())), {name: [i for p in names for i in places[p]] for name, names in sets.items()}


@dataclass
class Fit:
    """One regression; ``beta`` holds the intercept and a coefficient per place."""

    fold: int
    feature_set: str
    places: np.ndarray
    c: float
    n: int = 0
    mean: np.ndarray = field(default_factory=lambda: np.empty(0))
    spread: np.ndarray = field(default_factory=lambda: np.empty(0))
    class_weight: tuple[float, float] = (0.0, 0.0)
    beta: np.ndarray = field(default_factory=lambda: np.empty(0))
    done: bool = False

    def features(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, self.places] - self.mean) / self.spread
        return np.concatenate([np.ones((len(z), 1)), z], axis=1)

    def decision(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta


def _members(batch: pa.RecordBatch, fold: int) -> np.ndarray:
    return (np.asarray(batch.column("fit_folds")) >> fold) & 1 == 1


def _added(rows: DataFrame, partial, keys: int) -> dict[int, np.ndarray]:
    """Sums per key over all tasks: a row per key and task, added up by ``MERGE_TASKS`` tasks."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for key, value in partial(batch):
                    total[key] = total[key] + value if key in total else value
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], schema=SUMS
        )

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = np.asarray(value.values)
                total[key] = total[key] + value if key in total else value
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], schema=SUMS
        )

    schema = "fit int, sums array<double>"
    parts = rows.mapInArrow(run, schema).repartition(min(MERGE_TASKS, keys), "fit").mapInArrow(add, schema).toArrow()
    return {k: np.asarray(v.values) for k, v in zip(parts.column("fit").to_pylist(), parts.column("sums"))}


def _standards(rows: DataFrame, folds: list[int], width: int) -> dict[int, tuple]:
    """Per fold: rows of each class, means and sample spreads of the fit part."""

    def counts(batch):
        x, y = matrix_of(batch.column("x")), np.asarray(batch.column("y"))
        for k in folds:
            m = _members(batch, k)
            yield k, np.concatenate([[(m & (y == 0)).sum(), (m & (y == 1)).sum()], x[m].sum(0)])

    first = _added(rows, counts, len(folds))
    means = {k: v[2:] / max(v[0] + v[1], 1) for k, v in first.items()}

    def squares(batch):
        x = matrix_of(batch.column("x"))
        for k in folds:
            away = x[_members(batch, k)] - means[k]
            yield k, (away * away).sum(0)

    second = _added(rows, squares, len(folds))
    out = {}
    for k in folds:
        n0, n1 = (int(v) for v in first[k][:2])
        if not n0 or not n1:
            raise ContractError(f"fold {k}: the fit part has one class only")
        spread = np.sqrt(second[k] / max(n0 + n1 - 1, 1))
        # rounding of a constant feature's mean is no spread
        constant = spread <= 1e-12 * (1 + np.abs(means[k]))
        out[k] = (n0, n1, means[k], np.where(constant, np.inf, spread))
    return out


def many_fits(
    rows: DataFrame,
    sets: dict[str, list[int]],
    folds: list[int],
    grid=GRID,
    steps: int = STEPS,
    tolerance: float = TOLERANCE,
) -> list[Fit]:
    """A fit for every fold, feature set and penalty.

    ``rows`` has ``y`` (0 or 1), ``x`` (array) and ``fit_folds``, a number whose bit k says whether
    the row is in the fit part of fold k (at most 62).
    """
    if not folds or min(folds) < 0 or max(folds) > 61:
        raise ContractError(f"folds must be numbers from 0 to 61, got {folds}")
    held = written(rows.select(F.col("y").cast("int").alias("y"), "x", F.col("fit_folds").cast("bigint").alias("fit_folds")), "fit-rows")
    width = max(max(places) for places in sets.values()) + 1
    standards = _standards(held, folds, width)
    fits = []
    for k in folds:
        n0, n1, mean, spread = standards[k]
        n = n0 + n1
        for name, places in sets.items():
            at = np.asarray(places)
            for c in grid:
                fit = Fit(k, name, at, float(c), n, mean[at], spread[at], (n / (2 * n0), n / (2 * n1)))
                fit.beta = np.zeros(len(at) + 1)
                fits.append(fit)
    before: list[tuple | None] = [None] * len(fits)
    for _ in range(steps):
        active = [i for i, f in enumerate(fits) if not f.done]
        if not active:
            break
        sums = _added(held, _curvatures(fits, active), len(active))
        for i in active:
            before[i] = _stepped(fits[i], sums.get(i), before[i], tolerance)
    return fits


def _curvatures(fits: list[Fit], active: list[int]):
    """Loss, gradient and curvature of the active fits over a batch, as one flat array each."""

    def run(batch):
        x, y = matrix_of(batch.column("x")), np.asarray(batch.column("y")).astype(float)
        parts: dict[int, tuple] = {}
        seen: dict[tuple, np.ndarray] = {}
        for i in active:
            fit = fits[i]
            if fit.fold not in parts:  # feature sets share a fold's rows
                m = _members(batch, fit.fold)
                parts = {fit.fold: (x[m], y[m], np.where(y[m] == 1, fit.class_weight[1], fit.class_weight[0]))}
            held, t, w = parts[fit.fold]
            if not len(t):
                continue
            at = (fit.fold, fit.feature_set)
            if at not in seen:  # penalties share the standardised features
                seen = {at: fit.features(held)}
            z = seen[at]
            s = z @ fit.beta
            e = np.exp(-np.abs(s))  # one exponential serves loss and probability
            p = np.where(s >= 0, 1.0, e) / (1.0 + e)
            loss = (w * (np.log1p(e) + np.maximum(s, 0.0) - t * s)).sum()
            bend = z * (w * p * (1 - p))[:, None]
            yield i, np.concatenate([[loss], z.T @ (w * (p - t)), (z.T @ bend).ravel()])

    return run


def _stepped(fit: Fit, sums: np.ndarray, before: tuple | None, tolerance: float) -> tuple:
    """Move a fit by a Newton step, or halve its last step if that has not lowered the loss."""
    d = len(fit.beta)
    ridge = np.full(d, 1.0 / fit.c)
    ridge[0] = 0.0
    loss = sums[0] + 0.5 * (ridge * fit.beta**2).sum()
    if before is not None and loss > before[0] + 1e-12 * abs(before[0]):
        at, step = before[1], before[2] / 2
        if np.abs(step).max() < tolerance:
            fit.beta, fit.done = at, True
        else:
            fit.beta = at + step
        return before[0], at, step
    gradient = sums[1 : d + 1] + ridge * fit.beta
    curve = sums[d + 1 :].reshape(d, d) + np.diag(ridge)
    step = -np.linalg.lstsq(curve, gradient, rcond=None)[0]
    at = fit.beta
    fit.beta = at + step
    fit.done = bool(np.abs(step).max() < tolerance)
    return loss, at, step


def scored(rows: DataFrame, fits: list[Fit], part: Column, keep: list[str]) -> DataFrame:
    """Decision values on a 1e-9 grid: one row per row of a fit's fold, with ``fold, feature_set, penalty``.

    ``part`` is a number whose bit k says whether the row is scored by the fits of fold k.
    """
    asked = rows.select(*keep, "x", part.cast("bigint").alias("fit_folds"))
    names = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column("x"))
            for fit in fits:
                m = _members(batch, fit.fold)
                if not m.any():
                    continue
                mine = batch.select(keep).filter(pa.array(m))
                n = mine.num_rows
                extra = [pa.array([fit.fold] * n, pa.int32()), pa.array([fit.feature_set] * n), pa.array([fit.c] * n, pa.float64())]
                extra.append(pa.array(np.round(fit.decision(x[m]), 9)))
                yield pa.RecordBatch.from_arrays([*mine.columns, *extra], names=[*keep, "fold", "feature_set", "penalty", "anomaly_score"])

    return asked.mapInArrow(run, ", ".join([*names, "fold int, feature_set string, penalty double, anomaly_score double"]))
