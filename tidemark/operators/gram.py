"""Linear models out of one pass over the rows.

What least squares need to know of the rows are their number, the means and the scatter matrix of features and label. These merge, so
one aggregation serves every penalty: ridge solves a small system for each, the elastic net goes round the coordinates of the
same matrix. Only matrices of features by features reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks' matrices are merged in so many groups before the driver merges those.
MERGERS = 64


class Moments(NamedTuple):
    """Rows, means and scatter (centred sums of products) of the features and, last, the label."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray


class Linear(NamedTuple):
    intercept: float
    weights: np.ndarray

    def column(self, features: Sequence[str]) -> Column:
        """The prediction as an expression."""
        return sum((F.col(f) * float(w) for f, w in zip(features, self.weights)), F.lit(self.intercept))


def merged(a: Moments, b: Moments) -> Moments:
    """The moments of two sets of rows together."""
    n = a.n + b.n
    if not n:
        return a
    gap = b.mean - a.mean
    return Moments(n, a.mean + gap * (b.n / n), a.scatter + b.scatter + np.outer(gap, gap) * (a.n * b.n / n))


def _row(part: int, m: Moments) -> pa.RecordBatch:
    return pa.record_batch({"part": pa.array([part], pa.int32()), "n": [m.n], "mean": [m.mean.tolist()], "scatter": [m.scatter.ravel().tolist()]})


SCHEMA = "part int, n long, mean array<double>, scatter array<double>"


def moments(df: DataFrame, features: Sequence[str], label: str, fill: float | None = None) -> Moments:
    """The moments of the rows that have all features and the label; with `fill`, missing features count as that."""
    columns = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*features, label])]
    rows = df.select(*columns)
    rows = rows.fillna(fill, subset=rows.columns[:-1]) if fill is not None else rows
    size = len(columns)
    none = Moments(0, np.zeros(size), np.zeros((size, size)))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = none
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if len(x):
                mean = x.mean(axis=0)
                total = merged(total, Moments(len(x), mean, (x - mean).T @ (x - mean)))
        if total.n:
            yield _row(TaskContext.get().partitionId() % MERGERS, total)

    def parsed(rows: Iterable[dict]) -> Moments:
        each = (Moments(r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(size, size)) for r in rows)
        return reduce(merged, each, none)

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["n"], r["mean"]))  # the same sums on every run
        return pa.Table.from_batches([_row(rows[0]["part"], parsed(rows))])

    found = rows.dropna().mapInArrow(add, SCHEMA).groupBy("part").applyInArrow(merge, SCHEMA)
    return parsed(r.asDict() for r in sorted(found.collect(), key=lambda r: r.part))


def ridge(m: Moments, alpha: float) -> Linear:
    """The least sum of squares plus alpha times the squared weights; the constant is free."""
    x, y = m.scatter[:-1, :-1], m.scatter[:-1, -1]
    weights = np.linalg.lstsq(x + alpha * np.eye(len(y)), y, rcond=None)[0]
    return Linear(float(m.mean[-1] - m.mean[:-1] @ weights), weights)


def elastic_net(m: Moments, alpha: float, l1_ratio: float, rounds: int = 10_000, tolerance: float = 1e-12) -> Linear:
    """Mean square over two, plus alpha times (l1_ratio of the absolute and (1 - l1_ratio) / 2 of the squared weights), coordinate by coordinate until no weight moves."""
    x, y = m.scatter[:-1, :-1] / max(m.n, 1), m.scatter[:-1, -1] / max(m.n, 1)
    weights = np.zeros(len(y))
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(y)):
            rest = y[j] - x[j] @ weights + x[j, j] * weights[j]
            below = x[j, j] + alpha * (1 - l1_ratio)
            new = np.sign(rest) * max(abs(rest) - alpha * l1_ratio, 0.0) / below if below > 0 else 0.0
            moved, weights[j] = max(moved, abs(new - weights[j])), new
        if moved <= tolerance * max(1.0, np.abs(weights).max(initial=0.0)):
            break
    return Linear(float(m.mean[-1] - m.mean[:-1] @ weights), weights)


def predicted(df: DataFrame, model: Linear, features: Sequence[str], into: str = "prediction", fill: float | None = None) -> DataFrame:
    """Rows with the prediction; those without a feature are left out, or get `fill` there for the prediction."""
    if fill is None:
        return df.na.drop(subset=list(features)).withColumn(into, model.column(features))
    filled = {f: F.coalesce(F.col(f), F.lit(fill)) for f in features}
    return df.withColumn(into, sum((filled[f] * float(w) for f, w in zip(features, model.weights)), F.lit(model.intercept)))


def sweep(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str, models: dict[float, Linear] | Sequence[float], fill: float | None = None) -> DataFrame:
    """Mean absolute error on the later rows for each penalty (or each given model by its name), best first.

    One pass over the training rows serves all penalties, and one over the later rows scores all of them.
    """
    if not isinstance(models, dict):
        m = moments(train, features, label, fill)
        models = {float(alpha): ridge(m, alpha) for alpha in models}
    names = list(models)
    rows = valid
    for i, name in enumerate(names):
        rows = predicted(rows, models[name], features, f"_p{i}", fill)
    rows = rows.where(F.col(label).isNotNull())
    errors = rows.agg(F.array(*(F.avg(F.abs(F.col(label) - F.col(f"_p{i}"))) for i in range(len(names)))).alias("e"))
    each = errors.select(F.posexplode("e").alias("i", "mae"))
    return each.select(F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("alpha"), "mae").orderBy(F.asc_nulls_last("mae"), "alpha")
