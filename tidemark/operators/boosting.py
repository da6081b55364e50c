"""Joint boosting of several classes: softmax gradients, histograms over binned features, leaf-wise trees.

Each round grows one tree a class against the gradients of all classes' common softmax, so the chances of a row sum to one. The rows are
binned once, and rows of the same bins and class are one with a weight. What a split needs is the sum of gradients and curvatures by leaf, feature and bin: tasks add these up for all
classes and open leaves at once, and one grouping adds up the tasks. Where the different binned rows are few enough for one task, it grows
the trees of a round by itself. The driver holds trees and histograms, whose sizes do not
depend on the rows; a row's place is worked out from the trees, and nothing is kept but the different binned rows with their scores of some rounds ago.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import work_dir


@dataclass
class Tree:
    """Nodes by number, the root is 0: feature and bin (go left if the row's bin is at most that), children, and the value of a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int, values: tuple[float, float]) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.left[node] = feature, bin_, len(self.feature)
        for v in values:
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(0)
            self.value.append(v)
        return self.left[node], self.left[node] + 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row. `bins` has a row for each row and a column for each feature."""
        at, feature, limit, left = np.zeros(len(bins), np.int64), *(np.array(x) for x in (self.feature, self.bin, self.left))
        while (open_ := np.flatnonzero(feature[at] >= 0)).size:
            node = at[open_]
            at[open_] = left[node] + (bins[open_, feature[node]] > limit[node])
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


@dataclass
class Boosted:
    features: list[str]
    classes: list[str]
    edges: list[list[float]]
    prior: list[float]
    rounds: list[list[Tree]] = field(default_factory=list)

    def margins(self, bins: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """Scores by row and class. `start` has those of the rounds before the model's first, if it is the later part of another."""
        out = np.tile(np.array(self.prior), (len(bins), 1)) if start is None else start.copy()
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += tree.scores(bins)
        return out

    def chances(self, bins: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        m = self.margins(bins, start)
        e = np.exp(m - m.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def bins(self, values: np.ndarray) -> np.ndarray:
        """The bin of each value: how many edges are below it. A missing value has the bin 0."""
        out = np.stack([np.searchsorted(e, values[:, j], "left") + 1 for j, e in enumerate(self.edges)], axis=1)
        out[np.isnan(values)] = 0
        return out


@dataclass(frozen=True)
class Growth:
    """How a tree is grown: shrinkage, most leaves, fewest rows of a leaf, penalty on the square of leaf values, least gain of a split."""

    rate: float = 0.1
    leaves: int = 15
    rows: int = 20
    penalty: float = 0.0
    gain: float = 1e-12


def quantile_edges(df: DataFrame, features: Sequence[str], bins: int = 32, accuracy: int = 10_000) -> list[list[float]]:
    """Up to bins - 1 different edges of each feature, in one aggregation."""
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(*(F.percentile_approx(F.col(f).cast("double"), shares, accuracy).alias(f"c{i}") for i, f in enumerate(features))).first()
    return [sorted(set(found or [])) for found in row]


def best_split(histogram: np.ndarray, growth: Growth) -> tuple[float, int, int, tuple[float, float], tuple[int, int]] | None:
    """(gain, feature, bin, values of the children, their rows) of the best split of a leaf, the first feature and bin on a tie.

    `histogram` has gradient, curvature and rows by feature and bin.
    """
    g, h, n = np.cumsum(histogram, axis=2)
    g_all, h_all, n_all = g[:, -1:], h[:, -1:], n[:, -1:]
    score = lambda a, b: np.divide(a * a, b + growth.penalty, out=np.zeros_like(a), where=b + growth.penalty > 0)
    gains = score(g, h) + score(g_all - g, h_all - h) - score(g_all, h_all)
    gains[(n < growth.rows) | (n_all - n < growth.rows)] = -np.inf
    gains[:, -1] = -np.inf
    best = gains.max()
    if not best > growth.gain:
        return None
    j, b = (int(x[0]) for x in np.nonzero(gains >= best - 1e-9 * abs(best)))
    value = lambda a, c: float(-growth.rate * a / (c + growth.penalty)) if c + growth.penalty > 0 else 0.0
    left = (g[j, b], h[j, b])
    right = (g_all[j, 0] - left[0], h_all[j, 0] - left[1])
    return float(best), j, b, (value(*left), value(*right)), (int(n[j, b]), int(n_all[j, 0] - n[j, b]))


#: Different binned rows that are too few to be dealt over several tasks.
ROWS_A_TASK = 50_000
#: After so many rounds their trees are added to the scores that the rows keep.
KEPT_ROUNDS = 20
HISTOGRAM = "class int, node int, feature int, bin int, g double, h double, n long"
NODE = "class int, node int, feature int, bin int, left int, value double"

Histograms = dict[tuple[int, int], np.ndarray]


def _arrays(batch: pa.RecordBatch, model: Boosted) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins, class, how many rows are alike, and the kept scores."""
    columns, n = [c.to_numpy() for c in batch.columns], len(model.features)
    return np.stack(columns[:n], axis=1), columns[n], columns[n + 1], np.stack(columns[n + 2 :], axis=1)


def _slopes(batch: pa.RecordBatch, model: Boosted) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins, gradients and curvatures by class, and how many rows are alike."""
    bins, label, weight, kept = _arrays(batch, model)
    p, weights = model.chances(bins, kept), weight[:, None]
    return bins, weights * (p - (label[:, None] == np.arange(len(model.classes)))), weights * p * (1 - p), weight


def _sums(parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], model: Boosted, trees: list[Tree], wanted: list[list[int]], width: int) -> Histograms:
    """Gradient, curvature and rows by feature and bin of the wanted leaves, over a task's rows."""
    total = {(k, node): np.zeros((3, len(model.features), width)) for k, nodes in enumerate(wanted) for node in nodes}
    for bins, g, h, weight in parts:
        for k, tree in enumerate(trees):
            if not wanted[k]:
                continue
            leaf = tree.leaves(bins)
            for node in wanted[k]:
                mine = np.flatnonzero(leaf == node)
                for j in range(len(model.features)):
                    for i, w in enumerate((g[mine, k], h[mine, k], weight[mine])):
                        total[k, node][i, j] += np.bincount(bins[mine, j], w, width)
    return total


def histograms(rows: DataFrame, model: Boosted, trees: list[Tree], wanted: list[list[int]], width: int) -> Histograms:
    """Sums of gradient, curvature and rows by feature and bin of the wanted leaves of each class's growing tree.

    `rows` has the bins, the class, how many rows are alike and their scores before the model's rounds. A task gives one row for each class, leaf, feature and bin that it has; these are added up by one grouping.
    """

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k, node), sums in _sums((_slopes(b, model) for b in batches), model, trees, wanted, width).items():
            j, b = np.nonzero(sums[2])
            if len(j):
                fixed = lambda x: pa.array(np.full(len(j), x), pa.int32())
                yield pa.record_batch([fixed(k), fixed(node), pa.array(j, pa.int32()), pa.array(b, pa.int32()), sums[0][j, b], sums[1][j, b], sums[2][j, b].astype(np.int64)], ["class", "node", "feature", "bin", "g", "h", "n"])

    found = rows.mapInArrow(add, HISTOGRAM).groupBy("class", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    out = {(k, node): np.zeros((3, len(model.features), width)) for k, nodes in enumerate(wanted) for node in nodes}
    for r in found.collect():  # classes x open leaves x features x bins at most
        out[r["class"], r.node][:, r.feature, r.bin] = r.g, r.h, r.n
    return out


def _grown(classes: int, growth: Growth, find: Callable[[list[Tree], list[list[int]]], Histograms]) -> list[Tree]:
    """One tree a class, leaf by leaf: the leaf with the largest gain is split next. `find` gives the histograms of all wanted leaves of all classes."""
    trees = [Tree() for _ in range(classes)]
    splits: list[dict[int, tuple | None]] = [{} for _ in trees]
    counts = [1] * len(trees)
    while True:
        wanted = []
        for k, tree in enumerate(trees):
            known = splits[k]
            wanted.append([i for i, f in enumerate(tree.feature) if f < 0 and i not in known] if counts[k] < growth.leaves else [])
        if not any(wanted):
            return trees
        for (k, node), histogram in find(trees, wanted).items():
            splits[k][node] = best_split(histogram, growth)
        for k, tree in enumerate(trees):
            while counts[k] < growth.leaves:
                ready = [(s[0], -i) for i, s in splits[k].items() if s and tree.feature[i] < 0]
                if not ready:
                    break
                node = -max(ready)[1]
                _, feature, bin_, values, sizes = splits[k][node]
                children = tree.split(node, feature, bin_, values)
                counts[k] += 1
                for child, size in zip(children, sizes):
                    if size < 2 * growth.rows:
                        splits[k][child] = None
                if any(splits[k].get(c, 0) == 0 for c in children):
                    break  # a child may gain more than what else is known


def grow(rows: DataFrame, model: Boosted, growth: Growth, width: int, kept: int, alone: bool) -> list[Tree]:
    """The trees of the next round. `rows` have the scores of the first `kept` rounds.

    The histograms of all open leaves of all classes are one job. Rows that are `alone` in one task need no adding up: the round is one job.
    """
    later = replace(model, rounds=model.rounds[kept:])
    if not alone:
        return _grown(len(model.classes), growth, lambda trees, wanted: histograms(rows, later, trees, wanted, width))

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_slopes(b, later) for b in batches]
        for k, t in enumerate(_grown(len(later.classes), growth, lambda trees, wanted: _sums(parts, later, trees, wanted, width))):
            integers = ([k] * len(t.feature), range(len(t.feature)), t.feature, t.bin, t.left)
            yield pa.record_batch([*(pa.array(x, pa.int32()) for x in integers), pa.array(t.value)], ["class", "node", "feature", "bin", "left", "value"])

    nodes = sorted(rows.mapInArrow(whole, NODE).collect(), key=lambda r: r.node)  # classes x twice the leaves at most
    return [Tree(*([r[c] for r in nodes if r["class"] == k] for c in ("feature", "bin", "left", "value"))) for k in range(len(model.classes))]


def _moved(rows: DataFrame, later: Boosted) -> DataFrame:
    """`rows` with the scores after the rounds of `later`."""

    def move(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, _, _, kept = _arrays(batch, later)
            scores = later.margins(bins, kept)
            yield pa.record_batch([*batch.columns[: len(later.features) + 2], *(pa.array(scores[:, k]) for k in range(len(later.classes)))], batch.schema.names)

    return rows.mapInArrow(move, rows.schema)


def _stored(rows: DataFrame) -> DataFrame:
    """`rows` without their lineage, as the plan of every round would be that of all before, and held for the jobs of the next rounds."""
    work_dir(rows.sparkSession)
    return rows.checkpoint().persist()


def fit(train: DataFrame, features: Sequence[str], label: str, classes: Sequence[str], rounds: int = 50, growth: Growth = Growth(), bins: int = 32) -> Boosted:
    """A model of the classes from the rows whose label is one of them. A missing feature has a bin of its own, below all others.

    The start is each class's share. Without rows all classes are alike.
    """
    rows = train.where(F.col(label).isin(*classes)).select(*(F.col(f).cast("double").alias(f"c{i}") for i, f in enumerate(features)), F.col(label).alias("_label"))
    edges = quantile_edges(rows, [f"c{i}" for i in range(len(features))], bins)
    model = Boosted(list(features), list(classes), edges, [0.0] * len(classes))
    width = max(map(len, edges), default=0) + 2
    names = [f"c{i}" for i in range(len(features))]

    def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {c: k for k, c in enumerate(model.classes)}
        for batch in batches:
            values = np.stack([batch.column(j).to_numpy(zero_copy_only=False).astype(float) for j in range(len(names))], axis=1)
            found = model.bins(values)
            yield pa.record_batch([*(pa.array(found[:, j], pa.int32()) for j in range(len(names))), pa.array([place[x] for x in batch.column(len(names)).to_pylist()], pa.int32())], [*names, "label"])

    each = rows.mapInArrow(binned, ", ".join(f"{n} int" for n in [*names, "label"]))
    data = each.groupBy(*names, "label").agg(F.count("*").cast("double").alias("weight")).persist()
    held = data
    try:
        sizes = data.groupBy("label").agg(F.sum("weight").alias("n"), F.count("*").alias("different")).collect()
        n, different = {r.label: r.n for r in sizes}, sum(r.different for r in sizes)
        total = sum(n.values())
        if total:
            model.prior = [float(np.log(max(n.get(k, 0), 1e-9) / total)) for k in range(len(classes))]
            tasks, kept = 1 + different // ROWS_A_TASK, 0
            dealt = data.coalesce(tasks).sortWithinPartitions(*names, "label").select("*", *(F.lit(p).alias(f"m{k}") for k, p in enumerate(model.prior)))
            for done in range(rounds):
                if done % KEPT_ROUNDS == 0:
                    dealt, kept = _stored(_moved(dealt, replace(model, rounds=model.rounds[kept:]))), done
                    held.unpersist()
                    held = dealt
                model.rounds.append(grow(dealt, model, growth, width, kept, tasks == 1))
    finally:
        held.unpersist()
    return model


def scored(df: DataFrame, model: Boosted, prefix: str = "p_", into: str = "pred") -> DataFrame:
    """`df` with a chance for each class, which sum to one, and the likeliest class, the first on a tie."""
    names = [f"_c{i}" for i in range(len(model.features))]
    rows = df.select(F.struct(*df.columns).alias("_row"), *(F.col(f).cast("double").alias(c) for f, c in zip(model.features, names)))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([batch.column(j + 1).to_numpy(zero_copy_only=False).astype(float) for j in range(len(names))], axis=1)
            different, place = np.unique(model.bins(values), axis=0, return_inverse=True)
            p = model.chances(different)[place]
            best = pa.array([model.classes[k] for k in p.argmax(axis=1).tolist()], pa.string())
            yield pa.record_batch([batch.column(0), *(p[:, k] for k in range(len(model.classes))), best], ["_row", *(f"_p{k}" for k in range(len(model.classes))), "_pred"])

    row = rows.schema["_row"].dataType.simpleString()
    out = rows.mapInArrow(score, f"_row {row}, " + "".join(f"_p{k} double, " for k in range(len(model.classes))) + "_pred string")
    return out.select("_row.*", *(F.col(f"_p{k}").alias(f"{prefix}{c}") for k, c in enumerate(model.classes)), F.col("_pred").alias(into))
