"""Leaf-wise gradient boosting on binned features, fitted from counts.

Trees see a row only by its bins, so rows of equal bins have one prediction, and all that a fit needs of them is their number and the sum of
their targets. Spark bins the rows and sums them into such cells, once for all folds; their number is bounded by the bins and not by the
rows. Rows carry one of `BAGS` tags by a hash, and a tree learns from a part of the tags, which is its sample of the rows. What is left, a
sequence of small steps over the cells of a fold, is one task a fold.
"""

from __future__ import annotations

import hashlib
import heapq
import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a continuous feature, and tags of rows: cells of two such features, two lags' flags, horizon and quarter are at most 64 * 64 * 16 * 10 a fold.
BINS, BAGS = 64, 10
#: Number of trees, their leaves, the rate, the fewest rows of a leaf, and the parts of rows and features that a tree sees.
TREES, LEAVES, RATE, LEAST, ROWS, COLUMNS = 400, 31, 0.05, 50, 0.8, 0.8


def _part(n: int, share: float, seed: str) -> np.ndarray:
    """round(share * n) of 0..n-1, at least one, by digests."""
    order = sorted(range(n), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
    return np.array(sorted(order[: max(1, round(share * n))]))


class Grower:
    """Trees over cells: x (cells by features, bins), n (rows), s (sum of targets), tag."""

    def __init__(self, x: np.ndarray, n: np.ndarray, s: np.ndarray, tag: np.ndarray, leaves: int = LEAVES, rate: float = RATE, least: int = LEAST, rows: float = ROWS, columns: float = COLUMNS, seed: str = "boost"):
        self.x, self.n, self.s, self.tag = x.astype(np.int64), n.astype(float), s.astype(float), tag
        self.leaves, self.rate, self.least, self.rows, self.columns, self.seed = leaves, rate, least, rows, columns, seed
        self.width = int(x.max()) + 1 if x.size else 1
        self.base = self.s.sum() / self.n.sum() if self.n.sum() else 0.0
        self.told = np.full(len(self.n), self.base)

    def _histogram(self, at: np.ndarray, features: np.ndarray) -> np.ndarray:
        """(2, features, bins): rows and residuals of the sampled rows of these cells."""
        k = (self.x[np.ix_(at, features)] + np.arange(len(features)) * self.width).ravel()
        size = len(features) * self.width
        sums = [np.bincount(k, np.repeat(v[at], len(features)), size) for v in (self.bag_n, self.bag_r)]
        return np.array(sums).reshape(2, len(features), self.width)

    def _split(self, h: np.ndarray) -> tuple[float, int, int]:
        """(gain, place among the features, last bin of the left part) of the best split; of equal ones the first."""
        n, r = np.cumsum(h, axis=2)
        all_n, all_r = n[:, -1:], r[:, -1:]
        right_n, right_r = all_n - n, all_r - r
        fits = (n >= self.least) & (right_n >= self.least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, r * r / n + right_r * right_r / right_n - all_r * all_r / all_n, -np.inf)
        best = int(np.argmax(gain))
        return float(gain.ravel()[best]), best // gain.shape[1], best % gain.shape[1]

    def tree(self, number: int) -> np.ndarray:
        """A tree as rows (feature or -1, last bin of the left part, left, right, value, gain); the predictions move on."""
        tags, features = _part(BAGS, self.rows, f"{self.seed}:{number}:rows"), _part(self.x.shape[1], self.columns, f"{self.seed}:{number}:columns")
        bag = np.isin(self.tag, tags)
        self.bag_n, self.bag_r = np.where(bag, self.n, 0.0), np.where(bag, self.s - self.n * self.told, 0.0)
        # cells that no sampled row is in still belong to a leaf: they get its value
        nodes, open_ = [[-1, 0, 0, 0, 0.0, 0.0]], []
        held = {0: np.arange(len(self.n))}
        histograms = {0: self._histogram(held[0], features)}

        def offer(node: int) -> None:
            gain, f, cut = self._split(histograms[node])
            if gain > 1e-9:
                heapq.heappush(open_, (-gain, node, int(features[f]), cut))

        offer(0)
        for _ in range(self.leaves - 1):
            if not open_:
                break
            gain, node, f, cut = heapq.heappop(open_)
            at = held.pop(node)
            left = self.x[at, f] <= cut
            sides = at[left], at[~left]
            ids = len(nodes), len(nodes) + 1
            nodes[node][:4], nodes[node][5] = [f, cut, *ids], -gain
            nodes += [[-1, 0, 0, 0, 0.0, 0.0], [-1, 0, 0, 0, 0.0, 0.0]]
            small = 0 if len(sides[0]) <= len(sides[1]) else 1
            histograms[ids[small]] = self._histogram(sides[small], features)
            histograms[ids[1 - small]] = histograms.pop(node) - histograms[ids[small]]  # what the one child hasn't, the other has
            for i, cells in zip(ids, sides):
                held[i] = cells
                offer(i)
        for node, at in held.items():
            n = self.bag_n[at].sum()
            nodes[node][4] = self.rate * self.bag_r[at].sum() / n if n else 0.0
            self.told[at] += nodes[node][4]
        return np.array(nodes, float)


def predict(base: float, trees: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), base)
    for t in trees:
        feature, cut, left, right = (t[:, i].astype(np.int64) for i in range(4))
        at = np.zeros(len(x), np.int64)
        while True:
            going = np.flatnonzero(feature[at] >= 0)
            if not len(going):
                break
            node = at[going]
            at[going] = np.where(x[going, feature[node]] <= cut[node], left[node], right[node])
        out += t[at, 4]
    return out


def edges(rows: DataFrame, group: str, columns: list[str], bins: int = BINS) -> dict[int, dict[str, list[float]]]:
    """{group: {column: upper ends of its bins but the last}} by approximate quantiles: bins - 1 numbers a column and group."""
    cuts = [i / bins for i in range(1, bins)]
    got = rows.groupBy(group).agg(*(F.percentile_approx(c, cuts, 10_000).alias(c) for c in columns)).collect()
    return {r[group]: {c: sorted(set(r[c] or [])) for c in columns} for r in got}


def binned(column: str, group: Column, ends: dict[int, dict[str, list[float]]]) -> Column:
    """The bin of a value: how many ends of its group lie below it."""
    out = F.lit(0)
    for g, by in ends.items():
        if by[column]:
            known = F.array(*map(F.lit, by[column]))
            out = F.when(group == g, F.aggregate(known, F.lit(0), lambda s, e: s + (F.col(column) > e).cast("int"))).otherwise(out)
    return out


def cells(rows: DataFrame, group: str, names: list[str], y: str, tag: Column) -> DataFrame:
    """(group, tag, names, n, s): rows of equal bins and tag, summed."""
    return rows.withColumn("tag", tag).groupBy(group, "tag", *names).agg(F.count("*").alias("n"), F.sum(y).alias("s"))


def fit(cells_: DataFrame, group: str, names: list[str], trees: int = TREES, **how) -> dict[int, tuple[float, list[np.ndarray]]]:
    """{group: (base, trees)}; groups are fitted side by side, a task each, from a bounded number of cells."""

    def grow(part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in ("tag", *names)])
        x = np.column_stack([part.column(c).to_numpy() for c in names])
        g = Grower(x, part.column("n").to_numpy(), part.column("s").to_numpy(), part.column("tag").to_numpy(), **how)
        out = io.BytesIO()
        np.savez_compressed(out, base=g.base, **{f"t{i}": g.tree(i) for i in range(trees)})
        return pa.table({"group": pa.array([int(part.column(group)[0].as_py())], pa.int64()), "model": [out.getvalue()]})

    found = {}
    for r in cells_.groupBy(group).applyInArrow(grow, "group long, model binary").collect():  # trees * leaves rows a group
        with np.load(io.BytesIO(r.model)) as m:
            found[r.group] = float(m["base"]), [m[f"t{i}"] for i in range(trees)]
    return found


def predicted(rows: DataFrame, group: str, names: list[str], models: dict[int, tuple[float, list[np.ndarray]]], keep: list[str]) -> DataFrame:
    """keep, and prediction: what each row's group's model says of its bins."""
    kept = rows.select(group, *names, *keep)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.select(*keep).schema) + ", prediction double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups = b.column(0).to_numpy()
            x = np.column_stack([b.column(i).to_numpy() for i in range(1, len(names) + 1)]) if b.num_rows else np.empty((0, len(names)), int)
            out = np.zeros(b.num_rows)
            for g in np.unique(groups):
                at = groups == g
                alike, back = np.unique(x[at], axis=0, return_inverse=True)
                out[at] = predict(*models[int(g)], alike)[back.ravel()] if int(g) in models else 0.0
            yield pa.RecordBatch.from_arrays([*b.columns[len(names) + 1 :], pa.array(out)], names=[*keep, "prediction"])

    return kept.mapInArrow(run, schema)
