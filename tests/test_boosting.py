"""Boosted trees from cells against a grower that looks at every row and every split."""

import numpy as np
from pyspark.sql import functions as F

from lodestrata.operators import boosting as B

NAMES = ["a", "b", "c"]
HOW = {"leaves": 7, "rate": 0.3, "least": 12, "rows": 0.8, "columns": 0.7}


def _rows(n=900):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 9, n), rng.integers(0, 5, n), rng.integers(0, 2, n)])
    return x, x[:, 0] ** 1.5 + 3 * x[:, 2] * (x[:, 1] > 2) + rng.normal(0, 1, n), rng.integers(0, B.BAGS, n)


def _brute(x, y, tag, trees, leaves, rate, least, rows, columns, seed="boost"):
    """Every row, leaf, feature and bin anew at each step."""
    told, out = np.full(len(y), y.mean()), []
    for number in range(trees):
        bag = np.isin(tag, B._part(B.BAGS, rows, f"{seed}:{number}:rows"))
        features = B._part(x.shape[1], columns, f"{seed}:{number}:columns")
        leaf, splits = np.zeros(len(y), int), []
        made = 1
        while len(set(leaf)) < leaves:
            best = None
            for node in sorted(set(leaf)):
                here = bag & (leaf == node)
                r = (y - told)[here]
                for f in features:
                    for cut in range(int(x[:, f].max()) + 1):
                        left = x[here, f] <= cut
                        if min(left.sum(), (~left).sum()) >= least:
                            gain = r[left].sum() ** 2 / left.sum() + r[~left].sum() ** 2 / (~left).sum() - r.sum() ** 2 / len(r)
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = gain, node, int(f), cut
            if best is None:
                break
            gain, node, f, cut = best
            here = leaf == node
            leaf[here] = np.where(x[here, f] <= cut, made, made + 1)
            made += 2
            splits.append((node, f, cut, round(gain, 6)))
        for node in set(leaf):
            here = leaf == node
            told[here] += rate * (y - told)[here & bag].mean()
        out.append(splits)
    return out, told


def test_split_by_split(spark):
    x, y, tag = _rows()
    wanted, told = _brute(x, y, tag, 6, **HOW)
    frame = spark.createDataFrame([(1, *map(int, a), float(b), int(t)) for a, b, t in zip(x, y, tag)], "fold int, a int, b int, c int, y double, t int").repartition(4)
    models = B.fit(B.cells(frame, "fold", NAMES, "y", F.col("t")), "fold", NAMES, trees=6, **HOW)
    base, trees = models[1]
    assert abs(base - y.mean()) < 1e-9
    for tree, splits in zip(trees, wanted):
        inner = np.flatnonzero(tree[:, 0] >= 0)
        order = sorted(inner, key=lambda i: tree[i, 2])  # children are numbered as nodes are split
        assert [(int(i), int(tree[i, 0]), int(tree[i, 1]), round(tree[i, 5], 6)) for i in order] == splits
    assert np.abs(B.predict(base, trees, x) - told).max() < 1e-9
    got = B.predicted(frame, "fold", NAMES, models, ["y", "a", "b", "c"]).collect()
    by = {tuple(map(int, a)): b for a, b in zip(x, told)}
    assert len(got) == len(y) and all(abs(by[(r.a, r.b, r.c)] - r.prediction) < 1e-9 for r in got)


def test_leaves_and_rows():
    x, y, tag = _rows()
    g = B.Grower(x, np.ones(len(y)), y, tag, leaves=31, least=50)
    trees = [g.tree(i) for i in range(40)]
    assert all((t[:, 0] < 0).sum() <= 31 for t in trees) and max((t[:, 0] < 0).sum() for t in trees) > 8
    assert ((y - B.predict(g.base, trees, x)) ** 2).mean() < 0.3 * y.var()
    one = B.Grower(x[:60], np.ones(60), y[:60], tag[:60], least=50)
    assert len(one.tree(0)) == 1  # too few rows for two leaves


def test_bins(spark):
    df = spark.createDataFrame([(g, float(v)) for g in (1, 2) for v in range(200)] + [(1, 0.0)] * 300, "fold int, v double")
    ends = B.edges(df, "fold", ["v"], 8)
    got = df.withColumn("b", B.binned("v", F.col("fold"), ends)).groupBy("fold").agg(F.max("b").alias("most"), F.count_if(F.col("b") == 0).alias("first")).collect()
    assert {r.fold: r.most < 8 for r in got} == {1: True, 2: True} and {r.fold: r.first for r in got}[1] >= 300
