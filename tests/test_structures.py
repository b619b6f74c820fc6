"""Running numbers, paths, drawn pairs and complements against loops."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import hierarchy as H
from lodestrata.operators import ranks, series, strata, training


@pytest.fixture
def no_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    yield
    spark.conf.unset("spark.sql.exchange.reuse")


def test_ranks_without_exchange_reuse(spark, no_reuse):
    df = spark.range(60_000).select((F.pmod(F.xxhash64("id"), F.lit(25_000)) / 7).alias("x"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(900)).alias("y")).persist()
    x = np.sort(np.array([r.x for r in df.collect()]))
    got = ranks.running_counts(df, "x").collect()
    assert [r._u for r in sorted(got, key=lambda r: r.x)] == np.searchsorted(x, np.unique(x), side="right").tolist()
    cuts = [0.01, 0.25, 0.5, 0.99]
    assert np.allclose(list(ranks.quantiles(df, "x", cuts).first()), np.quantile(x, cuts))
    pairs = np.array([(r.x, r.y) for r in df.collect()])
    rank = lambda v: (np.searchsorted(np.sort(v), v, side="left") + np.searchsorted(np.sort(v), v, side="right") + 1) / 2
    assert abs(ranks.spearman(df, "x", "y").first().rho - np.corrcoef(rank(pairs[:, 0]), rank(pairs[:, 1]))[0, 1]) < 1e-9
    assert {r.id for r in ranks.smallest(spark.range(500), ["id"], F.pmod(F.col("id"), F.lit(3)), 180).collect()} == set(range(0, 500, 3)) | {1 + 3 * i for i in range(13)}
    df.unpersist()


def test_spine_keeps_null_keys(spark):
    rows = spark.createDataFrame([(None, "m", 3, 5.0), ("p", None, 4, 7.0), ("p", "m", 5, 1.0)], "product string, market string, q long, v double")
    got = {(r.product, r.market, r.q): r.v for r in series.with_spine(rows, ["product", "market"], 3, 5, value="v").collect()}
    assert len(got) == 9 and {k: v for k, v in got.items() if v is not None} == {(None, "m", 3): 5.0, ("p", None, 4): 7.0, ("p", "m", 5): 1.0}


def _searched(edges):
    """Shortest and longest path of every pair, by walking every path."""
    out = {}

    def walk(top, at, n):
        for a, b in edges:
            if a == at:
                s, l = out.get((top, b), (n, n))  # noqa: E741
                out[(top, b)] = min(s, n), max(l, n)
                walk(top, b, n + 1)

    for top in {a for a, _ in edges}:
        walk(top, top, 1)
    return out


def test_paths(spark):
    rng = random.Random(8)
    graphs = [[("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "d")], [(f"n{i}", f"n{i + 1}") for i in range(19)]]
    graphs += [sorted({(f"n{i:02}", f"n{j:02}") for i in range(14) for j in range(i + 1, 14) if rng.random() < 0.25})]
    # codes whose middle levels are missing hang from the nearest one there is
    graphs += [[("A", "A01BC01"), ("A", "A02B"), ("A02B", "A02BC02")]]
    for edges in graphs:
        df = spark.createDataFrame([*edges, edges[0], (None, "b")], "parent string, child string")
        assert {(r.ancestor, r.descendant): (r.shortest, r.longest) for r in H.paths(df).collect()} == _searched(edges)
    with pytest.raises(ValueError, match="cycle"):
        H.paths(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "b")], "parent string, child string"))
    assert H.paths(spark.createDataFrame([], "parent string, child string")).collect() == []


def test_ranks_by_paths(spark):
    codes = spark.createDataFrame([(c,) for c in "abcdx"], "code string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "parent string, child string")
    assert {r.code: (r.sp, r.lp, r["rank"]) for r in H.ranks(codes, edges).collect()} == {"a": (1, 3, 0.25), "b": (2, 2, 0.5), "c": (2, 1, 2 / 3), "d": (3, 0, 1.0), "x": (1, 0, 1.0)}


def _items(n):
    return [(i, [str(i)[: k + 1] for k in range(len(str(i)))]) for i in range(n)]


def test_drawn_pairs_are_even_and_different(spark):
    items = spark.createDataFrame(_items(130), "id long, path array<string>")
    tree = lambda a, b: len(str(a)) + len(str(b)) - 2 * next(k for k in range(9, -1, -1) if str(a)[:k] == str(b)[:k] and len(str(a)) >= k <= len(str(b)))
    every = {frozenset((a, b)): tree(a, b) for a in range(130) for b in range(a)}
    groups = [(1, 2), (3, 4), (5, 99)]
    seen = Counter()
    for seed in range(10):
        got = strata.stratified_pairs(items, groups, 400, f"s{seed}").collect()
        pairs = [frozenset((r.a, r.b)) for r in got]
        assert len(set(pairs)) == len(pairs) and all(every[p] == r.tree for p, r in zip(pairs, got))
        sizes = Counter(r.stratum for r in got)
        for low, high in groups:
            assert sizes[f"{low}-{high}"] == min(400, sum(low <= t <= high for t in every.values()))
        seen.update(pairs)
    for low, high in groups:
        pool = [p for p, t in every.items() if low <= t <= high]
        share = min(1, 400 / len(pool))
        counts = np.array([seen[p] for p in pool])
        # each pair's number of draws is binomial, or all
        assert counts.min() == 10 if share == 1 else abs(counts.mean() - 10 * share) < 1e-9 and counts.var() < 1.2 * 10 * share * (1 - share)


def test_draws():
    for total, k in ((0, 5), (3, 5), (10**12, 1000), (1001, 1000)):
        got = strata.draws(total, k, "x")
        assert len(set(got)) == len(got) == min(total, k) and all(0 <= t < total for t in got) and got == sorted(got)


def test_negatives_come_from_the_whole_complement(spark):
    names = [f"c{i:02}" for i in range(24)]
    codes = spark.createDataFrame([(c,) for c in names], "code string")
    rng = random.Random(2)
    near = {u: set(rng.sample(names, k)) - {u} for u, k in zip(names, [0, 23, 24, 21, 22, 12, 3] * 4)}
    edges = spark.createDataFrame([(u, v) for u, vs in near.items() for v in vs], "u string, v string")
    seen = Counter()
    for seed in range(15):
        got = {}
        for r in training.negative_samples(codes, edges, 5, f"s{seed}").collect():
            got.setdefault(r.u, []).append(r.negative)
        for u in names:
            left = set(names) - near[u] - {u}
            drawn = got.get(u, [])
            assert len(drawn) == (5 if left else 0) and set(drawn) <= left
            assert len(left) < 5 or len(set(drawn)) == 5
            seen.update((u, v) for v in drawn)
    wide = [u for u in names if len(near[u]) <= 3]
    counts = np.array([seen[(u, v)] for u in wide for v in set(names) - near[u] - {u}])
    expected = np.concatenate([np.full(23 - len(near[u]), 75 / (23 - len(near[u]))) for u in wide])
    assert abs((counts - expected).mean()) < 0.2 and counts.min() >= 0 and counts.max() <= 12
