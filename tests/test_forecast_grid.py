"""The shared moments against separate fits, and the cluster bootstrap against its definition."""

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from lodestrata.operators import forecast as O
from lodestrata.operators import grid

CUTS = [14, 16, 19]


def _series(spark):
    rng, rows = np.random.default_rng(3), []
    for p in range(14):
        for m in range(3):
            level = rng.normal(0, 40)
            for q in range(24):
                rows.append((f"p{p}", f"m{m}", q, None if rng.random() < 0.15 else float(np.round(level + 9 * (q % 4) + rng.normal(0, 5), 2))))
    return rows, spark.createDataFrame(rows, "product string, market string, q long, v double")


def _fits(rows, vectors, width, cutoff, held):
    """Design matrix, target and standardised ridge of one configuration and fold, and the test rows with their predictions."""
    z = lambda v: None if v is None else math.copysign(math.log1p(abs(v)), v)
    by = defaultdict(dict)
    for p, m, q, v in rows:
        by[(p, m)][q] = v
    def feature(s, p, q, h):
        a, season = z(s.get(q - h)), z(s.get(q - 4))
        vec = list(vectors.get(p, np.zeros(width))) if width else []
        return [a or 0.0, season or 0.0, float(a is None), float(season is None), *(float(h == k) for k in range(1, 5)), *(float(q % 4 == k) for k in range(4)), *vec]

    x, y, test = [], [], []
    for (p, m), s in by.items():
        for q, v in s.items():
            if q <= cutoff and v is not None and p not in held:
                for h in range(1, 5):
                    if q - h in s:
                        x.append(feature(s, p, q, h))
                        y.append(z(v))
            if cutoff < q <= cutoff + 4 and v is not None:
                test.append((p, m, v, feature(s, p, q, q - cutoff), s))
    x, y = np.array(x), np.array(y)
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd < 1e-9, 1, sd)
    xs = (x - mean) / sd
    w = np.linalg.solve(xs.T @ xs + 10 * np.eye(x.shape[1]), xs.T @ (y - y.mean()))
    errors, floor = defaultdict(list), defaultdict(list)
    for p, m, v, f, s in test:
        hat = y.mean() + (np.array(f) - mean) / sd @ w
        errors[(p, m)].append(abs(v - math.copysign(math.expm1(abs(hat)), hat)))
        floor[(p, m)].append(abs(v - math.copysign(math.expm1(abs(f[1])), f[1])))
    scale = {}
    for k, s in by.items():
        d = [abs(s[q] - s[q - 4]) for q in s if q <= cutoff and s[q] is not None and s.get(q - 4) is not None]
        scale[k] = np.mean(d) if d else 0
    score = lambda e: {k: np.mean(v) / scale[k] for k, v in e.items() if scale[k] > 0}
    return score(errors), score(floor)


def test_grid_equals_separate_fits(spark):
    rows, series = _series(spark)
    rng = np.random.default_rng(5)
    widths = {"none": 0, "a": 6, "b": 2}
    vectors = {c: {f"p{p}": rng.normal(0, 1, w).tolist() for p in range(13)} for c, w in widths.items() if w}  # the last product has none
    frame = spark.createDataFrame([(c, p, v) for c, vs in vectors.items() for p, v in vs.items()], "config string, code string, v array<double>")
    held = spark.createDataFrame([("p3",), ("p7",)], "product string")
    got = defaultdict(dict)
    for r in grid.records(series, ["product", "market"], "product", frame, widths, CUTS, held).collect():
        got[(r.model, r.config, r.fold)][(r.product, r.market)] = r.mase
    assert len(got) == 12
    for cutoff in CUTS:
        for config, width in widths.items():
            errors, floor = _fits(rows, vectors.get(config, {}), width, cutoff, {"p3", "p7"})
            mine = got[("ridge", config, cutoff)]
            assert mine.keys() == errors.keys() and max(abs(mine[k] - errors[k]) for k in errors) < 1e-8
            assert max(abs(got[("floor", "none", cutoff)][k] - floor[k]) for k in floor) < 1e-9


def test_every_replicate_draws_as_many_as_there_are():
    for n in (1, 5, 512, 513, 3000):
        leaves = [O.drawn_in(n, leaf, 2000, [7, 1]) for leaf in range(-(-n // O.LEAF))]
        times = np.concatenate(leaves, axis=1)
        assert times.shape == (2000, n) and (times.sum(1) == n).all()
        assert abs(times.mean() - 1) < 1e-12
        if n > 100:  # counts of a multinomial draw: variance 1 - 1 / n
            assert abs(times.var(0).mean() - 1) < 0.05 and abs(times.mean(0) - 1).max() < 0.15


def test_interval_like_the_plain_bootstrap(spark):
    rng = np.random.default_rng(9)
    rows = [("g" if i % 3 else "h", f"c{i}", float(x), 1.0 + i % 2) for i, x in enumerate(rng.normal(0.2, 1, 1800)) for _ in range(1 + i % 2)]
    df = spark.createDataFrame(rows + [("bad", "x", 1.0, 0.0), (None, "y", 1.0, 2.0)], "grp string, c string, num double, den double")
    first = {r.grp: r for r in O.bootstrap_ratio(df, ["c"], "num", "den", ["grp"]).collect()}
    again = {r.grp: r for r in O.bootstrap_ratio(df.repartition(7), ["c"], "num", "den", ["grp"]).collect()}
    assert first.keys() == again.keys() == {"g", "h", None} and first[None].estimate == 0.5
    for g in ("g", "h"):
        assert all(abs(first[g][c] - again[g][c]) < 1e-12 for c in ("estimate", "low", "high", "p"))
        sums = defaultdict(lambda: [0.0, 0.0])
        for grp, c, a, b in rows:
            if grp == g:
                sums[c][0] += a
                sums[c][1] += b
        v = np.array(list(sums.values()))
        boot = np.array([v[i].sum(0) for i in rng.integers(0, len(v), (2000, len(v)))])
        low, high = np.percentile(boot[:, 0] / boot[:, 1], [2.5, 97.5])
        width = high - low
        assert abs(first[g].estimate - v[:, 0].sum() / v[:, 1].sum()) < 1e-12 and first[g].n_clusters == len(v)
        assert abs(first[g].low - low) < 0.12 * width and abs(first[g].high - high) < 0.12 * width
