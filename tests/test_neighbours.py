"""Nearest neighbours by rings against all pairs."""

import numpy as np

from lodestrata.operators import neighbours as N


def _frame(spark, x, labels):
    return spark.createDataFrame([(i, None if v is None else list(map(float, v)), l) for i, (v, l) in enumerate(zip(x, labels))], "id long, v array<double>, labels array<string>").repartition(4)


def _brute(x, labels, k):
    out = {}
    there = [i for i, v in enumerate(x) if v is not None]
    norm = {i: np.linalg.norm(x[i]) for i in there}
    for level in range(len(labels[0])):
        ok = [i for i in there if labels[i][level] is not None]
        for i in ok:
            d = sorted((1.0 if not norm[i] or not norm[j] else max(0.0, 1 - float(np.dot(x[i], x[j])) / norm[i] / norm[j]), j) for j in ok if j != i)[:k]
            out[(level, i)] = [(j, labels[i][level] == labels[j][level]) for _, j in d], [e for e, _ in d]
    return out


def _same(spark, x, labels, k, rows):
    got = {}
    for r in sorted(N.neighbours(_frame(spark, x, labels), k, rows).collect(), key=lambda r: r["rank"]):
        one = got.setdefault((r.level, r.id), ([], []))
        one[0].append((r.other, r.same))
        one[1].append(r.distance)
    want = _brute(x, labels, k)
    assert got.keys() == {key for key, (found, _) in want.items() if found}
    for key, (found, far) in got.items():
        assert np.allclose(far, want[key][1], atol=1e-9)
        assert found == want[key][0]


def test_random_vectors_and_levels(spark):
    rng = np.random.default_rng(6)
    x = list(rng.normal(0, 1, (150, 5)))
    x[3], x[70], x[71], x[9] = np.zeros(5), np.zeros(5), x[8] * 2.5 + 1e-3, None
    labels = [[str(i % 4), None if i % 3 else str(i % 2)] for i in range(150)]
    _same(spark, x, labels, 7, 20)


def test_blocks_that_do_not_meet(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (24, 16))
    x = [centres[i % 24] + rng.normal(0, 0.02, 16) for i in range(960)]
    labels = [[str(i % 24)] for i in range(960)]
    _same(spark, x, labels, 5, 20)
    blocks, pivots = N.rings(_frame(spark, x, labels), 20)
    n, met = blocks.count(), N.block_pairs(blocks, pivots, 5).count()
    assert n >= 40 and met < 0.25 * n * n


def test_few_rows(spark):
    assert N.neighbours(_frame(spark, [np.ones(3)], [["a"]]), 4).collect() == []
    _same(spark, [np.array([1.0, 0]), np.array([1.0, 1]), np.array([2.0, 0])], [["a"], ["b"], ["a"]], 4, 10)
