import math
import os

import numpy as np
import pytest

from lodestrata.operators.cycle import partner_distances
from lodestrata.operators.ranks import spearman


def _searched(rows, by, step, first, last):
    size = max(i for i, _ in rows if i is not None) + 1
    out = []
    for a, v in rows:
        for k in range(first, last + 1) if a is not None else ():
            for b, w in rows:
                if b != (a * by + k * step) % size or a >= b:
                    continue
                s, t = str(a), str(b)
                tree = len(s) + len(t) - 2 * len(os.path.commonprefix([s, t]))
                n = 0 if v is None or w is None else math.hypot(*v) * math.hypot(*w)
                out.append((round(1 - np.dot(v, w) / n if n else 1.0, 9), tree))
    return sorted(out)


@pytest.mark.parametrize("step", [7, 12, 60, 1])
def test_partners_on_their_lines(spark, step):
    rng = np.random.default_rng(step)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(60) if i % 9]  # gaps, and steps with common factors with 60
    rows += [(14, [1.0, 2.0, 3.0]), (None, [1.0, 1.0, 1.0])]
    rows[3], rows[5] = (rows[3][0], None), (rows[5][0], [0.0, 0.0, 0.0])
    df = spark.createDataFrame(rows, "n long, v array<double>")
    got = partner_distances(df, "n", "v", 11, step, 1, 70).collect()  # more partners than the circle has places
    assert np.allclose(sorted((r.dist, r.tree) for r in got), _searched(rows, 11, step, 1, 70), atol=1e-8)
    assert partner_distances(df.limit(0), "n", "v", 11, step, 1, 70).count() == 0


def test_ranks_work_their_rows_out_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.range(1000).selectExpr("double(id % 37) AS x", "double(id % 11) AS y").mapInArrow(count, "x double, y double")
    assert spearman(df, "x", "y").first().n == 1000
    assert read.value == 1000
