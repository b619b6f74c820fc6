"""Principal axes by stacked triangles against NumPy, at the width of real embeddings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import vectors as V


def _frame(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>").repartition(5)


def test_width_of_a_thousand(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (1500, 1024)) * np.geomspace(1e-6, 10, 1024) + 300  # small axes beside a large mean
    df = _frame(spark, x).persist()
    r, mean, n = V.triangle(df, "v")
    assert n == 1500 and np.allclose(mean, x.mean(0)) and r.shape == (1024, 1024)
    sv = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert np.allclose(np.linalg.svd(r, compute_uv=False), sv, rtol=1e-6, atol=1e-9)
    p = sv**2 / (sv**2).sum()
    assert abs(V.isotropy(df, "v") - np.exp(-(p * np.log(p)).sum()) / 1024) < 1e-9
    df.unpersist()


def test_projection(spark):
    x = np.random.default_rng(2).normal(0, 1, (40, 7)) @ np.diag([5, 4, 3, 1, 1, 0.5, 0])
    got = np.array([r.pca for r in V.pca(_frame(spark, x), "v", 3).orderBy("id").collect()])
    _, _, axes = np.linalg.svd(x - x.mean(0))
    want = (x - x.mean(0)) @ axes[:3].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-9)


def test_few_and_equal_vectors(spark):
    r, mean, n = V.triangle(_frame(spark, np.array([[1.0, 2.0, 3.0], [3.0, 2.0, 1.0]])), "v")
    assert n == 2 and np.allclose(mean, [2, 2, 2]) and np.allclose(r.T @ r, np.array([[2, 0, -2], [0, 0, 0], [-2, 0, 2]]))
    assert np.isnan(V.isotropy(_frame(spark, np.ones((9, 4))), "v"))
    df = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, v array<double>")
    assert V.triangle(df, "v")[2] == 2
    with pytest.raises(ValueError, match="no vector"):
        V.triangle(df.where(F.col("id") < 0), "v")
