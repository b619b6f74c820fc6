"""Many ridge fits from one pass: second moments per interval of cutoffs, shared by all folds and configurations.

Rows of one product differ in their own features alone, and a configuration adds a vector of the product's code. So the moments of the own
features are summed per interval and product by Spark, and vectors meet these sums, one row per product, instead of the rows. What a
configuration needs is then the moments of its own features, of its vectors (weighted by the products' rows) and of both together. A fold's
moments are the sums over the intervals up to its cutoff; a configuration's are a part of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import signed_log
from .forecast import HORIZON, SEASON

#: The own features: two lags, whether they are missing, the horizon and the quarter of the year.
FEATURES = ["y_anchor", "y_season", "anchor_missing", "season_missing", *(f"horizon_{h}" for h in range(1, HORIZON + 1)), *(f"season_{k}" for k in range(SEASON))]
#: Partial moments of a configuration and interval are first summed in so many groups.
SALTS = 32


def lagged(series: DataFrame, keys: list[str], time: str = "q", value: str = "v") -> DataFrame:
    """series with y, the lags at each horizon (y, and whether the period is on the spine), and y a season ago: one window for all folds."""
    w = Window.partitionBy(*keys).orderBy(time)
    y = signed_log(F.col(value))
    lags = F.array(*(F.struct(F.lag(y, h).over(w).alias("y"), F.lag(F.lit(1), h).over(w).alias("there")) for h in range(1, HORIZON + 1)))
    return series.withColumns({"y": y, "lags": lags, "season": F.lag(y, SEASON).over(w), "back": F.lag(value, SEASON).over(w)})


def features(horizon: Column, time: str = "q") -> list[Column]:
    """Values of FEATURES of a row of lagged() at a horizon from 1."""
    anchor = F.get("lags", (horizon - 1).cast("int"))["y"]
    one = lambda c: c.cast("double")
    return [F.coalesce(anchor, F.lit(0.0)), F.coalesce("season", F.lit(0.0)), one(anchor.isNull()), one(F.col("season").isNull()), *(one(horizon == h) for h in range(1, HORIZON + 1)), *(one(F.col(time) % SEASON == k) for k in range(SEASON))]


def moments(rows: DataFrame, code: str, cutoffs: list[int], time: str = "q") -> DataFrame:
    """(interval, code, m): per interval of cutoffs and code, sums of all products of [1, features, y] over the training rows (targets present, the horizon's anchor on the spine), the upper triangle row by row."""
    cuts = sorted(cutoffs)
    late = F.lit(len(cuts))
    for i in range(len(cuts) - 1, -1, -1):
        late = F.when(F.col(time) <= cuts[i], i).otherwise(late)
    train = rows.where((F.col(time) <= cuts[-1]) & F.col("y").isNotNull()).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(HORIZON)))).where(F.get("lags", F.col("h") - 1)["there"].isNotNull())
    x = train.select(code, late.alias("interval"), F.lit(1.0).alias("x0"), *(f.alias(f"x{i}") for i, f in enumerate(features(F.col("h"), time), 1)), F.col("y").alias(f"x{len(FEATURES) + 1}"))
    n = len(FEATURES) + 2
    return x.groupBy("interval", code).agg(F.array(*(F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(n) for j in range(i, n))).alias("m"))


def _summed(parts: DataFrame) -> DataFrame:
    """parts (config, interval, salt, packed) added up by config and interval, in two levels; a task holds two of them at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for b in batches:
            for r in b.to_pylist():
                x = np.frombuffer(r["packed"])
                total = x.copy() if total is None else total + x
                key = key or r
        if key:
            yield pa.RecordBatch.from_pylist([{"config": key["config"], "interval": key["interval"], "packed": total.tobytes()}], schema=pa.schema([("config", pa.string()), ("interval", pa.int32()), ("packed", pa.binary())]))

    out = "config string, interval int, packed binary"
    return parts.groupBy("config", "interval", "salt").applyInArrow(add, out).groupBy("config", "interval").applyInArrow(add, out)


def grams(moments_: DataFrame, code: str, vectors: DataFrame, widths: dict[str, int]) -> dict[tuple[str, int], np.ndarray]:
    """{(config, interval): moments of [1, features, y, vector]}: widths[config] numbers a vector (0: none), a code without one has zeros. vectors: config, code, v. The driver receives one square matrix for each configuration and interval."""
    n = len(FEATURES) + 2
    upper = np.triu_indices(n)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        salt = 0
        for b in batches:
            salt = b.column(4)[0].as_py() if b.num_rows else salt
            configs, intervals = np.array(b.column(0).to_pylist()), b.column(1).to_numpy()
            tri = np.array(b.column(2).to_pylist(), float).reshape(-1, len(upper[0]))
            vecs = b.column(3).to_pylist()
            for config in np.unique(configs):
                d = widths[str(config)]
                for interval in np.unique(intervals[configs == config]):
                    at = np.flatnonzero((configs == config) & (intervals == interval))
                    own = np.zeros((len(at), n, n))
                    own[:, upper[0], upper[1]] = own[:, upper[1], upper[0]] = tri[at]
                    v = np.array([vecs[i] if vecs[i] is not None else np.zeros(d) for i in at], float).reshape(len(at), d)
                    g = held.setdefault((str(config), int(interval)), np.zeros((n + d, n + d)))
                    g[:n, :n] += own.sum(0)
                    cross = own[:, 0, :].T @ v  # the first row holds the sums of each feature
                    g[:n, n:] += cross
                    g[n:, :n] += cross.T
                    g[n:, n:] += (v * own[:, 0, 0][:, None]).T @ v
        for (config, interval), g in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([config]), pa.array([interval], pa.int32()), pa.array([salt], pa.int32()), pa.array([g.tobytes()])], ["config", "interval", "salt", "packed"])

    names = moments_.sparkSession.createDataFrame([(c,) for c in widths], "config string")
    met = moments_.crossJoin(F.broadcast(names)).join(vectors.select("config", F.col("code").alias(code), "v"), ["config", code], "left")  # a handful of configurations
    parts = met.select("config", "interval", "m", "v", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")).mapInArrow(run, "config string, interval int, salt int, packed binary")
    got = {}
    for r in _summed(parts).collect():
        x = np.frombuffer(r.packed)
        k = int(round(np.sqrt(len(x))))
        got[(r.config, r.interval)] = x.reshape(k, k)
    return got


def solve(g: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """(constant, weights of [features, vector]) of a ridge fit on standardised columns (population deviation; a constant column has no weight), from the moments of [1, features, y, vector]."""
    y = len(FEATURES) + 1
    x = [i for i in range(1, len(g)) if i != y]
    n = g[0, 0]
    mean, y_mean = g[0, x] / n, g[0, y] / n
    cov = g[np.ix_(x, x)] / n - np.outer(mean, mean)
    var = np.diag(cov).copy()
    flat = var <= 1e-12 * (np.diag(g[np.ix_(x, x)]) / n + 1e-300)
    sd = np.where(flat, 1.0, np.sqrt(np.maximum(var, 1e-300)))
    z = n * cov / np.outer(sd, sd)
    zy = n * (g[x, y] / n - mean * y_mean) / sd
    z[flat, :] = z[:, flat] = 0.0
    zy[flat] = 0.0
    w = np.linalg.solve(z + alpha * np.eye(len(x)), zy) / sd
    return float(y_mean - mean @ w), w


def ridge_grid(moments_: DataFrame, code: str, vectors: DataFrame, widths: dict[str, int], cutoffs: list[int], alpha: float = 10.0) -> dict[tuple[str, int], tuple[float, np.ndarray]]:
    """{(config, cutoff): (constant, weights)} of every configuration and fold."""
    found, out = grams(moments_, code, vectors, widths), {}
    for config in widths:
        total = None
        for i, cutoff in enumerate(sorted(cutoffs)):
            more = found.get((config, i))
            total = more if total is None else total if more is None else total + more
            if total is not None and total[0, 0] > 0:
                out[(config, cutoff)] = solve(total, alpha)
    return out


def records(series: DataFrame, keys: list[str], code: str, vectors: DataFrame, widths: dict[str, int], cutoffs: list[int], unseen: DataFrame | None = None, alpha: float = 10.0, time: str = "q", value: str = "v") -> DataFrame:
    """(model, config, fold, keys, mase, volume, history, n): the seasonal floor, and the ridge model of every configuration, on every fold, from one scan of the series for the fits and one for the scores.

    series: a full spine, NULL where unobserved or imputed; code is one of its columns. A test target is scored if it is observed and its
    series' seasonal error up to the cutoff is above 0. Products in unseen (code) are left out of the fits and scored like others. vectors:
    config, code, v, a row each; a code without one has zeros.
    """
    rows = lagged(series, keys, time, value)
    train = rows if unseen is None else rows.join(unseen.select(code), code, "left_anti")
    fits = ridge_grid(moments(train, code, cutoffs, time), code, vectors, widths, cutoffs, alpha)
    spark, n = series.sparkSession, len(FEATURES)
    known = spark.createDataFrame([(c, f, const, w[:n].tolist()) for (c, f), (const, w) in fits.items()], "config string, fold int, const double, w array<double>")

    def offsets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(c, f, k, float(np.dot(fits[(c, f)][1][n:], v))) for c, k, v in zip(*(b.column(i).to_pylist() for i in range(3))) for f in cutoffs if (c, f) in fits]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["config", "fold", code, "off"])

    off = vectors.select("config", F.col("code").alias(code), "v").where("v IS NOT NULL").mapInArrow(offsets, f"config string, fold long, {code} string, off double")
    folds = rows.withColumn("fold", F.explode(F.array(*map(F.lit, cutoffs))))
    inside = F.col(time) <= F.col("fold")
    scale = folds.groupBy("fold", *keys).agg(F.avg(F.when(inside, F.abs(F.col(value) - F.col("back")))).alias("scale"), F.coalesce(F.sum(F.when(inside, F.col(value))), F.lit(0.0)).alias("volume"), F.count(F.when(inside, F.col(value))).alias("history"))
    h = F.col(time) - F.col("fold")
    test = folds.where(F.col(time).between(F.col("fold") + 1, F.col("fold") + HORIZON) & F.col(value).isNotNull()).withColumn("x", F.array(*features(h, time)))
    inverse = lambda c: F.signum(c) * F.expm1(F.abs(c))
    told = test.join(F.broadcast(known), "fold").join(off, ["config", "fold", code], "left")  # a row for each configuration and fold
    dot = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
    told = told.withColumn("hat", inverse(F.col("const") + dot + F.coalesce("off", F.lit(0.0)))).withColumn("model", F.lit("ridge"))
    floor = test.withColumns({"model": F.lit("floor"), "config": F.lit("none"), "hat": inverse(F.coalesce("season", F.lit(0.0)))})
    err = ["model", "config", "fold", *keys, value, "hat"]
    both = told.select(*err).unionByName(floor.select(*err)).groupBy("model", "config", "fold", *keys).agg(F.avg(F.abs(F.col(value) - F.col("hat"))).alias("e"), F.count("*").alias("n"))
    return both.join(scale.where("scale > 0"), ["fold", *keys]).select("model", "config", "fold", *keys, (F.col("e") / F.col("scale")).alias("mase"), "volume", "history", "n")
