"""Forecast operators: fold rows, seasonal floor, scores, paired comparison, bootstrap, Holm."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import signed_log
from .ranks import smallest
from .tables import running, stored

#: Horizons and season of the direct multi-horizon forecast.
HORIZON, SEASON = 4, 4


def fold_rows(series: DataFrame, keys: list[str], cutoff: int, test: bool = False, time: str = "q", value: str = "v") -> DataFrame:
    """Training rows (every target up to the cutoff and every horizon whose anchor exists, target observed) or test rows (targets cutoff + 1..HORIZON, anchored at the cutoff).

    series: a full spine, NULL where unobserved or imputed. Missing features are 0 with a flag.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    y = signed_log(F.col(value))
    lags = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lag(y, h).over(w).alias("y"), F.lag(F.lit(1), h).over(w).alias("there")) for h in range(1, HORIZON + 1)))
    rows = series.withColumn("_y", y).withColumn("_lags", lags).withColumn("_season", F.lag(y, SEASON).over(w))
    if test:
        rows = rows.where(F.col(time).between(cutoff + 1, cutoff + HORIZON)).withColumn("_a", F.get("_lags", (F.col(time) - cutoff - 1).cast("int")))
    else:
        rows = rows.where((F.col(time) <= cutoff) & F.col("_y").isNotNull()).withColumn("_a", F.explode("_lags")).where("_a.there IS NOT NULL")
    return rows.select(*keys, time, F.col("_a.horizon").alias("horizon"), F.col("_y").alias("y"), F.coalesce("_a.y", F.lit(0.0)).alias("y_anchor"), F.coalesce("_season", F.lit(0.0)).alias("y_season"), F.col("_a.y").isNull().alias("anchor_missing"), F.col("_season").isNull().alias("season_missing"), F.col(value).alias("units"))


def in_sample(series: DataFrame, keys: list[str], cutoff: int, time: str = "q", value: str = "v") -> DataFrame:
    """Per key up to the cutoff: scale (seasonal-naive MAE, NULL if undefined), volume, history."""
    w = Window.partitionBy(*keys).orderBy(time)
    rows = series.where(F.col(time) <= cutoff).withColumn("_d", F.abs(F.col(value) - F.lag(value, SEASON).over(w)))
    return rows.groupBy(*keys).agg(F.nullif(F.avg("_d"), F.lit(0.0)).alias("scale"), F.coalesce(F.sum(value), F.lit(0.0)).alias("volume"), F.count(value).alias("history"))


def score(predictions: DataFrame, scales: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    """MASE per key: mean absolute error over observed targets / scale; keys without a scale or target go."""
    err = F.avg(F.abs(F.col(actual) - F.col(predicted)))
    per = predictions.where(F.col(actual).isNotNull()).groupBy(*keys).agg(err.alias("_e"), F.count("*").alias("n"))
    return per.join(scales.where("scale IS NOT NULL"), keys).select(*keys, (F.col("_e") / F.col("scale")).alias("mase"), "volume", "history", "n")


def summary(scores: DataFrame, by: list[str]) -> DataFrame:
    w = F.greatest(F.col("volume"), F.lit(0.0))
    m = F.col("mase")
    return scores.groupBy(*by).agg(F.count("*").alias("n_series"), F.avg(m).alias("mean_mase"), F.median(m).alias("median_mase"), F.when(F.sum(w) > 0, F.sum(w * m) / F.sum(w)).otherwise(F.avg(m)).alias("weighted_mase"))


#: So many clusters are drawn among at once by one generator.
LEAF = 512


def drawn_in(n: int, leaf: int, replicates: int, seed: list[int], size: int = LEAF) -> np.ndarray:
    """How often each cluster of a leaf (numbers leaf * size on, of n in all) is drawn in each replicate of n draws from n.

    The leaves are halved again and again; how many of a node's draws fall in its first half is binomial, from a generator that the node's
    place seeds. So every leaf finds the same way down for itself, draws of all leaves add up to n in every replicate, and reruns agree.
    """
    low, high, count = 0, -(-n // size), np.full(replicates, n, np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        first = np.random.default_rng([*seed, low, high]).binomial(count, (mid - low) * size / (min(high * size, n) - low * size))
        low, high, count = (low, mid, first) if leaf < mid else (mid, high, count - first)
    here = min(size, n - low * size)
    return np.random.default_rng([*seed, low, high]).multinomial(count, np.full(here, 1 / here))


def bootstrap_ratio(rows: DataFrame, cluster: list[str], num: str, den: str, by: list[str] = (), replicates: int = 2000, seed: int = 7) -> DataFrame:
    """Σnum / Σden with a percentile interval and a two-sided p; a replicate draws as many clusters as there are, anew and with repeats.

    Clusters are summed first and numbered within their group; a task has LEAF of them at a time and finds their draws by itself, and a
    replicate is the sum over leaves. Groups with Σden <= 0 go; n_rows counts the rows, null sums count as 0.
    """
    by = list(by)
    cluster = [c for c in cluster if c not in by]
    per = rows.groupBy(*by, *cluster).agg(F.coalesce(F.sum(num), F.lit(0.0)).cast("double").alias("_n"), F.coalesce(F.sum(den), F.lit(0.0)).cast("double").alias("_d"), F.count("*").alias("_rows")).withColumn("_one", F.lit(1))
    per = stored(running(per, [*by, *cluster], {"_at": "_one"}, "clusters"), "clusters")
    whole = per.groupBy(*by).agg(F.min("_at").alias("_first"), F.count("*").alias("n_clusters"), F.sum("_rows").alias("n_rows"), F.sum("_n").alias("_sn"), F.sum("_d").alias("_sd")).where("_sd > 0")
    group = F.concat_ws("\x1f", *(F.coalesce(F.col(b).cast("string"), F.lit("\x00")) for b in by)) if by else F.lit("")
    whole = stored(whole.withColumn("_g", group), "groups")
    tagged = per.withColumn("_g", group).join(whole.select("_g", "_first", "n_clusters"), "_g").withColumn("_i", F.col("_at") - F.col("_first"))
    tagged = tagged.select("_g", F.floor(F.col("_i") / LEAF).alias("_leaf"), "_i", "_n", "_d", F.col("n_clusters").alias("_all"))

    def draw(part: pa.Table) -> pa.Table:
        part = part.sort_by("_i")
        g, leaf, n = part.column("_g")[0].as_py(), part.column("_leaf")[0].as_py(), part.column("_all")[0].as_py()
        times = drawn_in(n, leaf, replicates, [seed, zlib.crc32(g.encode())])
        return pa.table({"_g": [g] * replicates, "_r": np.arange(replicates), "_bn": times @ part.column("_n").to_numpy(), "_bd": times @ part.column("_d").to_numpy()})

    boot = tagged.groupBy("_g", "_leaf").applyInArrow(draw, "_g string, _r long, _bn double, _bd double").groupBy("_g", "_r").agg((F.sum("_bn") / F.nullif(F.sum("_bd"), F.lit(0.0))).alias("_s"))
    ci = boot.groupBy("_g").agg(F.percentile("_s", 0.025).alias("low"), F.percentile("_s", 0.975).alias("high"), F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("_s") >= 0).cast("int")), F.avg((F.col("_s") <= 0).cast("int")))).alias("p"))
    return whole.join(ci, "_g").select(*by, "n_clusters", "n_rows", (F.col("_sn") / F.col("_sd")).alias("estimate"), "low", "high", "p")


def holm(df: DataFrame, p: str, key: str, by: list[str] = ()) -> DataFrame:
    """Adds p_holm: running maximum of (n - rank) p, capped at 1, within each family (rows equal in by). A family is a report of a few rows."""
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    w = every.orderBy(p, key)
    step = (F.count("*").over(every) - F.row_number().over(w) + 1) * F.col(p)
    return df.withColumn("_s", step).withColumn("p_holm", F.least(F.lit(1.0), F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def holdout(df: DataFrame, key: str, fraction: float, seed: str) -> DataFrame:
    """About `fraction` of the distinct keys: those with the smallest seeded hash; half-even rounding of their number."""
    keys = df.select(key).distinct()
    n = keys.count()
    k = round(n * fraction)
    return smallest(keys, [key], F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), k)
