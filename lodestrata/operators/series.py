"""Quarterly series: spine, spans, gap filling, run lengths, diagnostics. Keys are hash-partitioned once; the windows of a step share that partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_to_series(long: DataFrame, keys: list[str], time: str = "q", value: str = "sales_units") -> DataFrame:
    """One row per key and period; a period whose values are all NULL stays NULL."""
    return long.groupBy(*keys, time).agg(F.sum(value).alias(value))


def with_spine(series: DataFrame, keys: list[str], first: int, last: int, time: str = "q", value: str = "sales_units") -> DataFrame:
    """Every period from first to last for every key, NULL where nothing was observed."""
    spine = series.select(*keys).distinct().withColumn(time, F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
    there = series.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(time).alias("_time"), *(c for c in series.columns if c not in (*keys, time)))
    same = F.col(time) == F.col("_time")
    for k in keys:  # a null key is a key
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return spine.join(there, same, "left").drop(*(f"_{k}" for k in keys), "_time")


def within_span(series: DataFrame, keys: list[str], time: str = "q", value: str = "sales_units") -> DataFrame:
    """Rows from the first to the last observed period of each key; keys with none go."""
    w = Window.partitionBy(*keys)
    seen = F.when(F.col(value).isNotNull(), F.col(time))
    rows = series.withColumn("_first", F.min(seen).over(w)).withColumn("_last", F.max(seen).over(w))
    return rows.where(F.col(time).between(F.col("_first"), F.col("_last"))).drop("_first", "_last")


def gap_runs(series: DataFrame, keys: list[str], time: str = "q", value: str = "sales_units") -> DataFrame:
    """Adds `run` (length of the run of equal blankness that the row lies in) by gaps and islands."""
    blank = F.col(value).isNull()
    island = F.col(time) - F.row_number().over(Window.partitionBy(*keys, "_blank").orderBy(time))
    rows = series.withColumn("_blank", blank).withColumn("_island", island)
    return rows.withColumn("run", F.count("*").over(Window.partitionBy(*keys, "_blank", "_island"))).withColumnRenamed("_blank", "blank").drop("_island")


def resolve_gaps(series: DataFrame, keys: list[str], method: str = "locf", max_gap: int | None = None, policy: str = "zero", time: str = "q", value: str = "sales_units") -> DataFrame:
    """Truncated to the span, internal gaps filled: locf or linear by position. Runs longer than max_gap become 0 (policy zero) or remove their series (drop).

    Adds is_imputed and resolution in {observed, locf, linear, long_gap_zero}.
    """
    rows = gap_runs(within_span(series, keys, time, value), keys, time, value)
    w = Window.partitionBy(*keys).orderBy(time)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    before = F.last(value, ignorenulls=True).over(back)
    if method == "locf":
        filled = before
    else:
        at = F.when(~F.col("blank"), F.col(time))
        q0, q1, v1 = F.last(at, ignorenulls=True).over(back), F.first(at, ignorenulls=True).over(ahead), F.first(value, ignorenulls=True).over(ahead)
        filled = F.when(F.col("blank"), before + (v1 - before) * (F.col(time) - q0) / (q1 - q0)).otherwise(F.col(value))
    long_gap = F.col("blank") & (F.col("run") > max_gap) if max_gap is not None else F.lit(False)
    rows = rows.withColumn("_filled", filled).withColumn("_long", long_gap)
    if max_gap is not None and policy == "drop":
        rows = rows.withColumn("_any", F.max("_long").over(Window.partitionBy(*keys))).where(~F.col("_any")).drop("_any")
    return rows.select(*keys, time, F.when(F.col("_long"), 0.0).otherwise(F.col("_filled")).alias(value), F.col("blank").alias("is_imputed"), F.when(~F.col("blank"), "observed").when(F.col("_long"), "long_gap_zero").otherwise(method).alias("resolution"))


def blank_stats(series: DataFrame, keys: list[str], n_periods: int, time: str = "q", value: str = "sales_units") -> DataFrame:
    """Per key over a full spine: observed, leading, trailing and internal blanks, the longest run of blanks, span, volume."""
    rows = gap_runs(series, keys, time, value)
    first, last = F.min(F.when(~F.col("blank"), F.col(time))), F.max(F.when(~F.col("blank"), F.col(time)))
    per = rows.groupBy(*keys).agg(
        F.count_if(~F.col("blank")).alias("n_observed"), first.alias("first_q"), last.alias("last_q"), F.min(time).alias("_q0"), F.max(time).alias("_q1"),
        F.coalesce(F.max(F.when(F.col("blank"), F.col("run"))), F.lit(0)).alias("longest_blank"), F.coalesce(F.sum(value), F.lit(0.0)).alias("volume"),
    )
    span = F.coalesce(F.col("last_q") - F.col("first_q") + 1, F.lit(0))
    return per.select(
        *keys, "n_observed", span.cast("long").alias("span"), F.coalesce(F.col("first_q") - F.col("_q0"), F.lit(n_periods)).cast("long").alias("lead_blanks"),
        F.when(F.col("n_observed") == 0, 0).otherwise(F.col("_q1") - F.col("last_q")).cast("long").alias("trail_blanks"), (span - F.col("n_observed")).cast("long").alias("internal"), "longest_blank", "volume", "first_q", "last_q",
    )


def blank_pattern(leading: Column, trailing: Column, internal: Column, n_observed: Column) -> Column:
    return (
        F.when(n_observed == 0, "all_blank").when(internal > 0, "internal_gaps").when((leading > 0) & (trailing > 0), "leading_and_trailing")
        .when(leading > 0, "leading_only").when(trailing > 0, "trailing_only").otherwise("complete")
    )


def autocorrelation(series: DataFrame, keys: list[str], lag: int, time: str = "q", value: str = "sales_units") -> DataFrame:
    """Lag-k autocorrelation per key, blanks as 0, each slice centred by its own mean; NULL where one has no variance."""
    v = F.coalesce(value, F.lit(0.0))
    rows = series.withColumn("x", v).withColumn("y", F.lag(v, lag).over(Window.partitionBy(*keys).orderBy(time))).where("y IS NOT NULL")
    m = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return m.select(*keys, F.when((vx > 1e-9) & (vy > 1e-9), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy)).alias("acf"))


def seasonal_scale(series: DataFrame, keys: list[str], season: int = 4, time: str = "q", value: str = "v") -> DataFrame:
    """Mean |v_t - v_(t - season)| over pairs observed at both ends; NULL if there is none or it is 0. series: a full spine, NULL where unobserved or imputed."""
    back = F.lag(value, season).over(Window.partitionBy(*keys).orderBy(time))
    return series.withColumn("_d", F.abs(F.col(value) - back)).groupBy(*keys).agg(F.nullif(F.avg("_d"), F.lit(0.0)).alias("scale"))
