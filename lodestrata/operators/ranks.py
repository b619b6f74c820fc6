"""Rank correlation whose sort is distributed: ranks come from counts of distinct values, so one window runs over as many rows as there are values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import pearson
from .tables import running, stored


def running_counts(df: DataFrame, column: str, times: str | None = None) -> DataFrame:
    """(column, _n, _u): each distinct value with its rows, and the rows up to and with it in ascending order (null first). A row counts once, or as often as times says."""
    counts = df.groupBy(column).agg((F.sum(times) if times else F.count("*")).alias("_n"))
    return running(counts, [column], {"_u": "_n"}, "counts").select(column, "_n", "_u")


def average_ranks(df: DataFrame, column: str, out: str, times: str | None = None) -> DataFrame:
    """(column, out): each distinct value with its average rank."""
    return running_counts(df, column, times).select(column, (F.col("_u") - (F.col("_n") - 1) / 2).alias(out))


def smallest(df: DataFrame, columns: list[str], key: Column, k: int) -> DataFrame:
    """The k rows of df (distinct in columns) with the smallest key, ties by columns: a threshold on running counts, so a k that is a share of all rows costs no task more than its range."""
    rows = df.select(*columns, key.alias("_key")).withColumn("_one", F.lit(1))
    return running(rows, ["_key", *columns], {"_u": "_one"}, "smallest").where(F.col("_u") <= k).select(*columns)


def quantiles(df: DataFrame, column: str, cuts: list[float]) -> DataFrame:
    """One row with q0, q1, ...: linear quantiles of the present values, whatever their number; no reducer holds them all."""
    run = running_counts(df.where(F.col(column).isNotNull()).select(column), column)
    total = run.agg(F.max("_u").alias("_all"))
    rows = run.crossJoin(F.broadcast(total))  # one row
    at = lambda pos: F.max(F.when((F.col("_u") - F.col("_n") <= pos) & (pos < F.col("_u")), F.col(column)))  # noqa: E731  value at a position from 0
    places = [(F.col("_all") - 1) * F.lit(c) for c in cuts]
    both = rows.agg(F.max("_all").alias("_all"), *(at(F.floor(x)).alias(f"_l{i}") for i, x in enumerate(places)), *(at(F.ceil(x)).alias(f"_h{i}") for i, x in enumerate(places)))
    return both.select(*((F.col(f"_l{i}") + (x - F.floor(x)) * (F.col(f"_h{i}") - F.col(f"_l{i}"))).alias(f"q{i}") for i, x in enumerate(places)))


def top_shares(df: DataFrame, column: str, percents: list[int]) -> DataFrame:
    """(pct, share): what the largest max(1, half-even round(pct % of the rows)) values hold of the sum. Ties hold the same, so their order doesn't matter."""
    run = running_counts(df.select((-F.col(column)).alias("_v")), "_v")
    total = run.agg(F.max("_u").alias("_all"), F.sum(-F.col("_v") * F.col("_n")).alias("_sum"))
    rows = run.crossJoin(F.broadcast(total)).withColumn("pct", F.explode(F.array(*map(F.lit, percents))))  # one row
    k = F.greatest(F.lit(1), F.bround(F.col("pct") / 100 * F.col("_all"), 0))
    taken = F.greatest(F.lit(0), F.least(F.col("_n"), k - (F.col("_u") - F.col("_n"))))
    return rows.groupBy("pct").agg((F.sum(-F.col("_v") * taken) / F.max("_sum")).alias("share"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho) over rows where both are present; NULL rho if one is constant. df is worked out once: its counted pairs are a table, which the ranks are made from."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    pairs = stored(rows.groupBy(x, y).agg(F.count("*").alias("_m")), "counted-pairs")
    ranked = pairs.join(average_ranks(pairs, x, "_rx", "_m"), x).join(average_ranks(pairs, y, "_ry", "_m"), y)
    m, a, b = F.col("_m"), F.col("_rx"), F.col("_ry")
    s = ranked.agg(F.sum(m).alias("n"), F.sum(m * a).alias("sx"), F.sum(m * b).alias("sy"), F.sum(m * a * b).alias("sxy"), F.sum(m * a * a).alias("sxx"), F.sum(m * b * b).alias("syy"))
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return s.select("n", F.when((vx > 0) & (vy > 0), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy)).alias("rho"))


__all__ = ["average_ranks", "pearson", "quantiles", "running_counts", "smallest", "spearman", "top_shares"]
