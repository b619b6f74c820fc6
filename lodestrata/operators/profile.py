"""Profiles: summaries, distributions, shares, reports in (metric, value) form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import strip
from .tables import stored


def metric_table(row: DataFrame, metrics: list[str]) -> DataFrame:
    """One-row aggregate -> (metric, value) rows."""
    parts = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    return row.select(F.expr(f"stack({len(metrics)}, {parts}) as (metric, value)"))


def gini(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """Gini coefficient per key over values clipped at 0; 0 for an empty or zero sum. Sorted by windows per key; without keys use gini_of_counts, which sorts distinct values alone."""
    w = Window.partitionBy(*keys).orderBy("x")
    rows = df.withColumn("x", F.greatest(F.col(value), F.lit(0.0))).withColumn("i", F.row_number().over(w))
    s = rows.groupBy(*keys).agg(F.sum(F.col("i") * F.col("x")).alias("ix"), F.sum("x").alias("sx"), F.count("*").alias("n"))
    return s.select(*keys, F.when(F.col("sx") > 0, 2 * F.col("ix") / (F.col("n") * F.col("sx")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0).alias("gini"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Σwx / Σw over rows with a finite value, weights clipped at 0; the plain mean where no weight is left."""
    ok = value.isNotNull() & ~F.isnan(value)
    w = F.when(ok, F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0)))
    return F.when(F.sum(w) > 0, F.sum(w * value) / F.sum(w)).otherwise(F.avg(F.when(ok, value)))


def average_rank(column: str, partition: list[str] = ()) -> Column:
    """Rank with ties averaged."""
    w = Window.partitionBy(*partition)
    return F.rank().over(w.orderBy(column)) + (F.count("*").over(Window.partitionBy(*partition, column)) - 1) / 2


def pearson(df: DataFrame, x: str, y: str, keys: list[str] = ()) -> DataFrame:
    """Correlation from moments; NULL where a column is constant."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    m = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * b).alias("sxy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"))
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return m.select(*keys, "n", F.when((vx > 0) & (vy > 0), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy)).alias("rho"))


def macro_f1(pred: DataFrame, truth: str = "label", guess: str = "prediction") -> DataFrame:
    """Mean F1 over the classes of either column, from confusion counts."""
    c = pred.select(F.col(truth).alias("t"), F.col(guess).alias("p")).groupBy("t", "p").count()
    side = c.select(F.explode(F.array(F.struct(F.col("t").alias("k"), F.col("count").alias("a"), F.lit(0).cast("long").alias("b")), F.struct(F.col("p").alias("k"), F.lit(0).cast("long").alias("a"), F.col("count").alias("b")))).alias("s"), F.when(F.col("t") == F.col("p"), F.col("count")).otherwise(0).alias("hit"))
    per = side.groupBy("s.k").agg(F.sum("s.a").alias("truth"), F.sum("s.b").alias("guess"), (F.sum("hit") / 2).alias("hit"))
    return per.select(F.when(F.col("truth") + F.col("guess") > 0, 2 * F.col("hit") / (F.col("truth") + F.col("guess"))).otherwise(0.0).alias("f1")).agg(F.avg("f1").alias("macro_f1"))


def value_table(df: DataFrame, columns: list[str], order: Column) -> DataFrame:
    """(column, value, n, first): every distinct text of every column, with its rows and the smallest `order` among them; '' is missing, like NULL. One scan, summed before the shuffle; a table."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.nullif(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns))
    rows = df.select(order.alias("_order"), F.explode(cells).alias("x"))
    return stored(rows.groupBy("x.column", "x.value").agg(F.count("*").alias("n"), F.min("_order").alias("first")), "values")


def raw_profile(values: DataFrame, types: dict[str, str], expected: dict[str, str], examples: int = 5) -> DataFrame:
    """A row per column from value_table(): what is expected in it, its type, present and missing rows, distinct values, and the first different texts (stripped, not empty) by the order of the rows.

    What is kept of a column for its examples is the first `examples` texts, in each task before they meet, whatever the number of values.
    """
    there = F.col("value").isNotNull()
    counts = values.groupBy("column").agg(F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("non_null_rows"), F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)).alias("missing_rows"), F.count("value").alias("unique_values"))
    texts = values.select("column", strip(F.col("value")).alias("text"), "first").where("text <> ''").groupBy("column", "text").agg(F.min("first").alias("first"))
    kept = texts.withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy("first", "text"))).where(F.col("k") <= examples)
    said = kept.groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), " | ").alias("example_values"))
    known = values.sparkSession.createDataFrame([(c, expected.get(c, ""), t) for c, t in types.items()], "column string, expected_content string, dtype string")
    out = known.join(counts, "column", "left").join(said, "column", "left").fillna(0, ["non_null_rows", "missing_rows", "unique_values"]).fillna("", ["example_values"])
    return out.withColumn("missing_pct", F.coalesce(F.col("missing_rows") / F.nullif(F.col("missing_rows") + F.col("non_null_rows"), F.lit(0)), F.lit(0.0)))
