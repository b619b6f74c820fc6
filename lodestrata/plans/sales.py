"""Queries over the prepared sales table: aggregation, reshape, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import profile as P
from ..operators.ranks import quantiles
from .base import DIMS, FULL, LONG, PREPARED, full_series, long_table, period_bounds, prepared, table
from .registry import query


@query("prep_long_agg", f"WITH {PREPARED} SELECT product, dosage, brand, market, q, (q // 4)::VARCHAR || 'Q' || (q % 4 + 1)::VARCHAR AS quarter_label, make_date(q // 4, (q % 4) * 3 + 1, 1) AS quarter_start, sales_units, source_rows, missing_sales_rows FROM a")
def prep_long_agg(spark, d):
    return prepared(spark, d).select(*DIMS, "q", X.ordinal_label(F.col("q")).alias("quarter_label"), X.quarter_start(F.col("q")).alias("quarter_start"), "sales_units", "source_rows", "missing_sales_rows")


@query("merge_series", f"WITH {LONG} SELECT product, market, q, sum(sales_units) AS sales_units FROM f GROUP BY ALL")
def merge_series(spark, d):
    return long_table(spark, d).groupBy("product", "market", "q").agg(F.sum("sales_units").alias("sales_units"))


@query("wide_pivot", f"WITH {LONG} SELECT brand, market, " + ", ".join(f"sum(CASE WHEN q % 4 = {k} AND q // 4 = {y} THEN sales_units END) AS \"{y}Q{k + 1}\"" for y in range(1995, 2002) for k in range(4) if (y, k) <= (2001, 2)) + " FROM f GROUP BY ALL")
def wide_pivot(spark, d):
    labels = [f"{y}Q{k + 1}" for y in range(1995, 2002) for k in range(4) if (y, k) <= (2001, 2)]
    return long_table(spark, d).withColumn("label", X.ordinal_label(F.col("q"))).groupBy("brand", "market").pivot("label", labels).agg(F.sum("sales_units"))


@query("unpivot_long", f"WITH {LONG}, w AS (SELECT brand, market, " + ", ".join(f"sum(CASE WHEN q = {1995 * 4 + k} THEN sales_units END) AS q{k}" for k in range(4)) + " FROM f GROUP BY ALL) SELECT brand, market, unnest(['q0', 'q1', 'q2', 'q3']) AS quarter, unnest([q0, q1, q2, q3]) AS sales_units FROM w")
def unpivot_long(spark, d):
    wide = long_table(spark, d).groupBy("brand", "market").agg(*(F.sum(F.when(F.col("q") == 1995 * 4 + k, F.col("sales_units"))).alias(f"q{k}") for k in range(4)))
    return wide.unpivot(["brand", "market"], ["q0", "q1", "q2", "q3"], "quarter", "sales_units")


def _summary(dim: str, others: list[str]):
    sql = f"WITH {PREPARED} SELECT {dim}, sum(sales_units) AS sales_units, count(*) AS n_rows, " + ", ".join(f"count(DISTINCT {o}) AS n_{o}" for o in others) + " FROM a GROUP BY ALL"

    @query(f"summarize_by_{'quarter' if dim == 'q' else dim}", sql)
    def run(spark, d):
        # few distinct values per group: sets of them are gathered in one aggregation instead of expanding rows per distinct count
        return prepared(spark, d).groupBy(dim).agg(F.sum("sales_units").alias("sales_units"), F.count("*").alias("n_rows"), *(F.size(F.collect_set(o)).cast("long").alias(f"n_{o}") for o in others))


for _dim in (*DIMS, "q"):
    _summary(_dim, [o for o in (*DIMS, "q") if o != _dim])


@query("time_coverage", f"WITH {PREPARED} SELECT q, count(*) AS n_rows, count(*) FILTER (WHERE sales_units > 0) AS n_positive, count(*) FILTER (WHERE sales_units < 0) AS n_negative, count(*) FILTER (WHERE sales_units = 0) AS n_zero, count(DISTINCT product) AS n_products, count(DISTINCT market) AS n_markets, round(count(*) FILTER (WHERE sales_units > 0) / count(*), 6) AS positive_share FROM a GROUP BY q")
def time_coverage(spark, d):
    u = F.col("sales_units")
    return prepared(spark, d).groupBy("q").agg(F.count("*").alias("n_rows"), F.count_if(u > 0).alias("n_positive"), F.count_if(u < 0).alias("n_negative"), F.count_if(u == 0).alias("n_zero"), F.count_distinct("product").alias("n_products"), F.count_distinct("market").alias("n_markets"), F.round(F.count_if(u > 0) / F.count("*"), 6).alias("positive_share"))


@query("top_combinations", f"WITH {PREPARED} SELECT product, brand, market, sum(sales_units) AS total, round(avg(sales_units), 6) AS mean, max(sales_units) AS peak, count(*) FILTER (WHERE sales_units > 0) AS n_positive FROM a GROUP BY ALL ORDER BY total DESC, product, brand, market LIMIT 100")
def top_combinations(spark, d):
    u = F.col("sales_units")
    return prepared(spark, d).groupBy("product", "brand", "market").agg(F.sum(u).alias("total"), F.round(F.avg(u), 6).alias("mean"), F.max(u).alias("peak"), F.count_if(u > 0).alias("n_positive")).orderBy(F.desc("total"), "product", "brand", "market").limit(100)


@query("dosage_mix", f"WITH {PREPARED} SELECT product, count(DISTINCT dosage) AS n_dosages, string_agg(DISTINCT dosage, ' | ' ORDER BY dosage) AS dosages FROM a GROUP BY product")
def dosage_mix(spark, d):
    kinds = F.collect_set("dosage")
    return prepared(spark, d).groupBy("product").agg(F.size(kinds).cast("long").alias("n_dosages"), F.array_join(F.array_sort(kinds), " | ").alias("dosages"))


@query("dimension_profile", f"WITH {PREPARED}, x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, sum(sales_units) AS total FROM a GROUP BY {c}" for c in DIMS) + ") SELECT dimension, count(value) AS n_unique, count(*) FILTER (WHERE value IS NULL) AS n_null_groups, arg_max(value, (total, value)) AS top_value, max(total) AS top_total FROM x GROUP BY dimension")
def dimension_profile(spark, d):
    rows = prepared(spark, d).select("sales_units", F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in DIMS))).alias("x"))
    per = rows.groupBy("x.dimension", "x.value").agg(F.sum("sales_units").alias("total"))
    return per.groupBy("dimension").agg(F.count("value").alias("n_unique"), F.count_if(F.col("value").isNull()).alias("n_null_groups"), F.max_by("value", F.struct("total", "value")).alias("top_value"), F.max("total").alias("top_total"))


_CUTS = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.95, 0.99)


@query("sales_distribution", f"WITH {PREPARED}, x AS (SELECT count(*) FILTER (WHERE sales_units IS NULL) AS blank, count(*) FILTER (WHERE sales_units = 0) AS zero, count(*) FILTER (WHERE sales_units > 0) AS positive, count(*) FILTER (WHERE sales_units < 0) AS negative, round(avg(sales_units), 6) AS mean, round(stddev_samp(sales_units), 6) AS std, " + ", ".join(f"round(quantile_cont(sales_units, {c}), 6) AS p{int(100 * c)}" for c in _CUTS) + " FROM a) SELECT unnest(['blank', 'zero', 'positive', 'negative', 'mean', 'std', " + ", ".join(f"'p{int(100 * c)}'" for c in _CUTS) + "]) AS metric, unnest([blank, zero, positive, negative, mean, std, " + ", ".join(f"p{int(100 * c)}" for c in _CUTS) + "]::DOUBLE[]) AS value FROM x")
def sales_distribution(spark, d):
    u = F.col("sales_units")
    row = prepared(spark, d).agg(F.count_if(u.isNull()).alias("blank"), F.count_if(u == 0).alias("zero"), F.count_if(u > 0).alias("positive"), F.count_if(u < 0).alias("negative"), F.round(F.avg(u), 6).alias("mean"), F.round(F.stddev_samp(u), 6).alias("std"))
    cuts = quantiles(prepared(spark, d), "sales_units", list(_CUTS)).select(*(F.round(f"q{i}", 6).alias(f"p{int(100 * c)}") for i, c in enumerate(_CUTS)))
    row = row.crossJoin(F.broadcast(cuts))  # one row each
    return P.metric_table(row, ["blank", "zero", "positive", "negative", "mean", "std", *(f"p{int(100 * c)}" for c in _CUTS)])


_OVERVIEW = ["n_rows", "n_products", "n_dosages", "n_brands", "n_markets", "n_quarters", "source_rows", "missing_sales_rows", "total", "positive_total", "negative_total"]


@query("overview", f"WITH {PREPARED}, x AS (SELECT count(*) AS n_rows, count(DISTINCT product) AS n_products, count(DISTINCT dosage) AS n_dosages, count(DISTINCT brand) AS n_brands, count(DISTINCT market) AS n_markets, count(DISTINCT q) AS n_quarters, sum(source_rows) AS source_rows, sum(missing_sales_rows) AS missing_sales_rows, sum(sales_units) AS total, sum(CASE WHEN sales_units > 0 THEN sales_units END) AS positive_total, sum(CASE WHEN sales_units < 0 THEN sales_units END) AS negative_total FROM a) SELECT unnest([" + ", ".join(f"'{m}'" for m in _OVERVIEW) + "]) AS metric, unnest([" + ", ".join(_OVERVIEW) + "]::DOUBLE[]) AS value FROM x")
def overview(spark, d):
    u = F.col("sales_units")
    row = prepared(spark, d).agg(
        F.count("*").alias("n_rows"), *(F.size(F.collect_set(c)).alias(n) for c, n in (("product", "n_products"), ("dosage", "n_dosages"), ("brand", "n_brands"), ("market", "n_markets"), ("q", "n_quarters"))),
        F.sum("source_rows").alias("source_rows"), F.sum("missing_sales_rows").alias("missing_sales_rows"), F.sum(u).alias("total"), F.sum(F.when(u > 0, u)).alias("positive_total"), F.sum(F.when(u < 0, u)).alias("negative_total"),
    )
    return P.metric_table(row, _OVERVIEW)


@query("blank_profile", f"WITH {FULL} SELECT q, count(*) FILTER (WHERE v IS NULL) AS n_blank, count(*) AS n_cells, round(count(*) FILTER (WHERE v IS NULL) / count(*), 6) AS blank_share FROM s GROUP BY q")
def blank_profile(spark, d):
    blank = F.count_if(F.col("v").isNull())
    return full_series(spark, d).groupBy("q").agg(blank.alias("n_blank"), F.count("*").alias("n_cells"), F.round(blank / F.count("*"), 6).alias("blank_share"))


@query("column_profile", "WITH x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) FILTER (WHERE {c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_unique, min({c}::VARCHAR) AS least, max({c}::VARCHAR) AS most FROM part" for c in ("p_name", "p_brand", "p_type", "p_size")) + ") SELECT * FROM x")
def column_profile(spark, d):
    p = table(spark, d, "part")
    cols = ("p_name", "p_brand", "p_type", "p_size")
    rows = p.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in cols))).alias("x"))
    return rows.groupBy("x.name").agg(F.count_if(F.col("x.value").isNull()).alias("n_null"), F.count_distinct("x.value").alias("n_unique"), F.min("x.value").alias("least"), F.max("x.value").alias("most"))


@query("value_counts", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def value_counts(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select("event_type", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("share"))  # one row per type


@query("weighted_mean", f"WITH {PREPARED} SELECT market, round(CASE WHEN sum(greatest(sales_units, 0)) > 0 THEN sum(greatest(sales_units, 0) * source_rows) / sum(greatest(sales_units, 0)) ELSE avg(source_rows) END, 6) AS weighted, round(avg(source_rows), 6) AS plain FROM a GROUP BY market")
def weighted_mean(spark, d):
    rows = F.col("source_rows").cast("double")
    return prepared(spark, d).groupBy("market").agg(F.round(P.weighted_mean(rows, F.col("sales_units")), 6).alias("weighted"), F.round(F.avg(rows), 6).alias("plain"))


@query("filtered_brand_scan", "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS mean_price FROM part WHERE upper(p_brand) = upper('brand#12') OR upper(p_brand) = upper('BRAND#13') GROUP BY p_brand")
def filtered_brand_scan(spark, d):
    return table(spark, d, "part").where(F.upper("p_brand").isin("BRAND#12", "BRAND#13")).groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean_price"))


@query("set_operations", f"WITH {LONG}, x AS (SELECT DISTINCT product || '/' || brand AS item FROM f WHERE market = 'NATION_1'), y AS (SELECT DISTINCT product || '/' || brand AS item FROM f WHERE market = 'NATION_2') (SELECT 'both' AS kind, item FROM x INTERSECT SELECT 'both', item FROM y) UNION ALL (SELECT 'first', item FROM x EXCEPT SELECT 'first', item FROM y)")
def set_operations(spark, d):
    f = long_table(spark, d).select(F.concat_ws("/", "product", "brand").alias("item"), "market")
    x, y = (f.where(F.col("market") == m).select("item").distinct() for m in ("NATION_1", "NATION_2"))
    return x.join(y, "item", "left_semi").select(F.lit("both").alias("kind"), "item").unionByName(x.join(y, "item", "left_anti").select(F.lit("first").alias("kind"), "item"))


@query("clean_scalars", r"""WITH x AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN ' 1,234.56 ' WHEN 1 THEN '1.234,56' WHEN 2 THEN 'abc' WHEN 3 THEN '' WHEN 4 THEN '-12' WHEN 5 THEN '1.234' WHEN 6 THEN 'nan' ELSE '7.5' END AS s, CASE p_partkey % 5 WHEN 0 THEN 'Q2 2014' WHEN 1 THEN '2014-Q3' WHEN 2 THEN '2014_05' WHEN 3 THEN 'Q4 2014_Standard Units' ELSE 'none' END AS l FROM part)
SELECT p_partkey, CASE WHEN trim(s) NOT IN ('', 'nan', 'None') THEN trim(s) END AS text, CASE p_partkey % 8 WHEN 0 THEN 1234.56 WHEN 1 THEN 1234.56 WHEN 4 THEN -12 WHEN 5 THEN 1.234 WHEN 7 THEN 7.5 END::DOUBLE AS units, CASE p_partkey % 5 WHEN 0 THEN '2014Q2' WHEN 1 THEN '2014Q3' WHEN 2 THEN '2014Q2' WHEN 3 THEN '2014Q4' END AS quarter FROM x""")
def clean_scalars(spark, d):
    k = F.col("p_partkey")
    s, l = F.lit("7.5"), F.lit("none")
    for i, v in reversed(list(enumerate([" 1,234.56 ", "1.234,56", "abc", "", "-12", "1.234", "nan"]))):
        s = F.when(k % 8 == i, v).otherwise(s)
    for i, v in reversed(list(enumerate(["Q2 2014", "2014-Q3", "2014_05", "Q4 2014_Standard Units"]))):
        l = F.when(k % 5 == i, v).otherwise(l)
    return table(spark, d, "part").select("p_partkey", X.clean_text(s).alias("text"), X.clean_sales(s).alias("units"), X.quarter_label(l).alias("quarter"))


@query("signed_log", "SELECT c_custkey, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) AS y, round(c_acctbal, 4) AS back FROM customer")
def signed_log(spark, d):
    y = X.signed_log(F.col("c_acctbal"))
    return table(spark, d, "customer").select("c_custkey", F.round(y, 6).alias("y"), F.round(X.inverse_signed_log(y), 4).alias("back"))


@query("one_hot", "SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{v}')::INT::DOUBLE AS is_{v}" for v in "FOP") + " FROM orders")
def one_hot(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *(F.when(F.col("o_orderstatus") == v, 1.0).otherwise(0.0).alias(f"is_{v}") for v in "FOP"))


@query("crosstab", "SELECT p_brand, " + ", ".join(f"count(*) FILTER (WHERE p_size % 4 = {k}) AS s{k}" for k in range(4)) + " FROM part GROUP BY p_brand")
def crosstab(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(*(F.count_if(F.col("p_size") % 4 == k).alias(f"s{k}") for k in range(4)))


@query("quarter_columns", "SELECT 'Column' || (6 + i)::VARCHAR AS name, ((2001 * 4 + 2 - 47 + i) // 4)::VARCHAR || 'Q' || ((2001 * 4 + 2 - 47 + i) % 4 + 1)::VARCHAR AS label FROM range(48) AS t(i)")
def quarter_columns(spark, d):
    i = F.col("id")
    return spark.range(48).select(F.concat(F.lit("Column"), (i + 6).cast("string")).alias("name"), X.ordinal_label(i + (2001 * 4 + 2 - 47)).alias("label"))


@query("metadata_rows", "SELECT o_orderpriority, count(*) FILTER (WHERE lower(o_orderpriority) IN ('1-urgent', '2-high') OR o_orderstatus = 'P') AS removed, count(*) FILTER (WHERE NOT (lower(o_orderpriority) IN ('1-urgent', '2-high') OR o_orderstatus = 'P')) AS kept FROM orders GROUP BY o_orderpriority")
def metadata_rows(spark, d):
    meta = F.lower("o_orderpriority").isin("1-urgent", "2-high") | (F.col("o_orderstatus") == "P")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(meta).alias("removed"), F.count_if(~meta).alias("kept"))
