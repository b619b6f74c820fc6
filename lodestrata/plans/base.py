"""Proxy tables: the star schema as quarterly sales, part as a code tree, embeddings as vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series as S
from ..operators.tables import stored

KEYS = ["product", "market"]
DIMS = ["product", "dosage", "brand", "market"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def long_table(spark: SparkSession, d: str) -> DataFrame:
    """product, dosage, brand, market, q (year * 4 + quarter - 1), sales_units. Orders meet their market before the lines, so lines are shuffled with the orders once, at every size; dimensions are broadcast by Spark's statistics where they are small enough."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("sales_units"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).cast("long").alias("q"))
    cust = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("market")), F.col("c_nationkey") == F.col("n_nationkey"))
    part = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("product"), F.col("p_type").alias("dosage"), F.col("p_brand").alias("brand"))
    placed = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "q", "market")
    rows = line.join(placed.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(*DIMS, "q", "sales_units")


def prepared(spark: SparkSession, d: str) -> DataFrame:
    """One row per dimensions and quarter: sum (NULL if all are), rows, missing rows."""
    return long_table(spark, d).groupBy(*DIMS, "q").agg(F.sum("sales_units").alias("sales_units"), F.count("*").alias("source_rows"), F.count_if(F.col("sales_units").isNull()).alias("missing_sales_rows"))


def period_bounds(spark: SparkSession, d: str) -> tuple[int, int]:
    """First and last quarter of the orders: two numbers, read from the narrow column."""
    q = F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1
    r = table(spark, d, "orders").agg(F.min(q), F.max(q)).first()
    return int(r[0]), int(r[1])


def merged(spark: SparkSession, d: str, keys: list[str] = KEYS) -> DataFrame:
    """keys, q, sales_units of the periods with sales; a table, so the fact's joins run once, however often it is read."""
    return stored(S.merge_to_series(long_table(spark, d), keys), "merged")


def full_series(spark: SparkSession, d: str, keys: list[str] = KEYS) -> DataFrame:
    """keys, q, v on the full spine; v is NULL where nothing was sold. A table, as merged() is."""
    first, last = period_bounds(spark, d)
    return stored(S.with_spine(merged(spark, d, keys).withColumnRenamed("sales_units", "v"), keys, first, last, value="v"), "series")


def codes(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct code of the five-level tree from part, with all its ancestors."""
    p = table(spark, d, "part")
    two = F.split("p_name", " ")
    leaf = F.concat(F.upper(F.substring("p_type", 1, 1)), F.lpad(F.regexp_extract("p_brand", r"(\d+)", 1), 2, "0"), F.upper(F.substring(two[0], 1, 1)), F.upper(F.substring(two[1], 1, 1)), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"))
    return p.select(F.explode(F.array(*(F.substring(leaf, 1, n) for n in (1, 3, 4, 5, 7)))).alias("code")).distinct()


LONG = """f AS (SELECT p_name AS product, p_type AS dosage, p_brand AS brand, n_name AS market, (year(o_orderdate) * 4 + quarter(o_orderdate) - 1)::BIGINT AS q,
  CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS sales_units FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""
PREPARED = LONG + """, a AS (SELECT product, dosage, brand, market, q, sum(sales_units) AS sales_units, count(*) AS source_rows, count(*) FILTER (WHERE sales_units IS NULL) AS missing_sales_rows FROM f GROUP BY ALL)"""
FULL = LONG + """, m AS (SELECT product, market, q, sum(sales_units) AS v FROM f GROUP BY ALL), b AS (SELECT min(q) AS q0, max(q) AS q1 FROM (SELECT (year(o_orderdate) * 4 + quarter(o_orderdate) - 1)::BIGINT AS q FROM orders)),
s AS (SELECT product, market, q, v FROM (SELECT product, market, unnest(generate_series(q0, q1)) AS q FROM (SELECT DISTINCT product, market FROM m), b) LEFT JOIN m USING (product, market, q))"""
SPAN = FULL + """, p AS (SELECT *, min(CASE WHEN v IS NOT NULL THEN q END) OVER w AS f0, max(CASE WHEN v IS NOT NULL THEN q END) OVER w AS l0 FROM s WINDOW w AS (PARTITION BY product, market)),
g AS (SELECT product, market, q, v, v IS NULL AS blank, q - row_number() OVER (PARTITION BY product, market, v IS NULL ORDER BY q) AS isl FROM p WHERE q BETWEEN f0 AND l0),
r AS (SELECT product, market, q, v, blank, count(*) OVER (PARTITION BY product, market, blank, isl) AS run FROM g)"""
#: the same runs over the full spine, and per-series figures
STATS = FULL + """, g AS (SELECT *, v IS NULL AS blank, q - row_number() OVER (PARTITION BY product, market, v IS NULL ORDER BY q) AS isl FROM s), r AS (SELECT *, count(*) OVER (PARTITION BY product, market, blank, isl) AS run FROM g),
z AS (SELECT product, market, count(*) FILTER (WHERE NOT blank) AS n_observed, min(CASE WHEN NOT blank THEN q END) AS first_q, max(CASE WHEN NOT blank THEN q END) AS last_q, min(q) AS q0, max(q) AS q1, coalesce(max(CASE WHEN blank THEN run END), 0)::BIGINT AS longest_blank, coalesce(sum(v), 0) AS volume FROM r GROUP BY ALL),
st AS (SELECT product, market, n_observed, coalesce(last_q - first_q + 1, 0)::BIGINT AS span, coalesce(first_q - q0, q1 - q0 + 1)::BIGINT AS lead_blanks, CASE WHEN n_observed = 0 THEN 0 ELSE q1 - last_q END::BIGINT AS trail_blanks, (coalesce(last_q - first_q + 1, 0) - n_observed)::BIGINT AS internal, longest_blank, volume, first_q, last_q FROM z)"""
PATTERN = """CASE WHEN n_observed = 0 THEN 'all_blank' WHEN internal > 0 THEN 'internal_gaps' WHEN lead_blanks > 0 AND trail_blanks > 0 THEN 'leading_and_trailing' WHEN lead_blanks > 0 THEN 'leading_only' WHEN trail_blanks > 0 THEN 'trailing_only' ELSE 'complete' END"""
CODES = """leaf AS (SELECT upper(substr(p_type, 1, 1)) || lpad(regexp_extract(p_brand, '(\\d+)', 1), 2, '0') || upper(substr(split_part(p_name, ' ', 1), 1, 1)) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || lpad((p_partkey % 100)::VARCHAR, 2, '0') AS c FROM part),
codes AS (SELECT DISTINCT substr(c, 1, n::INT) AS code FROM leaf, (VALUES (1), (3), (4), (5), (7)) AS t(n)),
lv AS (SELECT code, CASE length(code) WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 ELSE 5 END AS level, CASE length(code) WHEN 3 THEN substr(code, 1, 1) WHEN 4 THEN substr(code, 1, 3) WHEN 5 THEN substr(code, 1, 4) WHEN 7 THEN substr(code, 1, 5) END AS parent FROM codes)"""
