"""Queries over quarterly series: gaps, blanks, patterns, diagnostics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import profile as P
from ..operators import series as S
from ..operators.ranks import quantiles, top_shares
from .base import FULL, KEYS, LONG, PATTERN, SPAN, STATS, full_series, long_table, period_bounds, prepared
from .registry import query

_OUT = "product, market, (q // 4)::VARCHAR || 'Q' || (q % 4 + 1)::VARCHAR AS quarter_label, make_date(q // 4, (q % 4) * 3 + 1, 1) AS quarter_start"


def _resolved(spark, d, **how):
    rows = S.resolve_gaps(full_series(spark, d), KEYS, value="v", **how)
    return rows.select(*KEYS, X.ordinal_label(F.col("q")).alias("quarter_label"), X.quarter_start(F.col("q")).alias("quarter_start"), F.round("v", 6).alias("sales_units"), "is_imputed", "resolution")


_LOCF = "last_value(v IGNORE NULLS) OVER (PARTITION BY product, market ORDER BY q ROWS UNBOUNDED PRECEDING)"


@query("series_locf", f"WITH {SPAN} SELECT {_OUT}, {_LOCF} AS sales_units, blank AS is_imputed, CASE WHEN blank THEN 'locf' ELSE 'observed' END AS resolution FROM r")
def series_locf(spark, d):
    return _resolved(spark, d)


@query("series_linear", f"""WITH {SPAN}, i AS (SELECT *, {_LOCF} AS v0, last_value(CASE WHEN NOT blank THEN q END IGNORE NULLS) OVER (PARTITION BY product, market ORDER BY q ROWS UNBOUNDED PRECEDING) AS a0,
first_value(v IGNORE NULLS) OVER (PARTITION BY product, market ORDER BY q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1, first_value(CASE WHEN NOT blank THEN q END IGNORE NULLS) OVER (PARTITION BY product, market ORDER BY q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a1 FROM r)
SELECT {_OUT}, round(CASE WHEN blank THEN v0 + (v1 - v0) * (q - a0) / (a1 - a0) ELSE v END, 6) AS sales_units, blank AS is_imputed, CASE WHEN blank THEN 'linear' ELSE 'observed' END AS resolution FROM i""")
def series_linear(spark, d):
    return _resolved(spark, d, method="linear")


@query("series_maxgap_zero", f"WITH {SPAN} SELECT {_OUT}, CASE WHEN blank AND run > 2 THEN 0 ELSE {_LOCF} END AS sales_units, blank AS is_imputed, CASE WHEN NOT blank THEN 'observed' WHEN run > 2 THEN 'long_gap_zero' ELSE 'locf' END AS resolution FROM r")
def series_maxgap_zero(spark, d):
    return _resolved(spark, d, max_gap=2, policy="zero")


@query("series_maxgap_drop", f"WITH {SPAN}, x AS (SELECT *, max(CASE WHEN blank AND run > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY product, market) AS bad FROM r) SELECT {_OUT}, {_LOCF} AS sales_units, blank AS is_imputed, CASE WHEN blank THEN 'locf' ELSE 'observed' END AS resolution FROM x WHERE bad = 0")
def series_maxgap_drop(spark, d):
    return _resolved(spark, d, max_gap=2, policy="drop")


def _gaps(spark, d):
    """One row per internal gap: keys, gap_length."""
    rows = S.gap_runs(S.within_span(full_series(spark, d), KEYS, value="v"), KEYS, value="v").where("blank")
    first = F.row_number().over(Window.partitionBy(*KEYS).orderBy("q"))
    return rows.withColumn("_start", F.col("q") - first).groupBy(*KEYS, "_start").agg(F.count("*").alias("gap_length"))


_GAPS = SPAN + ", gp AS (SELECT product, market, isl, count(*) AS gap_length FROM (SELECT product, market, q - row_number() OVER (PARTITION BY product, market ORDER BY q) AS isl FROM r WHERE blank) GROUP BY ALL)"


@query("gap_stats", f"WITH {_GAPS} SELECT product, market, count(*) AS n_gaps, sum(gap_length)::BIGINT AS blank_cells, max(gap_length) AS longest, round(avg(gap_length), 6) AS mean_length FROM gp GROUP BY ALL")
def gap_stats(spark, d):
    return _gaps(spark, d).groupBy(*KEYS).agg(F.count("*").alias("n_gaps"), F.sum("gap_length").alias("blank_cells"), F.max("gap_length").alias("longest"), F.round(F.avg("gap_length"), 6).alias("mean_length"))


@query("gap_distribution", f"WITH {_GAPS} SELECT gap_length, count(*) AS n_gaps, (gap_length * count(*))::BIGINT AS cells FROM gp GROUP BY gap_length")
def gap_distribution(spark, d):
    return _gaps(spark, d).groupBy("gap_length").agg(F.count("*").alias("n_gaps"), F.sum("gap_length").alias("cells"))


@query("gap_guardrail", f"""WITH {_GAPS}, l AS (SELECT product, market, max(gap_length) AS longest FROM gp GROUP BY ALL), t AS (SELECT unnest([1, 2, 3, 4, 6, 8]) AS max_gap)
SELECT max_gap, (SELECT coalesce(sum(CASE WHEN gap_length <= max_gap THEN gap_length ELSE 0 END), 0)::BIGINT FROM gp) AS cells_filled, (SELECT coalesce(round(sum(CASE WHEN gap_length <= max_gap THEN gap_length ELSE 0 END) / sum(gap_length), 4), 0) FROM gp) AS pct_filled, (SELECT count(*) FROM l WHERE longest > max_gap) AS series_with_longer_gap FROM t""")
def gap_guardrail(spark, d):
    per = _gaps(spark, d).groupBy(*KEYS, "gap_length").agg(F.count("*").alias("n"))
    lengths = per.groupBy("gap_length").agg(F.sum(F.col("n") * F.col("gap_length")).alias("cells"), F.lit(0).cast("long").alias("series"))
    longest = per.groupBy(*KEYS).agg(F.max("gap_length").alias("gap_length")).groupBy("gap_length").agg(F.lit(0).cast("long").alias("cells"), F.count("*").alias("series"))
    steps = lengths.unionByName(longest).withColumn("max_gap", F.explode(F.array(*map(F.lit, (1, 2, 3, 4, 6, 8)))))  # one row per length
    steps = spark.createDataFrame([(g,) for g in (1, 2, 3, 4, 6, 8)], "max_gap int").join(steps, "max_gap", "left")  # without any gap a threshold still has its row
    within = F.when(F.col("gap_length") <= F.col("max_gap"), F.col("cells")).otherwise(0)
    return steps.groupBy("max_gap").agg(F.sum(within).alias("cells_filled"), F.coalesce(F.round(F.sum(within) / F.nullif(F.sum("cells"), F.lit(0)), 4), F.lit(0.0)).alias("pct_filled"), F.sum(F.when(F.col("gap_length") > F.col("max_gap"), F.col("series")).otherwise(0)).alias("series_with_longer_gap"))


@query("imputation_report", f"WITH {SPAN} SELECT product, market, count(*) AS n_quarters, sum(blank::INT)::BIGINT AS n_imputed, min(q)::BIGINT AS first_q, max(q)::BIGINT AS last_q, round(sum(blank::INT) / count(*), 6) AS imputed_share FROM r GROUP BY ALL")
def imputation_report(spark, d):
    rows = S.resolve_gaps(full_series(spark, d), KEYS, value="v")
    n = F.sum(F.col("is_imputed").cast("long"))
    return rows.groupBy(*KEYS).agg(F.count("*").alias("n_quarters"), n.alias("n_imputed"), F.min("q").alias("first_q"), F.max("q").alias("last_q"), F.round(n / F.count("*"), 6).alias("imputed_share"))


def _stats(spark, d):
    first, last = period_bounds(spark, d)
    return S.blank_stats(full_series(spark, d), KEYS, last - first + 1, value="v")


_STAT = "product, market, n_observed, span, lead_blanks, trail_blanks, internal, longest_blank, volume, first_q, last_q"


@query("series_blank_stats", f"WITH {STATS} SELECT {_STAT} FROM st")
def series_blank_stats(spark, d):
    return _stats(spark, d)


@query("blank_patterns", f"WITH {STATS} SELECT {PATTERN} AS pattern, count(*) AS n_series, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM st GROUP BY 1")
def blank_patterns(spark, d):
    kind = S.blank_pattern(*map(F.col, ("lead_blanks", "trail_blanks", "internal", "n_observed")))
    n = _stats(spark, d).groupBy(kind.alias("pattern")).agg(F.count("*").alias("n_series"))
    return n.select("pattern", "n_series", F.round(F.col("n_series") / F.sum("n_series").over(Window.partitionBy(F.lit(1))), 6).alias("share"))


@query("cell_overview", f"WITH {FULL}, x AS (SELECT count(*) AS cells, count(*) FILTER (WHERE v IS NULL) AS blank, count(*) FILTER (WHERE v = 0) AS zero, count(*) FILTER (WHERE v > 0) AS positive, count(*) FILTER (WHERE v < 0) AS negative FROM s) SELECT unnest(['cells', 'blank', 'zero', 'positive', 'negative']) AS metric, unnest([cells, blank, zero, positive, negative]::DOUBLE[]) AS value FROM x")
def cell_overview(spark, d):
    v = F.col("v")
    row = full_series(spark, d).agg(F.count("*").alias("cells"), F.count_if(v.isNull()).alias("blank"), F.count_if(v == 0).alias("zero"), F.count_if(v > 0).alias("positive"), F.count_if(v < 0).alias("negative"))
    return P.metric_table(row, ["cells", "blank", "zero", "positive", "negative"])


@query("first_active", f"WITH {STATS} SELECT first_q, count(*) AS n_series FROM st WHERE first_q IS NOT NULL GROUP BY first_q")
def first_active(spark, d):
    return _stats(spark, d).where("first_q IS NOT NULL").groupBy("first_q").agg(F.count("*").alias("n_series"))


_SB = "CASE WHEN n_demand = 0 THEN 'no_demand' WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth' WHEN adi < 1.32 THEN 'erratic' WHEN cv2 < 0.49 THEN 'intermittent' ELSE 'lumpy' END"
_INTER = FULL + f", y AS (SELECT product, market, count(*) FILTER (WHERE v > 0) AS n_demand, (max(CASE WHEN v > 0 THEN q END) - min(CASE WHEN v > 0 THEN q END) + 1) / nullif(count(*) FILTER (WHERE v > 0), 0) AS adi, power(stddev_pop(CASE WHEN v > 0 THEN v END) / avg(CASE WHEN v > 0 THEN v END), 2) AS cv2 FROM s GROUP BY ALL), yy AS (SELECT *, {_SB} AS kind FROM y)"


@query("intermittency", f"WITH {_INTER} SELECT product, market, n_demand, round(adi, 6) AS adi, round(cv2, 6) AS cv2, kind FROM yy")
def intermittency(spark, d):
    pos, v = F.col("v") > 0, F.when(F.col("v") > 0, F.col("v"))
    q = F.when(pos, F.col("q"))
    per = full_series(spark, d).groupBy(*KEYS).agg(F.count_if(pos).alias("n_demand"), (F.max(q) - F.min(q) + 1).alias("_span"), F.stddev_pop(v).alias("_sd"), F.avg(v).alias("_mean"))
    adi, cv2 = F.col("_span") / F.nullif("n_demand", F.lit(0)), F.pow(F.col("_sd") / F.col("_mean"), 2)
    kind = F.when(F.col("n_demand") == 0, "no_demand").when((adi < 1.32) & (cv2 < 0.49), "smooth").when(adi < 1.32, "erratic").when(cv2 < 0.49, "intermittent").otherwise("lumpy")
    return per.select(*KEYS, "n_demand", F.round(adi, 6).alias("adi"), F.round(cv2, 6).alias("cv2"), kind.alias("kind"))


@query("intermittency_classes", f"WITH {_INTER} SELECT kind, count(*) AS n_series, round(median(adi), 4) AS median_adi, round(median(cv2), 4) AS median_cv2 FROM yy GROUP BY kind")
def intermittency_classes(spark, d):
    return intermittency(spark, d).groupBy("kind").agg(F.count("*").alias("n_series"), F.round(F.median("adi"), 4).alias("median_adi"), F.round(F.median("cv2"), 4).alias("median_cv2"))


@query("gap_levels", f"""WITH {FULL}, o AS (SELECT product, market, q, v, lead(q) OVER w AS q1, lead(v) OVER w AS v1 FROM s WHERE v IS NOT NULL WINDOW w AS (PARTITION BY product, market ORDER BY q)), x AS (SELECT v1 / v AS ratio, v > 0 AND v1 > 0 AS ok FROM o WHERE q1 - q > 1)
SELECT count(*) AS n_gaps, count(*) FILTER (WHERE ok) AS n_positive, round(median(CASE WHEN ok THEN ratio END), 6) AS median_ratio, round(count(*) FILTER (WHERE ok AND ratio BETWEEN 0.5 AND 2) / nullif(count(*) FILTER (WHERE ok), 0), 6) AS similar_share FROM x""")
def gap_levels(spark, d):
    w = Window.partitionBy(*KEYS).orderBy("q")
    o = full_series(spark, d).where("v IS NOT NULL").withColumn("q1", F.lead("q").over(w)).withColumn("v1", F.lead("v").over(w)).where("q1 - q > 1")
    ok = (F.col("v") > 0) & (F.col("v1") > 0)
    x = o.select(F.when(ok, F.col("v1") / F.col("v")).alias("ratio"), ok.alias("ok"))
    n = F.count_if("ok")
    one = x.agg(F.count("*").alias("n_gaps"), n.alias("n_positive"), F.round(F.count_if(F.col("ratio").between(0.5, 2)) / F.nullif(n, F.lit(0)), 6).alias("similar_share"))
    return one.crossJoin(F.broadcast(quantiles(x, "ratio", [0.5]).select(F.round("q0", 6).alias("median_ratio"))))  # one row each


@query("longest_blank", f"WITH {STATS} SELECT round(avg(longest_blank), 6) AS mean, count(*) FILTER (WHERE longest_blank = 0) AS n_none, count(*) FILTER (WHERE longest_blank >= 4) AS n_year, round(quantile_cont(longest_blank, 0.5), 6) AS p50, round(quantile_cont(longest_blank, 0.9), 6) AS p90, max(longest_blank) AS most FROM st")
def longest_blank(spark, d):
    b = F.col("longest_blank")
    return _stats(spark, d).agg(F.round(F.avg(b), 6).alias("mean"), F.count_if(b == 0).alias("n_none"), F.count_if(b >= 4).alias("n_year"), F.round(F.percentile(b, 0.5), 6).alias("p50"), F.round(F.percentile(b, 0.9), 6).alias("p90"), F.max(b).alias("most"))


@query("history_hist", f"WITH {STATS}, h AS (SELECT n_observed, count(*) AS n FROM st GROUP BY 1) SELECT i::BIGINT AS n_observed, coalesce(n, 0) AS n_series FROM range(28) AS t(i) LEFT JOIN h ON n_observed = i")
def history_hist(spark, d):
    h = _stats(spark, d).groupBy("n_observed").agg(F.count("*").alias("n"))
    return spark.range(28).select(F.col("id").alias("n_observed")).join(h, "n_observed", "left").select("n_observed", F.coalesce("n", F.lit(0)).alias("n_series"))


@query("seasonality", f"WITH {FULL}, t AS (SELECT q, sum(coalesce(v, 0)) AS total FROM s GROUP BY q) SELECT (q % 4 + 1)::BIGINT AS quarter, round(avg(total) / (SELECT avg(total) FROM t), 6) AS season_index FROM t GROUP BY 1")
def seasonality(spark, d):
    t = full_series(spark, d).groupBy("q").agg(F.sum(F.coalesce("v", F.lit(0.0))).alias("total"))
    s = t.groupBy((F.col("q") % 4 + 1).alias("quarter")).agg(F.sum("total").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))  # four rows
    return s.select("quarter", F.round(F.col("s") / F.col("n") / (F.sum("s").over(w) / F.sum("n").over(w)), 6).alias("season_index"))


def _acf(lag: int):
    sql = f"""WITH {FULL}, x AS (SELECT product, market, coalesce(v, 0) AS x, lag(coalesce(v, 0), {lag}) OVER (PARTITION BY product, market ORDER BY q) AS y FROM s), mm AS (SELECT product, market, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx, sum(y * y) AS syy FROM x WHERE y IS NOT NULL GROUP BY ALL)
SELECT product, market, round(CASE WHEN sxx - sx * sx / n > 1e-9 AND syy - sy * sy / n > 1e-9 THEN (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) END, 6) AS acf FROM mm"""

    @query(f"acf_lag{lag}", sql)
    def run(spark, d):
        return S.autocorrelation(full_series(spark, d), KEYS, lag, value="v").withColumn("acf", F.round("acf", 6))


_acf(1)
_acf(4)


@query("concentration", f"WITH {LONG}, t AS (SELECT product, greatest(sum(sales_units), 0) AS v FROM f GROUP BY product), o AS (SELECT v, row_number() OVER (ORDER BY v DESC, product) AS i, count(*) OVER () AS n, sum(v) OVER () AS total FROM t) SELECT pct, round(sum(CASE WHEN i <= greatest(1, round_even(pct / 100.0 * n, 0)) THEN v END) / max(total), 6) AS share FROM o, (SELECT unnest([1, 5, 10, 20, 50]) AS pct) GROUP BY pct")
def concentration(spark, d):
    t = long_table(spark, d).groupBy("product").agg(F.greatest(F.sum("sales_units"), F.lit(0.0)).alias("v"))
    return top_shares(t, "v", [1, 5, 10, 20, 50]).select("pct", F.round("share", 6).alias("share"))


@query("gini_by_market", f"WITH {STATS}, x AS (SELECT market, greatest(volume, 0) AS x, row_number() OVER (PARTITION BY market ORDER BY greatest(volume, 0)) AS i FROM st) SELECT market, round(CASE WHEN sum(x) > 0 THEN 2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*) ELSE 0 END, 6) AS gini FROM x GROUP BY market")
def gini_by_market(spark, d):
    return P.gini(_stats(spark, d), "volume", ["market"]).withColumn("gini", F.round("gini", 6))


_NEG = FULL + ", x AS (SELECT market, product, v, lag(v) OVER (PARTITION BY product, market ORDER BY q) AS back FROM s)"


def _negatives(spark, d):
    return full_series(spark, d).withColumn("back", F.lag("v").over(Window.partitionBy(*KEYS).orderBy("q")))


_NEG_OUT = "count(*) FILTER (WHERE v < 0) AS n_negative, count(*) FILTER (WHERE v < 0 AND back > 0) AS n_after_positive, round(count(*) FILTER (WHERE v < 0) / count(*), 6) AS cell_share, round(count(*) FILTER (WHERE v < 0 AND back > 0) / nullif(count(*) FILTER (WHERE v < 0), 0), 6) AS after_positive_share"


def _negative_figures():
    n, a = F.count_if(F.col("v") < 0), F.count_if((F.col("v") < 0) & (F.col("back") > 0))
    return n.alias("n_negative"), a.alias("n_after_positive"), F.round(n / F.count("*"), 6).alias("cell_share"), F.round(a / F.nullif(n, F.lit(0)), 6).alias("after_positive_share")


@query("negatives", f"WITH {_NEG} SELECT {_NEG_OUT} FROM x")
def negatives(spark, d):
    return _negatives(spark, d).agg(*_negative_figures())


@query("negatives_by_market", f"WITH {_NEG} SELECT market, {_NEG_OUT} FROM x GROUP BY market")
def negatives_by_market(spark, d):
    return _negatives(spark, d).groupBy("market").agg(*_negative_figures())


@query("blank_alignment", f"""WITH {LONG}, c AS (SELECT product, market, dosage, q, sum(sales_units) AS v FROM f GROUP BY ALL), b AS (SELECT product, market, min(q) AS q0, max(q) AS q1 FROM c GROUP BY ALL), k AS (SELECT DISTINCT product, market, dosage FROM c),
s AS (SELECT k.product, k.market, k.dosage, unnest(generate_series(q0, q1)) AS q FROM k JOIN b USING (product, market)), g AS (SELECT s.product, s.market, s.q, count(*) AS parts, count(*) FILTER (WHERE v IS NULL) AS blank FROM s LEFT JOIN c USING (product, market, dosage, q) GROUP BY ALL)
SELECT product, market, max(parts) AS n_components, count(*) AS span, count(*) FILTER (WHERE blank = parts) AS merged_blank, count(*) FILTER (WHERE blank > 0 AND blank < parts) AS partial_blank FROM g GROUP BY ALL""")
def blank_alignment(spark, d):
    parts = ["product", "market", "dosage"]
    c = S.merge_to_series(long_table(spark, d), parts)
    dosages = c.groupBy(*KEYS).agg(F.min("q").alias("q0"), F.max("q").alias("q1"), F.collect_set("dosage").alias("ds"))
    s = dosages.select(*KEYS, F.explode("ds").alias("dosage"), "q0", "q1").select(*parts, F.explode(F.sequence("q0", "q1")).alias("q"))
    g = s.join(c, [*parts, "q"], "left").groupBy(*KEYS, "q").agg(F.count("*").alias("parts"), F.count_if(F.col("sales_units").isNull()).alias("blank"))
    return g.groupBy(*KEYS).agg(F.max("parts").alias("n_components"), F.count("*").alias("span"), F.count_if(F.col("blank") == F.col("parts")).alias("merged_blank"), F.count_if((F.col("blank") > 0) & (F.col("blank") < F.col("parts"))).alias("partial_blank"))


@query("pattern_strings", f"WITH {FULL} SELECT product, market, string_agg(CASE WHEN v IS NULL THEN '.' ELSE '#' END, '' ORDER BY q) AS pattern FROM s GROUP BY ALL")
def pattern_strings(spark, d):
    cells = F.array_sort(F.collect_list(F.struct("q", F.when(F.col("v").isNull(), ".").otherwise("#").alias("c"))))
    return full_series(spark, d).groupBy(*KEYS).agg(F.array_join(F.transform(cells, lambda x: x["c"]), "").alias("pattern"))


def _subset(dim: str, keys: list[str]):
    ks = ", ".join(keys)
    sql = f"""WITH {LONG}, m AS (SELECT {ks}, q, sum(sales_units) AS v FROM f GROUP BY ALL), b AS (SELECT min(q) AS q0, max(q) AS q1 FROM (SELECT (year(o_orderdate) * 4 + quarter(o_orderdate) - 1)::BIGINT AS q FROM orders)),
z AS (SELECT {ks}, count(v) AS n_observed, max(q) - min(q) + 1 AS span, sum(v) AS volume FROM m GROUP BY ALL), g AS (SELECT *, greatest(volume, 0) AS x, row_number() OVER (PARTITION BY {dim} ORDER BY greatest(volume, 0)) AS i, sum(volume) OVER () AS total FROM z)
SELECT {dim}, count(*) AS n_series, median(n_observed) AS median_history, round(avg((n_observed >= 12)::INT), 6) AS pct_history_ge12, round(avg((span - n_observed = 0 AND span = q1 - q0 + 1)::INT), 6) AS pct_complete, round(quantile_cont(span - n_observed, 0.9), 6) AS p90_internal, round(CASE WHEN sum(x) > 0 THEN 2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*) ELSE 0 END, 6) AS gini, round(sum(volume) / max(total), 6) AS volume_share FROM g, b GROUP BY {dim}"""

    @query(f"subset_summary_{dim}", sql)
    def run(spark, d):
        first, last = period_bounds(spark, d)
        z = S.merge_to_series(long_table(spark, d), keys).groupBy(*keys).agg(F.count("sales_units").alias("n_observed"), (F.max("q") - F.min("q") + 1).alias("span"), F.sum("sales_units").alias("volume"))
        internal = F.col("span") - F.col("n_observed")
        per = z.groupBy(dim).agg(
            F.count("*").alias("n_series"), F.median("n_observed").alias("median_history"), F.round(F.avg((F.col("n_observed") >= 12).cast("int")), 6).alias("pct_history_ge12"),
            F.round(F.avg(((internal == 0) & (F.col("span") == last - first + 1)).cast("int")), 6).alias("pct_complete"), F.round(F.percentile(internal, 0.9), 6).alias("p90_internal"), F.sum("volume").alias("_v"),
        )
        both = per.join(P.gini(z, "volume", [dim]), dim)
        return both.select(*[c for c in per.columns if c != "_v"], F.round("gini", 6).alias("gini"), F.round(F.col("_v") / F.sum("_v").over(Window.partitionBy(F.lit(1))), 6).alias("volume_share"))


_subset("market", ["product", "market"])
_subset("brand", ["brand", "product", "market"])
