"""Queries of the forecast pipeline: folds, floor, scores, tests, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import forecast as O
from ..operators import grid as G
from ..operators import series as S
from ..operators import vectors as V
from ..operators.tables import running, stored
from .base import FULL, KEYS, LONG, full_series
from .registry import query

#: The last quarter of each fold's training data (2000Q1 to 2000Q3 and the quarter before).
CUTOFFS = (7999, 8000, 8001, 8002)
_Y = "sign(v) * ln(1 + abs(v))"
_FEAT = "round(coalesce({a}, 0), 6) AS y_anchor, round(coalesce(ys, 0), 6) AS y_season, ({a} IS NULL) AS anchor_missing, (ys IS NULL) AS season_missing"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, "q", "horizon", F.round("y", 6).alias("y"), F.round("y_anchor", 6).alias("y_anchor"), F.round("y_season", 6).alias("y_season"), "anchor_missing", "season_missing")


@query("fold_train_rows", f"WITH {FULL}, y AS (SELECT product, market, q, {_Y} AS y FROM s), l AS (SELECT *, [lag(y, 1) OVER w, lag(y, 2) OVER w, lag(y, 3) OVER w, lag(y, 4) OVER w] AS ls, lag(y, 4) OVER w AS ys, row_number() OVER w AS i FROM y WINDOW w AS (PARTITION BY product, market ORDER BY q)), x AS (SELECT *, unnest([1, 2, 3, 4]) AS horizon FROM l WHERE q <= 8002 AND y IS NOT NULL) SELECT product, market, q, horizon, round(y, 6) AS y, {_FEAT.format(a='ls[horizon]')} FROM x WHERE i > horizon")
def fold_train_rows(spark, d):
    return _rounded(O.fold_rows(full_series(spark, d), KEYS, 8002))


@query("fold_test_rows", f"WITH {FULL}, y AS (SELECT product, market, q, {_Y} AS y FROM s), l AS (SELECT *, [lag(y, 1) OVER w, lag(y, 2) OVER w, lag(y, 3) OVER w, lag(y, 4) OVER w] AS ls, lag(y, 4) OVER w AS ys FROM y WINDOW w AS (PARTITION BY product, market ORDER BY q)) SELECT product, market, q, (q - 8002)::INT AS horizon, round(y, 6) AS y, {_FEAT.format(a='ls[q - 8002]')} FROM l WHERE q BETWEEN 8003 AND 8006")
def fold_test_rows(spark, d):
    return _rounded(O.fold_rows(full_series(spark, d), KEYS, 8002, test=True))


@query("mase_scale", f"WITH {FULL}, x AS (SELECT product, market, abs(v - lag(v, 4) OVER (PARTITION BY product, market ORDER BY q)) AS dd FROM s) SELECT product, market, round(nullif(avg(dd), 0), 6) AS scale FROM x GROUP BY ALL")
def mase_scale(spark, d):
    return S.seasonal_scale(full_series(spark, d), KEYS).withColumn("scale", F.round("scale", 6))


def floor_table(spark, d) -> DataFrame:
    """fold, series, mase, volume, history, n of the seasonal floor (value a season ago, 0 where missing) for every fold: the series are read once, folds are rows."""
    s = full_series(spark, d).withColumn("back", F.lag("v", 4).over(Window.partitionBy(*KEYS).orderBy("q")))
    rows = s.withColumn("fold", F.explode(F.array(*map(F.lit, CUTOFFS))))
    inside = F.col("q") <= F.col("fold")
    test = F.col("q").between(F.col("fold") + 1, F.col("fold") + 4) & F.col("v").isNotNull()
    per = rows.groupBy("fold", *KEYS).agg(
        F.avg(F.when(inside, F.abs(F.col("v") - F.col("back")))).alias("scale"), F.coalesce(F.sum(F.when(inside, F.col("v"))), F.lit(0.0)).alias("volume"), F.count(F.when(inside, F.col("v"))).alias("history"),
        F.avg(F.when(test, F.abs(F.col("v") - F.coalesce("back", F.lit(0.0))))).alias("err"), F.count_if(test).alias("n"),
    )
    return per.where("scale > 0 AND n > 0").select("fold", *KEYS, (F.col("err") / F.col("scale")).alias("mase"), "volume", "history", "n")


_FLOOR = FULL + f""", x AS (SELECT *, lag(v, 4) OVER (PARTITION BY product, market ORDER BY q) AS back FROM s), fo AS (SELECT unnest([{', '.join(map(str, CUTOFFS))}]) AS fold),
pe AS (SELECT fold, product, market, avg(CASE WHEN q <= fold THEN abs(v - back) END) AS scale, coalesce(sum(CASE WHEN q <= fold THEN v END), 0) AS volume, count(CASE WHEN q <= fold THEN v END) AS history, avg(CASE WHEN q BETWEEN fold + 1 AND fold + 4 AND v IS NOT NULL THEN abs(v - coalesce(back, 0)) END) AS err, count(*) FILTER (WHERE q BETWEEN fold + 1 AND fold + 4 AND v IS NOT NULL) AS n FROM x, fo GROUP BY ALL),
fl AS (SELECT fold, product, market, err / scale AS mase, volume, history, n FROM pe WHERE scale > 0 AND n > 0)"""


@query("floor_scores", f"WITH {_FLOOR} SELECT fold, product, market, round(mase, 6) AS mase, volume, history, n FROM fl")
def floor_scores(spark, d):
    return floor_table(spark, d).withColumn("mase", F.round("mase", 6))


_SUM = "count(*) AS n_series, round(avg(mase), 6) AS mean_mase, round(median(mase), 6) AS median_mase, round(CASE WHEN sum(greatest(volume, 0)) > 0 THEN sum(greatest(volume, 0) * mase) / sum(greatest(volume, 0)) ELSE avg(mase) END, 6) AS weighted_mase"


def _summed(df: DataFrame, by: list[str]) -> DataFrame:
    s = O.summary(df, by)
    return s.select(*by, "n_series", *(F.round(c, 6).alias(c) for c in ("mean_mase", "median_mase", "weighted_mase")))


@query("floor_summary", f"WITH {_FLOOR} SELECT fold, {_SUM} FROM fl GROUP BY fold")
def floor_summary(spark, d):
    return _summed(floor_table(spark, d), ["fold"])


@query("floor_strata", f"WITH {_FLOOR} SELECT CASE WHEN history <= 8 THEN 'cold' ELSE 'mature' END AS stratum, {_SUM} FROM fl GROUP BY 1")
def floor_strata(spark, d):
    return _summed(floor_table(spark, d).withColumn("stratum", F.when(F.col("history") <= 8, "cold").otherwise("mature")), ["stratum"])


@query("floor_unseen", f"WITH {_FLOOR}, pd AS (SELECT product FROM fl GROUP BY product ORDER BY md5('holdout' || product), product LIMIT (SELECT round_even(count(DISTINCT product) * 0.2, 0)::INT FROM fl)) SELECT product IN (SELECT product FROM pd) AS unseen, {_SUM} FROM fl GROUP BY 1")
def floor_unseen(spark, d):
    scores = stored(floor_table(spark, d), "floor")
    held = O.holdout(scores, "product", 0.2, "holdout").withColumn("unseen", F.lit(True))
    return _summed(scores.join(held, "product", "left").withColumn("unseen", F.coalesce("unseen", F.lit(False))), ["unseen"])


_PAIR = FULL + """, w AS (SELECT product, market, max(CASE WHEN q = 8002 THEN v END) AS last FROM s GROUP BY ALL), x AS (SELECT *, lag(v, 4) OVER (PARTITION BY product, market ORDER BY q) AS back FROM s),
pr AS (SELECT product, market, avg(abs(v - coalesce(last, 0))) - avg(abs(v - coalesce(back, 0))) AS delta, count(*) AS n FROM x JOIN w USING (product, market) WHERE q BETWEEN 8003 AND 8006 AND v IS NOT NULL GROUP BY ALL)"""


def paired(spark, d) -> DataFrame:
    """Error of the last value minus error of the seasonal floor, per series, over the last fold."""
    s = full_series(spark, d)
    w = Window.partitionBy(*KEYS)
    rows = s.withColumn("last", F.max(F.when(F.col("q") == 8002, F.col("v"))).over(w)).withColumn("back", F.lag("v", 4).over(w.orderBy("q"))).where(F.col("q").between(8003, 8006) & F.col("v").isNotNull())
    z = F.lit(0.0)
    return rows.groupBy(*KEYS).agg((F.avg(F.abs(F.col("v") - F.coalesce("last", z))) - F.avg(F.abs(F.col("v") - F.coalesce("back", z)))).alias("delta"), F.count("*").alias("n"))


@query("paired_delta", f"WITH {_PAIR} SELECT market, count(*) AS n_series, round(sum(delta * n) / sum(n), 6) + 0.0 AS delta, count(*) FILTER (WHERE delta > 0) AS n_better, count(*) FILTER (WHERE delta < 0) AS n_worse FROM pr GROUP BY market")
def paired_delta(spark, d):
    x = F.col("delta")
    return paired(spark, d).groupBy("market").agg(F.count("*").alias("n_series"), (F.round(F.sum(x * F.col("n")) / F.sum("n"), 6) + 0.0).alias("delta"), F.count_if(x > 0).alias("n_better"), F.count_if(x < 0).alias("n_worse"))


@query("holm", f"WITH {_PAIR}, p AS (SELECT market, round(count(*) FILTER (WHERE delta <= 0) / count(*) / 10, 9) AS p, round(sum(delta * n) / sum(n), 9) AS delta FROM pr GROUP BY market), r AS (SELECT *, row_number() OVER (ORDER BY p, market) AS k, count(*) OVER () AS n FROM p) SELECT market, p, round(least(1, max((n - k + 1) * p) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)), 9) AS p_holm, CASE WHEN least(1, max((n - k + 1) * p) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)) >= 0.05 THEN 'not significant' WHEN delta < 0 THEN 'better' ELSE 'worse' END AS verdict FROM r")
def holm(spark, d):
    p = paired(spark, d).groupBy("market").agg(F.round(F.count_if(F.col("delta") <= 0) / F.count("*") / 10, 9).alias("p"), F.round(F.sum(F.col("delta") * F.col("n")) / F.sum("n"), 9).alias("delta"))
    return O.holm(p, "p", "market").select("market", "p", F.round("p_holm", 9).alias("p_holm"), F.when(F.col("p_holm") >= 0.05, "not significant").when(F.col("delta") < 0, "better").otherwise("worse").alias("verdict"))


@query("config_pairs", "WITH c AS (SELECT DISTINCT label AS config FROM embeddings) SELECT a.config AS a, b.config AS b FROM c a JOIN c b ON a.config < b.config")
def config_pairs(spark, d):
    c = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("a")).distinct()
    return c.join(F.broadcast(c.withColumnRenamed("a", "b")), F.col("a") < F.col("b"))  # configurations are a handful


@query("bootstrap_ci")
def bootstrap_ci(spark, d):
    rows = paired(spark, d).withColumn("num", F.col("delta") * F.col("n"))
    return O.bootstrap_ratio(rows, KEYS, "num", "n", ["market"]).drop("n_rows")



def standardize(rows: DataFrame, names: list[str]) -> tuple[list[float], list[float]]:
    """Means and population deviations (1 for a constant column) of the training rows, in one aggregate."""
    r = rows.agg(*(F.avg(n) for n in names), *(F.stddev_pop(n) for n in names)).first()
    return [float(x or 0) for x in r[: len(names)]], [float(x) if x else 1.0 for x in r[len(names) :]]


#: Configurations of the run, by the width of the vector that a product's code adds: none, the whole vector, its principal axes, its first half, tangent vectors of the hyperboloid's points.
CONFIGS = {"none": 0, "full": 64, "pca16": 16, "head32": 32, "lorentz10": 10}


def product_vectors(spark, d, series: DataFrame) -> DataFrame:
    """(config, code, v): the vector of each product of the series in each configuration. Products take the vectors in the order of their names, and begin anew where there are more products than vectors."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    names = running(series.select("product").distinct().withColumn("one", F.lit(1)), ["product"], {"at": "one"}, "products").select(F.col("product").alias("code"), "at")
    places = running(e.select("vec_id").withColumn("one", F.lit(1)), ["vec_id"], {"at": "one"}, "vectors").select("vec_id", F.col("at").alias("place"))
    flat = V.pca(e, "e", CONFIGS["pca16"], "p").join(places, "vec_id")
    met = names.withColumn("place", (F.col("at") - 1) % places.count() + 1).join(flat, "place")
    lifted = V.log_map_origin(V.lift(F.slice("e", 1, CONFIGS["lorentz10"])))
    made = {"full": F.col("e"), "pca16": F.col("p"), "head32": F.slice("e", 1, CONFIGS["head32"]), "lorentz10": lifted}
    rows = met.select("code", F.explode(F.array(*(F.struct(F.lit(c).alias("config"), v.alias("v")) for c, v in made.items()))).alias("x"))
    return stored(rows.select("x.config", "code", "x.v"), "vectors")


def records(spark, d) -> DataFrame:
    """The run: a row per model, configuration, fold and series, with mase, volume, history, n and whether the product was held out of the fits (unseen); a table."""
    series = full_series(spark, d)
    unseen = O.holdout(series, "product", 0.2, "holdout").select("product", F.lit(True).alias("unseen"))
    out = G.records(series, KEYS, "product", product_vectors(spark, d, series), CONFIGS, list(CUTOFFS), unseen)
    return stored(out.join(unseen, "product", "left").withColumn("unseen", F.coalesce("unseen", F.lit(False))), "records")


@query("forecast_run")
def forecast_run(spark, d):
    """Models by configurations by folds, summed up for each."""
    return O.summary(records(spark, d), ["model", "config", "fold"])


def _against_none(summed: DataFrame, by: list[str]) -> DataFrame:
    """Adds delta_vs_none: the mean less that of the same model without vectors, among rows equal in by."""
    none = summed.where("config = 'none'").select("model", *by, F.col("mean_mase").alias("_none"))
    return summed.join(none, ["model", *by], "left").withColumn("delta_vs_none", F.col("mean_mase") - F.col("_none")).drop("_none")  # a row a configuration


@query("forecast_summaries")
def forecast_summaries(spark, d):
    """Over all folds: all series, cold and mature ones, products in and out of the fits, each with its difference to the model without vectors."""
    rows = records(spark, d).withColumn("cold", F.when(F.col("history") <= 8, "cold").otherwise("mature")).withColumn("held", F.when(F.col("unseen"), "unseen").otherwise("seen"))
    parts = rows.withColumn("part", F.explode(F.array(F.lit("all"), F.col("cold"), F.col("held"))))
    return _against_none(O.summary(parts, ["model", "config", "part"]), ["part"])


def _deltas(rows: DataFrame, first: tuple[str, str], second: tuple[str, str], weight: str | None) -> DataFrame:
    """Paired differences of mase (first less second) over the folds and series that both have."""
    keys = ["fold", *KEYS]
    of = lambda m: rows.where((F.col("model") == m[0]) & (F.col("config") == m[1]))
    w = F.lit(1.0) if weight is None else F.greatest(F.col(weight), F.lit(0.0))
    met = of(first).join(of(second).select(*keys, F.col("mase").alias("_other")), keys)
    return met.select(*KEYS, "unseen", F.lit("/".join(first)).alias("first"), F.lit("/".join(second)).alias("second"), (w * (F.col("mase") - F.col("_other"))).alias("num"), w.alias("den"))


@query("bootstrap_families")
def bootstrap_families(spark, d):
    """The families of comparisons, by series and weighted by volume: each configuration against none, the same for products in and out of the fits, every pair of configurations, each against the floor. Holm's correction runs within a family."""
    from itertools import combinations

    rows = records(spark, d)
    some = [c for c in CONFIGS if c != "none"]
    parts = [("vs_none", ("ridge", c), ("ridge", "none")) for c in some] + [("config_pair", ("ridge", a), ("ridge", b)) for a, b in combinations(some, 2)] + [("vs_floor", ("ridge", c), ("floor", "none")) for c in CONFIGS]
    met = None
    for weight in (None, "volume"):
        for family, a, b in parts:
            one = _deltas(rows, a, b, weight).withColumn("family", F.lit(family + ("" if weight is None else "_weighted")))
            more = [one] + ([one.withColumn("family", F.concat("family", F.when(F.col("unseen"), "_unseen").otherwise("_seen")))] if family == "vs_none" else [])
            for x in more:
                met = x if met is None else met.unionByName(x)
    ci = stored(O.bootstrap_ratio(met, KEYS, "num", "den", ["family", "first", "second"]), "families")
    adjusted = O.holm(ci.withColumn("key", F.concat("first", F.lit(" "), "second")), "p", "key", ["family"]).drop("key")
    clear = (F.col("low") > 0) | (F.col("high") < 0)
    firm = clear & (F.col("p_holm") < 0.05)
    return adjusted.withColumns({"significant": clear, "significant_holm": firm, "verdict": F.when(~firm, "not significant").when(F.col("estimate") < 0, "better").otherwise("worse")})


@query("ridge_forecast")
def ridge_forecast(spark, d):
    """Scores of every rolling origin in CUTOFFS (fold), each with a ridge model of its own, all fitted from one pass over the series."""
    none = spark.createDataFrame([], "config string, code string, v array<double>")
    out = G.records(full_series(spark, d), KEYS, "product", none, {"none": 0}, list(CUTOFFS)).where("model = 'ridge'")
    return out.select(*KEYS, "mase", "volume", "history", "n", "fold")


@query("gbt_forecast")
def gbt_forecast(spark, d):
    """Leaf-wise boosted trees on every origin: all rows are binned and summed up in one pass, the origins' models are grown side by side, and all test rows are told in one pass."""
    rows = G.lagged(full_series(spark, d), KEYS)
    folds = rows.withColumn("fold", F.explode(F.array(*map(F.lit, CUTOFFS))))
    train = folds.where((F.col("q") <= F.col("fold")) & F.col("y").isNotNull()).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(O.HORIZON)))).where(F.get("lags", F.col("h") - 1)["there"].isNotNull())
    test = folds.where(F.col("q").between(F.col("fold") + 1, F.col("fold") + O.HORIZON) & F.col("v").isNotNull()).withColumn("h", (F.col("q") - F.col("fold")).cast("int"))
    named = lambda x: x.withColumns({n: f for n, f in zip(G.FEATURES, G.features(F.col("h")))})
    smooth = G.FEATURES[:2]
    train, test = named(train), named(test)
    ends = B.edges(train, "fold", smooth)
    bins = lambda x: x.withColumns({n: B.binned(n, F.col("fold"), ends) if n in smooth else F.col(n).cast("int") for n in G.FEATURES})
    tag = F.pmod(F.xxhash64(*KEYS, "q", "h"), F.lit(B.BAGS))
    models = B.fit(B.cells(bins(train), "fold", G.FEATURES, "y", tag), "fold", G.FEATURES)
    told = B.predicted(bins(test), "fold", G.FEATURES, models, ["fold", *KEYS, "v"])
    err = told.groupBy("fold", *KEYS).agg(F.avg(F.abs(F.col("v") - F.signum("prediction") * F.expm1(F.abs("prediction")))).alias("e"), F.count("*").alias("n"))
    inside = F.col("q") <= F.col("fold")
    scale = folds.groupBy("fold", *KEYS).agg(F.avg(F.when(inside, F.abs(F.col("v") - F.col("back")))).alias("scale"), F.coalesce(F.sum(F.when(inside, F.col("v"))), F.lit(0.0)).alias("volume"), F.count(F.when(inside, F.col("v"))).alias("history"))
    return err.join(scale.where("scale > 0"), ["fold", *KEYS]).select(*KEYS, (F.col("e") / F.col("scale")).alias("mase"), "volume", "history", "n", "fold")
