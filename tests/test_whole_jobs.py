from pyspark.sql import functions as F

from lodestrata.operators import profile
from lodestrata.plans import catalog, forecast
from lodestrata.plans.base import codes

SF = "/root/testdata/sf0.001"


def test_forecast_over_all_origins(spark):
    assert {r.fold for r in catalog.QUERIES["ridge_forecast"](spark, SF).select("fold").distinct().collect()} == set(forecast.CUTOFFS)


def test_probe_tests_every_row(spark, monkeypatch):
    tested = []
    monkeypatch.setattr(profile, "macro_f1", lambda pred, f=profile.macro_f1: tested.append(pred.count()) or f(pred))
    got = catalog.QUERIES["probe_f1"](spark, SF).first()
    assert 0 <= got.shuffled_f1 <= 1 and 0 <= got.macro_f1 <= 1
    # five folds of the real rows and the same five with the vectors dealt anew
    assert len(tested) == 10 and sum(tested) == 2 * spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_all_codes_are_trained(spark):
    got = {r.code for r in catalog.QUERIES["hyperbolic_train"](spark, SF).select(F.col("code")).collect()}
    assert got == {r.code for r in codes(spark, SF).collect()}


def test_run_has_every_fold_configuration_and_model(spark):
    rows = forecast.records(spark, SF).groupBy("model", "config", "fold").agg(F.count("*").alias("n"), F.count_if("unseen").alias("u")).collect()
    assert {(r.model, r.config, r.fold) for r in rows} == {(m, c, f) for m, c in [("floor", "none"), *(("ridge", c) for c in forecast.CONFIGS)] for f in forecast.CUTOFFS}
    assert all(0 < r.u < r.n for r in rows) and len(forecast.CONFIGS) == 5
    families = {r.family for r in catalog.QUERIES["bootstrap_families"](spark, SF).select("family").distinct().collect()}
    assert families == {f + w + part for w in ("", "_weighted") for f, parts in (("vs_none", ("", "_seen", "_unseen")), ("config_pair", ("",)), ("vs_floor", ("",))) for part in parts}


def test_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert forecast.standardize(df, ["a", "b"]) == ([2.0, 5.0], [1.0, 1.0])


def test_strata(spark):
    from lodestrata.plans.vectors import tree_pairs

    rows = tree_pairs(spark, SF).groupBy("stratum").agg(F.count("*").alias("n"), F.min("tree").alias("a"), F.max("tree").alias("b")).collect()
    assert {r.stratum: (1 <= r.a, r.n <= 20_000) for r in rows} and all(int(r.stratum.split("-")[0]) <= r.a and r.b <= int(r.stratum.split("-")[1]) for r in rows)
