"""Hand-made edge cases of the reference operators."""

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import scalars as X
from lodestrata.operators import forecast, hierarchy, profile, series, vectors
from lodestrata.operators.ranks import spearman
from lodestrata.sources import io
from lodestrata.streaming.quarters import windowed_counts


def test_gap_policies(spark):
    def rows(k, values):
        return [(k, q, v) for q, v in enumerate(values)]

    data = rows("none", [None] * 6) + rows("one", [None, None, 5.0, None, None, None]) + rows("two", [1.0, None, None, 4.0, None, 0.0]) + rows("long", [1.0, None, None, None, 5.0, None]) + rows(None, [2.0, None, 3.0, -1.0, None, None])
    df = spark.createDataFrame(data, "k string, q long, v double")
    got = lambda **how: {(r.k, r.q): (r.v, r.resolution) for r in series.resolve_gaps(df, ["k"], value="v", **how).collect()}
    locf = got(max_gap=2)
    assert ("none", 0) not in locf and [k for k in locf if k[0] == "one"] == [("one", 2)]
    assert locf["two", 2] == (1.0, "locf") and locf["two", 5] == (0.0, "observed")
    assert locf["long", 2] == (0.0, "long_gap_zero") and locf[None, 1] == (2.0, "locf") and (None, 4) not in locf
    assert got(method="linear")["two", 2] == (3.0, "linear")
    assert not [k for k in got(max_gap=2, policy="drop") if k[0] == "long"]


def test_scalars(spark):
    df = spark.createDataFrame([(x,) for x in ["1,234.56", "1.234,56", "1.234", "abc", "", " 7 ", None, "-5"]], "s string")
    assert [r[0] for r in df.select(X.clean_sales(F.col("s"))).collect()] == [1234.56, 1234.56, 1.234, None, None, 7.0, None, -5.0]
    q = spark.createDataFrame([(x,) for x in ["Q2 2014", "2014-Q2", "2014_05", "Q2 2014_Standard Units", "x", None]], "s string")
    assert [r[0] for r in q.select(X.quarter_label(F.col("s"))).collect()] == ["2014Q2"] * 4 + [None, None]
    c = spark.createDataFrame([("see http://x/y/c10aa05, A01 and A01b or XA01",), ("http://x/ATC/c10aa05 atc/A01AA9z A0112",), ("",), (None,)], "s string")
    assert [r[0] for r in c.select(X.extract_codes(F.col("s"))).collect()] == [["A01", "A01B"], ["A0112", "A01AA9", "C10AA05"], [], None]
    w = spark.createDataFrame([("5\t",), ("\tnan\n",), ("\u00a0x\u2003",), (" ",)], "s string")
    assert [tuple(r) for r in w.select(X.clean_sales(F.col("s")), X.clean_text(F.col("s"))).collect()] == [(5.0, "5"), (None, None), (None, "x"), (None, None)]
    v = spark.createDataFrame([(x,) for x in ["2014-05-31", "2014-5", "q3 - 2014", "2014 q4", "5/31/2014", "20140531", "2014-13", "Q2 2014_x", "31 May 2014", None]], "s string")
    assert [r[0] for r in v.select(X.quarter_value(F.col("s"))).collect()] == ["2014Q2", "2014Q2", "2014Q3", "2014Q4", "2014Q2", "2014Q2", None, None, "2014Q2", None]
    f = spark.createDataFrame([("to Q2 2014, 2015Q1",), ("2015Q1 Q2 2014",), ("none",), (None,)], "s string")
    assert [r[0] for r in f.select(X.quarter_search(F.col("s"))).collect()] == ["2014Q2", "2015Q1", None, None]
    m = spark.createDataFrame([("03.2026",), ("12/2025",), ("2026Q1",), ("13.2026",)], "s string")
    assert [r[0] for r in m.select(X.last_quarter(F.col("s"))).collect()] == ["2026Q1", "2025Q4", "2026Q1", None]
    t = spark.createDataFrame([("ALL CAPS in ATC",), ("Mixed Case",)], "s string")
    assert [r[0] for r in t.select(X.sentence_case(F.col("s"))).collect()] == ["All caps", "Mixed Case"]


def test_hierarchy(spark):
    df = spark.createDataFrame([(["A12A", "A12AA"],), (["C10AA", "C10AB"],), (["A01", "N02"],)], "c array<string>")
    got = df.select(hierarchy.collapse(F.col("c")), hierarchy.common_level(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(["A12AA"], 3), (["C10AA", "C10AB"], 3), (["A01", "N02"], 0)]
    d = spark.createDataFrame([("A", "A01"), ("A01", "B01"), ("C10AA05", "C10AA05"), ("XX", "A")], "a string, b string").select(hierarchy.tree_distance(F.col("a"), F.col("b")))
    assert [r[0] for r in d.collect()] == [1, 4, 0, None]


def test_holm_and_weighted_mean(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.04), ("d", 0.9)], "k string, p double")
    assert [round(r.p_holm, 6) for r in forecast.holm(df, "p", "k").orderBy("k").collect()] == [0.04, 0.12, 0.12, 0.9]
    w = spark.createDataFrame([(1.0, -5.0), (3.0, 0.0), (None, 7.0)], "x double, w double")
    assert w.agg(profile.weighted_mean(F.col("x"), F.col("w"))).first()[0] == 2.0


def test_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [6.0, 8.0]), (4, [-4.0, 3.0])], "id long, v array<double>")
    v = F.col("v")
    assert df.select(vectors.cosine_distance(v, F.array(F.lit(3.0), F.lit(4.0)))).collect()[0][0] == 1.0
    assert [round(x, 9) for x in df.select(vectors.log_map_origin(vectors.lift(v))).collect()[0][0]] == [0.0, 0.0]
    near = {(r.id, r.rank): r.other for r in vectors.nearest(df, "id", "v", 2).collect()}
    assert near[2, 1] == 3 and near[4, 1] == 1 and len(near) == 8
    assert 0 < vectors.isotropy(df, "v") <= 1


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0)], "a int, b double")
    assert spearman(df, "a", "b").first().rho is None
    s = spark.createDataFrame([("k", q, 1.0) for q in range(8)], "k string, q long, v double")
    assert series.seasonal_scale(s, ["k"]).first().scale is None
    assert series.autocorrelation(s, ["k"], 1, value="v").first().acf is None


def test_io(spark, tmp_path):
    df = spark.createDataFrame([("A", "x"), ("T1", "y")], "code string, text string")
    io.write_report(df, f"{tmp_path}/r.csv")
    assert io.read_table(spark, f"{tmp_path}/r.csv", "code string, text string").count() == 2
    assert io.read_optional(spark, f"{tmp_path}/nothing.csv", "a int").count() == 0
    assert io.resolve_column(df, "nope", "CODE") == "code"
    with pytest.raises(ValueError, match="missing"):
        io.require_columns(df, ["z"])
    assert [r.code for r in io.canonical_codes(df).collect()] == ["A"]
    assert io.quarter_columns(8006)["Column53"] == "2001Q3" and len(io.wide_schema()) == 53
    out = io.embed(df, "code", "text", lambda texts: [[float(len(t))] for t in texts]).collect()
    assert [r.embedding for r in out] == [[1.0], [1.0]]


def test_stream(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(src)
    batch = windowed_counts(spark.read.parquet(src))
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("counts").select("start", "event_type", "n").collect()) == sorted(batch.select("start", "event_type", "n").collect())


def test_prepare(spark):
    from lodestrata.operators import prepare as P

    names = ", ".join(f"{n} string" for n in [*P.FIXED, *P.QUARTERS])
    labels = [f"Q{q % 4 + 1} {q // 4}" for q in range(8000, 8048)]
    rows = [("A", "x", "", None, "M", *["1,000.5"] * 47, ""), ("A", "x", "", None, "M", *["2"] * 47, " "), ("h", "", "", "", "", *labels), ("A", "", "", "", "market", *["1"] * 48), (None, "", "", "", "M", *["Q1 2014"] * 2, *["7"] * 46)]
    raw = spark.createDataFrame(rows, names)
    got = P.prepare(raw.coalesce(1)).collect()
    a = {r.quarter_label: r for r in got if r["product"] == "A"}
    assert len(got) == 96 and len(a) == 48 and a["2000Q1"].sales_units == 1002.5 and a["2000Q1"].source_rows == 2 and a["2000Q1"].year == 2000
    assert a["2011Q4"].sales_units is None and a["2011Q4"].missing_sales_rows == 2
    assert sum(r.sales_units is None for r in got if r["product"] is None) == 2  # two labels are too few to make a row metadata
    assert P.split_metadata(raw)[1].first().n_removed == 2
    plain = raw.where("Column1 = 'A' AND Column5 = 'M'")
    with pytest.raises(ValueError, match="last"):
        P.prepare(plain)
    assert P.prepare(plain, "2011Q4").count() == 48
    with pytest.raises(ValueError, match="missing"):
        P.prepare(plain.drop("Column53"), "2011Q4")


def test_files(spark, tmp_path):
    edges = spark.createDataFrame([("A", "A01"), ("A01", "A01B")], "ancestor string, descendant string")
    io.write_edges(edges, f"{tmp_path}/e")
    assert sorted(map(tuple, io.read_edges(spark, f"{tmp_path}/e").collect())) == [("A", "A01"), ("A01", "A01B")]
    (tmp_path / "one.json").write_text('[["A", "A01"], ["B", "B01"]]')
    assert sorted(map(tuple, io.read_edges(spark, f"{tmp_path}/one.json").collect())) == [("A", "A01"), ("B", "B01")]
    io.append_report(edges, f"{tmp_path}/r.csv")
    io.append_report(edges, f"{tmp_path}/r.csv")
    assert io.read_table(spark, f"{tmp_path}/r.csv", "ancestor string, descendant string").count() == 4
    with pytest.raises(FileNotFoundError, match="nothing"):
        io.load_inputs(spark, f"{tmp_path}/one.json", f"{tmp_path}/nothing.csv")
    v = spark.createDataFrame([("A", [3.0, 4.0, 0.0]), ("B", [0.0, 2.0, 1.0]), ("C", [1.0, 0.0, 5.0])], "code string, embedding array<double>")
    v.write.parquet(f"{tmp_path}/v")
    codes = v.select("code").where("code < 'C'")
    assert {r.code: [round(x, 9) for x in r.embedding] for r in io.load_code_vectors(spark, f"{tmp_path}/v", codes, "euclidean").collect()}["A"] == [0.6, 0.8, 0.0]
    assert {len(r.embedding) for r in io.load_code_vectors(spark, f"{tmp_path}/v", None, "euclidean", 2).collect()} == {2}
    assert {len(r.embedding) for r in io.load_code_vectors(spark, f"{tmp_path}/v", codes, "hyperbolic").collect()} == {2}
    assert [tuple(r) for r in io.with_default_vector(spark.createDataFrame([("A",), ("Z",)], "code string"), v, "code", 3).orderBy("code").collect()] == [("A", [3.0, 4.0, 0.0]), ("Z", [0.0, 0.0, 0.0])]
