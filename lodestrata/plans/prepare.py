"""Queries of the prepare step, over a wide export made from the fact table, and of text and key functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import prepare as P
from ..operators import profile as R
from ..operators.tables import stored
from ..sources.io import with_default_vector
from .base import CODES, LONG, codes, long_table, merged, table
from .registry import query
from .vectors import emb

#: The export's quarters: 48 back from 2001Q3.
FIRST, LAST = 7959, 8006


def export(spark, d):
    """Products and markets by quarter as the export has them: US numbers as text, blanks, and three rows of metadata (headings, labels, a country)."""
    wide = merged(spark, d).groupBy("product", "market").pivot("q", list(range(FIRST, LAST + 1))).agg(F.sum("sales_units"))
    cells = [F.format_number(F.col(str(q)), 2).alias(c) for q, c in zip(range(FIRST, LAST + 1), P.QUARTERS)]
    dims = [F.concat(F.lit(" "), "product", F.lit("\t")).alias("Column1"), F.lit("nan").alias("Column2"), F.lit("").alias("Column3"), F.lit("-").alias("Column4"), F.col("market").alias("Column5")]
    names = [*P.FIXED, *P.QUARTERS]
    labels = [f"Q{q % 4 + 1} {q // 4}_Standard Units" for q in range(FIRST, LAST + 1)]
    odd = [("Product List", *[""] * 52), ("", "", "", "", "", *labels), ("x", "", "", "", " Country ", *["1"] * 48)]
    return spark.createDataFrame(odd, ", ".join(f"{n} string" for n in names)).unionByName(wide.select(*dims, *cells))


_EXPORT = f"""WITH {LONG}, k AS (SELECT DISTINCT product, market FROM f), a AS (SELECT product, market, q, sum(sales_units) AS v FROM f GROUP BY ALL), s AS (SELECT product, market, q, v FROM (SELECT product, market, unnest(generate_series({FIRST}, {LAST})) AS q FROM k) LEFT JOIN a USING (product, market, q))"""


@query("prepare_export", _EXPORT + """ SELECT product, NULL::VARCHAR AS dosage, NULL::VARCHAR AS dosage2, '-' AS brand, market, (q // 4)::INT AS year, (q % 4 + 1)::INT AS quarter, (q // 4) || 'Q' || (q % 4 + 1) AS quarter_label, make_date(q // 4, (q % 4) * 3 + 1, 1) AS quarter_start, v AS sales_units, 1::BIGINT AS source_rows, (v IS NULL)::BIGINT AS missing_sales_rows FROM s""")
def prepare_export(spark, d):
    """Metadata rows out, quarters from the row that names them, unpivoted, cleaned, aggregated."""
    return P.prepare(export(spark, d))


@query("prepare_by_last_quarter", _EXPORT + """ SELECT (q // 4) || 'Q' || (q % 4 + 1) AS quarter_label, count(*) AS n, count(v) AS n_sold, sum(v) AS units FROM s GROUP BY q""")
def prepare_by_last_quarter(spark, d):
    last = spark.range(1).select(X.last_quarter(F.lit("09.2001"))).first()[0]
    return P.prepare(export(spark, d), last).groupBy("quarter_label").agg(F.count("*").alias("n"), F.count("sales_units").alias("n_sold"), F.sum("sales_units").alias("units"))


@query("metadata_removed", f"WITH {LONG} SELECT 3::BIGINT AS n_removed, (SELECT count(*) FROM (SELECT DISTINCT product, market FROM f)) AS n_left")
def metadata_removed(spark, d):
    data, removed = P.split_metadata(export(spark, d))
    return removed.crossJoin(data.agg(F.count("*").alias("n_left")))  # one row each


#: the export's cells, one a row, as its columns hold them
_CELLS = _EXPORT + f""", cl AS (SELECT 'Column' || (6 + q - {FIRST}) AS col, CASE WHEN v IS NOT NULL THEN format('{{:,.2f}}', v) END AS val, product || chr(31) || market AS o FROM s
UNION ALL SELECT unnest(['Column1', 'Column2', 'Column3', 'Column4', 'Column5']), unnest([' ' || product || chr(9), 'nan', NULL, '-', market]), product || chr(31) || market FROM k),
nm AS (SELECT 'Column' || i AS col, CASE WHEN i > 5 THEN 'quarterly_sales' ELSE ['product', 'dosage', 'dosage2', 'brand', 'market'][i::INT] END AS expected_content FROM range(1, 54) AS r(i)),
ct AS (SELECT col, count(val) AS non_null_rows, count(*) - count(val) AS missing_rows, count(DISTINCT val) AS unique_values FROM cl GROUP BY col)"""


def _raw(whole):
    """(rows of data, their values, one row with the number of metadata rows) of an export."""
    data, removed = P.split_metadata(whole)
    order = F.concat(X.strip(F.col("Column1")), F.lit("\x1f"), F.col("Column5"))
    return data, R.value_table(data, [*P.FIXED, *P.QUARTERS], order), removed


@query("export_profile", _CELLS + """, tx AS (SELECT col, trim(val, ' ' || chr(9)) AS t, min(o) AS f FROM cl WHERE trim(val, ' ' || chr(9)) <> '' GROUP BY ALL), ex AS (SELECT col, string_agg(t, ' | ' ORDER BY k) AS example_values FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY f, t) AS k FROM tx) WHERE k <= 5 GROUP BY col)
SELECT col AS "column", expected_content, 'string' AS dtype, non_null_rows, missing_rows, unique_values, coalesce(example_values, '') AS example_values, missing_rows / (missing_rows + non_null_rows) AS missing_pct FROM nm JOIN ct USING (col) LEFT JOIN ex USING (col)""")
def export_profile(spark, d):
    """What all 53 columns of the export hold, in one pass over it."""
    data, values, _ = _raw(export(spark, d))
    return R.raw_profile(values, {f.name: f.dataType.simpleString() for f in data.schema}, P.FIXED | dict.fromkeys(P.QUARTERS, "quarterly_sales"))


_RAW = ["raw_rows", "raw_columns", "raw_cells", "embedded_metadata_rows_removed", "raw_missing_cells", "raw_unique_products", "raw_unique_dosages", "raw_unique_dosage2_values", "raw_unique_brands", "raw_unique_markets", "raw_blank_quarterly_sales_cells"]
_PREPARED = ["prepared_rows", "long_rows_before_aggregation", "duplicate_key_rows_aggregated", "missing_sales_rows", "negative_sales_rows", "total_sales_units", "n_products", "n_dosages", "n_dosage2_values", "n_brands", "n_markets", "n_quarters"]


@query("sales_overview", _CELLS + f""", x AS (SELECT (SELECT count(*) FROM k) AS raw_rows, 53 AS raw_columns, 53 * (SELECT count(*) FROM k) AS raw_cells, 3 AS embedded_metadata_rows_removed, sum(missing_rows) AS raw_missing_cells,
{', '.join(f"max(CASE WHEN col = 'Column{i + 1}' THEN unique_values END) AS {m}" for i, m in enumerate(_RAW[5:10]))}, sum(CASE WHEN substr(col, 7)::INT > 5 THEN missing_rows END) AS raw_blank_quarterly_sales_cells FROM ct),
y AS (SELECT count(*) AS prepared_rows, count(*) AS long_rows_before_aggregation, 0 AS duplicate_key_rows_aggregated, count(*) FILTER (WHERE v IS NULL) AS missing_sales_rows, count(*) FILTER (WHERE v < 0) AS negative_sales_rows, sum(v) AS total_sales_units, count(DISTINCT product) AS n_products, 0 AS n_dosages, 0 AS n_dosage2_values, 1 AS n_brands, count(DISTINCT market) AS n_markets, count(DISTINCT q) AS n_quarters FROM s)
SELECT unnest([{', '.join(f"'{m}'" for m in _RAW + _PREPARED)}]) AS metric, unnest([{', '.join(_RAW + _PREPARED)}]::DOUBLE[]) AS value FROM x, y""")
def sales_overview(spark, d):
    """The 23 figures of the export and of the table prepared from it. Distinct values are counted from the tables of values, which were summed before they were shuffled."""
    whole = export(spark, d)
    data, values, removed = _raw(whole)
    n, there = F.col("n"), F.col("value").isNotNull()
    missing = F.when(~there, n)
    raw = values.agg(
        F.sum(F.when(F.col("column") == "Column1", n)).alias("raw_rows"), F.lit(len(data.columns)).alias("raw_columns"), F.sum(n).alias("raw_cells"), F.coalesce(F.sum(missing), F.lit(0)).alias("raw_missing_cells"),
        *(F.count_if((F.col("column") == f"Column{i + 1}") & there).alias(m) for i, m in enumerate(_RAW[5:10])),
        # a cell of white space alone is blank, but not missing
        F.coalesce(F.sum(F.when(~F.col("column").isin(*P.FIXED) & (~there | (X.strip(F.col("value")) == "")), n)), F.lit(0)).alias("raw_blank_quarterly_sales_cells"),
    )
    long = stored(P.prepare(whole), "prepared")
    u = F.col("sales_units")
    sums = long.agg(F.count("*").alias("prepared_rows"), F.sum("source_rows").alias("long_rows_before_aggregation"), F.count_if(F.col("source_rows") > 1).alias("duplicate_key_rows_aggregated"), F.sum("missing_sales_rows").alias("missing_sales_rows"), F.count_if(u < 0).alias("negative_sales_rows"), F.sum(u).alias("total_sales_units"))
    keys = R.value_table(long, ["product", "dosage", "dosage2", "brand", "market", "quarter_label"], F.lit(0))
    kinds = keys.agg(*(F.count_if((F.col("column") == c) & there).alias(m) for c, m in zip(("product", "dosage", "dosage2", "brand", "market", "quarter_label"), _PREPARED[6:])))
    row = raw.crossJoin(removed.select(F.col("n_removed").alias("embedded_metadata_rows_removed"))).crossJoin(sums).crossJoin(kinds)  # one row each
    return R.metric_table(row, _RAW + _PREPARED)


@query("export_rename", _EXPORT + " SELECT product, market, count(v) AS n_sold, min(CASE WHEN v IS NOT NULL THEN q END)::BIGINT AS first_q FROM s GROUP BY ALL")
def export_rename(spark, d):
    """Columns renamed by position, quarters by a map."""
    raw = P.split_metadata(export(spark, d))[0]
    named = raw.withColumnsRenamed({**P.FIXED, **P.quarter_map("2001Q3")})
    cells = F.array(*(F.struct(F.lit(q).alias("label"), F.col(q).alias("cell")) for q in P.quarter_map("2001Q3").values()))
    held = F.filter(cells, lambda x: X.sales_or_blank(x["cell"])[0].isNotNull())
    return named.select(X.clean_text(F.col("product")).alias("product"), "market", F.size(held).cast("long").alias("n_sold"), F.array_min(F.transform(held, lambda x: X.ordinal(x["label"]))).alias("first_q"))


@query("sales_keep_blank", r"""WITH x AS (SELECT p_partkey, p_size, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN '1,' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || ' units' WHEN 3 THEN '-' || p_size WHEN 4 THEN chr(9) || ' ' ELSE p_size || '.5' END AS s FROM part) SELECT p_partkey, CASE p_partkey % 6 WHEN 2 THEN 1000 + p_partkey % 1000 WHEN 3 THEN -p_size WHEN 5 THEN p_size + 0.5 END::DOUBLE AS value, p_partkey % 6 IN (0, 4) AS is_blank FROM x""")
def sales_keep_blank(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    s = F.when(k % 6 == 0, "").when(k % 6 == 1, "n/a").when(k % 6 == 2, F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" units"))).when(k % 6 == 3, F.concat(F.lit("-"), n)).when(k % 6 == 4, "\t ").otherwise(F.concat(n, F.lit(".5")))
    value, blank = X.sales_or_blank(s)
    return table(spark, d, "part").select("p_partkey", value.alias("value"), blank.alias("is_blank"))


_DAY = "year(o_orderdate)::VARCHAR AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, quarter(o_orderdate) AS qq"


@query("quarter_forms", f"SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 10 THEN y || 'Q' || qq END AS quarter, CASE WHEN o_orderkey % 11 IN (0, 1, 2, 8) THEN y || 'Q' || qq END AS found FROM (SELECT o_orderkey, {_DAY} FROM orders)")
def quarter_forms(spark, d):
    """Every form of a quarter that is read, from the orders' dates: quarters, year and month, whole dates, month and year, labels within a text."""
    t = F.col("o_orderdate")
    y, m, q = F.year(t).cast("string"), F.month(t).cast("string"), F.quarter(t).cast("string")
    forms = [F.concat(y, F.lit(" - q"), q), F.concat(F.lit("\tQ"), q, F.lit("_"), y), F.concat(F.lit("q"), q, y), F.concat(y, F.lit("-"), m), F.date_format(t, "yyyy-MM-dd"), F.concat(y, F.lit("/"), m, F.lit(" x")), F.date_format(t, "M/d/yyyy"), F.date_format(t, "yyyyMMdd"), F.concat(F.lit("to Q"), q, F.lit(" "), y, F.lit("_Standard Units")), F.concat(m, F.lit("."), y), F.lit("none")]
    k = F.col("o_orderkey") % len(forms)
    s = F.when(k == 0, forms[0])
    for i, f in enumerate(forms[1:], 1):
        s = s.when(k == i, f)
    # the label within a text isn't a quarter's value, the month before a year is only the last quarter's form
    read = F.when(k == 8, X.quarter_label(s)).when(k == 9, X.last_quarter(s)).otherwise(X.quarter_value(s))
    return table(spark, d, "orders").select("o_orderkey", read.alias("quarter"), X.quarter_search(s).alias("found"))


@query("code_texts", f"""WITH {CODES}, t AS (SELECT code, level, 'http://host/ontology/KIND/' || code AS id, CASE WHEN level = 1 THEN 'GROUP ' || code || ' in ATC' ELSE 'Label of ' || code END AS raw FROM lv WHERE code NOT LIKE 'T%'),
l AS (SELECT *, CASE WHEN level = 1 THEN 'Group ' || lower(code) ELSE raw END AS label FROM t),
p AS (SELECT l.code, string_agg(coalesce(a.label, substr(l.code, 1, n::INT)), ' > ' ORDER BY n) AS path FROM l, (VALUES (1), (3), (4), (5), (7)) AS s(n) LEFT JOIN l a ON a.code = substr(l.code, 1, n::INT) WHERE n <= length(l.code) GROUP BY l.code)
SELECT code, code AS short_id, 'KIND' AS namespace, label AS preferred_label, path AS atc_path, label || ': ' || path AS label_path, CASE substr(code, 1, 1) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in X.GROUPS.items())} ELSE substr(code, 1, 1) END AS group_name FROM l JOIN p USING (code)""")
def code_texts(spark, d):
    """Ids, labels, the four text formats and group names; ids of other namespaces go by a substring, codes in T by a prefix."""
    c = codes(spark, d)
    rows = c.select("code", F.explode(F.array(F.lit("KIND/"), F.lit("STY/"))).alias("kind"))
    rows = rows.select("code", F.concat(F.lit("http://host/ontology/"), "kind", "code").alias("id")).where(~F.col("id").contains("/STY/") & ~F.col("code").startswith("T"))
    label = X.sentence_case(F.when(F.length("code") == 1, F.concat(F.lit("GROUP "), "code", F.lit(" in ATC"))).otherwise(F.concat(F.lit("Label of "), "code")))
    rows = rows.select("code", "id", label.alias("label"))
    steps = F.filter(F.array(*(F.when(F.length("code") >= n, F.struct(F.lit(n).alias("n"), F.substring("code", 1, n).alias("up"))) for n in (1, 3, 4, 5, 7))), lambda x: x.isNotNull())
    up = rows.select("code", F.explode(steps).alias("s")).select("code", "s.n", "s.up").join(rows.select(F.col("code").alias("up"), F.col("label").alias("up_label")), "up", "left")
    path = up.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("up_label", "up").alias("t")))), lambda x: x["t"]), " > ").alias("atc_path"))
    return rows.join(path, "code").select("code", X.short_class_id(F.col("id")).alias("short_id"), X.namespace(F.col("id")).alias("namespace"), F.col("label").alias("preferred_label"), "atc_path", F.concat_ws(": ", "label", "atc_path").alias("label_path"), X.group_name(F.col("code")).alias("group_name"))


@query("series_ids", f"WITH {LONG} SELECT product || ' | ' || market AS series_id, product, market, round(sum(sales_units) / nullif(count(*) FILTER (WHERE sales_units > 0), 0), 6) AS ratio FROM f GROUP BY ALL")
def series_ids(spark, d):
    rows = long_table(spark, d).groupBy(X.series_id(F.col("product"), F.col("market")).alias("series_id")).agg(F.sum("sales_units").alias("units"), F.count_if(F.col("sales_units") > 0).alias("n"))
    product, market = X.split_series_id(F.col("series_id"))
    return rows.select("series_id", product.alias("product"), market.alias("market"), F.round(X.safe_ratio(F.col("units"), F.col("n")), 6).alias("ratio"))


@query("vector_or_zero", "SELECT k.id, round(coalesce(list_sum([x::DOUBLE * x::DOUBLE FOR x IN e.embedding]), 0), 4) AS square, coalesce(len(e.embedding), 64)::INT AS dims FROM (SELECT vec_id + 7 AS id FROM embeddings) k LEFT JOIN embeddings e ON e.vec_id = k.id")
def vector_or_zero(spark, d):
    """Vectors by key; a key without one has the zero vector."""
    keys = table(spark, d, "embeddings").select((F.col("vec_id") + 7).alias("id"))
    rows = with_default_vector(keys, emb(spark, d).select(F.col("vec_id").alias("id"), "embedding"), "id", 64)
    return rows.select("id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("square"), F.size("embedding").alias("dims"))
