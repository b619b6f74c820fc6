"""Queries over the code tree and the product mapping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import hierarchy as H
from ..operators import mapping as M
from .base import CODES, LONG, codes, long_table, table
from .registry import query

_CLOSURE = CODES + ", cl AS (SELECT substr(code, 1, n::INT) AS ancestor, code AS descendant FROM codes, (VALUES (1), (3), (4), (5)) AS t(n) WHERE length(code) > n)"


@query("code_levels", f"WITH {CODES} SELECT level, count(*) AS n_codes FROM lv GROUP BY level")
def code_levels(spark, d):
    return codes(spark, d).groupBy(X.level(F.col("code")).alias("level")).agg(F.count("*").alias("n_codes"))


@query("tree_edges", f"WITH {CODES} SELECT parent, code AS child FROM lv WHERE parent IS NOT NULL")
def tree_edges(spark, d):
    return H.edges(codes(spark, d))


@query("root_edges", f"WITH {CODES} SELECT coalesce(parent, 'ROOT') AS parent, code AS child FROM lv")
def root_edges(spark, d):
    c = codes(spark, d)
    return H.edges(c).unionByName(c.where(F.length("code") == 1).select(F.lit("ROOT").alias("parent"), F.col("code").alias("child")))


@query("closure", f"WITH {_CLOSURE} SELECT * FROM cl")
def closure(spark, d):
    return H.paths(H.edges(codes(spark, d))).select("ancestor", "descendant")


@query("grafted_paths", f"WITH RECURSIVE {CODES}, ed AS (SELECT parent, code AS child FROM lv WHERE parent IS NOT NULL AND level <> 3 UNION SELECT substr(code, 1, 1), code FROM lv WHERE level = 3 UNION SELECT substr(code, 1, 1), code FROM lv WHERE level = 5 AND code LIKE '%7'), r AS (SELECT parent AS a, child AS d, 1 AS l FROM ed UNION ALL SELECT a, child, l + 1 FROM r JOIN ed ON parent = d) SELECT a AS ancestor, d AS descendant, min(l)::BIGINT AS shortest, max(l)::BIGINT AS longest FROM r GROUP BY ALL")
def grafted_paths(spark, d):
    """Paths over parent edges that are no prefixes' ones: the third level hangs from the first, and leaves ending in 7 have a second parent there."""
    c = codes(spark, d)
    k, top = X.level(F.col("code")), F.substring("code", 1, 1).alias("parent")
    e = H.edges(c).where(X.level(F.col("child")) != 3).unionByName(c.where(k == 3).select(top, F.col("code").alias("child"))).unionByName(c.where((k == 5) & F.col("code").endswith("7")).select(top, F.col("code").alias("child")))
    return H.paths(e)


@query("tree_distance", f"WITH {CODES}, a AS (SELECT * FROM lv WHERE level <= 2), b AS (SELECT * FROM lv WHERE level = 3) SELECT a.code AS a, b.code AS b, (a.level + b.level - 2 * CASE WHEN a.level >= 2 AND substr(a.code, 1, 3) = substr(b.code, 1, 3) THEN 2 WHEN substr(a.code, 1, 1) = substr(b.code, 1, 1) THEN 1 ELSE 0 END)::INT AS distance FROM a, b WHERE substr(a.code, 1, 1) <= substr(b.code, 1, 1)")
def tree_distance(spark, d):
    c = codes(spark, d)
    a, b = c.where(F.length("code") <= 3).select(F.col("code").alias("a")), c.where(F.length("code") == 4).select(F.col("code").alias("b"))
    met = a.join(F.broadcast(b), F.substring("a", 1, 1) <= F.substring("b", 1, 1))  # at most 26 * 100 * 26 codes of level 3
    return met.select("a", "b", H.tree_distance(F.col("a"), F.col("b")).alias("distance"))


@query("norm_rank", f"WITH {_CLOSURE}, h AS (SELECT ancestor, max(level) AS deep FROM cl JOIN lv ON descendant = code GROUP BY ancestor) SELECT code, level::INT AS sp, (coalesce(deep, level) - level)::INT AS lp, round(level / (level + coalesce(deep, level) - level), 6) AS rank FROM lv LEFT JOIN h ON ancestor = code")
def norm_rank(spark, d):
    c = codes(spark, d)
    return H.ranks(c, H.edges(c)).select("code", F.col("sp").cast("int").alias("sp"), F.col("lp").cast("int").alias("lp"), F.round("rank", 6).alias("rank"))


@query("subtree_size", f"WITH {_CLOSURE}, n AS (SELECT ancestor, count(*) AS n FROM cl GROUP BY 1) SELECT code, level::INT AS level, coalesce(n, 0) AS n_descendants FROM lv LEFT JOIN n ON ancestor = code")
def subtree_size(spark, d):
    c = codes(spark, d)
    n = H.closure(c).groupBy(F.col("ancestor").alias("code")).agg(F.count("*").alias("n"))
    return c.join(n, "code", "left").select("code", X.level(F.col("code")).alias("level"), F.coalesce("n", F.lit(0)).alias("n_descendants"))


@query("group_stats", f"WITH {_CLOSURE}, n AS (SELECT ancestor, count(*) AS n FROM cl GROUP BY 1) SELECT level::INT AS level, round(avg(coalesce(n, 0)), 6) AS mean, median(coalesce(n, 0)) AS median, min(coalesce(n, 0)) AS least, max(coalesce(n, 0)) AS most, count(*) AS n FROM lv LEFT JOIN n ON ancestor = code GROUP BY level")
def group_stats(spark, d):
    n = F.col("n_descendants")
    return subtree_size(spark, d).groupBy("level").agg(F.round(F.avg(n), 6).alias("mean"), F.median(n).alias("median"), F.min(n).alias("least"), F.max(n).alias("most"), F.count("*").alias("n"))


@query("generality", f"WITH {_CLOSURE}, n AS (SELECT ancestor, count(*) AS n FROM cl GROUP BY 1), x AS (SELECT level AS a, coalesce(n, 0) AS b FROM lv LEFT JOIN n ON ancestor = code), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM x) SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r")
def generality(spark, d):
    from ..operators.ranks import spearman

    return spearman(subtree_size(spark, d), "level", "n_descendants").withColumn("rho", F.round("rho", 6))


# sets of codes per product of a brand and type: codes of all parts that share them
_SETS = CODES.replace("leaf AS (SELECT ", "leaf AS (SELECT p_name || '/' || p_brand || '/' || p_type AS product, p_partkey, ") + ", cs AS (SELECT product, list_sort(list_distinct(list(CASE WHEN p_partkey % 7 = 0 THEN substr(c, 1, 4) ELSE c END))) AS codes FROM leaf GROUP BY product)"


def code_sets(spark, d):
    p = table(spark, d, "part")
    two = F.split("p_name", " ")
    leaf = F.concat(F.upper(F.substring("p_type", 1, 1)), F.lpad(F.regexp_extract("p_brand", r"(\d+)", 1), 2, "0"), F.upper(F.substring(two[0], 1, 1)), F.upper(F.substring(two[1], 1, 1)), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"))
    c = F.when(F.col("p_partkey") % 7 == 0, F.substring(leaf, 1, 4)).otherwise(leaf)
    return p.groupBy(F.concat_ws("/", "p_name", "p_brand", "p_type").alias("product")).agg(F.array_sort(F.collect_set(c)).alias("codes"))


_COLLAPSED = "list_filter(codes, lambda c: len(list_filter(codes, lambda x: x <> c AND starts_with(x, c))) = 0)"
_COMMON = "CASE WHEN len(list_distinct(list_transform(codes, lambda c: substr(c, 1, 5)))) = 1 THEN 4 WHEN len(list_distinct(list_transform(codes, lambda c: substr(c, 1, 4)))) = 1 THEN 3 WHEN len(list_distinct(list_transform(codes, lambda c: substr(c, 1, 3)))) = 1 THEN 2 WHEN len(list_distinct(list_transform(codes, lambda c: substr(c, 1, 1)))) = 1 THEN 1 ELSE 0 END"


@query("ancestor_collapse", f"WITH {_SETS} SELECT product, array_to_string({_COLLAPSED}, '|') AS codes, len(codes)::INT AS n_before FROM cs")
def ancestor_collapse(spark, d):
    return code_sets(spark, d).select("product", F.array_join(H.collapse(F.col("codes")), "|").alias("codes"), F.size("codes").alias("n_before"))


@query("common_level", f"WITH {_SETS} SELECT product, ({_COMMON})::INT AS common_level FROM cs")
def common_level(spark, d):
    return code_sets(spark, d).select("product", H.common_level(F.col("codes")).alias("common_level"))


@query("resolve_cohort", f"""WITH {_SETS}, y AS (SELECT product, {_COLLAPSED} AS codes FROM cs), z AS (SELECT product, codes, len(string_split(product, ' ')) AS parts, CASE WHEN len(codes) = 1 THEN 5 ELSE ({_COMMON}) END AS k FROM y)
SELECT product, CASE WHEN len(codes) = 1 THEN codes[1] WHEN k >= 2 THEN substr(codes[1], 1, CASE k WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 5 END) END AS resolved, CASE WHEN len(codes) = 1 THEN 'single' WHEN k >= 2 THEN 'lca' ELSE 'crossbranch' END AS representation, k::INT AS common_level, CASE WHEN product LIKE 'a%' THEN 'B_combo' WHEN len(codes) = 1 OR k >= 2 THEN 'A_single_vector' ELSE 'A_crossbranch' END AS cohort FROM z""")
def resolve_cohort(spark, d):
    n = F.when(F.col("product").startswith("a"), 2).otherwise(1)
    return M.resolve(code_sets(spark, d), "codes", n).select("product", "resolved", "representation", "common_level", "cohort")


@query("tc_eligible", f"WITH {_CLOSURE} SELECT ancestor, descendant FROM cl WHERE length(descendant) > 1 AND descendant IN (SELECT ancestor FROM cl)")
def tc_eligible(spark, d):
    c = H.closure(codes(spark, d))
    inner = c.select(F.col("ancestor").alias("descendant")).distinct()
    return c.where(F.length("descendant") > 1).join(inner, "descendant", "left_semi").select("ancestor", "descendant")


@query("dup_flag", "SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name, p_brand) > 1 AS is_duplicate FROM part")
def dup_flag(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", (F.count("*").over(Window.partitionBy("p_name", "p_brand")) > 1).alias("is_duplicate"))


@query("explode_links", "SELECT p_partkey, unnest(string_split(p_brand || '|' || p_type, '|')) AS kind FROM part")
def explode_links(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(F.split(F.concat_ws("|", "p_brand", "p_type"), "[|]")).alias("kind"))


@query("crosstab_level", f"WITH {_SETS}, x AS (SELECT ({_COMMON}) AS k, CASE WHEN len(codes) = 1 THEN 'single' ELSE 'multi' END AS kind FROM cs) SELECT k::INT AS common_level, count(*) FILTER (WHERE kind = 'single') AS single, count(*) FILTER (WHERE kind = 'multi') AS multi FROM x GROUP BY k")
def crosstab_level(spark, d):
    x = code_sets(spark, d).select(H.common_level(F.col("codes")).alias("common_level"), F.when(F.size("codes") == 1, "single").otherwise("multi").alias("kind"))
    return x.groupBy("common_level").pivot("kind", ["single", "multi"]).agg(F.count(F.lit(1))).na.fill(0)


@query("code_path", f"WITH {CODES} SELECT code, array_to_string([substr(code, 1, n) FOR n IN [1, 3, 4, 5, 7] IF n <= length(code)], ' > ') AS path FROM codes")
def code_path(spark, d):
    pre = F.filter(F.array(*(F.when(F.length("code") >= n, F.substring("code", 1, n)) for n in (1, 3, 4, 5, 7))), lambda x: x.isNotNull())
    return codes(spark, d).select("code", F.array_join(pre, " > ").alias("path"))


@query("text_scalars", "SELECT p_partkey, nullif(upper(trim(p_brand)), '') AS key, array_to_string(list_sort(list_distinct(list_transform(string_split(p_name, ' '), lambda x: upper(x)))), '|') AS parts, p_brand || ' ' || p_type AS label FROM part")
def text_scalars(spark, d):
    return table(spark, d, "part").select("p_partkey", X.normalize_key(F.col("p_brand")).alias("key"), F.array_join(F.array_sort(F.array_distinct(F.transform(F.split("p_name", " "), F.upper))), "|").alias("parts"), F.concat_ws(" ", "p_brand", "p_type").alias("label"))


@query("code_regex", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(['A' || lpad((p_partkey % 100)::VARCHAR, 2, '0') || CASE WHEN p_partkey % 2 = 0 THEN 'BC' ELSE 'B' END, 'C01AA05', 'N02'], CASE WHEN p_partkey % 3 = 0 THEN ['B' || lpad((p_size % 100)::VARCHAR, 2, '0') || '12'] ELSE [] END))), '|') AS codes FROM part")
def code_regex(spark, d):
    """Codes in addresses ending in atc/..., and bare ones; a bare code after another slash or within a word is none."""
    n = lambda c: F.lpad((F.col(c) % 100).cast("string"), 2, "0")
    text = F.concat(F.lit("http://example.org/ATC/a"), n("p_partkey"), F.when(F.col("p_partkey") % 2 == 0, "bc").otherwise("b"), F.lit(" or c01aa05, x/y/g04bd and XA01 but (N02)"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" B"), n("p_size"), F.lit("12"))).otherwise(""))
    return table(spark, d, "part").select("p_partkey", F.array_join(X.extract_codes(text), "|").alias("codes"))


# product mapping: the words of p_name are components; tier tables are rules over the words
_TIERS = "w AS (SELECT DISTINCT upper(unnest(string_split(p_name, ' '))) AS word FROM part), tm AS (SELECT word AS key, 1 AS tier, 'A' || lpad((length(word) * 7 % 100)::VARCHAR, 2, '0') AS code FROM w WHERE length(word) % 3 = 0 UNION ALL SELECT word, 2, 'B' || lpad((ascii(word) % 100)::VARCHAR, 2, '0') FROM w WHERE length(word) % 2 = 0 UNION ALL SELECT word, 3, 'C' || lpad((length(word) % 100)::VARCHAR, 2, '0') FROM w WHERE ascii(word) % 2 = 0), su AS (SELECT key, tier, list_sort(list_distinct(list(code))) AS codes FROM tm GROUP BY ALL), re AS (SELECT key, min(tier) AS tier, arg_min(codes, tier) AS codes FROM su GROUP BY key)"


def tier_rows(spark, d):
    w = table(spark, d, "part").select(F.explode(F.split(F.upper("p_name"), " ")).alias("key")).distinct()
    pad = lambda x: F.lpad((x % 100).cast("string"), 2, "0")
    n, a = F.length("key"), F.ascii("key")
    rules = F.filter(F.array(F.when(n % 3 == 0, F.struct(F.lit(1).alias("tier"), F.concat(F.lit("A"), pad(n * 7)).alias("code"))), F.when(n % 2 == 0, F.struct(F.lit(2).alias("tier"), F.concat(F.lit("B"), pad(a)).alias("code"))), F.when(a % 2 == 0, F.struct(F.lit(3).alias("tier"), F.concat(F.lit("C"), pad(n)).alias("code")))), lambda x: x.isNotNull())
    return w.select("key", F.explode(rules).alias("r")).select("key", "r.tier", "r.code")


@query("substance_map", f"WITH {_TIERS} SELECT key, tier, array_to_string(codes, '|') AS codes FROM su")
def substance_map(spark, d):
    return M.substance_codes(tier_rows(spark, d)).select("key", "tier", F.array_join("codes", "|").alias("codes"))


@query("tier_fallback", f"WITH {_TIERS} SELECT key, tier, array_to_string(codes, '|') AS codes FROM re")
def tier_fallback(spark, d):
    return M.first_tier(M.substance_codes(tier_rows(spark, d))).select("key", "tier", F.array_join("codes", "|").alias("codes"))


_COMBO = _TIERS + """, pc AS (SELECT DISTINCT p_name AS product, upper(unnest(string_split(p_name, ' '))) AS key FROM part), pr AS (SELECT product, count(*) AS n_components, count(tier) AS n_mapped, min(tier) AS tier, list_sort(list_distinct(flatten(list(coalesce(codes, []))))) AS codes FROM pc LEFT JOIN re USING (key) GROUP BY product),
mp AS (SELECT product, n_components, n_mapped, codes, CASE WHEN n_mapped = 0 THEN 'none' WHEN n_components = 1 THEN CASE tier WHEN 1 THEN 'exact' WHEN 2 THEN 'close' ELSE 'related' END WHEN n_mapped = n_components THEN 'combination' ELSE 'combination_partial' END AS match_type FROM pr)"""


def product_map(spark, d):
    products = table(spark, d, "part").select(F.col("p_name").alias("product")).distinct()
    return M.map_products(products, F.array_distinct(F.transform(F.split("product", " "), F.upper)), M.first_tier(M.substance_codes(tier_rows(spark, d))))


@query("combo_resolve", f"WITH {_COMBO} SELECT product, match_type, array_to_string(codes, '|') AS codes, len(codes)::INT AS n_codes, n_components, n_mapped FROM mp")
def combo_resolve(spark, d):
    return product_map(spark, d).select("product", "match_type", F.array_join("codes", "|").alias("codes"), F.size("codes").alias("n_codes"), "n_components", "n_mapped")


@query("coverage_summary", f"WITH {_COMBO}, {LONG}, v AS (SELECT product, sum(sales_units) AS volume FROM f GROUP BY product) SELECT match_type, count(*) AS n_products, round(count(*) / sum(count(*)) OVER (), 6) AS product_share, sum(coalesce(volume, 0)) AS volume, round(sum(coalesce(volume, 0)) / sum(sum(coalesce(volume, 0))) OVER (), 6) AS volume_share FROM mp LEFT JOIN v USING (product) GROUP BY match_type")
def coverage_summary(spark, d):
    v = long_table(spark, d).groupBy("product").agg(F.sum("sales_units").alias("volume"))
    per = product_map(spark, d).join(v, "product", "left").groupBy("match_type").agg(F.count("*").alias("n_products"), F.sum(F.coalesce("volume", F.lit(0.0))).alias("volume"))
    w = Window.partitionBy(F.lit(1))  # one row per match type
    return per.select("match_type", "n_products", F.round(F.col("n_products") / F.sum("n_products").over(w), 6).alias("product_share"), "volume", F.round(F.col("volume") / F.sum("volume").over(w), 6).alias("volume_share"))
