"""Mapping products to codes: tiers of substance maps, combination products, resolution to one code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hierarchy import collapse, common_level

TIERS = ("exact", "close", "related")


def substance_codes(rows: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """(key, tier, code) rows -> (key, tier, codes): sorted union of the codes, valid ones alone if a table of them is given."""
    if valid is not None:
        rows = rows.join(valid.select("code"), "code", "left_semi")
    return rows.groupBy("key", "tier").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def first_tier(substances: DataFrame) -> DataFrame:
    """(key, tier, codes) of each key's best tier."""
    return substances.groupBy("key").agg(F.min("tier").alias("tier"), F.min_by("codes", "tier").alias("codes"))


def map_products(products: DataFrame, components: Column, resolved: DataFrame) -> DataFrame:
    """product -> match_type, codes, n_components, n_mapped: tier name of a single component, else combination, combination_partial or none."""
    parts = products.select("product", F.explode(components).alias("key")).join(resolved, "key", "left")
    per = parts.groupBy("product").agg(F.count("*").alias("n_components"), F.count("tier").alias("n_mapped"), F.min("tier").alias("tier"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("codes", F.array().cast("array<string>")))))).alias("codes"))
    name = F.element_at(F.array(*map(F.lit, TIERS)), F.coalesce("tier", F.lit(1)))
    kind = F.when(F.col("n_mapped") == 0, "none").when(F.col("n_components") == 1, name).when(F.col("n_mapped") == F.col("n_components"), "combination").otherwise("combination_partial")
    return per.select("product", kind.alias("match_type"), "codes", "n_components", "n_mapped")


def resolve(products: DataFrame, codes: str, n_components: Column) -> DataFrame:
    """Adds resolved, representation, common_level and cohort: one code after collapsing ancestors, else the deepest common ancestor from level 2 on."""
    c = products.withColumn("_c", collapse(F.col(codes)))
    single = F.size("_c") == 1
    k = F.when(single, 5).otherwise(common_level(F.col("_c")))
    length = F.when(k == 2, 3).when(k == 3, 4).otherwise(5)
    first = F.get("_c", F.lit(0))
    none = F.size("_c") == 0
    one = single | (k >= 2)
    return c.select(
        *products.columns, F.when(~none & single, first).when(~none & (k >= 2), first.substr(F.lit(1), length)).alias("resolved"), F.when(none, "none").when(single, "single").when(k >= 2, "lca").otherwise("crossbranch").alias("representation"),
        k.alias("common_level"), F.when(none, "unmapped").when(n_components > 1, "B_combo").when(one, "A_single_vector").otherwise("A_crossbranch").alias("cohort"),
    )
