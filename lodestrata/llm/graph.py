"""Connected components over a table of links, by large-star and small-star steps; every step is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(links: DataFrame, most_steps: int = 60) -> DataFrame:
    """(node, root) for every node of links (a long, b long): root is the smallest node reachable; a table that drop_stored() deletes. Nothing of the graph reaches the driver but a count and a checksum per step."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    seal = _seal(edges)
    for _ in range(most_steps if seal[0] else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "components")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = stored(small, "components")
        drop_stored(edges, large)
        edges, last, seal = new, seal, _seal(new)
        if seal == last:
            break
    else:
        if seal[0]:
            raise RuntimeError("the components haven't settled")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = stored(roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")
    drop_stored(edges)
    return out


def _seal(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
