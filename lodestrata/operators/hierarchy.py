"""Operators over a tree whose codes hold their ancestors as prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import PREFIXES, level, parent
from .tables import stored


def edges(codes: DataFrame, code: str = "code") -> DataFrame:
    """(parent, child) where the parent is a code too."""
    c = codes.select(F.col(code).alias("child"), parent(F.col(code)).alias("parent"))
    return c.join(codes.select(F.col(code).alias("parent")), "parent", "left_semi").select("parent", "child")


def closure(codes: DataFrame, code: str = "code") -> DataFrame:
    """(ancestor, descendant): prefixes that are codes; equals the closure of edges() while every intermediate ancestor exists."""
    pre = codes.select(F.col(code).alias("descendant"), F.explode(F.array(*(F.when(F.length(code) > n, F.substring(code, 1, n)) for n in PREFIXES))).alias("ancestor")).where("ancestor IS NOT NULL")
    return pre.join(codes.select(F.col(code).alias("ancestor")), "ancestor", "left_semi").select("ancestor", "descendant")


def paths(edges: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """(ancestor, descendant, shortest, longest): every pair that a path of the edges links, with the lengths of its shortest and longest paths; a table.

    Paths of up to 2, 4, 8, ... edges are made by joining those found so far with those that the last step found or bettered, so a graph
    takes as many steps as its longest path has doublings. Edges need not be prefixes of each other, nor a tree: a descendant may have
    several parents. Repeated edges are one, those with a null end go; a cycle is an error, as it has no longest path.
    """
    known = edges.where(F.col(parent).isNotNull() & F.col(child).isNotNull()).select(F.col(parent).alias("ancestor"), F.col(child).alias("descendant")).distinct()
    known = stored(known.withColumns({"shortest": F.lit(1).cast("long"), "longest": F.lit(1).cast("long"), "new": F.lit(True)}), "paths")
    while True:
        state = known.agg(F.count_if("new"), F.count_if(F.col("ancestor") == F.col("descendant"))).first()
        if state[1]:
            raise ValueError("the edges have a cycle")
        if not state[0]:
            return known.drop("new")
        first = known.select("ancestor", F.col("descendant").alias("via"), F.col("shortest").alias("s1"), F.col("longest").alias("l1"), F.col("new").alias("n1"))
        second = known.select(F.col("ancestor").alias("via"), "descendant", F.col("shortest").alias("s2"), F.col("longest").alias("l2"), F.col("new").alias("n2"))
        longer = first.join(second, "via").where("n1 OR n2").select("ancestor", "descendant", (F.col("s1") + F.col("s2")).alias("shortest"), (F.col("l1") + F.col("l2")).alias("longest"))
        longer = longer.groupBy("ancestor", "descendant").agg(F.min("shortest").alias("s"), F.max("longest").alias("l"))
        met = known.drop("new").join(longer, ["ancestor", "descendant"], "full")
        shortest, longest = F.least("shortest", "s"), F.greatest("longest", "l")
        known = stored(met.select("ancestor", "descendant", shortest.alias("shortest"), longest.alias("longest"), (F.col("shortest").isNull() | (shortest < F.col("shortest")) | (longest > F.col("longest"))).alias("new")), "paths")


def ranks(codes: DataFrame, edges: DataFrame, code: str = "code") -> DataFrame:
    """(code, sp, lp, rank): the shortest path from a virtual root above all codes without a parent, the longest path down to a leaf, and sp / (sp + lp)."""
    found = paths(edges)
    tops = codes.select(code).join(edges.select(F.col("child").alias(code)), code, "left_anti").select(F.col(code).alias("ancestor"))
    down = found.groupBy(F.col("ancestor").alias(code)).agg(F.max("longest").alias("lp"))
    up = found.join(tops, "ancestor").groupBy(F.col("descendant").alias(code)).agg((F.min("shortest") + 1).alias("sp"))
    out = codes.select(code).join(up, code, "left").join(down, code, "left").select(code, F.coalesce("sp", F.lit(1)).alias("sp"), F.coalesce("lp", F.lit(0)).alias("lp"))
    return out.withColumn("rank", F.col("sp") / (F.col("sp") + F.col("lp")))


def tree_distance(a: Column, b: Column) -> Column:
    """level(a) + level(b) - 2 * deepest shared level; NULL for a code of no level."""
    la, lb = level(a), level(b)
    shared = F.when(a == b, la)
    for k, n in reversed(list(enumerate(PREFIXES, 1))):
        shared = shared.when((la >= k) & (lb >= k) & (F.substring(a, 1, n) == F.substring(b, 1, n)), k)
    return la + lb - 2 * F.coalesce(shared, F.lit(0))


def collapse(codes: Column) -> Column:
    """A sorted set of codes without those that are ancestors of others in it."""
    return F.filter(codes, lambda c: ~F.exists(codes, lambda x: (x != c) & F.startswith(x, c)))


def common_level(codes: Column) -> Column:
    """Deepest of levels 4 to 1 whose prefixes all agree, else 0."""
    def agree(n: int) -> Column:
        return F.size(F.array_distinct(F.transform(codes, lambda c: F.substring(c, 1, n)))) == 1

    out = None
    for k, n in ((4, 5), (3, 4), (2, 3), (1, 1)):
        same = agree(n)
        out = F.when(same, k) if out is None else out.when(same, k)
    return out.otherwise(0)
