"""Pairs of tree nodes by their distance, drawn without making the pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import running, stored


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def draws(total: int, k: int, seed: str) -> list[int]:
    """min(k, total) different numbers below total, ascending: one from each of as many intervals, whose borders differ by one in length, all moved on by one number in a circle, so that each number is as likely as any other."""
    k = min(k, total)
    cuts = [j * total // k for j in range(k + 1)] if k else []
    return sorted((a + _number(f"{seed}:{j}") % (b - a) + _number(seed)) % total for j, (a, b) in enumerate(zip(cuts, cuts[1:])))


def stratified_pairs(items: DataFrame, strata: list[tuple[int, int]], per: int, seed: str | list[str] = "0") -> DataFrame:
    """(stratum, tree, a, b): of each stratum of tree distances (low, high) `per` different pairs of items, all if it has fewer; every pair of a stratum is as likely as any other.

    items: id, path (the prefixes of its code from level 1 to itself; different for different items). A pair whose lowest common ancestor
    is x has its first item under one child of x and its second under a later one, or, at another level, under any other one. How many
    pairs of two levels a child takes part in is a product of counts, so pairs are numbered without being made: cells (x, child, levels)
    are laid end to end, a stratum's numbers are drawn, and a number in a cell is the place of the one item in the child's list and of
    the other in what is left of x's list. Lists are ranges of one numbering of the items. The work grows with the number of nodes.
    Several seeds share the numbering; a column `seed` then tells their draws apart.
    """
    level = F.size("path")
    rows = items.select("id", "path", level.alias("level")).withColumn("_one", F.lit(1))
    rows = stored(running(rows, ["level", "path"], {"at": "_one"}, "items").drop("_one"), "items")
    none = F.lit("")
    # each item under each of its ancestors x, the root (depth 0, '') included, by the child it is under ('' if it is x itself)
    under = rows.select("level", "at", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("depth"), "path")
    under = under.select("level", "at", "depth", F.when(F.col("depth") > 0, F.element_at("path", F.greatest("depth", F.lit(1)))).otherwise(none).alias("x"), F.when(F.col("depth") < F.col("level"), F.element_at("path", F.least(F.col("depth") + 1, F.col("level")))).otherwise(none).alias("y"))
    child = stored(under.groupBy("depth", "x", "y", "level").agg(F.count("*").alias("n"), F.min("at").alias("first")), "children")
    whole = child.groupBy("depth", "x", "level").agg(F.sum("n").alias("all_n"), F.min("first").alias("all_first"))
    cell = child.withColumnRenamed("level", "la").join(whole.withColumnRenamed("level", "lb"), ["depth", "x"]).where("la <= lb")
    cell = cell.join(child.select("depth", "x", "y", F.col("level").alias("lb"), F.col("n").alias("own_n"), F.col("first").alias("own_first")), ["depth", "x", "y", "lb"], "left")
    later = F.col("all_first") + F.col("all_n") - F.col("first") - F.col("n")
    cell = cell.withColumn("m", F.when(F.col("la") == F.col("lb"), later).otherwise(F.col("all_n") - F.coalesce("own_n", F.lit(0)))).withColumn("tree", F.col("la") + F.col("lb") - 2 * F.col("depth"))
    k = F.lit(None).cast("int")
    for i, (low, high) in enumerate(strata):
        k = F.when(F.col("tree").between(low, high), i).otherwise(k)
    cell = cell.withColumn("k", k).where("k IS NOT NULL AND m > 0").withColumn("size", F.col("n") * F.col("m"))
    cell = stored(running(cell, ["k", "x", "y", "la", "lb"], {"stop": "size"}, "cells"), "cells")
    totals = {r[0]: r[1] for r in cell.groupBy("k").agg(F.sum("size")).collect()}  # a row a stratum
    seeds = [seed] if isinstance(seed, str) else list(seed)
    base, wanted = 0, []
    for i, (low, high) in enumerate(strata):
        wanted += sorted((base + t, k) for k, one in enumerate(seeds) for t in draws(totals.get(i, 0), per, f"{one}:{low}-{high}"))
        base += totals.get(i, 0)
    numbers, which = np.array(wanted, np.int64).reshape(-1, 2).T  # `per` a stratum and seed at most

    def hit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stop, size = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("stop", "size"))
            first, last = np.searchsorted(numbers, stop - size), np.searchsorted(numbers, stop)
            of = np.repeat(np.arange(b.num_rows), last - first)
            at = np.concatenate([np.arange(f, e) for f, e in zip(first, last) if e > f]) if len(of) else np.empty(0, np.int64)
            taken = b.take(pa.array(of))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(numbers[at] - (stop - size)[of]), pa.array(which[at])], names=[*taken.schema.names, "u", "s"])

    kept = ["k", "tree", "la", "lb", "n", "first", "m", "all_first", "own_n", "own_first", "stop", "size"]
    got = cell.select(*kept).mapInArrow(hit, "k int, tree int, la int, lb int, n long, first long, m long, all_first long, own_n long, own_first long, stop long, size long, u long, s long")
    j = F.col("u") % F.col("m")
    other = F.col("all_first") + j
    other = other + F.when(other >= F.col("own_first"), F.col("own_n")).otherwise(0)
    got = got.withColumn("j", F.when(F.col("la") == F.col("lb"), F.col("first") + F.col("n") + j).otherwise(other))
    got = got.withColumn("i", F.col("first") + F.expr("u div m"))
    named = F.element_at(F.array(*(F.lit(f"{a}-{b}") for a, b in strata)), F.col("k") + 1)
    ids = rows.select(F.col("at").alias("i"), F.col("id").alias("a")), rows.select(F.col("at").alias("j"), F.col("id").alias("b"))
    told = [] if isinstance(seed, str) else [F.element_at(F.array(*map(F.lit, seeds)), F.col("s").cast("int") + 1).alias("seed")]
    return got.join(ids[0], "i").join(ids[1], "j").select(*told, named.alias("stratum"), "tree", "a", "b")
