"""Mixing sources to target weights as a min-cost flow over membership patterns."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import drop_stored, others, stored, table, word_count

BUCKETS = 4096


def fill_targets(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Share `total` by weight; a source stops at most * its size, and what it can't take is shared again by weight until none is above."""
    target, open_, left = {}, sorted(sizes, key=lambda s: (s is None, s or "")), float(total)
    while open_:
        whole = float(sum(weights[s] for s in open_))
        over = [s for s in open_ if left * weights[s] / whole > most * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / whole for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in target]
    return target


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each (from, to, capacity, cost) of a maximal flow of least cost: shortest augmenting paths with potentials."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, left, cost = [], [], []
    for u, v, c, w in arcs:
        for a, b, x, y in ((u, v, c, w), (v, u, 0, -w)):
            graph[a].append(len(to))
            to.append(b), left.append(x), cost.append(y)
    high = [0] * n
    while True:
        dist, by = [float("inf")] * n, [-1] * n
        dist[source], heap = 0, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in graph[u]:
                if left[e] and (x := d + cost[e] + high[u] - high[to[e]]) < dist[to[e]]:
                    dist[to[e]], by[to[e]] = x, e
                    heapq.heappush(heap, (x, to[e]))
        if by[sink] < 0:
            return [left[2 * k + 1] for k in range(len(arcs))]
        for v in range(n):
            high[v] += dist[v] if dist[v] < float("inf") else dist[sink]
        push, v = None, sink
        while v != source:
            push = left[by[v]] if push is None else min(push, left[by[v]])
            v = to[by[v] ^ 1]
        v = sink
        while v != source:
            left[by[v]] -= push
            left[by[v] ^ 1] += push
            v = to[by[v] ^ 1]


def route(patterns: dict[tuple, int], quotas: dict, epochs: int) -> dict[tuple, int]:
    """Words that each membership pattern gives. Arcs from the start carry a pattern's words once for each epoch, each epoch dearer than the one before, so words are repeated only where nothing fresh is left."""
    keys, names = list(patterns), list(quotas)
    at = {s: 1 + len(keys) + i for i, s in enumerate(names)}
    sink, arcs = 1 + len(keys) + len(names), []
    for i, key in enumerate(keys):
        arcs += [(0, 1 + i, patterns[key], e) for e in range(epochs)]
    for i, key in enumerate(keys):
        arcs += [(1 + i, at[s], epochs * patterns[key], 0) for s in key]
    arcs += [(at[s], sink, quotas[s], 0) for s in names]
    flow = min_cost_flow(sink + 1, arcs, 0, sink)
    return {key: sum(flow[i * epochs : (i + 1) * epochs]) for i, key in enumerate(keys)}


def mix(docs: DataFrame, size: Column, sources: Column, weights=None, total: float | None = None, epochs: int = 3, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """docs with `mix_size`, `mix_taken`, and the table of sources (source, source_size, target).

    sources: array of the sources that hold the document (nulls allowed; null, not an array, is the source null). weights: a dict, or
    None for 1, 2, 3, repeating in code point order, null last. Documents are aggregated by membership pattern, so what reaches the
    driver grows with the number of patterns and sources alone. Within a pattern, the words that the flow asks for are taken as whole
    epochs, then documents in the order of a seeded hash of doc_id and text; the one document on the border gives the words that are
    still missing (repeated equal rows on the border share them evenly, so the result doesn't depend on the order of rows).

    Where every document has one source, as in the query below, each pattern is one source, and the flow gives it its target.

    Defined results: null or blank text has size 0 and is taken 0 times; empty tables give empty tables; equal hashes share the border;
    columns of the input keep their names, but those called mix_in, mix_size or mix_taken are replaced.
    """
    spark = docs.sparkSession
    kept = others(docs.columns, ["mix_in", "mix_size", "mix_taken"])
    # the columns of docs travel as one, so none of their names can clash
    own = docs.select(F.struct(*docs.columns).alias("mix_row"), "doc_id", "text", size.cast("long").alias("mix_size"), sources.alias("mix_of")).withColumns({
        "mix_in": F.array_sort(F.array_distinct(F.coalesce("mix_of", F.array(F.lit(None).cast("string")))), lambda a, b: F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), 1).when(b.isNull(), -1).when(a < b, -1).when(a > b, 1).otherwise(0)),
        "mix_hash": F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")),
    })
    slim = stored(own.select("mix_in", "mix_size", "mix_hash"), "mix")
    found = slim.groupBy("mix_in").agg(F.sum("mix_size").alias("n")).collect()
    patterns = {tuple(r.mix_in): r.n for r in found}
    sizes: dict = {}
    for key, n in patterns.items():
        for s in key:
            sizes[s] = sizes.get(s, 0) + n
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weights = {s: weights[s] for s in order} if weights is not None else {s: i % 3 + 1 for i, s in enumerate(order)}
    target = fill_targets(sizes, weights, sum(patterns.values()) if total is None else total, epochs)
    gives = route(patterns, {s: round(target[s]) for s in order}, epochs)
    named = T.StructType([T.StructField("mix_in", T.ArrayType(T.StringType())), T.StructField("whole", T.LongType()), T.StructField("rest", T.LongType())])
    plan = spark.createDataFrame([(list(k), v // patterns[k], v % patterns[k]) if patterns[k] else (list(k), 0, 0) for k, v in gives.items()], named)
    cut = _borders(slim, plan)
    rows = [(list(r.mix_in), r.whole, r.cut, r.share) for r in cut.collect()]
    drop_stored(slim)
    cuts = spark.createDataFrame(rows, "mix_in array<string>, mix_whole long, mix_cut long, mix_share long")  # as many rows as patterns
    part = F.when(F.col("mix_hash") < F.col("mix_cut"), F.col("mix_size")).when(F.col("mix_hash") == F.col("mix_cut"), F.least("mix_size", "mix_share")).otherwise(0)
    if len(rows) <= 10_000:
        cuts = F.broadcast(cuts)
    taken = own.join(cuts, "mix_in", "left").withColumn("mix_taken", F.coalesce(F.col("mix_whole") * F.col("mix_size") + part, F.lit(0).cast("long")))
    report = spark.createDataFrame([(s, sizes[s], target[s]) for s in order], "source string, source_size long, target double")
    return taken.select(*(F.col("mix_row")[c].alias(c) for c in kept), "mix_in", "mix_size", "mix_taken"), report


def _borders(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """For each pattern: whole epochs, the hash at which the rest runs out, and what each row with that hash gives."""
    dealt = slim.withColumn("b", F.shiftright("mix_hash", 52))  # -2048 .. 2047, in the order of the hash
    sums = dealt.groupBy("mix_in", "b").agg(F.sum("mix_size").alias("n"))
    upto = Window.partitionBy("mix_in").orderBy("b")  # BUCKETS rows at most
    edge = sums.withColumn("before", F.sum("n").over(upto) - F.col("n")).join(plan, "mix_in").where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
    inside = dealt.join(edge.select("mix_in", "b", "before", "rest"), ["mix_in", "b"]).groupBy("mix_in", "mix_hash", "before", "rest").agg(F.sum("mix_size").alias("n"), F.count("*").alias("rows"))
    run = Window.partitionBy("mix_in").orderBy("mix_hash")  # the rows of one bucket
    last = inside.withColumn("start", F.col("before") + F.sum("n").over(run) - F.col("n")).where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("n")))
    last = last.select("mix_in", F.col("mix_hash").alias("cut"), ((F.col("rest") - F.col("start")) / F.col("rows")).cast("long").alias("share"))
    return plan.join(last, "mix_in", "left").select("mix_in", "whole", F.coalesce("cut", F.lit(-(2**63))).alias("cut"), F.coalesce("share", F.lit(0)).alias("share"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed, report = mix(docs, word_count(F.col("text")), F.array("source"))
    report = report.withColumnRenamed("source", "_s")
    return mixed.join(F.broadcast(report) if report.count() <= 10_000 else report, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", F.col("mix_taken").alias("taken"))
