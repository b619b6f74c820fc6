"""Exact nearest neighbours by cosine distance, and which blocks of clustered vectors can hold them.

Vectors of unit length lie around pivots; those nearest to one pivot are cut into blocks by their distance to it, so a block is a ring around
its pivot. A block first finds neighbours within itself, which bounds how far its vectors need look. By the triangle inequality the vectors
of two rings have a least distance, and where that is beyond the bound the blocks don't meet.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import running, stored
from .tiles import Nearest, against, matrix, packed
from .vectors import BLOCK

#: At most so many pivots, which every task holds.
MOST_PIVOTS = 4096


def _units(rows: list[dict]) -> np.ndarray:
    x = np.array([r["v"] for r in rows], float)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def rings(df: DataFrame, rows: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(blocks: b, cluster, low, high, rows; pivots). df: id, v, labels. Rings of up to `rows` vectors between distances low and high of their pivot; null vectors are left out, zero ones are a cluster (-1) without a pivot."""
    df = df.where("v IS NOT NULL")
    n = df.count()
    pivots = _units([r.asDict() for r in df.orderBy(F.xxhash64("id"), "id").limit(min(MOST_PIVOTS, max(1, -(-n // rows)))).collect()]) if n else np.empty((0, 0))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(1).to_pylist(), float)
                size = np.linalg.norm(x, axis=1)
                x = x / np.where(size > 0, size, 1)[:, None]
                far = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0))
                at = far.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(size > 0, at, -1)), pa.array(far[np.arange(len(x)), at])], names=[*b.schema.names, "cluster", "far"])

    placed = df.select("id", "v", "labels").mapInArrow(place, df.select("id", "v", "labels").schema.add("cluster", "long").add("far", "double")).withColumn("one", F.lit(1))
    placed = running(placed, ["cluster", "far", "id"], {"at": "one"}, "rings")
    first = placed.groupBy("cluster").agg(F.min("at").alias("first"))  # a row a pivot
    placed = placed.join(F.broadcast(first), "cluster").withColumn("b", F.col("at") - (F.col("at") - F.col("first")) % rows)
    return stored(placed.groupBy("b", "cluster").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.sort_array(F.collect_list(F.struct("id", "v", "labels"))).alias("rows")), "blocks"), pivots


def _found(own: list[dict], other: list[dict], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, places in own, places in other, distances, same label, own's k-th distance) of each level's k nearest, with all ties of the last."""
    d = np.maximum(1 - _units(own) @ _units(other).T, 0)
    mine, theirs = np.array([r["id"] for r in own]), np.array([r["id"] for r in other])
    d[mine[:, None] == theirs[None, :]] = np.inf
    for level in range(len(own[0]["labels"])):
        la, lb = (np.array([r["labels"][level] for r in x], object) for x in (own, other))
        i, j = (np.flatnonzero([x is not None for x in y]) for y in (la, lb))
        if not len(i) or not len(j):
            yield level, i[:0], j[:0], np.empty(0), np.empty(0, bool), np.full(len(i), np.inf)
            continue
        sub = d[np.ix_(i, j)]
        m = min(k, sub.shape[1])
        last = np.partition(sub, m - 1, axis=1)[:, m - 1] if m == k else np.full(len(i), np.inf)
        r, c = np.nonzero((sub <= last[:, None]) & np.isfinite(sub))
        yield level, i[r], j[c], sub[r, c], la[i[r]] == lb[j[c]], last


def block_pairs(blocks: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """(a, b): block a's vectors may have one of their k nearest in block b."""
    between = np.sqrt(np.maximum((pivots * pivots).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * pivots @ pivots.T, 0)) if len(pivots) else np.empty((0, 0))

    def reach(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How far a block's vectors must look, from what lies within it."""
        for batch in batches:
            for r in batch.to_pylist():
                far = max((float(last.max()) for *_, last in _found(r["rows"], r["rows"], k) if len(last)), default=0.0)
                yield pa.RecordBatch.from_arrays([pa.array([r["b"]]), pa.array([r["cluster"]]), pa.array([r["low"]]), pa.array([r["high"]]), pa.array([far])], names=["b", "cluster", "low", "high", "far"])

    facts = stored(blocks.mapInArrow(reach, "b long, cluster long, low double, high double, far double"), "reach")
    wide = {r.cluster: (r.low, r.high) for r in facts.groupBy("cluster").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}  # a row a pivot

    def clusters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                # distances of the block's vectors to each pivot, and what they can reach (with room for rounding)
                bound, out = np.sqrt(2 * r["far"]) + 1e-6, []
                for c, (low, high) in wide.items():
                    if r["cluster"] < 0 or c < 0:
                        near, most = -np.inf, np.inf
                    else:
                        x = between[r["cluster"], c]
                        near, most = max(x - r["high"], r["low"] - x, 0), x + r["high"]
                    if max(near - high, low - most) <= bound:
                        out.append((r["b"], c, near, most, bound))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["a", "cluster", "near", "most", "bound"])

    met = facts.select("b", "cluster", "low", "high", "far").mapInArrow(clusters, "a long, cluster long, near double, most double, bound double").join(facts.select("b", "cluster", "low", "high"), "cluster")
    return met.where(F.greatest(F.col("near") - F.col("high"), F.col("low") - F.col("most")) <= F.col("bound")).select("a", "b")


def neighbours(df: DataFrame, k: int, rows: int | None = None) -> DataFrame:
    """(level, id, other, distance, same, rank): of every row with a label at a level the k nearest of the other rows with one, ties by id, and whether they have the same label.

    df: id, v, labels (an array, one label a level, NULL where a row takes no part in it). All levels are answered from one set of
    distances. A zero vector is at distance 1 from all; rows without a vector are left out. Chunks of vectors stream past each task's own.
    """

    def pack(part: pa.Table) -> dict:
        return {"id": part.column("id").to_numpy(), "x": matrix(part.column("v")), "labels": np.array(part.column("labels").to_pylist(), object)}

    chunks = packed(df.where("v IS NOT NULL").select("id", "v", "labels"), "id", pack, rows)
    return against(chunks, chunks, lambda own: Nearest(own, k), "level int, id long, other long, distance double, same boolean, rank int")
