"""Distances of vectors to partners found by modular arithmetic, without sending a vector once a partner.

The k-th partner of a is (by a + k step) mod size. Numbers are laid on lines on which step goes one place on, so the partners of a for
consecutive k lie side by side. Lines are cut into blocks, and a vector goes to its own block and to the one or two in which its partners lie.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block, on average.
BLOCK = 8192
#: Characters of a code that a common prefix is looked for in.
PREFIX = 11


class Line:
    """Places of the numbers below size: step is one place on, in a circle of `round` places (as many circles as step and size have common factors)."""

    def __init__(self, size: int, step: int):
        self.size, self.circles = size, gcd(step, size)
        self.round = size // self.circles
        self.back = pow(step // self.circles, -1, self.round)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place of the circle, place in it)."""
        q = x // self.circles
        if self.round > 3_000_000_000:  # the product needs more than 64 bits
            q = q.astype(object)
        return x % self.circles * self.round, (q * self.back % self.round).astype(np.int64)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in doubles (zeros where there is none, or a component is missing), and their lengths."""
    size, flat = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), column.flatten()
    if not column.null_count and not flat.null_count and len(size) and (size == size[0]).all():
        return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(size), -1), size
    out = np.zeros((len(size), size.max(initial=0)))
    for i, v in enumerate(column.to_pylist()):
        if v is not None and None not in v:
            out[i, : len(v)] = v
    return out, size


def _digits(ids: np.ndarray) -> np.ndarray:
    return ids.astype("S20").view(np.uint8).reshape(len(ids), 20)


def partner_distances(vectors: DataFrame, key: str, vector: str, by: int, step: int, first: int, last: int) -> DataFrame:
    """(dist, tree) of each vector a and its partners b for k from first to last, where there is such a vector and a < b: cosine distance (1 where a norm is 0 or a vector or component is missing), and the distance of their numbers as codes, digit by digit. Vectors without a number have no partners."""
    e = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    top, n = e.agg(F.max("id"), F.count("*")).first()
    schema = "dist double, tree int"
    if not n or top < 0:
        return e.sparkSession.createDataFrame([], schema)
    line = Line(top + 1, step)
    width = BLOCK * -(-line.size // n)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            own = np.flatnonzero(ids >= 0)
            at = sum(line(ids[own]))
            yield pa.RecordBatch.from_arrays([pa.array(at // width), pa.array(at), pa.array(np.zeros(len(at), bool)), *b.take(pa.array(own)).columns], names=["block", "at", "asks", "id", "v"])
            circle, place = line(ids * by % line.size)
            met = np.sort((circle[:, None] + (place[:, None] + np.arange(first, last + 1)) % line.round) // width, 1)
            i, j = np.nonzero(np.diff(met, axis=1, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(met[i, j]), pa.array(np.zeros(len(i), np.int64)), pa.array(np.ones(len(i), bool)), *b.take(pa.array(i)).columns], names=["block", "at", "asks", "id", "v"])

    def meet(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks, ids = t["asks"].to_numpy(), t["id"].to_numpy()
        v, size = _matrix(t["v"].chunk(0))
        norm, text = np.sqrt(np.einsum("ij,ij->i", v, v)), _digits(ids)
        long, text = (text > 0).sum(1), text[:, :PREFIX]
        a, own, at = np.flatnonzero(asks), np.flatnonzero(~asks), t["at"].to_numpy()
        own = own[np.argsort(at[own], kind="stable")]
        at = at[own]
        circle, place = line(ids[a] * by % line.size)
        dist, tree = [np.empty(0)], [np.empty(0, np.int32)]
        for k in range(first, last + 1):
            want = circle + (place + k) % line.round
            low = np.searchsorted(at, want)
            count = np.searchsorted(at, want, "right") - low  # a number may be there more than once
            x = np.repeat(a, count)
            y = own[np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(x))]
            keep = ids[x] < ids[y]
            x, y = x[keep], y[keep]
            n = norm[x] * norm[y]
            keep = (size[x] == size[y]) | (n <= 0)  # of vectors of unlike lengths there is no distance
            x, y, n = x[keep], y[keep], n[keep]
            dist.append(np.where(n <= 0, 1.0, 1 - np.einsum("ij,ij->i", v[x], v[y]) / np.where(n <= 0, 1.0, n)))
            same = np.logical_and.accumulate((text[x] == text[y]) & (text[x] > 0), axis=1).sum(1)
            tree.append((long[x] + long[y] - 2 * same).astype(np.int32))
        return pa.table({"dist": np.concatenate(dist), "tree": np.concatenate(tree)})

    kind = e.schema["v"].dataType.simpleString()
    return e.mapInArrow(deal, f"block long, at long, asks boolean, id long, v {kind}").groupBy("block").applyInArrow(meet, schema)
