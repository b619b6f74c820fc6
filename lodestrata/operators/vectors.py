"""Vector operators: expressions over arrays, and block-wise all-pairs work whose memory is bounded by two blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, 1 - dot(a, b) / n).otherwise(1.0)


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def lift(a: Column) -> Column:
    """Point of the hyperboloid over a: [sqrt(1 + |a|^2), a...]."""
    return F.concat(F.array(F.sqrt(1 + dot(a, a))), F.transform(a, lambda x: x.cast("double")))


def lorentz_distance(a: Column, b: Column) -> Column:
    """acosh of max(1, -<a, b>), time coordinate first."""
    inner = 2 * F.get(a, F.lit(0)) * F.get(b, F.lit(0)) - dot(a, b)
    return F.acosh(F.greatest(inner, F.lit(1.0)))


def log_map_origin(a: Column) -> Column:
    """Tangent vector at the origin; 0 where the spatial part is 0."""
    s = F.slice(a, F.lit(2), F.size(a) - 1)
    n = norm(s)
    k = F.when(n > 0, F.acosh(F.greatest(F.get(a, F.lit(0)), F.lit(1.0))) / n).otherwise(0.0)
    return F.transform(s, lambda x: x * k)


def poincare(a: Column) -> Column:
    return F.transform(F.slice(a, F.lit(2), F.size(a) - 1), lambda x: x / (F.get(a, F.lit(0)) + 1))


def blocks(df: DataFrame, key: str, vector: str, extra: list[str] = (), rows: int = BLOCK) -> tuple[DataFrame, int]:
    """(b, rows: array of structs) blocks of about `rows` vectors, dealt by hash, and their number."""
    n = max(1, -(-df.count() // rows))
    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("b")).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("id"), F.col(vector).alias("v"), *extra))).alias("rows")), n


def against_all(df: DataFrame, key: str, vector: str, work: Callable, schema: str, extra: list[str] = ()) -> DataFrame:
    """work(own rows, other rows) -> columns, for every pair of blocks; the pairs are spread over the cluster and each task holds two blocks at a time."""
    own, n = blocks(df, key, vector, extra)
    pairs = own.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(own.select(F.col("b").alias("c"), F.col("rows").alias("other")), "c").select("rows", "other")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                out = work(b.column(0)[i].as_py(), b.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

    return pairs.mapInArrow(run, schema)


def _unit(rows: list[dict]) -> np.ndarray:
    x = np.array([r["v"] for r in rows], float)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def nearest(df: DataFrame, key: str, vector: str, k: int, group: str | None = None) -> DataFrame:
    """(id, other, distance, rank): the k nearest by cosine distance, itself left out, ties by id. With group, `same` says whether the neighbour has the same one."""

    def work(own, other):
        d = 1 - _unit(own) @ _unit(other).T
        ids, oids = np.array([r["id"] for r in own]), np.array([r["id"] for r in other])
        d[ids[:, None] == oids[None, :]] = np.inf
        m = min(k, d.shape[1])
        # one more than asked for and all ties of the last, so ties by id are decided over whole blocks
        at = np.argpartition(d, m - 1, axis=1)[:, :m] if m < d.shape[1] else np.tile(np.arange(m), (len(d), 1))
        far = np.take_along_axis(d, at, 1).max(1)
        r, c = np.nonzero((d <= far[:, None]) & np.isfinite(d))
        out = [ids[r], oids[c], d[r, c]]
        if group:
            g, og = np.array([x["g"] for x in own]), np.array([x["g"] for x in other])
            out.append(g[r] == og[c])
        return out

    schema = "id long, other long, distance double" + (", same boolean" if group else "")
    near = against_all(df, key, vector, work, schema, [F.col(group).alias("g")] if group else [])
    w = Window.partitionBy("id").orderBy("distance", "other")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Triangles are merged in so many groups before the last one.
SALTS = 32


def _reduced(rows: np.ndarray) -> np.ndarray:
    """The triangle of a QR decomposition; fewer rows than columns stay as they are."""
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def triangle(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(R, mean, n): R'R is the sum of outer products of the centred vectors, by QR up a tree; n vectors, null ones left out.

    A task reduces its rows, with a 1 before each, to one triangle, a block at a time; triangles are stacked and reduced again in SALTS groups
    and then in one. The column of ones takes the mean out, so nothing is squared and small axes keep their digits. A triangle travels as
    one packed row, and the driver receives the last: (D + 1) numbers squared, whatever the number of vectors.
    """
    packed = pa.schema([("salt", pa.int64()), ("width", pa.int64()), ("n", pa.int64()), ("r", pa.binary())])

    def told(salt: int, r: np.ndarray, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([salt], pa.int64()), pa.array([r.shape[1]], pa.int64()), pa.array([n], pa.int64()), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], schema=packed)

    def reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, n, salt = None, 0, 0
        for b in batches:
            if b.num_rows:
                salt = b.column(1)[0].as_py()
                x = np.array(b.column(0).to_pylist(), float)
                x = np.column_stack([np.ones(len(x)), x])
                r, n = _reduced(x if r is None else np.vstack([r, x])), n + len(x)
        if n:
            yield told(salt, r, n)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, n = None, 0
        for b in batches:
            for part in b.to_pylist():
                x = np.frombuffer(part["r"]).reshape(-1, part["width"])
                r, n = _reduced(x if r is None else np.vstack([r, x])), n + part["n"]
        if n:
            yield told(0, r, n)

    schema = "salt long, width long, n long, r binary"
    parts = df.where(F.col(vector).isNotNull()).select(vector, F.pmod(F.spark_partition_id(), F.lit(SALTS)).cast("long").alias("salt")).mapInArrow(reduce, schema)
    got = parts.groupBy("salt").applyInArrow(merge, schema).groupBy("salt").applyInArrow(merge, schema).first()
    if got is None:
        raise ValueError("there is no vector")
    r = np.linalg.qr(np.frombuffer(got.r).reshape(-1, got.width), mode="r")
    return r[1:, 1:], r[0, 1:] / r[0, 0], got.n


def isotropy(df: DataFrame, vector: str) -> float:
    """exp(entropy of the normalised spectrum of the centred vectors) / D; NaN if they are all the same."""
    r, mean, _ = triangle(df, vector)
    e = np.linalg.svd(r, compute_uv=False) ** 2 if len(r) else np.zeros(1)
    if e.sum() <= 1e-24 * max(1.0, float(mean @ mean)):
        return float("nan")
    p = e[e > 0] / e.sum()
    return float(np.exp(-(p * np.log(p)).sum()) / len(mean))


def pca(df: DataFrame, vector: str, k: int, out: str = "pca") -> DataFrame:
    """Projection of the centred vectors on the first k axes; each axis' largest component is positive."""
    r, mean, _ = triangle(df, vector)
    axes = np.linalg.svd(r)[2][:k].T
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    lit = lambda x: F.array(*(F.lit(float(y)) for y in x))
    centred = F.zip_with(F.col(vector), lit(mean), lambda a, b: a.cast("double") - b)
    return df.withColumn(out, F.array(*(dot(centred, lit(axes[:, j])) for j in range(axes.shape[1]))))
