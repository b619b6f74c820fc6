"""Readers and writers. Everything goes through Spark's own sources, so any store that Spark reads will do; schemas are passed, not inferred."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The five dimensions of the wide export, and its number of quarter columns.
WIDE_DIMS, WIDE_QUARTERS = ("product", "dosage", "dosage2", "brand", "market"), 48


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sheet: str | int = 0) -> DataFrame:
    """csv, tsv, json, parquet, or an Excel sheet by the path's ending. Excel files are read by pandas on the driver, if it can."""
    low = path.lower()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if low.endswith((".parquet", ".pq")):
        return reader.parquet(path)
    if low.endswith((".json", ".jsonl")):
        return reader.json(path)
    if low.endswith((".xlsx", ".xls")):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet, dtype=str), schema)
    return reader.option("header", True).option("sep", "\t" if low.endswith((".tsv", ".txt")) else ",").csv(path)


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table, or an empty one of the schema where the path doesn't exist."""
    try:
        return read_table(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def wide_schema() -> T.StructType:
    """Column1..Column53, strings on read."""
    return T.StructType([T.StructField(f"Column{i}", T.StringType()) for i in range(1, len(WIDE_DIMS) + WIDE_QUARTERS + 1)])


def resolve_column(df: DataFrame, *names: str) -> str:
    """The first column that has one of the names, whatever its case."""
    own = {c.lower(): c for c in reversed(df.columns)}
    for n in names:
        if n.lower() in own:
            return own[n.lower()]
    raise ValueError(f"none of {', '.join(names)} is a column; there are {', '.join(df.columns)}")


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def quarter_columns(last: int, n: int = WIDE_QUARTERS) -> dict[str, str]:
    """Column name -> quarter label, counted back from the last quarter (year * 4 + quarter - 1)."""
    return {f"Column{len(WIDE_DIMS) + 1 + i}": f"{(last - n + 1 + i) // 4}Q{(last - n + 1 + i) % 4 + 1}" for i in range(n)}


def load_vectors(spark: SparkSession, path: str, codes: DataFrame | None = None) -> DataFrame:
    """(code, embedding); with a table of codes, its rows alone, and an error if one has no vector."""
    v = spark.read.parquet(path)
    if codes is None:
        return v
    lost = codes.join(v, "code", "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"codes without a vector: {', '.join(str(r.code) for r in lost)}")
    return codes.join(v, "code")


def canonical_codes(df: DataFrame, code: str = "code") -> DataFrame:
    """Distinct codes of a valid level, without those that begin with T, sorted."""
    from ..functions.scalars import level

    return df.select(F.col(code).alias("code")).where(~F.col("code").startswith("T") & level(F.col("code")).isNotNull()).distinct().orderBy("code")


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_vectors(df: DataFrame, path: str, model: str, kind: str, root: str = "ROOT") -> None:
    """Vectors with their metadata as Parquet, without the virtual root."""
    df.where(F.col("code") != root).withColumns({"model": F.lit(model), "format": F.lit(kind)}).write.mode("overwrite").parquet(path)


def export_projector(vectors: DataFrame, labels: DataFrame, path: str) -> None:
    """Tab-separated vectors and metadata side by side, in one order (sorted by code)."""
    both = vectors.join(labels, "code", "left").withColumn("label", F.coalesce("label", F.lit("N/A"))).orderBy("code")
    both.select(F.array_join(F.transform("embedding", lambda x: x.cast("string")), "\t").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/vectors")
    both.select("code", "label").coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}/metadata")


def embed(df: DataFrame, key: str, text: str, embedder: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """(key, embedding) by any function from texts to vectors, called with up to `batch` texts at a time on the executors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(embedder(part.column(1).to_pylist()), pa.list_(pa.float32()))], [key, "embedding"])

    return df.select(key, text).mapInArrow(run, df.select(key).schema.add("embedding", T.ArrayType(T.FloatType())))


def with_default_vector(keys: DataFrame, vectors: DataFrame, key: str, dims: int) -> DataFrame:
    """keys with the vector of each, and the zero vector where there is none."""
    kind = vectors.schema["embedding"].dataType.elementType
    return keys.join(vectors, key, "left").withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast(kind), dims)))


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load_inputs(spark: SparkSession, raw: str, prepared: str, raw_schema: T.StructType | str | None = None, prepared_schema: T.StructType | str | None = None) -> tuple[DataFrame, DataFrame]:
    """The raw and the prepared table; an error that names every one that isn't there before anything is read."""
    lost = [p for p in (raw, prepared) if not path_exists(spark, p)]
    if lost:
        raise FileNotFoundError(f"run the steps before this one: {', '.join(lost)} missing")
    return read_table(spark, raw, raw_schema), read_table(spark, prepared, prepared_schema)


def append_report(df: DataFrame, path: str) -> None:
    """More rows for a CSV report, written where they lie; every part has the header."""
    df.write.mode("append").option("header", True).csv(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Pairs of codes (ancestor, descendant), one JSON array a row, as read_edges() takes them."""
    edges.select(F.to_json(F.array("ancestor", "descendant")).alias("value")).write.mode("overwrite").text(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(ancestor, descendant) from JSON arrays: one pair a row, or all pairs in one array."""
    pairs = F.coalesce(F.when(F.col("value").rlike(r"^\s*\[\s*\["), F.from_json("value", "array<array<string>>")), F.array(F.from_json("value", "array<string>")))
    rows = spark.read.option("wholetext", False).text(path).select(F.explode(pairs).alias("p"))
    return rows.select(F.col("p")[0].alias("ancestor"), F.col("p")[1].alias("descendant"))


def load_code_vectors(spark: SparkSession, path: str, codes: DataFrame | None, kind: str, dims: int | None = None) -> DataFrame:
    """(code, embedding) as a configuration wants them. euclidean: reduced to dims principal axes where dims is given, then of unit length; hyperbolic: the log map at the origin."""
    from ..operators import vectors as V

    rows = load_vectors(spark, path, codes)
    if kind == "hyperbolic":
        return rows.select("code", V.log_map_origin(F.col("embedding")).alias("embedding"))
    if dims is not None:
        rows = V.pca(rows, "embedding", dims, "embedding_").select("code", F.col("embedding_").alias("embedding"))
    return rows.select("code", V.normalize(F.col("embedding")).alias("embedding"))
