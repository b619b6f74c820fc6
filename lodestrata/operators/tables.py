"""Steps whose result is read more than once are tables in the cluster's shared folder; and running numbers over any number of rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a temporary folder only where that is unset and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _OWN.get(app) or _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="lodestrata-"))
    return folder.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: worked out once, whatever reads it, and not lost with an executor."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, keys: list[str], sums: dict[str, str], tag: str = "running") -> DataFrame:
    """df, one row per keys, with new columns: for `out: column` in sums the sum of column over the rows up to and with this one in the order of keys (nulls first).

    Ranges of keys are stored with the number of their task, so all that follows sees the same ranges, however often they are read and
    whatever the planner reuses. Within a range the sum is a window; what lies before it comes from the ranges' totals, a row each.
    """
    rows = stored(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), tag)
    totals = rows.groupBy("_range").agg(*(F.sum(c).alias(f"_{o}") for o, c in sums.items()))
    ahead = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = totals.select("_range", *(F.coalesce(F.sum(f"_{o}").over(ahead), F.lit(0)).alias(f"_{o}") for o in sums))
    upto = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.select("*", *(F.sum(c).over(upto).alias(o) for o, c in sums.items()))
    return within.join(F.broadcast(before), "_range").select(*df.columns, *((F.col(o) + F.col(f"_{o}")).alias(o) for o in sums))
