"""What the operators of this subpackage share: word rules, token hashes, and tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what separates words in the contracts that count plain words.
BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
BLANKS = " \t\n\x0b\x0c\r"
#: Fixed value: lower-casing of A-Z alone, as `translate` takes it.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)

_OWN: dict[str, str] = {}
#: Bytes of a batch on its way to a Python worker. The JVM holds it outside its heap, and the worker as columns and again as objects, for each task at once.
BATCH = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one only where that is unset and all runs in one process (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, "")
        if not folder:
            folder = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
    return folder.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    # what the step shuffled is garbage from here on, but executors keep the files until the driver collects its own
    spark._jvm.System.gc()
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def drop_stored(*frames: DataFrame | None) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    for df in frames:
        if df is not None and (at := getattr(df, "_stored_at", None)):
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def others(columns: list[str], own: list[str]) -> list[str]:
    """The columns that none of an operator's own replaces (names differ in more than case)."""
    taken = {c.lower() for c in own}
    return [c for c in columns if c.lower() not in taken]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in text, 0 for null; one split, no per-word function."""
    edges = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(text.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.size(F.split(text, BREAK)) - edges).otherwise(0).cast("long")


def low_words(text: str) -> list[bytes]:
    """The words of a text in UTF-8, A-Z in lower case: of bytes, lower() and split() know ASCII alone, and split() the blanks of WORD."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """word (or its bytes) -> 64-bit hash, remembered; emptied when it has grown to `most` words, so memory is bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str | bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass") if isinstance(word, str) else word)
        return h

    def of(self, words: list[str] | list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) & (2**64 - 1) | 1 for i in range(1, 17)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive word hashes (len(h) - size + 1 of them)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n] * _ODD[0]
    for i in range(1, size):
        out = out + mix64(h[i : i + n] + _ODD[i]) * _ODD[i]
    return mix64(out)
