"""From a wide sales export (five dimensions, 48 quarters, rows of metadata among the data) to the long quarterly table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..sources.io import WIDE_DIMS, WIDE_QUARTERS, require_columns

#: Columns of the export: dimensions first, then quarters.
FIXED = {f"Column{i + 1}": name for i, name in enumerate(WIDE_DIMS)}
QUARTERS = [f"Column{len(WIDE_DIMS) + 1 + i}" for i in range(WIDE_QUARTERS)]
#: What the first and fifth column say in a row of metadata, how many quarter labels make one, how many rows are searched for labels.
FIRST_SAYS, FIFTH_SAYS, LEAST_LABELS, HEAD = ("molecule list", "product", "product list"), ("country", "market"), 3, 10


def check_layout(raw: DataFrame) -> DataFrame:
    return require_columns(raw, [*FIXED, *QUARTERS])


def _cells() -> Column:
    return F.array(*(F.col(c).cast("string") for c in QUARTERS))


def is_metadata(raw: DataFrame) -> Column:
    """A row that repeats headings or labels at least LEAST_LABELS of its cells as quarters. The cells are one array, so the expression is as long for any number of them."""
    low = lambda c: F.lower(X.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    labels = F.size(F.filter(_cells(), lambda x: x.rlike(f"(?i)(?:{X.YEAR_FIRST}|{X.QUARTER_FIRST})")))
    return low("Column1").isin(*FIRST_SAYS) | low("Column5").isin(*FIFTH_SAYS) | (labels >= LEAST_LABELS)


def split_metadata(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of data, one row with n_removed). The flag is made once for each, in the scan."""
    flagged = raw.withColumn("_metadata", is_metadata(raw))
    return flagged.where(~F.col("_metadata")).drop("_metadata"), flagged.agg(F.count_if("_metadata").alias("n_removed"))


def quarter_map(last: str) -> dict[str, str]:
    """Column -> YYYYQn, counted back from the last quarter (YYYYQn)."""
    end = int(last[:4]) * 4 + int(last[5]) - 1
    return {c: f"{(end - WIDE_QUARTERS + 1 + i) // 4}Q{(end - WIDE_QUARTERS + 1 + i) % 4 + 1}" for i, c in enumerate(QUARTERS)}


def labelled_quarters(raw: DataFrame) -> dict[str, str] | None:
    """Column -> YYYYQn from the first of the HEAD first rows whose 48 quarter cells all name a quarter; None if there is none."""
    head = raw.limit(HEAD).select(F.transform(_cells(), X.quarter_search).alias("labels")).collect()
    return next((dict(zip(QUARTERS, r.labels)) for r in head if all(r.labels)), None)


def to_long(raw: DataFrame, quarters: dict[str, str]) -> DataFrame:
    """One row per row and quarter: cleaned dimensions, year, quarter, quarter_label, quarter_start, sales_units (NULL where blank or no number). Unpivots in one pass; dimensions are cleaned before it, once a row and not once a quarter."""
    rows = check_layout(raw).select(*(X.clean_text(F.col(c).cast("string")).alias(n) for c, n in FIXED.items()), *(F.col(c).cast("string").alias(quarters[c]) for c in QUARTERS))
    q = X.ordinal(F.col("quarter_label"))
    long = rows.unpivot(list(WIDE_DIMS), list(quarters.values()), "quarter_label", "cell")
    return long.select(*WIDE_DIMS, F.floor(q / 4).cast("int").alias("year"), (q % 4 + 1).cast("int").alias("quarter"), "quarter_label", X.quarter_start(q).alias("quarter_start"), X.clean_sales(F.col("cell")).alias("sales_units"))


def aggregate(long: DataFrame) -> DataFrame:
    """One row per dimensions and quarter: the sum (NULL where every cell is), rows, missing rows."""
    return long.groupBy(*WIDE_DIMS, "year", "quarter", "quarter_label", "quarter_start").agg(F.sum("sales_units").alias("sales_units"), F.count("*").alias("source_rows"), F.count_if(F.col("sales_units").isNull()).alias("missing_sales_rows"))


def prepare(raw: DataFrame, last: str | None = None) -> DataFrame:
    """The whole step. Quarters are those that a metadata row names, or are counted back from `last`."""
    check_layout(raw)
    quarters = labelled_quarters(raw) if last is None else quarter_map(last)
    if quarters is None:
        raise ValueError("no row names the quarters; give the last one")
    return aggregate(to_long(split_metadata(raw)[0], quarters))
