"""Helpers shared by the operators for training-data pipelines."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import clean, forget, remove, shared_dir, tables_dir, written  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark (the path may be in any store Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(col, UPPER, LOWER)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows and bytes of an Arrow batch, as a text can be very long; a setting of the session, read when a query runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


#: Bytes of the text columns of a broadcast table.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, rows: int, items: str | None = None) -> DataFrame:
    """A broadcast hint only where a count shows that ``df`` has at most ``rows`` rows and its text few bytes; otherwise Spark shuffles.

    With ``items``, the elements of that list column count too, so that long lists are bounded as well.
    """
    texts = [name for name, kind in df.dtypes if kind in ("string", "binary")]
    if items is None and texts:
        size = reduce(Column.__add__, [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c in texts])
        n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
        return F.broadcast(df) if n <= rows and total <= BROADCAST_BYTES else df
    if items is None:
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    n = df.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size(items)), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= rows else df


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """A text column as a list, null as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
