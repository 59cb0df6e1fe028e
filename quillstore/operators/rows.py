"""Rows: (column, row id) to a map of keys and values, replaced as a whole or merged key by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import REPLACE
from .objects import latest

ROW = ["column", "row_id"]
ENTRY = [*ROW, "key"]


def live_rows(log: DataFrame, commit: str | None = None) -> DataFrame:
    """The live entries of a log (column, row_id, key, value, kind, seq): since a row's last replacement, the last value of each key.

    commit names the column whose equal values are one batch; by default seq >> 32. Last replacements are numbers by row, aggregated before
    the shuffle and joined back, so the mutations of a row that has very many needn't meet in one task.
    """
    batch = F.col(commit) if commit else F.shiftright("seq", 32)
    base = log.where(F.col("kind") == REPLACE).groupBy(F.col("column").alias("_column"), F.col("row_id").alias("_row")).agg(F.max(batch).alias("_base"))
    based = log.withColumn("_batch", batch).join(base, (F.col("column") == F.col("_column")) & (F.col("row_id") == F.col("_row")), "left")
    since = based.where(F.col("_base").isNull() | (F.col("_batch") >= F.col("_base"))).drop("_batch", "_base", "_column", "_row")
    return latest(since, ENTRY)


def live_row(log: DataFrame) -> DataFrame:
    """The same of the mutations of one row, in one pass and one shuffle."""
    based = log.withColumn("_batch", F.shiftright("seq", 32)).withColumn("_base", F.max(F.when(F.col("kind") == REPLACE, F.col("_batch"))).over(Window.partitionBy(*ROW)))
    return latest(based.where(F.col("_base").isNull() | (F.col("_batch") >= F.col("_base"))).drop("_batch", "_base"), ENTRY)


def dedupe_batch(batch: DataFrame, order: str = "seq") -> DataFrame:
    """The last value of each key of each row of a batch."""
    return latest(batch, ENTRY, order)


def row_maps(entries: DataFrame) -> DataFrame:
    """column, row_id, entries array<struct<key, value>> by key: one value for each row."""
    return entries.groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("entries"))


def row_sizes(entries: DataFrame) -> DataFrame:
    """column, row_id and the number of live entries."""
    return entries.groupBy(*ROW).agg(F.count("*").alias("item_count"))
