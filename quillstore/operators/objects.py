"""Objects: (column, key) to value, the last write counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["column", "key"]


def latest(log: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The row of the highest `order` for each combination of keys. A task keeps one row of a key before the shuffle is sorted."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return log.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_objects(log: DataFrame, unique: bool = False) -> DataFrame:
    """The live objects of a log (column, key, value, seq); a log of unique keys is its own current state."""
    return log if unique else latest(log, KEY)


def get(view: DataFrame, column, key) -> DataFrame:
    """The object of a key: no rows or one. Equalities reach the scan."""
    return view.where((F.col("column") == F.lit(column)) & (F.col("key") == F.lit(key)))


def lookup(view: DataFrame, keys: DataFrame, on: list[str] = KEY, order: str = "pos") -> DataFrame:
    """keys with found and value, in their own order, repeated ones repeated. A miss has found = false; values can be empty but not null."""
    hit = view.select(*on, "value", F.lit(True).alias("found"))
    return keys.join(hit, on, "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy(order)


def missing_keys(view: DataFrame, keys: DataFrame, on: list[str] = KEY) -> DataFrame:
    return keys.join(view.select(*on), on, "left_anti")


def unique_violations(new: DataFrame, view: DataFrame | None = None) -> DataFrame:
    """column, key, n: keys that a batch of new ones has more than once, or that are live already."""
    n = new.groupBy(*KEY).agg(F.count("*").alias("n"))
    if view is None:
        return n.where("n > 1")
    return n.join(view.select(*KEY, F.lit(1).alias("live")), KEY, "left").select(*KEY, (F.col("n") + F.coalesce("live", F.lit(0))).alias("n")).where("n > 1")
