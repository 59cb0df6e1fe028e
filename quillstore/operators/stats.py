"""Counts by column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_text


def column_stats(objects: DataFrame, rows: DataFrame) -> DataFrame:
    """column, object_count (live objects and row entries), row_count (live rows), by column bytewise. Counts by row come before those by column."""
    one = objects.groupBy("column").agg(F.count("*").alias("o"), F.lit(0).cast("long").alias("r"))
    by_row = rows.groupBy("column", "row_id").agg(F.count("*").alias("n"))
    two = by_row.groupBy("column").agg(F.sum("n").alias("o"), F.count("*").alias("r"))
    return one.unionByName(two).groupBy("column").agg(F.sum("o").alias("object_count"), F.sum("r").alias("row_count")).orderBy("column")


def stats_lines(stats: DataFrame, indent: str = "") -> DataFrame:
    return stats.select(F.col("column"), F.concat(F.lit(indent + "column="), escape_text(F.col("column")), F.lit(" objects="), F.col("object_count").cast("string"), F.lit(" rows="), F.col("row_count").cast("string")).alias("line"))
