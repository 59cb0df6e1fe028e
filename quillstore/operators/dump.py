"""The current state as lines of text: objects, rows with their entries, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a64, object_index_hash, shard_for_row
from ..functions.text import escape_text, hex_bytes
from ..schema import unsigned
from .stats import column_stats, stats_lines

VALUE = "struct<column: binary, row_id: decimal(20,0), key: binary, value: binary>"


def text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def decoded(entries: DataFrame, deserialize: Callable | None, row_id: Column) -> tuple[DataFrame, list]:
    """entries with the text that the caller's function makes of (column, row_id or None, key, value), and how a line shows it; nothing without one."""
    if deserialize is None:
        return entries, []
    call = F.udf(lambda v: deserialize(bytes(v["column"]), None if v["row_id"] is None else int(v["row_id"]), bytes(v["key"]), bytes(v["value"])), "string")
    return entries.withColumn("_text", call(F.struct("column", row_id.alias("row_id"), "key", "value"))), [" deserialized=", escape_text(F.col("_text").cast("binary"))]


def object_lines(objects: DataFrame, deserialize: Callable | None = None, diagnostics: bool = False) -> DataFrame:
    """column, key, line of each live object; diagnostics adds hashes."""
    hashes: list = []
    if diagnostics:
        c, k = fnv1a64(F.col("column")), fnv1a64(F.col("key"))
        hashes = [" column_hash=", unsigned(c), " key_hash=", unsigned(k), " index_hash=", unsigned(object_index_hash(c, k))]
    objects, more = decoded(objects, deserialize, F.lit(None).cast("decimal(20,0)"))
    return objects.select("column", "key", text("  object column=", escape_text(F.col("column")), " key=", escape_text(F.col("key")), *hashes, " value_size=", F.length("value"), " value_hex=", hex_bytes(F.col("value")), *more).alias("line"))


def row_lines(rows: DataFrame, deserialize: Callable | None = None, shards: int = 8, diagnostics: bool = False) -> DataFrame:
    """column, row_id (unsigned), key (null for the row's own line), line."""
    more: list = []
    if diagnostics:
        c = fnv1a64(F.col("column"))
        more = [" column_hash=", unsigned(c), " shard=", shard_for_row(c, F.col("row_id"), shards)]
    heads = rows.groupBy("column", "row_id").agg(F.count("*").alias("n")).select(
        "column", unsigned(F.col("row_id")).alias("row_id"), F.lit(None).cast("binary").alias("key"), text("  row column=", escape_text(F.col("column")), " row_id=", unsigned(F.col("row_id")), *more, " object_count=", F.col("n")).alias("line")
    )
    rows, last = decoded(rows, deserialize, unsigned(F.col("row_id")))
    entries = rows.select("column", unsigned(F.col("row_id")).alias("row_id"), "key", text("    key=", escape_text(F.col("key")), " value_size=", F.length("value"), " value_hex=", hex_bytes(F.col("value")), *last).alias("line"))
    return heads.unionByName(entries)


def dump(objects: DataFrame, rows: DataFrame, titles: dict[str, str], column: bytes | None = None, deserialize: Callable | None = None, shards: int = 8, diagnostics: bool = False) -> DataFrame:
    """One column, line, in order: title, objects, rows, statistics. The column filter stands before all three, so scans read only that."""
    spark = objects.sparkSession
    if column is not None:
        objects, rows = (x.where(F.col("column") == F.lit(column)) for x in (objects, rows))
    blank = {"column": F.lit(None).cast("binary"), "row_id": F.lit(None).cast("decimal(20,0)"), "key": F.lit(None).cast("binary")}
    heads = spark.createDataFrame([(0, titles["title"]), (0, titles["objects"]), (0, "objects:"), (2, titles["rows"]), (2, "rows:"), (4, "column_statistics:")], "section int, line string").withColumn("place", F.monotonically_increasing_id()).withColumns(blank)

    def part(df: DataFrame, section: int) -> DataFrame:
        return df.withColumns({k: v for k, v in blank.items() if k not in df.columns}).withColumns({"section": F.lit(section), "place": F.lit(0).cast("long")})

    every = heads.unionByName(part(object_lines(objects, deserialize, diagnostics), 1)).unionByName(part(row_lines(rows, deserialize, shards, diagnostics), 3)).unionByName(part(stats_lines(column_stats(objects, rows), "  "), 5))
    return every.orderBy("section", "place", "column", "row_id", F.col("key").asc_nulls_first()).select("line")


__all__ = ["decoded", "dump", "object_lines", "row_lines", "text"]
