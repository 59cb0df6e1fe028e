"""Sizes and offsets that the diagnostic dump shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of file, record and block headers and of a key bucket.
FILE_HEADER, RECORD_HEADER, BLOCK_HEADER, KEY_BUCKET = 24, 24, 72, 48
#: Numbers of seq whose records one task sums.
CHUNK = 1 << 16


def record_size(column: Column, key: Column, value: Column) -> Column:
    return F.lit(RECORD_HEADER) + F.octet_length(column) + F.octet_length(key) + F.octet_length(value)


def record_offsets(log: DataFrame, segment: str | None = None) -> DataFrame:
    """Adds record_size, record_offset and value_offset, in the order of seq.

    Offsets depend on all that was written before. Sums by segment (seq >> 32 unless named) come first, so only one number for each
    segment is ever in one task, then sums by CHUNK numbers of seq in a segment, and the records of a chunk last: no task has a segment.
    """
    sized = log.withColumn("record_size", record_size(F.col("column"), F.col("key"), F.col("value")).cast("long")).withColumns({"segment": F.col(segment) if segment else F.shiftright("seq", 32), "chunk": F.expr(f"seq div {CHUNK}")})
    chunks = sized.groupBy("segment", "chunk").agg(F.sum("record_size").alias("bytes"))
    sums = chunks.groupBy("segment").agg(F.sum("bytes").alias("all"))
    before = sums.select("segment", (F.sum("all").over(Window.orderBy("segment")) - F.col("all")).alias("before"))
    upto = chunks.select("segment", "chunk", (F.sum("bytes").over(Window.partitionBy("segment").orderBy("chunk")) - F.col("bytes")).alias("upto")).join(before, "segment")
    inside = F.sum("record_size").over(Window.partitionBy("segment", "chunk").orderBy("seq")) - F.col("record_size")
    placed = sized.withColumn("inside", inside).join(upto, ["segment", "chunk"]).withColumn("record_offset", F.lit(FILE_HEADER) + F.col("before") + F.col("upto") + F.col("inside"))
    return placed.withColumn("value_offset", F.col("record_offset") + RECORD_HEADER + F.octet_length("column") + F.octet_length("key")).drop("segment", "chunk", "inside", "before", "upto")


def power_of_two(n: Column) -> Column:
    """The smallest power of two that is at least n and 16, by comparing whole numbers."""
    found = F.lit(None).cast("long")
    for k in range(40, 3, -1):
        found = F.when(n <= F.lit(1 << k), F.lit(1 << k)).otherwise(found)
    return found


def key_buckets(entries: Column, load_factor: float) -> Column:
    """Key buckets of a row block by the entries given, duplicates included."""
    return power_of_two((F.floor(entries / F.lit(load_factor)) + 1).cast("long"))


def block_size(column: Column, entries: Column, key_bytes: Column, value_bytes: Column, load_factor: float) -> Column:
    """Bytes of a row block: the header, its key buckets, the column, distinct keys and the values chosen."""
    return F.lit(BLOCK_HEADER) + F.lit(KEY_BUCKET) * key_buckets(entries, load_factor) + F.octet_length(column) + key_bytes + value_bytes
