"""From the older log format, whose records also carried a sequence number and hashes, to the present one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ORDINAL_BITS


def migrated(legacy: DataFrame, commit: int = 1) -> DataFrame:
    """column, key, value, seq: records keep the order of their positions; the old sequence numbers and hashes are dropped."""
    return legacy.select("column", "key", "value", (F.lit(commit << ORDINAL_BITS) + F.col("position")).alias("seq"))


def write_legacy(log, records: list[tuple[bytes, bytes, bytes]] | DataFrame) -> None:
    """A store of the older format, for tests and for exports, from a list or from a DataFrame of column, key, value, position."""
    from .log import LEGACY_OBJECTS, Manifest

    if isinstance(records, DataFrame):
        zero = F.lit(0).cast("long")
        df = records.select("column", "key", "value", (F.col("position") + 1).alias("sequence"), zero.alias("column_hash"), zero.alias("key_hash"), "position")
    else:
        df = log.spark.createDataFrame([(c, k, v, i + 1, 0, 0, i) for i, (c, k, v) in enumerate(records)], LEGACY_OBJECTS)
    log.make()
    written = log.write("legacy", df, 16, f"legacy/{uuid.uuid4().hex}")
    log.commit(Manifest(version=1, segments=[{"kind": "legacy", "path": written["path"], "unique": False}]))
