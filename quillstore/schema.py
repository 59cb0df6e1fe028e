"""The fixed schemas of the mutation log."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InvalidArgumentError

#: The column that plain string pairs are kept under.
STRING_COLUMN = b"__string_kv__"
REPLACE, MERGE = "replace", "merge"
#: seq = commit << 32 | ordinal: one number that orders all mutations.
ORDINAL_BITS = 32

OBJECTS = T.StructType([T.StructField("column", T.BinaryType(), False), T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType(), False), T.StructField("seq", T.LongType(), False)])
ROWS = T.StructType([T.StructField("column", T.BinaryType(), False), T.StructField("row_id", T.LongType(), False), T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType(), False), T.StructField("kind", T.StringType(), False), T.StructField("seq", T.LongType(), False)])


def to_bytes(x: bytes | bytearray | str, what: str) -> bytes:
    if isinstance(x, str):
        return x.encode()
    if not isinstance(x, (bytes, bytearray, memoryview)):
        raise InvalidArgumentError(f"{what} must be bytes or text")
    return bytes(x)


def row_bits(row_id: int) -> int:
    """An unsigned 64-bit row id as the signed number with the same bits."""
    if isinstance(row_id, bool) or not isinstance(row_id, (int, Decimal)) or not 0 <= row_id < 1 << 64:
        raise InvalidArgumentError("a row id is an unsigned 64-bit number")
    return int(row_id) - (1 << 64 if row_id >= 1 << 63 else 0)


def unsigned(bits: Column) -> Column:
    """Signed 64 bits as the unsigned number, DECIMAL(20,0)."""
    return F.when(bits < 0, bits.cast("decimal(20,0)") + F.expr("cast(18446744073709551616 as decimal(20,0))")).otherwise(bits.cast("decimal(20,0)")).cast("decimal(20,0)")
