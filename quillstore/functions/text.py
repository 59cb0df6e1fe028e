"""How bytes are shown in dumps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_values(data: Column) -> Column:
    """array<int> of a binary's bytes."""
    return F.when(F.length(data) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int")))


def escape_text(data: Column) -> Column:
    """In quotes: printable ASCII as it is, backslash, quote, line end, return and tab with a backslash, other bytes as \\xhh."""

    def shown(v: Column) -> Column:
        return (
            F.when(v == 92, "\\\\")
            .when(v == 34, '\\"')
            .when(v == 10, "\\n")
            .when(v == 13, "\\r")
            .when(v == 9, "\\t")
            .when(v.between(0x20, 0x7E), F.char(v))
            .otherwise(F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(v), 2, "0"))))
        )

    return F.concat(F.lit('"'), F.array_join(F.transform(byte_values(data), shown), ""), F.lit('"'))


def hex_bytes(data: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(data)))
