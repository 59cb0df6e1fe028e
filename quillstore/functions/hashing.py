"""Unsigned 64-bit hashes as column expressions: ANSI arithmetic raises on overflow, so numbers are taken in halves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import byte_values

LOW = 0xFFFFFFFF
#: Basis and prime of FNV-1a, multipliers and shifts of the 64-bit finalizer, the rotation.
FNV_BASIS, FNV_PRIME = 14695981039346656037, 1099511628211
FINAL = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None))
ROTATE = 23


def signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def mul64(a: Column, n: int) -> Column:
    """a * n modulo 2 ** 64: halves of a against 16-bit limbs of n, so that no product or sum passes 2 ** 52."""
    limbs = [n >> 16 * k & 0xFFFF for k in range(4)]

    def total(parts: list[Column]) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    def times(v: Column) -> Column:
        low, high = v.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(v, 32)
        products = {(h, k): x * F.lit(limbs[k]) for h, x, most in ((0, low, 4), (1, high, 2)) for k in range(most) if limbs[k]}
        zero = F.lit(0).cast("long")
        below = total([products.get((0, 0), zero), *([F.shiftleft(products[0, 1].bitwiseAND(F.lit(0xFFFF)), 16)] if (0, 1) in products else [])])
        above = [F.shiftrightunsigned(below, 32)]
        above += [F.shiftrightunsigned(products[0, 1], 16)] if (0, 1) in products else []
        for whole, shifted in (((0, 2), (0, 3)), ((1, 0), (1, 1))):  # of these only the lowest 32 bits count
            above += [products[whole]] if whole in products else []
            above += [F.shiftleft(products[shifted].bitwiseAND(F.lit(0xFFFF)), 16)] if shifted in products else []
        return F.shiftleft(total(above).bitwiseAND(F.lit(LOW)), 32).bitwiseOR(below.bitwiseAND(F.lit(LOW)))

    return bind(a, times)


def fnv1a64(data: Column) -> Column:
    """FNV-1a of a binary, as signed bits."""
    return F.aggregate(byte_values(data), F.lit(signed(FNV_BASIS)), lambda h, v: mul64(h.bitwiseXOR(v.cast("long")), FNV_PRIME))


def fnv1a64_of(data: bytes) -> Column:
    """The same of known bytes, as a literal."""
    h = FNV_BASIS
    for x in data:
        h = (h ^ x) * FNV_PRIME % (1 << 64)
    return F.lit(signed(h))


def mix_hashes(a: Column, b: Column) -> Column:
    """One hash of two, as signed bits: the second is rotated, both are joined and finalized."""
    x = a.bitwiseXOR(F.shiftleft(b, ROTATE).bitwiseOR(F.shiftrightunsigned(b, 64 - ROTATE)))
    def folded(shift: int) -> Callable[[Column], Column]:
        return lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, shift))

    for shift, factor in FINAL:
        x = bind(x, folded(shift))
        x = mul64(x, factor) if factor else x
    return x


def object_index_hash(a: Column, b: Column) -> Column:
    return bind(mix_hashes(a, b), lambda x: F.when(x == 0, F.lit(1).cast("long")).otherwise(x))


def shard_for_row(column_hash: Column, row_bits: Column, shards: int) -> Column:
    """The mixed hash modulo shards, unsigned: its upper 63 bits and the lowest one by themselves."""
    return bind(mix_hashes(column_hash, row_bits), lambda x: ((F.shiftrightunsigned(x, 1) % shards * 2 + x.bitwiseAND(F.lit(1).cast("long"))) % shards).cast("int"))
