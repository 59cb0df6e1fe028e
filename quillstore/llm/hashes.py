"""Hashes of words and of their windows, and compact exchange of many of them between tasks.

Rows of two or three numbers cost Spark several times their size on the way. Here a task sorts what it has gathered, packs the part for
each bucket into one binary value, and the task that gets the bucket unpacks arrays. A packed value has PER_ROW entries on average, or
HELD / FAN of them at least where buckets are many: a task gathers the more, the more buckets there are, and beyond FAN buckets entries are
dealt in several rounds, to ranges of buckets first. So rows, and the bytes around them, grow as the entries do. A round sends all
entries once more, so FAN is as large as values stay long enough to pack well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import trimmed

#: Entries of a packed value, on average.
PER_ROW = 8192
#: Buckets that a round deals to.
FAN = 1024
#: Entries that a task gathers at most.
HELD = 1 << 21
#: Entries of all tasks for each task that receives.
PER_TASK = 2_000_000
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
SENT = "bucket int, payload binary"

_powers: dict[int, np.ndarray] = {}


def powers(which: int, n: int) -> np.ndarray:
    """Powers of a multiplier and of its inverse modulo 2 ** 64, at least n of each."""
    found = _powers.get(which)
    if found is None or found.shape[1] < n:
        p = int(MULTIPLIERS[which])
        size = max(1024, 1 << (n - 1).bit_length())
        out = np.ones((2, size), np.uint64)
        for row, x in enumerate((p, pow(p, -1, 1 << 64))):
            have = 1
            while have < size:  # doubling
                out[row, have : 2 * have] = out[row, :have] * np.uint64(pow(x, have, 1 << 64))
                have *= 2
        found = _powers[which] = out
    return found


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)


def window_hashes(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every n consecutive words, in constant time for each: differences of running sums."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    up, down = powers(which, len(h))[:, : len(h)]
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum((mixed(h ^ MULTIPLIERS[1]) if which else h) * up, out=total[1:])
    return mixed((total[n:] - total[:-n]) * down[: len(h) - n + 1])


def digest(a: np.ndarray) -> tuple[int, int]:
    """128 bits of an array, as two signed numbers."""
    d = xxhash.xxh3_128_digest(a.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays in one value; bytes of equal weight stand together, so the equal high ones of sorted numbers vanish."""
    out = [len(arrays).to_bytes(4, "little")]
    squeeze = zstandard.ZstdCompressor(level=1)
    for a in arrays:
        data = squeeze.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()) if len(a) else b""
        out += [a.dtype.str.encode().ljust(4), len(a).to_bytes(8, "little"), len(data).to_bytes(8, "little"), data]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    at, out, stretch = 4, [], zstandard.ZstdDecompressor()
    for _ in range(int.from_bytes(data[:4], "little")):
        kind, n, size = np.dtype(data[at : at + 4].decode().strip()), int.from_bytes(data[at + 4 : at + 12], "little"), int.from_bytes(data[at + 12 : at + 20], "little")
        at += 20
        if n:
            raw = np.frombuffer(stretch.decompress(data[at : at + size]), np.uint8).reshape(kind.itemsize, n)
            out.append(np.ascontiguousarray(raw.T).reshape(-1).view(kind))
        else:
            out.append(np.empty(0, kind))
        at += size
    return out


def first_of_runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Indices where a new combination begins."""
    n = len(sorted_columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for c in sorted_columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


@dataclass
class Entries:
    """Sorted keys, each with its owner (a place in the owners' columns) and columns of its own. Without owners, owner is empty."""

    keys: np.ndarray
    owner: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint16))
    columns: list[np.ndarray] = field(default_factory=list)
    owners: list[np.ndarray] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.keys)

    def take(self, which) -> Entries:
        return Entries(self.keys[which], self.owner[which] if self.owners else self.owner, [c[which] for c in self.columns], self.owners)

    def of(self, k: int) -> np.ndarray:
        """A column of the owners, for each entry."""
        return self.owners[k][self.owner]

    def packed(self, kind: int) -> bytes:
        own, inverse = np.unique(self.owner, return_inverse=True)
        shape = np.array([kind, len(self.columns), len(self.owners)], np.uint8)
        return packed([shape, self.keys, small(inverse), *self.columns, *(o[own] for o in self.owners)])

    @staticmethod
    def unpacked(data: bytes) -> tuple[int, Entries]:
        (kind, columns, _), keys, owner, *rest = unpacked(data)
        return int(kind), Entries(keys, owner, rest[:columns], rest[columns:])

    @staticmethod
    def merged(parts: list[Entries]) -> Entries:
        """All entries of several, sorted."""
        first = np.cumsum([0, *(len(p.owners[0]) if p.owners else 0 for p in parts)])
        keys = np.concatenate([p.keys for p in parts])
        order = np.argsort(keys, kind="stable")
        owner = np.concatenate([p.owner.astype(np.int64) + n for p, n in zip(parts, first[:-1], strict=True)])
        columns, owners = ([np.concatenate(c) for c in zip(*x, strict=True)] for x in ([p.columns for p in parts], [p.owners for p in parts]))
        return Entries(keys[order], owner[order] if owners else owner, [c[order] for c in columns], owners)


def small(a: np.ndarray) -> np.ndarray:
    """In as few bytes as the largest number, but at least two."""
    return a.astype(np.uint16 if not len(a) or a.max() < 1 << 16 else np.uint32 if a.max() < 1 << 32 else np.uint64)


def sorted_entries(keys: np.ndarray, owner: np.ndarray, columns: list[np.ndarray], owners: list[np.ndarray]) -> Entries:
    order = np.argsort(keys, kind="stable")
    return Entries(keys[order], owner[order] if owners else owner, [c[order] for c in columns], owners)


#: By kind, what a task has gathered or got.
Gathered = dict[int, Entries]
#: Entries of this kind are on their way to no bucket in particular.
ANSWERS = 255


@dataclass(frozen=True)
class Deal:
    """How entries come to buckets: ranges of keys of so many bits. `reduce` leaves out what a task needn't send."""

    buckets: int
    bits: int = 64
    reduce: Callable[[Gathered], Gathered] | None = None
    fan: int = field(default_factory=lambda: FAN)
    per_row: int = field(default_factory=lambda: PER_ROW)

    @property
    def flush(self) -> int:
        """Entries that a task gathers before it sends them."""
        return min(self.per_row * min(self.buckets, self.fan), HELD)

    @property
    def widths(self) -> list[int]:
        """Buckets of the ranges of each round; 1 in the last."""
        out = [1]
        while self.buckets > out[0] * self.fan:
            out.insert(0, out[0] * self.fan)
        return [-(-self.buckets // self.fan ** (i + 1)) if i + 1 < len(out) else 1 for i in range(len(out))]

    def rows(self, gathered: Gathered, width: int | None = None) -> pa.RecordBatch:
        """Packed values by range of buckets; empty ranges have none."""
        width = self.widths[0] if width is None else width
        out = []
        for kind, e in (self.reduce(gathered) if self.reduce else gathered).items():
            if not len(e):
                continue
            if kind == ANSWERS:
                out.append((int(e.keys[0] % np.uint64(self.buckets)) // width, e.packed(kind)))
                continue
            low, high = (int(e.keys[i]) * self.buckets >> self.bits for i in (0, -1))
            low, high = low // width, high // width
            starts = [-(-(i * width << self.bits) // self.buckets) for i in range(low + 1, high + 1)]
            edges = np.concatenate(([0], np.searchsorted(e.keys, np.array(starts, np.uint64)), [len(e)]))
            out += [(low + int(i), e.take(slice(edges[i], edges[i + 1])).packed(kind)) for i in np.flatnonzero(np.diff(edges))]
        return sent(out)

    def exchanged(self, df: DataFrame) -> DataFrame:
        """Rows of packed values, each with the others of its bucket. Rounds before the last only deal anew, so any task can do any row of a range."""
        widths = self.widths
        for at, below in zip(widths, widths[1:]):
            tasks = -(-self.buckets // at) * at
            place = F.col("bucket") * at + F.pmod(F.xxhash64("payload"), F.lit(at)).cast("int")
            df = df.withColumn("place", place).repartitionById(tasks, "place").select("bucket", "payload").mapInArrow(trimmed(self.again(below)), SENT)
        return df.repartitionById(self.buckets, "bucket")

    def again(self, width: int) -> Callable:
        """A mapInArrow function that deals what it gets to smaller ranges."""

        def run(batches):
            held: dict[int, list[Entries]] = {}
            size = 0
            for batch in batches:
                for data in batch.column("payload"):
                    kind, e = Entries.unpacked(data.as_buffer().to_pybytes())
                    held.setdefault(kind, []).append(e)
                    size += len(e)
                    if size >= self.flush:
                        yield self.rows({k: Entries.merged(v) for k, v in held.items()}, width)
                        held, size = {}, 0
            if held:
                yield self.rows({k: Entries.merged(v) for k, v in held.items()}, width)

        return run


def sent(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "payload"])


def received(batches: Iterator[pa.RecordBatch]) -> dict[int, list[Entries]]:
    """A task's entries by kind."""
    out: dict[int, list[Entries]] = {}
    for batch in batches:
        for data in batch.column("payload"):
            kind, e = Entries.unpacked(data.as_buffer().to_pybytes())
            out.setdefault(kind, []).append(e)
    return out


def gathered(items: Iterator[tuple], flush: int, made: Callable[[list], Gathered]) -> Iterator[Gathered]:
    """made() of as many items as have `flush` entries together. An item's last field has its entries."""
    held, size = [], 0
    for item in items:
        held.append(item)
        size += len(item[-1])
        if size >= flush:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)
