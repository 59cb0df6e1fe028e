"""Options of a store."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import InvalidArgumentError


def round_up_power_of_two(n: int) -> int:
    """The smallest power of two that is at least n and at least 16."""
    return max(16, 1 << (max(1, int(n)) - 1).bit_length())


@dataclass(frozen=True)
class StoreOptions:
    initial_buckets: int = 65536
    initial_row_buckets: int = 65536
    row_shards: int = 8
    max_load_factor: float = 0.80
    #: Partitions of a segment's files; a point read touches one.
    log_buckets: int = 16
    #: Enforce the bound on rows that row_buckets and the load factor give.
    limit_rows: bool = False
    #: Mutations from the driver are held back until so many are pending.
    buffer: int = 10_000

    def __post_init__(self):
        if not 0 < self.max_load_factor < 0.95:
            raise InvalidArgumentError("max_load_factor must be above 0 and below 0.95")
        if self.row_shards < 1 or self.log_buckets < 1 or self.buffer < 1:
            raise InvalidArgumentError("row_shards, log_buckets and buffer must be at least 1")

    @property
    def row_buckets(self) -> int:
        return round_up_power_of_two(self.initial_row_buckets)


def bucket_count(initial: int, load_factor: float, peak: int) -> int:
    """Buckets of an index that doubles until `peak` (entries before a batch plus all of the batch) fits the load factor."""
    n = round_up_power_of_two(initial)
    while peak / n > load_factor:
        n *= 2
    return n
