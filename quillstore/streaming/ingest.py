"""Ingestion from a stream: each micro-batch is one commit. An addition; the log itself knows no time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..store import Store


def put_batches(store: Store, column) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: upserts (key, value, ordinal). A batch that is run again writes the same values again."""

    def put(batch: DataFrame, _: int) -> None:
        store.put_structs(column, batch)

    return put
