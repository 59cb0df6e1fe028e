"""Write and read benchmarks of a store: objects in batches, or rows written by several handles at once, then reads of random keys.

    python -m quillstore.benchmark --mode object --sizes 0.01,0.1 --payload-size 4096 --read-count 100
"""

from __future__ import annotations

import argparse
import random
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .options import StoreOptions
from .store import Store

MARK = b"QUIL"
OBJECT, ROW_PARALLEL = "object", "row-parallel"


def sizes(text: str) -> list[float]:
    """Gigabytes, as a list with commas."""
    return [float(x) for x in text.split(",")]


def positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be greater than zero")
    return n


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("--dir", default=None, help="where the stores are made; by default in the shared scratch folder")
    p.add_argument("--sizes", type=sizes, default=[0.01], help="GB of payload of each run")
    p.add_argument("--mode", choices=[OBJECT, ROW_PARALLEL], default=OBJECT)
    p.add_argument("--payload-size", type=int, default=4096)
    p.add_argument("--object-batch-size", type=positive, default=10_000, help="objects of a commit")
    p.add_argument("--row-entries", type=positive, default=64)
    p.add_argument("--read-count", type=int, default=100)
    p.add_argument("--threads", type=positive, default=4, help="writers, for rows")
    p.add_argument("--shards", type=positive, default=8)
    p.add_argument("--keep", action="store_true", help="leave the stores")
    return p.parse_args(argv)


def payload(seed: F.Column, size: int) -> F.Column:
    """Bytes that look random, the same for the same seed, behind a mark; made by the executors."""
    if size <= 0:
        return F.lit(b"")
    blocks = F.transform(F.sequence(F.lit(0), F.lit((size - 1) // 64)), lambda k: F.sha2(F.concat_ws(" ", seed.cast("string"), k.cast("string")), 512))
    return F.substring(F.concat(F.lit(MARK), F.unhex(F.array_join(blocks, ""))), 1, size)


def percentiles(seconds: list[float], at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> dict[str, float]:
    """By nearest rank: the value at place min(n - 1, floor(n * p)) of the sorted ones."""
    own = sorted(seconds)
    return {f"p{round(100 * p)}": own[min(len(own) - 1, int(len(own) * p))] for p in at} if own else {}


def timed(f: Callable[[], object]) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def object_mode(spark: SparkSession, path: str, gb: float, o: argparse.Namespace) -> dict[str, float]:
    """Seconds of writing, of opening for reading, and of single reads of random keys; payload MB/s."""
    n = max(1, int(gb * 1e9) // max(1, o.payload_size))

    def batch(first: int) -> DataFrame:
        ids = spark.range(first, min(n, first + o.object_batch_size))
        return ids.select(F.concat(F.lit("object-"), F.col("id").cast("string")).alias("key"), payload(F.col("id"), o.payload_size).alias("value"), (F.col("id") - first).alias("ordinal"))

    out = {"gb": gb, "objects": n}
    with Store.open(spark, path, StoreOptions(row_shards=o.shards)) as s:
        out["write_s"] = timed(lambda: [s.put_structs("Payload", batch(i)) for i in range(0, n, o.object_batch_size)])
        out["snapshot_s"] = timed(s.snapshot)
    out["mb_per_s"] = n * o.payload_size / 1e6 / out["write_s"]
    stores: list[Store] = []
    out["open_s"] = timed(lambda: stores.append(Store.open_read_only(spark, path)))
    rng = random.Random(42)
    keys = [f"object-{rng.randrange(n)}" for _ in range(o.read_count)]
    out |= {f"read_{k}_s": v for k, v in percentiles([timed(lambda k=k: stores[0].get_struct("Payload", k)) for k in keys]).items()}
    out["read_many_s"] = timed(lambda: stores[0].get_many("Payload", keys))
    return out


def row_parallel_mode(spark: SparkSession, path: str, gb: float, o: argparse.Namespace) -> dict[str, float]:
    """The same of rows: o.threads handles replace rows of their own at the same time."""
    n = max(1, int(gb * 1e9) // max(1, o.payload_size * o.row_entries))
    Store.open(spark, path, StoreOptions(row_shards=o.shards)).close()
    failed: list[Exception] = []

    def write(part: int) -> None:
        ids = spark.range(n).where(F.col("id") % o.threads == part).select(F.col("id").alias("row_id"), F.explode(F.sequence(F.lit(0), F.lit(o.row_entries - 1))).alias("k"))
        rows = ids.select(F.lit(b"Payload").alias("column"), "row_id", F.concat(F.lit("entry-"), F.col("k").cast("string")).alias("key"), payload(F.col("row_id") * o.row_entries + F.col("k"), o.payload_size).alias("value"), F.col("k").alias("ordinal"))
        try:
            with Store.open(spark, path) as s:
                s.put_rows(rows)
        except Exception as e:  # shown by the caller
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(o.threads)]
    out = {"gb": gb, "rows": n, "write_s": timed(lambda: ([t.start() for t in threads], [t.join() for t in threads]))}
    if failed:
        raise failed[0]
    out["mb_per_s"] = n * o.row_entries * o.payload_size / 1e6 / out["write_s"]
    s, rng = Store.open_read_only(spark, path), random.Random(42)
    picked = [(rng.randrange(n), f"entry-{rng.randrange(o.row_entries)}") for _ in range(o.read_count)]
    out |= {f"read_{k}_s": v for k, v in percentiles([timed(lambda r=r: s.get_row_struct("Payload", *r)) for r in picked]).items()}
    return out


MODES = {OBJECT: object_mode, ROW_PARALLEL: row_parallel_mode}


def run(spark: SparkSession, o: argparse.Namespace) -> list[dict[str, float]]:
    from .sources.log import Log
    from .sources.scratch import scratch

    out = []
    for i, gb in enumerate(o.sizes):
        path = f"{o.dir.rstrip('/')}/{o.mode}-{i}" if o.dir else scratch(spark)
        try:
            out.append({k: round(v, 4) for k, v in MODES[o.mode](spark, path, gb, o).items()})
        finally:
            if not o.keep:
                log = Log(spark, path)
                log.call(log.fs.delete, log.at(""), True)
    return out


if __name__ == "__main__":
    import json

    print(json.dumps(run(SparkSession.builder.getOrCreate(), arguments())))
