"""What several operators share: input columns, words, white space, bounded caches, scratch tables."""

from __future__ import annotations

import ctypes
import re
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import drop_scratch, scratch

#: The characters of Unicode's White_Space property.
WHITE = "\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space and the run of other characters after it. What a tokenizer of words does never crosses the end of such a match.
SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: The end of a run of other characters, before white space.
EDGE = re.compile(f"[^{WHITE}](?=[{WHITE}])")
#: Runs without white space.
RUN = re.compile(f"[^{WHITE}]+")

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that most operators read, so that the scan reads no others and no name can clash."""
    bounded(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from now on, unless the session has fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def words(text: str | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` as UTF-8; none for null. bytes.split() parts at exactly these six bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Memo(dict):
    """A cache of at most two generations of `limit` entries; only speed depends on what it holds.

    `memo[key]` computes what is missing. A full generation becomes the old one, and entries that are used again move on.
    Keys longer than `longest` are computed each time.
    """

    def __init__(self, compute: Callable, limit: int = 300_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


#: Seconds after a task in which a worker without a new one still has its caches.
IDLE_S = 2.0
#: Rows of an Arrow batch at most: texts are long, and a worker, the JVM and the pipe between hold a batch each.
BATCH_ROWS = 1000

_lock = threading.RLock()
_caches: dict[str, dict] = {}
_idle: threading.Timer | None = None


def at_hand(kind: str, key, make: Callable):
    """make(key), kept in this process for tasks of the same kind."""
    with _lock:
        own = _caches.setdefault(kind, {})
        if key not in own:
            own[key] = make(key)
        return own[key]


def forget(but: str | None = None) -> None:
    """Drops the caches of other kinds and hands freed memory back to the system."""
    with _lock:
        gone = [k for k in _caches if k != but]
        for k in gone:
            del _caches[k]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def begin(keeps: str | None) -> None:
    """A task begins in this worker."""
    global _idle
    with _lock:
        if _idle:
            _idle.cancel()
        _idle = None
    forget(keeps)


def end(keeps: str | None) -> None:
    """A task has ended; if none follows soon, all caches go."""
    global _idle
    forget(keeps)
    with _lock:
        _idle = threading.Timer(IDLE_S, forget)
        _idle.daemon = True
        _idle.start()


def trimmed(run: Callable, keeps: str | None = None) -> Callable:
    """A mapInArrow function for workers that live through many operators: a task drops the caches of other kinds than `keeps`, an idle worker drops all.

    Without that each operator of a long job would leave its own in every worker.
    """

    def whole(batches):
        begin(keeps)
        try:
            yield from run(batches)
        finally:
            end(keeps)

    return whole


def slices(text: str, size: int) -> Iterator[str]:
    """A text in parts of about `size` characters that no pre-token crosses: cut where white space follows another character."""
    at = 0
    while len(text) - at > size and (edge := EDGE.search(text, at + size)):
        yield text[at : edge.end()]
        at = edge.end()
    yield text[at:]


def per_text(schema: str, rows: Callable[[str | None], tuple], names: list[str], keeps: str | None = None) -> Callable:
    """A mapInArrow function that keeps doc_id and adds what `rows` makes of each text."""
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [rows(x) for x in batch.column("text").to_pylist()]
            columns = list(zip(*made, strict=True)) if made else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, arrow.field(n).type) for c, n in zip(columns, names, strict=True))], schema=arrow)

    return trimmed(run, keeps)


def kept(df: DataFrame) -> DataFrame:
    """Writes df once to a table in the shared folder and reads it from there: lineage ends, lost executors cost nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of at most so many bytes on disk are broadcast.
SMALL = 16 << 20


def attached(docs: DataFrame, table: DataFrame, on: str, how: str = "left") -> DataFrame:
    """docs joined with a table that kept() wrote. The table's size is looked up: a small one is broadcast, so texts stay where they are; else both are dealt by key."""
    spark = docs.sparkSession
    files = table.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
        size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    else:
        size = 0
    return docs.join(F.broadcast(table) if size <= SMALL else table, on, how)


def spread(spark: SparkSession, rows: int, per_task: int) -> int:
    """A number of partitions by the amount of data, never under the session's own."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


__all__ = ["DOCUMENT_COLUMNS", "F", "Memo", "RUN", "SEGMENT", "at_hand", "attached", "bounded", "drop_scratch", "fresh", "kept", "per_text", "scratch", "slices", "spread", "texts", "trimmed", "words"]
