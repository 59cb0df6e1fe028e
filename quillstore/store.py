"""A store of keyed binary objects and rows: a write phase with atomic commits, then read-only readers of a pinned state."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import CorruptionError, InvalidArgumentError, NotFoundError, NotOpenError
from .operators import dump as dumps
from .operators import objects as obj
from .operators import rows as row
from .operators.stats import column_stats, stats_lines
from .options import StoreOptions, bucket_count
from .schema import MERGE, OBJECTS, ORDINAL_BITS, REPLACE, ROWS, STRING_COLUMN, row_bits, to_bytes, unsigned
from .sources.log import LEGACY, Log, Manifest, bucket_of
from .sources.migrate import migrated

Entries = Iterable[tuple[bytes, bytes]] | DataFrame
#: Keys of a lookup that go into the scan as literals; more are joined.
LITERAL_KEYS = 1000


class Store:
    """Open with `Store.open` or `Store.open_read_only`; after close(), data operations raise NotOpenError and counters are 0.

    Single writes from the driver are gathered and committed together, at the latest before the next read. Several handles can write to one
    folder, and several threads to one handle: a commit that loses a race takes its numbers anew on the newer manifest, so it comes after
    what won, and keys that it promised to be new are looked up there.
    """

    def __init__(self) -> None:
        self._open = False

    # phases

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: StoreOptions | None = None) -> Store:
        """Creates or opens for reading and writing; migrates an older format; rebuilds a missing snapshot from the log."""
        self = cls()
        self._start(spark, path, options or StoreOptions(), read_only=False)
        return self

    @classmethod
    def open_read_only(cls, spark: SparkSession, path: str, options: StoreOptions | None = None) -> Store:
        """Pins the newest committed state. Nothing is created, migrated or rebuilt."""
        self = cls()
        self._start(spark, path, options or StoreOptions(), read_only=True)
        return self

    def _start(self, spark: SparkSession, path: str, options: StoreOptions, read_only: bool) -> None:
        self.spark, self.options, self.read_only = spark, options, read_only
        self.log, self._lock = Log(spark, path), threading.RLock()
        if read_only:
            found = self.log.newest() if self.log.exists("") else None
            if found is None:
                raise InvalidArgumentError(f"there is no store at {path}")
            if found.version == LEGACY:
                raise InvalidArgumentError("the store has an older format; open it for writing once")
            self._manifest = found
            self._check(found)
        else:
            self.log.make()
            found = self.log.newest()
            if found is None and not self.log.commit(found := Manifest(buckets=options.log_buckets)):
                found = self.log.newest()
            self._manifest = found
            self._check(found, snapshot=False)
            if found.version == LEGACY:
                self._migrate()
            s = self._manifest.snapshot
            if s and not all(self.log.exists(f"{s[k]}/_SUCCESS") for k in ("objects", "rows")):
                self.rebuild(whole=True)
        self._objects: list[tuple] = []
        self._rows: list[tuple] = []
        self._batches = 0
        self._open = True

    def _check(self, m: Manifest, snapshot: bool = True) -> None:
        gone = self.log.lost(m)
        if snapshot and m.snapshot:
            gone += [m.snapshot[k] for k in ("objects", "rows") if not self.log.exists(f"{m.snapshot[k]}/_SUCCESS")]
        if gone:
            raise CorruptionError(f"committed data is missing: {', '.join(gone)}")

    def _migrate(self) -> None:
        old = self._manifest
        own = self.log.write("objects", migrated(self.log.read("legacy", old.segments), commit=0), old.buckets)
        self._manifest = Manifest(id=old.id, commit=1, buckets=old.buckets, segments=[own | {"unique": False, "first": 1, "last": 1}])
        if not self.log.commit(self._manifest):
            self._manifest = self.log.newest()

    def moved(self) -> Store:
        """A handle with all that this one has; this one is closed, and what it held back is not lost."""
        out = Store()
        out.__dict__.update(self.__dict__)
        self.__dict__ = {"_open": False}
        return out

    def close(self) -> None:
        """Commits what is pending; closing twice is fine."""
        if self._open:
            self.flush()
            self._open = False

    def flush(self) -> None:
        """Commits what is pending. Nothing to do when closed or read-only."""
        if self._open and not self.read_only:
            self._commit()

    @property
    def is_open(self) -> bool:
        return self._open

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _need_open(self) -> None:
        if not self._open:
            raise NotOpenError("the store is not open")

    def _need_writer(self) -> None:
        self._need_open()
        if self.read_only:
            raise InvalidArgumentError("the store is open for reading only")

    # commits

    def _publish(self, add: list[dict], batches: int, recheck: Callable[[Manifest], None] | None = None) -> None:
        """Makes written segments part of the store, as the next `batches` commits on the newest manifest."""
        while True:
            m = self.log.newest()
            if recheck:
                recheck(m)
            first, m.commit = m.commit + 1, m.commit + batches
            if self.log.commit(m, [s | {"first": first, "last": m.commit} for s in add]):
                self._manifest = m
                return

    def _commit(self) -> None:
        with self._lock:
            objects, rows, batches, self._objects, self._rows, self._batches = self._objects, self._rows, self._batches, [], [], 0
            buckets = self._manifest.buckets
            add = [self.log.write(kind, self.spark.createDataFrame(data, schema), buckets) | {"unique": False} for kind, data, schema in (("objects", objects, OBJECTS), ("rows", rows, ROWS)) if data]
            if add:
                self._publish(add, batches)

    def _take(self) -> int:
        n, self._batches = self._batches, self._batches + 1
        return n << ORDINAL_BITS

    def _held(self) -> None:
        if len(self._objects) + len(self._rows) >= self.options.buffer:
            self._commit()

    def _bulk(self, kind: str, df: DataFrame, unique: bool = False) -> None:
        """A DataFrame with `ordinal` (32 bits; it orders equal keys) as one commit, written by the executors; what is pending comes first."""
        names = {"objects": ["column", "key", "value"], "rows": ["column", "row_id", "key", "value"]}[kind]
        if "ordinal" not in df.columns:
            raise InvalidArgumentError("rows of a DataFrame have no order: give them an ordinal column")
        checked = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null"))).otherwise(F.col(c)).alias(c) for c in [*names, "ordinal"]]
        own = df.select(*checked, *(["kind"] if kind == "rows" else []))
        if kind == "rows":
            wide = F.col("row_id").cast("decimal(20,0)")
            bits = F.when((wide < 0) | (wide > F.expr("cast(18446744073709551615 as decimal(20,0))")), F.raise_error(F.lit("a row id is an unsigned 64-bit number"))).when(wide > F.lit((1 << 63) - 1), wide - F.expr("cast(18446744073709551616 as decimal(20,0))")).otherwise(wide)
            own = own.withColumn("row_id", bits.cast("long"))
        place = F.col("ordinal").cast("long")
        place = F.when((place < 0) | (place >= 1 << ORDINAL_BITS), F.raise_error(F.lit("an ordinal has 32 bits"))).otherwise(place)
        own = own.withColumns({c: F.col(c).cast("binary") for c in ("column", "key", "value")}).withColumn("seq", place)
        with self._lock:
            self._commit()
            seen = self._manifest.commit
            segment = self.log.write(kind, own, self._manifest.buckets) | {"unique": unique}

            def recheck(m: Manifest) -> None:
                if unique and (late := [s for s in m.segments if s["kind"] == "objects" and s["first"] > seen]):
                    new = self.log.read("objects", [segment | {"first": 0}]).select("column", "key")
                    if not obj.unique_violations(new, self.log.read("objects", late).select("column", "key").distinct()).isEmpty():
                        raise InvalidArgumentError("keys of a unique batch were written meanwhile")

            self._publish([segment], 1, recheck)

    # objects

    def put(self, key: str, value: str) -> None:
        self.put_structs(STRING_COLUMN, [(key, value)])

    def get(self, key: str) -> str:
        return self.get_struct(STRING_COLUMN, key).decode()

    def put_struct(self, column, key, value) -> None:
        self.put_structs(column, [(key, value)])

    def put_structs(self, column, entries: Entries) -> None:
        """Upserts a batch; of equal keys the last counts. An empty batch changes nothing."""
        self._need_writer()
        column = to_bytes(column, "column")
        if isinstance(entries, DataFrame):
            self._bulk("objects", entries.withColumn("column", F.lit(column)))
            return
        batch = [(to_bytes(k, "key"), to_bytes(v, "value")) for k, v in entries]
        if batch:
            with self._lock:
                seq = self._take()
                self._objects += [(column, k, v, seq + i) for i, (k, v) in enumerate(batch)]
                self._held()

    def put_objects(self, objects: DataFrame) -> None:
        """Many objects (column, key, value, ordinal) of any columns in one commit, written by the executors."""
        self._need_writer()
        self._bulk("objects", objects)

    def put_unique_structs(self, column, entries: Entries, validate: bool = False) -> None:
        """A batch of keys that are new. Unless validated, a key that isn't counts as an upsert. A validated batch is a commit of its own, and is looked up once more in what other writers have committed meanwhile."""
        self._need_writer()
        if not validate:
            self.put_structs(column, entries)
            return
        column = to_bytes(column, "column")
        if not isinstance(entries, DataFrame):
            entries = self.spark.createDataFrame([(to_bytes(k, "key"), to_bytes(v, "value"), i) for i, (k, v) in enumerate(entries)], "key binary, value binary, ordinal long")
        with self._lock:
            if not obj.unique_violations(entries.select(F.lit(column).alias("column"), F.col("key").cast("binary").alias("key")), self.objects()).isEmpty():
                raise InvalidArgumentError("keys of a unique batch are there already or repeat")
            self._bulk("objects", entries.withColumn("column", F.lit(column)), unique=True)

    def get_struct(self, column, key) -> bytes:
        self._need_open()
        column, key = to_bytes(column, "column"), to_bytes(key, "key")
        found = self.point_object(column, key).select("value").collect()
        if not found:
            raise NotFoundError("object not found")
        return bytes(found[0]["value"])

    def point_object(self, column: bytes, key: bytes) -> DataFrame:
        """The object of a key; its partition is a literal, so the scan lists one folder of each segment."""
        log = self._log("objects").where(F.col("bucket") == bucket_of("objects", self._manifest.buckets, column=column, key=key))
        return obj.latest_objects(obj.get(log, column, key))

    def get_many(self, column, keys: Iterable) -> list[bytes]:
        """The values of keys in their order, repeated ones repeated; NotFoundError if any is missing."""
        self._need_open()
        column, keys = to_bytes(column, "column"), [to_bytes(k, "key") for k in keys]
        if not keys:
            return []
        own = sorted(set(keys))
        log = self._log("objects").where(F.col("column") == F.lit(column))
        if len(own) <= LITERAL_KEYS:
            buckets = self.spark.createDataFrame([(column, k) for k in own], "column binary, key binary").select(bucket_of("objects", self._manifest.buckets).alias("b")).distinct().collect()
            log = log.where(F.col("bucket").isin([r["b"] for r in buckets]) & F.col("key").isin([F.lit(k) for k in own]))
        else:  # the keys came from the driver, so they fit there
            log = log.join(F.broadcast(self.spark.createDataFrame([(k,) for k in own], "key binary")), "key", "left_semi")
        found = {bytes(r["key"]): bytes(r["value"]) for r in obj.latest_objects(log.select("column", "key", "value", "seq")).select("key", "value").collect()}
        for k in keys:
            if k not in found:
                raise NotFoundError("object not found")
        return [found[k] for k in keys]

    def lookup(self, keys: DataFrame, order: str = "pos", on_missing: str = "null") -> DataFrame:
        """A DataFrame of (column, key, pos) with found and value; on_missing='raise' checks first that none is missing."""
        self._need_open()
        out = obj.lookup(self.objects(), keys, order=order)
        if on_missing == "raise" and not out.where(~F.col("found")).isEmpty():
            raise NotFoundError("object not found")
        return out

    # rows

    def _room(self, column: bytes, bits: int, replacing: bool) -> None:
        if self.options.limit_rows:
            known = self.rows().select("column", "row_id").distinct()
            if not replacing and not known.where((F.col("column") == F.lit(column)) & (F.col("row_id") == bits)).isEmpty():
                return
            self._fits(known.count() + 1)

    def _fits(self, rows: int) -> None:
        if rows / self.row_bucket_count > self.options.max_load_factor:
            raise InvalidArgumentError("the row index is full")

    def put_row_struct(self, column, row_id: int, key, value) -> None:
        """Merges one key into a row."""
        self._need_writer()
        column, key, value, bits = to_bytes(column, "column"), to_bytes(key, "key"), to_bytes(value, "value"), row_bits(row_id)
        with self._lock:
            self._room(column, bits, replacing=False)
            self._rows.append((column, bits, key, value, MERGE, self._take()))
            self._held()

    def put_row_structs(self, column, row_id: int, entries: Iterable[tuple]) -> None:
        """Replaces a row by a batch: keys that it lacks are gone, of equal keys the last counts. An empty batch is invalid."""
        self._need_writer()
        column, bits = to_bytes(column, "column"), row_bits(row_id)
        batch = [(to_bytes(k, "key"), to_bytes(v, "value")) for k, v in entries]
        if not batch:
            raise InvalidArgumentError("a row needs entries")
        with self._lock:
            self._room(column, bits, replacing=True)
            seq = self._take()
            self._rows += [(column, bits, k, v, REPLACE, seq + i) for i, (k, v) in enumerate(batch)]
            self._held()

    def put_rows(self, rows: DataFrame, kind: str = REPLACE) -> None:
        """Many rows (column, row_id, key, value, ordinal) in one commit, written by the executors."""
        self._need_writer()
        if kind not in (REPLACE, MERGE):
            raise InvalidArgumentError("kind is replace or merge")
        with self._lock:
            if self.options.limit_rows:
                own = rows.select(F.col("column").cast("binary").alias("column"), F.col("row_id").cast("decimal(20,0)").alias("row_id"))
                known = self.rows().select("column", unsigned(F.col("row_id")).alias("row_id"))
                self._fits(own.unionByName(known).distinct().count())
            self._bulk("rows", rows.withColumn("kind", F.lit(kind)))

    def _point(self, column: bytes, bits: int) -> DataFrame:
        return self._log("rows").where((F.col("bucket") == bucket_of("rows", self._manifest.buckets, column=column, row_id=bits)) & (F.col("column") == F.lit(column)) & (F.col("row_id") == bits))

    def point_row(self, column: bytes, bits: int) -> DataFrame:
        return row.live_row(self._point(column, bits))

    def row_keys(self, column: bytes, bits: int) -> DataFrame:
        """column, row_id, key, kind, seq of a row's live entries; their values aren't read."""
        return row.live_row(self._point(column, bits).drop("value", "bucket"))

    def get_row(self, column, row_id: int) -> dict[bytes, bytes]:
        self._need_open()
        found = self.point_row(to_bytes(column, "column"), row_bits(row_id)).select("key", "value").collect()
        if not found:
            raise NotFoundError("row not found")
        return {bytes(r["key"]): bytes(r["value"]) for r in sorted(found, key=lambda r: bytes(r["key"]))}

    def get_row_struct(self, column, row_id: int, key) -> bytes:
        """One value of a row. The row's keys are read first, without values; then the one entry that counts, by its key and number."""
        self._need_open()
        column, key, bits = to_bytes(column, "column"), to_bytes(key, "key"), row_bits(row_id)
        with self._lock:
            own = self.row_keys(column, bits).agg(F.count("*").alias("n"), F.max(F.when(F.col("key") == F.lit(key), F.col("seq"))).alias("seq")).first()
            if not own["n"]:
                raise NotFoundError("row not found")
            if own["seq"] is None:
                raise NotFoundError("key not found in row")
            return bytes(self.row_entry(column, bits, key, own["seq"]).first()["value"])

    def row_entry(self, column: bytes, bits: int, key: bytes, seq: int) -> DataFrame:
        return self._point(column, bits).where((F.col("key") == F.lit(key)) & (F.col("seq") == seq)).select("value")

    # state

    def _log(self, kind: str) -> DataFrame:
        """All mutations of a kind that the state needs: the snapshot and what came after it."""
        if not self.read_only:
            self._commit()
        return self._since(self._manifest, kind)

    def _since(self, m: Manifest, kind: str, whole: bool = False) -> DataFrame:
        s = None if whole else m.snapshot
        return self.log.read(kind, [x for x in m.segments if x["kind"] == kind and not (s and x["last"] <= s["commit"])], s and s[kind])

    def objects(self) -> DataFrame:
        """column, key, value, seq of the live objects."""
        self._need_open()
        log = self._log("objects")
        own = [x for x in self._manifest.segments if x["kind"] == "objects"]
        return obj.latest_objects(log.drop("bucket"), unique=bool(own) and all(x["unique"] for x in own))

    def rows(self) -> DataFrame:
        """column, row_id (signed bits), key, value, kind, seq of the live row entries."""
        self._need_open()
        return row.live_rows(self._log("rows").drop("bucket"))

    def rebuild(self, whole: bool = False) -> None:
        """Folds the last snapshot and what came after it, or the whole log, into a new snapshot, the index of this store. The log stays."""
        m, made = self._manifest, {"commit": self._manifest.commit}
        for kind in ("objects", "rows"):
            log = self._since(m, kind, whole).drop("bucket")
            live = obj.latest_objects(log) if kind == "objects" else row.live_rows(log)
            made[kind] = self.log.write(kind, live, m.buckets, f"snapshot/{m.commit}-{uuid.uuid4().hex}/{kind}")["path"]
        rows = self.log.read("rows", [], made["rows"]).select("column", "row_id").distinct().count()
        buckets = bucket_count(self.options.initial_row_buckets, self.options.max_load_factor, rows)
        while True:
            m = self.log.newest()
            if whole or not m.snapshot or m.snapshot["commit"] < made["commit"]:
                m.snapshot, m.row_buckets = made, max(m.row_buckets, buckets)
                if not self.log.commit(m, []):
                    continue
            self._manifest = m
            return

    def snapshot(self) -> None:
        self._need_writer()
        with self._lock:
            self._commit()
            self.rebuild()

    # diagnostics

    def column_stats(self) -> DataFrame:
        """column, object_count, row_count, by column bytewise."""
        self._need_open()
        return column_stats(self.objects(), self.rows())

    def dump_column_stats(self) -> DataFrame:
        self._need_open()
        title = self.spark.createDataFrame([("column statistics",)], "line string").select(F.lit(None).cast("binary").alias("column"), "line")
        return title.unionByName(stats_lines(self.column_stats())).orderBy(F.col("column").asc_nulls_first()).select("line")

    def dump(self, diagnostics: bool = False) -> DataFrame:
        self._need_open()
        titles = {"title": "store dump", "objects": f"object_index: entries={self.entry_count} buckets={self.bucket_count}", "rows": f"row_index: rows={self.row_count} buckets={self.row_bucket_count} shards={self.options.row_shards} next_sequence={self._manifest.commit + 1 + self._batches}"}
        return dumps.dump(self.objects(), self.rows(), titles, shards=self.options.row_shards, diagnostics=diagnostics)

    def dump_column(self, column, deserialize: Callable[[bytes, int | None, bytes, bytes], str] | None = None, diagnostics: bool = False) -> DataFrame:
        """The dump of one column; deserialize(column, row id or None, key, value) adds its text to each value, and its errors end the dump."""
        self._need_open()
        column = to_bytes(column, "column")
        shown = self.spark.range(1).select(dumps.escape_text(F.lit(column)).alias("x")).first()["x"]
        titles = {"title": f"column dump column={shown}", "objects": f"object_index: buckets={self.bucket_count}", "rows": f"row_index: buckets={self.row_bucket_count} shards={self.options.row_shards}"}
        return dumps.dump(self.objects(), self.rows(), titles, column, deserialize, self.options.row_shards, diagnostics)

    def lines(self, dumped: DataFrame) -> list[str]:
        """A dump's lines on the driver; a deserializer's failure raises InvalidArgumentError."""
        try:
            return [r["line"] for r in dumped.collect()]
        except PythonException as e:
            raise InvalidArgumentError(f"the deserializer failed: {str(e)[-500:]}") from None

    def write_lines(self, dumped: DataFrame, path: str) -> None:
        """A dump as text files, written by the executors; their names are in the order of the lines."""
        try:
            dumped.write.text(path)
        except PythonException as e:
            raise InvalidArgumentError(f"the deserializer failed: {str(e)[-500:]}") from None

    @property
    def entry_count(self) -> int:
        return self.objects().count() if self._open else 0

    @property
    def row_count(self) -> int:
        return self.rows().select("column", "row_id").distinct().count() if self._open else 0

    @property
    def bucket_count(self) -> int:
        if not self._open:
            return 0
        self.flush()
        log = self._since(self._manifest, "objects", whole=True)
        return bucket_count(self.options.initial_buckets, self.options.max_load_factor, batch_peak(log))

    @property
    def row_bucket_count(self) -> int:
        """By the options; more if a rebuilt index needed more."""
        return max(self.options.row_buckets, self._manifest.row_buckets) if self._open else 0


def batch_peak(log: DataFrame) -> int:
    """The largest number of live keys before a batch (commit) plus the batch's entries."""
    commit = F.shiftright("seq", ORDINAL_BITS)
    size = log.groupBy(commit.alias("commit")).agg(F.count("*").alias("n"))
    new = log.groupBy("column", "key").agg(F.min(commit).alias("commit")).groupBy("commit").agg(F.count("*").alias("new"))
    both = size.join(new, "commit", "left").select("commit", "n", F.coalesce("new", F.lit(0)).alias("new"))
    return both.select((F.expr("sum(new) over (order by commit) - new") + F.col("n")).alias("need")).agg(F.coalesce(F.max("need"), F.lit(0)).alias("need")).first()["need"]
