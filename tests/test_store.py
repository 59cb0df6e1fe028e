"""The store's contract: writes, reads, phases, errors."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from quillstore.errors import CorruptionError, InvalidArgumentError, NotFoundError, NotOpenError
from quillstore.functions.hashing import fnv1a64
from quillstore.functions.text import escape_text, hex_bytes
from quillstore.operators import rows as row_ops
from quillstore.options import StoreOptions, bucket_count, round_up_power_of_two
from quillstore.schema import unsigned
from quillstore.sources.log import Log, Manifest
from quillstore.sources.migrate import write_legacy
from quillstore.store import Store

SMALL = StoreOptions(initial_buckets=4, max_load_factor=0.5, log_buckets=2)


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/store"


def test_strings_overwrite_and_reopen(spark, path):
    with Store.open(spark, path, SMALL) as s:
        s.put("alpha", "one")
        s.put("beta", "two")
        s.put("alpha", "updated")
        assert s.get("alpha") == "updated" and s.entry_count == 2
        with pytest.raises(NotFoundError, match="object not found"):
            s.get("missing")
    assert not s.is_open and s.entry_count == s.row_count == s.bucket_count == s.row_bucket_count == 0
    s.close()
    s.flush()
    with Store.open_read_only(spark, path) as s:
        assert (s.get("alpha"), s.get("beta")) == ("updated", "two")


def test_not_open(spark, path):
    s = Store()
    for f in (lambda: s.get("a"), lambda: s.put("a", "b"), lambda: s.column_stats(), lambda: s.dump(), lambda: s.get_many("c", []), lambda: s.put_row_structs("c", 1, [])):
        with pytest.raises(NotOpenError):
            f()


def test_columns_batches_and_multi_get(spark, path):
    with Store.open(spark, path, SMALL) as s:
        s.put_struct("StructA", "a-1", b"bytes-a1")
        s.put_struct("StructA", "a-2", b"bytes-a2")
        s.put_struct("StructB", "a-1", b"bytes-b1")
        s.put_structs("StructA", [("a-1", b"x"), ("a-1", b"bytes-a1-new")])
        s.put_structs("StructA", [])
        assert s.get_struct("StructB", "a-1") == b"bytes-b1"
        assert s.get_many("StructA", ["a-2", "a-1", "a-2"]) == [b"bytes-a2", b"bytes-a1-new", b"bytes-a2"]
        assert s.get_many("StructA", []) == [] and s.entry_count == 3 and s.bucket_count == 16
        with pytest.raises(NotFoundError):
            s.get_many("StructA", ["a-1", "nowhere"])
        keys = spark.createDataFrame([(b"StructA", b"a-2", 1), (b"StructA", b"no", 0)], "column binary, key binary, pos int")
        assert [(r.pos, r.found) for r in s.lookup(keys).collect()] == [(0, False), (1, True)]
        with pytest.raises(NotFoundError):
            s.lookup(keys, on_missing="raise")
        plan = s.point_object(b"StructA", b"a-1")._jdf.queryExecution().toString()
        assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(key" in plan


def test_unique_batches(spark, path):
    with Store.open(spark, path) as s:
        s.put_unique_structs("C", [("first", b"1"), ("second", b"2")], validate=True)
        assert s.get_many("C", ["second", "first"]) == [b"2", b"1"]
        for bad in ([("first", b"3")], [("x", b"1"), ("x", b"2")]):
            with pytest.raises(InvalidArgumentError):
                s.put_unique_structs("C", bad, validate=True)
        s.put_unique_structs("C", [("first", b"3")])
        assert s.get_struct("C", "first") == b"3" and s.entry_count == 2


def test_binary_keys_and_values(spark, path):
    pairs = [(f"p-key-{i}-".encode() + bytes([255, 0, i % 256]), (b"v%d" % i) + (b"\0" if i % 2 == 0 else b"\xfe")) for i in range(300)] + [(b"", b""), (b"\0", b"x")]
    with Store.open(spark, path) as s:
        s.put_structs(b"", pairs)
    with Store.open_read_only(spark, path) as s:
        assert s.get_many(b"", [k for k, _ in pairs]) == [v for _, v in pairs]


def test_rows_replace_and_merge(spark, path):
    with Store.open(spark, path) as s:
        s.put_row_structs("A", 7, [("a", b"row-a"), ("b", b"row-b"), ("b", b"row-b-new")])
        assert s.row_count == 1 and s.get_row_struct("A", 7, "b") == b"row-b-new"
        with pytest.raises(NotFoundError, match="^key not found in row$"):
            s.get_row_struct("A", 7, "c")
        with pytest.raises(NotFoundError, match="^row not found$"):
            s.get_row_struct("A", 8, "a")
        with pytest.raises(InvalidArgumentError):
            s.put_row_structs("A", 1, [])
        s.put_row_struct("A", 7, "c", b"row-c")
        s.put_row_struct("A", 7, "a", b"row-a2")
        assert s.get_row("A", 7) == {b"a": b"row-a2", b"b": b"row-b-new", b"c": b"row-c"}
        s.put_row_structs("A", 7, [("z", b"")])
        assert s.get_row("A", 7) == {b"z": b""} and s.row_count == 1
        for big in (0, 1 << 63, (1 << 64) - 1):
            s.put_row_struct("A", big, "k", str(big).encode())
        assert [s.get_row_struct("A", big, "k") for big in (0, 1 << 63, (1 << 64) - 1)] == [b"0", str(1 << 63).encode(), str((1 << 64) - 1).encode()]
        for bad in (-1, 1 << 64, "1"):
            with pytest.raises(InvalidArgumentError):
                s.put_row_struct("A", bad, "k", b"")


def test_rows_in_bulk(spark, path):
    df = spark.range(64).selectExpr("cast('P' as binary) as column", "id as row_id", "explode(array('first','second')) as key").selectExpr("*", "concat(key, '-', row_id) as value", "row_id * 2 as ordinal")
    with Store.open(spark, path) as s:
        s.put_rows(df)
        assert s.row_count == 64 and s.get_row_struct("P", 9, "second") == b"second-9"
        with pytest.raises(InvalidArgumentError):
            s.put_rows(df.drop("ordinal"))
        with pytest.raises(Exception, match="is null"):
            s.put_rows(df.withColumn("key", F.lit(None).cast("string")))
        s.put_structs("O", spark.createDataFrame([("k", "a", 0), ("k", "b", 1)], "key string, value string, ordinal int"))
        assert s.get_struct("O", "k") == b"b"


def test_writers_of_distinct_rows(spark, path):
    Store.open(spark, path).close()

    def write(n):
        with Store.open(spark, path) as s:
            for r in range(4):
                s.put_row_structs("A", n * 4 + r, [("payload", b"value-%d" % (n * 4 + r))])

    threads = [threading.Thread(target=write, args=(n,)) for n in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    with Store.open_read_only(spark, path) as s:
        assert s.row_count == 12 and s.get_row_struct("A", 11, "payload") == b"value-11"


def test_threads_on_one_handle(spark, path):
    with Store.open(spark, path, StoreOptions(buffer=5)) as s:

        def write(n):
            for r in range(6):
                s.put_struct("C", f"{n}-{r}", b"%d" % n)
                s.put_row_struct("R", n, f"{r}", b"%d" % r)

        threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert s.entry_count == 24 and s.row_count == 4 and len(s.get_row("R", 3)) == 6


def test_late_writer_after_a_snapshot(spark, path):
    late = Store.open(spark, path)
    with Store.open(spark, path) as s:
        for i in range(3):
            s.put_struct("C", "k", b"%d" % i)
            s.flush()
        s.put_row_structs("R", 1, [("a", b"first")])
        s.snapshot()
    late.put_struct("C", "k", b"late")
    late.put_row_structs("R", 1, [("b", b"late")])
    late.close()
    with Store.open_read_only(spark, path) as s:
        assert s.get_struct("C", "k") == b"late" and s.get_row("R", 1) == {b"b": b"late"}
        seqs = [r.seq for r in s.log.read("objects", s._manifest.segments).collect()]
        assert len(set(seqs)) == len(seqs) == 4


def test_two_writers_of_the_same_unique_key(spark, path, monkeypatch):
    a, b = Store.open(spark, path), Store.open(spark, path)
    real = a.log.write

    def slow(kind, *args):  # the other one commits while this one writes what it has validated
        segment = real(kind, *args)
        b.put_unique_structs("C", [("k", b"b")], validate=True)
        return segment

    monkeypatch.setattr(a.log, "write", slow)
    with pytest.raises(InvalidArgumentError):
        a.put_unique_structs("C", [("k", b"a"), ("other", b"a")], validate=True)
    with Store.open_read_only(spark, path) as s:
        assert s.entry_count == 1 and s.get_struct("C", "k") == b"b"


def test_manifests_tell_what_they_add(spark, path):
    log = Log(spark, path)
    log.make()
    m = Manifest()
    assert log.commit(m)
    for i in range(1, 40):
        assert log.commit(m, [{"kind": "objects", "id": i, "unique": False, "first": i, "last": i}])
        assert log.newest() == m and len(m.segments) == i
    assert not log.commit(Manifest(id=m.id - 1), []) and log.newest() == m  # that number is taken
    sizes = {x.getPath().getName(): x.getLen() for x in log.fs.listStatus(log.at("_manifest"))}
    assert sizes["000000000039.json"] < sizes["000000000032.json"] / 3


def test_plans_of_scans(spark, path):
    with Store.open(spark, path, SMALL) as s:
        for i in range(4):
            s.put_row_structs("R", i % 2, [(f"k{i}", b"v" * 50), ("x", b"y")])
            s.put_struct("C", f"k{i}", b"v")
            s.flush()
        spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
        plan = s.objects()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "rdd" not in plan.lower().replace("scan existingrdd", "")
        keys = s.row_keys(b"R", 1)._jdf.queryExecution().executedPlan().toString()
        schema = keys[keys.index("ReadSchema") :].split("\n")[0]
        assert "value" not in schema and "PartitionFilters: [isnotnull(bucket" in keys
        one = s.row_entry(b"R", 1, b"x", 5)._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        assert "EqualTo(key" in one and "EqualTo(row_id" in one
        assert s.get_row_struct("R", 1, "x") == b"y" and s.get_row("R", 1) == {b"k3": b"v" * 50, b"x": b"y"}


def test_segments_are_written_by_size(spark, path):
    """A bucket isn't one task's: Spark splits it."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(20000).selectExpr("cast('k' || id as binary) as key", "cast(repeat(uuid(), 3) as binary) as value", "id as ordinal").repartition(8)
        with Store.open(spark, path, StoreOptions(log_buckets=2)) as s:
            s.put_structs("C", df)
            files = s.log.read("objects", s._manifest.segments).inputFiles()
            assert len(files) > 8 and s.entry_count == 20000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_moved_handles_and_dumps_as_files(spark, path, tmp_path):
    s = Store.open(spark, path)
    s.put_struct("C", "k", b"v")
    t = s.moved()
    assert not s.is_open and s.entry_count == 0 and t.get_struct("C", "k") == b"v"
    with pytest.raises(NotOpenError):
        s.get_struct("C", "k")
    t.write_lines(t.dump(), f"file://{tmp_path}/dump")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/dump").collect()] == t.lines(t.dump())
    t.close()


def test_row_index_grows_when_rebuilt_and_bounds_batches(spark, path):
    rows = spark.range(20).selectExpr("cast('R' as binary) as column", "id as row_id", "'k' as key", "'v' as value", "id as ordinal")
    with Store.open(spark, path, StoreOptions(initial_row_buckets=16)) as s:
        s.put_rows(rows)
        assert s.row_bucket_count == 16
        s.snapshot()
        assert s.row_bucket_count == 32
    with Store.open(spark, path + "2", StoreOptions(initial_row_buckets=16, limit_rows=True)) as s:
        with pytest.raises(InvalidArgumentError):
            s.put_rows(rows)
        s.put_rows(rows.where("row_id < 12"))
        assert s.row_count == 12


def test_read_only_phase(spark, path):
    with pytest.raises(InvalidArgumentError):
        Store.open_read_only(spark, path)
    w = Store.open(spark, path)
    w.put_struct("O", "k", b"v")
    w.put_row_struct("R", 17, "rk", b"rv")
    w.flush()
    r = Store.open_read_only(spark, path)
    w.put_struct("O", "k", b"later")
    w.close()
    assert r.get_struct("O", "k") == b"v" and r.get_row_struct("R", 17, "rk") == b"rv"
    for f in (lambda: r.put("a", "b"), lambda: r.put_row_structs("R", 1, []), lambda: r.put_unique_structs("O", [])):
        with pytest.raises(InvalidArgumentError):
            f()
    r.flush()
    r.close()


def test_snapshot_rebuild_and_lost_data(spark, path, tmp_path):
    import shutil

    with Store.open(spark, path) as s:
        s.put_struct("A", "k", b"old")
        s.put_row_structs("A", 9, [("x", b"1"), ("y", b"2")])
        s.snapshot()
        s.put_struct("A", "k", b"new")
        s.put_row_struct("A", 9, "y", b"3")
        assert s.get_struct("A", "k") == b"new" and s.get_row("A", 9) == {b"x": b"1", b"y": b"3"}
    shutil.rmtree(tmp_path / "store/snapshot")
    with pytest.raises(CorruptionError):
        Store.open_read_only(spark, path)
    with Store.open(spark, path) as s:
        assert s.get_struct("A", "k") == b"new" and s.get_row("A", 9) == {b"x": b"1", b"y": b"3"} and s.entry_count == s.row_count == 1
    (tmp_path / "store/objects/half").mkdir()  # what a failed writer left
    Store.open(spark, path).close()
    shutil.rmtree(tmp_path / "store/objects")
    with pytest.raises(CorruptionError):
        Store.open(spark, path)


def test_older_format(spark, path):
    write_legacy(Log(spark, path), [(b"StructA", b"key", b"old"), (b"StructA", b"key", b"payload")])
    with pytest.raises(InvalidArgumentError):
        Store.open_read_only(spark, path)
    with Store.open(spark, path) as s:
        assert s.get_struct("StructA", "key") == b"payload"
        s.put_struct("StructA", "key", b"newer")
    with Store.open_read_only(spark, path) as s:
        assert s.get_struct("StructA", "key") == b"newer"


def test_path_is_a_file(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    with pytest.raises(InvalidArgumentError):
        Store.open(spark, f"file://{tmp_path}/file")


def test_options():
    for bad in ({"max_load_factor": 0}, {"max_load_factor": 0.95}, {"row_shards": 0}):
        with pytest.raises(InvalidArgumentError):
            StoreOptions(**bad)
    assert [round_up_power_of_two(n) for n in (0, 16, 17, 4096)] == [16, 16, 32, 4096]
    assert bucket_count(4, 0.5, 9) == 32 and bucket_count(4, 0.5, 8) == 16


def test_row_capacity(spark, path):
    with Store.open(spark, path, StoreOptions(initial_row_buckets=16, max_load_factor=0.1, limit_rows=True)) as s:
        s.put_row_structs("A", 1, [("k", b"1")])
        s.put_row_struct("A", 1, "k", b"2")
        for f in (lambda: s.put_row_struct("A", 2, "k", b""), lambda: s.put_row_structs("A", 1, [("k", b"")])):
            with pytest.raises(InvalidArgumentError):
                f()


def test_stats_and_dumps(spark, path):
    with Store.open(spark, path) as s:
        s.put_struct("StructA", "object-a", b"first-value")
        s.put_struct("StructA", "object-a", b"updated-value")
        s.put_struct("StructB", "object-b", b"second-value")
        s.put_row_structs("StructA", 7, [("row-key-a", b"row-a"), ("row-key-b", b"row-b")])
        s.put_row_structs("StructB", 9, [("row-key-c", b"row-c")])
        s.put("s", "t")
        assert [(bytes(r["column"]), r.object_count, r.row_count) for r in s.column_stats().collect()] == [(b"StructA", 3, 1), (b"StructB", 2, 1), (b"__string_kv__", 1, 0)]
        lines = s.lines(s.dump(diagnostics=True))
        assert any("value_hex=0x757064617465642d76616c7565" in x for x in lines) and lines[1].startswith("object_index: entries=3 buckets=")
        assert lines.index("objects:") < lines.index("rows:") < lines.index("column_statistics:") and any("column_hash=4476163269382220915" in x for x in lines)
        assert s.lines(s.dump_column_stats())[1:3] == ['column="StructA" objects=3 rows=1', 'column="StructB" objects=2 rows=1']
        one = s.lines(s.dump_column("StructA", lambda c, r, k, v: f"{'object' if r is None else f'row-{r}'}:{v.decode()}"))
        assert sum("deserialized=" in x for x in one) == 3 and any('deserialized="row-7:row-a"' in x for x in one) and not any("StructB" in x for x in one)

        def fails(c, r, k, v):
            raise ValueError("no")

        with pytest.raises(InvalidArgumentError):
            s.lines(s.dump_column("StructA", fails))


def test_shown_bytes(spark):
    data = [b"", b'a\\"\n\r\t', bytes(range(256)), "é".encode()]

    def plain(b):
        names = {92: "\\\\", 34: '\\"', 10: "\\n", 13: "\\r", 9: "\\t"}
        return '"' + "".join(names.get(x) or (chr(x) if 0x20 <= x <= 0x7E else f"\\x{x:02x}") for x in b) + '"'

    def fnv(b):
        h = 14695981039346656037
        for x in b:
            h = (h ^ x) * 1099511628211 % (1 << 64)
        return h

    got = spark.createDataFrame([(x,) for x in data], "b binary").select("b", escape_text(F.col("b")).alias("e"), hex_bytes(F.col("b")).alias("h"), unsigned(fnv1a64(F.col("b"))).alias("f")).collect()
    for r in got:
        assert (r.e, r.h, int(r.f)) == (plain(bytes(r.b)), "0x" + bytes(r.b).hex(), fnv(bytes(r.b)))


def test_random_scripts_against_a_model(spark):
    rng, model, log = random.Random(2), {}, []
    for commit in range(1, 400):
        column, row_id = rng.choice([b"A", b"B"]), rng.randrange(6)
        kind = rng.choice(["replace", "merge"])
        batch = [(b"k%d" % rng.randrange(5), b"v%d" % rng.randrange(99)) for _ in range(rng.randrange(1, 5) if kind == "replace" else 1)]
        own = model.setdefault((column, row_id), {})
        if kind == "replace":
            own.clear()
        own.update(batch)
        log += [(column, row_id, k, v, kind, (commit << 32) + i) for i, (k, v) in enumerate(batch)]
    df = spark.createDataFrame(log, "column binary, row_id long, key binary, value binary, kind string, seq long").repartition(5)
    got = {}
    for r in row_ops.live_rows(df).collect():
        got.setdefault((bytes(r["column"]), r.row_id), {})[bytes(r.key)] = bytes(r.value)
    assert got == model


def test_stream(spark, path, tmp_path):
    from quillstore.streaming.ingest import put_batches

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"key": "a", "value": "1", "ordinal": 0}\n{"key": "a", "value": "2", "ordinal": 1}\n')
    with Store.open(spark, path) as s:
        stream = spark.readStream.schema("key string, value string, ordinal int").json(f"file://{tmp_path}/in")
        stream.writeStream.foreachBatch(put_batches(s, "C")).option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
        assert s.get_struct("C", "a") == b"2"
