"""Queries that write the driver's tables to a `Store` in the shared folder and read them back through it.

Objects: events (column event_type, key user_id, value props), in two commits with a snapshot between. Rows: events by (event_type, user_id)
with key event_id % 5, in three commits: event_id % 3 = 0 merges, 1 replaces, 2 merges. Each query makes the store that it needs.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgumentError, NotFoundError
from ..functions import hashing
from ..options import StoreOptions
from ..schema import MERGE, REPLACE, unsigned
from ..sources.log import Log
from ..sources.migrate import write_legacy
from ..sources.scratch import scratch
from ..store import Store
from .queries import COLUMN_HASH, ENTRY_SQL, FNV, LIVE, LIVE_SQL, OBJECT_LINE, WANTED, WANTED_SQL, events, mixed_sql, plain, query, shown, table, text


def objects_of(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).withColumnRenamed("seq", "ordinal")


def rows_of(spark: SparkSession, sf: str, part: int) -> DataFrame:
    t = table(spark, sf, "events").where(F.col("event_id") % 3 == part)
    return t.select(text("event_type").alias("column"), F.col("user_id").alias("row_id"), text(F.expr("event_id % 5")).alias("key"), text("props").alias("value"), F.col("event_id").alias("ordinal"))


def with_objects(spark: SparkSession, sf: str) -> str:
    """A store of the events in two commits, with a snapshot after the first."""
    path, log = scratch(spark), objects_of(spark, sf)
    with Store.open(spark, path) as s:
        s.put_objects(log.where("ordinal % 2 = 0"))
        s.snapshot()
        s.put_objects(log.where("ordinal % 2 = 1"))
    return path


def with_rows(spark: SparkSession, sf: str, path: str | None = None) -> str:
    path = path or scratch(spark)
    with Store.open(spark, path) as s:
        for part, kind in enumerate((MERGE, REPLACE, MERGE)):
            s.put_rows(rows_of(spark, sf, part), kind)
    return path


#: A user of every event type, in tables of any size.
POINT = "5"
#: What counts of the two commits: the later one, and in a commit the last event.
TWO = "select event_type, user_id, props, event_id from events qualify row_number() over (partition by event_type, user_id order by event_id % 2 desc, event_id desc) = 1"
TWO_SQL = f"select event_type as column_name, cast(user_id as varchar) as key_text, lower(hex(encode(props))) as value_hex from ({TWO})"
U = "select event_type, user_id, event_id % 5 as k, event_id % 3 as c, props, event_id from events"
FOLD = f"(with u as ({U}), b as (select *, max(case when c = 1 then 1 else 0 end) over (partition by event_type, user_id) as base from u) select * from b where c >= base qualify row_number() over (partition by event_type, user_id, k order by c desc, event_id desc) = 1)"


@query(TWO_SQL)
def store_write_and_reopen(spark, sf):
    return plain(Store.open_read_only(spark, with_objects(spark, sf)).objects())


@query(TWO_SQL)
def store_rebuild_lost_snapshot(spark, sf):
    path = with_objects(spark, sf)
    log = Log(spark, path)
    log.fs.delete(log.at("snapshot"), True)
    with Store.open(spark, path) as s:
        return plain(s.objects())


@query(TWO_SQL)
def store_late_writer(spark, sf):
    """A handle that was opened before others committed and made a snapshot still adds to the newest state."""
    path, log = scratch(spark), objects_of(spark, sf)
    late = Store.open(spark, path)
    with Store.open(spark, path) as s:
        s.put_objects(log.where("ordinal % 2 = 0"))
        s.snapshot()
    late.put_objects(log.where("ordinal % 2 = 1"))
    late.close()
    return plain(Store.open_read_only(spark, path).objects())


@query(LIVE_SQL)
def store_pinned_reader(spark, sf):
    """A reader keeps its state while a writer goes on."""
    path = scratch(spark)
    with Store.open(spark, path) as s:
        s.put_objects(objects_of(spark, sf))
        s.flush()
        reader = Store.open_read_only(spark, path)
        s.put_objects(objects_of(spark, sf).withColumn("value", F.lit(b"later")))
    return plain(reader.objects())


@query(f"{TWO_SQL} where event_type = 'click' and user_id = {POINT}")
def store_get_struct(spark, sf):
    s = Store.open_read_only(spark, with_objects(spark, sf))
    return spark.createDataFrame([("click", POINT, s.get_struct("click", POINT).hex())], "column_name string, key_text string, value_hex string")


HIT = ["8", POINT, "8", "7"]


@query(f"select w.pos, w.key_text, lower(hex(encode(l.props))) as value_hex from (select * from (values {', '.join(f'({i}, {k!r})' for i, k in enumerate(HIT))}) as t(pos, key_text)) w join ({TWO}) l on l.event_type = 'click' and cast(l.user_id as varchar) = w.key_text")
def store_get_many(spark, sf):
    s = Store.open_read_only(spark, with_objects(spark, sf))
    return spark.createDataFrame([(i, k, v.hex()) for i, (k, v) in enumerate(zip(HIT, s.get_many("click", HIT), strict=True))], "pos int, key_text string, value_hex string")


@query(f"select w.pos, w.key_text, lower(hex(encode(l.props))) as value_hex, l.props is not null as found from {WANTED_SQL} w left join ({TWO}) l on l.event_type = 'click' and cast(l.user_id as varchar) = w.key_text")
def store_lookup(spark, sf):
    s = Store.open_read_only(spark, with_objects(spark, sf))
    wanted = spark.createDataFrame([(b"click", k.encode(), i) for i, k in enumerate(WANTED)], "column binary, key binary, pos int")
    return s.lookup(wanted).select("pos", shown("key").alias("key_text"), F.lower(F.hex("value")).alias("value_hex"), "found")


@query("select n_name as key_text, n_name || '-' || cast(n_regionkey as varchar) as value_text from nation")
def store_put_get_strings(spark, sf):
    nations = table(spark, sf, "nation").collect()
    path = scratch(spark)
    with Store.open(spark, path) as s:
        for r in nations:
            s.put(r["n_name"], "old")
        for r in nations:
            s.put(r["n_name"], f"{r['n_name']}-{r['n_regionkey']}")
    s = Store.open_read_only(spark, path)
    assert s.get(nations[0]["n_name"]).startswith(nations[0]["n_name"])
    return s.objects().select(shown("key").alias("key_text"), shown("value").alias("value_text"))


@query("select count(*) as entries, true as refused from customer")
def store_unique_batches(spark, sf):
    """A validated batch of new keys, and one that another writer's commit makes invalid."""
    path = scratch(spark)
    keys = table(spark, sf, "customer").select(text("c_custkey").alias("key"), text("c_name").alias("value"), F.col("c_custkey").alias("ordinal"))
    with Store.open(spark, path) as s, Store.open(spark, path) as other:
        other.put_unique_structs("customer", keys, validate=True)
        refused = False
        try:
            s.put_unique_structs("customer", keys, validate=True)
        except InvalidArgumentError:
            refused = True
    s = Store.open_read_only(spark, path)
    return spark.createDataFrame([(s.entry_count, refused)], "entries long, refused boolean")


@query(f"select {ENTRY_SQL} from {FOLD}")
def store_rows_fold(spark, sf):
    return plain(Store.open_read_only(spark, with_rows(spark, sf)).rows().select("column", "row_id", "key", "value"))


@query(f"select cast(k as varchar) as key_text, props as value_text from {FOLD} where event_type = 'click' and user_id = 8")
def store_get_row(spark, sf):
    s = Store.open_read_only(spark, with_rows(spark, sf))
    return spark.createDataFrame([(k.decode(), v.decode()) for k, v in s.get_row("click", 8).items()], "key_text string, value_text string")


@query(f"select cast(k as varchar) as key_text, props as value_text from {FOLD} where event_type = 'view' and user_id = 7")
def store_get_row_struct(spark, sf):
    s, found = Store.open_read_only(spark, with_rows(spark, sf)), []
    for k in "012345":
        try:
            found.append((k, s.get_row_struct("view", 7, k).decode()))
        except NotFoundError:
            pass
    return spark.createDataFrame(found, "key_text string, value_text string")


@query("select conv_id as row_id, count(distinct turn) as n from conversations group by 1")
def store_parallel_writers(spark, sf):
    """Four handles replace rows of their own at the same time."""
    path, t = scratch(spark), table(spark, sf, "conversations")
    own = t.select(F.lit(b"talk").alias("column"), F.col("conv_id").alias("row_id"), text("turn").alias("key"), text("role").alias("value"), F.col("turn").alias("ordinal"))
    Store.open(spark, path).close()
    failed = []

    def write(n: int) -> None:
        try:
            with Store.open(spark, path) as s:
                s.put_rows(own.where(F.col("row_id") % 4 == n))
        except Exception as e:  # a thread's error is the query's
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    if failed:
        raise failed[0]
    return Store.open_read_only(spark, path).rows().groupBy("row_id").agg(F.count("*").alias("n"))


STORE_STATS = f"select event_type as column_name, cast(sum(o) as bigint) as object_count, cast(sum(r) as bigint) as row_count from (select event_type, count(*) as o, 0 as r from ({TWO}) group by 1 union all select event_type, count(*), count(distinct user_id) from {FOLD} group by 1) group by 1"


def with_both(spark: SparkSession, sf: str) -> Store:
    return Store.open_read_only(spark, with_rows(spark, sf, with_objects(spark, sf)))


@query(STORE_STATS)
def store_column_stats(spark, sf):
    return with_both(spark, sf).column_stats().select(shown("column").alias("column_name"), "object_count", "row_count")


#: Live keys before a commit plus the entries of the commit, at most.
PEAK = "select greatest((select count(*) from events where event_id % 2 = 0), (select count(distinct (event_type, user_id)) from events where event_id % 2 = 0) + (select count(*) from events where event_id % 2 = 1)) as peak"
BUCKETS = "greatest(65536, cast(pow(2, ceil(log2(peak / 0.8))) as bigint))"


@query(f"select (select count(*) from ({TWO})) as entries, (select count(distinct (event_type, user_id)) from events) as row_total, {BUCKETS} as buckets, cast(65536 as bigint) as row_buckets from ({PEAK})")
def store_counts(spark, sf):
    s = with_both(spark, sf)
    return spark.createDataFrame([(s.entry_count, s.row_count, s.bucket_count, s.row_bucket_count)], "entries long, row_total long, buckets long, row_buckets long")


ROW_LINES = f"""select '  row column="' || event_type || '" row_id=' || user_id || ' object_count=' || count(*) as line, event_type from {FOLD} group by event_type, user_id
union all select '    key="' || k || '" value_size=' || strlen(props) || ' value_hex=0x' || lower(hex(encode(props))), event_type from {FOLD}"""


@query(f"""select line from (values ('store dump'), ('objects:'), ('rows:'), ('column_statistics:')) as t(line)
union all select 'object_index: entries=' || (select count(*) from ({TWO})) || ' buckets=' || {BUCKETS} from ({PEAK})
union all select 'row_index: rows=' || (select count(distinct (event_type, user_id)) from events) || ' buckets=65536 shards=8 next_sequence=6'
union all select {OBJECT_LINE} from ({TWO}) union all select line from ({ROW_LINES})
union all select '  column="' || column_name || '" objects=' || object_count || ' rows=' || row_count from ({STORE_STATS})""")
def store_dump(spark, sf):
    """The whole dump, written as text files by the executors and read again."""
    s, path = with_both(spark, sf), scratch(spark)
    s.write_lines(s.dump(), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(f"""select line from (values ('column dump column="click"'), ('objects:'), ('rows:'), ('column_statistics:')) as t(line)
union all select 'object_index: buckets=' || {BUCKETS} from ({PEAK})
union all select 'row_index: buckets=65536 shards=8'
union all select {OBJECT_LINE} from ({TWO}) where event_type = 'click' union all select line from ({ROW_LINES}) where event_type = 'click'
union all select '  column="' || column_name || '" objects=' || object_count || ' rows=' || row_count from ({STORE_STATS}) where column_name = 'click'""")
def store_dump_column(spark, sf):
    return with_both(spark, sf).dump_column("click")


@query("select 'column statistics' as line union all select 'column=\"' || column_name || '\" objects=' || object_count || ' rows=' || row_count from (" + STORE_STATS + ")")
def store_dump_statistics(spark, sf):
    return with_both(spark, sf).dump_column_stats()


@query(LIVE_SQL)
def store_migrate_older_format(spark, sf):
    """A store of the older format, opened for writing once."""
    path = scratch(spark)
    write_legacy(Log(spark, path), events(spark, sf).select("column", "key", "value", F.col("seq").alias("position")))
    Store.open(spark, path).close()
    return plain(Store.open_read_only(spark, path).objects())


@query("select event_type as column_name, cast(count(*) as bigint) as records, cast(sum(strlen(props)) as bigint) as value_bytes from events group by 1")
def store_object_log(spark, sf):
    """All mutations of the log, superseded ones too."""
    s = Store.open_read_only(spark, with_objects(spark, sf))
    return s.log.read("objects", s._manifest.segments).groupBy(shown("column").alias("column_name")).agg(F.count("*").alias("records"), F.sum(F.length("value")).alias("value_bytes"))


@query("select event_type as column_name, cast(event_id % 3 + 1 as integer) as commit, cast(count(*) as bigint) as records from events group by 1, 2")
def store_row_log(spark, sf):
    s = Store.open_read_only(spark, with_rows(spark, sf))
    return s.log.read("rows", s._manifest.segments).groupBy(shown("column").alias("column_name"), F.shiftright("seq", 32).cast("int").alias("commit")).agg(F.count("*").alias("records"))


@query("select count(distinct (event_type, user_id)) > 0.8 * 16 as refused, case when count(distinct (event_type, user_id)) > 0.8 * 16 then 0 else count(distinct (event_type, user_id)) end as rows_kept from events")
def store_row_capacity(spark, sf):
    """Rows beyond what the row index holds are refused as a whole batch."""
    path, refused = scratch(spark), False
    with Store.open(spark, path, StoreOptions(initial_row_buckets=16, limit_rows=True)) as s:
        try:
            for part in range(3):
                s.put_rows(rows_of(spark, sf, part), MERGE)
        except InvalidArgumentError:
            refused = True
        return spark.createDataFrame([(refused, s.row_count)], "refused boolean, rows_kept long")


@query("select count(*) as row_total, greatest(16, cast(pow(2, ceil(log2(count(*) / 0.8))) as bigint)) as row_buckets from (select distinct event_type, user_id from events)")
def store_row_index_growth(spark, sf):
    """A rebuilt row index doubles until the rows fit."""
    path = with_rows(spark, sf)
    with Store.open(spark, path, StoreOptions(initial_row_buckets=16)) as s:
        s.snapshot()
        return spark.createDataFrame([(s.row_count, s.row_bucket_count)], "row_total long, row_buckets long")


@query(f"with h as (select distinct user_id, cast({FNV.format('cast(user_id as varchar)')} as uhugeint) as k, cast({COLUMN_HASH} as uhugeint) as c from events), m as (select user_id, {mixed_sql('c', 'k')} as x from h) select user_id, cast(case when x = 0 then 1 else x end as decimal(20,0)) as index_hash from m")
def object_index_hash(spark, sf):
    own = table(spark, sf, "events").select("user_id").distinct()
    return own.select("user_id", unsigned(hashing.object_index_hash(hashing.fnv1a64_of(b"lineitem"), hashing.fnv1a64(text("user_id")))).alias("index_hash"))


