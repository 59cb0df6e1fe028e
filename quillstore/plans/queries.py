"""The registered queries of the store's operators over the driver's tables, each with the SQL of the same rows.

Projections: events as a mutation log (column event_type, key user_id, value props, order event_id); documents as unique objects (lang,
doc_id); lineitem as row batches (row l_orderkey, key l_linenumber); conversations as rows (conv_id, turn); events once more as replaced
and merged rows (key event_id % 5, commit event_id div 100, every third commit replaces).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, layout
from ..functions.text import escape_text, hex_bytes
from ..operators import dump, objects, rows, stats
from ..options import bucket_count, round_up_power_of_two
from ..schema import MERGE, REPLACE, unsigned
from ..sources.migrate import migrated
from ..store import batch_peak

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string").cast("binary")


def shown(c: str) -> F.Column:
    return F.col(c).cast("string")


def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(text("event_type").alias("column"), text("user_id").alias("key"), text("props").alias("value"), F.col("event_id").alias("seq"))


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(text("lang").alias("column"), text("doc_id").alias("key"), text(F.coalesce("text", F.lit(""))).alias("value"), F.col("doc_id").alias("seq"))


def batches(spark, sf) -> DataFrame:
    t = table(spark, sf, "lineitem")
    return t.select(F.lit(b"lineitem").alias("column"), F.col("l_orderkey").alias("row_id"), text("l_linenumber").alias("key"), text("l_returnflag").alias("value"), F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("seq"))


def talks(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(text("role").alias("column"), F.col("conv_id").alias("row_id"), text("turn").alias("key"), text("text").alias("value"), F.col("turn").alias("seq"))


def mutations(spark, sf, kind: str | None = None) -> DataFrame:
    t, commit = table(spark, sf, "events"), F.expr("event_id div 100")
    kinds = F.lit(kind) if kind else F.when(commit % 3 == 0, REPLACE).otherwise(MERGE)
    return t.select(text("event_type").alias("column"), F.col("user_id").alias("row_id"), text(F.expr("event_id % 5")).alias("key"), text("props").alias("value"), kinds.alias("kind"), F.col("event_id").alias("seq"), commit.alias("commit"))


def plain(df: DataFrame) -> DataFrame:
    """Bytes as text or hex, so that every engine shows the same."""
    out = {"column": shown("column").alias("column_name"), "key": shown("key").alias("key_text"), "value": F.lower(F.hex("value")).alias("value_hex")}
    return df.select(*(out.get(c, F.col(c)) for c in df.columns if c not in ("seq", "kind", "commit")))


LIVE = "select event_type, user_id, props, event_id from events qualify row_number() over (partition by event_type, user_id order by event_id desc) = 1"
LIVE_SQL = f"select event_type as column_name, cast(user_id as varchar) as key_text, lower(hex(encode(props))) as value_hex from ({LIVE})"


@query(LIVE_SQL)
def put_structs_upsert(spark, sf):
    return plain(objects.latest_objects(events(spark, sf)))


@query("select l_orderkey as row_id, cast(l_linenumber as varchar) as key_text, arg_max(l_returnflag, (l_partkey, l_suppkey, l_extendedprice)) as flag from lineitem group by 1, 2")
def batch_last_duplicate_wins(spark, sf):
    return rows.dedupe_batch(batches(spark, sf)).select("row_id", shown("key").alias("key_text"), shown("value").alias("flag"))


@query("select l_orderkey as row_id, count(distinct l_linenumber) as item_count from lineitem group by 1")
def row_batch_dedupe(spark, sf):
    return rows.row_sizes(rows.dedupe_batch(batches(spark, sf))).select("row_id", "item_count")


@query("select lang as column_name, cast(doc_id as varchar) as key_text, octet_length(encode(text)) as value_size from documents")
def put_unique_structs(spark, sf):
    return objects.latest_objects(documents(spark, sf), unique=True).select(shown("column").alias("column_name"), shown("key").alias("key_text"), F.length("value").cast("long").alias("value_size"))


@query("select event_type as column_name, cast(user_id as varchar) as key_text, count(*) as n from events group by 1, 2 having count(*) > 1")
def unique_violation_check(spark, sf):
    return objects.unique_violations(events(spark, sf)).select(shown("column").alias("column_name"), shown("key").alias("key_text"), "n")


@query("select cast(user_id as varchar) as key_text, arg_max(props, event_id) as value_text from events group by 1")
def string_put_get(spark, sf):
    log = events(spark, sf).withColumn("column", F.lit(b"__string_kv__"))
    return objects.latest_objects(log).select(shown("key").alias("key_text"), F.decode("value", "UTF-8").alias("value_text"))


@query(f"{LIVE_SQL} where event_type = 'click' and user_id = 46")
def get_struct_point(spark, sf):
    return plain(objects.latest_objects(objects.get(events(spark, sf), b"click", b"46")))


@query(f"{LIVE_SQL} where user_id = 46")
def column_isolation(spark, sf):
    return plain(objects.latest_objects(events(spark, sf).where(F.col("key") == F.lit(b"46"))))


WANTED = ["46", "7", "46", "1", "-5", "12"]
WANTED_SQL = f"(select * from (values {', '.join(f'({i}, {k!r})' for i, k in enumerate(WANTED))}) as t(pos, key_text))"


def wanted(spark) -> DataFrame:
    return spark.createDataFrame([(b"click", k.encode(), i) for i, k in enumerate(WANTED)], "column binary, key binary, pos int")


@query(f"select w.pos, w.key_text, lower(hex(encode(l.props))) as value_hex, l.props is not null as found from {WANTED_SQL} w left join ({LIVE}) l on l.event_type = 'click' and cast(l.user_id as varchar) = w.key_text")
def get_many_ordered(spark, sf):
    found = objects.lookup(objects.latest_objects(events(spark, sf).where(F.col("column") == F.lit(b"click"))), wanted(spark))
    return found.select("pos", shown("key").alias("key_text"), F.lower(F.hex("value")).alias("value_hex"), "found")


@query("select c_custkey from customer where not exists (from events e where e.event_type = 'click' and e.user_id = c_custkey)")
def missing_keys(spark, sf):
    keys = table(spark, sf, "customer").select(F.lit(b"click").alias("column"), text("c_custkey").alias("key"), "c_custkey")
    return objects.missing_keys(objects.latest_objects(events(spark, sf)), keys).select("c_custkey")


@query(f"select w.pos, w.key_text from {WANTED_SQL} w where not exists (from events e where e.event_type = 'click' and cast(e.user_id as varchar) = w.key_text)")
def get_many_missing(spark, sf):
    return objects.lookup(objects.latest_objects(events(spark, sf)), wanted(spark)).where(~F.col("found")).select("pos", shown("key").alias("key_text"))


U = "select event_type, user_id, event_id % 5 as k, event_id // 100 as c, props, event_id from events"
ENTRY_SQL = "event_type as column_name, user_id as row_id, cast(k as varchar) as key_text, lower(hex(encode(props))) as value_hex"


@query(f"with u as ({U}), b as (select *, max(c) over (partition by event_type, user_id) as base from u) select {ENTRY_SQL} from b where c = base qualify row_number() over (partition by event_type, user_id, k order by event_id desc) = 1")
def put_row_structs_replace(spark, sf):
    return plain(rows.live_rows(mutations(spark, sf, REPLACE), "commit"))


@query(f"with u as ({U}) select {ENTRY_SQL} from u qualify row_number() over (partition by event_type, user_id, k order by event_id desc) = 1")
def put_row_struct_merge(spark, sf):
    return plain(rows.live_rows(mutations(spark, sf, MERGE), "commit"))


FOLD_SQL = f"with u as ({U}), b as (select *, coalesce(max(case when c % 3 = 0 then c end) over (partition by event_type, user_id), 0) as base from u), f as (select * from b where c >= base qualify row_number() over (partition by event_type, user_id, k order by event_id desc) = 1) "


@query(FOLD_SQL + f"select {ENTRY_SQL} from f")
def row_mixed_fold(spark, sf):
    return plain(rows.live_rows(mutations(spark, sf), "commit"))


@query(FOLD_SQL + f"select {ENTRY_SQL} from f where event_type = 'click' and user_id = 8 and k = 0")
def get_row_struct_point(spark, sf):
    row = mutations(spark, sf).where((F.col("column") == F.lit(b"click")) & (F.col("row_id") == 8))
    return plain(rows.live_rows(row, "commit").where(F.col("key") == F.lit(b"0")))


@query(FOLD_SQL + f"select {ENTRY_SQL} from f where event_type = 'click' and user_id = 8")
def row_entries(spark, sf):
    return plain(rows.live_rows(mutations(spark, sf).where((F.col("column") == F.lit(b"click")) & (F.col("row_id") == 8)), "commit"))


@query("select conv_id as row_id, string_agg(cast(turn as varchar) || '=' || cast(octet_length(encode(text)) as varchar), ';' order by cast(turn as varchar)) as entries from conversations group by 1")
def row_maps(spark, sf):
    log = talks(spark, sf).withColumn("column", F.lit(b"c"))
    sizes = F.transform("entries", lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.length(e["value"]).cast("string")))
    return rows.row_maps(log).select("row_id", F.array_join(sizes, ";").alias("entries"))


@query("select count(distinct (event_type, user_id)) as entries from events")
def entry_count(spark, sf):
    return objects.latest_objects(events(spark, sf)).agg(F.count("*").alias("entries"))


@query("select count(distinct l_orderkey) as row_total from lineitem")
def row_count(spark, sf):
    return rows.dedupe_batch(batches(spark, sf)).select("column", "row_id").distinct().agg(F.count("*").alias("row_total"))


STATS_SQL = f"select column_name, cast(sum(o) as bigint) as object_count, cast(sum(r) as bigint) as row_count from (select event_type as column_name, count(*) as o, 0 as r from ({LIVE}) group by 1 union all select role, count(*), count(distinct conv_id) from conversations group by 1) group by 1"


def live_stats(spark, sf) -> DataFrame:
    return stats.column_stats(objects.latest_objects(events(spark, sf)), talks(spark, sf))


@query(STATS_SQL)
def column_stats(spark, sf):
    return live_stats(spark, sf).select(shown("column").alias("column_name"), "object_count", "row_count")


@query(f"""select 'column="' || column_name || '" objects=' || object_count || ' rows=' || row_count as line from ({STATS_SQL})""")
def dump_column_stats_text(spark, sf):
    return stats.stats_lines(live_stats(spark, sf)).select("line")


ESCAPED = "'\"' || replace(replace({}, '\\', '\\\\'), '\"', '\\\"') || '\"'"
OBJECT_LINE = "'  object column=' || " + ESCAPED.format("event_type") + " || ' key=\"' || user_id || '\" value_size=' || strlen(props) || ' value_hex=0x' || lower(hex(encode(props)))"


@query(f"select {OBJECT_LINE} as line from ({LIVE})")
def dump_objects(spark, sf):
    return dump.object_lines(objects.latest_objects(events(spark, sf))).select("line")


@query("""select '  row column="c" row_id=' || conv_id || ' object_count=' || count(*) as line from conversations group by conv_id
union all select '    key="' || turn || '" value_size=' || strlen(text) || ' value_hex=0x' || lower(hex(encode(text))) from conversations""")
def dump_rows(spark, sf):
    return dump.row_lines(talks(spark, sf).withColumn("column", F.lit(b"c"))).select("line")


TITLES = {"title": "column dump", "objects": "object_index:", "rows": "row_index:"}
CLICKS = "f where event_type = 'click'"


@query(FOLD_SQL + f"""select {OBJECT_LINE} as line from ({LIVE}) where event_type = 'click' union all
select * from (values ('column dump'), ('object_index:'), ('objects:'), ('row_index:'), ('rows:'), ('column_statistics:'))
union all select '  row column="click" row_id=' || user_id || ' object_count=' || count(*) from {CLICKS} group by user_id
union all select '    key="' || k || '" value_size=' || strlen(props) || ' value_hex=0x' || lower(hex(encode(props))) from {CLICKS}
union all select '  column="click" objects=' || (select count(*) from ({LIVE}) where event_type = 'click') + (select count(*) from {CLICKS}) || ' rows=' || (select count(distinct user_id) from {CLICKS})""")
def dump_column(spark, sf):
    return dump.dump(objects.latest_objects(events(spark, sf)), rows.live_rows(mutations(spark, sf), "commit"), TITLES, b"click")


def json_number(column: bytes, row_id: int | None, key: bytes, value: bytes) -> str:
    import json

    return str(json.loads(value)["k"])


@query(f"""select {OBJECT_LINE} || ' deserialized="' || json_extract_string(props, '$.k') || '"' as line from ({LIVE}) where event_type = 'click'""")
def dump_column_deserialized(spark, sf):
    return dump.object_lines(objects.latest_objects(events(spark, sf).where(F.col("column") == F.lit(b"click"))), json_number).select("line")


@query("select event_id, " + ESCAPED.format("props") + " as escaped from events", "escape_text")
def escape_text_of_events(spark, sf):
    return events(spark, sf).select(F.col("seq").alias("event_id"), escape_text(F.col("value")).alias("escaped"))


@query("select doc_id, '0x' || lower(hex(encode(text))) as hexed from documents", "hex_bytes")
def hex_bytes_of_documents(spark, sf):
    return documents(spark, sf).select(F.col("seq").alias("doc_id"), hex_bytes(F.col("value")).alias("hexed"))


FNV = "cast(list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(range(1, strlen({0}) + 1), lambda i: cast(ascii({0}[i]) as uhugeint))), lambda h, v: (xor(h, v) * 1099511628211) % 18446744073709551616::uhugeint) as decimal(20,0))"


@query("select user_id, " + FNV.format("cast(user_id as varchar)") + " as hash from (select distinct user_id from events)")
def fnv1a64(spark, sf):
    return table(spark, sf, "events").select("user_id").distinct().select("user_id", unsigned(hashing.fnv1a64(text("user_id"))).alias("hash"))


M64 = "18446744073709551616::uhugeint"


def mixed_sql(a: str, b: str) -> str:
    """The finalizer over unsigned numbers wide enough not to overflow."""
    x = f"xor({a}, ({b} * 8388608) % {M64} + {b} // 2199023255552)"
    # products of two 64-bit numbers fit 128 bits
    step1 = f"list_transform([{x}], lambda v: (xor(v, v // 1073741824) * 13787848793156543929::uhugeint) % {M64})"
    step2 = f"list_transform({step1}, lambda v: (xor(v, v // 134217728) * 10723151780598845931::uhugeint) % {M64})"
    return f"list_transform({step2}, lambda v: xor(v, v // 2147483648))[1]"


COLUMN_HASH = FNV.format("'lineitem'")


@query(f"with h as (select distinct l_orderkey, cast({COLUMN_HASH} as uhugeint) as c from lineitem) select l_orderkey, cast({mixed_sql('c', 'cast(l_orderkey as uhugeint)')} as decimal(20,0)) as mixed from h")
def mix_hashes(spark, sf):
    mixed = hashing.mix_hashes(hashing.fnv1a64_of(b"lineitem"), F.col("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey").distinct().select("l_orderkey", unsigned(mixed).alias("mixed"))


@query(f"with h as (select distinct l_orderkey, cast({COLUMN_HASH} as uhugeint) as c from lineitem) select cast({mixed_sql('c', 'cast(l_orderkey as uhugeint)')} % 8 as integer) as shard, count(*) as n from h group by 1")
def shard_distribution(spark, sf):
    own = table(spark, sf, "lineitem").select("l_orderkey").distinct()
    return own.select(hashing.shard_for_row(hashing.fnv1a64_of(b"lineitem"), F.col("l_orderkey"), 8).alias("shard")).groupBy("shard").agg(F.count("*").alias("n"))


@query("""with s as (select event_id, strlen(event_type) + strlen(cast(user_id as varchar)) as names, 24 + strlen(event_type) + strlen(cast(user_id as varchar)) + strlen(props) as record_size from events),
o as (select *, cast(24 + sum(record_size) over (order by event_id) - record_size as bigint) as record_offset from s) select event_id, record_size, record_offset, record_offset + 24 + names as value_offset from o""")
def record_offsets(spark, sf):
    placed = layout.record_offsets(events(spark, sf).withColumn("batch", F.expr("seq div 1000")), "batch")
    return placed.select(F.col("seq").alias("event_id"), F.col("record_size").cast("long").alias("record_size"), F.col("record_offset").cast("long").alias("record_offset"), F.col("value_offset").cast("long").alias("value_offset"))


@query("""with d as (select l_orderkey, l_linenumber, count(*) as given from lineitem group by 1, 2), r as (select l_orderkey, sum(given) as n, sum(strlen(cast(l_linenumber as varchar))) as keys, count(*) as live from d group by 1)
select l_orderkey as row_id, cast(72 + 48 * greatest(16, cast(pow(2, ceil(log2(floor(n / 0.8) + 1))) as bigint)) + 8 + keys + live as bigint) as block_size from r""")
def row_block_sizes(spark, sf):
    batch = batches(spark, sf)
    given = batch.groupBy("column", "row_id").agg(F.count("*").alias("n"))
    kept = rows.dedupe_batch(batch).groupBy("column", "row_id").agg(F.sum(F.octet_length("key")).alias("keys"), F.sum(F.octet_length("value")).alias("vals"))
    return given.join(kept, ["column", "row_id"]).select("row_id", layout.block_size(F.col("column"), F.col("n"), F.col("keys"), F.col("vals"), 0.8).cast("long").alias("block_size"))


@query("""with b as (select event_id // 100 as c, event_type, user_id from events), s as (select c, count(*) as n from b group by 1), f as (select c, count(*) as fresh from (select min(c) as c from b group by event_type, user_id) group by 1),
p as (select max(coalesce(before, 0) + n) as peak from (select s.c, s.n, sum(coalesce(f.fresh, 0)) over (order by s.c rows between unbounded preceding and 1 preceding) as before from s left join f on f.c = s.c))
select cast(peak as bigint) as peak, cast(greatest(16, pow(2, ceil(log2(peak / 0.8)))) as bigint) as buckets from p""")
def bucket_count_model(spark, sf):
    peak = batch_peak(events(spark, sf).withColumn("seq", F.shiftleft(F.expr("seq div 100"), 32)))
    return spark.createDataFrame([(peak, bucket_count(1, 0.8, peak))], "peak long, buckets long")


@query("select count(distinct l_orderkey) as row_total, count(distinct l_orderkey) + 1 > 0.8 * 16384 as over_limit from lineitem")
def row_capacity_check(spark, sf):
    n = F.count_distinct("row_id")
    return batches(spark, sf).agg(n.alias("row_total"), ((n + 1) > F.lit(0.8 * round_up_power_of_two(16000))).alias("over_limit"))


@query(LIVE_SQL)
def rebuild_object_view(spark, sf):
    log = events(spark, sf)
    half = log.agg(F.max("seq")).first()[0] // 2
    snapshot = objects.latest_objects(log.where(F.col("seq") <= half))
    return plain(objects.latest_objects(snapshot.unionByName(log.where(F.col("seq") > half))))


@query(FOLD_SQL + f"select {ENTRY_SQL} from f")
def rebuild_row_view(spark, sf):
    log = mutations(spark, sf)
    pin = log.agg(F.max("commit")).first()[0] // 2
    snapshot = rows.live_rows(log.where(F.col("commit") <= pin), "commit")
    return plain(rows.live_rows(snapshot.unionByName(log.where(F.col("commit") > pin)), "commit"))


@query("select event_type as column_name, cast(user_id as varchar) as key_text, lower(hex(encode(props))) as value_hex, (cast(1 as bigint) << 32) + event_id as new_seq from events")
def migrate_legacy_log(spark, sf):
    legacy = events(spark, sf).select("column", "key", "value", (F.col("seq") * 7).alias("sequence"), F.lit(0).alias("column_hash"), F.lit(0).alias("key_hash"), F.col("seq").alias("position"))
    return migrated(legacy).select(shown("column").alias("column_name"), shown("key").alias("key_text"), F.lower(F.hex("value")).alias("value_hex"), F.col("seq").alias("new_seq"))


@query("with p as (select event_type, user_id, props, event_id from events where event_id <= (select max(event_id) // 2 from events) qualify row_number() over (partition by event_type, user_id order by event_id desc) = 1) select event_type as column_name, cast(user_id as varchar) as key_text, lower(hex(encode(props))) as value_hex from p")
def read_only_snapshot(spark, sf):
    log = events(spark, sf)
    pin = log.agg(F.max("seq")).first()[0] // 2
    return plain(objects.latest_objects(log.where(F.col("seq") <= pin)))


@query("with o as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events) select event_type, max(case when i = least(n - 1, cast(floor(n * 0.5) as bigint)) then value end) as p50, max(case when i = least(n - 1, cast(floor(n * 0.95) as bigint)) then value end) as p95, max(case when i = least(n - 1, cast(floor(n * 0.99) as bigint)) then value end) as p99 from o group by 1")
def nearest_rank_percentiles(spark, sf):
    """sorted[min(n - 1, floor(n * p))]. Equal values are counted first, so a group is its distinct values, summed in order, not an array."""
    counted = table(spark, sf, "events").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    upto = counted.select("event_type", "value", F.sum("n").over(Window.partitionBy("event_type").orderBy("value")).alias("upto"), F.sum("n").over(Window.partitionBy("event_type")).alias("n"))
    place = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p)).cast("long"))
    return upto.groupBy("event_type").agg(*(F.min(F.when(F.col("upto") > place(p), F.col("value"))).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)))
