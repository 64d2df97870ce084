"""Every query of the engine by name, with its SQL counterpart.

Most read the message log made of ``events`` (see ``sources.events_log``); the ledger queries read a
ledger that follows from the log's flushes by fixed rules, given once as a DataFrame and once as SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions import exprs
from tidelake.model import LEDGER
from tidelake.operators import health, ledger, lookups, maintenance, recovery, schema, snapshot
from tidelake.plans import decoding
from tidelake.sources.events_log import event_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The sequence number up to which rows are committed, rows of a flush, and other fixed points.
COMMITTED, BATCH, AS_OF = 7000, 1000, 5000
TARGET = 20_000

_L = """l as (select cast(user_id as varchar) as key, props as value, 'events' as topic, cast(user_id % 4 as integer) as partition,
  cast(row_number() over (partition by user_id % 4 order by event_id) - 1 as bigint) as "offset", epoch_us(ts) // 1000 as timestamp, event_id + 1 as read_lsn from events)"""
_M = f"""{_L}, m as (select cast((read_lsn - 1) // {BATCH} as bigint) as batch_id, topic, partition, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') as event_date,
  min("offset") as min_offset, max("offset") as max_offset, min(read_lsn) as min_lsn, max(read_lsn) as max_lsn, min(timestamp) as first_timestamp, count(*) as row_count from l group by all)"""
_FILE = "'data/' || event_date || '/' || partition || '/' || batch_id || '.parquet'"
_DONE = "batch_id % 5 <> 4 and batch_id % 6 <> 5"
_COMMITTED_FILES = f"""{_M}, f as (select {_FILE} as file_path, * from m where {_DONE} and (batch_id > 2 or not exists (select 1 from m where batch_id = 2)))"""


def query(oracle: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


# --- scans and lookups -------------------------------------------------------------------------


@query(f"with {_L} select * from l")
def raw_decode(spark, sf):
    """The seven columns of a raw table."""
    return event_log(spark, sf)


@query(f"with {_L} select partition, cast(sum(strlen(key) + strlen(value) + strlen(topic) + 24) as bigint) as bytes from l group by 1")
def msg_size_by_partition(spark, sf):
    size = exprs.message_size(F.col("key"), F.col("value"), F.col("topic"))
    return event_log(spark, sf, offsets=False).groupBy("partition").agg(F.sum(size).alias("bytes"))


@query("select event_id + 1 as read_lsn, cast(user_id as varchar) as key, props as value from events where event_id + 1 = 4321")
def lookup_row(spark, sf):
    return lookups.by_lsn(event_log(spark, sf, offsets=False, where=F.col("event_id") == 4320), 4321).select("read_lsn", "key", "value")


@query(f"with {_L} select key, value, topic, partition, \"offset\", timestamp, read_lsn from l where key = '7' order by read_lsn desc limit 1")
def lookup_key_latest(spark, sf):
    return lookups.latest_of_key(event_log(spark, sf), "7").select("key", "value", "topic", "partition", "offset", "timestamp", "read_lsn")


@query(f"with {_L} select key, arg_max(value, read_lsn) as value, arg_max(partition, read_lsn) as partition, arg_max(timestamp, read_lsn) as timestamp, max(read_lsn) as read_lsn from l group by key")
def latest_per_key(spark, sf):
    return lookups.latest_per_key(event_log(spark, sf, offsets=False)).select("key", "value", "partition", "timestamp", "read_lsn")


@query(f'with {_L} select * from l where partition = 2 and "offset" = 11')
def lookup_offset(spark, sf):
    return lookups.by_offset(event_log(spark, sf), 2, 11)


@query(f'with {_L} select * from l where partition = 1 and "offset" between 100 and 200')
def range_offsets(spark, sf):
    return lookups.offset_range(event_log(spark, sf), 1, 100, 200)


@query(f"with {_L} select topic, partition, count(*) as n from l where topic = 'events' group by 1, 2")
def topic_scan(spark, sf):
    return lookups.by_topic(event_log(spark, sf, offsets=False), "events").groupBy("topic", "partition").agg(F.count("*").alias("n"))


@query(f"with {_L} select key, timestamp, read_lsn from l where (select max(timestamp) from l) - timestamp <= 86400000")
def recent_scan(spark, sf):
    log = event_log(spark, sf, offsets=False)
    now = log.agg(F.max("timestamp").alias("now"))
    return lookups.recent(log.join(F.broadcast(now)), F.col("now"), 86_400_000).select("key", "timestamp", "read_lsn")


@query(f"with {_L} select key, value, partition, read_lsn from l where read_lsn <= {AS_OF}")
def as_of_scan(spark, sf):
    return lookups.as_of(event_log(spark, sf, offsets=False), AS_OF).select("key", "value", "partition", "read_lsn")


@query("select cast(max(event_id) + 1 as bigint) as current_lsn, max(event_id) + 1 < 1000000000 as ahead from events")
def ahead_lsn_check(spark, sf):
    return event_log(spark, sf, offsets=False).agg(F.max("read_lsn").alias("current_lsn")).withColumn("ahead", F.col("current_lsn") < 1_000_000_000)


# --- flushes, watermarks, hot and cold -----------------------------------------------------------


@query(f"with {_M} select * from m")
def flush_manifest(spark, sf):
    return snapshot.flush_manifest(event_log(spark, sf), BATCH)


@query(f"with {_M} select * from m where min_lsn <= {AS_OF - 500}")
def files_visible_at(spark, sf):
    return snapshot.files_visible_at(flush_manifest(spark, sf), AS_OF - 500)


def _committed(log: DataFrame) -> DataFrame:
    return snapshot.watermarks(lookups.as_of(log, COMMITTED))


@query(f'with {_L} select topic, partition, max("offset") as committed_offset from l where read_lsn <= {COMMITTED} group by 1, 2')
def partition_watermarks(spark, sf):
    return _committed(event_log(spark, sf))


@query(f"""with {_L}, w as (select partition, max("offset") as committed_offset from l where read_lsn <= {COMMITTED} and partition < 3 group by 1)
select l.topic, l.partition, max(l."offset") as current_offset, max(w.committed_offset) as committed_offset, max(l."offset") - coalesce(max(w.committed_offset), 0) as lag
from l left join w on l.partition = w.partition group by 1, 2""")
def partition_lag(spark, sf):
    log = event_log(spark, sf)
    return snapshot.lag(log, _committed(log.filter("partition < 3"))).select("topic", "partition", "current_offset", "committed_offset", "lag")


@query(f'with {_L}, w as (select partition, max("offset") as o from l where read_lsn <= {COMMITTED} group by 1) select l.* from l left join w on l.partition = w.partition where l."offset" > coalesce(w.o, -1)')
def hot_tail(spark, sf):
    log = event_log(spark, sf)
    return snapshot.hot_tail(log, _committed(log)).select("key", "value", "topic", "partition", "offset", "timestamp", "read_lsn")


@query(f"with {_L} select key, value, partition, \"offset\", read_lsn, case when read_lsn <= {COMMITTED} then 'cold' else 'hot' end as tier from l where read_lsn <= 9000")
def hot_cold_union(spark, sf):
    log = event_log(spark, sf)
    cold = lookups.as_of(log, COMMITTED).withColumn("tier", F.lit("cold"))
    hot = snapshot.hot_tail(log, _committed(log)).withColumn("tier", F.lit("hot"))
    return snapshot.scan(cold, hot, 9000).select("key", "value", "partition", "offset", "read_lsn", "tier")


@query(f"with {_L} select count(*) as visible, count(*) filter (read_lsn <= {COMMITTED}) as cold, count(*) filter (read_lsn > {COMMITTED}) as hot from l")
def visible_counts(spark, sf):
    lsn = F.col("read_lsn")
    return event_log(spark, sf, offsets=False).agg(F.count("*").alias("visible"), F.count_if(lsn <= COMMITTED).alias("cold"), F.count_if(lsn > COMMITTED).alias("hot"))


def _buckets(hourly: bool):
    bucket = lambda spark, sf: event_log(spark, sf, offsets=False).groupBy(exprs.time_bucket(F.col("timestamp"), hourly).alias("bucket"), "partition").agg(F.count("*").alias("n"))
    return bucket


for _name, _hourly, _format in (("time_bucket_daily", False, "%Y-%m-%d"), ("time_bucket_hourly", True, "%Y-%m-%d-%H")):
    QUERIES[_name] = _buckets(_hourly)
    ORACLES[_name] = f"with {_L} select strftime(make_timestamp(timestamp * 1000), '{_format}') as bucket, partition, count(*) as n from l group by 1, 2"


@query(f"""with {_L} select read_lsn, cast(year(make_timestamp(timestamp * 1000)) - 1970 as integer) as y, cast((year(make_timestamp(timestamp * 1000)) - 1970) * 12 + month(make_timestamp(timestamp * 1000)) - 1 as integer) as mo,
cast(timestamp // 86400000 as integer) as d, cast(timestamp // 3600000 as integer) as h, read_lsn - read_lsn % 100 as t100, key[1:1] as k1 from l""")
def partition_transforms(spark, sf):
    t = F.col("timestamp")
    return event_log(spark, sf, offsets=False).select(
        "read_lsn", exprs.transform_year(t).alias("y"), exprs.transform_month(t).alias("mo"), exprs.transform_day(t).alias("d"), exprs.transform_hour(t).alias("h"),
        exprs.transform_truncate(F.col("read_lsn"), 100).alias("t100"), exprs.transform_truncate(F.col("key"), 1, text=True).alias("k1"),
    )


@query()
def partition_bucket(spark, sf):
    """Rows by Murmur3 bucket of their sequence number; a hash that DuckDB lacks."""
    return event_log(spark, sf, offsets=False).groupBy(exprs.transform_bucket(F.col("read_lsn"), 16).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"with {_L} select distinct on (topic, partition, \"offset\") topic, partition, \"offset\", key, read_lsn from (select * from l union all select * from l where read_lsn between 2000 and 3000)")
def dedup_replay(spark, sf):
    """Rows once, though a slice of the log is replayed."""
    log = event_log(spark, sf)
    return log.unionByName(log.filter("read_lsn between 2000 and 3000")).dropDuplicates(["topic", "partition", "offset"]).select("topic", "partition", "offset", "key", "read_lsn")


# --- ledger and recovery ---------------------------------------------------------------------------


def made_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger of the log's flushes: every fifth flush has no snapshot, every fifth or sixth isn't
    completed, every seventh wrote no file, and the table was reset after flush 2."""
    m = flush_manifest(spark, sf)
    path = F.concat(F.lit("data/"), "event_date", F.lit("/"), F.col("partition").cast("string"), F.lit("/"), F.col("batch_id").cast("string"), F.lit(".parquet"))
    files = m.select("*", path.alias("file_path"), (F.col("row_count") * 100).alias("file_size_bytes"))
    batch = m.groupBy("batch_id").agg(F.sum("row_count").alias("row_count"))
    b, done = F.col("batch_id"), "batch_id % 5 <> 4 and batch_id % 6 <> 5"

    def entry(rows: DataFrame, kind: str, place: int, **columns) -> DataFrame:
        have = {"seq": b * 1000 + place, "type": F.lit(kind), "batch_id": b.cast("string")} | columns
        return rows.select(*(have[f.name].cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in LEDGER))

    own = {"database": F.lit("db"), "table": F.lit("events"), "topic": F.col("topic"), "partition": F.col("partition")}
    named = lambda *names: {n: F.col(n) for n in names}
    parts = [
        entry(batch, "FlushBegun", 1, **named("row_count")),
        entry(files.filter("batch_id % 7 <> 3"), "FileWritten", 10, **named("file_path", "file_size_bytes", "row_count")),
        entry(batch.filter("batch_id % 5 <> 4"), "SnapshotMade", 20, snapshot_id=b + 1, row_count=F.col("row_count")),
        entry(batch.filter(done), "FlushDone", 30, snapshot_id=b + 1),
        entry(files.filter(done), "FileCommitted", 40, **own, **named("file_path", "file_size_bytes", "row_count", "min_offset", "max_offset", "min_lsn"), read_lsn=F.col("max_lsn"), snapshot_id=b + 1),
        entry(m.filter(done).groupBy("batch_id", "topic", "partition").agg(F.min("min_offset").alias("lo"), F.max("max_offset").alias("hi")), "RangeCommitted", 50, topic=F.col("topic"), partition=F.col("partition"), first_offset=F.col("lo"), last_offset=F.col("hi"), snapshot_id=b + 1),
        entry(batch.filter("batch_id = 2"), "TableCleared", 999, database=F.lit("db"), table=F.lit("events"), keep_data=F.lit(True)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"with {_M} select cast(batch_id as varchar) as batch_id, cast(sum(row_count) as bigint) as row_count from m where not ({_DONE}) group by 1")
def incomplete_flushes(spark, sf):
    return recovery.incomplete_flushes(made_ledger(spark, sf))


@query(f"with {_M} select cast(batch_id as varchar) as batch_id, {_FILE} as file_path, row_count * 100 as file_size_bytes from m where not ({_DONE}) and batch_id % 5 = 4 and batch_id % 7 <> 3")
def orphan_files_from_log(spark, sf):
    return recovery.orphan_files(made_ledger(spark, sf))


@query(f"with {_M} select topic, partition, max(max_offset) + 1 as start_offset from m where {_DONE} group by 1, 2")
def recovered_offsets(spark, sf):
    return recovery.starting_offsets(made_ledger(spark, sf))


@query(f"with {_COMMITTED_FILES} select file_path, partition, row_count from f")
def reset_replay(spark, sf):
    return ledger.live_files(made_ledger(spark, sf)).select("file_path", "partition", "row_count")


@query(f"""with {_M}, s as (select * from m where {_DONE}), f as (select * from s where (batch_id > 2 or not exists (select 1 from m where batch_id = 2))), o as (select * from m where batch_id % 5 = 4 and batch_id % 7 <> 3),
b as (select distinct batch_id from m), p as (select distinct batch_id, topic, partition from s)
select cast((select count(*) from b) + (select count(*) from m where batch_id % 7 <> 3) + (select count(*) from b where batch_id % 5 <> 4) + (select count(*) from b where {_DONE}) + (select count(*) from s) + (select count(*) from p) + (select count(*) from b where batch_id = 2) as bigint) as entries,
(select count(*) from b) as flushes_started, (select count(*) from b where {_DONE}) as flushes_completed, (select max(batch_id) + 1 from b where batch_id % 5 <> 4) as last_snapshot_id,
(select count(*) from o) as orphan_files, cast(coalesce((select sum(row_count * 100) from o), 0) as bigint) as orphan_bytes, (select count(*) from f) as files, cast(coalesce((select sum(row_count) from f), 0) as bigint) as rows, coalesce((select max(max_lsn) from f), 0) as last_lsn""")
def recovery_summary(spark, sf):
    return recovery.summary(made_ledger(spark, sf))


@query("with l as (select event_id + 1 as seq from events) select cast((seq - 1) // 512 as bigint) as checkpoint, max(seq) as last_seq, count(*) as entries_covered from l group by 1")
def checkpoint_rollup(spark, sf):
    return recovery.checkpoint_groups(event_log(spark, sf, offsets=False).select(F.col("read_lsn").alias("seq")), 512)


@query(f"""with {_M}, c as (select topic, partition, min(min_offset) as lo, max(max_offset) as hi from m where {_DONE} group by batch_id, topic, partition),
a as (select topic, partition, min_offset + 1 as lo, greatest(max_offset - 1, min_offset + 1) as hi from m)
select a.* from a where exists (select 1 from c where c.topic = a.topic and c.partition = a.partition and c.lo <= a.lo and c.hi >= a.hi)""")
def idempotency_cover(spark, sf):
    m = flush_manifest(spark, sf)
    done = m.filter("batch_id % 5 <> 4 and batch_id % 6 <> 5").groupBy("batch_id", "topic", "partition").agg(F.min("min_offset").alias("lo"), F.max("max_offset").alias("hi"))
    asked = m.select("topic", "partition", (F.col("min_offset") + 1).alias("lo"), F.greatest(F.col("max_offset") - 1, F.col("min_offset") + 1).alias("hi"))
    return lookups.covered_ranges(asked, done)


@query(f"""with {_M}, c as (select topic, partition, max(max_offset) as last from m where {_DONE} group by 1, 2)
select l.topic, l.partition, l."offset", l.key from l join c on l.topic = c.topic and l.partition = c.partition where l."offset" <= c.last""")
def already_processed(spark, sf):
    log = event_log(spark, sf)
    last = recovery.last_offsets(made_ledger(spark, sf)).withColumnRenamed("last_offset", "last")
    return lookups.already_processed(log, last).select("topic", "partition", "offset", "key")


# --- schemas -----------------------------------------------------------------------------------------


_MIXED = """select case when event_id % 3 = 0 then '{"a":' || event_id || ',"b":"' || event_type || '"}' when event_id % 3 = 1 then '{"a":' || event_id || '.5,"c":true,"d":"2024-01-02"}' else '{"a":null,"e":' || (event_id * 1000000) || ',"d":"2024-01-02"}' end as value from events"""


def _mixed_json(spark, sf):
    e, n = spark.read.parquet(f"{sf}/events.parquet"), F.col("event_id").cast("string")
    text = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"a":'), n, F.lit(',"b":"'), "event_type", F.lit('"}')))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"a":'), n, F.lit('.5,"c":true,"d":"2024-01-02"}')))
        .otherwise(F.concat(F.lit('{"a":null,"e":'), (F.col("event_id") * 1_000_000).cast("string"), F.lit(',"d":"2024-01-02"}')))
    )
    return e.select(text.alias("value"))


_JSON_TYPE = """case json_type(value, '$.' || k) when 'NULL' then null when 'BOOLEAN' then 'boolean' when 'DOUBLE' then 'double' when 'VARCHAR' then
  case when regexp_matches(value ->> ('$.' || k), '^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}') then 'timestamptz' when regexp_matches(value ->> ('$.' || k), '^\\d{4}-\\d{2}-\\d{2}$') then 'date' else 'string' end
  else case when cast(value ->> ('$.' || k) as bigint) between -2147483648 and 2147483647 then 'int' else 'long' end end"""


@query(f"with v as ({_MIXED}), k as (select value, unnest(json_keys(value)) as k from v) select k as name, {_JSON_TYPE} as type, count(*) as n from k group by 1, 2")
def json_field_types(spark, sf):
    return schema.json_values(_mixed_json(spark, sf), "value").groupBy("name", "type").agg(F.count("*").alias("n"))


@query(f"""with v as ({_MIXED}), k as (select value, unnest(json_keys(value)) as k from v), t as (select k as name, {_JSON_TYPE} as type from k),
s as (select name, count(*) as seen, count(*) filter (type is null) as nulls, list(distinct type) filter (type is not null) as kinds from t group by 1)
select name, case when list_contains(kinds, 'double') then 'double' when list_contains(kinds, 'long') or (list_contains(kinds, 'int') and len(kinds) > 1) then 'long' when len(kinds) = 1 then kinds[1] else 'string' end as type,
seen = (select count(*) from v) and nulls = 0 as required, seen, nulls from s""")
def json_required(spark, sf):
    return schema.infer(_mixed_json(spark, sf))


_OLD = [("id", "long", True), ("amount", "int", False), ("note", "string", False), ("gone", "date", False), ("flag", "boolean", False), ("score", "double", False), ("must", "int", False)]
_NEW = [("id", "long", True), ("amount", "long", False), ("note", "int", False), ("flag", "date", False), ("score", "int", False), ("team", "string", False), ("key", "string", True), ("must", "int", True)]


@query("""select * from (values ('id','long','long','same',false), ('amount','int','long','promoted',false), ('note','string','int','fits',false), ('gone','date',null,'removed',true),
('flag','boolean','date','incompatible',true), ('score','double','int','fits',false), ('team',null,'string','added',false), ('key',null,'string','added',true), ('must','int','int','requiredness',true)) t(name, old_type, new_type, change, breaking)""")
def schema_diff(spark, sf):
    kind = "name string, type string, required boolean"
    return schema.diff(spark.createDataFrame(_OLD, kind), spark.createDataFrame(_NEW, kind))


@query("""with t as (select unnest(['boolean','int','long','float','double','string','date','timestamptz','uuid']) as x)
select a.x as from_type, b.x as to_type, a.x = b.x or b.x = 'string' or (a.x = 'int' and b.x in ('long','float','double')) or (a.x in ('float','long') and b.x = 'double') as promotes,
a.x = b.x or b.x = 'string' or (b.x = 'long' and a.x = 'int') or (b.x = 'double' and a.x in ('float','int','long')) or (b.x = 'float' and a.x = 'int') as fits from t a cross join t b""")
def promotion_matrix(spark, sf):
    return schema.promotion_matrix(spark)


@query("with n as (select distinct event_type from events) select 10 as id, 'driver' as name union all select 11, 'lap' union all select cast(11 + row_number() over (order by event_type) as integer), event_type from n")
def evolved_field_ids(spark, sf):
    old = spark.createDataFrame([(10, "driver"), (11, "lap")], "id int, name string")
    new = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("name"), F.col("event_type").alias("place")).distinct()
    return maintenance.field_numbers(old, new)


@query(f"with {_L} select key, read_lsn, null::varchar as team from l where read_lsn % 2 = 1 union all by name select key, read_lsn, 'blue' as team from l where read_lsn % 2 = 0")
def union_by_name_nulls(spark, sf):
    log = event_log(spark, sf, offsets=False).select("key", "read_lsn")
    return log.filter("read_lsn % 2 = 1").unionByName(log.filter("read_lsn % 2 = 0").withColumn("team", F.lit("blue")), allowMissingColumns=True)


# --- windows of event time and the largest --------------------------------------------------------


@query("""select epoch_us(time_bucket(interval 1 hour, ts)) // 1000 as window_start, event_type, count(*) as events, cast(count(distinct user_id) as bigint) as users
from events group by all""")
def event_windows(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type", "user_id")
    hourly = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type")
    return hourly.agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users")).select(F.unix_millis("w.start").alias("window_start"), "event_type", "events", "users")


@query("select user_id, count(*) as events, max(event_id) as last_event from events group by user_id order by events desc, user_id limit 10")
def busiest_users(spark, sf):
    """A top-k report: the limit is the feature; ties go to the smaller id."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id")
    return events.groupBy("user_id").agg(F.count("*").alias("events"), F.max("event_id").alias("last_event")).orderBy(F.desc("events"), "user_id").limit(10)


# --- maintenance -------------------------------------------------------------------------------------


_FILES = f"{_M}, o as (select row_number() over (order by row_count * 100, batch_id, partition, event_date) as file_id, row_count * 100 as size, batch_id, first_timestamp from m)"


def _sized_files(spark, sf):
    from pyspark.sql import Window

    m = flush_manifest(spark, sf)
    order = Window.orderBy(F.col("row_count") * 100, "batch_id", "partition", "event_date")  # files of the table
    return m.select(F.row_number().over(order).cast("long").alias("file_id"), (F.col("row_count") * 100).alias("size"), "batch_id", "first_timestamp")


@query(f"with {_FILES} select file_id, size from o where size < 8000")
def compaction_candidates(spark, sf):
    return maintenance.candidates(_sized_files(spark, sf), 8000).select("file_id", "size")


@query(f"""with recursive {_FILES}, b as (select file_id, size, 0::bigint as bin, size as cur from o where file_id = 1 union all
select o.file_id, o.size, case when b.cur + o.size > {TARGET} then b.bin + 1 else b.bin end, case when b.cur + o.size > {TARGET} then o.size else b.cur + o.size end from b join o on o.file_id = b.file_id + 1)
select file_id, size, bin from b where bin in (select bin from b group by bin having count(*) > 1)""")
def compaction_groups(spark, sf):
    return maintenance.bins(_sized_files(spark, sf).select("file_id", "size"), TARGET)


@query(f"with {_FILES} select count(*) as files, cast(sum(size) as bigint) as bytes, cast(sum(size) // 12 as bigint) as saved from o")
def compaction_savings(spark, sf):
    return maintenance.savings(_sized_files(spark, sf))


_SNAPS = f"{_M}, s as (select batch_id + 1 as snapshot_id, max(first_timestamp) as timestamp from m group by batch_id)"


def _snapshots(spark, sf):
    return flush_manifest(spark, sf).groupBy((F.col("batch_id") + 1).alias("snapshot_id")).agg(F.max("first_timestamp").alias("timestamp"))


_NOW = 1_800_000_000_000


@query(f"with {_SNAPS}, c as (select arg_max(snapshot_id, timestamp) as c from s) select snapshot_id, timestamp from s, c where snapshot_id <> c and timestamp < {_NOW} - 86400000")
def expire_candidates(spark, sf):
    return maintenance.expired(_snapshots(spark, sf), _NOW, 86_400_000)


@query(f"""with {_SNAPS}, c as (select arg_max(snapshot_id, timestamp) as c from s), g as (select snapshot_id from s, c where snapshot_id <> c and timestamp < {_NOW} - 86400000),
f as (select batch_id + 1 as snapshot_id, row_count * 100 as size, batch_id % 3 <> 0 as live from m where batch_id + 1 in (select snapshot_id from g))
select (select count(*) from g) as snapshots, count(*) filter (not live) as files, cast(coalesce(sum(size) filter (not live), 0) as bigint) as bytes, count(*) filter (live) as kept_files from f""")
def expiration_impact(spark, sf):
    """What goes with the expired snapshots, if every third flush's files have been replaced."""
    files = flush_manifest(spark, sf).select((F.col("batch_id") + 1).alias("snapshot_id"), (F.col("row_count") * 100).alias("size"), (F.col("batch_id") % 3 != 0).alias("live"))
    return maintenance.expiration_impact(maintenance.expired(_snapshots(spark, sf), _NOW, 86_400_000), files)


_LISTED = """select {path} as path, {size} as size, {mtime} as mtime from {m}"""
_KINDS = "case batch_id % 5 when 0 then 'data/f' || batch_id || '-' || partition || event_date || '.parquet' when 1 then 'metadata/snap-' || batch_id || partition || event_date || '-x.avro' when 2 then 'metadata/a-manifest-' || batch_id || partition || event_date || '.avro' when 3 then 'x/statistics/' || batch_id || partition || event_date else 'y/' || batch_id || partition || event_date end"


def _listing(spark, sf):
    m = flush_manifest(spark, sf)
    b, p, d = F.col("batch_id").cast("string"), F.col("partition").cast("string"), F.col("event_date")
    path = (
        F.when(F.col("batch_id") % 5 == 0, F.concat(F.lit("data/f"), b, F.lit("-"), p, d, F.lit(".parquet"))).when(F.col("batch_id") % 5 == 1, F.concat(F.lit("metadata/snap-"), b, p, d, F.lit("-x.avro")))
        .when(F.col("batch_id") % 5 == 2, F.concat(F.lit("metadata/a-manifest-"), b, p, d, F.lit(".avro"))).when(F.col("batch_id") % 5 == 3, F.concat(F.lit("x/statistics/"), b, p, d)).otherwise(F.concat(F.lit("y/"), b, p, d))
    )
    return m.select(path.alias("path"), (F.col("row_count") * 100).alias("size"), F.col("first_timestamp").alias("mtime"), "partition")


_ORPHANS = f"""{_M}, f as (select {_KINDS} as path, row_count * 100 as size, first_timestamp as mtime, partition from m), x as (select path, size, mtime,
case when path like '%.parquet' then 'data' when regexp_matches(path, '/snap-[^/]*\\.avro$') then 'manifest_list' when regexp_matches(path, 'manifest[^/]*\\.avro$') then 'manifest' when path like '%/statistics%' then 'statistics' else 'unknown' end as class from f where partition > 0 and mtime < {_NOW})"""


@query(f"with {_ORPHANS} select * from x")
def orphans(spark, sf):
    listed = _listing(spark, sf)
    return maintenance.orphans(listed.drop("partition"), listed.filter("partition = 0"), _NOW)


@query(f"with {_ORPHANS} select class, count(*) as files, cast(sum(size) as bigint) as bytes from x group by 1")
def orphan_summary(spark, sf):
    return maintenance.orphan_summary(orphans(spark, sf))


@query("""select 'user_id' as "column", cast(min(user_id) as varchar) as min, cast(max(user_id) as varchar) as max, count(*) filter (user_id is null) as nulls, count(distinct user_id) as "distinct" from events
union all select 'event_type', min(event_type), max(event_type), count(*) filter (event_type is null), count(distinct event_type) from events
union all select 'event_id', cast(min(event_id) as varchar), cast(max(event_id) as varchar), count(*) filter (event_id is null), count(distinct event_id) from events""")
def column_stats(spark, sf):
    return maintenance.column_stats(spark.read.parquet(f"{sf}/events.parquet"), ["user_id", "event_type", "event_id"], exact=True)


# --- metrics -----------------------------------------------------------------------------------------


@query("""with d as (select value * 10 as ms from events), b as (select unnest([100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0, 'infinity'::double]) as le)
select le, count(*) filter (ms <= le) as n from b, d group by le""")
def flush_histogram(spark, sf):
    return health.histogram(spark.read.parquet(f"{sf}/events.parquet").select((F.col("value") * 10).alias("ms")), "ms", (100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0))


@query("select event_type as error_type, count(*) as n from events where value > 100 group by 1")
def errors_by_type(spark, sf):
    return health.count_by(spark.read.parquet(f"{sf}/events.parquet").filter("value > 100").select(F.col("event_type").alias("error_type")), "error_type")


@query("""with c as (select user_id, max(case when value > 400 then 2 when value > 100 then 1 else 0 end) as s from events group by 1)
select case max(s) when 2 then 'unhealthy' when 1 then 'degraded' else 'healthy' end as status, count(*) as components, count(*) filter (s = 2) as unhealthy, count(*) filter (s = 1) as degraded from c""")
def health_rollup(spark, sf):
    v = F.col("value")
    severity = F.when(v > 400, "unhealthy").when(v > 100, "degraded").otherwise("healthy")
    return health.rollup(spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("component"), severity.alias("status")))


@query("select event_type, count(*) filter (value > 50) as ok, count(*) as n, coalesce(count(*) filter (value > 50) / nullif(count(*), 0), 1.0) as rate from events group by 1")
def success_rate(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("ok"), F.count("*").alias("n")).withColumn("rate", F.coalesce(F.try_divide("ok", "n"), F.lit(1.0)))


@query("select range as attempt, cast(least(30000, 100 * 2 ** least(range, 20)) as bigint) as wait_ms from range(0, 30)")
def backoff_schedule(spark, sf):
    return spark.range(30).select(F.col("id").alias("attempt"), exprs.backoff_ms(F.col("id")).alias("wait_ms"))


# --- decoding ----------------------------------------------------------------------------------------


@query("select event_id + 1 as read_lsn, cast(101 + event_id % 2 as bigint) as schema_id from events")
def frame_schema_id(spark, sf):
    """Schema ids read from framed messages by expressions alone."""
    framed = decoding.framed_events(spark, sf)
    return framed.select("read_lsn", exprs.frame_schema_id(F.col("value")).alias("schema_id"))


@query("""select event_id + 1 as read_lsn, user_id as user_id, event_type, value as amount, cast(101 + event_id % 2 as integer) as _schema_id, case when event_id % 2 = 1 then 'blue' end as team,
case when event_id % 3 = 0 then '{"field":"status_text","field_number":7,"value":"ok"}' when event_id % 3 = 1 then '{"field":"status_code","field_number":8,"value":' || (event_id % 1000) || '}' end as status_json from events""")
def proto_decode(spark, sf):
    """Framed Protobuf of two schema versions, decoded to the newer one's columns."""
    return decoding.decoded_events(spark, sf).select("read_lsn", "user_id", "event_type", "amount", "_schema_id", "team", "status_json")


@query("""select case when event_id % 3 = 0 then 'status_text' when event_id % 3 = 1 then 'status_code' end as field, count(*) as n from events group by 1""")
def oneof_json(spark, sf):
    return decoding.decoded_events(spark, sf).groupBy(F.get_json_object("status_json", "$.field").alias("field")).agg(F.count("*").alias("n"))


@query()
def file_crc32(spark, sf):
    """CRC-32 and size of the files of the log's table."""
    files = spark.read.format("binaryFile").load(f"{sf}/events.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", exprs.file_crc32(F.col("content")).alias("crc32"))


# --- the full Spark surface on a snapshot ------------------------------------------------------------


@query("""select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(18, 2))) as decimal(28, 2)) as sum_qty, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(spark, sf):
    item = spark.read.parquet(f"{sf}/lineitem.parquet").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return item.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("sum_qty"), F.count("*").alias("n"))


@query("""select n_name, count(*) as orders, count(distinct o_custkey) as customers from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1""")
def orders_by_nation(spark, sf):
    t = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"))


@query(f"with {_L} select key, read_lsn, timestamp - lag(timestamp) over (partition by key order by read_lsn) as gap from l")
def gaps_per_key(spark, sf):
    from pyspark.sql import Window

    by_key = Window.partitionBy("key").orderBy("read_lsn")
    return event_log(spark, sf, offsets=False).select("key", "read_lsn", (F.col("timestamp") - F.lag("timestamp").over(by_key)).alias("gap"))
