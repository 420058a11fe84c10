"""Queries of the data-processing problems 1 to 7, each over its whole tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import compaction, drift, history, incremental, late, quotient, versions
from tidemark.session import shared_folder
from tidemark.streaming.totals import TotalsStream


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all machines share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """What a run takes that follows the runs of the ledger: its committed output."""
    log, runs = table(spark, d, "feature_log"), table(spark, d, "consumer_runs")
    consumer = incremental.IncrementalConsumer(spark, _folder(spark, "p1"))
    consumer.run(log, incremental.snapshot_limit(log), lambda new: incremental.open_messages(new, runs))
    return consumer.output()


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    """Three runs, each up to a third more of the flushes, the second tried twice: every row once, with its run."""
    log = table(spark, d, "feature_log").select("delivery_no", "batch_no")
    consumer, last = incremental.IncrementalConsumer(spark, _folder(spark, "p1")), incremental.snapshot_limit(log)
    for i, limit in enumerate((last // 3, 2 * last // 3, 2 * last // 3, last)):
        consumer.run(log, limit, lambda new, i=i: new.withColumn("run", F.lit(i)))
    return consumer.output()


def p1_watermarks(spark: SparkSession, d: str) -> DataFrame:
    """How far each shard is done, and up to which flush."""
    done = incremental.done_ranges(table(spark, d, "consumer_runs"))
    return done.groupBy("shard").agg(F.max(F.struct("done_ms", "done_seq")).alias("w"), F.max("seen_batch_no").alias("seen_batch_no"), F.count(F.lit(1)).alias("n_ranges")).select("shard", "w.done_ms", "w.done_seq", "seen_batch_no", "n_ranges")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return quotient.repeated_deliveries(table(spark, d, "feature_log"))


def p2_messages(spark: SparkSession, d: str) -> DataFrame:
    return quotient.distinct_messages(table(spark, d, "feature_log")).select("delivery_no", "entity_id", "event_time_ns", "msg_id_ms", "msg_id_seq")


def _loads(updates: DataFrame) -> list[tuple[DataFrame, int]]:
    """The updates as two loads, split at the middle of their arrivals; late ones are in the second."""
    lo, hi = updates.agg(F.min("msg_id_ms"), F.max("msg_id_ms")).first()
    mid = (lo + hi) // 2
    first = F.col("msg_id_ms").isNull() | (F.col("msg_id_ms") <= mid)
    return [(updates.where(first), mid), (updates.where(~first), hi)]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Versions after two loads into a stored ledger, the second of which splits and supersedes what the first recorded."""
    u = table(spark, d, "item_updates")
    v = history.item_versions(_loads(u), history.HistoryLedger(spark, _folder(spark, "p3")))
    return v.select("entity_id", "valid_from_ns", "valid_to_ns")


def _text(c: str) -> Column:
    """A float as text of nine digits, by which every single-precision value differs; NaN is a value like any other."""
    x = F.col(c).cast("double")
    return F.when(F.isnan(x), "NaN").when(x.isNotNull(), F.format_string("%.8e", x)).alias(c)


def p3_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The whole ledger after the two loads; superseded rows are in it. Prices are text, so that NaN can be compared."""
    ledger = history.HistoryLedger(spark, _folder(spark, "p3"))
    for updates, at in _loads(table(spark, d, "item_updates")):
        ledger.load(updates, at)
    return ledger.ledger().select("entity_id", "valid_from_ns", "valid_to_ns", _text("price"), "quantity", "recorded_from", "recorded_to")


def _late(spark: SparkSession, d: str) -> late.KeyedTotals:
    return late.run(table(spark, d, "feature_log"), late.KeyedTotals(spark, _folder(spark, "p4")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Upserts of the keyed state that revised a closed window."""
    return late.revisions(_late(spark, d)).select("entity_id", "event_date", "batch_no")


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    return _late(spark, d).totals().select("entity_id", "event_date", "n_messages", "clicks", "n_late", "n_revisions")


def p4_dropped(spark: SparkSession, d: str) -> DataFrame:
    return _late(spark, d).dropped()


def p4_stream(spark: SparkSession, d: str) -> DataFrame:
    """The totals of a stream over the log's files, copies taken out across its micro-batches."""
    stream = TotalsStream(spark, _folder(spark, "p4"))
    files = f"{d}/feature_log.parque[t]"  # a pattern: the table may be a folder or a file
    stream.start(files, table(spark, d, "feature_log").schema, 8).awaitTermination()
    return stream.totals().select("entity_id", "event_date", "n_messages", "clicks", "n_late")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return versions.known_at(table(spark, d, "feature_log"), table(spark, d, "training_queries"), []).select("query_id", "msg_id_ms", "msg_id_seq")


def p5_features(spark: SparkSession, d: str) -> DataFrame:
    """Every query with the features known at its time, nulls where there is no answer."""
    q = table(spark, d, "training_queries")
    got = versions.known_at(table(spark, d, "feature_log"), q, ["age", "clicks", "ltv", "score"]).drop("entity_id", "as_of_time", "event_time_ns")
    return q.join(got, "query_id", "left").select("query_id", "label", "fold", "msg_id_ms", "msg_id_seq", "age", "clicks", _text("ltv"), _text("score"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.drift_report(table(spark, d, "schema_fields"), table(spark, d, "upgrade_log"))


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    """The typed values of all records against the last fields of their schema, older names followed through their renames."""
    f = table(spark, d, "schema_fields")
    target = drift.latest_target(f)
    long = drift.table_long(drift.unified(table(spark, d, "drift_records"), target, drift.final_names(f)), target)
    return long.select("record_id", "schema_name", "entity_id", "event_time_ns", "field_name", "rescued", "whole", _text("number"), F.size("vector").alias("n_elements"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return compaction.plan_merges(table(spark, d, "log_files")).select("file_no")


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """What the plan merges in each partition, and whether a chunk's outputs differ by more than its largest file."""
    p = compaction.plan_merges(table(spark, d, "log_files"))
    g = p.groupBy("part", "chunk_no", "group_no").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"), F.max("n_bytes").alias("largest"))
    c = g.groupBy("part", "chunk_no").agg(*[F.sum(x).alias(x) for x in ("n_files", "n_rows", "n_bytes")], (F.max("n_bytes") - F.min("n_bytes") > F.max("largest")).alias("uneven"))
    return c.groupBy("part").agg(*[F.sum(x).alias(x) for x in ("n_files", "n_rows", "n_bytes")], F.max("uneven").alias("uneven"))


def p7_messages(spark: SparkSession, d: str) -> DataFrame:
    """Every message once with the partition that its file is merged in."""
    out = compaction.compacted(table(spark, d, "feature_log"), table(spark, d, "log_files"))
    return out.select("delivery_no", "out_part", F.col("out_group").isNotNull().alias("merged"))


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    """The log stored in 16 files a day, merged and published: every row of it as readers see it afterwards."""
    log, root = table(spark, d, "feature_log"), _folder(spark, "p7")
    log.select("delivery_no", "entity_id", "event_date").repartition(64, "event_date", F.col("file_no") % 16).write.partitionBy("event_date").parquet(root)
    files = compaction.list_files(spark, root)
    t = compaction.CompactionTable(spark, root)
    t.init(files.select("file_path"))
    t.merge(compaction.plan_merges(files, small_bytes=64 << 20))
    return t.read().select("delivery_no", "entity_id", F.col("event_date").cast("string").alias("event_date"))


QUERIES = {f.__name__: f for f in (p1_found, p1_runs, p1_watermarks, p2_found, p2_messages, p3_found, p3_ledger, p4_found, p4_totals, p4_dropped, p4_stream, p5_found, p5_features, p6_found, p6_table, p7_found, p7_groups, p7_messages, p7_table)}

_E = "lower(trim(entity_id, ' ' || chr(9)))"
_DAY_NO = "((event_time_ns - ((event_time_ns % 86400000000000) + 86400000000000) % 86400000000000) // 86400000000000)"
_DAY = f"strftime(date '1970-01-01' + cast({_DAY_NO} as integer), '%Y-%m-%d')"
_KEPT = f"""
kept as (select * from (select *, {_E} e, row_number() over (partition by msg_id_ms, msg_id_seq, {_E} order by delivery_no) rn
  from feature_log where msg_id_ms is not null and msg_id_seq is not null) where rn = 1)"""
_CLASS = f"""
classed as (select *, {_DAY} event_date_, msg_id_ms - ({_DAY_NO} + 1) * 86400000 late from kept)"""
_POINTS = """
pts as (select * from (select *, row_number() over (partition by entity_id, event_time_ns order by msg_id_ms desc, msg_id_seq desc, update_no) rn from {0}) where rn = 1)"""
_FIELDS = """
f as (select distinct schema_name, file_seq, field_name, field_pos,
  case lower(dtype) when '1' then 'f32' when 'float32' then 'f32' when '2' then 'f64' when 'float64' then 'f64' when '3' then 'i32' when 'int32' then 'i32'
    when '4' then 'i64' when 'int64' then 'i64' when '5' then 'u8' when 'uint8' then 'u8' else lower(dtype) end dt,
  coalesce(array_to_string(regexp_extract_all(shape, '[0-9]+'), 'x'), '') dims from schema_fields)"""
_SMALL = """
last as (select * from (select *, row_number() over (partition by file_no order by listed_ms desc, listing_no desc) rn from log_files) where rn = 1),
small as (select *, url_decode(replace(regexp_extract(file_path, 'event_date=([^/]*)/', 1), '+', '%2B')) part from last
  where replaced_by is null and n_rows > 0 and n_bytes < 65536 and not ('/' || file_path like '%/\\_tmp/%' escape '\\'))"""
_TEXT = "case when isnan({0}) then 'NaN' when isinf({0}) then case when {0} > 0 then 'Infinity' else '-Infinity' end when {0} is not null then printf('%.8e', cast({0} as double)) end"
_IDENT = f"row_number() over (partition by msg_id_ms, msg_id_seq, {_E}, case when msg_id_ms is null then event_time_ns end order by delivery_no)"

SQL = {
    "p1_found": f"""
with d as (select l.msg_id_ms, l.msg_id_seq, {_E} entity_id,
    exists (select 1 from consumer_runs r where r.shard = l.shard and r.status in ('committed', 'failed') and r.done_ms is not null
      and (r.lo_ms < l.msg_id_ms or (r.lo_ms = l.msg_id_ms and r.lo_seq < l.msg_id_seq))
      and (l.msg_id_ms < r.done_ms or (l.msg_id_ms = r.done_ms and l.msg_id_seq <= r.done_seq)) and l.batch_no <= r.seen_batch_no) done
  from feature_log l where l.msg_id_ms is not null)
select msg_id_ms, msg_id_seq, entity_id from d group by all having not bool_or(done)""",
    "p1_runs": """
select delivery_no, batch_no, cast(case when batch_no <= m // 3 then 0 when batch_no <= 2 * m // 3 then 1 else 3 end as integer) run
from feature_log, (select max(batch_no) m from feature_log) where batch_no is not null""",
    "p1_watermarks": """
with r as (select distinct shard, lo_ms, lo_seq, done_ms, done_seq, seen_batch_no from consumer_runs where status in ('committed', 'failed') and done_ms is not null and (lo_ms, lo_seq) < (done_ms, done_seq))
select shard, max(row(done_ms, done_seq))[1] done_ms, max(row(done_ms, done_seq))[2] done_seq, max(seen_batch_no) seen_batch_no, count(*) n_ranges from r group by shard""",
    "p2_found": f"select delivery_no from (select delivery_no, {_IDENT} rn from feature_log) where rn > 1",
    "p2_messages": f"select delivery_no, entity_id, event_time_ns, msg_id_ms, msg_id_seq from (select *, {_IDENT} rn from feature_log) where rn = 1",
    "p3_found": f"""
with {_POINTS.format("item_updates")},
s as (select *, lag(update_no) over w is null or price is distinct from lag(price) over w or quantity is distinct from lag(quantity) over w st from pts window w as (partition by entity_id order by event_time_ns))
select entity_id, event_time_ns valid_from_ns, coalesce(lead(event_time_ns) over (partition by entity_id order by event_time_ns), -1) valid_to_ns from s where st""",
    "p3_ledger": f"""
with m as (select (min(msg_id_ms) + max(msg_id_ms)) // 2 mid, max(msg_id_ms) hi from item_updates),
u1 as (select item_updates.* from item_updates, m where msg_id_ms <= mid),
{_POINTS.format("u1").replace("pts as", "p1 as")},
a as (select entity_id, event_time_ns f, coalesce(lead(event_time_ns) over (partition by entity_id order by event_time_ns), -1) t, price, quantity, msg_id_ms, msg_id_seq from p1),
{_POINTS.format("item_updates").replace("pts as", "p2 as")},
b as (select entity_id, event_time_ns f, coalesce(lead(event_time_ns) over (partition by entity_id order by event_time_ns), -1) t, price, quantity, msg_id_ms, msg_id_seq from p2)
select coalesce(a.entity_id, b.entity_id) entity_id, coalesce(a.f, b.f) valid_from_ns, coalesce(a.t, b.t) valid_to_ns, {_TEXT.format('coalesce(a.price, b.price)')} price, coalesce(a.quantity, b.quantity) quantity,
  case when a.f is null then hi else mid end recorded_from, case when b.f is null then hi else -1 end recorded_to
from a full join b on a.entity_id = b.entity_id and a.f = b.f and a.t = b.t and a.msg_id_ms = b.msg_id_ms and a.msg_id_seq = b.msg_id_seq cross join m""",
    "p4_found": f"with {_KEPT}, {_CLASS} select distinct e entity_id, event_date_ event_date, batch_no from classed where late >= 0 and late < 172800000",
    "p4_totals": f"""
with {_KEPT}, {_CLASS}
select e entity_id, event_date_ event_date, count(*) n_messages, cast(sum(clicks) as bigint) clicks, count_if(late >= 0) n_late, count(distinct case when late >= 0 then batch_no end) n_revisions
from classed where late < 172800000 group by 1, 2""",
    "p4_stream": f"""
with {_KEPT}, {_CLASS}
select e entity_id, event_date_ event_date, count(*) n_messages, cast(sum(clicks) as bigint) clicks, count_if(late >= 0) n_late from classed where late < 172800000 group by 1, 2""",
    "p4_dropped": f"with {_KEPT}, {_CLASS} select msg_id_ms, msg_id_seq, e entity_id, event_time_ns, event_date_ event_date, batch_no from classed where late >= 172800000",
    "p5_found": f"""
with {_KEPT}
select query_id, msg_id_ms, msg_id_seq from (select q.query_id, k.msg_id_ms, k.msg_id_seq, row_number() over (partition by q.query_id order by k.event_time_ns desc, k.msg_id_ms desc, k.msg_id_seq desc) r
  from (select *, {_E} qe from training_queries) q join kept k on q.qe = k.e and k.event_time_ns <= q.as_of_time and k.event_time_ns >= q.as_of_time - 604800000000000 and k.msg_id_ms * 1000000 <= q.as_of_time) where r = 1""",
    "p5_features": f"""
with {_KEPT},
a as (select * from (select q.query_id, k.msg_id_ms, k.msg_id_seq, k.age, k.clicks, k.ltv, k.score, row_number() over (partition by q.query_id order by k.event_time_ns desc, k.msg_id_ms desc, k.msg_id_seq desc) r
  from (select *, {_E} qe from training_queries) q join kept k on q.qe = k.e and k.event_time_ns <= q.as_of_time and k.event_time_ns >= q.as_of_time - 604800000000000 and k.msg_id_ms * 1000000 <= q.as_of_time) where r = 1)
select q.query_id, label, fold, msg_id_ms, msg_id_seq, age, clicks, {_TEXT.format("ltv")} ltv, {_TEXT.format("score")} score from training_queries q left join a using (query_id)""",
    "p6_found": f"""
with {_FIELDS},
files as (select schema_name, file_seq, lag(file_seq) over (partition by schema_name order by file_seq) prev from (select distinct schema_name, file_seq from f)),
n as (select f.*, prev from f join files using (schema_name, file_seq) where prev is not null),
o as (select f.schema_name, files.file_seq, field_name, field_pos, dt, dims from f join files on f.schema_name = files.schema_name and f.file_seq = files.prev),
added as (select n.* from n anti join o using (schema_name, file_seq, field_name)),
gone as (select o.* from o anti join n using (schema_name, file_seq, field_name)),
bytes as (select schema_name, file_seq, case dt when 'f32' then 4 when 'i32' then 4 when 'f64' then 8 when 'i64' then 8 else 1 end * coalesce(list_product(list_transform(string_split(nullif(dims, ''), 'x'), lambda x: cast(x as bigint))), 1) b from f),
sizes as (select schema_name, file_seq, sum(b) plain, sum(ceil(b / 64.0) * 64) padded from bytes group by all)
select schema_name, file_seq, field_name, case when exists (select 1 from gone g where g.schema_name = a.schema_name and g.file_seq = a.file_seq and g.field_pos = a.field_pos and g.dt = a.dt and g.dims = a.dims) then 'renamed' else 'added' end change_kind from added a
union select schema_name, file_seq, field_name, 'removed' from gone g where not exists (select 1 from added a where g.schema_name = a.schema_name and g.file_seq = a.file_seq and g.field_pos = a.field_pos and g.dt = a.dt and g.dims = a.dims)
union select n.schema_name, n.file_seq, n.field_name, 'retyped' from n join o using (schema_name, file_seq, field_name) where n.dt <> o.dt
union select n.schema_name, n.file_seq, n.field_name, 'reshaped' from n join o using (schema_name, file_seq, field_name) where n.dims <> o.dims
union select schema_name, file_seq, '*', 'size' from upgrade_log u join sizes using (schema_name, file_seq) where row_size_bytes_new <> case when dry_run then plain else padded end""",
    "p6_table": f"""
with recursive {_FIELDS.replace("f as (", "f0 as (").strip()},
f as (select schema_name, file_seq, field_name, v.field_pos, v.dt, v.dims from (select schema_name, file_seq, field_name, min(struct_pack(field_pos := field_pos, dt := dt, dims := dims)) v from f0 group by all)),
files as (select *, row_number() over (partition by schema_name order by file_seq) k, count(*) over (partition by schema_name) last from (select distinct schema_name, file_seq from f)),
g as (select f.*, k, last from f join files using (schema_name, file_seq)),
came as (select n.schema_name, n.k, n.field_pos, n.dt, n.dims, min(n.field_name) field_name, count(*) c from g n where k > 1 and not exists (select 1 from g o where o.schema_name = n.schema_name and o.k = n.k - 1 and o.field_name = n.field_name) group by all),
went as (select o.schema_name, o.k + 1 k, o.field_pos, o.dt, o.dims, min(o.field_name) field_name, count(*) c from g o where o.k < o.last and not exists (select 1 from g n where n.schema_name = o.schema_name and n.k = o.k + 1 and n.field_name = o.field_name) group by all),
ren as (select a.schema_name, a.k, b.field_name old_name, a.field_name new_name from came a join went b using (schema_name, k, field_pos, dt, dims) where a.c = 1 and b.c = 1),
walk as (select schema_name, file_seq, field_name source_name, field_name cur, k, last from g
  union all select w.schema_name, w.file_seq, w.source_name, coalesce(r.new_name, n.field_name), w.k + 1, w.last
  from walk w left join ren r on r.schema_name = w.schema_name and r.k = w.k + 1 and r.old_name = w.cur
  left join g n on n.schema_name = w.schema_name and n.k = w.k + 1 and n.field_name = w.cur
  where w.k < w.last and coalesce(r.new_name, n.field_name) is not null),
target as (select schema_name, field_name, dt, dims from g where k = last),
ends as (select g.schema_name, g.file_seq, g.field_name source_name, w.cur from g left join walk w on w.schema_name = g.schema_name and w.file_seq = g.file_seq and w.source_name = g.field_name and w.k = w.last),
told as (select e.schema_name, e.file_seq, e.source_name, coalesce(e.cur, case when not exists (select 1 from ends o where o.schema_name = e.schema_name and o.file_seq = e.file_seq and o.cur = e.source_name) then t.field_name end) field_name
  from ends e left join target t on t.schema_name = e.schema_name and t.field_name = e.source_name),
kv as (select record_id, r.schema_name, r.file_seq, k.unnest as key, json_extract_string(payload, '$."' || k.unnest || '"') as v from drift_records r, unnest(json_keys(payload)) k),
j as (select kv.*, told.source_name is null as other, case when told.source_name is null then kv.key else told.field_name end as looked from kv left join told on told.schema_name = kv.schema_name and told.file_seq = kv.file_seq and told.source_name = kv.key where v is not null),
x as (select j.*, t.field_name, t.dt, t.dims, case when t.field_name is null then false
    when t.dims = '' and t.dt in ('f32', 'f64') then try_cast(trim(v) as double) is not null
    when t.dims = '' then regexp_full_match(trim(v), '[+-]?[0-9]+') and case t.dt when 'i32' then try_cast(v as integer) is not null when 'i64' then try_cast(v as bigint) is not null else try_cast(v as integer) between 0 and 255 end
    else starts_with(v, '[') and len(regexp_extract_all(v, '-?[0-9.eE+-]+|NaN')) = list_product(list_transform(string_split(t.dims, 'x'), lambda y: cast(y as bigint))) end ok
  from j left join target t on t.schema_name = j.schema_name and t.field_name = j.looked),
y as (select *, ok and row_number() over (partition by record_id, field_name, ok order by other, key) = 1 typed from x)
select r.record_id, r.schema_name, r.entity_id, r.event_time_ns, case when typed then field_name else key end field_name, not typed rescued,
  case when typed and dims = '' and dt in ('i32', 'i64', 'u8') then cast(v as bigint) end whole,
  case when typed and dims = '' and dt in ('f32', 'f64') then case when isnan(cast(trim(v) as double)) then 'NaN' when isinf(cast(trim(v) as double)) then case when cast(trim(v) as double) > 0 then 'Infinity' else '-Infinity' end when dt = 'f32' then printf('%.8e', cast(cast(trim(v) as float) as double)) else printf('%.8e', cast(trim(v) as double)) end end number,
  case when typed and dims <> '' then cast(len(regexp_extract_all(v, '-?[0-9.eE+-]+|NaN')) as integer) end n_elements
from drift_records r left join y using (record_id)""",
    "p7_groups": f"""with {_SMALL}, m as (select * from small where part <> '' qualify count(*) over (partition by part) > 1)
select part, cast(count(*) as bigint) n_files, cast(sum(n_rows) as bigint) n_rows, cast(sum(n_bytes) as bigint) n_bytes, false uneven from m group by 1""",
    "p7_messages": f"""with {_SMALL}, m as (select file_no, part from small where part <> '' qualify count(*) over (partition by part) > 1)
select delivery_no, part out_part, part is not null merged from (select delivery_no, file_no, {_IDENT} copy from feature_log) l left join m using (file_no) where copy = 1""",
    "p7_table": "select delivery_no, entity_id, event_date from feature_log",
    "p7_found": f"with {_SMALL} select file_no from small where part <> '' qualify count(*) over (partition by part) > 1",
}
