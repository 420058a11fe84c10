"""Queries of the feature-store operators over events, lineitem, orders, customer and embeddings, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import DAY_NS, day_bucket, msg_id_parts, ns_of, safe_name, stable_id
from tidemark.lifecycle import hydrate, upgrade_schema
from tidemark.operators import features as ops
from tidemark.operators.validate import checked, split_valid
from tidemark.schema import DType, FeatureField, FeatureSchema
from tidemark.session import shared_folder
from tidemark.sources import FeatureLog, OnlineTable
from tidemark.streaming.consumer import Consumer

LINE_IDS = ("l_orderkey", "l_linenumber", "l_partkey")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a feature log: entity = user, message id = event id."""
    e = _t(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("entity_id"), ns_of("ts").alias("event_time_ns"), "value", F.col("event_id").alias("msg_id_ms"), F.lit(0).alias("msg_id_seq"), "event_type")


def line_log(spark: SparkSession, d: str) -> DataFrame:
    """Line items as a log with many ties: entity = supplier, time = ship date."""
    x = _t(spark, d, "lineitem")
    return x.select(F.col("l_suppkey").cast("string").alias("entity_id"), ns_of("l_shipdate").alias("event_time_ns"), "l_quantity", "l_extendedprice", *LINE_IDS)


def views(spark: SparkSession, d: str) -> DataFrame:
    return events_log(spark, d).where(F.col("event_type") == "view").drop("event_type")


def spine(spark: SparkSession, d: str) -> DataFrame:
    """Purchases as queries."""
    return events_log(spark, d).where(F.col("event_type") == "purchase").select(F.col("msg_id_ms").alias("qid"), "entity_id", F.col("event_time_ns").alias("as_of_time"))


def _pit(days: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = ops.as_of_join(views(spark, d), spine(spark, d), ["value"], days * DAY_NS)
        return out.select("qid", F.col("msg_id_ms").alias("event_id"), "value")

    return run


def pit_query_order(spark: SparkSession, d: str) -> DataFrame:
    """The rows in the order of the queries; ``pos`` is the place of each."""
    out = ops.as_of_join(views(spark, d), spine(spark, d), ["value"], 7 * DAY_NS, order="qid")
    return out.select("qid", F.col("msg_id_ms").alias("event_id"), "value")


def pit_wide(spark: SparkSession, d: str) -> DataFrame:
    """Many fields: found by narrow keys, met afterwards."""
    wide = views(spark, d).select("*", *[(F.col("value") * i).alias(f"v{i}") for i in range(2, 22)])
    fields = ["value", *[f"v{i}" for i in range(2, 22)]]
    out = ops.as_of_join(wide, spine(spark, d), fields, 7 * DAY_NS)
    return out.select("qid", F.col("msg_id_ms").alias("event_id"), "value", "v2", "v21")


def pit_ties(spark: SparkSession, d: str) -> DataFrame:
    """Ties on the day are broken by the line's ids; queries: every order's date for the suppliers of the next key."""
    q = _t(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), (F.col("o_custkey") % 100 + 1).cast("string").alias("entity_id"), ns_of("o_orderdate").alias("as_of_time"))
    out = ops.as_of_join(line_log(spark, d), q, ["l_quantity", "l_extendedprice"], 30 * DAY_NS, LINE_IDS)
    return out.select("qid", *LINE_IDS, "l_quantity", "l_extendedprice")


def pit_duplicate_queries(spark: SparkSession, d: str) -> DataFrame:
    q = spine(spark, d)
    return ops.as_of_join(views(spark, d), q.unionAll(q), ["value"], 7 * DAY_NS).select("qid", "value")


def pit_extra_columns(spark: SparkSession, d: str) -> DataFrame:
    q = spine(spark, d).withColumns({"label": (F.col("qid") % 2).cast("int"), "fold": (F.col("qid") % 5).cast("int")})
    return ops.as_of_join(views(spark, d), q, ["value"], 7 * DAY_NS).select("qid", "label", "fold", "value")


def pit_unknown_entity(spark: SparkSession, d: str) -> DataFrame:
    q = spine(spark, d).withColumn("entity_id", F.concat(F.lit("x"), "entity_id"))
    return ops.as_of_join(views(spark, d), q, ["value"], 7 * DAY_NS).select("qid", "value")


def log_dedup_msg_id(spark: SparkSession, d: str) -> DataFrame:
    log = events_log(spark, d)
    return ops.dedup_by_message(log.unionAll(log.where(F.col("msg_id_ms") % 10 == 0))).select("msg_id_ms", "entity_id", "value")


def log_dedup_natural_key(spark: SparkSession, d: str) -> DataFrame:
    return ops.dedup_by_time(line_log(spark, d), ["l_extendedprice", "l_quantity", "l_orderkey"]).select("entity_id", day_bucket("event_time_ns").alias("day"), "l_extendedprice", "l_quantity", "l_orderkey")


def latest_features(spark: SparkSession, d: str) -> DataFrame:
    return ops.latest(events_log(spark, d), ["value"]).select("entity_id", "msg_id_ms", "value")


def latest_ties(spark: SparkSession, d: str) -> DataFrame:
    return ops.latest(line_log(spark, d), ["l_quantity"], ids=LINE_IDS).select("entity_id", *LINE_IDS, "l_quantity")


def latest_as_of_snapshot(spark: SparkSession, d: str) -> DataFrame:
    log = events_log(spark, d)
    at = log.agg(((F.min("event_time_ns") + F.max("event_time_ns")) / 2).cast("bigint")).first()[0] // DAY_NS * DAY_NS
    return ops.latest(log, ["value"], at).select("entity_id", "msg_id_ms", "value")


def latest_lookback(spark: SparkSession, d: str) -> DataFrame:
    log = events_log(spark, d)
    at = log.agg(F.max("event_time_ns")).first()[0]
    return ops.latest(log, ["value"], at, 2 * DAY_NS).select("entity_id", "msg_id_ms", "value")


def distinct_entities(spark: SparkSession, d: str) -> DataFrame:
    return ops.distinct_entities(events_log(spark, d))


def window_scan(spark: SparkSession, d: str) -> DataFrame:
    log = line_log(spark, d).withColumn("event_date", day_bucket("event_time_ns"))
    lo = 800_000_000 * 1_000_000_000
    return ops.window_scan(log, lo, lo + 100 * DAY_NS).select("entity_id", "event_date", *LINE_IDS)


def day_bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    return events_log(spark, d).groupBy(day_bucket("event_time_ns").alias("event_date")).agg(F.count(F.lit(1)).alias("n_rows"))


def asof_minmax_window(spark: SparkSession, d: str) -> DataFrame:
    return spine(spark, d).agg(F.min(day_bucket("as_of_time")).alias("first_day"), F.max(day_bucket("as_of_time")).alias("last_day"), F.count(F.lit(1)).alias("n_queries"))


def online_last_arrival(spark: SparkSession, d: str) -> DataFrame:
    log = line_log(spark, d)
    return ops.last_arrival(log, ["l_quantity"], LINE_IDS).select("entity_id", *LINE_IDS, "l_quantity")


def late_skew(spark: SparkSession, d: str) -> DataFrame:
    """Entities whose last arrival is not their newest row."""
    a = ops.last_arrival(line_log(spark, d), [], LINE_IDS)
    b = ops.latest(line_log(spark, d), [], ids=LINE_IDS).select(F.col("entity_id").alias("_e"), *[F.col(c).alias(f"new_{c}") for c in LINE_IDS])
    same = (F.col("l_orderkey") == F.col("new_l_orderkey")) & (F.col("l_linenumber") == F.col("new_l_linenumber")) & (F.col("l_partkey") == F.col("new_l_partkey"))
    return a.join(b, F.col("entity_id") == F.col("_e")).where(~same).select("entity_id", "l_orderkey", "new_l_orderkey")


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    log = events_log(spark, d).drop("event_type")
    return ops.last_arrival(log.where(F.col("msg_id_ms") % 2 == 0), ["value"]), log.where(F.col("msg_id_ms") % 2 == 1)


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    current, batch = _halves(spark, d)
    return ops.upsert(current, batch).select("entity_id", "msg_id_ms", "value")


def upsert_new_vs_update_counts(spark: SparkSession, d: str) -> DataFrame:
    current, batch = _halves(spark, d)
    return ops.upsert_counts(current, batch)


ACCOUNT = FeatureSchema("Account", 1, [FeatureField("nation", DType.INT32), FeatureField("balance", DType.FLOAT64), FeatureField("key", DType.INT64)])
WIDE = FeatureSchema("Account", 2, [FeatureField("nation", DType.INT64), FeatureField("balance", DType.FLOAT64), FeatureField("key", DType.INT64), FeatureField("score", DType.FLOAT32), FeatureField("hist", DType.FLOAT64, (3,))])
EMBEDDED = FeatureSchema("Embedded", 1, [FeatureField("label", DType.INT32), FeatureField("embedding", DType.FLOAT32, (64,))])


def accounts(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("entity_id"), F.lit(0).cast("bigint").alias("event_time_ns"), F.col("c_nationkey").cast("int").alias("nation"), F.col("c_acctbal").cast("double").alias("balance"), F.col("c_custkey").cast("bigint").alias("key"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    """A request per order; keys shifted, so that some have no account."""
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), (F.col("o_custkey") + 100).cast("string").alias("entity_id"))


def batch_assemble(spark: SparkSession, d: str) -> DataFrame:
    v = ops.assemble_batch(requests(spark, d), accounts(spark, d), ACCOUNT)
    return v.select("qid", *[F.get("vector", F.lit(i)).cast("double").alias(n) for i, n in enumerate(("nation", "balance", "key"))])


def batch_found_mask(spark: SparkSession, d: str) -> DataFrame:
    return ops.assemble_batch(requests(spark, d), accounts(spark, d), ACCOUNT).select("qid", "found")


def batch_semi(spark: SparkSession, d: str) -> DataFrame:
    return ops.found(requests(spark, d), accounts(spark, d))


def batch_anti(spark: SparkSession, d: str) -> DataFrame:
    return ops.missing(requests(spark, d), accounts(spark, d))


def entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A point lookup."""
    return accounts(spark, d).where(F.col("entity_id") == "7").select("entity_id", "nation", "balance")


def assemble_declaration_order(spark: SparkSession, d: str) -> DataFrame:
    s = FeatureSchema("Pinned", 1, [FeatureField("key", DType.INT64), FeatureField("balance", DType.FLOAT64), FeatureField("nation", DType.INT32)])
    v = ops.assemble(accounts(spark, d), s)
    return v.select("entity_id", F.posexplode("vector").alias("pos", "x")).select("entity_id", "pos", F.col("x").cast("double").alias("x"))


def embedded(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("entity_id"), F.col("label").cast("int").alias("label"), "embedding")


def assemble_embedding(spark: SparkSession, d: str) -> DataFrame:
    v = ops.assemble(embedded(spark, d), EMBEDDED)
    return v.select("entity_id", F.posexplode("vector").alias("pos", "x")).select("entity_id", "pos", F.col("x").cast("double").alias("x"))


def assemble_flat_2d(spark: SparkSession, d: str) -> DataFrame:
    """A field of shape (8, 8) is flattened row by row."""
    s = FeatureSchema("Matrix", 1, [FeatureField("m", DType.FLOAT32, (8, 8))])
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    v = ops.assemble(embedded(spark, d).select("entity_id", rows.alias("m")), s)
    return v.select("entity_id", F.posexplode("vector").alias("pos", "x")).select("entity_id", "pos", F.col("x").cast("double").alias("x"))


def cast_float32(spark: SparkSession, d: str) -> DataFrame:
    x = _t(spark, d, "lineitem")
    return x.select("l_orderkey", "l_partkey", F.col("l_extendedprice").cast("float").cast("double").alias("price"), F.col("l_orderkey").cast("float").cast("double").alias("okey"))


def widen_types(spark: SparkSession, d: str) -> DataFrame:
    return ops.translate(accounts(spark, d), ACCOUNT, WIDE).select("entity_id", "nation", "balance")


def zero_fill_new_field(spark: SparkSession, d: str) -> DataFrame:
    t = ops.translate(accounts(spark, d), ACCOUNT, WIDE)
    return t.select("entity_id", F.col("score").cast("double").alias("score"), F.size("hist").alias("n"), F.get("hist", F.lit(2)).alias("h2"))


def upgrade_translate(spark: SparkSession, d: str) -> DataFrame:
    v = ops.assemble(ops.translate(accounts(spark, d), ACCOUNT, WIDE), WIDE)
    return v.select("entity_id", F.size("vector").alias("width"), F.get("vector", F.lit(2)).cast("double").alias("key"))


def hydrate_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The table that hydration would publish: latest rows, as vectors."""
    s = FeatureSchema("Value", 1, [FeatureField("value", DType.FLOAT64)])
    v = ops.assemble(ops.latest(events_log(spark, d), ["value"]), s)
    return v.select("entity_id", F.get("vector", F.lit(0)).cast("double").alias("x"))


LINE = FeatureSchema("Line", 1, [FeatureField("quantity", DType.UINT8), FeatureField("price", DType.FLOAT32), FeatureField("partkey", DType.INT32)])


def raw_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with some values out of range, and some entities empty or missing."""
    x = _t(spark, d, "lineitem")
    k = F.col("l_orderkey")
    return x.select(
        F.when(k % 11 == 0, "").when(k % 13 == 0, None).otherwise(F.col("l_suppkey").cast("string")).alias("entity_id"),
        ns_of("l_shipdate").alias("event_time_ns"),
        F.when(k % 7 == 0, F.col("l_quantity") + 300).otherwise(F.col("l_quantity")).alias("quantity"),
        F.when(k % 5 == 0, F.lit(1e39)).when(k % 17 == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice")).alias("price"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("l_partkey")).alias("partkey"),
        k.alias("msg_id_ms"),
        "l_linenumber",
    ).withColumnRenamed("l_linenumber", "msg_id_seq")


def validate_good(spark: SparkSession, d: str) -> DataFrame:
    good, _ = split_valid(raw_lines(spark, d), LINE)
    return good.select("entity_id", "msg_id_ms", "msg_id_seq", F.col("quantity").cast("int").alias("quantity"), "partkey")


def validate_reasons(spark: SparkSession, d: str) -> DataFrame:
    return checked(raw_lines(spark, d), LINE).groupBy("_reason").agg(F.count(F.lit(1)).alias("n_rows")).select(F.coalesce("_reason", F.lit("ok")).alias("reason"), "n_rows")


def shard_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every row has one of 16 shards, and no entity has two."""
    s = ops.shard(events_log(spark, d), 16)
    per = s.groupBy("entity_id").agg(F.count_distinct("shard").alias("k"), F.min("shard").alias("lo"), F.max("shard").alias("hi"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.count_if(F.col("k") != 1).alias("n_split"), F.count_if(~F.col("lo").between(0, 15) | ~F.col("hi").between(0, 15)).alias("n_outside"))


def value_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per event type, as benchmark reports take them."""
    return events_log(spark, d).groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.99), 6).alias("p99"), F.count(F.lit(1)).alias("n_rows"))


def id_crc(spark: SparkSession, d: str) -> DataFrame:
    """Name sanitising, byte lengths and checksums of ids."""
    c = _t(spark, d, "customer")
    return c.select("c_custkey", safe_name("c_name").alias("safe_name"), F.octet_length("c_name").cast("bigint").alias("n_bytes"), F.crc32("c_name").alias("crc"))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that other systems can compute from the names."""
    return _t(spark, d, "customer").select("c_custkey", stable_id("c_name").alias("id"))


def msg_id_parse(spark: SparkSession, d: str) -> DataFrame:
    """Message ids written as ms-seq, parsed again."""
    e = events_log(spark, d).select(F.concat_ws("-", "msg_id_ms", "msg_id_seq").alias("id"))
    ms, seq = msg_id_parts("id")
    return e.select("id", ms.alias("ms"), seq.alias("seq"))


VALUE = FeatureSchema("Value", 1, [FeatureField("value", DType.FLOAT64)])


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all machines share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _value_log(spark: SparkSession, rows: DataFrame) -> FeatureLog:
    log = FeatureLog(spark, _folder(spark, "log"))
    log.append(rows.drop("event_type"), VALUE)
    return log


def log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Events appended to a feature log and read again."""
    return _value_log(spark, events_log(spark, d)).scan(VALUE).select("entity_id", "event_time_ns", "value", "msg_id_ms", "event_date")


def row_counts_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Rows per directory of a feature log."""
    return _value_log(spark, events_log(spark, d)).day_counts(VALUE)


def log_point_in_time(spark: SparkSession, d: str) -> DataFrame:
    """Views in a feature log, read as of the purchases."""
    out = _value_log(spark, views(spark, d)).read_point_in_time(VALUE, spine(spark, d), 7)
    return out.select("qid", F.col("msg_id_ms").alias("event_id"), "value")


def hydrate_table(spark: SparkSession, d: str) -> DataFrame:
    """A current-value table built from the log, read as vectors."""
    log = events_log(spark, d)
    at = log.agg(F.max("event_time_ns")).first()[0]
    online = OnlineTable(spark, _folder(spark, "online"), VALUE)
    hydrate(VALUE, _value_log(spark, log), online, as_of_time_ns=at, lookback_days=10_000)
    return ops.assemble(online.read(), VALUE).select("entity_id", F.get("vector", F.lit(0)).cast("double").alias("x"))


def online_upserts(spark: SparkSession, d: str) -> DataFrame:
    """A table built from one half of the events, with the other half merged in."""
    current, batch = _halves(spark, d)
    t = OnlineTable(spark, _folder(spark, "online"), VALUE)
    t.create(current)
    t.upsert(batch)
    return t.read().select("entity_id", "msg_id_ms", "value")


def upgrade_table(spark: SparkSession, d: str) -> DataFrame:
    """A stored table rewritten under a newer schema."""
    base = _folder(spark, "online")
    OnlineTable(spark, base, ACCOUNT, msg_id=False).create(accounts(spark, d))
    new = OnlineTable(spark, base, WIDE, msg_id=False)
    upgrade_schema(ACCOUNT, WIDE, new)
    return new.read().select("entity_id", "nation", "balance", "key", F.col("score").cast("double").alias("score"), F.size("hist").alias("n"))


def stream_apply(spark: SparkSession, d: str) -> DataFrame:
    """Events as messages of the write-ahead stream, applied by the consumer."""
    base = _folder(spark, "stream")
    e = events_log(spark, d)
    e.select(F.lit("Value").alias("schema"), "entity_id", "event_time_ns", F.to_json(F.struct("value")).alias("payload"), "msg_id_ms", "msg_id_seq").write.json(f"{base}/wal")
    consumer = Consumer(spark, base, [VALUE])
    consumer.drain()
    return consumer.online["Value"].read().select("entity_id", "msg_id_ms", "value")


QUERIES = {
    "pit_inclusive_7d": _pit(7),
    "pit_lookback_1d": _pit(1),
    "pit_30d": _pit(30),
} | {
    f.__name__: f
    for f in (
        pit_query_order, pit_wide, pit_ties, pit_duplicate_queries, pit_extra_columns, pit_unknown_entity, log_dedup_msg_id, log_dedup_natural_key, latest_features, latest_ties,
        latest_as_of_snapshot, latest_lookback, distinct_entities, window_scan, day_bucket_counts, asof_minmax_window, online_last_arrival, late_skew, upsert_merge,
        upsert_new_vs_update_counts, batch_assemble, batch_found_mask, batch_semi, batch_anti, entity_lookup, assemble_declaration_order, assemble_embedding, assemble_flat_2d,
        cast_float32, widen_types, zero_fill_new_field, upgrade_translate, hydrate_snapshot, validate_good, validate_reasons, shard_counts, value_percentiles, id_crc, stable_ids, msg_id_parse,
        log_round_trip, row_counts_by_day, log_point_in_time, hydrate_table, online_upserts, upgrade_table, stream_apply,
    )
}

_EV = "ev as (select cast(user_id as varchar) entity_id, epoch_us(ts) * 1000 t, value, event_id, event_type from events)"
_LN = "ln as (select cast(l_suppkey as varchar) entity_id, epoch_us(l_shipdate) * 1000 t, l_quantity, l_extendedprice, l_orderkey, l_linenumber, l_partkey from lineitem)"
_Q = "q as (select event_id qid, entity_id, t from ev where event_type = 'purchase')"
_V = "v as (select * from ev where event_type = 'view')"


def _pit_sql(days: int, spine_sql: str = _Q, cols: str = "qid, event_id, value") -> str:
    return f"""with {_EV}, {_V}, {spine_sql},
m as (select q.*, v.event_id, v.value, v.t vt from q asof left join v on q.entity_id = v.entity_id and q.t >= v.t)
select {cols} from (select * replace (case when t - vt <= {days * DAY_NS} then event_id end as event_id, case when t - vt <= {days * DAY_NS} then value end as value) from m)"""


_ACC = "acc as (select cast(c_custkey as varchar) entity_id, cast(c_nationkey as integer) nation, cast(c_acctbal as double) balance, cast(c_custkey as bigint) key from customer)"
_REQ = "req as (select o_orderkey qid, cast(o_custkey + 100 as varchar) entity_id from orders)"
_F = "cast(cast({} as float) as double)"
_EMB = "select cast(vec_id as varchar) entity_id, unnest(range({n})) pos, unnest({x}) x from embeddings"
_RAW = """raw as (select case when l_orderkey % 11 = 0 then '' when l_orderkey % 13 = 0 then null else cast(l_suppkey as varchar) end entity_id, case when l_orderkey % 7 = 0 then l_quantity + 300 else l_quantity end quantity,
  case when l_orderkey % 5 = 0 then 1e39 when l_orderkey % 17 = 0 then 'nan'::double else l_extendedprice end price, case when l_orderkey % 3 = 0 then null else l_partkey end partkey, l_orderkey msg_id_ms, l_linenumber msg_id_seq from lineitem),
res as (select *, case when entity_id is null then 'entity:null' when entity_id = '' then 'entity:empty' when quantity <> floor(quantity) or quantity < 0 or quantity > 255 then 'type:quantity'
  when not isnan(price) and abs(price) > 3.5e38 then 'overflow:price' when partkey is null then 'missing:partkey' else 'ok' end reason from raw)"""

SQL = {
    "pit_inclusive_7d": _pit_sql(7),
    "pit_lookback_1d": _pit_sql(1),
    "pit_30d": _pit_sql(30),
    "pit_query_order": _pit_sql(7),
    "pit_wide": _pit_sql(7, cols="qid, event_id, value, value * 2 v2, value * 21 v21"),
    "pit_ties": f"""with {_LN}, b as (select *, row_number() over (partition by entity_id, t order by l_orderkey desc, l_linenumber desc, l_partkey desc) rn from ln), u as (select * from b where rn = 1),
q as (select o_orderkey qid, cast(o_custkey % 100 + 1 as varchar) entity_id, epoch_us(o_orderdate) * 1000 t from orders),
m as (select q.qid, q.t, u.t ut, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice from q asof left join u on q.entity_id = u.entity_id and q.t >= u.t)
select qid, {", ".join(f"case when t - ut <= {30 * DAY_NS} then {c} end {c}" for c in (*LINE_IDS, "l_quantity", "l_extendedprice"))} from m""",
    "pit_duplicate_queries": _pit_sql(7, _Q.replace("q as (", "q0 as (") + ", q as (select * from q0 union all select * from q0)", "qid, value"),
    "pit_extra_columns": _pit_sql(7, cols="qid, cast(qid % 2 as integer) as label, cast(qid % 5 as integer) as fold, value"),
    "pit_unknown_entity": _pit_sql(7, _Q.replace("event_id qid, entity_id", "event_id qid, 'x' || entity_id entity_id"), "qid, value"),
    "log_dedup_msg_id": f"with {_EV} select distinct event_id msg_id_ms, entity_id, value from (select * from ev union all select * from ev where event_id % 10 = 0)",
    "log_dedup_natural_key": f"with {_LN} select entity_id, strftime(make_timestamp(t // 1000), '%Y-%m-%d') as day, l_extendedprice, l_quantity, l_orderkey from (select *, row_number() over (partition by entity_id, t order by l_extendedprice desc, l_quantity desc, l_orderkey desc) rn from ln) where rn = 1",
    "latest_features": f"with {_EV} select entity_id, event_id msg_id_ms, value from (select *, row_number() over (partition by entity_id order by t desc, event_id desc) rn from ev) where rn = 1",
    "latest_ties": f"with {_LN} select entity_id, l_orderkey, l_linenumber, l_partkey, l_quantity from (select *, row_number() over (partition by entity_id order by t desc, l_orderkey desc, l_linenumber desc, l_partkey desc) rn from ln) where rn = 1",
    "latest_as_of_snapshot": f"with {_EV}, s as (select ((min(t) + max(t)) // 2) // {DAY_NS} * {DAY_NS} x from ev) select entity_id, event_id msg_id_ms, value from (select ev.*, row_number() over (partition by entity_id order by t desc, event_id desc) rn from ev, s where t <= x) where rn = 1",
    "latest_lookback": f"with {_EV}, s as (select max(t) x from ev) select entity_id, event_id msg_id_ms, value from (select ev.*, row_number() over (partition by entity_id order by t desc, event_id desc) rn from ev, s where t <= x and t >= x - {2 * DAY_NS}) where rn = 1",
    "distinct_entities": "select distinct cast(user_id as varchar) entity_id from events",
    "window_scan": f"with {_LN} select entity_id, strftime(make_timestamp(t // 1000), '%Y-%m-%d') event_date, l_orderkey, l_linenumber, l_partkey from ln where t between 800000000000000000 and 800000000000000000 + {100 * DAY_NS}",
    "day_bucket_counts": "select strftime(ts, '%Y-%m-%d') event_date, count(*) n_rows from events group by 1",
    "asof_minmax_window": "select strftime(min(ts), '%Y-%m-%d') first_day, strftime(max(ts), '%Y-%m-%d') last_day, count(*) n_queries from events where event_type = 'purchase'",
    "online_last_arrival": f"with {_LN} select entity_id, l_orderkey, l_linenumber, l_partkey, l_quantity from (select *, row_number() over (partition by entity_id order by l_orderkey desc, l_linenumber desc, l_partkey desc) rn from ln) where rn = 1",
    "late_skew": f"""with {_LN}, r as (select *, row_number() over (partition by entity_id order by l_orderkey desc, l_linenumber desc, l_partkey desc) a, row_number() over (partition by entity_id order by t desc, l_orderkey desc, l_linenumber desc, l_partkey desc) b from ln)
select x.entity_id, x.l_orderkey, y.l_orderkey new_l_orderkey from r x join r y on x.entity_id = y.entity_id where x.a = 1 and y.b = 1 and (x.l_orderkey, x.l_linenumber, x.l_partkey) <> (y.l_orderkey, y.l_linenumber, y.l_partkey)""",
    "upsert_merge": f"with {_EV} select entity_id, event_id msg_id_ms, value from (select *, row_number() over (partition by entity_id order by event_id desc) rn from ev) where rn = 1",
    "upsert_new_vs_update_counts": f"with {_EV}, a as (select distinct entity_id from ev where event_id % 2 = 0), b as (select distinct entity_id from ev where event_id % 2 = 1) select count_if(a.entity_id is null) n_new, count_if(a.entity_id is not null) n_updated from b left join a on a.entity_id = b.entity_id",
    "batch_assemble": f"with {_ACC}, {_REQ} select qid, {', '.join(f'coalesce({_F.format(c)}, 0) {c}' for c in ('nation', 'balance', 'key'))} from req left join acc on acc.entity_id = req.entity_id",
    "batch_found_mask": f"with {_ACC}, {_REQ} select qid, acc.entity_id is not null found from req left join acc on acc.entity_id = req.entity_id",
    "batch_semi": f"with {_ACC}, {_REQ} select qid, entity_id from req where entity_id in (select entity_id from acc)",
    "batch_anti": f"with {_ACC}, {_REQ} select qid, entity_id from req where entity_id not in (select entity_id from acc)",
    "entity_lookup": f"with {_ACC} select entity_id, nation, balance from acc where entity_id = '7'",
    "assemble_declaration_order": f"with {_ACC} select entity_id, 0 as pos, {_F.format('key')} x from acc union all select entity_id, 1, {_F.format('balance')} from acc union all select entity_id, 2, {_F.format('nation')} from acc",
    "assemble_embedding": f"with a as ({_EMB.format(n=65, x='list_concat([cast(label as float)], cast(embedding as float[]))')}) select entity_id, cast(pos as integer) pos, cast(x as double) x from a",
    "assemble_flat_2d": f"with a as ({_EMB.format(n=64, x='cast(embedding as float[])')}) select entity_id, cast(pos as integer) pos, cast(x as double) x from a",
    "cast_float32": f"select l_orderkey, l_partkey, {_F.format('l_extendedprice')} price, {_F.format('l_orderkey')} okey from lineitem",
    "widen_types": f"with {_ACC} select entity_id, cast(nation as bigint) nation, balance from acc",
    "zero_fill_new_field": f"with {_ACC} select entity_id, 0.0::double score, 3 n, 0.0::double h2 from acc",
    "upgrade_translate": f"with {_ACC} select entity_id, 7 width, {_F.format('key')} as key from acc",
    "hydrate_snapshot": f"with {_EV} select entity_id, {_F.format('value')} x from (select *, row_number() over (partition by entity_id order by t desc, event_id desc) rn from ev) where rn = 1",
    "validate_good": f"with {_RAW} select entity_id, msg_id_ms, msg_id_seq, cast(quantity as integer) quantity, cast(partkey as integer) partkey from res where reason = 'ok'",
    "validate_reasons": f"with {_RAW} select reason, count(*) n_rows from res group by 1",
    "value_percentiles": "select event_type, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.99), 6) p99, count(*) n_rows from events group by 1",
    "id_crc": """select c_custkey, regexp_replace(c_name, '[^A-Za-z0-9_]', '_', 'g') safe_name, cast(strlen(c_name) as bigint) n_bytes,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c_name, ''), lambda x: cast(ord(x) as bigint))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end))), 4294967295::bigint) crc from customer""",
    "shard_counts": "select count(*) n_rows, 0::bigint n_split, 0::bigint n_outside from events",
    "log_round_trip": f"with {_EV} select entity_id, t event_time_ns, value, event_id msg_id_ms, strftime(make_timestamp(t // 1000), '%Y-%m-%d') event_date from ev",
    "row_counts_by_day": "select strftime(ts, '%Y-%m-%d') event_date, count(*) n_rows from events group by 1",
    "log_point_in_time": _pit_sql(7),
    "hydrate_table": f"with {_EV} select entity_id, {_F.format('value')} x from (select *, row_number() over (partition by entity_id order by t desc, event_id desc) rn from ev) where rn = 1",
    "online_upserts": f"with {_EV} select entity_id, event_id msg_id_ms, value from (select *, row_number() over (partition by entity_id order by event_id desc) rn from ev) where rn = 1",
    "upgrade_table": f"with {_ACC} select entity_id, cast(nation as bigint) nation, balance, key, 0.0::double score, 3 n from acc",
    "stream_apply": f"with {_EV} select entity_id, event_id msg_id_ms, value from (select *, row_number() over (partition by entity_id order by event_id desc) rn from ev) where rn = 1",
    "msg_id_parse": "select event_id || '-0' id, event_id ms, 0 seq from events",
}
