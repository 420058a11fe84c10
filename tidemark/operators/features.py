"""Feature-log operators: deduplication, point-in-time joins, latest rows, vector assembly and batch lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import DAY_NS, day_bucket
from tidemark.operators.skew import HOT_ROWS, hot_keys, with_blocks, within
from tidemark.schema import FeatureSchema

IDS = ("msg_id_ms", "msg_id_seq")
_LEAST = -(1 << 63)


def dedup_by_message(log: DataFrame) -> DataFrame:
    """One row per ``(msg_id_ms, msg_id_seq)``; replays of a message are identical, so any copy is the row."""
    return log.dropDuplicates(list(IDS))


def dedup_by_time(log: DataFrame, fields: list[str]) -> DataFrame:
    """One row per entity and event time, for logs without message ids: the greatest row by its fields, so results repeat.

    NaN is greater than any number and null less.
    """
    g = log.groupBy("entity_id", "event_time_ns").agg(F.max(F.struct(*fields)).alias("_f"))
    return g.select("entity_id", "event_time_ns", *[F.col(f"_f.{c}").alias(c) for c in fields])


def window_scan(log: DataFrame, lo_ns: int, hi_ns: int) -> DataFrame:
    """Rows with lo <= event_time_ns <= hi. The day predicate is added where the log is partitioned by day, so that whole directories are skipped."""
    out = log.where(F.col("event_time_ns").between(lo_ns, hi_ns))
    if "event_date" in log.columns:
        days = log.sparkSession.range(1).select(day_bucket(F.lit(lo_ns)).alias("a"), day_bucket(F.lit(hi_ns)).alias("b")).first()
        out = out.where(F.col("event_date").between(days["a"], days["b"]))
    return out


def query_window(queries: DataFrame, lookback_ns: int) -> tuple[int, int] | None:
    """Least and greatest event time that any query can need; None when there are no queries."""
    lo, hi = queries.agg(F.min("as_of_time"), F.max("as_of_time")).first()
    return None if lo is None else (max(_LEAST, lo - lookback_ns), hi)


#: With more fields than this the newest rows are found by narrow keys, and only theirs meet the wide rows.
CARRIED_FIELDS = 16


def as_of_join(log: DataFrame, queries: DataFrame, fields: list[str], lookback_ns: int = 30 * DAY_NS, ids: tuple[str, ...] = IDS, hot_rows: int = HOT_ROWS, order: str | None = None) -> DataFrame:
    """Each query row with the entity's newest log row at its ``as_of_time``, at most ``lookback_ns`` old, else nulls.

    Both bounds are inclusive; of equal times the greatest ids win. Every query row comes out once, duplicates included,
    with its columns, then event_time_ns, ``fields`` and ids; ``order`` names a column to sort the result by. Log and queries
    are merged in one shuffle by entity and scanned once in order of time; entities that hold very many rows of either are
    cut into blocks of time that start with the last row before them. Queries without entity or time have no match and are
    not shuffled.
    """
    clash = [c for c in ("event_time_ns", *fields, *ids) if c in queries.columns]
    if clash:
        raise ValueError(f"query columns clash with log columns: {clash}")
    out = ["event_time_ns", *fields, *ids]
    wide = len(fields) > CARRIED_FIELDS
    row = F.struct("event_time_ns", *ids, *([] if wide else fields))
    known = log.where(F.col("entity_id").isNotNull() & F.col("event_time_ns").isNotNull())
    asked = queries.where(F.col("entity_id").isNotNull() & F.col("as_of_time").isNotNull())
    f = known.select(F.col("entity_id").alias("_e"), F.col("event_time_ns").alias("_t"), F.lit(0).alias("_side"), row.alias("_f"))
    q = asked.select(F.col("entity_id").alias("_e"), F.col("as_of_time").alias("_t"), F.lit(1).alias("_side"), F.struct(*queries.columns).alias("_q"))
    both = f.unionByName(q, allowMissingColumns=True)
    hot = hot_keys(both, "_e", "_t", hot_rows)
    rows = with_blocks(both, "_e", "_t", hot)
    if hot is not None:
        newest = F.struct("_f.event_time_ns", *[f"_f.{c}" for c in ids])
        ends = rows.where(F.col("_blk") >= 0).groupBy("_e", "_blk").agg(F.max_by("_f", F.when(F.col("_side") == 0, newest)).alias("_f"))
        before = F.last("_f", ignorenulls=True).over(Window.partitionBy("_e").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1))
        start = ends.select("_e", "_blk", before.alias("_f")).where(F.col("_f").isNotNull())
        rows = rows.unionByName(start.select("_e", "_blk", "_f", F.lit(_LEAST).cast("bigint").alias("_t"), F.lit(0).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy(*within("_e", hot)).orderBy("_t", "_side", *[F.col(f"_f.{c}") for c in ids]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = rows.withColumn("_hit", F.last("_f", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    near = F.try_subtract(F.col("_t"), F.col("_hit.event_time_ns")) <= lookback_ns
    hit = hit.select("_q", F.when(near, F.col("_hit")).alias("_hit"))
    if wide:
        names = [f"_k{i}" for i in range(2 + len(ids))]
        keys = [F.col("_hit.event_time_ns"), *[F.col(f"_hit.{c}") for c in ids]]
        hit = hit.select("_q", "_hit", F.col("_q.entity_id").alias(names[0]), *[k.alias(n) for k, n in zip(keys, names[1:], strict=True)])
        mine = known.select(*[F.col(c).alias(n) for c, n in zip(("entity_id", "event_time_ns", *ids), names, strict=True)], F.struct(*fields).alias("_w"))
        met = hit.select(*names).where(F.col(names[1]).isNotNull()).distinct()
        some = mine.join(met, names, "left_semi").groupBy(*names).agg(F.max("_w").alias("_w"))  # equal keys: one row, the same each time
        hit = hit.join(some, names, "left")
    value = lambda c: F.col(f"_w.{c}" if wide and c in fields else f"_hit.{c}").alias(c)
    met = hit.select(*[F.col(f"_q.{c}").alias(c) for c in queries.columns], *[value(c) for c in out])
    rest = queries.where(F.col("entity_id").isNull() | F.col("as_of_time").isNull())
    done = met.unionByName(rest, allowMissingColumns=True)
    return done.orderBy(order) if order else done


def latest(log: DataFrame, fields: list[str], as_of_ns: int | None = None, lookback_ns: int | None = None, ids: tuple[str, ...] = IDS) -> DataFrame:
    """The newest row per entity in [as_of - lookback, as_of]; of equal times the greatest ids. Hot entities collapse before the shuffle."""
    if as_of_ns is not None:
        log = log.where(F.col("event_time_ns") <= as_of_ns)
        if lookback_ns is not None:
            log = log.where(F.col("event_time_ns") >= as_of_ns - lookback_ns)
    cols = ["event_time_ns", *fields, *ids]
    g = log.groupBy("entity_id").agg(F.max_by(F.struct(*cols), F.struct("event_time_ns", *ids)).alias("_f"))
    return g.select("entity_id", *[F.col(f"_f.{c}").alias(c) for c in cols])


def last_arrival(log: DataFrame, fields: list[str], ids: tuple[str, ...] = IDS) -> DataFrame:
    """The row per entity that arrived last (greatest ids), whatever its event time: the rule of the current-value table."""
    cols = ["event_time_ns", *fields, *ids]
    g = log.groupBy("entity_id").agg(F.max_by(F.struct(*cols), F.struct(*ids)).alias("_f"))
    return g.select("entity_id", *[F.col(f"_f.{c}").alias(c) for c in cols])


def distinct_entities(log: DataFrame) -> DataFrame:
    return log.select("entity_id").distinct()


def upsert(current: DataFrame, batch: DataFrame, ids: tuple[str, ...] = IDS) -> DataFrame:
    """Current values with a batch merged in: per entity the row with the greatest ids."""
    cols = [c for c in current.columns if c != "entity_id"]
    g = current.unionByName(batch.select(*current.columns)).groupBy("entity_id").agg(F.max_by(F.struct(*cols), F.struct(*ids)).alias("_f"))
    return g.select("entity_id", *[F.col(f"_f.{c}").alias(c) for c in cols])


def upsert_counts(current: DataFrame, batch: DataFrame) -> DataFrame:
    """How many entities of a batch are new and how many are updates: n_new, n_updated."""
    ids = batch.select("entity_id").distinct()
    seen = current.select(F.col("entity_id").alias("_seen")).distinct()
    return ids.join(seen, F.col("entity_id") == F.col("_seen"), "left").agg(F.count_if(F.col("_seen").isNull()).alias("n_new"), F.count_if(F.col("_seen").isNotNull()).alias("n_updated"))


# --- vectors ---


def vector(schema: FeatureSchema) -> Column:
    """The row as one float array: fields in declaration order, shapes flattened row by row, everything cast to float.

    Integers round, doubles narrow (too large ones become infinite), NaN stays.
    """
    parts = []
    for f in schema.fields:
        c = F.col(f.name)
        for _ in f.shape[1:]:
            c = F.flatten(c)
        parts.append(c.cast("array<float>") if f.shape else F.array(c.cast("float")))
    return F.concat(*parts)


def assemble(table: DataFrame, schema: FeatureSchema) -> DataFrame:
    """entity_id and ``vector`` of each row."""
    return table.select("entity_id", vector(schema).alias("vector"))


def assemble_batch(requests: DataFrame, current: DataFrame, schema: FeatureSchema) -> DataFrame:
    """Each request with ``vector`` and ``found``; a miss has zeros. Duplicates of a request are answered each.

    Requests keep all their columns; Spark chooses the join by the sizes that it finds.
    """
    own = current.select(F.col("entity_id").alias("_id"), vector(schema).alias("_v"))
    zeros = F.array_repeat(F.lit(0).cast("float"), schema.n_elements)
    j = requests.join(own, F.col("entity_id") == F.col("_id"), "left")
    return j.withColumns({"vector": F.coalesce("_v", zeros), "found": F.col("_id").isNotNull()}).drop("_id", "_v")


def found(requests: DataFrame, current: DataFrame) -> DataFrame:
    """Requests that have a current row."""
    return requests.join(current.select(F.col("entity_id").alias("_id")), F.col("entity_id") == F.col("_id"), "left_semi")


def missing(requests: DataFrame, current: DataFrame) -> DataFrame:
    """Requests that have none."""
    return requests.join(current.select(F.col("entity_id").alias("_id")), F.col("entity_id") == F.col("_id"), "left_anti")


def translate(table: DataFrame, old: FeatureSchema, new: FeatureSchema) -> DataFrame:
    """Rows under another schema: kept fields widened, new ones zero, other columns as they are. One projection."""
    cols = []
    for f in new.fields:
        if f.name in old.names:
            cols.append(F.col(f.name).cast(f.cast_type).alias(f.name))
        elif f.shape:
            cols.append(F.array_repeat(F.lit(0).cast(f.dtype.spark_type), f.n_elements).alias(f.name))
        else:
            cols.append(F.lit(0).cast(f.cast_type).alias(f.name))
    lead = [c for c in ("entity_id", "event_time_ns") if c in table.columns]
    tail = [c for c in IDS if c in table.columns]
    return table.select(*lead, *cols, *tail)


def shard(df: DataFrame, n: int) -> DataFrame:
    """Adds ``shard``: a stable hash of the entity modulo ``n``."""
    return df.withColumn("shard", F.pmod(F.xxhash64("entity_id"), F.lit(n)).cast("int"))
