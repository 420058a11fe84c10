"""Attributes as they were known at the time of a query.

A row becomes visible when it has both happened and arrived. Over each entity's rows in order of visibility the greatest
(event time, message id) so far is the state; wherever it rises, the entity has a new version. A query gets the number of
versions that were visible by its time, counted over narrow timestamp rows, and then meets the wide attributes by an
equi-join on entity and number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import DAY_NS, entity_key
from tidemark.operators.dedup import has_id
from tidemark.operators.skew import HOT_ROWS, hot_keys, with_blocks, within

_LEAST = -(1 << 63)


def _once(changes: DataFrame, queries: DataFrame) -> DataFrame:
    """Changes and queries in one shuffle by entity; of the copies of a message the kept row remains."""
    both = changes.withColumn("_side", F.lit(0)).unionByName(queries.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    best = F.min(F.struct(F.col("_d").isNull().alias("_n"), "_d", "_t", "_w", "_at"))
    one = both.repartition("_e").groupBy("_e", "_side", "_ms", "_seq", "_q").agg(best.alias("_k"))
    s = F.when(F.col("_side") == 0, F.struct("_k._t", "_ms", "_seq")).alias("_s")
    return one.where((F.col("_side") == 1) | F.col("_k._t").isNotNull()).select("_e", F.lit(-1).alias("_blk"), s, "_k._w", "_k._at", "_side", "_q")


def _in_blocks(changes: DataFrame, queries: DataFrame, hot: DataFrame) -> DataFrame:
    """The same where entities are hot: copies are taken out by message, and hot entities are cut into blocks of visibility,
    each of which starts with a copy of the state that the blocks before it reached."""
    best = F.min(F.struct(F.col("_d").isNull().alias("_n"), "_d", "_t", "_w", "_at"))
    kept = changes.groupBy("_ms", "_seq", "_e").agg(best.alias("_k")).select("_e", "_ms", "_seq", "_k._t", "_k._w", "_k._at").where(F.col("_t").isNotNull())
    rows = kept.withColumn("_side", F.lit(0)).unionByName(queries.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rows = with_blocks(rows, "_e", "_at", hot).withColumn("_s", F.when(F.col("_side") == 0, F.struct("_t", "_ms", "_seq")))
    rows = rows.select("_e", "_blk", "_s", "_w", "_at", "_side", "_q")
    top = F.max(F.when(F.col("_side") == 0, F.struct("_s", "_w")))
    reached = rows.where(F.col("_blk") >= 0).groupBy("_e", "_blk").agg(top.alias("_x"))
    before = F.max("_x").over(Window.partitionBy("_e").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1))
    start = reached.select("_e", "_blk", before.alias("_x")).where(F.col("_x").isNotNull())
    start = start.select("_e", "_blk", "_x._s", "_x._w", F.lit(_LEAST).cast("bigint").alias("_at"), F.lit(0).alias("_side"))
    return rows.unionByName(start, allowMissingColumns=True)


def _counted(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Queries, and changes that start a version and have one, with ``_no``, the count of versions so far."""
    w = Window.partitionBy(*within("_e", hot)).orderBy("_at", "_side", "_s")
    best = F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rose = (F.col("_side") == 0) & (F.col("_best").isNull() | (F.col("_s") > F.col("_best")))
    rows = rows.withColumn("_best", best).withColumn("_rose", rose)
    rows = rows.withColumn("_no", F.sum(F.col("_rose").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # without the changes that start no version, a version has queries when the row after it is one
    rows = rows.where(F.col("_rose") | (F.col("_side") == 1)).withColumn("_asked", F.lead("_side").over(w) == 1)
    return rows.where((F.col("_rose") & F.col("_asked")) | ((F.col("_side") == 1) & (F.col("_no") > 0)))


def numbered(changes: DataFrame, queries: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Version numbers. changes: _e, _at (visible from), _t, _ms, _seq, _d (delivery), _w (attributes); queries: _e, _at, _q.

    Returns versions that some query has (_e, _blk, _no, _t, _ms, _seq, _w) and queries (_e, _blk, _no, _at, _q), which meet by
    _e, _blk and _no. Only entities with very many changes or queries are split; the others take the short way.
    """
    hot = hot_keys(changes.select("_e", "_at").unionByName(queries.select("_e", "_at")), "_e", "_at", hot_rows)
    if hot is None:
        parts = [_counted(_once(changes, queries), None)]
    else:
        names = F.broadcast(hot.select(F.col("_hot").alias("_e")))
        side = lambda how: (changes.join(names, "_e", how), queries.join(names, "_e", how))
        parts = [_counted(_once(*side("left_anti")), None), _counted(_in_blocks(*side("left_semi"), hot), hot)]
    vers = [p.where(F.col("_side") == 0).select("_e", "_blk", "_no", "_s._t", "_s._ms", "_s._seq", "_w") for p in parts]
    qs = [p.where(F.col("_side") == 1).select("_e", "_blk", "_no", "_at", "_q") for p in parts]
    return reduce(DataFrame.unionByName, vers), reduce(DataFrame.unionByName, qs)


def known_at(log: DataFrame, queries: DataFrame, fields: list[str], lookback_ns: int = 7 * DAY_NS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each query that has an answer, with the kept row that held and had arrived at its ``as_of_time``.

    Columns: query_id, entity_id, as_of_time, event_time_ns, msg_id_ms, msg_id_seq and ``fields`` of the log. The answer is
    the candidate with the greatest (event_time_ns, msg_id_ms, msg_id_seq) of those with
    as_of_time - lookback <= event_time_ns <= as_of_time that had arrived by then. Queries without entity or time have
    none. ``query_id`` must be unique; repeated pairs of entity and time are answered each. The attributes travel with the
    changes, so that the log is shuffled once; only versions that a query has reach the join, which is on entity and number
    alone.
    """
    asked = queries.select(entity_key("entity_id").alias("_e"), F.col("as_of_time").alias("_at"), F.col("query_id").alias("_q")).where(F.col("_e").isNotNull() & F.col("_at").isNotNull())
    arrived = F.coalesce(F.try_multiply("msg_id_ms", F.lit(1_000_000)), F.when(F.col("msg_id_ms") < 0, F.lit(_LEAST)))
    wide = F.struct(*fields) if fields else F.lit(None).cast("int")
    changes = log.where(has_id()).select(
        entity_key("entity_id").alias("_e"), F.greatest("event_time_ns", arrived).alias("_at"), F.col("event_time_ns").alias("_t"), F.col("msg_id_ms").alias("_ms"), F.col("msg_id_seq").alias("_seq"),
        F.col("delivery_no").alias("_d"), wide.alias("_w"), arrived.isNotNull().alias("_ok"),
    ).where(F.col("_e").isNotNull() & F.col("_ok")).drop("_ok")
    vers, qs = numbered(changes, asked, hot_rows)
    met = qs.join(vers, ["_e", "_blk", "_no"]).where(F.try_subtract("_at", "_t") <= lookback_ns)
    return met.select(
        F.col("_q").alias("query_id"), F.col("_e").alias("entity_id"), F.col("_at").alias("as_of_time"), F.col("_t").alias("event_time_ns"), F.col("_ms").alias("msg_id_ms"), F.col("_seq").alias("msg_id_seq"),
        *[F.col(f"_w.{c}").alias(c) for c in fields],
    )
