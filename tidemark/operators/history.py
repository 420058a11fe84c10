"""History of changing entity attributes as a bitemporal ledger.

A ledger row says: in ``[valid_from_ns, valid_to_ns)`` the entity had this state, as believed from ``recorded_from`` until
``recorded_to`` (-1: the end is open). A load of updates, late ones included, sweeps the time line of the entities it
touches, splits the intervals that its points fall into and appends what changed. A superseded row is followed by a closing
of it; what has been written stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.skew import HOT_ROWS, hot_keys, neighbours, with_blocks
from tidemark.session import settled
from tidemark.storage import CommitLog, Folder

STATE = ("price", "quantity")


def points(updates: DataFrame, state: tuple[str, ...] = STATE) -> DataFrame:
    """Of rows with the same entity and ``event_time_ns`` the one with the greatest message id.

    Rows without a time have no place on a time line and are left out; a null entity is one entity; repeated rows
    collapse. Equal ids with unlike states: the greatest state counts, so that results repeat.
    """
    best = F.max(F.struct("msg_id_ms", "msg_id_seq", *state))
    g = updates.where(F.col("event_time_ns").isNotNull()).groupBy("entity_id", F.col("event_time_ns").alias("valid_from_ns")).agg(best.alias("_s"))
    return g.select("entity_id", "valid_from_ns", *[F.col(f"_s.{c}").alias(c) for c in ("msg_id_ms", "msg_id_seq", *state)])


def hot_entities(updates: DataFrame, hot_rows: int) -> DataFrame | None:
    """Hot entities with the cuts of their time lines, from the updates as they are."""
    return hot_keys(updates.select("entity_id", F.col("event_time_ns").alias("valid_from_ns")), "entity_id", "valid_from_ns", hot_rows)


def intervals(pts: DataFrame, fields: tuple[str, ...], hot: DataFrame | None) -> DataFrame:
    """Each point with the time of the entity's next point, -1 for the last; ``_prev`` is the point before."""
    n = neighbours(with_blocks(pts, "entity_id", "valid_from_ns", hot), "entity_id", "valid_from_ns", ["valid_from_ns", *fields], hot)
    return n.withColumn("valid_to_ns", F.coalesce(F.col("_next.valid_from_ns"), F.lit(-1).cast("bigint"))).drop("_next")


def _columns(state: tuple[str, ...]) -> list[str]:
    return ["entity_id", "valid_from_ns", "valid_to_ns", *state, "msg_id_ms", "msg_id_seq"]


def additions(current: DataFrame | None, updates: DataFrame, recorded_at: int, state: tuple[str, ...] = STATE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """What a load appends to a ledger: intervals that are new, and closings of those that it supersedes.

    ``current``: the open intervals of (at least) the entities that the load touches, or None. The load's points and those
    of the open intervals are swept together; an interval that stays as it is appends nothing. A closing repeats the
    interval's row with ``recorded_to`` set.
    """
    cols = _columns(state)
    new_row = [F.lit(recorded_at).cast("bigint").alias("recorded_from"), F.lit(-1).cast("bigint").alias("recorded_to")]
    if current is None:
        return intervals(points(updates, state), state, hot_entities(updates, hot_rows)).select(*cols, *new_row)
    touched = updates.where(F.col("event_time_ns").isNotNull()).select(F.col("entity_id").alias("_touched")).distinct()
    old = current.join(touched, F.col("entity_id").eqNullSafe(F.col("_touched")), "left_semi").select(*cols, "recorded_from")
    known = old.select("entity_id", F.col("valid_from_ns").alias("event_time_ns"), *state, "msg_id_ms", "msg_id_seq")
    both = known.unionByName(updates.select(*known.columns))
    swept = intervals(points(both, state), state, hot_entities(both, hot_rows)).select(*cols, F.lit(None).cast("bigint").alias("recorded_from"))
    # old and new intervals meet by all their columns; what is on both sides stays
    sides = old.withColumns({"_old": F.lit(1), "_new": F.lit(0)}).unionByName(swept.withColumns({"_old": F.lit(0), "_new": F.lit(1)}))
    met = sides.groupBy(*cols).agg(F.max("recorded_from").alias("recorded_from"), F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    one = met.where(F.col("_old") != F.col("_new"))
    now = F.lit(recorded_at).cast("bigint")
    return one.select(*cols, F.coalesce("recorded_from", now).alias("recorded_from"), F.when(F.col("_new") == 1, F.lit(-1)).otherwise(now).cast("bigint").alias("recorded_to"))


def settled_rows(appended: DataFrame, state: tuple[str, ...] = STATE) -> DataFrame:
    """The ledger that appended rows amount to: each interval once, with the end of its record if it has been closed."""
    return appended.groupBy(*_columns(state), "recorded_from").agg(F.max("recorded_to").alias("recorded_to"))


def apply_updates(ledger: DataFrame | None, updates: DataFrame, recorded_at: int, state: tuple[str, ...] = STATE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """A ledger held as a table after one more load, recorded at ``recorded_at``. The ledger may be None.

    Columns: entity_id, valid_from_ns, valid_to_ns, the state, msg_id_ms, msg_id_seq, recorded_from, recorded_to.
    Loads must be applied in order of ``recorded_at``; applying one again changes nothing.
    """
    if ledger is None:
        return additions(None, updates, recorded_at, state, hot_rows)
    more = additions(ledger.where(F.col("recorded_to") == -1), updates, recorded_at, state, hot_rows)
    return settled_rows(ledger.unionByName(more), state)


class HistoryLedger:
    """A stored ledger: each load appends its new intervals and closings, by bucket of entities; nothing is overwritten.

    A load reads the buckets of the entities that it touches. It becomes visible by one commit; of two loads at once one
    wins, and a load that died is repeated.
    """

    def __init__(self, spark: SparkSession, path: str, state: tuple[str, ...] = STATE, buckets: int = 64) -> None:
        self.spark, self.state, self.buckets = spark, state, buckets
        self.folder = Folder(spark, path)
        self.log = CommitLog(self.folder)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("entity_id"), F.lit(self.buckets)).cast("int")

    def _appended(self, doc: dict) -> DataFrame | None:
        paths = [self.folder / f"rows/{p}" for p in doc.get("parts", [])]
        return self.spark.read.option("basePath", self.folder / "rows").schema(doc["schema"] + ", load string, _bucket int").parquet(*paths) if paths else None

    def load(self, updates: DataFrame, recorded_at: int, hot_rows: int = HOT_ROWS) -> None:
        """Appends a load; ``recorded_at`` must rise from load to load."""
        n, last = self.log.latest()
        if last and recorded_at <= last["recorded_at"]:
            raise ValueError(f"a load recorded at {last['recorded_at']} has been applied")
        current = None
        if last:
            touched = [r[0] for r in updates.select(self._bucket().alias("b")).distinct().collect()]  # at most as many as buckets
            current = settled_rows(self._appended(last).where(F.col("_bucket").isin(touched)), self.state).where(F.col("recorded_to") == -1)
        more = additions(current, updates, recorded_at, self.state, hot_rows)
        part = f"load={n + 1:08d}-{uuid.uuid4().hex}"
        more.withColumn("_bucket", self._bucket()).write.partitionBy("_bucket").parquet(self.folder / f"rows/{part}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in more.schema.fields)
        self.log.append(n + 1, {"recorded_at": recorded_at, "schema": schema, "parts": [*last.get("parts", []), part]})

    def ledger(self) -> DataFrame | None:
        """All intervals ever believed; None before the first load."""
        rows = self._appended(self.log.latest()[1])
        return None if rows is None else settled_rows(rows, self.state)

    def current(self) -> DataFrame | None:
        """The open intervals."""
        rows = self.ledger()
        return None if rows is None else rows.where(F.col("recorded_to") == -1)


def as_recorded(ledger: DataFrame, at: int) -> DataFrame:
    """The ledger as it stood at a time of record."""
    return ledger.where((F.col("recorded_from") <= at) & ((F.col("recorded_to") == -1) | (F.col("recorded_to") > at)))


def versions(current: DataFrame, state: tuple[str, ...] = STATE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Current intervals with adjacent equal states joined: entity_id, valid_from_ns, valid_to_ns and the state.

    NaN equals NaN and null equals null.
    """
    hot = hot_keys(current, "entity_id", "valid_from_ns", hot_rows)
    n = neighbours(with_blocks(current.select("entity_id", "valid_from_ns", *state), "entity_id", "valid_from_ns", hot), "entity_id", "valid_from_ns", [*state], hot)
    changed = F.col("_prev").isNull()
    for c in state:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_prev.{c}"))
    starts = n.where(changed).drop("_prev", "_next")
    s = neighbours(starts, "entity_id", "valid_from_ns", ["valid_from_ns"], hot)
    return s.select("entity_id", "valid_from_ns", F.coalesce(F.col("_next.valid_from_ns"), F.lit(-1).cast("bigint")).alias("valid_to_ns"), *state)


def item_versions(loads: list[tuple[DataFrame, int]], ledger: HistoryLedger, state: tuple[str, ...] = STATE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Versions of each entity after these loads of updates and snapshots into a ledger, late ones in their place."""
    for updates, recorded_at in loads:
        ledger.load(updates, recorded_at, hot_rows)
    return versions(settled(ledger.current()), state, hot_rows)
