"""Totals per entity and day of event time, corrected as late messages arrive, with a cut-off.

The window of a day closes at the midnight (UTC) that follows. A message that arrives before is on time; one that arrives
less than the allowed lateness after it revises the totals; later ones are dropped and reported.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import DAY_MS, day_bucket, day_number
from tidemark.operators.dedup import kept_rows
from tidemark.session import settled
from tidemark.storage import CommitLog, Folder

LATENESS_MS = 48 * 3_600_000


def classify(rows: DataFrame, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """Rows with an event time, with ``event_day`` and ``arrival``: on_time, revision or dropped."""
    rows = rows.where(F.col("event_time_ns").isNotNull())
    late = F.col("msg_id_ms") - (day_number("event_time_ns").cast("bigint") + 1) * DAY_MS
    arrival = F.when(late < 0, "on_time").when(late < lateness_ms, "revision").otherwise("dropped")
    return rows.withColumns({"event_day": day_bucket("event_time_ns"), "arrival": arrival})


def classified(log: DataFrame, lateness_ms: int = LATENESS_MS, fields: tuple[str, ...] = ("clicks",)) -> DataFrame:
    """Kept rows with a message id and their ``arrival``: on_time, revision or dropped; and ``event_day``.

    Copies of a message count once, by the kept row. Rows without an id or without event time belong to no window.
    """
    return classify(kept_rows(log, ["event_time_ns", "batch_no", *fields]), lateness_ms)


def batch_totals(rows: DataFrame) -> DataFrame:
    """What each flush adds to an entity's day; hot entities collapse before the shuffle."""
    return (
        rows.where(F.col("arrival") != "dropped")
        .groupBy("entity_id", F.col("event_day").alias("event_date"), "batch_no")
        .agg(
            F.count(F.lit(1)).alias("n_new"),
            F.sum("clicks").alias("clicks_new"),
            F.count_if(F.col("arrival") == "revision").alias("n_late"),
        )
    )


class KeyedTotals:
    """The totals per entity and day as keyed state in a folder, fed by batches of classified rows.

    A batch merges into the state of the days it touches, emits an upsert for each entity, day and flush, diverts what came
    beyond the cut-off, and publishes all of it by one commit. Days whose window and lateness have passed are not touched
    again, so their state is never read or written any more. Batches are numbered; one that has been applied is skipped.
    """

    STATE = "entity_id string, event_date string, n_messages bigint, clicks bigint, n_late bigint, n_revisions bigint, n_emissions bigint"
    EMITTED = STATE + ", batch_no int, n_new bigint, clicks_new bigint, late_new bigint"
    DROPPED = "msg_id_ms bigint, msg_id_seq int, entity_id string, event_time_ns bigint, event_date string, batch_no int"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, Folder(spark, path)
        self.log = CommitLog(self.folder)

    def _read(self, kind: str, parts: list[str], schema: str) -> DataFrame:
        paths = [self.folder / f"{kind}/{p}" for p in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def apply(self, rows: DataFrame, batch_id: int) -> None:
        """``rows``: of ``classified``, each message once over all batches, the flushes of a batch after those of the batches before."""
        n, last = self.log.latest()
        if last and batch_id <= last["batch"]:
            return
        part, days = f"{n + 1:08d}-{uuid.uuid4().hex}", dict(last.get("days", {}))
        batch_totals(rows).write.parquet(self.folder / f"delta/{part}")
        delta = self.spark.read.parquet(self.folder / f"delta/{part}")
        touched = [r[0] for r in delta.select("event_date").distinct().collect()]  # calendar days
        old = self._read("state", [days[x] for x in touched if x in days], self.STATE)
        was = {"n_messages": "n_new", "clicks": "clicks_new", "n_late": "n_late"}
        step = delta.select("entity_id", "event_date", "batch_no", *[F.col(b).alias(a) for a, b in was.items()], (F.col("n_late") > 0).cast("bigint").alias("n_revisions"), F.lit(1).cast("bigint").alias("n_emissions"))
        base = old.select("entity_id", "event_date", F.lit(None).cast("int").alias("batch_no"), *was, "n_revisions", "n_emissions")
        w = Window.partitionBy("entity_id", "event_date").orderBy(F.col("_step"), F.col("batch_no").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = base.withColumn("_step", F.lit(0)).unionByName(step.withColumn("_step", F.lit(1)))
        upto = both.withColumns({f"_{c}": F.sum(c).over(w) for c in (*was, "n_revisions", "n_emissions")})
        emitted = upto.where(F.col("_step") == 1).select(
            "entity_id", "event_date", *[F.col(f"_{c}").alias(c) for c in (*was, "n_revisions", "n_emissions")], "batch_no",
            F.col("n_messages").alias("n_new"), F.col("clicks").alias("clicks_new"), F.col("n_late").alias("late_new"),
        )
        emitted.write.parquet(self.folder / f"emitted/{part}")
        # the last upsert of each key is its state; keys of a touched day that were not touched stay
        now = self._read("emitted", [part], self.EMITTED)
        cols = [c for c in old.columns if c not in ("entity_id", "event_date")]
        final = old.withColumn("_o", F.lit(-1).cast("bigint")).unionByName(now.select(*old.columns, F.col("n_emissions").alias("_o")))
        state = final.groupBy("entity_id", "event_date").agg(F.max_by(F.struct(*cols), "_o").alias("s")).select("entity_id", "event_date", *[f"s.{c}" for c in cols])
        state.withColumn("_day", F.col("event_date")).write.partitionBy("_day").parquet(self.folder / f"state/{part}")
        rows.where(F.col("arrival") == "dropped").select("msg_id_ms", "msg_id_seq", "entity_id", "event_time_ns", F.col("event_day").alias("event_date"), "batch_no").write.parquet(self.folder / f"dropped/{part}")
        days |= {x: f"{part}/_day={x}" for x in touched}
        self.log.append(n + 1, {"batch": batch_id, "days": days, "parts": [*last.get("parts", []), part]})

    def totals(self) -> DataFrame:
        """The totals as corrected so far: entity_id, event_date, n_messages, clicks, n_late, n_revisions, n_emissions."""
        return self._read("state", list(self.log.latest()[1].get("days", {}).values()), self.STATE)

    def emissions(self) -> DataFrame:
        """Every upsert: the state after a flush (n_emissions counts them per key), and what the flush brought: n_new, clicks_new, late_new."""
        return self._read("emitted", self.log.latest()[1].get("parts", []), self.EMITTED)

    def dropped(self) -> DataFrame:
        """Messages beyond the cut-off."""
        return self._read("dropped", self.log.latest()[1].get("parts", []), self.DROPPED)


def run(log: DataFrame, state: KeyedTotals, batches: int = 2, lateness_ms: int = LATENESS_MS) -> KeyedTotals:
    """Feeds a whole log, copies taken out, into the state in so many batches of flushes."""
    rows = settled(classified(log, lateness_ms, ("clicks",)))
    last = rows.agg(F.max("batch_no")).first()[0] or 0
    no = F.greatest(F.least(F.floor(F.coalesce("batch_no", F.lit(0)) * batches / (last + 1)), F.lit(batches - 1)), F.lit(0))
    for i in range(batches):
        state.apply(rows.where(no == i), i)
    return state


def revisions(state: KeyedTotals) -> DataFrame:
    """Upserts that corrected a closed window."""
    return state.emissions().where(F.col("late_new") > 0)
