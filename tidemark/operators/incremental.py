"""Processing only records that no earlier run has durably done.

:class:`IncrementalConsumer` makes the runs: each takes what lies above the high watermark of a monotonic commit sequence
up to a limit that is fixed when the run starts, and publishes output and new watermark in one atomic step. A run that
takes over from consumers whose runs are only known by a ledger, and whose done ranges need not join, leaves out what those
have done with :func:`open_messages`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import entity_key
from tidemark.operators.dedup import has_id
from tidemark.storage import CommitLog, Folder

#: Ranges in cells up to which they are broadcast: about 60 bytes each, 30 MB in all.
BROADCAST_RANGES = 500_000


def done_ranges(runs: DataFrame) -> DataFrame:
    """Ranges ``(lo, done]`` of message ids that runs have durably done, with the flush up to which they had seen the log.

    Rolled back and running attempts and failed ones without a position have done nothing. Rows with a null bound or null
    ``seen_batch_no`` and empty ranges are left out; repeated rows do no harm.
    """
    below = (F.col("lo_ms") < F.col("done_ms")) | ((F.col("lo_ms") == F.col("done_ms")) & (F.col("lo_seq") < F.col("done_seq")))
    return runs.where(F.col("status").isin("committed", "failed") & below & F.col("seen_batch_no").isNotNull()).select("shard", "lo_ms", "lo_seq", "done_ms", "done_seq", "seen_batch_no").distinct()


#: Cells of a level that a range lies in at most; a longer one goes to the next level, whose cells are so many times as wide.
SPAN = 64


def _leveled(ranges: DataFrame) -> tuple[DataFrame, int]:
    """Each range in the cells of message time of its own level, and the width of cells of level 0.

    Columns: _shard, _level, _cell, range. Level 0 has about as many cells as a shard has ranges, so that a row meets few of
    them; a range lies in about ``SPAN`` cells at most however long it is.
    """
    n, shards, lo, hi = ranges.agg(F.count(F.lit(1)), F.count_distinct("shard"), F.min("lo_ms"), F.max("done_ms")).first()
    base = max(1000, (hi - lo) // max(1, n // max(1, shards))) if n else 1000
    long = F.greatest((F.col("done_ms") - F.col("lo_ms")).cast("double") / base, F.lit(1.0))
    level = F.greatest(F.ceil(F.log2(long) / (SPAN.bit_length() - 1)), F.lit(1)).cast("int") - 1
    width = F.lit(base).cast("double") * F.pow(F.lit(float(SPAN)), level)
    cells = F.sequence(F.floor(F.col("lo_ms") / width), F.floor(F.col("done_ms") / width))
    each = F.struct("lo_ms", "lo_seq", "done_ms", "done_seq", "seen_batch_no").alias("range")
    return ranges.select(F.col("shard").alias("_shard"), level.alias("_level"), each, F.explode(cells).alias("_cell")), base


def _covers(r: Column) -> Column:
    after = (r["lo_ms"] < F.col("msg_id_ms")) | ((r["lo_ms"] == F.col("msg_id_ms")) & (r["lo_seq"] < F.col("msg_id_seq")))
    upto = (F.col("msg_id_ms") < r["done_ms"]) | ((F.col("msg_id_ms") == r["done_ms"]) & (F.col("msg_id_seq") <= r["done_seq"]))
    return after & upto & (F.col("batch_no") <= r["seen_batch_no"])


def open_messages(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Messages with an id of which no copy has been done: ``msg_id_ms, msg_id_seq, entity_id`` (the entity).

    The log passes by the bounds of the earlier runs once (a row meets one short list of ranges for each level of their
    lengths) and is then reduced to one row per message; copies collapse before the shuffle. The ranges are broadcast only
    when they are counted to be few, else both sides are shuffled by shard and cell. Rows with a null shard or ``batch_no``
    count as not done; a null entity is one entity; no runs at all leave every message open.
    """
    ranges, base = _leveled(done_ranges(runs))
    levels = {r["_level"]: r["n"] for r in ranges.groupBy("_level").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ten
    few = sum(levels.values()) <= BROADCAST_RANGES
    met = log.where(has_id()).select("msg_id_ms", "msg_id_seq", entity_key("entity_id").alias("entity_id"), "shard", "batch_no", F.lit(False).alias("_done"))
    for k in sorted(levels):
        side = ranges.where(F.col("_level") == k).groupBy("_shard", "_cell").agg(F.collect_list("range").alias("_ranges"))
        here = (F.col("shard") == F.col("_shard")) & (F.floor(F.col("msg_id_ms") / (float(base) * float(SPAN) ** k)) == F.col("_cell"))
        done = F.col("_done") | F.coalesce(F.exists("_ranges", _covers), F.lit(False))
        met = met.join(F.broadcast(side) if few else side, here, "left").withColumn("_done", done).drop("_shard", "_cell", "_ranges")
    per = met.groupBy("msg_id_ms", "msg_id_seq", "entity_id").agg(F.max("_done").alias("_done"))
    return per.where(~F.col("_done")).drop("_done")


class FlushMarks:
    """Which flushes of a growing table are complete.

    A writer begins a flush, writes it, and seals it; flushes may overlap. Readers go up to ``complete``, below the first
    one that has been begun and not sealed.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        folder = Folder(spark, path)
        self.begun, self.sealed = folder.sub("begun"), folder.sub("sealed")

    def begin(self, n: int) -> None:
        self.begun.create(f"{n:012d}", "")

    def seal(self, n: int) -> None:
        self.sealed.create(f"{n:012d}", "")

    def complete(self) -> int | None:
        """The greatest sealed flush below which none is open; None when there is none."""
        done = {int(x) for x in self.sealed.names() if x.isdigit()}
        first = min({int(x) for x in self.begun.names() if x.isdigit()} - done, default=None)
        return max((n for n in done if first is None or n < first), default=None)


def snapshot_limit(table: DataFrame, sequence: str = "batch_no") -> int | None:
    """The greatest sequence of a table that nobody writes to any more, where every flush is complete."""
    return table.agg(F.max(sequence)).first()[0]


class IncrementalConsumer:
    """Runs over a growing table; each takes the rows above the high watermark and publishes its output once.

    A run's upper limit is fixed when it starts: the caller names the greatest sequence up to which all flushes are complete
    (``FlushMarks.complete``, or ``snapshot_limit`` of a table at rest), so no half-written flush is passed over. The folder
    holds ``out/<run>`` and numbered commits. A commit names its output and the watermark that it reached, so both become
    visible in one step; of two runs that start from the same watermark one wins and the other fails without effect. Output
    of runs that died is never read.
    """

    def __init__(self, spark: SparkSession, path: str, sequence: str = "batch_no") -> None:
        self.spark, self.sequence = spark, sequence
        self.folder = Folder(spark, path)
        self.log = CommitLog(self.folder)

    def watermark(self) -> int | None:
        return self.log.latest()[1].get("hi")

    def run(self, table: DataFrame, limit: int | None, process: Callable[[DataFrame], DataFrame] = lambda df: df) -> int | None:
        """Processes rows with watermark < sequence <= limit; returns the new watermark, or None when there is nothing new.

        Rows with a null sequence have not been committed yet and wait.
        """
        n, last = self.log.latest()
        lo = last.get("hi")
        if limit is None or (lo is not None and limit <= lo):
            return None
        new = table.where(F.col(self.sequence) <= limit)
        new = new if lo is None else new.where(F.col(self.sequence) > lo)
        part = f"{n + 1:08d}-{uuid.uuid4().hex}"
        process(new).write.parquet(self.folder / f"out/{part}")
        self.log.append(n + 1, {"n": n + 1, "lo": lo, "hi": limit, "output": part})
        return limit

    def output(self) -> DataFrame | None:
        """All published output."""
        parts = [self.folder / f"out/{c['output']}" for c in self.log.all()]
        return self.spark.read.parquet(*parts) if parts else None
