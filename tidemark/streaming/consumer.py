"""The write-ahead stream: producers append JSON files, a Structured Streaming consumer applies them.

A micro-batch is validated, appended to the feature log, then merged into the current-value table. The checkpoint moves
on only after both; a batch that died is replayed with its number. The log may then hold a batch twice, which readers
take out by message id, and the merge is idempotent. Rows that do not fit go to ``quarantine`` with the reason.
"""

from __future__ import annotations

import json
import os
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.errors import LockHeldError, TableNotFoundError, WriteSyncTimeoutError
from tidemark.lifecycle import LIVE_S, live_mark
from tidemark.metrics import METRICS
from tidemark.operators.features import last_arrival
from tidemark.operators.validate import from_json, row_reason, split_valid
from tidemark.schema import FeatureSchema
from tidemark.sources.feature_log import FeatureLog, LogSink
from tidemark.sources.online import OnlineTable
from tidemark.storage import CommitLog, Folder, Lock

WAL = "schema string, entity_id string, event_time_ns bigint, payload string, msg_id_ms bigint, msg_id_seq int"


class Producer:
    """Appends messages to the stream's folder. Ids rise: time in ms and a sequence number; the high-water mark is kept in a
    file under a lock, so that several producers never hand out an id twice."""

    def __init__(self, base: str) -> None:
        self.base = base
        self.dir = os.path.join(base, "wal")
        os.makedirs(self.dir, exist_ok=True)

    def _ids(self, n: int) -> list[tuple[int, int]]:
        path = os.path.join(self.base, "_SEQUENCE")
        import fcntl

        with open(path, "a+") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            f.seek(0)
            ms, seq = map(int, (f.read() or "0-0").split("-"))
            now = max(time.time_ns() // 1_000_000, ms)
            first = seq + 1 if now == ms else 0
            f.seek(0)
            f.truncate()
            f.write(f"{now}-{first + n - 1}")
            f.flush()
        return [(now, first + i) for i in range(n)]

    def write_many(self, schema: FeatureSchema, rows: list[tuple[str, dict, int | None]], check: bool = True) -> list[str]:
        """Messages of (entity, values, event time or None for now), appended as one file; returns their ids.

        Each is checked as ``write`` does, and none is written if one does not fit; unchecked ones are left to the consumer.
        """
        for entity, values, _ in rows if check else ():
            self._check(schema, entity, values)
        ids = self._ids(len(rows))
        name = f"{ids[0][0]:015d}-{ids[0][1]:08d}-{uuid.uuid4().hex[:8]}.json"
        tmp = os.path.join(self.dir, f".{name}")
        with open(tmp, "w") as f:
            for (ms, seq), (entity, values, t) in zip(ids, rows, strict=True):
                f.write(json.dumps({"schema": schema.name, "entity_id": entity, "event_time_ns": time.time_ns() if t is None else t, "payload": json.dumps(values), "msg_id_ms": ms, "msg_id_seq": seq}) + "\n")
            f.flush()
            os.fsync(f.fileno())
        os.rename(tmp, os.path.join(self.dir, name))
        METRICS.count("producer_messages_total", len(rows), schema=schema.name)
        return [f"{ms}-{seq}" for ms, seq in ids]

    @staticmethod
    def _check(schema: FeatureSchema, entity_id: str, values: dict) -> None:
        gone = [n for n in schema.names if n not in values]
        extra = [n for n in values if n not in schema.names]
        if gone or extra:
            raise ValueError(f"missing fields: {gone}; unknown fields: {extra}")
        reason = row_reason(schema, entity_id, values)
        if reason:
            METRICS.count("producer_refused_total", schema=schema.name)
            raise ValueError(f"{schema.name} does not hold this: {reason}")

    def write(self, schema: FeatureSchema, entity_id: str, values: dict, event_time_ns: int | None = None) -> str:
        """Checks names, types, ranges and lengths of one message and appends it; returns its id. What the schema cannot hold
        raises ValueError here."""
        return self.write_many(schema, [(entity_id, values, event_time_ns)])[0]

    def _applied(self, schema: FeatureSchema) -> tuple[int, int]:
        folder = os.path.join(self.base, "online", schema.name, "applied")
        for name in sorted((n for n in os.listdir(folder) if n.endswith(".json") and n[0] != "."), reverse=True) if os.path.isdir(folder) else ():
            try:
                with open(os.path.join(folder, name)) as f:
                    return tuple(json.load(f)["id"])
            except FileNotFoundError:
                continue  # pruned meanwhile
        return (-1, -1)

    def write_sync(self, schema: FeatureSchema, entity_id: str, values: dict, event_time_ns: int | None = None, timeout_ms: int = 10_000) -> str:
        """Like ``write``, then waits until the message is applied; on a timeout it stays queued."""
        msg = self.write(schema, entity_id, values, event_time_ns)
        want = tuple(map(int, msg.split("-")))
        deadline, pause = time.time() + timeout_ms / 1000, 0.01
        while time.time() < deadline:
            if self._applied(schema) >= want:
                return msg
            time.sleep(pause)
            pause = min(pause * 2, 0.2)
        raise WriteSyncTimeoutError(msg, timeout_ms)


class Consumer:
    """Applies the stream to the log and the current-value tables of some schemas under ``base``.

    One consumer runs per ``base``, whatever process it is in: it holds a lock and a mark on each table, and renews them also
    when nothing arrives. ``retain`` says what becomes of applied files of the stream: kept, moved to ``done``, or deleted.
    """

    def __init__(self, spark: SparkSession, base: str, schemas: list[FeatureSchema], max_files: int = 1000, max_bytes: str | None = None, retain: str = "keep", log: LogSink | None = None) -> None:
        if retain not in ("keep", "archive", "delete"):
            raise ValueError("retain must be keep, archive or delete")
        self.spark, self.base, self.max_files, self.max_bytes, self.retain = spark, base, max_files, max_bytes, retain
        self.schemas = {s.name: s for s in schemas}
        self.log = FeatureLog(spark, os.path.join(base, "log")) if log is None else log
        self.online = {s.name: OnlineTable(spark, os.path.join(base, "online"), s) for s in schemas}
        os.makedirs(os.path.join(base, "wal"), exist_ok=True)
        self.locks: list[Lock] = []
        self.query: StreamingQuery | None = None

    def _apply(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            known = F.col("schema").isin(*self.schemas)
            self._quarantine(batch.where(~F.coalesce(known, F.lit(False))).select("entity_id", "event_time_ns", F.to_json(F.struct("*")).alias("raw"), F.lit("unknown_schema").alias("_reason")), batch_id, "unknown")
            for name, schema in self.schemas.items():
                own = batch.where(F.col("schema") == name).drop("schema")
                if own.isEmpty():
                    continue
                table = self.online[name]
                if table.current_version() is not None:
                    table.read()  # a table of another schema version stops the query before anything is written
                good, bad = split_valid(from_json(own, schema), schema)
                self._quarantine(bad, batch_id, name)
                with METRICS.timed("consumer_log_seconds", schema=name):
                    self.log.append(good, schema, validate=False)
                with METRICS.timed("consumer_merge_seconds", schema=name):
                    try:
                        new, updated = table.upsert(good)
                        METRICS.count("consumer_rows_total", new + updated, schema=name)
                    except TableNotFoundError:
                        table.create(last_arrival(good, schema.names))
                table.gc()  # the version that this batch replaced, unless it is being read
                seen = own.agg(F.max(F.struct("msg_id_ms", "msg_id_seq"))).first()[0]
                applied = CommitLog(table.folder, "applied")
                n, doc = applied.latest()
                applied.append(n + 1, {"id": max(list(seen), doc.get("id", [-1, -1]))})
                applied.prune()
        finally:
            batch.unpersist()

    def _quarantine(self, bad: DataFrame, batch_id: int, source: str) -> None:
        """Rows that cannot be applied, by batch; a replay overwrites its own folder."""
        out = bad.select("entity_id", "event_time_ns", "raw", F.col("_reason").alias("reason"))
        if not out.isEmpty():
            METRICS.count("consumer_quarantined_total", source=source)
            out.write.mode("overwrite").json(os.path.join(self.base, "quarantine", f"batch={batch_id}", f"source={source}"))

    def quarantined(self) -> DataFrame:
        path = os.path.join(self.base, "quarantine")
        schema = "entity_id string, event_time_ns bigint, raw string, reason string, batch int, source string"
        return self.spark.read.schema(schema).json(path) if os.path.isdir(path) else self.spark.createDataFrame([], schema)

    def _hold(self) -> None:
        """Takes the lock of the stream and the marks of the tables, and renews them while the query runs."""
        mine = [Lock(Folder(self.spark, self.base), "consumer", LIVE_S), *map(live_mark, self.online.values())]
        mine[0].take()  # the one that excludes others
        for mark in mine[1:]:
            mark.take()
        self.locks = mine

    def _beat(self, query: StreamingQuery) -> None:
        while query.isActive and self.locks:
            try:
                for lock in self.locks:
                    lock.renew()
            except LockHeldError:
                query.stop()  # another consumer has taken over
                return
            query.awaitTermination(LIVE_S / 4)

    def _release(self) -> None:
        for lock in self.locks:
            lock.release()
        self.locks = []

    def start(self, once: bool = True, interval: str = "1 second") -> StreamingQuery:
        """Starts the query: once over what is there, or continuously, by files, bytes or time. LockHeldError when one runs."""
        if self.query is not None and self.query.isActive:
            raise LockHeldError(f"{self.base}: this consumer is running")
        self._release()
        self._hold()
        try:
            reader = self.spark.readStream.schema(WAL).option("maxFilesPerTrigger", self.max_files)
            if self.max_bytes:
                reader = self.spark.readStream.schema(WAL).option("maxBytesPerTrigger", self.max_bytes)
            if self.retain != "keep":
                reader = reader.option("cleanSource", self.retain).option("sourceArchiveDir", os.path.join(self.base, "done"))
            stream = reader.json(os.path.join(self.base, "wal"))
            w = stream.writeStream.foreachBatch(self._apply).option("checkpointLocation", os.path.join(self.base, "checkpoint"))
            self.query = (w.trigger(availableNow=True) if once else w.trigger(processingTime=interval)).start()
        except Exception:
            self._release()
            raise
        threading.Thread(target=self._beat, args=(self.query,), daemon=True).start()
        return self.query

    def stop(self) -> None:
        """Ends the query after its batch and gives up the lock."""
        if self.query is not None:
            self.query.stop()
        self._release()

    def drain(self) -> None:
        """Applies all that is queued, then returns."""
        query = self.start(once=True)
        try:
            query.awaitTermination()
        finally:
            self._release()
