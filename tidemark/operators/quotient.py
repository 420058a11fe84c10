"""Exact removal of repeated deliveries with quotient hash tables.

A message's identifier is two 64-bit words and the entity: the words are the message id (or the event time where there
is no id) and flags. Two Feistel rounds keyed by the entity permute the words. A permutation loses nothing: equal words
and entity after it mean equal identifiers before it, so the tables never match falsely. The top bits of the permuted
word are the quotient, which names the shard and the slot; the remaining words are stored complete.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import entity_key
from tidemark.operators.dedup import has_id
from tidemark.storage import CommitLog, Folder

#: Entries of the table that each task keeps before the shuffle; when it is full, its entries are handed on.
COMBINER_ENTRIES = 1 << 18
SHARD_BITS = 16
_FLAG_ID, _FLAG_NO_TIME = 1 << 40, 1 << 41
KEYS = "_a bigint, _b bigint, _e string, _v bigint, _new boolean"


def permuted(ms: Column, seq: Column, entity: Column) -> tuple[Column, Column]:
    """The two words after two Feistel rounds; invertible for a given entity."""
    a = ms.bitwiseXOR(F.xxhash64(seq, entity))
    b = seq.bitwiseXOR(F.xxhash64(a, entity))
    return a, b


def identifiers(log: DataFrame, value: str = "delivery_no") -> DataFrame:
    """Permuted identifier ``_a, _b, _e`` of each row's message and ``_v``, the value whose least decides the kept row."""
    named = has_id()
    first = F.coalesce(F.when(named, F.col("msg_id_ms")).otherwise(F.col("event_time_ns")), F.lit(0)).cast("bigint")
    second = F.when(named, F.col("msg_id_seq").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(_FLAG_ID)).otherwise(F.when(F.col("event_time_ns").isNull(), F.lit(_FLAG_NO_TIME)).otherwise(F.lit(0))).cast("bigint")
    base = log.select(first.alias("_ms"), second.alias("_sq"), entity_key("entity_id").alias("_e"), F.col(value).cast("bigint").alias("_v"))
    a, b = permuted(F.col("_ms"), F.col("_sq"), F.col("_e"))
    return base.select(a.alias("_a"), b.alias("_b"), "_e", "_v")


class QuotientTable:
    """Open-addressing table of identifiers with the least value of each; grows by doubling."""

    def __init__(self, bits: int = 12) -> None:
        self.names: dict[str | None, int] = {}
        self.list: list[str | None] = []
        self._alloc(bits)

    def _alloc(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        size = 1 << bits
        self.a, self.b = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.e, self.v = np.full(size, -1, np.int32), np.zeros(size, np.int64)

    def codes(self, entities: pa.Array) -> np.ndarray:
        """Entities as numbers of this table's dictionary; null is an entity of its own."""
        d = entities.dictionary_encode(null_encoding="encode")
        if isinstance(d, pa.ChunkedArray):
            d = d.combine_chunks()
        local = np.empty(len(d.dictionary), np.int32)
        for i, s in enumerate(d.dictionary.to_pylist()):
            c = self.names.get(s)
            if c is None:
                c = self.names[s] = len(self.list)
                self.list.append(s)
            local[i] = c
        return local[d.indices.to_numpy(zero_copy_only=False)] if len(d) else np.empty(0, np.int32)

    def insert(self, a: np.ndarray, b: np.ndarray, e: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Enters the rows; returns the values that lost to a smaller one of the same identifier."""
        order = np.lexsort((v, e, a, b))
        a, b, e, v = a[order], b[order], e[order], v[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (e[1:] != e[:-1])
        lost = [v[~first]]
        a, b, e, v = a[first], b[first], e[first], v[first]
        while (self.n + len(a)) * 2 > 1 << self.bits:
            self._grow()
        lost.append(self._place(a, b, e, v))
        return np.concatenate(lost)

    def _grow(self) -> None:
        old = self.entries()
        self._alloc(self.bits + 1)
        self._place(*old)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        used = self.e >= 0
        return self.a[used], self.b[used], self.e[used], self.v[used]

    def _place(self, a: np.ndarray, b: np.ndarray, e: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Linear probing of identifiers that differ from each other, all of them a step at a time."""
        mask, lost = (1 << self.bits) - 1, []
        quotient = (b.view(np.uint64) << np.uint64(SHARD_BITS)) >> np.uint64(64 - self.bits)
        slot, todo = quotient.astype(np.int64), np.arange(len(a))
        while len(todo):
            s = slot[todo]
            free = self.e[s] < 0
            taken, at = np.unique(s[free], return_index=True)
            new = todo[free][at]
            self.a[taken], self.b[taken], self.e[taken], self.v[taken] = a[new], b[new], e[new], v[new]
            self.n += len(new)
            placed = np.zeros(len(a), bool)
            placed[new] = True
            same = ~free & (self.a[s] == a[todo]) & (self.b[s] == b[todo]) & (self.e[s] == e[todo])
            hit, where = todo[same], s[same]
            lost.append(np.maximum(self.v[where], v[hit]))
            self.v[where] = np.minimum(self.v[where], v[hit])
            placed[hit] = True
            rest = todo[~placed[todo]]
            moved = (self.a[slot[rest]] != a[rest]) | (self.b[slot[rest]] != b[rest]) | (self.e[slot[rest]] != e[rest])
            slot[rest[moved]] = (slot[rest[moved]] + 1) & mask
            todo = rest
        return np.concatenate(lost) if lost else np.empty(0, np.int64)


def _batch(a, b, e, v, new) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(e, pa.string()), pa.array(v, pa.int64()), pa.array(new, pa.bool_())], names=["_a", "_b", "_e", "_v", "_new"])


def _lost(v: np.ndarray) -> pa.RecordBatch:
    n = len(v)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(v.view(np.int64), pa.int64()), pa.nulls(n, pa.string()), pa.array(v, pa.int64()), pa.array(np.zeros(n, bool))], names=["_a", "_b", "_e", "_v", "_new"])


def _kept(t: QuotientTable) -> Iterator[pa.RecordBatch]:
    a, b, e, v = t.entries()
    names = pa.array(t.list, pa.string())
    for i in range(0, len(a), 50_000):
        j = slice(i, i + 50_000)
        yield _batch(a[j], b[j], names.take(pa.array(e[j])), v[j], np.ones(len(a[j]), bool))


def _run(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[pa.RecordBatch]:
    """Rows with ``_new`` are entered; those without it have lost already and pass. Without a limit the table holds the whole shard."""
    t = QuotientTable()
    for r in batches:
        if not r.num_rows:
            continue
        new = r.column("_new").to_numpy(zero_copy_only=False)
        if not new.all():
            yield _lost(r.column("_v").to_numpy(zero_copy_only=False)[~new])
            r = r.filter(r.column("_new"))
        a, b, v = (r.column(c).to_numpy(zero_copy_only=False) for c in ("_a", "_b", "_v"))
        lost = t.insert(a, b, t.codes(r.column("_e")), v)
        if len(lost):
            yield _lost(lost)
        if limit and t.n >= limit:
            yield from _kept(t)
            t = QuotientTable()
    yield from _kept(t)


#: Identifiers that one shard task may hold, about 60 bytes each and their entity.
SHARD_IDENTIFIERS = 4_000_000


def settle(ids: DataFrame, n: int | None = None) -> DataFrame:
    """Each row of ``ids`` (``_a, _b, _e, _v``) once, with ``_new``: whether it is the kept row of its identifier.

    A bounded table in front of the shuffle takes out the copies that one task sees, so that an identifier with very
    many copies does not fill one shard. ``_a`` and ``_e`` are null for rows that are not kept. ``n``: how many identifiers
    there are at most, if known; then shards are made small enough for a task's memory.
    """
    shard = F.shiftrightunsigned("_b", 64 - SHARD_BITS)
    front = ids.withColumn("_new", F.lit(True)).mapInArrow(lambda it: _run(it, COMBINER_ENTRIES), KEYS)
    usual = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    need = -(-(n or 0) // SHARD_IDENTIFIERS)
    # adaptive execution joins small shards only where their number is left to it
    parts = front.repartition(need, shard) if need > usual else front.repartition(shard)
    return parts.mapInArrow(lambda it: _run(it, None), KEYS)


def repeated_deliveries(log: DataFrame) -> DataFrame:
    """``delivery_no`` of every row that is not the kept row of its message.

    Two rows are copies when they agree in ``msg_id_ms``, ``msg_id_seq`` and entity or, both without an id, in entity and
    ``event_time_ns``. Null entities are one entity, null times one time. Rows without ``delivery_no`` cannot be named and
    are left out. An empty log gives no rows.
    """
    rows = log.where(F.col("delivery_no").isNotNull())
    return settle(identifiers(rows), rows.count()).where(~F.col("_new")).select(F.col("_v").alias("delivery_no"))


def distinct_messages(log: DataFrame) -> DataFrame:
    """The kept row of each message with all its columns; ``delivery_no`` must be unique."""
    keep = settle(identifiers(log), log.count()).where(F.col("_new")).select(F.col("_v").alias("_keep"))
    return log.join(keep, F.col("delivery_no") == F.col("_keep"), "left_semi")


#: An identifier that was stored earlier enters its table with this value, below that of any row, so that it stays.
_SEEN = -(1 << 63)
MAX_PARTS = 16


class QuotientStore:
    """Identifiers seen so far, kept over runs in a folder of Parquet files, and the new rows of each batch.

    ``insert`` enters a batch into tables that hold what was stored, shard by shard, writes the identifiers that are new and
    the rows that brought them, and makes both visible by one commit. A run that dies before leaves everything as it was and
    is repeated with its batch; of two that insert at once one wins. When there are ``MAX_PARTS`` parts they are written
    again as one.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, Folder(spark, path)
        self.log = CommitLog(self.folder)

    SCHEMA = "_a bigint, _b bigint, _e string"

    def seen(self, parts: list[str] | None = None) -> DataFrame:
        parts = self.log.latest()[1].get("parts", []) if parts is None else parts
        paths = [self.folder / f"ids/{p}" for p in parts]
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)

    def prepare(self, batch: DataFrame, value: str = "delivery_no") -> tuple[DataFrame, int, dict]:
        """The batch's rows of new identifiers, written, and the commit that makes them count; for callers that commit more with it."""
        n, last = self.log.latest()
        parts, part = last.get("parts", []), f"{n + 1:08d}-{uuid.uuid4().hex}"
        old = self.seen(parts)
        known = int(last.get("n_ids", 0))
        both = identifiers(batch, value).unionByName(old.withColumn("_v", F.lit(_SEEN).cast("bigint")))
        kept = settle(both, known + batch.count()).where(F.col("_new") & (F.col("_v") != _SEEN))
        kept.select("_a", "_b", "_e", "_v").write.parquet(self.folder / f"ids/{part}")
        fresh = self.spark.read.schema(f"{self.SCHEMA}, _v bigint").parquet(self.folder / f"ids/{part}")
        rows = batch.join(fresh.select(F.col("_v").alias("_keep")), F.col(value) == F.col("_keep"), "left_semi")
        rows.write.parquet(self.folder / f"out/{part}")
        parts, total = [*parts, part], known + fresh.count()
        if len(parts) > MAX_PARTS:
            whole = f"{part}-whole"
            self.seen(parts).write.parquet(self.folder / f"ids/{whole}")
            parts = [whole]
        return self.spark.read.parquet(self.folder / f"out/{part}"), n + 1, {"parts": parts, "n_ids": total, "output": part}

    def insert(self, batch: DataFrame, value: str = "delivery_no") -> DataFrame:
        """The rows of a batch whose identifiers are new, one of each; they and their identifiers are committed."""
        rows, n, doc = self.prepare(batch, value)
        self.log.append(n, doc)
        return rows

    def output(self) -> DataFrame | None:
        """The rows of all committed batches."""
        paths = [self.folder / f"out/{c['output']}" for c in self.log.all()]
        return self.spark.read.parquet(*paths) if paths else None
