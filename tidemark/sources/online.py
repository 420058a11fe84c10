"""The current-value table: one row per entity, in immutable versions behind an atomic pointer.

Rows lie in hash buckets of the entity under ``data``; a version is a list of buckets, and a merge writes only those that
its batch touches. The pointer is a log of numbered commits, so it moves by compare-and-swap and readers see the old table
or the new one, never a part. Readers may hold leases; versions without lease that are not current are removed by ``gc``.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import CapacityExceededError, ConflictError, EntityNotFoundError, LockHeldError, SchemaMismatchError, TableNotFoundError
from tidemark.operators import features
from tidemark.schema import FeatureSchema
from tidemark.storage import CommitLog, Folder, Lock

LEASE_TTL_S = 30.0
WRITE_TTL_S = 3600.0
BUCKETS = 64


class OnlineTable:
    """``buckets`` holds for the first version; later ones keep what the table has."""

    def __init__(self, spark: SparkSession, base: str, schema: FeatureSchema, msg_id: bool = True, buckets: int = BUCKETS) -> None:
        self.spark, self.schema, self.msg_id, self.buckets = spark, schema, msg_id, buckets
        self.dir = os.path.join(base, schema.name)
        self.folder = Folder(spark, self.dir)
        self.pointer, self.versions, self.leases = CommitLog(self.folder, "current"), self.folder.sub("versions"), self.folder.sub("leases")

    # --- pointer ---
    def current_version(self) -> str | None:
        return self.pointer.latest()[1].get("version")

    def swing(self, expected: str | None, new: str | None) -> int:
        """Compare-and-swap of the pointer: 1 done, 0 another version is current, -1 there is no pointer though one was expected."""
        n, doc = self.pointer.latest()
        now = doc.get("version")
        if now == expected:
            try:
                self.pointer.append(n + 1, {"version": new})
                self.pointer.prune()
                return 1
            except ConflictError:
                now = self.current_version()
        return -1 if now is None else 0

    def lock(self, name: str, ttl_s: float = 60.0) -> Lock:
        return Lock(self.folder, name, ttl_s)

    # --- versions ---
    def manifest(self, version: str) -> dict:
        text = self.versions.read(f"{version}.json")
        if text is None:
            raise TableNotFoundError(f"{self.schema.name} {version} is gone")
        return json.loads(text)

    @staticmethod
    def _bucket(buckets: int, c: Column | str = "entity_id") -> Column:
        return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")

    def write_version(self, rows: DataFrame, capacity: int | None = None, schema: FeatureSchema | None = None, over: dict | None = None, touched: list[int] | None = None) -> tuple[str, int]:
        """Writes rows (one per entity) as a version that nobody reads yet; returns its name and row count.

        ``over`` and ``touched``: a manifest and the buckets that the rows replace in it; the others are shared with it. Rows
        are sorted by entity, so that a lookup reads few row groups of one bucket.
        """
        schema = schema or self.schema
        n_buckets, token = (over or {}).get("buckets", self.buckets), uuid.uuid4().hex
        version = f"v{self.pointer.latest()[0] + 2:08d}-{token[:8]}"
        cols = [f.name for f in schema.log_type(self.msg_id and "msg_id_ms" in rows.columns).fields]
        with Lock(self.leases, f"data-{token}", WRITE_TTL_S).held():  # keeps gc away until a version names the data
            types = {f.name: f.cast_type for f in schema.fields}
            typed = [F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in cols]
            out = rows.select(*typed, self._bucket(n_buckets).alias("bucket"))
            path = self.folder / f"data/{token}"
            out.repartition("bucket").sortWithinPartitions("bucket", "entity_id").write.option("compression", "zstd").partitionBy("bucket").parquet(path)
            kept = {b: x for b, x in (over or {}).get("where", {}).items() if int(b) not in (touched or [])}
            mine = {}
            if self.folder.sub(f"data/{token}").names() != ["_SUCCESS"]:
                counted = self.spark.read.schema("bucket int").option("basePath", path).parquet(path).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
                mine = {str(r["bucket"]): [token, r["n"]] for r in counted.collect()}  # at most as many as buckets
            where = kept | mine
            count = sum(n for _, n in where.values())
            if capacity is not None and count > capacity:
                self.folder.delete(f"data/{token}")
                raise CapacityExceededError(f"{count} entities; the capacity is {capacity}")
            doc = {"schema": schema.to_json(), "fingerprint": schema.fingerprint(), "rows": count, "capacity": capacity, "created": time.time(), "buckets": n_buckets, "msg_id": "msg_id_ms" in cols, "where": where}
            self.versions.create(f"{version}.json", json.dumps(doc))
        return version, count

    def drop_version(self, version: str) -> None:
        """Removes a version that is not current; its data go with the next ``gc``."""
        if version != self.current_version():
            self.versions.delete(f"{version}.json")

    def create(self, rows: DataFrame | None = None, capacity: int | None = None, set_current: bool = True) -> str:
        rows = self.spark.createDataFrame([], self.schema.log_type(self.msg_id)) if rows is None else rows
        old = self.current_version()
        twice = rows.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("entity_id").first()
        if twice is not None:
            raise ValueError(f"entity {twice[0]!r} has several rows; a table has one row per entity")
        version, _ = self.write_version(rows, capacity)
        if set_current and self.swing(old, version) != 1:
            self.drop_version(version)
            raise LockHeldError("another version was published meanwhile")
        return version

    def _checked(self, version: str | None) -> tuple[str, dict]:
        version = version or self.current_version()
        if version is None:
            raise TableNotFoundError(f"{self.schema.name} has no current version")
        m = self.manifest(version)
        if m["fingerprint"] != self.schema.fingerprint():
            raise SchemaMismatchError(f"{self.schema.name} {version} was written under version {m['schema']['version']} of the schema")
        return version, m

    def _scan(self, m: dict, some: list[int] | None = None) -> DataFrame:
        paths = [self.folder / f"data/{token}/bucket={b}" for b, (token, _) in m["where"].items() if some is None or int(b) in some]
        schema = self.schema.log_type(m["msg_id"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: str | None = None) -> DataFrame:
        """The current version, or a named one, checked against the schema that the caller declares."""
        return self._scan(self._checked(version)[1])

    # --- operators ---
    def _of(self, entity_id: str) -> DataFrame:
        if not entity_id:
            raise ValueError("entity_id must not be empty")
        m = self._checked(None)[1]
        bucket = self.spark.sql("select pmod(xxhash64(:e), :n)", {"e": entity_id, "n": m["buckets"]}).first()[0]  # folded, no job
        return self._scan(m, [bucket]).where(F.col("entity_id") == entity_id)

    def lookup(self, entity_id: str):
        """The row of one entity, or None; one bucket is read."""
        return self._of(entity_id).first()

    def assemble(self, entity_id: str) -> list[float]:
        """The vector of one entity; a miss raises."""
        row = features.assemble(self._of(entity_id), self.schema).first()
        if row is None:
            raise EntityNotFoundError(entity_id)
        return list(row["vector"])

    def assemble_batch(self, requests: DataFrame) -> DataFrame:
        """Vectors and found mask of a table of requests (``entity_id``); an empty id is an error when it is met."""
        ok = requests.withColumn("entity_id", F.when(F.col("entity_id") == "", F.raise_error(F.lit("entity_id must not be empty"))).otherwise(F.col("entity_id")))
        return features.assemble_batch(ok, self.read(), self.schema)

    def assemble_ids(self, ids: list[str]) -> DataFrame:
        """The same for a list of ids, with ``pos``, the place in the list."""
        bad = [i for i, e in enumerate(ids) if not e]
        if bad:
            raise ValueError(f"empty entity_id at {bad[0]}")
        return self.assemble_batch(self.spark.createDataFrame(list(enumerate(ids)), "pos int, entity_id string"))

    def upsert(self, batch: DataFrame, capacity: int | None = None) -> tuple[int, int]:
        """Merges a batch by arrival (greatest message id) and publishes it; returns new and updated entities.

        Only the buckets that the batch touches are read and written. Merging a batch again changes nothing.
        """
        old, m = self._checked(None)
        bucket = self._bucket(m["buckets"])
        touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]
        current = self._scan(m, touched)
        n = features.upsert_counts(current, batch).first()
        version, _ = self.write_version(features.upsert(current, batch), capacity or m["capacity"], over=m, touched=touched)
        if self.swing(old, version) != 1:
            self.drop_version(version)
            raise LockHeldError("another writer published first; repeat the batch")
        return n["n_new"], n["n_updated"]

    # --- leases ---
    def lease(self, version: str | None = None, ttl_s: float = LEASE_TTL_S) -> Lock:
        """Marks a version as read; prolong it with ``renew``, end it with ``release``."""
        version = version or self.current_version()
        if version is None:
            raise TableNotFoundError(f"{self.schema.name} has no current version")
        lease = Lock(self.leases, f"{version}+{uuid.uuid4().hex}", ttl_s)
        lease.take()
        return lease

    def gc(self) -> list[str]:
        """Removes versions that are not current and have no living lease, and data that no version names and nobody writes."""
        live = set()
        for name in self.leases.names():
            if Lock(self.leases, name, 0).holder() is None:
                self.leases.delete(name)
            else:
                live.add(name.split("+")[0])
        gone, current = [], self.current_version()
        for name in self.versions.names():
            v = name.removesuffix(".json")
            if name.endswith(".json") and v != current and v not in live:
                self.versions.delete(name)
                gone.append(v)
        named = {token for name in self.versions.names() if name.endswith(".json") for token, _ in json.loads(self.versions.read(name) or '{"where": {}}')["where"].values()}
        data = self.folder.sub("data")
        for token in data.names():
            if token not in named and f"data-{token}" not in live and not token.startswith("."):
                data.delete(token)
        return gone
