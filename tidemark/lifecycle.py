"""Hydration from the log, compatibility of schemas, and upgrades.

Command line: ``python -m tidemark.lifecycle upgrade|gc|watch|compact ...``.
"""

from __future__ import annotations

import argparse
import importlib
import logging
import math
import os
import sys
import threading
import time
from dataclasses import dataclass

from pyspark.sql import SparkSession

from tidemark.errors import EmptyDatasetError, HydrationConflictError, LockHeldError, UpgradeAbortedError, UpgradeConflictError, UpgradeIncompatibleError
from tidemark.metrics import METRICS
from tidemark.operators import features
from tidemark.operators.compaction import CompactionTable, plan_merges
from tidemark.schema import DType, FeatureSchema
from tidemark.sources.feature_log import FeatureLog
from tidemark.sources.online import OnlineTable
from tidemark.storage import Lock

LIVE_S = 30.0
# fixed values: dtypes a field may be widened to
WIDER = {
    DType.FLOAT32: {DType.FLOAT64},
    DType.INT32: {DType.INT64},
    DType.UINT8: {DType.INT32, DType.INT64},
}


@dataclass(frozen=True)
class HydrationResult:
    version: str
    entity_count: int
    capacity: int
    seconds: float


@dataclass(frozen=True)
class UpgradeResult:
    schema_name: str
    old_version: int
    new_version: int
    dry_run: bool
    entity_count: int
    row_size_bytes_old: int
    row_size_bytes_new: int
    added: tuple[str, ...]
    widened: tuple[str, ...]
    version: str | None = None


def live_mark(table: OnlineTable) -> Lock:
    """What a consumer of a table holds and renews while it runs, idle or not."""
    return table.lock("live", LIVE_S)


def consumer_live(table: OnlineTable) -> bool:
    return live_mark(table).holder() is not None


def hydrate(schema: FeatureSchema, log: FeatureLog, online: OnlineTable, *, capacity_factor: float = 4.0, as_of_time_ns: int | None = None, lookback_days: int = 30) -> HydrationResult:
    """Builds the current-value table from the log's latest rows. Written first, published last."""
    began = time.time()
    if not math.isfinite(capacity_factor) or capacity_factor < 2:
        raise ValueError("capacity_factor must be finite and at least 2")
    if online.current_version() is not None:
        raise HydrationConflictError(f"{schema.name} has a current version")
    if consumer_live(online):
        raise HydrationConflictError(f"a consumer of {schema.name} is live")
    version, n = online.write_version(log.latest_features(schema, lookback_days, as_of_time_ns))
    if not n:
        online.drop_version(version)
        raise EmptyDatasetError(f"the log of {schema.name} has no rows in its lookback")
    if online.swing(None, version) != 1:
        online.drop_version(version)
        raise HydrationConflictError(f"{schema.name} was published meanwhile")
    return HydrationResult(version, n, max(int(n * capacity_factor), 16), time.time() - began)


def can_upgrade(old: FeatureSchema, new: FeatureSchema) -> tuple[bool, list[str]]:
    """Whether rows of ``old`` can become rows of ``new``, with every reason why not."""
    why = []
    if new.version <= old.version:
        why.append(f"version {new.version} is not above {old.version}")
    for f in old.fields:
        if f.name not in new.names:
            why.append(f"{f.name} is removed")
            continue
        g = new[f.name]
        if f.shape != g.shape:
            why.append(f"{f.name}: shape {f.shape} becomes {g.shape}")
        if f.dtype is not g.dtype and g.dtype not in WIDER.get(f.dtype, set()):
            why.append(f"{f.name}: {f.dtype.short} cannot become {g.dtype.short}")
        if len(f.shape) > 1 or len(g.shape) > 1:
            why.append(f"{f.name}: fields of rank 2 cannot be kept")
    why += [f"{g.name}: a new field may not have rank {len(g.shape)}" for g in new.fields if g.name not in old.names and len(g.shape) > 1]
    return not why, why


def upgrade_schema(old: FeatureSchema, new: FeatureSchema, online: OnlineTable, *, capacity_factor: float = 1.0, dry_run: bool = False, wait_for_consumer: bool = True, wait_seconds: float = 60.0) -> UpgradeResult:
    """Rewrites the current version under ``new`` and swings the pointer if nobody else has.

    The log is never touched. A live consumer is waited for (or is a conflict); a failure leaves the old version current.
    """
    if old.name != new.name:
        raise ValueError(f"schema names differ: {old.name}, {new.name}")
    if not math.isfinite(capacity_factor) or capacity_factor <= 0:
        raise ValueError("capacity_factor must be finite and positive")
    ok, why = can_upgrade(old, new)
    if not ok:
        raise UpgradeIncompatibleError("; ".join(why))
    added = tuple(n for n in new.names if n not in old.names)
    widened = tuple(f.name for f in old.fields if new[f.name].dtype is not f.dtype)
    was = online.current_version()
    if was is None:
        raise UpgradeConflictError(f"{old.name} has no current version")
    before = OnlineTable(online.spark, os.path.dirname(online.dir), old, online.msg_id)
    if dry_run:
        n = before.manifest(was)["rows"]
        before.read(was)
        return UpgradeResult(old.name, old.version, new.version, True, n, old.row_bytes(), new.row_bytes(padded=False), added, widened)
    try:
        with online.lock("upgrade", 3600.0).held():
            deadline = time.time() + (wait_seconds if wait_for_consumer else 0.0)
            while consumer_live(online):
                if time.time() >= deadline:
                    raise UpgradeConflictError(f"a consumer of {old.name} is live")
                time.sleep(0.2)
            rows = before.read(was)
            version, n = online.write_version(features.translate(rows, old, new), schema=new)
            if online.swing(was, version) != 1:
                online.drop_version(version)
                raise UpgradeAbortedError("another version was published meanwhile")
    except LockHeldError as e:
        raise UpgradeConflictError(str(e)) from e
    return UpgradeResult(old.name, old.version, new.version, False, n, old.row_bytes(), new.row_bytes(), added, widened, version)


def compact_log(log: FeatureLog, schema: FeatureSchema, small_bytes: int = 64 << 20) -> dict:
    """Merges the small files of each day. Files and outputs are members of the compaction manifest in the schema's folder.

    Nothing is removed and the log's own readers go on with its files; readers of ``CompactionTable`` see the merged ones.
    """
    root = log.path(schema)
    files = log.listing(schema)
    table = CompactionTable(log.spark, root)
    if not table.log.latest()[1]:
        table.init(files.select("file_path"))
    return table.merge(plan_merges(files, small_bytes))


def watch(tables: list[OnlineTable], every_s: float, stop: threading.Event) -> dict[str, int]:
    """Cleans up tables every so often until told to stop; a table that fails is tried again. Returns what was removed."""
    gone: dict[str, int] = {}
    while True:
        for t in tables:
            try:
                n = len(t.gc())
                gone[t.schema.name] = gone.get(t.schema.name, 0) + n
                METRICS.count("watchdog_removed_total", n, table=t.schema.name)
            except Exception:  # the other tables go on
                METRICS.count("watchdog_failed_total", table=t.schema.name)
                logging.getLogger(__name__).exception("cleaning up %s failed", t.schema.name)
        if stop.wait(every_s):
            return gone


def _load(spec: str) -> FeatureSchema:
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="command", required=True)
    up = sub.add_parser("upgrade", help="rewrite the current version under a newer schema")
    up.add_argument("--base", required=True)
    up.add_argument("--old", required=True, help="module:NAME")
    up.add_argument("--new", required=True, help="module:NAME")
    how = up.add_mutually_exclusive_group(required=True)
    how.add_argument("--dry-run", action="store_true")
    how.add_argument("--confirm", action="store_true")
    gc = sub.add_parser("gc", help="remove versions that nobody reads")
    gc.add_argument("--base", required=True)
    gc.add_argument("--schema", required=True, help="module:NAME")
    dog = sub.add_parser("watch", help="do so every so often")
    dog.add_argument("--base", required=True)
    dog.add_argument("--schema", required=True, nargs="+", help="module:NAME")
    dog.add_argument("--every", type=float, default=60.0, help="seconds")
    pack = sub.add_parser("compact", help="merge the small files of a schema's log into larger ones, in a table of its own")
    pack.add_argument("--log", required=True, help="folder of the logs")
    pack.add_argument("--schema", required=True, help="module:NAME")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "gc":
        print(*OnlineTable(spark, a.base, _load(a.schema)).gc(), sep="\n")
        return 0
    if a.command == "watch":
        watch([OnlineTable(spark, a.base, _load(x)) for x in a.schema], a.every, threading.Event())
        return 0
    if a.command == "compact":
        print(compact_log(FeatureLog(spark, a.log), _load(a.schema)))
        return 0
    old, new = _load(a.old), _load(a.new)
    table = OnlineTable(spark, a.base, new)
    try:
        print(upgrade_schema(old, new, table, dry_run=True))
        if a.confirm:
            print(upgrade_schema(old, new, table))
    except (UpgradeConflictError, UpgradeIncompatibleError, UpgradeAbortedError, ValueError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
