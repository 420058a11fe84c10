"""Feature log, current-value table, validation, lifecycle and streaming."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.errors import EmptyDatasetError, EntityNotFoundError, HydrationConflictError, LockHeldError, SchemaMismatchError, TableNotFoundError, UpgradeAbortedError, UpgradeConflictError, UpgradeIncompatibleError, WriteSyncTimeoutError
from tidemark.functions import DAY_NS, day_bucket, entity_key
from tidemark.lifecycle import hydrate, upgrade_schema
from tidemark.operators import features as ops
from tidemark.operators import late
from tidemark.operators.validate import split_valid
from tidemark.schema import DType, FeatureField, FeatureSchema
from tidemark.sources import FeatureLog, OnlineTable
from tidemark.streaming import Consumer, Producer, TotalsStream

XY = FeatureSchema("XY", 1, [FeatureField("x", DType.FLOAT32), FeatureField("y", DType.INT64)])
ROW = "entity_id string, event_time_ns bigint, x double, y bigint, msg_id_ms bigint, msg_id_seq int"


def frame(spark, data):
    return spark.createDataFrame([(e, t, float(x), y, ms, seq) for e, t, x, y, ms, seq in data], ROW)


def queries(spark, data):
    return spark.createDataFrame(data, "entity_id string, as_of_time bigint, label int")


def test_day_bucket_and_entity_key(spark):
    ns = [0, -1, DAY_NS - 1, DAY_NS, -DAY_NS, -DAY_NS - 1, (1 << 63) - 1, -(1 << 63)]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in ns], "n bigint").select(day_bucket("n")).collect()]
    assert got == ["1970-01-01", "1969-12-31", "1970-01-01", "1970-01-02", "1969-12-31", "1969-12-30", "2262-04-11", "1677-09-21"]
    assert [r[0] for r in spark.createDataFrame([(" A\t",), ("\n a",), (None,), ("",)], "e string").select(entity_key("e")).collect()] == ["a", "\n a", None, ""]


def test_point_in_time_golden_cases(spark, tmp_path):
    log = FeatureLog(spark, str(tmp_path))
    bad = log.append(frame(spark, [("A", 100, 1, 100, 1, 0), ("A", 110, 2, 200, 2, 0), ("A", 120, 3, 300, 3, 0), ("A", 120, 3, 300, 3, 0), ("T", 100, 1, 1, 4, 0), ("T", 100, 2, 2, 5, 0), ("L", 10**9, 7, 7, 6, 0), ("", 1, 1, 1, 7, 0)]), XY)
    assert rows(bad.select("_reason")) == [("entity:empty",)]
    q = queries(spark, [("A", 115, 0), ("A", 115, 0), ("A", 120, 1), ("A", 99, 1), ("T", 200, 0), ("L", 10**15, 0), ("L", 5 * 10**15, 0), ("Z", 5, 0), (None, 5, 0), ("A", None, 0)])
    out = log.read_point_in_time(XY, q, 30)
    assert out.columns == ["entity_id", "as_of_time", "label", "event_time_ns", "x", "y", "msg_id_ms", "msg_id_seq"]
    got = rows(out.select("entity_id", "as_of_time", "event_time_ns", "x"))
    assert got == sorted([("A", 115, 110, 2.0), ("A", 115, 110, 2.0), ("A", 120, 120, 3.0), ("A", 99, None, None), ("T", 200, 100, 2.0), ("L", 10**15, 10**9, 7.0), ("L", 5 * 10**15, None, None), ("Z", 5, None, None), (None, 5, None, None), ("A", None, None, None)], key=str)
    assert log.read_point_in_time(XY, q.limit(0)).count() == 0
    assert rows(log.latest_features(XY, as_of_time_ns=115).select("entity_id", "x")) == [("A", 2.0), ("T", 2.0)]
    assert rows(log.distinct_entity_ids(XY)) == [("A",), ("L",), ("T",)]
    assert rows(log.day_counts(XY)) == [("1970-01-01", 7)]


def test_reader_checks(spark, tmp_path):
    log = FeatureLog(spark, str(tmp_path))
    q = queries(spark, [("A", 1, 0)])
    for args in ((q, 0), (q.drop("as_of_time"), 1)):
        with pytest.raises(ValueError):
            log.read_point_in_time(XY, *args)
    for bad in (q.withColumn("entity_id", F.lit(1)), q.withColumn("as_of_time", F.lit(1.5))):
        with pytest.raises(TypeError):
            log.read_point_in_time(XY, bad)
    assert rows(log.read_point_in_time(XY, q).select("entity_id", "x", "msg_id_ms")) == [("A", None, None)]
    assert log.latest_features(XY).count() == 0 and log.scan(XY).count() == 0
    log.append(frame(spark, [("A", 1, 1, 1, 1, 0)]), XY)
    more = FeatureSchema("XY", 2, [*XY.fields, FeatureField("z", DType.INT32)])
    with pytest.raises(ValueError, match="lacks"):
        log.read_point_in_time(more, q)
    with pytest.raises(ValueError, match="clash"):
        log.read_point_in_time(XY, q.withColumn("x", F.lit(1)))
    FeatureLog(spark, str(tmp_path), msg_id=False).append(frame(spark, [("A", 1, 1, 1, 1, 0)]).drop("msg_id_ms", "msg_id_seq"), XY)
    with pytest.raises(ValueError, match="mixed"):
        log.read_point_in_time(XY, q)


def test_natural_key_log(spark, tmp_path):
    log = FeatureLog(spark, str(tmp_path), msg_id=False)
    log.append(frame(spark, [("T", 100, 1, 1, 1, 0), ("T", 100, 2, 2, 2, 0)]).drop("msg_id_ms", "msg_id_seq"), XY)
    assert rows(log.read_point_in_time(XY, queries(spark, [("T", 200, 0)])).select("event_time_ns", "x", "y")) == [(100, 2.0, 2)]


def test_scan_prunes_days(spark, tmp_path):
    log = FeatureLog(spark, str(tmp_path))
    log.append(frame(spark, [("A", i * DAY_NS, i, i, i, 0) for i in range(5)]), XY)
    df = log.scan(XY, DAY_NS, 2 * DAY_NS)
    assert df.count() == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "event_date" in plan.split("PartitionFilters")[1][:200]


def test_as_of_join_matches_brute_force_with_hot_keys(spark):
    rng = random.Random(4)
    data = [(rng.choice("ab"), rng.randrange(300), i, i, rng.randrange(50), i) for i in range(300)]
    qs = [(rng.choice("abz"), rng.randrange(320), i) for i in range(120)]
    want = []
    for e, t, i in qs:
        c = [(r[1], r[4], r[5]) for r in data if r[0] == e and t - 20 <= r[1] <= t]
        want.append((i, *(max(c) if c else (None, None, None))))
    for hot in (10**6, 40):
        got = ops.as_of_join(frame(spark, data), queries(spark, qs), ["x"], 20, hot_rows=hot)
        assert rows(got.select("label", "event_time_ns", "msg_id_ms", "msg_id_seq")) == sorted(want, key=str)


def test_validation_reasons(spark):
    s = FeatureSchema("V", 1, [FeatureField("f", DType.FLOAT32), FeatureField("u", DType.UINT8), FeatureField("v", DType.FLOAT32, (2,)), FeatureField("m", DType.INT32, (1, 2))])
    ok = (1.5, 3, [1.0, 1e39], [["1", "2"]])
    cases = {
        None: ok, "overflow:f": (1e39, *ok[1:]), "type:u": (1.0, 256, *ok[2:]), "missing:f": (None, *ok[1:]), "length:v": (*ok[:2], [1.0], ok[3]), "length:m": (*ok[:3], [["1"]]), "type:m": (*ok[:3], [["1", "x"]]),
    }
    data = [(f"e{i}", 1, *v) for i, v in enumerate(cases.values())] + [(None, 1, *ok), ("x" * 257, 1, *ok), ("n", None, *ok), ("nan", 1, math.nan, *ok[1:]), ("inf", 1, math.inf, *ok[1:])]
    df = spark.createDataFrame(data, "entity_id string, event_time_ns bigint, f double, u int, v array<double>, m array<array<string>>")
    good, bad = split_valid(df, s)
    assert sorted(r["entity_id"] for r in good.collect()) == ["e0", "inf", "nan"]
    assert good.where("entity_id = 'e0'").first()["v"] == [1.0, math.inf]
    assert sorted(r[0] for r in bad.select("_reason").collect()) == sorted([k for k in cases if k] + ["entity:null", "entity:too_long", "time:null"])
    with pytest.raises(ValueError):
        split_valid(df.drop("u"), s)
    with pytest.raises(ValueError):
        split_valid(df.withColumn("other", F.lit(1)), s)


def test_small_fractions_are_no_integers(spark):
    schema = FeatureSchema("S", 1, [FeatureField("f", DType.INT64)])
    values = ["2", "2.0", "2.00000000001", "1.99999999999", "9007199254740993", "9007199254740993.5"]
    for kind in ("string", "double"):
        df = spark.createDataFrame([(str(i), i, v) for i, v in enumerate(values[: 6 if kind == "string" else 4])], "entity_id string, event_time_ns bigint, f string").withColumn("f", F.col("f").cast(kind))
        good, bad = split_valid(df, schema)
        assert sorted(r["f"] for r in good.collect()) == [2, 2] + [9007199254740993] * (kind == "string")
        assert {r["_reason"] for r in bad.collect()} == {"type:f"}


def test_vectors(spark):
    s = FeatureSchema("P", 1, [FeatureField("zebra", DType.FLOAT32), FeatureField("alpha", DType.INT32), FeatureField("m", DType.UINT8, (2, 2)), FeatureField("beta", DType.FLOAT64)])
    t = spark.createDataFrame([("a", 2.5, 777, [[1, 2], [3, 4]], 1e40)], "entity_id string, zebra float, alpha int, m array<array<smallint>>, beta double")
    assert ops.assemble(t, s).first()["vector"] == [2.5, 777.0, 1.0, 2.0, 3.0, 4.0, math.inf]
    got = ops.assemble_batch(spark.createDataFrame([("a",), ("b",), ("a",)], "entity_id string"), t, s).select("entity_id", "found").collect()
    assert sorted(map(tuple, got)) == [("a", True), ("a", True), ("b", False)]


def test_online_table(spark, tmp_path):
    t = OnlineTable(spark, str(tmp_path), XY)
    with pytest.raises(TableNotFoundError):
        t.read()
    t.create(capacity=2)
    assert t.upsert(frame(spark, [("a", 5, 1, 1, 1, 0), ("a", 1, 2, 2, 2, 0), ("b", 1, 3, 3, 1, 0)])) == (2, 0)
    assert t.assemble("a") == [2.0, 2.0]  # the last arrival, though its event is older
    assert t.upsert(frame(spark, [("a", 9, 9, 9, 1, 5)])) == (0, 1) and t.assemble("a") == [2.0, 2.0]
    with pytest.raises(EntityNotFoundError):
        t.assemble("zz")
    with pytest.raises(ValueError):
        t.assemble_ids(["a", ""])
    got = sorted(tuple(r) for r in t.assemble_ids(["b", "zz", "b"]).select("pos", "vector", "found").collect())
    assert got == [(0, [3.0, 3.0], True), (1, [0.0, 0.0], False), (2, [3.0, 3.0], True)]
    assert t.lookup("b")["x"] == 3.0 and t.lookup("zz") is None
    from tidemark.errors import CapacityExceededError

    with pytest.raises(CapacityExceededError):
        t.upsert(frame(spark, [("c", 1, 1, 1, 9, 0)]))
    with pytest.raises(SchemaMismatchError):
        OnlineTable(spark, str(tmp_path), FeatureSchema("XY", 2, list(XY.fields))).read()
    old = t.current_version()
    lease = t.lease()
    t.upsert(frame(spark, [("b", 1, 4, 4, 9, 0)]))
    assert old not in t.gc()
    assert t.read(old).count() == 2
    lease.renew()
    lease.release()
    assert t.gc() == [old] and t.read().count() == 2
    assert t.swing("nothing", "x") == 0
    with t.lock("x").held(), pytest.raises(LockHeldError):
        t.lock("x").take()


def test_a_merge_writes_only_the_buckets_it_touches(spark, tmp_path):
    t = OnlineTable(spark, str(tmp_path), XY, buckets=8)
    t.create(frame(spark, [(f"e{i}", 1, i, i, 1, 0) for i in range(200)]))
    before = t.manifest(t.current_version())["where"]
    assert t.upsert(frame(spark, [("e7", 2, 70, 70, 2, 0), ("e7", 2, 71, 71, 3, 0)])) == (0, 1)
    after = t.manifest(t.current_version())["where"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert t.lookup("e7")["x"] == 71.0 and t.read().count() == 200
    assert len(t.gc()) == 1 and t.read().count() == 200 and len(t.folder.sub("data").names()) == 2
    stale = t.current_version()
    t.upsert(frame(spark, [("e8", 2, 1, 1, 9, 0)]))
    assert t.swing(stale, "x") == 0 and t.upsert(frame(spark, [])) == (0, 0) and t.read().count() == 200


def test_a_table_has_one_row_per_entity(spark, tmp_path):
    with pytest.raises(ValueError, match="several rows"):
        OnlineTable(spark, str(tmp_path), XY).create(frame(spark, [("a", 1, 1, 1, 1, 0), ("a", 2, 2, 2, 2, 0)]))


def test_message_ids_names_and_stable_ids(spark):
    import hashlib

    from tidemark.functions import msg_id_parts, safe_name, stable_id

    df = spark.createDataFrame([("12-3",), (None,)], "id string")
    assert [tuple(r) for r in df.select(*msg_id_parts("id")).collect()] == [(12, 3), (None, None)]
    for bad in ("12", "a-1", "1-2-3", ""):
        with pytest.raises(Exception, match="not a message id"):
            spark.createDataFrame([(bad,)], "id string").select(*msg_id_parts("id")).collect()
    names = ["a b", "é", "", None]
    got = [tuple(r) for r in spark.createDataFrame([(n,) for n in names], "n string").select(safe_name("n"), stable_id("n")).collect()]
    want = lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True)
    assert got == [("a_b", want("a b")), ("_", want("é")), ("", want("")), (None, None)]


def test_divergent_files_are_an_error(spark, tmp_path):
    log, more = FeatureLog(spark, str(tmp_path)), FeatureSchema("XY", 2, [*XY.fields, FeatureField("z", DType.INT32)])
    log.append(frame(spark, [("A", 1, 1, 1, 1, 0)]), XY)
    log.append(frame(spark, [("A", 2, 1, 1, 2, 0)]).withColumn("z", F.lit(1)), more)
    assert log.scan(XY).count() == 2
    with pytest.raises(ValueError, match="divergent"):
        log.scan(more)
    import shutil

    shutil.rmtree(tmp_path / "schema=XY" / "_forms")  # as a log that others wrote
    assert log.scan(XY).count() == 2
    with pytest.raises(ValueError, match="divergent"):
        log.scan(more)
    FeatureLog(spark, str(tmp_path), msg_id=False).append(frame(spark, [("A", 1, 1, 1, 1, 0)]).drop("msg_id_ms", "msg_id_seq"), XY)
    with pytest.raises(ValueError, match="mixed|divergent"):
        shutil.rmtree(tmp_path / "schema=XY" / "_forms")
        log.scan(XY)


def test_reading_a_window_opens_no_other_day(spark, tmp_path):
    log = FeatureLog(spark, str(tmp_path))
    log.append(frame(spark, [("A", i * DAY_NS, i, i, i, 0) for i in range(5)]), XY)
    for f in (tmp_path / "schema=XY" / "event_date=1970-01-05").glob("*.parquet"):
        f.write_bytes(b"broken")
    for f in (tmp_path / "schema=XY" / "event_date=1970-01-05").glob(".*.crc"):
        f.unlink()
    assert log.scan(XY, DAY_NS, 2 * DAY_NS).count() == 2
    assert log.read_point_in_time(XY, queries(spark, [("A", 2 * DAY_NS, 0)]), 1).first()["x"] == 2.0


@pytest.mark.parametrize("values", [{"x": "not a number", "y": 1}, {"x": 1, "y": 1.5}, {"x": 1e39, "y": 1}, {"x": None, "y": 1}, {"x": True, "y": 1}, {"x": 1, "y": 1 << 63}, {"x": [1], "y": 1}, {"x": 1}, {"x": 1, "y": 1, "z": 1}])
def test_producer_refuses_what_the_schema_cannot_hold(tmp_path, values):
    p = Producer(str(tmp_path))
    with pytest.raises(ValueError):
        p.write(XY, "a", values)
    for bad in ("", None, "x" * 257, 7):
        with pytest.raises(ValueError):
            p.write(XY, bad, {"x": 1, "y": 1})
    assert os.listdir(tmp_path / "wal") == []
    assert p.write(XY, "a", {"x": "1.5", "y": "2"}) and p.write(XY, "a", {"x": math.nan, "y": 2.0})


def test_one_consumer_and_its_heartbeat(spark, tmp_path):
    from tidemark.lifecycle import consumer_live

    base = str(tmp_path)
    one, two = Consumer(spark, base, [XY]), Consumer(spark, base, [XY])
    one.start(once=False)
    try:
        assert consumer_live(one.online["XY"])  # idle, yet live
        with pytest.raises(LockHeldError):
            two.start()
        n = one.locks[0].log.latest()[0]
        one.locks[0].renew()
        assert one.locks[0].log.latest()[0] > n
    finally:
        one.stop()
    assert not consumer_live(one.online["XY"])
    two.drain()


def test_noop_sink_and_retention(spark, tmp_path):
    from tidemark.sources import NoopSink

    base = str(tmp_path)
    p, c = Producer(base), Consumer(spark, base, [XY], log=NoopSink(), retain="delete", max_files=1)
    for i in range(3):
        p.write(XY, "a", {"x": i, "y": i}, 5)
    c.drain()
    assert c.online["XY"].assemble("a") == [2.0, 2.0] and not os.path.exists(tmp_path / "log")
    assert NoopSink().append(frame(spark, [("", 1, 1, 1, 1, 0)]), XY).count() == 1


def test_watchdog_compaction_and_metrics(spark, tmp_path):
    import json
    import logging
    import threading
    import urllib.request

    from tidemark.lifecycle import compact_log, watch
    from tidemark.metrics import JsonLines, Metrics, StreamMetrics
    from tidemark.operators.compaction import CompactionTable

    t = OnlineTable(spark, str(tmp_path / "online"), XY)
    t.create(frame(spark, [("a", 1, 1, 1, 1, 0)]))
    t.upsert(frame(spark, [("a", 1, 1, 1, 2, 0)]))
    stop = threading.Event()
    stop.set()
    assert watch([t], 60, stop) == {"XY": 1}
    log = FeatureLog(spark, str(tmp_path / "log"))
    for i in range(3):
        log.append(frame(spark, [("a", 1, i, i, i, 0)]), XY)
    assert compact_log(log, XY)["outputs"] == 1
    assert CompactionTable(spark, log.path(XY)).read().count() == 3
    m = Metrics()
    m.count("n_total", 2, kind="a")
    m.observe("s", 0.02)
    server = m.serve()
    text = urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/").read().decode()
    server.shutdown()
    assert 'n_total{kind="a"} 2' in text and 's_bucket{le="0.05"} 1' in text and "s_count 1" in text
    assert hasattr(StreamMetrics(m), "onQueryProgress")
    rec = logging.LogRecord("x", logging.INFO, "f", 1, "hi", None, None)
    rec.fields = {"k": 1}
    assert json.loads(JsonLines().format(rec))["k"] == 1


def test_hydrate_and_upgrade(spark, tmp_path):
    log, t = FeatureLog(spark, str(tmp_path / "log")), OnlineTable(spark, str(tmp_path / "online"), XY)
    with pytest.raises(ValueError):
        hydrate(XY, log, t, capacity_factor=1)
    with pytest.raises(EmptyDatasetError):
        hydrate(XY, log, t)
    new = FeatureSchema("XY", 2, [FeatureField("y", DType.INT64), FeatureField("x", DType.FLOAT64), FeatureField("n", DType.FLOAT32, (2,))])
    n = OnlineTable(spark, str(tmp_path / "online"), new)
    with pytest.raises(UpgradeConflictError):
        upgrade_schema(XY, new, n)
    log.append(frame(spark, [("a", 1, 1, 1, 1, 0), ("a", 5, 5, 5, 0, 0), ("b", 2, math.nan, 2, 1, 0)]), XY)
    r = hydrate(XY, log, t, as_of_time_ns=10)
    assert (r.entity_count, r.capacity) == (2, 16) and t.assemble("a") == [5.0, 5.0]
    with pytest.raises(HydrationConflictError):
        hydrate(XY, log, t)
    with pytest.raises(UpgradeIncompatibleError):
        upgrade_schema(XY, FeatureSchema("XY", 2, [FeatureField("x", DType.FLOAT32)]), n)
    dry = upgrade_schema(XY, new, n, dry_run=True)
    assert dry.dry_run and dry.row_size_bytes_new == 24 and t.read().count() == 2
    real = upgrade_schema(XY, new, n)
    assert (real.entity_count, real.row_size_bytes_new, real.added, real.widened) == (2, 192, ("n",), ("x",))
    assert n.assemble("a") == [5.0, 5.0, 0.0, 0.0] and math.isnan(n.assemble("b")[1])
    with pytest.raises(UpgradeConflictError), n.lock("upgrade").held():
        upgrade_schema(new, FeatureSchema("XY", 3, list(new.fields)), n)
    three = OnlineTable(spark, str(tmp_path / "online"), FeatureSchema("XY", 3, list(new.fields)))
    three.swing = lambda *a: 0
    with pytest.raises(UpgradeAbortedError):
        upgrade_schema(new, three.schema, three)


def test_stream_applies_quarantines_and_replays(spark, tmp_path):
    base = str(tmp_path)
    p, c = Producer(base), Consumer(spark, base, [XY])
    with pytest.raises(ValueError):
        p.write(XY, "a", {"x": 1})
    p.write(XY, "a", {"x": 3.0, "y": 3}, 300)
    p.write(XY, "a", {"x": 2.0, "y": 2}, 200)  # late: the table takes it, the log's latest does not
    p.write_many(XY, [("", {"x": 1, "y": 1}, 1), ("b", {"x": 1, "y": 1, "q": 0}, 1), ("c", {"x": 1, "y": 1.5}, 1)], check=False)
    p.write_many(FeatureSchema("Other", 1, list(XY.fields)), [("a", {}, 1)], check=False)
    with pytest.raises(WriteSyncTimeoutError):
        p.write_sync(XY, "d", {"x": 4, "y": 4}, 1, timeout_ms=30)

    real, calls = OnlineTable.upsert, []

    def dies(self, batch, capacity=None):
        calls.append(1)
        raise RuntimeError("lost")

    OnlineTable.upsert = dies
    try:
        with pytest.raises(Exception):  # noqa: B017
            c.drain()
    finally:
        OnlineTable.upsert = real
    c.drain()
    t = c.online["XY"]
    assert calls and t.assemble("a") == [2.0, 2.0] and t.assemble("d") == [4.0, 4.0]
    assert c.log.scan(XY).count() == 6  # the replayed batch is twice in the log
    assert ops.dedup_by_message(c.log.scan(XY)).count() == 3
    assert rows(c.log.latest_features(XY, as_of_time_ns=1000).where("entity_id = 'a'").select("x")) == [(3.0,)]
    assert rows(c.quarantined().select("reason")) == [("entity:empty",), ("type:y",), ("unknown:q",), ("unknown_schema",)]
    ids = [tuple(map(int, p.write(XY, "a", {"x": 1, "y": 1}, 1).split("-"))) for _ in range(5)]
    assert ids == sorted(set(ids))


def test_totals_stream_equals_batch(spark, tmp_path):
    log = spark.read.parquet("/root/testdata/sf0.001/feature_log.parquet") if os.path.exists("/root/testdata/sf0.001/feature_log.parquet") else pytest.skip("no test tables")
    src = tmp_path / "in"
    cut = [r[0] for r in log.select(F.percentile("delivery_no", [0.4, 0.8])).collect()][0]
    for i, (a, b) in enumerate(zip([-1, *cut], [*cut, 1 << 60], strict=True)):
        log.where((F.col("delivery_no") > a) & (F.col("delivery_no") <= b)).coalesce(1).write.mode("append").parquet(str(src))
    s = TotalsStream(spark, str(tmp_path / "out"))
    s.start(str(src), log.schema).awaitTermination()
    want = late.run(log, late.KeyedTotals(spark, str(tmp_path / "batch")))
    assert rows(s.totals().select("entity_id", "event_date", "n_messages", "clicks", "n_late")) == rows(want.totals().select("entity_id", "event_date", "n_messages", "clicks", "n_late"))
    assert rows(s.dropped()) == rows(want.dropped())
    key = ("entity_id", "event_date")
    final = s.emissions().groupBy(*key).agg(F.max("n_messages").alias("n_messages"))  # totals only grow
    assert rows(final) == rows(want.totals().select(*key, "n_messages"))
