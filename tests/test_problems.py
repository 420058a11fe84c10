"""Problems 1 to 7 on small tables with the awkward cases: nulls, ties, repeats, empty tables, extra columns, hot keys."""

import json
import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.errors import ConflictError, LockHeldError
from tidemark.functions import DAY_NS
from tidemark.operators import compaction, drift, history, incremental, late, quotient, versions
from tidemark.plans import problems
from tidemark.schema import DType, FeatureField, FeatureSchema
from tidemark.storage import CommitLog, Folder, Lock

LOG = "delivery_no bigint, shard int, batch_no int, file_no bigint, event_date string, entity_id string, event_time_ns bigint, age int, clicks bigint, ltv double, score float, msg_id_ms bigint, msg_id_seq int"
RUNS = "run_no bigint, shard int, attempt int, status string, lo_ms bigint, lo_seq int, hi_ms bigint, hi_seq int, done_ms bigint, done_seq int, seen_batch_no int, started_ms bigint, finished_ms bigint"
NAN = float("nan")


def msg(no, entity, ms, seq=0, t=0, batch=1, shard=1, clicks=1):
    return (no, shard, batch, 1, "1970-01-01", entity, t, 1, clicks, 1.0, 1.0, ms, seq)


def log(spark, data):
    return spark.createDataFrame(data, LOG).withColumn("_blk", F.lit("x")).withColumn("_e", F.lit(1))  # names that the operators use inside


# --- 1 ---
def test_open_messages(spark):
    data = [
        msg(1, "A", 10), msg(2, " a\t", 10, batch=9),  # done by the first copy
        msg(3, "b", 10, batch=3), msg(4, "a", 20), msg(5, "a", 21), msg(6, None, 30), msg(7, None, 30), msg(8, "a", None, None), msg(9, "z", 15, shard=None), msg(10, "q", 15, batch=None),
        msg(11, "c", 10, 5), msg(12, "c", 10, 6),
    ]
    runs = [
        (1, 1, 1, "committed", 0, 0, 20, 0, 20, 0, 2, 0, 0), (1, 1, 1, "committed", 0, 0, 20, 0, 20, 0, 2, 0, 0), (2, 1, 1, "rolled_back", 20, 0, 99, 0, 99, 0, 9, 0, 0),
        (3, 1, 1, "failed", 20, 0, 99, 0, None, None, 9, 0, 0), (4, 2, 1, "committed", 0, 0, 99, 0, 99, 0, 9, 0, 0), (5, 1, 1, "committed", 9, 0, 9, 0, 9, 0, 9, 0, 0), (6, 1, 1, "running", 0, 0, 99, 0, None, None, 9, 0, 0),
    ]
    got = rows(incremental.open_messages(log(spark, data), spark.createDataFrame(runs, RUNS)))
    assert got == sorted([(10, 0, "b"), (21, 0, "a"), (30, 0, None), (15, 0, "z"), (15, 0, "q")], key=str)
    none = rows(incremental.open_messages(log(spark, data[:1]), spark.createDataFrame([], RUNS)))
    assert none == [(10, 0, "a")]
    assert rows(incremental.open_messages(log(spark, []), spark.createDataFrame(runs, RUNS))) == []


def test_open_messages_large_ranges_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(incremental, "BROADCAST_RANGES", 0)
    test_open_messages(spark)


def test_long_and_short_ranges_cover_what_they_should(spark):
    runs = [(i, 1, 1, "committed", lo, 0, hi, 0, hi, 0, 5, 0, 0) for i, (lo, hi) in enumerate([(0, 10**12), (10**12 + 5, 10**12 + 6), (10**12 + 10, 10**12 + 3000), (2 * 10**12, 2 * 10**12 + 10**9)])]
    at = [1, 10**11, 10**12, 10**12 + 1, 10**12 + 6, 10**12 + 7, 10**12 + 2999, 10**12 + 3001, 2 * 10**12 + 10**8, 3 * 10**12]
    got = rows(incremental.open_messages(log(spark, [msg(i, "a", ms) for i, ms in enumerate(at)]), spark.createDataFrame(runs, RUNS)).select("msg_id_ms"))
    assert sorted(x[0] for x in got) == [10**12 + 1, 10**12 + 7, 10**12 + 3001, 3 * 10**12]


def test_incremental_runs_neither_skip_nor_repeat(spark, tmp_path):
    c = incremental.IncrementalConsumer(spark, str(tmp_path))
    t = lambda n: spark.range(n).select("id", F.col("id").cast("int").alias("batch_no"))
    assert c.run(t(0), incremental.snapshot_limit(t(0))) is None
    assert c.run(t(5), 4) == 4
    with pytest.raises(ZeroDivisionError):
        c.run(t(9), 8, lambda df: 1 / 0)
    assert c.watermark() == 4 and c.output().count() == 5
    other = incremental.IncrementalConsumer(spark, str(tmp_path))
    assert other.run(t(9), 8) == 8 and c.run(t(9), 8) is None
    assert sorted(r[0] for r in c.output().select("id").collect()) == list(range(9))


def test_a_half_written_flush_is_not_passed_over(spark, tmp_path):
    marks, c = incremental.FlushMarks(spark, str(tmp_path / "marks")), incremental.IncrementalConsumer(spark, str(tmp_path / "runs"))
    table = lambda *xs: spark.createDataFrame(list(xs), "id int, batch_no int")
    assert marks.complete() is None and c.run(table((1, 4)), marks.complete()) is None
    for n in (4, 5, 6):
        marks.begin(n)
    marks.seal(4)
    marks.seal(6)  # before 5
    assert c.run(table((1, 4), (2, 5), (4, 6)), marks.complete()) == 4
    assert c.run(table((1, 4), (2, 5), (4, 6)), marks.complete()) is None
    marks.seal(5)
    assert c.run(table((1, 4), (2, 5), (3, 5), (4, 6)), marks.complete()) == 6
    assert sorted(r[0] for r in c.output().select("id").collect()) == [1, 2, 3, 4]


def test_two_runs_from_one_watermark(spark, tmp_path):
    c = incremental.IncrementalConsumer(spark, str(tmp_path))
    t = spark.range(5).select("id", F.col("id").cast("int").alias("batch_no"))
    with pytest.raises(ConflictError):
        c.run(t, 4, lambda df: (incremental.IncrementalConsumer(spark, str(tmp_path)).run(t, 4), df)[1])
    assert c.output().count() == 5


@pytest.mark.parametrize("hadoop", [False, True])
def test_commits_and_locks(spark, tmp_path, hadoop):
    folder = Folder(spark, str(tmp_path / "x"), hadoop)
    log = CommitLog(folder)
    assert log.latest() == (-1, {})
    log.append(0, {"a": "é"})
    log.append(1, {"a": 2})
    with pytest.raises(ConflictError):
        log.append(1, {"a": 3})
    assert log.latest() == (1, {"a": 2}) and log.all() == [{"a": "é"}, {"a": 2}]
    log.prune(1)
    assert log.all() == [{"a": 2}]
    a, b = Lock(folder, "lock", 60), Lock(folder, "lock", 60)
    with a.held(), pytest.raises(LockHeldError):
        b.take()
    b.take()
    with pytest.raises(LockHeldError):
        a.renew()
    b.ttl_s = -1
    b.renew()  # expires at once
    stale = [Lock(folder, "lock", 60) for _ in range(2)]
    n, _ = stale[0].log.latest()
    stale[0]._put(n)
    with pytest.raises(LockHeldError):  # both saw the expired lock; one has it
        stale[1]._put(n)
    assert b.holder() == stale[0].token


# --- 2 ---
def brute_kept(data):
    best = {}
    for r in data:
        e = r[5].strip(" \t").lower() if r[5] is not None else None
        k = (e, r[11], r[12]) if r[11] is not None else (e, "t", r[6])
        best[k] = min(best.get(k, 1 << 62), r[0])
    return set(best.values())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "A ", "b", None, ""]), st.sampled_from([None, 1, 2]), st.integers(-1, 1), st.sampled_from([0, 5, -(1 << 62)])), max_size=40))
def test_repeated_deliveries_match_brute_force(spark, xs):
    data = [msg(i, e, ms, None if ms is None else seq, t) for i, (e, ms, seq, t) in enumerate(xs)]
    got = {r[0] for r in quotient.repeated_deliveries(log(spark, data)).collect()}
    assert got == {r[0] for r in data} - brute_kept(data)


def test_quotient_table_grows_and_is_exact():
    rng = np.random.default_rng(0)
    t = quotient.QuotientTable(4)
    a, b = rng.integers(0, 50, 5000), rng.integers(0, 50, 5000)
    e = t.codes(pa.array([f"e{i}" for i in rng.integers(0, 3, 5000)]))
    lost = [t.insert(a[i : i + 700], b[i : i + 700], e[i : i + 700], np.arange(i, min(i + 700, 5000))) for i in range(0, 5000, 700)]
    first = {}
    for i, k in enumerate(zip(a.tolist(), b.tolist(), e.tolist(), strict=True)):
        first.setdefault(k, i)
    assert sorted(t.entries()[3].tolist()) == sorted(first.values())
    assert sorted(np.concatenate(lost).tolist()) == sorted(set(range(5000)) - set(first.values()))


def test_hot_message_and_small_combiner(spark, monkeypatch):
    monkeypatch.setattr(quotient, "COMBINER_ENTRIES", 3)
    data = [msg(i, "a", 1) for i in range(200)] + [msg(1000 + i, "a", i) for i in range(2, 50)]
    got = sorted(r[0] for r in quotient.repeated_deliveries(log(spark, data)).collect())
    assert got == list(range(1, 200))
    assert quotient.distinct_messages(log(spark, data)).count() == 49


def test_quotient_store_over_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quotient, "MAX_PARTS", 2)
    s = quotient.QuotientStore(spark, str(tmp_path))
    assert s.output() is None
    no = lambda df: sorted(r[0] for r in df.select("delivery_no").collect())
    assert no(s.insert(log(spark, [msg(1, "a", 1), msg(2, "A", 1), msg(3, "b", 1)]))) == [1, 3]
    assert no(s.insert(log(spark, [msg(4, "a ", 1), msg(5, "c", 1), msg(6, None, 1)]))) == [5, 6]
    assert s.insert(log(spark, [msg(7, None, 1)])).count() == 0
    assert no(s.insert(log(spark, [msg(8, "c", 1), msg(9, "d", 1)]))) == [9]
    assert no(s.output()) == [1, 3, 5, 6, 9] and s.seen().count() == 5


def test_a_batch_that_died_before_its_commit_is_not_lost(spark, tmp_path):
    s = quotient.QuotientStore(spark, str(tmp_path))
    rows_, n, doc = s.prepare(log(spark, [msg(1, "a", 1)]))  # and here the run dies
    assert s.insert(log(spark, [msg(1, "a", 1), msg(2, "b", 1)])).count() == 2
    with pytest.raises(ConflictError):
        s.log.append(n, doc)
    assert s.output().count() == 2 and s.seen().count() == 2


# --- 3 ---
ITEMS = "update_no bigint, entity_id string, event_time_ns bigint, price float, quantity int, origin string, msg_id_ms bigint, msg_id_seq int, event_date string"


def items(spark, xs):
    return spark.createDataFrame([(i, e, t, p, q, "update", ms, 0, "d") for i, (e, t, p, q, ms) in enumerate(xs)], ITEMS)


def brute_versions(xs):
    pts = {}
    for e, t, p, q, ms in xs:
        if t is not None and ((e, t) not in pts or ms > pts[e, t][0]):
            pts[e, t] = (ms, p, q)
    out = []
    for e in {e for e, _ in pts}:
        starts, prev = [], None
        for t in sorted(t for f, t in pts if f == e):
            cur = (str(pts[e, t][1]), pts[e, t][2])
            if cur != prev:
                starts.append(t)
            prev = cur
        out += [(e, a, b) for a, b in zip(starts, [*starts[1:], -1], strict=True)]
    return sorted(out, key=str)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 30)), st.sampled_from([1.0, 2.0, NAN, None]), st.sampled_from([1, None])), max_size=60))
def test_item_versions_match_brute_force_with_and_without_hot_keys(spark, xs):
    xs = [(*x, i) for i, x in enumerate(xs)]
    want = brute_versions(xs)
    for hot in (100_000, 3):
        cut = len(xs) // 2
        loads = [(items(spark, x), i) for i, x in enumerate((xs[cut:], xs[:cut]))]  # the later ids first
        with tempfile.TemporaryDirectory() as d:
            got = history.item_versions(loads, history.HistoryLedger(spark, d), hot_rows=hot)
            assert rows(got.select("entity_id", "valid_from_ns", "valid_to_ns")) == want


def test_ledger_supersedes_without_overwriting(spark):
    a = history.apply_updates(None, items(spark, [("x", 10, 1.0, 1, 1), ("x", 30, 2.0, 1, 2), ("y", 5, 1.0, 1, 3)]), 100)
    late_ = items(spark, [("x", 20, 9.0, 1, 4)])
    b = history.apply_updates(a, late_, 200)
    cols = ("entity_id", "valid_from_ns", "valid_to_ns", "price", "recorded_from", "recorded_to")
    assert rows(b.select(*cols)) == sorted([("x", 10, 30, 1.0, 100, 200), ("x", 10, 20, 1.0, 200, -1), ("x", 20, 30, 9.0, 200, -1), ("x", 30, -1, 2.0, 100, -1), ("y", 5, -1, 1.0, 100, -1)], key=str)
    assert rows(history.as_recorded(b, 150).select(*cols[:4])) == rows(a.select(*cols[:4]))
    assert rows(history.apply_updates(b, late_, 300).select(*cols)) == rows(b.select(*cols))


def test_stored_ledger_appends_only(spark, tmp_path):
    t = history.HistoryLedger(spark, str(tmp_path))
    assert t.ledger() is None and t.current() is None
    files = lambda: {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "rows") for f in fs}
    t.load(items(spark, [("x", 10, 1.0, 1, 1), ("x", 30, NAN, 1, 2), ("y", 5, 1.0, 1, 3), (None, 5, None, None, 4)]), 100)
    before, one = files(), t.ledger().collect()
    second = items(spark, [("x", 20, 9.0, 1, 4), ("x", 30, NAN, 1, 2), (None, None, 1.0, 1, 9)])
    with pytest.raises(ZeroDivisionError):
        real, t.log.append = t.log.append, lambda *a: 1 / 0
        t.load(second, 200)  # dies before its commit
    t.log.append = real
    assert sorted(map(str, t.ledger().collect())) == sorted(map(str, one))
    t.load(second, 200)
    assert before.items() <= files().items()
    cols = ("entity_id", "valid_from_ns", "valid_to_ns", "recorded_from", "recorded_to")
    assert rows(t.ledger().select(*cols)) == sorted(
        [("x", 10, 30, 100, 200), ("x", 10, 20, 200, -1), ("x", 20, 30, 200, -1), ("x", 30, -1, 100, -1), ("y", 5, -1, 100, -1), (None, 5, -1, 100, -1)], key=str
    )
    with pytest.raises(ValueError):
        t.load(second, 200)
    t.load(items(spark, []), 300)
    t.load(second, 400)
    assert rows(history.as_recorded(t.ledger(), 150).select(*cols[:3])) == rows(spark.createDataFrame([tuple(r)[:3] for r in one], "e string, f bigint, t bigint"))
    assert t.ledger().count() == 6


# --- 4 ---
def test_late_events(spark, tmp_path):
    day, h = DAY_NS, 3_600_000
    data = [
        msg(1, "a", 23 * h, t=5), msg(2, "a", 24 * h, t=6, batch=2), msg(3, "A", 24 * h, t=6, batch=3), msg(4, "a", 71 * h + h - 1, t=7, batch=4), msg(5, "a", 72 * h, t=8, batch=4),
        msg(6, "a", None, None, t=9), msg(7, "b", 24 * h, t=day, batch=2), msg(8, "c", 30 * h, t=-1, batch=2, clicks=None), msg(9, "d", 1, t=None),
    ]
    x = log(spark, data)
    for batches in (1, 2, 5):
        t = late.run(x, late.KeyedTotals(spark, str(tmp_path / f"{batches}")), batches)
        assert rows(late.revisions(t).select("entity_id", "event_date", "batch_no")) == [("a", "1970-01-01", 2), ("a", "1970-01-01", 4), ("c", "1969-12-31", 2)]
        assert rows(t.dropped().select("msg_id_ms")) == [(72 * h,)]
        assert rows(t.totals().select("entity_id", "n_messages", "clicks", "n_late", "n_revisions")) == [("a", 3, 3, 2, 2), ("b", 1, 1, 0, 0), ("c", 1, None, 1, 1)]
        assert rows(t.emissions().where("entity_id = 'a'").select("batch_no", "n_messages", "n_emissions")) == [(1, 1, 1), (2, 2, 2), (4, 3, 3)]
    before = rows(t.totals())
    t.apply(late.classified(x), 0)  # a batch that was applied
    assert rows(t.totals()) == before
    none = late.run(log(spark, []), late.KeyedTotals(spark, str(tmp_path / "none")))
    assert none.totals().count() == none.emissions().count() == none.dropped().count() == 0


def test_state_of_a_batch_that_died_is_not_seen(spark, tmp_path):
    t, x = late.KeyedTotals(spark, str(tmp_path)), late.classified(log(spark, [msg(1, "a", 1), msg(2, "a", 2)]))
    real, t.log.append = t.log.append, lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):
        t.apply(x, 0)
    assert t.totals().count() == 0
    t.log.append = real
    t.apply(x, 0)
    assert rows(t.totals().select("n_messages")) == [(2,)] and t.emissions().count() == 1


# --- 5 ---
QUERIES = "query_id bigint, entity_id string, as_of_time bigint, label int, fold int"


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "A", "b"]), st.integers(0, 40), st.integers(0, 40), st.integers(0, 1)), max_size=50), st.lists(st.tuples(st.sampled_from(["a", " b", "z", None]), st.one_of(st.none(), st.integers(0, 45))), max_size=15))
def test_known_at_matches_brute_force_with_and_without_hot_keys(spark, xs, qs):
    unit = 1_000_000
    data = [msg(i, e, ms, seq, t * unit, clicks=i) for i, (e, t, ms, seq) in enumerate(xs)]
    kept = brute_kept(data)
    queries = [(i, e, None if t is None else t * unit, 0, 0) for i, (e, t) in enumerate(qs)]
    look = 10 * unit
    want = []
    for i, e, t, _, _ in queries:
        if e is None or t is None:
            continue
        c = [(r[6], r[11], r[12]) for r in data if r[0] in kept and r[5].lower() == e.strip() and t - look <= r[6] <= t and r[11] * unit <= t]
        if c:
            want.append((i, *max(c)[1:]))
    q = spark.createDataFrame(queries, QUERIES)
    for hot in (100_000, 3):
        assert rows(versions.known_at(log(spark, data), q, [], look, hot).select("query_id", "msg_id_ms", "msg_id_seq")) == sorted(want, key=str)
    assert versions.known_at(log(spark, data), q, ["clicks"], look).count() == len(want)


def test_known_at_with_nulls_and_ties(spark):
    data = [msg(1, "a", 5, t=None), msg(2, "a", 6, t=0), msg(3, "A ", 5, t=9), msg(4, "b", None, None, t=0), msg(5, "a", 6, seq=1, t=0, clicks=7), msg(6, None, 1, t=0)]
    q = spark.createDataFrame([(1, "a", 10**7, 0, 0), (2, "a", 5 * 10**6, 0, 0), (3, "b", 10**9, 0, 0), (4, None, 10**9, 0, 0)], QUERIES).withColumn("_e", F.lit(1)).withColumn("clicks", F.lit(1))
    for hot in (100_000, 1):
        got = versions.known_at(log(spark, data), q, ["clicks"], hot_rows=hot)
        assert rows(got.select("query_id", "msg_id_ms", "msg_id_seq", "clicks")) == [(1, 6, 1, 7)]
    assert versions.known_at(log(spark, []), q, []).count() == 0 and versions.known_at(log(spark, data), q.limit(0), []).count() == 0


# --- 6 ---
FIELDS = "schema_name string, schema_version int, file_seq int, field_pos int, field_name string, dtype string, shape string"
UPGRADES = "upgrade_no bigint, schema_name string, old_version int, new_version int, file_seq int, dry_run boolean, entity_count int, row_size_bytes_old int, row_size_bytes_new int"


def test_drift_report(spark):
    f = [
        ("S", 1, 1, 0, "a", "f32", "[]"), ("S", 1, 1, 1, "b", "INT32", None), ("S", 1, 1, 2, "c", "4", "(2x3)"), ("S", 1, 1, 3, "d", "u8", "[4]"), ("S", 1, 1, 3, "d", "5", "(4)"),
        ("S", 2, 4, 0, "A", "float32", "()"), ("S", 2, 4, 1, "b", "f64", ""), ("S", 2, 4, 2, "c", "i64", "[2, 4]"), ("S", 2, 4, 4, "e", "u8", "[4]"),
        ("S", 2, 9, 0, "A", "1", ""), ("T", 1, 4, 0, "a", "f32", ""),
    ]
    u = [(1, "S", 1, 2, 4, True, 1, 0, 4 + 8 + 64 + 4), (2, "S", 1, 2, 4, False, 1, 0, 256), (3, "S", 1, 2, 9, None, 1, 0, 4), (4, "S", 1, 2, 77, False, 1, 0, 4), (5, "S", 1, 2, 9, None, 1, 0, None)]
    want = [
        ("S", 4, "A", "renamed"), ("S", 4, "b", "retyped"), ("S", 4, "c", "reshaped"), ("S", 4, "d", "removed"), ("S", 4, "e", "added"),
        ("S", 9, "b", "removed"), ("S", 9, "c", "removed"), ("S", 9, "e", "removed"), ("S", 9, "*", "size"),
    ]
    for hot in (100_000, 1):
        assert rows(drift.drift_report(spark.createDataFrame(f, FIELDS), spark.createDataFrame(u, UPGRADES), hot)) == sorted(want, key=str)
    assert drift.drift_report(spark.createDataFrame([], FIELDS), spark.createDataFrame([], UPGRADES)).count() == 0


def test_rescue_promote_and_replay(spark):
    v1 = FeatureSchema("S", 1, [FeatureField("a", DType.INT32), FeatureField("v", DType.FLOAT32, (2,))])
    raw = [(1, '{"a": "7", "v": [1, 2.5], "x": 3}'), (2, '{"a": 3000000000, "v": [1]}'), (3, '{"old": 5, "u": "NaN"}'), (4, "not json"), (5, None), (6, "{}"), (7, '{"a": 1, "old": 2}')]
    t = drift.ingest(spark.createDataFrame(raw, "record_id bigint, payload string"), v1, {"old": "a"})
    got = {r["record_id"]: r for r in t.collect()}
    assert (got[1]["a"], got[1]["v"], got[1]["_rescued"]) == (7, [1.0, 2.5], '{"x":"3"}')
    assert got[2]["a"] is None and got[2]["v"] is None and "3000000000" in got[2]["_rescued"]
    assert (got[3]["a"], got[3]["_rescued"]) == (5, '{"u":"NaN"}')
    assert all(got[i]["a"] is None and got[i]["_rescued"] is None for i in (5, 6))
    assert got[4]["_rescued"] == '{"_payload":"not json"}'
    assert (got[7]["a"], got[7]["_rescued"]) == (1, '{"old":"2"}')
    v2 = FeatureSchema("S", 2, [FeatureField("a", DType.INT64), *v1.fields[1:], FeatureField("x", DType.FLOAT64), FeatureField("u", DType.FLOAT32)])
    again = {r["record_id"]: r for r in drift.replay(t, v2).collect()}
    assert again[1]["x"] == 3.0 and again[1]["_rescued"] is None and again[2]["a"] == 3_000_000_000 and again[3]["u"] != again[3]["u"] and again[7]["a"] == 1


def test_no_payload_is_lost(spark):
    v1 = FeatureSchema("S", 1, [FeatureField("a", DType.INT32)])
    raw = [(1, '{"a": 5, "b": '), (2, "[1, 2]"), (3, '{"a": 1, "a": 2}'), (4, "  "), (5, "null"), (6, '{"x": 1, "x": 2, "a": 3}'), (7, '{"a": null}')]
    recs = spark.createDataFrame(raw, "record_id bigint, payload string")
    t = drift.ingest(recs, v1)
    got = {r["record_id"]: (r["a"], json.loads(r["_rescued"]) if r["_rescued"] else None) for r in t.collect()}
    whole = {i: {"_payload": p} for i, p in raw}
    assert got == {1: (None, whole[1]), 2: (None, whole[2]), 3: (2, whole[3]), 4: (None, None), 5: (None, None), 6: (3, {"x": "2", **whole[6]}), 7: (None, None)}
    assert sorted(map(str, drift.replay(t, v1).collect())) == sorted(map(str, t.collect()))
    target = spark.createDataFrame([("S", "a", "a", "i32", [])], "schema_name string, source_name string, field_name string, dtype string, dims array<bigint>")
    full = recs.selectExpr("record_id", "'S' schema_name", "1 file_seq", "'e' entity_id", "1L event_time_ns", "payload")
    u = {r["record_id"]: (r["features"], json.loads(r["_rescued"]) if r["_rescued"] else None) for r in drift.unified(full, target).collect()}
    assert u[1] == ({}, whole[1]) and u[3] == ({"a": "2"}, whole[3]) and u[7] == ({}, None)
    assert rows(drift.table_long(drift.unified(full, target), target).where("record_id = 3").select("field_name", "whole", "text")) == [("_payload", None, raw[2][1]), ("a", 2, None)]


def test_unified_table(spark):
    target = spark.createDataFrame([("S", "a", "a", "i32", [])], "schema_name string, source_name string, field_name string, dtype string, dims array<bigint>")
    recs = spark.createDataFrame([(1, "S", 1, "e", 1, '{"a": 1, "b": 2}'), (2, "S", 1, "e", 1, '{"a": 1.5, "b": null}'), (3, "T", 1, None, None, None)], "record_id bigint, schema_name string, file_seq int, entity_id string, event_time_ns bigint, payload string")
    got = {r["record_id"]: (r["features"], r["_rescued"]) for r in drift.unified(recs, target).collect()}
    assert got == {1: ({"a": "1"}, '{"b":"2"}'), 2: ({}, '{"a":"1.5"}'), 3: ({}, None)}


RECORDS = "record_id bigint, schema_name string, file_seq int, entity_id string, event_time_ns bigint, payload string"


def test_values_under_earlier_names_reach_the_typed_field(spark):
    f = [
        ("S", 1, 1, 0, "a", "i32", ""), ("S", 1, 1, 1, "v", "f32", "[2]"), ("S", 1, 1, 2, "gone", "u8", ""),
        ("S", 2, 4, 0, "b", "3", None), ("S", 2, 4, 1, "v", "f32", "[2]"), ("S", 2, 4, 3, "a", "f64", ""),  # a is in both files, so it was retyped and b added
        ("S", 3, 9, 0, "c", "i64", ""), ("S", 3, 9, 1, "w", "f32", "(2)"), ("S", 3, 9, 2, "gone", "u8", ""), ("S", 3, 9, 3, "a", "f64", ""),
        ("S", 2, 6, 0, "b", "i64", None), ("S", 2, 6, 1, "v", "f32", "[2]"), ("S", 2, 6, 3, "a", "f64", ""),
    ]
    recs = [
        (1, "S", 1, "e", 1, '{"a": 7, "v": [1, 2], "gone": 3, "odd": 4}'), (2, "S", 4, "e", 2, '{"b": 8, "a": 0.5}'), (3, "S", 9, "e", 3, '{"c": 9, "w": [3, 4], "b": 1}'),
        (4, "S", 1, "e", 4, '{"a": 7, "c": 6}'), (5, "S", 1, "e", 5, '{"a": 1.5, "c": 6}'), (6, "T", 1, "e", 6, '{"a": 1}'), (7, "S", 1, None, None, None), (8, "S", None, "e", 8, '{"a": 2}'),
    ]
    fields = spark.createDataFrame(f, FIELDS)
    t = drift.unified(spark.createDataFrame(recs, RECORDS), drift.latest_target(fields), drift.final_names(fields))
    got = {r["record_id"]: (r["features"], r["_rescued"]) for r in t.collect()}
    assert got == {
        1: ({"a": "7", "w": "[1,2]", "gone": "3"}, '{"odd":"4"}'), 2: ({"c": "8", "a": "0.5"}, None), 3: ({"c": "9", "w": "[3,4]"}, '{"b":"1"}'),
        4: ({"a": "7", "c": "6"}, None), 5: ({"a": "1.5", "c": "6"}, None), 6: ({}, '{"a":"1"}'), 7: ({}, None), 8: ({"a": "2"}, None),
    }
    long = rows(drift.table_long(t, drift.latest_target(fields)).select("record_id", "field_name", "whole", "vector", "text", "rescued"))
    assert [x for x in long if x[0] in (3, 4, 7) and x[1] != "w"] == [(3, "b", None, None, "1", True), (3, "c", 9, None, None, False), (4, "a", None, None, None, False), (4, "c", 6, None, None, False), (7, None, None, None, None, None)]
    assert (3, "w", None, [3.0, 4.0], None, False) in long


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_table_against_brute_force(spark):
    read = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    files, report = {}, {}
    for r in drift.declared_fields(read("schema_fields")).collect():
        files.setdefault(r["schema_name"], {}).setdefault(r["file_seq"], {})[r["field_name"]] = (r["pos"], r["dtype"], tuple(r["dims"]))
    for r in drift.field_changes(read("schema_fields")).where("change_kind = 'renamed'").collect():
        report.setdefault((r["schema_name"], r["file_seq"]), set()).add(r["field_name"])

    def final(schema, seq, name):  # from the record's file on
        fs = files.get(schema, {})
        for at in sorted(x for x in fs if x > seq):
            was, now = fs[max(x for x in fs if x < at)], fs[at]
            if name not in now:
                name = next((n for n in report.get((schema, at), ()) if n not in was and now[n] == was[name]), None)
                if name is None:
                    return None
        return name

    want, by_name = {}, 0
    for r in read("drift_records").collect():
        schema, seq = r["schema_name"], r["file_seq"]
        last = files[schema][max(files[schema])]
        for k, v in (json.loads(r["payload"]) if r["payload"] else {}).items():
            if v is not None:
                to = final(schema, seq, k)
                by_name += to is not None and to != k and k not in last
                want[r["record_id"], k] = to if to is not None else k if k in last and k not in {final(schema, seq, n) for n in files[schema][seq]} else None
    long = drift.rescued_long(read("drift_records"), drift.latest_target(read("schema_fields")), drift.final_names(read("schema_fields"))).collect()
    got = {(r["record_id"], r["source_name"]): r["field_name"] for r in long}
    assert by_name > 0 and [(k, got.get(k), want.get(k)) for k in got.keys() | want.keys() if k not in got or k not in want or got[k] != want[k]] == []
    t = problems.p6_table(spark, DATA).where("field_name is not null")
    assert t.count() == len(want)  # nothing lost, nothing twice
    typed = {(r["record_id"], r["field_name"]) for r in t.where("not rescued").collect()}
    assert sorted(typed ^ {(r["record_id"], r["field_name"]) for r in long if r["typed"]}) == []


# --- 7 ---
LIST = "listing_no bigint, file_no bigint, file_path string, event_date string, n_rows int, n_bytes bigint, batch_no int, written_ms bigint, replaced_by bigint, listed_ms bigint"


def test_merge_plan(spark):
    p = "schema=S/event_date={}/{}.parquet"
    f = [
        (1, 1, p.format("2020-01-01", 1), None, 1, 10, 1, 0, None, 1), (2, 2, p.format("2020%2D01%2D01", 2), None, 1, 20, 1, 0, None, 1), (3, 3, p.format("2020-01-02", 3), None, 1, 10, 1, 0, None, 1),
        (4, 4, p.format("2020-01-01", 4), None, 1, 65536, 1, 0, None, 1), (5, 5, p.format("2020-01-01", 5), None, 0, 10, 1, 0, None, 1), (6, 6, p.format("2020-01-01/_tmp", 6), None, 1, 10, 1, 0, None, 1),
        (7, 7, p.format("2020-01-01", 7), None, 1, None, 1, 0, None, 1), (8, 8, p.format("2020-01-01", 8), None, 1, 10, 1, 0, None, 1), (9, 8, p.format("2020-01-01", 8), None, 1, 10, 1, 0, 99, 2),
        (10, None, p.format("2020-01-01", 9), None, 1, 10, 1, 0, None, 1), (11, 11, "x.parquet", None, 1, 10, 1, 0, None, 1), (12, 12, None, None, 1, 10, 1, 0, None, 1),
    ]
    assert rows(compaction.plan_merges(spark.createDataFrame(f, LIST)).select("file_no")) == [(1,), (2,)]
    assert compaction.plan_merges(spark.createDataFrame([], LIST)).count() == 0


def test_longest_first_is_balanced_and_chunks_cover_everything(spark):
    f = [(i, i, f"event_date=d/{i}.parquet", None, 1, 1 + i % 97, 1, 0, None, 1) for i in range(500)]
    plan = compaction.plan_merges(spark.createDataFrame(f, LIST), target_bytes=2000, chunk_files=100).toPandas()
    assert sorted(plan["file_no"]) == list(range(500)) and plan["chunk_no"].nunique() == 5
    for _, c in plan.groupby("chunk_no"):
        loads = c.groupby("group_no")["n_bytes"].sum()
        assert loads.max() - loads.min() <= 97


def test_compaction_moves_every_row_once(spark, tmp_path):
    files, n = [], 0
    for i in range(12):
        path = tmp_path / f"event_date=2020-01-0{1 + i % 3}"
        path.mkdir(exist_ok=True)
        pq.write_table(pa.table({"id": list(range(n, n + i + 1))}), path / f"{i}.parquet")
        files.append((i, i, f"{path.name}/{i}.parquet", None, i + 1, (path / f"{i}.parquet").stat().st_size, 1, 0, None, 1))
        n += i + 1
    t = compaction.CompactionTable(spark, str(tmp_path))
    listed = spark.createDataFrame([(f[2],) for f in files], "file_path string")
    t.init(listed)
    before = sorted(r[0] for r in t.read().select("id").collect())
    m = t.merge(compaction.plan_merges(spark.createDataFrame(files, LIST)))
    assert m["outputs"] == 3 and t.files().count() == 3 and sorted(r[0] for r in t.read().select("id").collect()) == before == list(range(n))
    assert t.read(["2020-01-01"]).count() == 1 + 4 + 7 + 10
    wrong = [(*f[:4], f[4] + 1, *f[5:]) for f in files]
    t.init(listed)
    with pytest.raises(OSError):
        t.merge(compaction.plan_merges(spark.createDataFrame(wrong, LIST)))
    assert sorted(r[0] for r in t.read().select("id").collect()) == before and t.vacuum() == 6
    plan, real = compaction.plan_merges(spark.createDataFrame(files, LIST)), t._publish

    def late_publish(n_, after):  # another merge is published while this one is at work
        t._publish = real
        compaction.CompactionTable(spark, str(tmp_path)).merge(plan)
        real(n_, after)

    t._publish = late_publish
    with pytest.raises(ConflictError):
        t.merge(plan)
    assert sorted(r[0] for r in t.read().select("id").collect()) == before


def test_merged_files_stay_inside_the_folder(spark, tmp_path):
    root = tmp_path / "t"
    files = []
    for i, raw in enumerate(["a%2F..%2F..%2Fx", "a%2F..%2F..%2Fx", "..", ".."]):
        (root / f"event_date={raw}").mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table({"id": [i]}), root / f"event_date={raw}" / f"{i}.parquet")
        files.append((i, i, f"event_date={raw}/{i}.parquet", None, 1, 100, 1, 0, None, 1))
    t = compaction.CompactionTable(spark, str(root))
    t.init(spark.createDataFrame([(f[2],) for f in files], "file_path string"))
    assert t.merge(compaction.plan_merges(spark.createDataFrame(files, LIST)))["outputs"] == 2
    assert os.listdir(tmp_path) == ["t"] and sorted(r[0] for r in t.read().select("id").collect()) == [0, 1, 2, 3]
    assert {os.path.dirname(r[0]) for r in t.files().collect()} == {"event_date=a%2F..%2F..%2Fx", "event_date=.."}
