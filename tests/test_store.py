"""Stored tables: windows of time, identities, versions that replace each other, streams."""

import random
import threading
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.functions.session import with_checkpoints
from tracemill.operators.eventlog import EventLog
from tracemill.sources import identities, versions
from tracemill.sources.store import Store
from tracemill.sources.tables import conform
from tracemill.streaming import live

AT = datetime(2026, 3, 1)
EVENT = "row_index long, source_event_id string, case_id string, activity string, occurred_at timestamp_ntz, completed_at timestamp_ntz, team string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(with_checkpoints(spark), str(tmp_path / "store"), "t1")


def made(spark, rows):
    """Events of (id, case, activity, hours from the first day)."""
    full = [(i, sid, case, a, AT + timedelta(hours=h), AT + timedelta(hours=h, minutes=10), "xy"[sum(map(ord, sid or "")) % 2]) for i, (sid, case, a, h) in enumerate(rows)]
    return spark.createDataFrame(full, EVENT)


# ------------------------------------------------------------------- windows


def test_a_window_reads_its_days(spark, store):
    rng = random.Random(1)
    rows = [(f"e{c}-{k}", f"c{c}", "abc"[k % 3], 24 * (c // 4) + rng.randrange(30) * k) for c in range(80) for k in range(4)]
    rng.shuffle(rows)
    for part in (rows[::2], rows[1::2]):  # a case comes in two batches
        store.insert_events(made(spark, part), "p")
    full = store.read("events", "p")
    assert "day" not in full.columns
    for start, end in [("2026-03-04 05:00:00", "2026-03-07 00:00:00"), (None, "2026-03-03 12:00:00"), ("2026-03-19 00:00:00", None), ("2027-01-01 00:00:00", None), (None, None)]:
        got, want = store.window("p", start, end), EventLog(full).between(start, end).events
        key = ["source_event_id", "case_id", "occurred_at"]
        assert sorted(map(str, got.select(key).collect())) == sorted(map(str, want.select(key).collect()))
        assert got.columns == full.columns
        part = store.between("p", start, end)
        assert {r.source_event_id for r in part.collect()} == {r.source_event_id for r in full.collect() if (start is None or str(r.occurred_at) >= start) and (end is None or str(r.occurred_at) < end)}
    few, several = (len(store.window("p", "2026-03-04 00:00:00", end).inputFiles()) for end in ("2026-03-05 00:00:00", "2026-03-12 00:00:00"))
    plan = store.between("p", "2026-03-04 00:00:00", "2026-03-05 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day" in plan.split("PartitionFilters")[1].split("]")[0]
    read = lambda df: df.select(F.input_file_name().alias("f")).distinct().count()
    days = [read(store._read("events", "p").where(F.col("day").between("2026-03-04", last))) for last in ("2026-03-05", "2026-03-12", "2026-12-31")]
    assert days[0] < days[1] < days[2]
    assert few and several


# ---------------------------------------------------------------- identities


def test_filters_hold_what_they_were_made_of():
    rng = np.random.default_rng(2)
    h = rng.integers(-(2**63), 2**63 - 1, 5000)
    raw = identities.make_filter(h)
    assert identities.may_hold(raw, h).all()
    other = rng.integers(-(2**63), 2**63 - 1, 200_000)
    assert identities.may_hold(raw, other).sum() <= 2 and len(raw) == 4 * 5000
    assert not identities.may_hold(identities.make_filter(h[:0]), other[:1000]).any()


def test_a_batch_meets_only_segments_that_it_can_repeat(spark, store, monkeypatch):
    monkeypatch.setattr(identities, "SEGMENT_IDS", 50)
    batches = [[(f"b{b}-{i}", f"c{i}", "x", b) for i in range(200)] for b in range(4)]
    for b in batches:
        assert store.insert_events(made(spark, b), "p") == (200, 0)
    ids = store.identities()
    known = lambda rows: made(spark, rows).withColumn("source_system", F.lit("api"))
    fresh = [(f"new{i}", "c", "x", 0) for i in range(100)]
    every = spark.read.parquet(ids.filters).count()
    assert every == 16 and ids.hit(known(fresh)) == []
    assert len(ids.hit(known([*fresh, batches[2][7]]))) == 1
    assert len(ids.hit(known(batches[1]))) == 4
    again = [*fresh, batches[2][7], batches[0][3], fresh[0]]
    assert store.insert_events(made(spark, again), "p") == (100, 3)
    monkeypatch.setattr("tracemill.sources.store.LOOKUP_ROWS", 10)  # beyond it all of the tenant's are met
    assert store.insert_events(made(spark, [*again, ("last", "c", "x", 1)]), "p") == (1, 103)
    other = Store(spark, store.root, "t2")
    assert other.insert_events(made(spark, again[:5]), "p") == (5, 0)


def test_identities_are_made_anew_after_an_insertion_that_broke_off(spark, store, monkeypatch):
    rows = [(f"e{i}", f"c{i}", "x", i) for i in range(20)]
    store.insert_events(made(spark, rows[:5]), "p")
    with monkeypatch.context() as m:
        m.setattr(identities.Identities, "add", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            store.insert_events(made(spark, rows[:12]), "p")
    assert store.identities().broken()
    assert store.insert_events(made(spark, rows), "p") == (8, 12)
    assert not store.identities().broken() and store.read("events", "p").count() == 20
    assert store.insert_events(made(spark, rows), "p") == (0, 20)


def test_events_that_nothing_identifies_all_stay(spark, store):
    rows = made(spark, [(None, None, "x", 0)] * 3 + [("a", "c", "x", 0)] * 2)
    assert store.insert_events(rows, "p") == (4, 1)


# ------------------------------------------------------------------ versions


def status(store, table="findings"):
    return {r.fingerprint: r.status for r in store.read(table, "p").collect()}


def table(spark, n, state="open"):
    return spark.createDataFrame([(f"f{i}", state) for i in range(n)], "fingerprint string, status string")


def test_a_writer_that_dies_leaves_the_old_rows(spark, store, monkeypatch):
    store.replace("findings", table(spark, 3), "p")
    for step in ("commit", "_taken"):
        with monkeypatch.context() as m:
            m.setattr(versions.Versions, step, lambda *_: (_ for _ in ()).throw(OSError("killed")))
            with pytest.raises(OSError, match="killed"):
                store.replace("findings", table(spark, 1, "resolved"), "p")
        assert status(store) == {f"f{i}": "open" for i in range(3)}
    # One that dies while it writes its number: others wait for it, and pass it over when it is dead.
    v = store.versions("findings", "p")
    v._taken(v.current()[0] + 1).close()
    assert status(store) == {f"f{i}": "open" for i in range(3)}
    with pytest.raises(versions.Conflict):
        store.replace("findings", table(spark, 2), "p")
    monkeypatch.setattr(versions, "DEAD_AFTER", -1.0)
    store.replace("findings", table(spark, 2, "resolved"), "p")
    assert status(store) == {"f0": "resolved", "f1": "resolved"}


def test_what_two_users_decide_at_once_is_kept(spark, store):
    store.replace("findings", table(spark, 6), "p")
    failed = []

    def decide(k):
        try:
            store.set_status("findings", "p", f"f{k}", "acknowledged" if k % 2 else "dismissed")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=decide, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert status(store) == {"f0": "dismissed", "f1": "acknowledged", "f2": "dismissed", "f3": "acknowledged", "f4": "open", "f5": "open"}


def test_old_versions_go(spark, store):
    for n in range(1, 7):
        store.replace("findings", table(spark, n), "p")
        assert store.read("findings", "p").count() == n
    v = store.versions("findings", "p")
    assert [n for n, _ in v._listed()] == [6, 5, 4]
    with pytest.raises(versions.Conflict):
        v.write(table(spark, 1), 5)


# ------------------------------------------------------------------- streams


def fed(spark, tmp_path, parts):
    """A stream of files, one a batch."""
    source = tmp_path / "in"
    schema = None
    for i, part in enumerate(parts):
        df = conform(made(spark, part))
        schema = df.schema
        df.coalesce(1).write.mode("append").parquet(str(source / f"part={i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(source / "*"))


def test_stream_drops_what_comes_again(spark, store, tmp_path):
    rows = [(f"e{i}", f"c{i % 3}", "x", i) for i in range(30)]
    parts = [rows[:10], [*rows[5:20], *rows[5:9]], [*rows, (None, None, "y", 1), (None, None, "y", 1)]]
    stream = fed(spark, tmp_path, parts)
    query = live.ingest_stream(stream, store, "p", str(tmp_path / "cp"))
    query.awaitTermination()
    assert store.read("events", "p").count() == 32
    kept = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert max(kept) <= 30  # identities, not events


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_open_cases_end_as_batch_cases(rocks, tmp_path):
    spark, rng = rocks, random.Random(4)
    rows = [(f"e{c}-{k}", f"c{c}", rng.choice("abc"), 3 * c + 2 * k + rng.randrange(2)) for c in range(6) for k in range(5)]
    late = [rows[3], rows[8]]  # come after later events of their cases
    first = [r for r in rows if r not in late]
    end = [("end", "other", "z", 24 * 30)]
    parts = [first[:15], [*first[10:], *first[:4]], [*late, *late], [("e0", "other", "z", 84)], [("e", "other", "z", 24 * 20)], end, [("end2", "other", "z", 24 * 30 + 1)]]
    live.to_memory(live.open_cases(fed(spark, tmp_path, parts), timedelta(hours=8), timedelta(days=3), "2 days"), "open_cases", "update").awaitTermination()
    got = spark.table("open_cases").collect()
    batch = {r.case_id: r for r in EventLog(conform(made(spark, rows))).cases().collect()}
    closed = {r.case_id: r for r in got if r.state == "closed" and r.case_id != "other"}
    assert set(closed) == set(batch)
    for case, r in closed.items():
        for c in ("started", "ended", "event_count", "service", "throughput", "waiting", "handoff_count", "rework_count", "manual_event_count", "variant_key"):
            assert r[c] == batch[case][c], (case, c)
        assert r.waited >= 3 * 86_400_000_000
    assert {r.state for r in got} == {"open", "stalled", "closed"}
    assert all(r.waited >= 8 * 3_600_000_000 for r in got if r.state == "stalled")
