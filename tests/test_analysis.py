"""Whole runs: log by rule, file, store, analysis, report."""

from pyspark.sql import functions as F

from tracemill.functions.session import with_checkpoints
from tracemill.operators.findings import Thresholds
from tracemill.plans import rollups
from tracemill.plans.analysis import analyze, report
from tracemill.sources import demo, files
from tracemill.sources.store import Store


def numbered(events):
    return events.withColumn("row_index", F.monotonically_increasing_id())


def test_demo_log_is_the_same_however_dealt(spark):
    a, b = (sorted(map(str, demo.order_log(spark, 30).repartition(n).drop("metadata").collect())) for n in (1, 7))
    assert a == b and len(a) > 30 * 8


def test_demo_file_maps_itself(spark, tmp_path):
    events = demo.order_log(spark, 40)
    demo.write_csv(events.coalesce(1), str(tmp_path / "csv"))
    rows = files.read_delimited(spark, str(tmp_path / "csv"))
    columns = [c for c in rows.columns if c != "row_index"]
    m = files.Mapping(files.suggest_mapping({r.column: r.inferred_type for r in files.infer_types(rows, columns).collect()}))
    assert (m.columns["case_id"], m.columns["activity_name"], m.columns["occurred_at"]) == ("order_id", "step", "timestamp")
    assert files.rejected_rows(rows, m).count() == 0
    got = files.normalize_events(rows, m)
    key = ["case_id", "activity", "occurred_at", "is_manual", "monetary_value"]
    assert got.select(key).exceptAll(events.select(key)).count() == 0 and got.count() == events.count()


def test_run_keeps_what_users_decided(spark, tmp_path):
    store = Store(with_checkpoints(spark), str(tmp_path / "s"), "t1")
    assert analyze(store, "orders") == {"cases": 0, "findings": 0, "opportunities": 0}
    store.insert_events(numbered(demo.order_log(spark, 200)), "orders")
    counts = analyze(store, "orders", sla_hours=72, hourly_cost=38)
    assert counts["cases"] == 200 and counts["findings"] and counts["opportunities"]
    findings = store.read("findings", "orders")
    assert {"excessive_waiting", "repeated_activity", "high_manual_repetition"} <= {r.finding_type for r in findings.collect()}
    best = store.read("opportunities", "orders").orderBy(F.desc("score")).first()
    assert (best.activity, best.status) == (demo.HAND_ENTRY, "proposed")
    # A user dismisses one, plans another; one that is open is found no more.
    own = ["tenant_id", "process_id"]
    dismissed = F.when(F.col("finding_type") == "repeated_activity", "dismissed").otherwise(F.col("status"))
    store.replace("findings", findings.withColumn("status", dismissed).withColumn("narrative", F.lit("seen")).drop(*own), "orders")
    store.replace("opportunities", store.read("opportunities", "orders").withColumn("status", F.when(F.col("activity") == demo.HAND_ENTRY, "planned").otherwise(F.col("status"))).drop(*own), "orders")
    analyze(store, "orders", sla_hours=72, thresholds=Thresholds(manual_repetition_share=1.1))
    status = {(r.finding_type, r.status) for r in store.read("findings", "orders").collect()}
    assert ("repeated_activity", "dismissed") in status and ("high_manual_repetition", "resolved") in status and ("excessive_waiting", "open") in status
    assert {r.narrative for r in store.read("findings", "orders").collect()} == {"seen"}
    assert {r.status for r in store.read("opportunities", "orders").where(F.col("activity") == demo.HAND_ENTRY).collect()} == {"planned"}
    assert store.read("metrics", "orders").count() == 2 and store.read("cases", "orders").count() == 200
    body = report(store, "orders", "Orders")
    assert "200 cases" in body and demo.HAND_ENTRY in body and store.read("reports", "orders").count() == 1


def test_tenants_and_empty_replacement(spark, tmp_path):
    one, other = (Store(with_checkpoints(spark), str(tmp_path / "s"), t) for t in ("1", "01"))
    rows = spark.createDataFrame([(1,), (2,)], "x long")
    one.replace("t", rows, "p/1")
    other.replace("t", rows.limit(1), "p/1")
    assert (one.read("t", "p/1").count(), other.read("t", "p/1").count()) == (2, 1)
    one.replace("t", rows.limit(0), "p/1")
    assert (one.read("t").count(), other.read("t").count()) == (0, 1)


FINDING = "process_id string, finding_type string, subject string, title string, severity string, status string, impact_score double, impact_hours double, evidence string, affected_case_count long, confidence double"


def test_report_leaves_dismissed_findings_out(spark):
    rows = [("p", "t", f"s{i:02}", f"title {i}", "high", "dismissed" if i < 10 else "open" if i % 2 else "resolved", 100.0 - i, 1.0, "{}", 9, 0.5) for i in range(24)]
    one = spark.createDataFrame([(1, 2, 1, 3600.0)], "case_count long, event_count long, variant_count long, median_throughput_seconds double")
    variants = spark.createDataFrame([], "variant_key string, sequence string, case_count long")
    scores = spark.createDataFrame([], "activity string, approach string, score double, estimated_hours_per_month double, estimated_eur_per_month double")
    payload = rollups.report_payload(one, variants, spark.createDataFrame(rows, FINDING), scores)
    assert [f["subject"] for f in payload["findings"]] == [f"s{i:02}" for i in range(10, 20)]
    assert "title 10" in (body := rollups.render_markdown("P", payload)) and "title 9:" not in body


def test_workspace(spark):
    late = "worsening_cycle_time"
    rows = [
        ("q", late, "trend", "slower by 50%", "high", "open", 3.0, 1.0, '{"subject":"trend","change_pct":0.5}'),
        ("p", late, "trend", "slower by 25%", "high", "open", 2.0, 1.0, '{"subject":"trend","change_pct":0.25}'),
        ("r", late, "trend", "slower by 90%", "high", "dismissed", 9.0, 1.0, '{"subject":"trend","change_pct":0.9}'),
        ("p", "excessive_waiting", "a", "waits", "high", "open", 5.0, 1.0, "{}"),
    ]
    findings = spark.createDataFrame([(*r, 9, 0.5) for r in rows], FINDING)
    events = spark.createDataFrame([("p",)] * 3 + [("q",)] * 4, "process_id string")
    cases = spark.createDataFrame([("p",), ("q",)], "process_id string")
    scores = spark.createDataFrame([("a", "planned", 1.0, 2.0, 70.0), ("b", "done", 3.0, 4.0, 140.0)], "activity string, status string, score double, estimated_hours_per_month double, estimated_eur_per_month double")
    r = rollups.workspace(events, cases, findings, scores).first()
    assert (r.process_count, r.event_count, r.case_count, r.open_findings, r.top_finding, r.top_opportunity) == (2, 7, 2, 3, "a", "b")
    assert [tuple(x) for x in r.worsening_processes] == [("p", "slower by 25%", 0.25), ("q", "slower by 50%", 0.5)]
    assert (r.recoverable_hours, r.recoverable_eur) == (2.0, 70.0)
    processes = spark.createDataFrame([("p",), ("q",), ("empty",)], "process_id string")
    r = rollups.workspace(events.limit(0), cases, findings.limit(0), scores, processes).first()
    assert (r.process_count, r.event_count, r.worsening_processes) == (3, 0, [])
