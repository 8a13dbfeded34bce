"""Import path: cells, timestamps, files, mapping, store, streams."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracemill.functions import text as tx
from tracemill.functions.session import with_checkpoints
from tracemill.plans import rollups
from tracemill.sources import files
from tracemill.sources.store import Store
from tracemill.sources.tables import conform
from tracemill.streaming import live


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(("raw", "clean"), [("=HYPERLINK(1)", "'=HYPERLINK(1)"), ("+1+1", "'+1+1"), ("-2+3", "'-2+3"), ("@SUM(A1)", "'@SUM(A1)"), ("  ok ", "ok"), ("x" * 10_000, "x" * 4096), (None, None), ("", "")])
def test_sanitize(spark, raw, clean):
    assert one(spark, tx.sanitize, raw) == clean


@pytest.mark.parametrize(
    ("raw", "parsed"),
    [
        ("2026-05-01T08:00:00+02:00", datetime(2026, 5, 1, 6)), ("2026-05-01T08:00:00Z", datetime(2026, 5, 1, 8)), ("2026-05-01 08:00", datetime(2026, 5, 1, 8)), ("01.05.2026 08:00", datetime(2026, 5, 1, 8)), ("1.5.2026", datetime(2026, 5, 1)),
        ("05/01/2026", datetime(2026, 5, 1)), ("20260501", datetime(2026, 5, 1)), ("2026", None), ("2026-05", None), ("soon", None), ("", None), (None, None), ("05/01/2026 08:00:00", None), ("31.02.2026", None),
    ],
)
def test_timestamps(spark, raw, parsed):
    assert one(spark, tx.timestamp, raw) == parsed


@pytest.mark.parametrize(("raw", "value"), [("120,50", 120.5), ("'-5", -5.0), ("5d", None), ("1,234.5", None), ("", None), ("None", None), ("1e3", 1000.0)])
def test_numbers(spark, raw, value):
    assert one(spark, tx.number, raw) == value


def test_redaction(spark):
    assert one(spark, tx.redact, "mail a.b@c.org or +49 (30) 1234567, DE89370400440532013000") == "mail [email] or [phone], [iban]"


def test_file_to_events(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("﻿order_id;step;timestamp;finished_at;department;channel;amount\nO1;Received;01.05.2026 08:00;01.05.2026 07:00;sales;manual;120,50\n;Sent;01.05.2026 09:00;;;web;\nO2;;soon;;;;\n", encoding="utf-8")
    rows = files.read_delimited(spark, str(path))
    columns = [c for c in rows.columns if c != "row_index"]
    assert columns[0] == "order_id"
    types = {r.column: r.inferred_type for r in files.infer_types(rows, columns).collect()}
    assert types["timestamp"] != "datetime"  # one cell is not a date
    mapping = files.suggest_mapping(types | {"timestamp": "datetime"})
    assert (mapping["case_id"], mapping["activity_name"], mapping["occurred_at"], mapping["is_manual"]) == ("order_id", "step", "timestamp", "channel")
    m = files.Mapping(mapping)
    got = files.normalize_events(rows, m).collect()
    assert [(r.case_id, r.activity, r.completed_at, r.is_manual, r.monetary_value) for r in got] == [("O1", "Received", None, True, 120.5)]
    assert got[0].source_event_id == "O1:Received:2026-05-01T08:00:00+00:00"
    bad = {r.row_index: r.problems for r in files.rejected_rows(rows, m).collect()}
    assert bad == {2: "missing case_id", 3: "missing activity_name; unparseable occurred_at"}


def test_store_and_stream(spark, tmp_path):
    store = Store(with_checkpoints(spark), str(tmp_path / "store"), "t1")
    rows = spark.createDataFrame([(1, "api", "a"), (2, "api", "b"), (3, "api", "a")], "row_index long, source_system string, source_event_id string")
    full = rows.withColumn("case_id", F.lit("c")).withColumn("activity", F.lit("x")).withColumn("occurred_at", F.lit(datetime(2026, 5, 1)).cast("timestamp_ntz"))
    assert store.insert_events(full, "p1") == (2, 1)
    assert store.insert_events(full, "p2") == (0, 3)
    assert Store(spark, store.root, "other").read("events").count() == 0
    source = tmp_path / "in"
    more = conform(full.withColumn("source_event_id", F.concat("source_event_id", F.lit("2"))))
    more.write.parquet(str(source))
    stream = spark.readStream.schema(more.schema).parquet(str(source))
    live.ingest_stream(stream, store, "p1", str(tmp_path / "cp")).awaitTermination()
    assert store.read("events", "p1").count() == 4
    live.to_memory(live.activity_rates(stream), "rates", "complete").awaitTermination()
    assert spark.table("rates").agg(F.sum("events")).first()[0] == 3


@pytest.mark.parametrize(
    ("columns", "case", "at"),
    [
        ({"casework": "string", "the_case_no": "string", "case_no": "string", "when": "datetime"}, "case_no", "when"),
        ({"Order ID": "string", "id": "string", "Start time": "datetime", "date": "datetime"}, "Order ID", "date"),
        ({"showcase": "string", "x": "number"}, "showcase", None),
    ],
)
def test_mapping_by_names(columns, case, at):
    got = files.suggest_mapping(columns)
    assert (got["case_id"], got.get("occurred_at")) == (case, at)


def test_match_scores():
    names = ("case_id", "case", "id")
    for column, score in [("case_id", 100), ("Case-ID", 100), ("case", 99), ("ID", 98), ("my_case_id", 60), ("case_no", 59), ("casework", 29), ("video", 28), ("other", 0), ("", 0)]:
        assert files.match_score(column, names) == score


def test_events_without_ids(spark, tmp_path):
    """Ids and systems that are missing are made, so nothing is lost and nothing comes twice."""
    store = Store(with_checkpoints(spark), str(tmp_path / "store"), "t1")
    at = datetime(2026, 5, 1, 8)
    five = [{"case_id": f"c{i}", "activity": "x", "occurred_at": at} for i in range(5)]
    assert store.insert_batch(five, "p") == (5, 0)
    assert store.insert_batch([*five, {**five[0], "source_system": "web"}], "p") == (1, 5)
    named = [{**e, "source_event_id": f"id{i}", "source_system": ""} for i, e in enumerate(five)]
    assert store.insert_batch(named, "p") == (5, 0) and store.insert_batch(named, "p") == (0, 5)
    ids = {(r.source_system, r.source_event_id) for r in store.read("events", "p").collect()}
    assert ("api", "c0:x:2026-05-01T08:00:00+00:00") in ids and ("api", "id0") in ids and len(ids) == 11
    for rows in ([], five * 2001):
        with pytest.raises(ValueError, match="1 to 10000"):
            store.insert_batch(rows, "p")


def test_import_replay_and_status(spark, tmp_path):
    store = Store(with_checkpoints(spark), str(tmp_path / "store"), "t1")
    process = store.create_process(" Orders ")
    assert store.create_process("Orders") == process != store.create_process("Other")
    rows = spark.createDataFrame([(1, "O1", "sent", "2026-05-01"), (2, "", "sent", "2026-05-02"), (3, "O2", "sent", "soon")], "row_index long, `the case` string, step string, day string")
    m = files.Mapping({"case_id": "the case", "activity_name": "step", "occurred_at": "day"})
    done = store.import_rows(rows, m, process)
    assert (done["accepted"], done["duplicates"], done["rejected"]) == (1, 0, 2)
    assert [(e["row_index"], e["problems"]) for e in done["errors"]] == [(2, "missing case_id"), (3, "unparseable occurred_at")]
    again = store.replay(process, done["import_id"], m)
    assert (again["accepted"], again["duplicates"], again["status"]) == (0, 1, "mapped")
    assert sorted(store.raw_rows(process, done["import_id"]).columns) == sorted(rows.columns)
    assert store.import_status(process, "none") is None


def test_set_status(spark, tmp_path):
    store = Store(with_checkpoints(spark), str(tmp_path / "store"), "t1")
    store.replace("findings", spark.createDataFrame([("f1", "open"), ("f2", "open")], "fingerprint string, status string"), "p")
    store.set_status("findings", "p", "f1", "dismissed")
    assert {r.fingerprint: r.status for r in store.read("findings", "p").collect()} == {"f1": "dismissed", "f2": "open"}
    with pytest.raises(ValueError, match="none of"):
        store.set_status("findings", "p", "f1", "done")
    with pytest.raises(KeyError):
        store.set_status("findings", "p", "f9", "open")


def test_columns_and_quoted_breaks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('_c0,,b\n1,2,"two\nlines"\n3,4,x\n', encoding="utf-8")
    assert [r.b for r in files.read_delimited(spark, str(path)).orderBy("row_index").collect()] == ["two\nlines", "x"]
    path.write_text("_c0,,b\n1,2,y\n", encoding="utf-8")
    assert files.read_delimited(spark, str(path)).columns == ["_c0", "b", "row_index"]


def test_report_renders(spark):
    from tracemill.plans import catalog

    sf = "/root/testdata/sf0.001"
    found = catalog._findings(catalog._day(with_checkpoints(spark), sf)).all().withColumn("status", F.lit("open"))
    payload = rollups.report_payload(catalog.summary(spark, sf), catalog.QUERIES["variants"](spark, sf), found, catalog.opportunities(spark, sf))
    text = rollups.render_markdown("Orders", payload)
    assert text.startswith("# Orders") and f"{payload['summary']['case_count']} cases" in text
    assert "EUR a month" in text and "do not show what causes" in text
    nothing = rollups.render_markdown("N", payload | {"findings": [], "opportunities": [], "variants": []})
    assert "beyond the thresholds" in nothing and "frequent enough" in nothing


def test_profile_of_an_import(spark):
    rows = spark.createDataFrame([(1, "O1", "2026-05-01", ""), (2, "O2", "2026-05-02", None)], "row_index long, order_id string, day string, junk string")
    got = files.import_profile(rows)
    assert got["row_count"] == 2 and got["mapping"] == {"case_id": "order_id", "occurred_at": "day"}
    assert got["warnings"] == ["no column for activity_name", "column junk is empty"]
    assert [c["suggested_field"] for c in got["columns"]] == ["case_id", "occurred_at", None] and got["sample_rows"][1]["order_id"] == "O2"


def test_orders_and_limits(spark):
    from tracemill.operators import order

    rows = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "variant_key string, case_count long")
    assert [r.variant_key for r in order.first(rows, "variants", 2).collect()] == ["c", "a"]
    for limit in (0, 501):
        with pytest.raises(ValueError, match="1 to 500"):
            order.first(rows, "variants", limit)
    found = spark.createDataFrame([("low", "f1", "open", 9.0), ("high", "f2", "open", 1.0), ("medium", "f3", "open", 5.0)], "severity string, subject string, status string, impact_score double")
    assert [r.subject for r in rollups.findings_inbox(found, limit=2).collect()] == ["f3", "f1"]


def csv_rows(path):
    import csv

    with open(path, newline="", encoding="utf-8") as f:
        rows = [r for r in csv.reader(f) if r and any(c.strip() for c in r)]
    return rows[1:]


@pytest.mark.parametrize("seed", range(4))
def test_records_with_breaks_by_many_tasks(spark, tmp_path, seed):
    """A file in many blocks, with quotes at every turn, against the csv module."""
    import csv
    import random

    rng = random.Random(seed)
    cell = lambda: rng.choice(["", "plain", "a b", "x\ny", 'he said ""so""', '"', "two\n\nlines", "a,b", ",\n,", 'end"', "1.5", "é漢", '5 inch" pipe'])
    path = tmp_path / "a.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["id", "one", "two", "three"])
        for i in range(3000):
            out.writerow([i, cell(), cell(), cell()])
            if rng.random() < 0.02:
                f.write("\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = files.read_delimited(spark, str(path))
        got = [[r.id, r.one or "", r.two or "", r.three or ""] for r in df.orderBy("row_index").collect()]
        index = [r.row_index for r in df.select("row_index").orderBy("row_index").collect()]
        tasks = files.records(spark, str(path), ",").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tasks > 5 and index == list(range(1, 3001))
    bare = lambda rows: [[c.strip(" \t\n\r") for c in r] for r in rows]
    assert bare(got) == bare(csv_rows(path))


def test_records_of_several_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.csv").write_text('﻿k,v\n1,"a\nb"\n\n2,c\n', encoding="utf-8")
    (tmp_path / "d" / "2.csv").write_text('k,v\r\n3,"open\r\nto the end\r\n', encoding="utf-8")
    (tmp_path / "d" / "3.csv").write_text("k,v\n4,d", encoding="utf-8")
    got = files.read_delimited(spark, str(tmp_path / "d")).orderBy("row_index").collect()
    assert [(r.row_index, r.k, r.v) for r in got][:2] == [(1, "1", "a\nb"), (2, "2", "c")]
    assert [(r.row_index, r.k) for r in got][2:] == [(3, "3"), (4, "4")] and got[3].v == "d"


def test_errors_of_an_import(spark, tmp_path):
    store = Store(with_checkpoints(spark), str(tmp_path / "store"), "t1")
    rows = spark.createDataFrame([(i, "", "x", "2026-05-01") for i in range(260)], "row_index long, c string, a string, t string")
    done = store.import_rows(rows, files.Mapping({"case_id": "c", "activity_name": "a", "occurred_at": "t"}), "p")
    assert done["rejected"] == 260 and [e["row_index"] for e in done["errors"]] == list(range(200))


def test_profile_has_no_window_over_all_values(spark):
    rows = spark.createDataFrame([(i, f"v{i % 9}", "") for i in range(40)], "row_index long, a string, b string")
    df = files.column_profile(rows, ["a", "b"])
    assert [(r.column, r.non_empty, r.distinct_count, r.samples) for r in df.collect()] == [("a", 40, 9, "v0|v1|v2|v3|v4")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange")[-2]  # before the shuffle too
