"""Traces, metrics, graph and findings on small hand-made logs, against plain Python."""

import hashlib
import random
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from tracemill.functions import stats
from tracemill.functions.session import with_checkpoints
from tracemill.operators import graph, metrics
from tracemill.operators.eventlog import EventLog
from tracemill.operators.findings import Findings, Thresholds, upsert_findings
from tracemill.operators.opportunities import COMPONENTS, score_opportunities
from tracemill.sources.tables import CANONICAL, conform

FIRST_DAY = datetime(2027, 2, 3, 6)


def event(case, activity, hours, n=0, minutes=5, **more):
    """A row of a log: an activity of so many minutes, at so many hours from the first day."""
    start = FIRST_DAY + timedelta(hours=hours)
    row = dict(case_id=case, activity=activity, source_event_id=f"{case}-{n}-{activity}-{hours}", occurred_at=start)
    row |= dict(completed_at=start + timedelta(minutes=minutes), duration_ms=60_000 * minutes, team="desk", is_manual=bool(more.pop("manual", False)))
    return row | more


def log(spark, rows):
    """An event log of rows that may leave canonical columns out."""
    names = CANONICAL.fieldNames()
    assert all(set(r) <= set(names) for r in rows)
    return EventLog(conform(spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], CANONICAL)))


def test_order_and_variant(spark):
    got = log(spark, [event("A", "second", 2), event("A", "first", 1), event("B", "only", 1)]).cases()
    rows = {r.case_id: r for r in got.collect()}
    assert rows["A"].sequence == ["first", "second"]
    assert rows["A"].variant_key == hashlib.sha1("first␟second".encode()).hexdigest()[:16]


def test_handoffs_rework_waiting(spark):
    teams = ("sales", "finance", "finance", "warehouse")
    rows = [event("A", f"s{i}", i, team=t) for i, t in enumerate(teams)]
    rows += [event("B", a, i) for i, a in enumerate(("issue", "fix", "issue", "issue"))]
    rows += [event("C", "one", 0, minutes=30), event("C", "two", 10, minutes=30)]
    got = {r.case_id: r for r in log(spark, rows).cases().collect()}
    assert got["A"].handoff_count == 2
    assert got["B"].rework_count == 2
    assert got["C"].throughput == 10.5 * 3.6e9 and got["C"].waiting == 9.5 * 3.6e9


def test_empty_owner_and_negative_duration(spark):
    rows = [event("A", "x", 0, team="", actor_id="bob"), event("A", "y", 1, team=None, actor_id="")]
    rows[1]["duration_ms"] = -5
    got = log(spark, rows).steps().orderBy("pos").collect()
    assert [r.owner for r in got] == ["bob", "unassigned"]
    assert got[1].service == -5000


def test_waits_run_from_the_end(spark):
    rows = [event("A", "one", 0, minutes=60), event("A", "two", 3), event("B", "one", 0, minutes=300), event("B", "two", 1)]
    got = {r.case_id: r.wait for r in log(spark, rows).transitions().collect()}
    assert got == {"A": 2 * 3_600_000_000, "B": 0}


@pytest.mark.parametrize(("edges", "cyclic"), [([("a", "a")], {"a"}), ([("a", "b"), ("b", "a")], {"a", "b"}), ([("a", "b"), ("b", "c")], set()), ([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e")], {"a", "b", "c", "d"})])
def test_cycles(spark, edges, cyclic):
    df = with_checkpoints(spark).createDataFrame(edges, "source string, target string")
    assert {r.activity for r in graph.cyclic_activities(df).collect()} == cyclic


def test_loop_edge_across_cycles(spark):
    rows = [event("A", a, i, n=i) for i, a in enumerate("abacdcd")]
    got = {(r.source, r.target): r.is_loop_edge for r in graph.dfg_edges(log(with_checkpoints(spark), rows).transitions()).collect()}
    assert got[("a", "c")] is True


def test_small_log_has_no_findings(spark):
    lg = log(spark, [event(f"c{i}", "x", i) for i in range(3)])
    assert Findings(lg.steps(), lg.cases(), lg.transitions()).all().count() == 0


def test_slow_handoff_is_found(spark):
    rows = []
    for i in range(60):
        rows += [event(f"c{i:02}", "request", 24 * i), event(f"c{i:02}", "approve", 24 * i + 20), event(f"c{i:02}", "ship", 24 * i + 21)]
    lg = log(spark, rows)
    got = Findings(lg.steps(), lg.cases(), lg.transitions()).excessive_waiting().collect()
    assert [(r.subject, r.affected_case_count) for r in got] == [("request->approve", 60)]
    assert round(got[0].metric_value / 3600, 1) == 19.9
    assert got[0].fingerprint == hashlib.sha1(b"excessive_waiting|request->approve").hexdigest()[:32]


def test_rework_is_found(spark):
    rows = []
    for i in range(60):
        path = ("issue", "fix", "issue", "send") if i % 2 == 0 else ("issue", "send")
        rows += [event(f"c{i:02}", a, 24 * i + j, n=j) for j, a in enumerate(path)]
    lg = log(spark, rows)
    got = Findings(lg.steps(), lg.cases(), lg.transitions()).repeated_activity().collect()
    assert [(r.subject, r.metric_value) for r in got] == [("issue", 0.5)]


def test_odd_half_goes_late(spark):
    lg = log(spark, [event(f"c{i}", "x", i) for i in range(5)])
    row = Findings(lg.steps(), lg.cases(), lg.transitions(), Thresholds()).halves().first()
    assert row.late == 3


def test_upsert_states(spark):
    old = spark.createDataFrame([("a", "open", "n", 1.0), ("b", "resolved", None, 1.0), ("c", "open", None, 2.0), ("d", "dismissed", None, 3.0)], "fingerprint string, status string, narrative string, impact_score double")
    new = spark.createDataFrame([("a", 9.0), ("b", 9.0), ("e", 9.0)], "fingerprint string, impact_score double")
    got = {r.fingerprint: (r.status, r.impact_score) for r in upsert_findings(old, new).collect()}
    assert got == {"a": ("open", 9.0), "b": ("resolved", 9.0), "c": ("resolved", 2.0), "d": ("dismissed", 3.0), "e": ("open", 9.0)}


def test_manual_scores_above_automated(spark):
    rows = []
    for i in range(80):
        rows += [event(f"c{i:02}", "retype", 24 * i, minutes=9, manual=True), event(f"c{i:02}", "sync", 24 * i + 1, minutes=9)]
    lg = log(spark, rows)
    got = {r.activity: r for r in score_opportunities(lg.steps(), lg.cases(), min_occurrences=10).collect()}
    assert got["retype"].score > got["sync"].score
    product = 100.0
    for c in COMPONENTS:
        product *= got["retype"][c]
    assert abs(product - got["retype"].score) < 0.1


def test_before_after(spark):
    rows = []
    for i in range(20):
        rows += [event(f"c{i:02}", "a", 24 * i, minutes=0), event(f"c{i:02}", "b", 24 * i + (20 if i < 10 else 10), minutes=0)]
    got = {r.metric: r for r in metrics.before_after(log(spark, rows).cases(), "2027-02-13 06:00:00").collect()}
    r = got["median_throughput_seconds"]
    assert (r.before, r.after, r.improved) == (72000.0, 36000.0, True)
    assert got["mean_handoffs"].improved is None


def test_median_of_the_other_edges(spark):
    """The baseline of a wait, against the median of all edges but one."""
    rng = random.Random(9)
    for edges in (1, 2, 3, 6, 7):
        rows, waits = [], {}
        for e in range(edges):
            waits[e] = rng.choice([3, 5, 8, 8, 13])
            for k in range(16):
                rows += [event(f"c{e}-{k}", f"a{e}", 24 * k, minutes=0), event(f"c{e}-{k}", f"b{e}", 24 * k + waits[e], minutes=0)]
        lg = log(spark, rows)
        got = Findings(lg.steps(), lg.cases(), lg.transitions(), Thresholds(wait_baseline_multiple=0.0)).excessive_waiting().collect()
        want = {f"a{e}->b{e}": median([w for o, w in waits.items() if o != e]) * 3600 if edges > 1 else 0.0 for e in waits}
        assert {r.subject: r.baseline_value for r in got} == want


def test_first_cases_of_a_variant(spark):
    rows = [event(f"c{i:02}", "x", (i * 7) % 23) for i in range(23)]
    got = metrics.variants(log(spark, rows).cases()).collect()
    order = sorted((r["occurred_at"], r["case_id"]) for r in rows)
    assert [r.example_case_ids for r in got] == [",".join(c for _, c in order[:5])]


def test_fixed_log_is_the_same(spark):
    rng = random.Random(3)
    lg = log(with_checkpoints(spark), [event(f"c{rng.randrange(9)}", rng.choice("abc"), rng.randrange(99), n=i) for i in range(80)])
    want = [sorted(map(str, df.collect())) for df in (lg.steps(), lg.cases(2.0), lg.transitions())]
    lg.fixed()
    assert [sorted(map(str, df.collect())) for df in (lg.steps(), lg.cases(2.0), lg.transitions())] == want


def test_empty_log(spark):
    lg = log(spark, [])
    assert metrics.throughput(lg.cases()).first().median_seconds == 0.0
    assert graph.dfg_nodes(lg.steps()).count() == 0


def test_random_logs_against_plain_python(spark):
    rng = random.Random(4)
    rows = [event(f"c{rng.randrange(12)}", rng.choice("abcd"), rng.randrange(200) / 4, team=rng.choice(["x", "y", None]), minutes=rng.randrange(90), n=i) for i in range(300)]
    cases = {}
    for r in rows:
        cases.setdefault(r["case_id"], []).append(r)
    edges, repeats = {}, {}
    for case in cases.values():
        case.sort(key=lambda r: (r["occurred_at"], r["activity"], r["source_event_id"]))
        seen = set()
        for a in case:
            repeats[a["activity"]] = repeats.get(a["activity"], 0) + (a["activity"] in seen)
            seen.add(a["activity"])
        for a, b in zip(case, case[1:]):
            edges.setdefault((a["activity"], b["activity"]), []).append(max((b["occurred_at"] - a["completed_at"]).total_seconds(), 0))
    lg = log(spark, rows)
    got = {(r.source, r.target): r for r in metrics.transition_metrics(lg.transitions()).collect()}
    assert set(got) == set(edges)
    for k, waits in edges.items():
        assert got[k].occurrence_count == len(waits)
        assert got[k].median_wait_seconds == pytest.approx(median(waits), abs=1e-5)
    loops = {r.activity: r.repeat_events for r in metrics.loop_metrics(lg.steps()).collect()}
    assert loops == {a: n for a, n in repeats.items() if n}


def test_one_exchange_serves_a_case(spark, tmp_path):
    lg = log(spark, [event("A", "x", 0), event("A", "y", 1)])
    plan = lg.cases()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(case_id") == 1


def test_filter_reaches_the_scan(spark):
    from tracemill.sources.tables import day_log

    events = day_log(spark, "/root/testdata/sf0.001").where(F.col("activity") == "click")
    plan = events.select("case_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in plan


def test_seconds(spark):
    """Also of sums beyond 2**53 microseconds, and of an infinite fence."""
    from tracemill.functions.stats import seconds

    rows = [(1_500_000.0, 1.5), (0.0, 0.0), (-2_000_000.0, -2.0), (3.2174064e16, 32174064000.0), (float("inf"), float("inf"))]
    got = spark.createDataFrame(rows, "us double, want double").select(seconds("us").alias("s"), "want").collect()
    assert [r.s for r in got] == [r.want for r in got]
    assert spark.range(1).select(seconds((F.col("id") + 32174064000000000)).alias("s")).first().s == 32174064000.0


def test_quantiles_are_those_of_sorted_values(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 0, -7, 2**40, rng.randrange(-10**6, 10**13)]), rng.choice([3, 4, 2**52 + 1]), None) for _ in range(301)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    wanted = {f"{c}{i}": (c, q) for c in "abc" for i, q in enumerate((0.0, 0.05, 0.25, 0.5, 0.9, 1.0))}
    got = stats.quantiles(df, wanted, "n").first()
    assert got.n == sum(r[0] is not None for r in rows)
    plain = df.agg(*[F.percentile(c, F.lit(q)).alias(name) for name, (c, q) in wanted.items()]).first()
    for name in wanted:
        assert got[name] == (None if plain[name] is None else pytest.approx(plain[name], rel=1e-15, abs=1e-6))
    empty = stats.quantiles(df.limit(0), wanted, "n").first()
    assert empty.n == 0 and all(empty[name] is None for name in wanted)
    few = stats.quartiles(df.limit(3), "b").select(stats.fence(-1), stats.fence(1)).first()
    assert tuple(few) == (float("-inf"), float("inf"))


def test_measures_by_group_against_percentiles(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), rng.choice([None, 0, -3, 7, rng.randrange(10**12), 2**50]), rng.randrange(5)) for _ in range(400)]
    rows += [("none", 1, None, 4), ("none", 1, None, 3), ("one", 2, 5, 1)]
    df = spark.createDataFrame(rows, "g string, h int, v long, w int")
    wanted = {"p0": 0.0, "p33": 0.33, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = stats.measures_by(df, ["g", "h"], "v", wanted, {"rows": F.lit(1), "total": F.col("v"), "w": F.col("w")})
    plain = df.groupBy("g", "h").agg(*[F.coalesce(F.percentile("v", F.lit(q)), F.lit(0.0)).alias(name) for name, q in wanted.items()], F.count("*").alias("rows"), F.sum("v").alias("total"), F.sum("w").alias("w"))
    mine, theirs = ({(r.g, r.h): r for r in df.collect()} for df in (got, plain))
    assert set(mine) == set(theirs)
    for key, r in theirs.items():
        assert all(mine[key][c] == (r[c] if c in ("rows", "total", "w") else pytest.approx(r[c], rel=1e-15, abs=1e-6)) for c in plain.columns[2:])
    assert stats.measures_by(df.limit(0), ["g"], "v", wanted, {}).count() == 0


def test_sums_of_waits_beyond_a_long(spark):
    """40 waits of 9,000 years, and as much service: more microseconds than a long holds."""
    first, last = datetime(1000, 1, 1), datetime(9999, 1, 1)
    hours = [(at - FIRST_DAY) / timedelta(hours=1) for at in (first, last)]
    rows = [event(f"c{i}", a, h, minutes=0) for i in range(40) for a, h in zip("xy", hours)]
    rows += [event(f"d{i}", "z", hours[0], n, minutes=int((last - first) / timedelta(minutes=1))) for i in range(20) for n in range(2)]
    lg = log(spark, rows)
    apart = (last - first).total_seconds()
    assert 40 * apart * 1e6 > 2**63
    (edge,) = metrics.transition_metrics(lg.transitions()).where("source = 'x'").collect()
    assert (edge.total_wait_seconds, edge.median_wait_seconds, edge.occurrence_count) == (40 * apart, apart, 40)
    assert {r.activity: r.total_service_seconds for r in metrics.activity_metrics(lg.steps()).collect()} == {"x": 0.0, "y": 0.0, "z": 40 * apart}
    assert [r.mean_throughput_seconds for r in metrics.variants(lg.cases()).collect()] == [apart, apart]
    assert metrics.loop_metrics(lg.steps()).first().extra_seconds_total == 20 * apart
    assert metrics.summary(lg.steps(), lg.cases()).first().waiting_share == round(40 / 60, 6)
    assert {r.activity: r.occurrences for r in score_opportunities(lg.steps(), lg.cases()).collect()} == {"x": 40, "y": 40, "z": 40}


def test_no_task_takes_the_values_of_a_group(spark):
    """Equal values are counted once, by one pass over the log; no aggregate holds values."""
    df = metrics.transition_metrics(log(spark, [event("A", "x", 0), event("A", "y", 1)]).transitions())
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "percentile" not in plan and "Expand" not in plan and "collect_list" not in plan
    assert plan.count("Exchange hashpartitioning(case_id") == 1 and "ReusedExchange" in plan


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 31])
def test_halves_are_those_of_numbered_cases(spark, n):
    from tracemill.operators.halves import is_late, last_early

    rng = random.Random(n)
    rows = [(f"c{i:02}", rng.choice([5, 5, 3_600_000_000 * 2 + 7, 3_600_000_000 * 2 + 9, 10**15 + rng.randrange(10**8)])) for i in range(n)]
    df = spark.createDataFrame(rows, "case_id string, started long")
    ordered = [c for _, c in sorted((s, c) for c, s in rows)]
    for least in (0, 1):
        got = {r.case_id for r in df.crossJoin(last_early(df, least)).where(is_late()).collect()}
        assert got == set(ordered[max(n // 2, least) :])


def closure(edges):
    reach = {(a, b) for a, b in edges}
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in reach if b == c}
        if more == reach:
            return reach
        reach = more


@pytest.mark.parametrize("small", [0, 10**6])
@pytest.mark.parametrize("seed", range(2))
def test_components_and_levels(spark, seed, small, monkeypatch):
    monkeypatch.setattr(graph, "SMALL_GRAPH", small)
    rng = random.Random(seed)
    names = [f"a{i:02}" for i in range(14)]
    edges = sorted({(rng.choice(names), rng.choice(names)) for _ in range(rng.choice([8, 16, 24]))})
    reach = closure(edges)
    nodes = {x for e in edges for x in e}
    comp = {a: min([a, *[b for b in nodes if (a, b) in reach and (b, a) in reach]]) for a in nodes}
    level = dict.fromkeys(comp.values(), 0)
    for _ in nodes:
        for a, b in edges:
            if comp[a] != comp[b]:
                level[comp[b]] = max(level[comp[b]], level[comp[a]] + 1)
    df = with_checkpoints(spark).createDataFrame(edges, "source string, target string")
    found = graph.levels(df)
    assert {(r.activity, r.component, r.level) for r in found.collect()} == {(a, comp[a], level[comp[a]]) for a in nodes}
    assert {r.activity for r in graph.cyclic_activities(df, found).collect()} == {a for a in nodes if (a, a) in reach}


def test_walk_of_small_graphs():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 12)
        edges = sorted({(f"a{rng.randrange(n)}", f"a{rng.randrange(n)}") for _ in range(rng.randrange(1, 20))})
        reach, nodes = closure(edges), {x for e in edges for x in e}
        comp = {a: min([a, *[b for b in nodes if (a, b) in reach and (b, a) in reach]]) for a in nodes}
        level = dict.fromkeys(comp.values(), 0)
        for _ in nodes:
            for a, b in edges:
                if comp[a] != comp[b]:
                    level[comp[b]] = max(level[comp[b]], level[comp[a]] + 1)
        assert set(graph.solved(edges)) == {(a, comp[a], level[comp[a]]) for a in nodes}
    chain = [(str(i), str(i + 1)) for i in range(5000)]
    assert max(x[2] for x in graph.solved(chain)) == 5000


@pytest.mark.parametrize("small", [-1, 10])
def test_empty_graph(spark, small, monkeypatch):
    monkeypatch.setattr(graph, "SMALL_GRAPH", small)
    assert graph.levels(with_checkpoints(spark).createDataFrame([], "source string, target string")).count() == 0


@pytest.mark.parametrize("piece", [1, 3, 4096])
def test_long_cases_in_pieces(spark, piece, monkeypatch):
    monkeypatch.setattr("tracemill.operators.eventlog.PIECE", piece)
    rng = random.Random(piece)
    rows = [event("long", rng.choice("abc"), i, n=i, manual=i % 3 == 0, monetary_value=float(i % 7)) for i in range(40)] + [event("short", "a", 0)]
    got = {r.case_id: r for r in log(spark, rows).cases(2.0).collect()}
    path = [r["activity"] for r in rows[:40]]
    one = got["long"]
    assert one.sequence == path and one.path == "␟".join(path) and one.variant_key == hashlib.sha1(one.path.encode()).hexdigest()[:16]
    assert (one.event_count, one.rework_count, one.handoff_count, one.manual_event_count, one.monetary_value) == (40, 40 - len(set(path)), 0, 14, 6.0)
    assert one.service == 40 * 300_000_000 and one.throughput == (39 * 60 + 5) * 60_000_000 and one.sla_breached
    assert got["short"].sequence == ["a"] and got["short"].event_count == 1
