"""The registered queries as SQL of their own, for comparison."""

from __future__ import annotations

from ..operators.opportunities import ADVICE

#: Canonical events of a user's day, in microseconds.
EVENTS = """
clicks AS (
  SELECT event_id, user_id, event_type AS activity, ts, epoch_us(ts) AS occ, CAST(round(value * 1000) AS BIGINT) * 1000 AS service,
    CASE WHEN event_type IN ('click', 'view') THEN 'web' WHEN event_type = 'signup' THEN 'growth' WHEN event_type = 'purchase' THEN 'sales' ELSE 'u' || (user_id % 4) END AS owner,
    event_type IN ('signup', 'error') AS is_manual, CASE WHEN event_type = 'purchase' THEN value END AS money, 's' || (user_id % 3) AS source_system
  FROM events
)"""
DAY = EVENTS + ", ev AS (SELECT *, user_id || '-' || strftime(ts, '%Y-%m-%d') AS case_id, CAST(event_id AS VARCHAR) AS sid FROM clicks)"
SESSION = EVENTS + """, gaps AS (
  SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR, true) AS fresh FROM clicks
), ev AS (
  SELECT *, user_id || '-' || sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS case_id, CAST(event_id AS VARCHAR) AS sid FROM gaps
)"""
ORDERS = """
ev AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS case_id, 'placed' AS activity, epoch_us(o_orderdate) AS occ, 0 AS service, 'sales' AS owner, false AS is_manual, o_totalprice AS money, o_orderkey || ':placed' AS sid FROM orders
  UNION ALL
  SELECT CAST(l_orderkey AS VARCHAR), 'ship_' || l_returnflag || l_linestatus, epoch_us(l_shipdate), 0, 'n' || s_nationkey, false, NULL,
    l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || l_quantity || ':' || l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
)"""
STEPS = """, st AS (
  SELECT *, occ + service AS fin, row_number() OVER w AS pos, lag(owner) OVER w AS prev_owner, lag(occ + service) OVER w AS prev_fin, lead(activity) OVER w AS next_activity, lead(owner) OVER w AS next_owner,
    lead(occ) OVER w AS next_occ, row_number() OVER (PARTITION BY case_id, activity ORDER BY occ, sid) > 1 AS is_repeat
  FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY occ, activity, sid)
), cs0 AS (
  SELECT case_id, min(occ) AS started, max(fin) AS ended, count(*) AS event_count, CAST(sum(service) AS BIGINT) AS service, count(*) FILTER (prev_owner <> owner) AS handoff_count, count(*) FILTER (is_repeat) AS rework_count,
    count(*) FILTER (is_manual) AS manual_event_count, max(money) AS monetary_value, list(activity ORDER BY pos) AS seq FROM st GROUP BY case_id
), cs AS (
  SELECT *, greatest(ended - started, 0) AS throughput, greatest(greatest(ended - started, 0) - service, 0) AS waiting, left(sha1(array_to_string(seq, '␟')), 16) AS variant_key,
    greatest(ended - started, 0) > 28800000000 AS sla_breached FROM cs0
), tr AS (
  SELECT case_id, pos, activity AS source, next_activity AS target, greatest(next_occ - fin, 0) AS wait, owner <> next_owner AS is_handoff FROM st WHERE next_activity IS NOT NULL
), eg AS (
  SELECT source, target, count(*) AS occurrence_count, count(DISTINCT case_id) AS case_count, quantile_cont(wait, 0.5) AS median_wait, quantile_cont(wait, 0.9) AS p90_wait, CAST(sum(wait) AS BIGINT) AS total_wait,
    avg(CAST(is_handoff AS INT)) AS handoff_rate FROM tr GROUP BY source, target
), ac AS (
  SELECT activity, count(*) AS occurrence_count, count(DISTINCT case_id) AS case_count, quantile_cont(service, 0.5) AS median_service, CAST(sum(service) AS BIGINT) AS total_service, avg(CAST(is_manual AS INT)) AS manual_share,
    count(DISTINCT owner) AS distinct_actors, count(*) FILTER (is_repeat) AS repeat_events FROM st GROUP BY activity
), sc AS (
  SELECT count(*) AS all_cases, greatest((max(ended) - min(started)) / 86400000000, 1) AS days FROM cs
)"""


def s(x: str) -> str:
    return f"floor(({x}) + 0.1234567) / 1e6"


def day(body: str, base: str = DAY, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{base.strip()}{STEPS}{more}\n{body}"


EDGES = f"source, target, occurrence_count, case_count, {s('median_wait')} AS median_wait_seconds, {s('p90_wait')} AS p90_wait_seconds, {s('total_wait')} AS total_wait_seconds, round(handoff_rate, 6) AS handoff_rate"
NODES = f"""SELECT activity, ac.occurrence_count, ac.case_count, {s('median_service')} AS median_service_seconds, round(ac.manual_share, 6) AS manual_share, is_start, is_end FROM ac
JOIN (SELECT activity, bool_or(pos = 1) AS is_start, bool_or(next_activity IS NULL) AS is_end FROM st GROUP BY activity) USING (activity)"""
#: A day's activities by the quarter of the day.
TIMED = EVENTS + """, ev AS (
  SELECT * REPLACE (activity || '@' || (hour(ts) // 6) AS activity), user_id || '-' || strftime(ts, '%Y-%m-%d') AS case_id, CAST(event_id AS VARCHAR) AS sid FROM clicks
)"""
#: Components by what reaches what, and the longest path to each.
MAP = """, reach(a, b) AS (
  SELECT source, target FROM eg UNION SELECT r.a, e.target FROM reach r JOIN eg e ON r.b = e.source
), comp AS (
  SELECT activity, least(activity, coalesce(min(y.b), activity)) AS component FROM ac LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach z ON x.a = z.b AND x.b = z.a) y ON y.a = activity GROUP BY activity
), between_components AS (
  SELECT DISTINCT p.component AS c, q.component AS d FROM eg JOIN comp p ON p.activity = source JOIN comp q ON q.activity = target WHERE p.component <> q.component
), lv(c, l) AS (
  SELECT DISTINCT component, CAST(0 AS BIGINT) FROM comp UNION SELECT d, l + 1 FROM lv JOIN between_components USING (c)
), pl AS (
  SELECT activity, component, (SELECT max(l) FROM lv WHERE lv.c = component) AS level FROM comp
)"""
KEPT = ", kept AS (SELECT eg.* FROM eg, sc WHERE case_count >= 0.06 * all_cases)"
VARIANTS = """, vr AS (
  SELECT variant_key, any_value(seq) AS seq, count(*) AS case_count, count(*) / any_value(all_cases) AS share, quantile_cont(throughput, 0.5) AS median_throughput, avg(throughput) AS mean_throughput, avg(CAST(sla_breached AS INT)) AS sla_breach_rate,
    avg(handoff_count) AS mean_handoffs, avg(CAST(rework_count > 0 AS INT)) AS rework_case_ratio, coalesce(sum(monetary_value), 0) AS money, list(case_id ORDER BY started, case_id)[1:5] AS examples
  FROM cs, sc GROUP BY variant_key
)"""
SUMMARY = f"""count(*) AS case_count, CAST(sum(event_count) AS BIGINT) AS event_count, count(DISTINCT variant_key) AS variant_count, {s('quantile_cont(throughput, 0.5)')} AS median_throughput_seconds,
  {s('quantile_cont(throughput, 0.9)')} AS p90_throughput_seconds, {s('quantile_cont(waiting, 0.5)')} AS median_waiting_seconds, round(sum(waiting) / sum(throughput), 6) AS waiting_share, round(avg(handoff_count), 6) AS mean_handoffs,
  round(avg(CAST(rework_count > 0 AS INT)), 6) AS rework_case_ratio, round(avg(CAST(sla_breached AS INT)), 6) AS sla_breach_rate, round(sum(manual_event_count) / sum(event_count), 6) AS manual_event_share"""
H = 3600000000


def finding(kind: str, subject: str, cases: str, metric: str, baseline: str, hours: str, source: str, sure: str = "", min_cases: int = 15) -> str:
    """A detector's rows in the common columns."""
    sure = sure or f"CASE WHEN {cases} > 0 THEN round(least(0.5 + {cases} / 400, 0.95), 3) ELSE 0 END"
    return f"""SELECT '{kind}' AS finding_type, subject, CASE WHEN h >= 80 THEN 'critical' WHEN h >= 20 THEN 'high' WHEN h >= 5 THEN 'medium' ELSE 'low' END AS severity, CAST(k AS BIGINT) AS affected_case_count,
  round(metric, 6) AS metric_value, round(baseline, 6) AS baseline_value, round(h, 6) AS impact_hours,
  round(100 * (0.7 * CASE WHEN h > 0 THEN least(ln(1 + h) / ln(2001), 1) ELSE 0 END + 0.3 * least(k / all_cases, 1)), 2) AS impact_score, CAST(sure AS DOUBLE) AS confidence, left(sha1('{kind}|' || subject), 32) AS fingerprint
FROM (SELECT {subject} AS subject, {cases} AS k, {metric} AS metric, CAST({baseline} AS DOUBLE) AS baseline, {hours} AS h, {sure} AS sure, all_cases FROM {source}) WHERE all_cases >= {min_cases}"""


def monthly(us: str) -> str:
    return f"({us}) / 1e6 / days * 30 / 3600"


def detectors(wait: float = 1.05, rework: float = 0.05, handoffs: float = 1.0, trend: float = -1.0, manual: float = 0.6, rare: float = 0.1) -> dict[str, str]:
    base = "(SELECT eg.*, coalesce((SELECT quantile_cont(o.median_wait, 0.5) FROM eg o WHERE o.source <> eg.source OR o.target <> eg.target), 0) AS base FROM eg)"
    loops = "(SELECT activity, count(DISTINCT case_id) AS affected, CAST(sum(service) AS BIGINT) AS extra FROM st WHERE is_repeat GROUP BY activity)"
    halves = """(SELECT quantile_cont(throughput, 0.5) FILTER (n <= all_cases // 2) AS was, quantile_cont(throughput, 0.5) FILTER (n > all_cases // 2) AS now, count(*) FILTER (n > all_cases // 2) AS late, any_value(all_cases) AS all_cases
      FROM (SELECT *, row_number() OVER (ORDER BY started, case_id) AS n FROM cs), sc)"""
    fence = "(SELECT quantile_cont(throughput, 0.75) + 1.5 * (quantile_cont(throughput, 0.75) - quantile_cont(throughput, 0.25)) AS fence FROM cs)"
    return {
        "finding_excessive_waiting": finding("excessive_waiting", "source || '->' || target", "case_count", "median_wait / 1e6", "base / 1e6", monthly("total_wait"), f"{base}, sc WHERE case_count >= 15 AND median_wait >= 2 * {H} AND NOT (base > 0 AND median_wait < base * {wait})"),
        "finding_repeated_activity": finding("repeated_activity", "activity", "affected", "affected / all_cases", "0", monthly("extra"), f"{loops}, sc WHERE affected >= 15 AND affected / all_cases >= {rework}"),
        "finding_high_handoffs": finding("high_handoff_count", "'process_handoffs'", "all_cases", "m", f"{handoffs}", "m * all_cases * 10 / 60", f"(SELECT avg(handoff_count) AS m FROM cs), sc WHERE m >= {handoffs}"),
        "finding_rare_variant": finding("rare_expensive_variant", "'variant:' || variant_key", "case_count", "median_throughput / 1e6", "o / 1e6", f"(median_throughput - o) * case_count / {H}.0",
            f"vr, (SELECT quantile_cont(throughput, 0.5) AS o FROM cs), sc WHERE o > 0 AND share <= {rare} AND case_count >= 5 AND median_throughput / o >= 1.75"),
        "finding_worsening": finding("worsening_cycle_time", "'cycle_time_trend'", "late", "now / 1e6", "was / 1e6", f"(now - was) * late / {H}.0", f"{halves} WHERE all_cases >= 30 AND was > 0 AND (now - was) / was >= {trend}", "round(least(0.5 + all_cases / 400, 0.95), 3)"),
        "finding_manual_repetition": finding("high_manual_repetition", "'manual:' || activity", "case_count", "manual_share", f"{manual}", monthly("total_service"), f"ac, sc WHERE manual_share >= {manual} AND case_count >= 15 AND {monthly('total_service')} >= 1"),
        "finding_outliers": finding("cycle_time_outliers", "'cycle_time_outliers'", "k0", "CAST(k0 AS DOUBLE)", "fence / 1e6", f"over / {H}.0",
            f"(SELECT count(*) AS k0, any_value(fence) AS fence, sum(throughput - fence) AS over FROM cs, {fence} WHERE throughput > fence), sc WHERE k0 >= 3", "0.75"),
    }


DETECTORS = detectors()
DETECTOR_ORDER = ("excessive_waiting", "repeated_activity", "high_handoff_count", "rare_expensive_variant", "worsening_cycle_time", "high_manual_repetition", "cycle_time_outliers")
ALL = " UNION ALL ".join(f"({q})" for q in DETECTORS.values())
OPPORTUNITIES = f""", ranked AS (
  SELECT case_id, monetary_value AS case_money, row_number() OVER (ORDER BY started, case_id) > greatest(all_cases // 2, 1) AS is_late FROM cs, sc
), op0 AS (
  SELECT activity, count(*) AS n, count(DISTINCT case_id) AS case_count, sum(service) AS total, avg(service) AS mean, stddev_pop(service) AS spread, quantile_cont(service, 0.5) AS median, avg(CAST(is_manual AS INT)) AS manual_share,
    count(DISTINCT owner) AS owners, list_sort(list(DISTINCT source_system)) AS systems, count(*) FILTER (is_late) AS late, avg(case_money) AS money, count(case_money) AS paid
  FROM st JOIN ranked USING (case_id) GROUP BY activity
), op1 AS (
  SELECT *, n - late AS early, {monthly('total')} AS hours FROM op0, sc, (SELECT coalesce(max(money), 0) AS top FROM st) WHERE n >= 20
), op2 AS (
  SELECT *, 1 - exp(-n / all_cases) AS frequency, CASE WHEN hours > 0 THEN 1 - exp(-hours / 40) ELSE 0 END AS time_cost, greatest(manual_share, 0.05) AS manuality,
    CASE WHEN n < 3 THEN 0.5 WHEN mean <= 0 THEN 0.9 ELSE least(greatest(1 / (1 + spread / mean), 0.15), 1) END AS repeatability,
    CASE WHEN greatest(early, late) = 0 THEN 0 WHEN least(early, late) = 0 THEN 0.4 ELSE 0.4 + 0.6 * least(early, late) / greatest(early, late) END AS stability,
    CASE WHEN paid = 0 OR top <= 0 THEN 0.6 ELSE least(1, 0.5 + 0.5 * money / top) END AS business_impact, least(0.5 + n / 500, 0.95) AS confidence FROM op1
), op AS (
  SELECT activity, round(100 * frequency * time_cost * manuality * repeatability * stability * business_impact * confidence, 2) AS score, round(frequency, 4) AS frequency, round(time_cost, 4) AS time_cost, round(manuality, 4) AS manuality,
    round(repeatability, 4) AS repeatability, round(stability, 4) AS stability, round(business_impact, 4) AS business_impact, CAST(round(confidence, 4) AS DOUBLE) AS confidence, round(hours, 2) AS estimated_hours_per_month, round(hours * 35, 2) AS estimated_eur_per_month,
    n AS occurrences, case_count AS cases, round(median / 6e7, 2) AS median_minutes, owners, array_to_string(systems, ',') AS systems, round(manual_share, 3) AS manual_share, round(days, 1) AS window_days,
    CASE WHEN manual_share < 0.3 THEN 'monitor' WHEN len(systems) > 1 THEN 'integration' WHEN repeatability >= 0.7 THEN 'rule_based_automation' ELSE 'assisted' END AS approach,
    concat_ws('; ', CASE WHEN stability < 0.6 THEN 'volume differs between the halves of the window' END, CASE WHEN repeatability < 0.4 THEN 'duration varies widely' END, CASE WHEN confidence < 0.7 THEN 'few observations' END) AS blockers
  FROM op2
)"""
RAW = """raw AS (
  SELECT event_id + 1 AS row_index, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'U-' || user_id END AS case_id, event_type AS activity, event_id % 6 AS form, date_trunc('minute', ts) AS ts0, round(value, 2) AS amount, user_id % 2 = 0 AS is_manual FROM events
), parsed AS (
  SELECT *, CASE WHEN form = 5 THEN NULL WHEN form = 4 THEN ts0 - INTERVAL 2 HOUR ELSE ts0 END AS occurred_at FROM raw
)"""
UPSERT_OLD = " UNION ALL ".join(f"({q})" for q in detectors(manual=0.3, wait=2.5, rework=0.1, handoffs=4.0, trend=0.2).values())
UPSERT_NEW = " UNION ALL ".join(f"({q})" for q in detectors(wait=2.5, rework=0.1, handoffs=1.0, trend=0.2, rare=0.0).values())

ORACLE_SQL: dict[str, str] = {
    "steps": day("SELECT case_id, pos, activity, occ, fin, service, owner, prev_owner, next_activity, is_repeat FROM st"),
    "cases": day(f"""SELECT case_id, variant_key, make_timestamp(started) AS started_at, make_timestamp(ended) AS ended_at, {s('throughput')} AS throughput_seconds, {s('waiting')} AS waiting_seconds, event_count, handoff_count, rework_count,
      manual_event_count, monetary_value, sla_breached FROM cs"""),
    "case_variants": day("SELECT case_id, variant_key, array_to_string(seq, '>') AS sequence FROM cs"),
    "transitions_raw": day("SELECT case_id, pos, source, target, wait, is_handoff FROM tr"),
    "throughput": day(f"""SELECT count(*) AS case_count, {s('quantile_cont(throughput, 0.5)')} AS median_seconds, {s('avg(throughput)')} AS mean_seconds, {s('quantile_cont(throughput, 0.9)')} AS p90_seconds,
      {s('quantile_cont(throughput, 0.95)')} AS p95_seconds, {s('min(throughput)')} AS min_seconds, {s('max(throughput)')} AS max_seconds FROM cs"""),
    "percentiles": day("SELECT " + ", ".join(f"{s(f'quantile_cont(throughput, {q / 100})')} AS p{q}_seconds" for q in (5, 25, 50, 75, 90, 95, 99)) + " FROM cs"),
    "tukey_fences": day(f"SELECT {s('q1 - 1.5 * (q3 - q1)')} AS lower_seconds, {s('q3 + 1.5 * (q3 - q1)')} AS upper_seconds FROM (SELECT quantile_cont(throughput, 0.25) AS q1, quantile_cont(throughput, 0.75) AS q3 FROM cs)"),
    "activity_metrics": day(f"""SELECT activity, occurrence_count, case_count, {s('median_service')} AS median_service_seconds, {s('total_service')} AS total_service_seconds, round(manual_share, 6) AS manual_share, distinct_actors,
      round(repeat_events / case_count, 6) AS repeat_rate FROM ac"""),
    "transition_metrics": day(f"SELECT {EDGES} FROM eg"),
    "slowest_transitions": day(f"SELECT {EDGES} FROM eg ORDER BY {s('median_wait')} DESC, source, target LIMIT 6"),
    "loop_metrics": day(f"SELECT activity, count(*) AS repeat_events, count(DISTINCT case_id) AS affected_cases, round(count(DISTINCT case_id) / any_value(all_cases), 6) AS rework_ratio, {s('sum(service)')} AS extra_seconds_total FROM st, sc WHERE is_repeat GROUP BY activity"),
    "order_cases": day("SELECT case_id, variant_key, event_count, throughput, handoff_count, rework_count, monetary_value FROM cs", ORDERS),
    "order_transitions": day(f"SELECT {EDGES} FROM eg", ORDERS),
    "summary": day(f"SELECT {SUMMARY}, make_timestamp(min(started)) AS window_start, make_timestamp(max(ended)) AS window_end, (SELECT count(*) FROM ac) AS activity_count FROM cs"),
    "manual_share": day("SELECT round(sum(manual_event_count) / sum(event_count), 6) AS manual_event_share FROM cs"),
    "window_days": day("SELECT round(days, 6) AS days FROM sc"),
    "sla_breaches": day("SELECT case_id, throughput FROM cs WHERE sla_breached"),
    "sla_breach_rate": day("SELECT round(avg(CAST(sla_breached AS INT)), 6) AS sla_breach_rate FROM cs"),
    "variants": day(f"""SELECT variant_key, array_to_string(seq, ' > ') AS sequence, case_count, round(share, 6) AS share, {s('median_throughput')} AS median_throughput_seconds, {s('mean_throughput')} AS mean_throughput_seconds,
      round(money, 2) AS total_monetary_value, array_to_string(examples, ',') AS example_case_ids FROM vr""", more=VARIANTS),
    "variants_shown": day(f"""SELECT variant_key, array_to_string(seq, ' > ') AS sequence, case_count, round(share, 6) AS share, {s('median_throughput')} AS median_throughput_seconds, {s('mean_throughput')} AS mean_throughput_seconds,
      round(money, 2) AS total_monetary_value, array_to_string(examples, ',') AS example_case_ids FROM vr ORDER BY case_count DESC, variant_key LIMIT 50""", more=VARIANTS),
    "variants_enriched": day("SELECT variant_key, case_count, round(share, 6) AS share, round(sla_breach_rate, 6) AS sla_breach_rate, round(mean_handoffs, 6) AS mean_handoffs, round(rework_case_ratio, 6) AS rework_case_ratio FROM vr", more=VARIANTS),
    "start_end_activities": day("SELECT 'start' AS kind, activity, count(*) AS case_count FROM st WHERE pos = 1 GROUP BY activity UNION ALL SELECT 'end', activity, count(*) FROM st WHERE next_activity IS NULL GROUP BY activity"),
    "dfg_nodes": day(NODES),
    "dfg_edges": day(f"SELECT {EDGES}, source IN (SELECT a FROM reach WHERE a = b) AND target IN (SELECT a FROM reach WHERE a = b) AS is_loop_edge FROM eg",
        more=", reach(a, b) AS (SELECT source, target FROM eg UNION SELECT r.a, e.target FROM reach r JOIN eg e ON r.b = e.source)", recursive=True),
    "dfg_edges_filtered": day(f"SELECT {EDGES} FROM kept", more=KEPT),
    "dfg_nodes_filtered": day(f"{NODES} WHERE activity IN (SELECT source FROM kept UNION SELECT target FROM kept) OR NOT EXISTS (SELECT 1 FROM kept)", more=KEPT),
    "cyclic_activities": day("SELECT DISTINCT a AS activity FROM reach WHERE a = b", more=KEPT + ", reach(a, b) AS (SELECT source, target FROM kept UNION SELECT r.a, e.target FROM reach r JOIN kept e ON r.b = e.source)", recursive=True),
    "edge_render_flags": day(f"SELECT source, target, {s('median_wait')} > 0.6 * (SELECT max({s('median_wait')}) FROM eg) AS is_slow, round(1 + 4 * case_count / all_cases, 6) AS width FROM eg, sc"),
    "process_map_nodes": day("SELECT activity, component, level, round(manual_share, 6) > 0.5 AS is_manual FROM ac JOIN pl USING (activity)", TIMED, MAP, recursive=True),
    "process_map_edges": day(f"""SELECT source, target, {s('median_wait')} > 0.6 * (SELECT max({s('median_wait')}) FROM eg) AS is_slow, round(1 + 4 * case_count / all_cases, 6) AS width, q.level <= p.level AS is_back
      FROM eg JOIN pl p ON p.activity = source JOIN pl q ON q.activity = target, sc""", TIMED, MAP, recursive=True),
    "outlier_cases": day(f"""SELECT case_id, {s('throughput')} AS throughput_seconds, variant_key, {s('fence')} AS threshold_seconds FROM cs,
      (SELECT quantile_cont(throughput, 0.75) + 1.5 * (quantile_cont(throughput, 0.75) - quantile_cont(throughput, 0.25)) AS fence FROM cs) WHERE throughput > fence""", SESSION),
    "window_filter": day("SELECT case_id, event_count, throughput FROM cs WHERE make_timestamp(started) >= TIMESTAMP '2024-01-05' AND make_timestamp(started) < TIMESTAMP '2024-01-12'"),
    "before_after": day("""SELECT b.metric, b.value AS before, a.value AS after, round(a.value - b.value, 6) AS change, CASE WHEN b.value <> 0 THEN round((a.value - b.value) / b.value, 6) END AS change_pct,
      CASE WHEN round(a.value - b.value, 6) <> 0 THEN a.value < b.value END AS improved FROM long b JOIN long a ON a.metric = b.metric AND b.period = 'before' AND a.period = 'after'""",
        more=f""", per AS (SELECT CASE WHEN make_timestamp(started) < TIMESTAMP '2024-01-16' THEN 'before' ELSE 'after' END AS period, {SUMMARY} FROM cs GROUP BY 1),
        long AS (UNPIVOT per ON median_throughput_seconds, p90_throughput_seconds, median_waiting_seconds, mean_handoffs, rework_case_ratio, sla_breach_rate, manual_event_share INTO NAME metric VALUE value)"""),
    "before_after_counts": day("""SELECT count(*) FILTER (make_timestamp(started) < TIMESTAMP '2024-01-16') AS cases_before, count(*) FILTER (make_timestamp(started) >= TIMESTAMP '2024-01-16') AS cases_after,
      CASE WHEN least(cases_before, cases_after) < 10 THEN 'a side has fewer than 10 cases' ELSE 'differences are not causes' END AS note FROM cs"""),
    "case_timeline": day(f"""SELECT case_id, pos, activity, make_timestamp(occ) AS occurred_at, make_timestamp(fin) AS completed_at, owner, source_system, is_manual, {s('service')} AS service_seconds,
      {s('coalesce(greatest(occ - prev_fin, 0), 0)')} AS wait_before_seconds FROM st WHERE case_id = '1-2024-01-07'"""),
    **{k: day(q, SESSION if k == "finding_outliers" else DAY, VARIANTS) for k, q in DETECTORS.items()},
    "findings": day(ALL, more=VARIANTS),
    "findings_inbox": day(f"SELECT finding_type, subject, severity, impact_score FROM ({ALL}) WHERE severity = 'high' ORDER BY impact_score DESC, subject LIMIT 10", more=VARIANTS),
    "findings_shown": day(f"SELECT * FROM ({ALL}) ORDER BY impact_score DESC, list_position({list(DETECTOR_ORDER)}, finding_type), impact_hours DESC, subject LIMIT 5", more=VARIANTS),
    "findings_upsert": day(f"""SELECT coalesce(o.fingerprint, n.fingerprint) AS fingerprint, CASE WHEN o.fingerprint IS NULL THEN 'open' WHEN n.fingerprint IS NULL AND o.status = 'open' THEN 'resolved' ELSE o.status END AS status,
      o.narrative, coalesce(n.impact_score, o.impact_score) AS impact_score
      FROM (SELECT fingerprint, CASE WHEN fingerprint[1] < '8' THEN 'open' WHEN fingerprint[1] < 'c' THEN 'resolved' ELSE 'dismissed' END AS status, 'noted' AS narrative, impact_score FROM ({UPSERT_OLD})) o
      FULL JOIN (SELECT fingerprint, impact_score FROM ({UPSERT_NEW})) n ON o.fingerprint = n.fingerprint""", more=VARIANTS),
    "opportunities": day(f"SELECT *, CASE approach {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ADVICE.items())} END AS detail FROM op", more=OPPORTUNITIES),
    "opportunities_shown": day(f"SELECT *, CASE approach {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ADVICE.items())} END AS detail FROM op ORDER BY score DESC, activity LIMIT 3", more=OPPORTUNITIES),
    "overview": day(f"""SELECT (SELECT count(*) FROM cs) AS case_count, (SELECT count(*) FROM ({ALL})) AS open_findings, (SELECT subject FROM ({ALL}) ORDER BY impact_score DESC, subject DESC LIMIT 1) AS top_finding,
      round(sum(estimated_hours_per_month) FILTER (activity <> 'click'), 2) AS recoverable_hours, round(sum(estimated_eur_per_month) FILTER (activity <> 'click'), 2) AS recoverable_eur,
      (SELECT activity FROM op ORDER BY score DESC, activity DESC LIMIT 1) AS top_opportunity FROM op""", more=VARIANTS + OPPORTUNITIES),
    "process_list": day("""SELECT 'p' || (CAST(split_part(case_id, '-', 1) AS BIGINT) % 3) AS process_id, count(*) AS case_count, round(avg(throughput) / 3.6e9, 2) AS median_throughput_hours,
      count(*) FILTER (sla_breached) AS open_findings FROM cs GROUP BY 1"""),
    "report_totals": day("SELECT count(*) AS listed, round(sum(estimated_hours_per_month), 2) AS hours_per_month, round(sum(estimated_eur_per_month), 2) AS eur_per_month FROM (SELECT * FROM op ORDER BY score DESC, activity LIMIT 3)", more=OPPORTUNITIES),
    "sanitize": "SELECT event_id + 1 AS row_index, event_type AS step, '''=' || event_type AS formula FROM events",
    "parse_timestamps": f"WITH {RAW} SELECT row_index, occurred_at AS parsed FROM parsed",
    "normalize_events": f"""WITH {RAW} SELECT row_index, case_id, activity, occurred_at, CAST(amount AS DOUBLE) AS monetary_value, is_manual,
      case_id || ':' || activity || ':' || strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS source_event_id FROM parsed WHERE case_id IS NOT NULL AND occurred_at IS NOT NULL""",
    "rejected_rows": f"""WITH {RAW} SELECT row_index, concat_ws('; ', CASE WHEN case_id IS NULL THEN 'missing case_id' END, CASE WHEN occurred_at IS NULL THEN 'unparseable occurred_at' END) AS problems
      FROM parsed WHERE case_id IS NULL OR occurred_at IS NULL""",
    "ingest_dedupe": """WITH e AS (SELECT event_id AS row_index, 'e' || (event_id // 2) AS source_event_id, user_id FROM events)
      SELECT row_index, source_event_id, user_id FROM e WHERE source_event_id NOT IN (SELECT source_event_id FROM e WHERE user_id % 2 = 0) QUALIFY row_number() OVER (PARTITION BY source_event_id ORDER BY row_index) = 1""",
    "ingest_identity": """WITH e AS (
        SELECT event_id AS row_index, CASE WHEN event_id % 3 = 0 THEN 'web' ELSE 'api' END AS source_system, user_id,
          CASE WHEN event_id % 2 = 0 THEN 'e' || event_id ELSE user_id || ':' || event_type || ':' || strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS source_event_id FROM events
      ), f AS (SELECT source_system, source_event_id, min(row_index) AS row_index, bool_or(user_id % 2 = 0) AS stored FROM e GROUP BY ALL)
      SELECT row_index, source_system, source_event_id FROM f WHERE NOT stored""",
    "column_profile": """WITH r AS (
        SELECT event_id, 'order_id' AS "column", CASE WHEN event_id % 11 = 0 THEN '' ELSE '''U-' || user_id END AS value FROM events UNION ALL SELECT event_id, 'step', ' ' || event_type FROM events
        UNION ALL SELECT event_id, 'channel', CASE WHEN user_id % 2 = 0 THEN 'Manual' ELSE 'web' END FROM events UNION ALL SELECT event_id, 'formula', '=' || event_type FROM events
      ), v AS (SELECT "column", value, count(*) AS k, min(event_id) AS first FROM r WHERE value <> '' GROUP BY ALL)
      SELECT "column", CAST(sum(k) AS BIGINT) AS non_empty, count(*) AS distinct_count, array_to_string(list(value ORDER BY first, value)[1:5], '|') AS samples FROM v GROUP BY "column" """,
    "infer_types": r"""WITH r AS (
        SELECT event_id, 'order_id' AS "column", CASE WHEN event_id % 11 = 0 THEN '' ELSE chr(39) || 'U-' || user_id END AS value FROM events UNION ALL SELECT event_id, 'step', ' ' || event_type FROM events
        UNION ALL SELECT event_id, 'channel', CASE WHEN user_id % 2 = 0 THEN 'Manual' ELSE 'web' END FROM events
        UNION ALL SELECT event_id, 'amount', replace(CAST(CAST(round(value, 2) AS DECIMAL(18, 2)) AS VARCHAR), '.', ',') FROM events
        UNION ALL SELECT event_id, 'timestamp', CASE WHEN event_id % 6 = 5 THEN 'soon' ELSE strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') || ' form ' || (event_id % 6) END FROM events
      ), v AS (
        SELECT "column", value FROM r WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY event_id) <= 200
      ), a AS (
        SELECT "column", count(*) AS n, bool_and("column" = 'timestamp' AND value <> 'soon') AS dates, bool_and(regexp_full_match(replace(value, ',', '.'), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)')) AS numbers,
          count(DISTINCT lower(value)) AS folded, count(DISTINCT value) AS kinds FROM v GROUP BY "column"
      )
      SELECT "column", CASE WHEN dates THEN 'datetime' WHEN numbers THEN 'number' WHEN folded <= 2 THEN 'boolean' WHEN kinds <= greatest(2, n // 10) THEN 'categorical' ELSE 'string' END AS inferred_type FROM a""",
}
