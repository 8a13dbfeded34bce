"""Roll-ups over processes and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import order

SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def process_list(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """Cases, open findings and mean hours of each process.

    The mean carries the name that readers of the list expect.
    """
    c = cases.groupBy("process_id").agg(F.count("*").alias("case_count"), F.round(F.avg("throughput") / 3.6e9, 2).alias("median_throughput_hours"))
    f = findings.where("status = 'open'").groupBy("process_id").agg(F.count("*").alias("open_findings"))
    return c.join(f, "process_id", "left").withColumn("open_findings", F.coalesce("open_findings", F.lit(0)))


def findings_inbox(findings: DataFrame, severity: str | None = None, status: str | None = None, limit: int = 100) -> DataFrame:
    """The most costly findings, at most so many, the most severe of them first."""
    if severity:
        findings = findings.where(F.col("severity") == severity)
    if status:
        findings = findings.where(F.col("status") == status)
    rank = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in SEVERITY_RANK.items()])
    best = findings.orderBy(F.desc("impact_score"), "subject").limit(limit)
    return best.withColumn("severity_rank", rank).orderBy("severity_rank", F.desc("impact_score"), "subject")


def overview(cases: DataFrame, findings: DataFrame, opportunities: DataFrame) -> DataFrame:
    """One row: counts, what proposed and planned work would save, and the top of each list."""
    c = cases.agg(F.count("*").alias("case_count"))
    f = findings.where("status = 'open'").agg(F.count("*").alias("open_findings"), F.max_by("subject", F.struct("impact_score", "subject")).alias("top_finding"))
    live = F.col("status").isin("proposed", "planned")
    o = opportunities.agg(
        F.round(F.coalesce(F.sum(F.when(live, F.col("estimated_hours_per_month"))), F.lit(0.0)), 2).alias("recoverable_hours"),
        F.round(F.coalesce(F.sum(F.when(live, F.col("estimated_eur_per_month"))), F.lit(0.0)), 2).alias("recoverable_eur"),
        F.max_by("activity", F.struct("score", "activity")).alias("top_opportunity"),
    )
    return c.crossJoin(F.broadcast(f)).crossJoin(F.broadcast(o))  # one row each


def workspace(events: DataFrame, cases: DataFrame, findings: DataFrame, opportunities: DataFrame, processes: DataFrame | None = None) -> DataFrame:
    """The overview with counts of processes and events, and the processes whose cycle times worsen.

    processes: one row each; where it is missing, those that have events.
    worsening_processes: the open findings of that kind, by process and subject.
    """
    p = (events.select("process_id").distinct() if processes is None else processes).agg(F.count("*").alias("process_count"))
    e = events.agg(F.count("*").alias("event_count"))
    change = F.get_json_object("evidence", "$.change_pct").cast("double").alias("change_pct")
    late = findings.where("finding_type = 'worsening_cycle_time' AND status = 'open'").agg(F.sort_array(F.collect_list(F.struct("process_id", "subject", "title", change))).alias("list"))
    late = late.select(F.transform("list", lambda x: x.dropFields("subject")).alias("worsening_processes"))
    out = overview(cases, findings, opportunities)
    for one in (p, e, late):
        out = out.crossJoin(F.broadcast(one))
    return out


def report_totals(opportunities: DataFrame, top: int = 10) -> DataFrame:
    """What the best opportunities would save; the others do not count."""
    best = order.first(opportunities, "opportunities", top)
    return best.agg(F.count("*").alias("listed"), F.round(F.sum("estimated_hours_per_month"), 2).alias("hours_per_month"), F.round(F.sum("estimated_eur_per_month"), 2).alias("eur_per_month"))


def report_payload(summary: DataFrame, variants: DataFrame, findings: DataFrame, opportunities: DataFrame) -> dict:
    """What a report shows: a summary row and the top of three lists, without findings that users dismissed."""
    rows = lambda df: [r.asDict(True) for r in df.collect()]
    return {
        "summary": rows(summary)[0],
        "variants": rows(order.first(variants, "variants", 5)),
        "findings": rows(findings.where("status <> 'dismissed'").orderBy(F.desc("impact_score"), "subject").limit(10)),
        "opportunities": rows(order.first(opportunities, "opportunities", 10)),
        "totals": rows(report_totals(opportunities))[0],
    }


def render_markdown(name: str, payload: dict) -> str:
    """The report as Markdown; every number comes from the payload."""
    s, totals = payload["summary"], payload["totals"]
    hours = lambda seconds: f"{(seconds or 0) / 3600:.2f} h"
    share = lambda x: f"{100 * (x or 0):.0f} %"
    facts = {
        "Cases": s["case_count"], "Events": s["event_count"], "Variants": s["variant_count"], "Median cycle time": hours(s["median_throughput_seconds"]), "90th percentile": hours(s.get("p90_throughput_seconds")),
        "Waiting, of the cycle time": share(s.get("waiting_share")), "Handoffs a case": f"{s.get('mean_handoffs') or 0:.2f}", "Cases with rework": share(s.get("rework_case_ratio")), "Events by hand": share(s.get("manual_event_share")),
    }
    out = [f"# {name}", "", f"{s['case_count']} cases in {s['variant_count']} variants.", "", "| | |", "|-|-|", *[f"| {k} | {v} |" for k, v in facts.items()], "", "## Findings", ""]
    out += [f"- **{f['severity']}** {explain(f)}" for f in payload["findings"]] or ["Nothing is beyond the thresholds."]
    out += ["", "## Opportunities", ""]
    if payload["opportunities"]:
        out += ["| Activity | Score | Hours a month | EUR a month | Approach |", "|-|-|-|-|-|"]
        out += [f"| {o['activity']} | {o['score']:.2f} | {o['estimated_hours_per_month']:.2f} | {o['estimated_eur_per_month']:.2f} | {o['approach']} |" for o in payload["opportunities"]]
        out += ["", *[f"- {explain_opportunity(o)}" for o in payload["opportunities"] if "detail" in o]]
        out += ["", f"All of these: {totals['hours_per_month'] or 0:.2f} hours and {totals['eur_per_month'] or 0:.2f} EUR a month."]
    else:
        out += ["No activity is frequent enough."]
    out += ["", "## Variants", ""]
    out += [f"- {v['case_count']} cases: {v['sequence']}" for v in payload["variants"]] or ["None."]
    return "\n".join([*out, "", "Findings state what goes together in the log. They do not show what causes it.", ""])


def explain(finding: dict) -> str:
    """A sentence about a finding from its own numbers."""
    return f"{finding['title']}. It affects {finding['affected_case_count']} cases at about {finding['impact_hours']:.1f} hours (confidence {finding['confidence']:.2f})."


def explain_opportunity(o: dict) -> str:
    """A sentence about an opportunity from its own numbers, and what is advised."""
    held_back = f" Against it: {o['blockers']}." if o["blockers"] else ""
    return f"{o['activity']}: {o['occurrences']} runs in {o['cases']} cases within {o['window_days']:g} days, {100 * o['manual_share']:.0f} % of them by hand. {o['detail']}{held_back}"
