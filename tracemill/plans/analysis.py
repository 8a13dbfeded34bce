"""A full analysis run of one stored process."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import with_checkpoints
from ..operators import graph, metrics, order
from ..operators.eventlog import EventLog, cases_shown
from ..operators.findings import Findings, Thresholds, upsert_findings
from ..operators.opportunities import carry_status, score_opportunities
from ..sources.store import Store
from . import rollups


#: What a report reads of a snapshot.
SNAPSHOT = (
    "case_count long, event_count long, variant_count long, median_throughput_seconds double, p90_throughput_seconds double, waiting_share double, "
    "mean_handoffs double, rework_case_ratio double, sla_breach_rate double, manual_event_share double"
)


def analyze(store: Store, process_id: str, sla_hours: float | None = None, hourly_cost: float = 35.0, thresholds: Thresholds | None = None) -> dict[str, int]:
    """Computes and stores cases, variants, edges, a metric snapshot, findings and opportunities.

    Cases, variants and edges are replaced; snapshots pile up; findings and
    opportunities keep what users decided. A process without events is left alone.
    Steps are computed once and kept on the executors; lost ones are computed again.
    """
    with_checkpoints(store.spark)
    counts = {"cases": 0, "findings": 0, "opportunities": 0}
    if not store.exists("events") or store.read("events", process_id).isEmpty():
        return counts
    log = EventLog(store.read("events", process_id)).keep()
    try:
        steps, cases, transitions = log.steps(), log.cases(sla_hours), log.transitions()
        store.replace("cases", cases_shown(cases), process_id)
        store.replace("variants", metrics.variants(cases).join(metrics.variants_enriched(cases).drop("case_count", "share"), "variant_key"), process_id)
        store.replace("edges", graph.dfg_edges(transitions), process_id)
        snapshot = metrics.summary(steps, cases)
        payload = F.to_json(F.struct(*snapshot.columns)).alias("payload")
        store.append("metrics", snapshot.select(F.current_timestamp().alias("computed_at"), "window_start", "window_end", payload), process_id)
        found = Findings(steps, cases, transitions, thresholds).all().withColumn("detected_at", F.current_timestamp())
        store.update("findings", process_id, lambda old: upsert_findings(_or_none(old, found, "narrative"), found))
        scored = score_opportunities(steps, cases, hourly_cost=hourly_cost)
        store.update("opportunities", process_id, lambda old: carry_status(scored, _or_none(old, scored)))
        return {name: store.read(name, process_id).count() if store.exists(name) else 0 for name in counts}
    finally:
        log.release()


def _or_none(old: DataFrame | None, like: DataFrame, *more: str) -> DataFrame:
    """The rows, or none with the columns of `like`."""
    return like.limit(0).select("*", *[F.lit(None).cast("string").alias(c) for c in ("status", *more)]) if old is None else old


#: The table in which each stored result is.
RESULTS = {"cases": "cases", "variants": "variants", "edges": "edges", "findings": "findings", "opportunities": "opportunities"}


def results(store: Store, process_id: str, result: str, limit: int | None = None, status: str | None = None) -> DataFrame:
    """A stored result of a process as it is shown: in its order, and as many rows as are shown or asked for."""
    df = store.read(RESULTS[result], process_id)
    if status is not None:
        df = df.where(F.col("status") == status)
    if result in order.LIMITS:
        return order.first(df, result, limit)
    df = order.ordered(df, result)
    return df if limit is None else df.limit(limit)


def report(store: Store, process_id: str, name: str) -> str:
    """A Markdown report from what is stored; it is kept in the table of reports."""
    rows = store.read("metrics", process_id).orderBy(F.desc("computed_at")).limit(1)
    summary = rows.select(F.from_json("payload", SNAPSHOT).alias("p")).select("p.*")
    payload = rollups.report_payload(summary, store.read("variants", process_id), store.read("findings", process_id), store.read("opportunities", process_id))
    body = rollups.render_markdown(name, payload)
    store.append("reports", store.spark.createDataFrame([(name, body)], "name string, body string").withColumn("created_at", F.current_timestamp()), process_id)
    return body
