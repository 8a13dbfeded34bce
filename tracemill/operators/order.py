"""The order in which results are shown, and how many of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of each result by which it is ordered; a minus before those that fall.
ORDERS = {
    "cases": ("started_at", "case_id"),
    "activities": ("-occurrence_count", "activity"),
    "transitions": ("-total_wait_seconds", "source", "target"),
    "loops": ("-repeat_events", "activity"),
    "variants": ("-case_count", "variant_key"),
    "nodes": ("-occurrence_count", "activity"),
    "edges": ("-occurrence_count", "source", "target"),
    "outliers": ("-throughput_seconds", "case_id"),
    "findings": ("-impact_score", "detector", "-inner", "subject"),
    "findings_shown": ("-impact_score", "detector", "-impact_hours", "subject"),
    "opportunities": ("-score", "activity"),
}
#: How many rows are shown, and at most.
LIMITS = {"variants": (50, 500), "findings": (100, 500), "findings_shown": (100, 500), "opportunities": (50, 200)}


def ordered(df: DataFrame, result: str) -> DataFrame:
    return df.orderBy(*[F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in ORDERS[result]])


def first(df: DataFrame, result: str, limit: int | None = None) -> DataFrame:
    """The first rows of a result that is already computed as a whole."""
    usual, most = LIMITS[result]
    limit = usual if limit is None else limit
    if not 1 <= limit <= most:
        raise ValueError(f"{result}: a limit of 1 to {most}, not {limit}")
    return ordered(df, result).limit(limit)
