"""The earlier and the later half of the cases, told apart by one case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Digits of a start in microseconds: hours, seconds within one, and what is left.
DIGITS = (3_600_000_000, 1_000_000, 1)


def _at_place(counts: DataFrame) -> DataFrame:
    """One row (d, place) of counts (d, place, k): where the place is counted in the order of d, and the place within it."""
    through = F.sum("k").over(W.Window.orderBy("d").rowsBetween(W.Window.unboundedPreceding, 0))
    return counts.withColumn("through", through).where("place <= through AND place > through - k").select("d", (F.col("place") - F.col("through") + F.col("k")).alias("place"))


def last_early(cases: DataFrame, least: int = 0) -> DataFrame:
    """One row: `pivot`, the (started, case_id) of the last case of the earlier half, or null where none is early.

    The earlier half has n // 2 cases, and `least` at least. The place of its last case
    is looked for by radix: cases are counted by the hour of their start, then those of
    the hour that has the place by second, then those of the second by microsecond. No count
    has more than a million rows beyond the hours of the log, and cases are
    not numbered. Cases that start in the same microsecond as the last one are put in
    order by case_id.
    """
    rows = cases.select("started", "case_id")
    total = rows.agg(F.greatest(F.floor(F.count("*") / 2), F.lit(least)).alias("place"))
    inside = rows.crossJoin(F.broadcast(total))  # every row carries the place: one table at a time is read
    unit, at = None, None
    for digit in DIGITS:
        if at is not None:
            inside = rows.crossJoin(F.broadcast(at)).where(F.expr(f"started div {unit}") == F.col("d")).drop("d")
        at = _at_place(inside.groupBy(F.expr(f"started div {digit}").alias("d"), "place").agg(F.count("*").alias("k")))
        unit = digit
    same = rows.crossJoin(F.broadcast(at)).where(F.col("started") == F.col("d"))
    same = same.withColumn("k", F.row_number().over(W.Window.orderBy("case_id"))).where("k = place")
    return same.agg(F.max(F.struct("started", "case_id")).alias("pivot"))


def is_late() -> Column:
    """Whether a case (started, case_id, pivot) is of the later half."""
    return F.coalesce(F.struct("started", "case_id") > F.col("pivot"), F.lit(True))
