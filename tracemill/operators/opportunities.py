"""Automation opportunities: seven components and their product per activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import measures_by, monthly_hours, ratio
from .halves import is_late, last_early
from .metrics import flag, window_days

#: What is advised by each approach.
ADVICE = {
    "monitor": "Most runs are done by systems already; look at those that are still done by hand.",
    "integration": "Several systems take part; connect them rather than copy between them.",
    "rule_based_automation": "Runs take much the same time; a rule or a template may do most of them.",
    "assisted": "Runs differ in time, which speaks for judgement; prepare the work and leave the decision.",
}
COMPONENTS = ("frequency", "time_cost", "manuality", "repeatability", "stability", "business_impact", "confidence")


def score_opportunities(steps: DataFrame, cases: DataFrame, min_occurrences: int = 20, hourly_cost: float = 35.0) -> DataFrame:
    scope = F.broadcast(cases.agg(F.count("*").alias("all_cases")).crossJoin(window_days(cases)))  # one row
    of_case = cases.crossJoin(F.broadcast(last_early(cases, 1))).select("case_id", is_late().alias("is_late"), F.col("monetary_value").alias("case_money"))
    rows = steps.join(of_case, "case_id")
    sums = {
        "n": F.lit(1), "case_count": flag(~F.col("is_repeat")), "manual": flag("is_manual"), "known": flag(F.col("is_manual").isNotNull()),
        "late": flag("is_late"), "paid_money": F.col("case_money"), "paid": flag(F.col("case_money").isNotNull()),
    }
    per = measures_by(rows, ["activity"], "service", {"median": 0.5}, sums, "total")
    per = per.withColumns({"manual_share": ratio(F.col("manual"), F.col("known")), "money": ratio(F.col("paid_money"), F.col("paid"))})
    kinds = steps.groupBy("activity", "owner", "source_system").agg(F.lit(1).alias("one")).groupBy("activity").agg(F.countDistinct("owner").alias("owners"), F.array_sort(F.collect_set("source_system")).alias("systems"))
    spread = steps.groupBy("activity").agg(F.avg("service").alias("mean"), F.stddev_pop("service").alias("spread"))
    per = per.join(kinds, "activity").join(spread, "activity")
    top = steps.agg(F.coalesce(F.max("monetary_value"), F.lit(0.0)).alias("top"))
    df = per.where(F.col("n") >= min_occurrences).crossJoin(scope).crossJoin(F.broadcast(top))
    hours = monthly_hours(F.col("total"), F.col("days"))
    early = F.col("n") - F.col("late")
    clamp = lambda x, lo: F.least(F.greatest(x, F.lit(lo)), F.lit(1.0))
    parts = {
        "frequency": 1 - F.exp(-F.col("n") / F.col("all_cases")),
        "time_cost": F.when(hours > 0, 1 - F.exp(-hours / 40)).otherwise(0.0),
        "manuality": F.greatest(F.col("manual_share"), F.lit(0.05)),
        "repeatability": F.when(F.col("n") < 3, 0.5).when(F.col("mean") <= 0, 0.9).otherwise(clamp(1 / (1 + F.col("spread") / F.col("mean")), 0.15)),
        "stability": F.when(F.greatest(early, "late") == 0, 0.0).when(F.least(early, "late") == 0, 0.4).otherwise(0.4 + 0.6 * F.least(early, "late") / F.greatest(early, "late")),
        "business_impact": F.when((F.col("paid") == 0) | (F.col("top") <= 0), 0.6).otherwise(F.least(F.lit(1.0), 0.5 + 0.5 * F.col("money") / F.when(F.col("top") > 0, F.col("top")))),
        "confidence": F.least(0.5 + F.col("n") / 500, F.lit(0.95)),
    }
    for name, value in parts.items():
        df = df.withColumn(name, value)
    product = F.lit(100.0)
    for name in COMPONENTS:
        product = product * F.col(name)
    approach = F.when(F.col("manual_share") < 0.3, "monitor").when(F.size("systems") > 1, "integration").when(F.col("repeatability") >= 0.7, "rule_based_automation").otherwise("assisted")
    blockers = F.array_compact(F.array(
        F.when(F.col("stability") < 0.6, "volume differs between the halves of the window"), F.when(F.col("repeatability") < 0.4, "duration varies widely"), F.when(F.col("confidence") < 0.7, "few observations")
    ))
    return df.select(
        "activity", F.round(product, 2).alias("score"), *[F.round(c, 4).alias(c) for c in COMPONENTS], F.round(hours, 2).alias("estimated_hours_per_month"), F.round(hours * hourly_cost, 2).alias("estimated_eur_per_month"),
        F.col("n").alias("occurrences"), F.col("case_count").alias("cases"), F.round(F.col("median") / 6e7, 2).alias("median_minutes"), F.col("owners"), F.array_join("systems", ",").alias("systems"), F.round("manual_share", 3).alias("manual_share"), F.round("days", 1).alias("window_days"),
        approach.alias("approach"), F.array_join(blockers, "; ").alias("blockers"),
    ).withColumn("detail", F.coalesce(*[F.when(F.col("approach") == k, v) for k, v in ADVICE.items()]))


def carry_status(new: DataFrame, old: DataFrame) -> DataFrame:
    """New opportunities with the status that the activity had, or `proposed`."""
    return new.join(old.select("activity", "status"), "activity", "left").withColumn("status", F.coalesce("status", F.lit("proposed")))
