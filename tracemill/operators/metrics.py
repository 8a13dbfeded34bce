"""Cycle, waiting, rework and handoff metrics of an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.stats import fence, measures_by, quantiles, quartiles, ratio, seconds, total
from .eventlog import SEPARATOR


def shown(name: str) -> Column:
    """A quantile in seconds; 0 where there is none."""
    return seconds(F.coalesce(F.col(name), F.lit(0.0))).alias(name)


def shown_path(joint: str) -> Column:
    """The path of a case or variant with another joint."""
    return F.replace("path", F.lit(SEPARATOR), F.lit(joint))


def percentiles(cases: DataFrame) -> DataFrame:
    names = {f"p{q}_seconds": ("throughput", q / 100) for q in (5, 25, 50, 75, 90, 95, 99)}
    return quantiles(cases, names).select(*map(shown, names))


def tukey_fences(cases: DataFrame, factor: float = 1.5) -> DataFrame:
    return quartiles(cases, "throughput").select(seconds(fence(-1, factor)).alias("lower_seconds"), seconds(fence(1, factor)).alias("upper_seconds"))


def throughput(cases: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    rest = cases.agg(
        F.count("*").alias("case_count"),
        F.coalesce(seconds(F.avg("throughput")), zero).alias("mean_seconds"),
        F.coalesce(seconds(F.min("throughput")), zero).alias("min_seconds"),
        F.coalesce(seconds(F.max("throughput")), zero).alias("max_seconds"),
    )
    names = {"median_seconds": ("throughput", 0.5), "p90_seconds": ("throughput", 0.9), "p95_seconds": ("throughput", 0.95)}
    both = rest.crossJoin(F.broadcast(quantiles(cases, names)))  # one row each
    return both.select("case_count", shown("median_seconds"), "mean_seconds", shown("p90_seconds"), shown("p95_seconds"), "min_seconds", "max_seconds")


def flag(c: Column | str) -> Column:
    """1 where a condition holds."""
    return F.when(F.col(c) if isinstance(c, str) else c, 1).otherwise(0)


def activity_base(steps: DataFrame) -> DataFrame:
    """Per activity, with durations in microseconds.

    A case has an activity for the first time once, so cases need no distinct count.
    """
    sums = {"occurrence_count": F.lit(1), "case_count": flag(~F.col("is_repeat")), "manual": flag("is_manual"), "known": flag(F.col("is_manual").isNotNull()), "repeat_events": flag("is_repeat")}
    base = measures_by(steps, ["activity"], "service", {"median_service": 0.5}, sums, "total_service").withColumn("manual_share", ratio(F.col("manual"), F.col("known"))).drop("manual", "known")
    owners = steps.groupBy("activity", "owner").agg(F.lit(1).alias("one")).groupBy("activity").agg(F.count("owner").alias("distinct_actors"))
    return base.join(owners, "activity")


def activity_metrics(steps: DataFrame) -> DataFrame:
    return activity_base(steps).select(
        "activity", "occurrence_count", "case_count", seconds("median_service").alias("median_service_seconds"), seconds("total_service").alias("total_service_seconds"),
        F.round("manual_share", 6).alias("manual_share"), "distinct_actors", F.round(F.col("repeat_events") / F.col("case_count"), 6).alias("repeat_rate"),
    )


def _with_first(transitions: DataFrame) -> DataFrame:
    """Transitions with `first`: whether it is the first of its kind in the case."""
    return transitions.withColumn("first", F.row_number().over(W.Window.partitionBy("case_id", "source", "target").orderBy("pos")) == 1)


def transition_counts(transitions: DataFrame) -> DataFrame:
    """Edges with their counts alone, without waits."""
    return _with_first(transitions).groupBy("source", "target").agg(F.count("*").alias("occurrence_count"), F.count_if("first").alias("case_count"))


def transition_base(transitions: DataFrame) -> DataFrame:
    """Per edge, with waits in microseconds.

    Which transition is the first of its kind in a case is told within cases, which are
    dealt by case already; so what is shuffled by edge are counts.
    """
    sums = {"occurrence_count": F.lit(1), "case_count": flag("first"), "handoffs": flag("is_handoff")}
    base = measures_by(_with_first(transitions), ["source", "target"], "wait", {"median_wait": 0.5, "p90_wait": 0.9}, sums, "total_wait")
    return base.withColumn("handoff_rate", F.col("handoffs") / F.col("occurrence_count")).drop("handoffs")


def _edges_shown(base: DataFrame, *more: str) -> DataFrame:
    return base.select(
        "source", "target", "occurrence_count", "case_count", seconds("median_wait").alias("median_wait_seconds"), seconds("p90_wait").alias("p90_wait_seconds"),
        seconds("total_wait").alias("total_wait_seconds"), F.round("handoff_rate", 6).alias("handoff_rate"), *more,
    )


def transition_metrics(transitions: DataFrame) -> DataFrame:
    return _edges_shown(transition_base(transitions))


def slowest_transitions(transitions: DataFrame, n: int = 6) -> DataFrame:
    """The n transitions of the longest median wait."""
    return transition_metrics(transitions).orderBy(F.desc("median_wait_seconds"), "source", "target").limit(n)


def loop_base(steps: DataFrame) -> DataFrame:
    every = steps.agg(F.count_if(F.col("pos") == 1).alias("all_cases"))
    return (
        steps.where("is_repeat").groupBy("activity").agg(F.count("*").alias("repeat_events"), F.countDistinct("case_id").alias("affected_cases"), total("service").alias("extra"))
        .crossJoin(F.broadcast(every))  # one row
        .withColumn("rework_ratio", F.col("affected_cases") / F.col("all_cases"))
    )


def loop_metrics(steps: DataFrame) -> DataFrame:
    return loop_base(steps).select("activity", "repeat_events", "affected_cases", F.round("rework_ratio", 6).alias("rework_ratio"), seconds("extra").alias("extra_seconds_total"))


def variant_base(cases: DataFrame) -> DataFrame:
    """Per variant; the five first cases by start stand for it.

    These are a branch of their own: Spark takes the first five of each variant
    before the shuffle too, and the aggregate needs no order.
    """
    order = W.Window.partitionBy("variant_key").orderBy("started", "case_id")
    first = cases.select("variant_key", "started", "case_id", "path").withColumn("rank", F.row_number().over(order)).where("rank <= 5")
    first = first.groupBy("variant_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "case_id"))), lambda x: x.case_id).alias("example_case_ids"), F.first("path").alias("path"))
    first = first.withColumn("sequence", F.split("path", SEPARATOR))
    every = cases.agg(F.count("*").alias("all_cases"))
    sums = {"case_count": F.lit(1), "late": flag("sla_breached"), "handoffs": F.col("handoff_count"), "reworked": flag(F.col("rework_count") > 0), "money": F.col("monetary_value")}
    base = measures_by(cases, ["variant_key"], "throughput", {"median_throughput": 0.5}, sums, "total")
    means = {"mean_throughput": "total", "sla_breach_rate": "late", "mean_handoffs": "handoffs", "rework_case_ratio": "reworked"}
    base = base.select("variant_key", "case_count", "median_throughput", F.coalesce("money", F.lit(0.0)).alias("total_monetary_value"), *[(F.col(c) / F.col("case_count")).alias(name) for name, c in means.items()])
    return base.join(first, "variant_key").crossJoin(F.broadcast(every)).withColumn("share", F.col("case_count") / F.col("all_cases"))


def variants(cases: DataFrame) -> DataFrame:
    return variant_base(cases).select(
        "variant_key", shown_path(" > ").alias("sequence"), "case_count", F.round("share", 6).alias("share"), seconds("median_throughput").alias("median_throughput_seconds"),
        seconds("mean_throughput").alias("mean_throughput_seconds"), F.round("total_monetary_value", 2).alias("total_monetary_value"), F.array_join("example_case_ids", ",").alias("example_case_ids"),
    )


def variants_enriched(cases: DataFrame) -> DataFrame:
    return variant_base(cases).select(
        "variant_key", "case_count", F.round("share", 6).alias("share"), F.round("sla_breach_rate", 6).alias("sla_breach_rate"),
        F.round("mean_handoffs", 6).alias("mean_handoffs"), F.round("rework_case_ratio", 6).alias("rework_case_ratio"),
    )


#: The quantiles of a summary.
MEDIANS = {"median_throughput_seconds": ("throughput", 0.5), "p90_throughput_seconds": ("throughput", 0.9), "median_waiting_seconds": ("waiting", 0.5)}


def case_aggregates() -> list[Column]:
    """The case-level part of a summary, but for its quantiles."""
    return [
        F.count("*").alias("case_count"),
        F.sum("event_count").alias("event_count"),
        F.countDistinct("variant_key").alias("variant_count"),
        F.round(ratio(total("waiting"), total("throughput")), 6).alias("waiting_share"),
        F.round(F.coalesce(F.avg("handoff_count"), F.lit(0.0)), 6).alias("mean_handoffs"),
        F.round(F.coalesce(F.avg((F.col("rework_count") > 0).cast("int")), F.lit(0.0)), 6).alias("rework_case_ratio"),
        F.round(F.coalesce(F.avg(F.col("sla_breached").cast("int")), F.lit(0.0)), 6).alias("sla_breach_rate"),
        F.round(ratio(F.sum("manual_event_count"), F.sum("event_count")), 6).alias("manual_event_share"),
    ]


def summary(steps: DataFrame, cases: DataFrame) -> DataFrame:
    activities = steps.agg(F.countDistinct("activity").alias("activity_count"))
    span = [F.min("started_at").alias("window_start"), F.max("ended_at").alias("window_end")]
    rest = cases.agg(*case_aggregates(), *span)
    order = [*rest.columns[:3], *map(shown, MEDIANS), *rest.columns[3:], "activity_count"]
    return rest.crossJoin(F.broadcast(quantiles(cases, MEDIANS))).crossJoin(F.broadcast(activities)).select(*order)  # one row each


def sla_breach_rate(cases: DataFrame) -> DataFrame:
    return cases.agg(F.round(F.coalesce(F.avg(F.col("sla_breached").cast("int")), F.lit(0.0)), 6).alias("sla_breach_rate"))


def manual_share(cases: DataFrame) -> DataFrame:
    return cases.agg(F.round(ratio(F.sum("manual_event_count"), F.sum("event_count")), 6).alias("manual_event_share"))


def window_days(cases: DataFrame) -> DataFrame:
    """Days from the first start to the last end, one at least."""
    return cases.agg(F.greatest((F.max("ended") - F.min("started")) / 86_400_000_000, F.lit(1.0)).alias("days"))


def outlier_cases(cases: DataFrame, factor: float = 1.5) -> DataFrame:
    upper = quartiles(cases, "throughput").select(fence(1, factor).alias("fence"))
    return cases.crossJoin(F.broadcast(upper)).where("throughput > fence").select("case_id", seconds("throughput").alias("throughput_seconds"), "variant_key", seconds("fence").alias("threshold_seconds"))


COMPARED = ("median_throughput_seconds", "p90_throughput_seconds", "median_waiting_seconds", "mean_handoffs", "rework_case_ratio", "sla_breach_rate", "manual_event_share")


def before_after(cases: DataFrame, split_at: str) -> DataFrame:
    """Seven metrics of the cases that start before and from a time; lower is better."""
    period = F.when(F.col("started_at") < F.lit(split_at).cast("timestamp_ntz"), "before").otherwise("after")
    wanted = ", ".join(f"'{m}', `{m}`" for m in COMPARED)
    columns = list(dict.fromkeys(c for c, _ in MEDIANS.values()))
    times = cases.select(period.alias("period"), F.explode(F.array(*[F.struct(F.lit(c).alias("s"), F.col(c).alias("t")) for c in columns])).alias("x")).select("period", "x.s", "x.t")
    found = measures_by(times, ["period", "s"], "t", {f"q{q}": q for _, q in MEDIANS.values()}, {})
    found = found.groupBy("period").agg(*[seconds(F.max(F.when(F.col("s") == c, F.col(f"`q{q}`")))).alias(name) for name, (c, q) in MEDIANS.items()])
    long = cases.groupBy(period.alias("period")).agg(*case_aggregates()).join(found, "period").selectExpr("period", f"stack({len(COMPARED)}, {wanted}) AS (metric, value)")
    wide = long.groupBy("metric").agg(*[F.coalesce(F.max(F.when(F.col("period") == p, F.col("value"))), F.lit(0.0)).alias(p) for p in ("before", "after")])
    change = F.col("after") - F.col("before")
    return wide.select(
        "metric", "before", "after", F.round(change, 6).alias("change"), F.round(F.try_divide(change, F.when(F.col("before") != 0, F.col("before"))), 6).alias("change_pct"),
        F.when(F.round(change, 6) != 0, change < 0).alias("improved"),
    )


def before_after_counts(cases: DataFrame, split_at: str, least: int = 10) -> DataFrame:
    """How many cases each side of a comparison has, with a note where one has fewer than `least`."""
    before = F.col("started_at") < F.lit(split_at).cast("timestamp_ntz")
    counts = cases.agg(F.count_if(before).alias("cases_before"), F.count_if(~before).alias("cases_after"))
    few = F.least("cases_before", "cases_after") < least
    return counts.withColumn("note", F.when(few, f"a side has fewer than {least} cases").otherwise("differences are not causes"))
