"""Rule-based findings. Each detector gives rows of one schema."""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import Scratch
from ..functions.stats import HOUR, confidence, fence, impact, monthly_hours, quantiles, quartiles, severity
from .halves import is_late, last_early
from .metrics import activity_base, loop_base, transition_base, variant_base, window_days

US_HOUR = HOUR * 1e6


@dataclass(frozen=True)
class Thresholds:
    """When the detectors fire."""

    min_cases: int = 15
    wait_baseline_multiple: float = 2.5
    min_wait_hours: float = 2.0
    rework_case_share: float = 0.10
    handoff_threshold: float = 4.0
    rare_variant_share: float = 0.10
    expensive_variant_multiple: float = 1.75
    trend_worsening_pct: float = 0.20
    manual_repetition_share: float = 0.60


class Findings:
    """Detectors over one event log's steps, cases and transitions."""

    def __init__(self, steps: DataFrame, cases: DataFrame, transitions: DataFrame, config: Thresholds | None = None, scratch: Scratch | None = None) -> None:
        """scratch: where what several detectors read is written once; without one, each plans it anew."""
        self.steps, self.cases, self.transitions, self.c = steps, cases, transitions, config or Thresholds()
        self.scratch, self.measures = scratch, {}
        scope = cases.agg(F.count("*").alias("all_cases")).crossJoin(window_days(cases))  # one row
        self.quartiles, scope = self._written(quartiles(cases, "throughput"), scope)
        self.scope = F.broadcast(scope)

    def _written(self, *tables: DataFrame) -> list[DataFrame]:
        return self.scratch.keep_all(list(tables)) if self.scratch else list(tables)

    def measured(self) -> Findings:
        """Writes what the detectors measure, so that it is there for other thresholds too (`under`)."""
        parts = (self.edges, self.loops, self.handoffs, self.variants, self.halves, self.activities, self.beyond)
        made = [transition_base(self.transitions), *[part() for part in parts[1:]]]
        self.measures = {part.__name__: df for part, df in zip(parts, self._written(*made))}
        return self

    def under(self, config: Thresholds) -> Findings:
        """The detectors under other thresholds, over the same measures."""
        other = copy.copy(self)
        other.c = config
        return other

    def _measure(self, part: Callable[[], DataFrame]) -> DataFrame:
        """What was written of a part, or the part."""
        return self.measures[part.__name__] if part.__name__ in self.measures else part()

    def edges(self) -> DataFrame:
        """The edges of the model, which are read more than once."""
        return self._written(transition_base(self.transitions))[0]

    def loops(self) -> DataFrame:
        return loop_base(self.steps).drop("all_cases")

    def handoffs(self) -> DataFrame:
        return self.cases.agg(F.avg("handoff_count").alias("mean"))

    def variants(self) -> DataFrame:
        """Variants of five cases and more: no thresholds ask for fewer."""
        return variant_base(self.cases).where("case_count >= 5").select("variant_key", "case_count", "share", "median_throughput", "sequence", "example_case_ids")

    def activities(self) -> DataFrame:
        return activity_base(self.steps)

    def finding(self, df: DataFrame, kind: str, subject: Column, title: Column, cases: Column, metric: Column, baseline: Column, hours: Column, evidence: list[Column], sure: Column | None = None, inner: Column | None = None) -> DataFrame:
        """Rows in the common schema. df has all_cases and days; inner: what falls in the detector's own order."""
        sure = confidence(cases, 400.0) if sure is None else sure
        return df.where(F.col("all_cases") >= max(self.c.min_cases, 2)).select(
            F.lit(kind).alias("finding_type"), subject.alias("subject"), title.alias("title"), severity(hours).alias("severity"), cases.cast("long").alias("affected_case_count"),
            F.round(metric, 6).alias("metric_value"), F.round(baseline.cast("double"), 6).alias("baseline_value"), F.round(hours, 6).alias("impact_hours"),
            impact(hours, cases, F.col("all_cases")).alias("impact_score"), sure.cast("double").alias("confidence"),
            F.substring(F.sha1(F.concat_ws("|", F.lit(kind), subject)), 1, 32).alias("fingerprint"), F.to_json(F.struct(subject.alias("subject"), *evidence)).alias("evidence"),
            (F.lit(0.0) if inner is None else inner.cast("double")).alias("inner"),
        )

    def excessive_waiting(self) -> DataFrame:
        """Waits far above the median of all other edges."""
        # Of the others' medians in order, the middle ones are among three about the middle of all:
        # without its own, an edge has the value at a place, or the next one where its own is not above it.
        # A median is a whole number of half microseconds.
        edges = self._measure(self.edges)
        low = F.floor((F.col("n") - 2) / 2)
        twice = edges.select((2 * F.col("median_wait")).cast("long").alias("twice"))
        middle = quantiles(twice, {f"m{i}": ("twice", low + i) for i in range(3)}, "edges")
        at = lambda i: F.when(2 * F.col("median_wait") > F.col(f"m{i}"), F.col(f"m{i}")).otherwise(F.col(f"m{i + 1}")) / 2
        base = (at(0) + F.when(F.col("edges") % 2 == 0, at(0)).otherwise(at(1))) / 2
        df = edges.crossJoin(F.broadcast(middle)).withColumn("base", F.when(F.col("edges") > 1, base).otherwise(0.0)).crossJoin(self.scope)
        df = df.where((F.col("case_count") >= self.c.min_cases) & (F.col("median_wait") >= self.c.min_wait_hours * US_HOUR) & ~((F.col("base") > 0) & (F.col("median_wait") < F.col("base") * self.c.wait_baseline_multiple)))
        hours = monthly_hours(F.col("total_wait"), F.col("days"))
        return self.finding(
            df, "excessive_waiting", F.concat("source", F.lit("->"), "target"), F.format_string("Cases wait %.1f h between '%s' and '%s'", F.col("median_wait") / US_HOUR, "source", "target"),
            F.col("case_count"), F.col("median_wait") / 1e6, F.col("base") / 1e6, hours,
            [F.col("source").alias("source_activity"), F.col("target").alias("target_activity"), F.lit("median wait of all other transitions").alias("baseline_scope"), F.round(F.col("median_wait") / US_HOUR, 2).alias("median_wait_hours"), F.round(F.col("p90_wait") / US_HOUR, 2).alias("p90_wait_hours"), F.round(F.col("base") / US_HOUR, 2).alias("baseline_median_wait_hours"),
             F.round("handoff_rate", 3).alias("handoff_rate"), F.col("case_count").alias("cases_affected"), F.round(hours, 1).alias("waiting_hours_per_month")], inner=F.col("total_wait"),
        )

    def repeated_activity(self) -> DataFrame:
        df = self._measure(self.loops).crossJoin(self.scope).where((F.col("affected_cases") >= self.c.min_cases) & (F.col("rework_ratio") >= self.c.rework_case_share))
        hours = monthly_hours(F.col("extra"), F.col("days"))
        return self.finding(
            df, "repeated_activity", F.col("activity"), F.format_string("'%s' is repeated in %.0f%% of cases", "activity", F.col("rework_ratio") * 100), F.col("affected_cases"), F.col("rework_ratio"), F.lit(0.0), hours,
            [F.col("activity"), F.col("repeat_events"), F.col("affected_cases").alias("cases_affected"), F.round("rework_ratio", 3).alias("rework_case_ratio"), F.round(hours, 1).alias("rework_hours_per_month")], inner=F.col("repeat_events"),
        )

    def high_handoffs(self) -> DataFrame:
        """Ten minutes a handoff, over the whole window."""
        df = self._measure(self.handoffs).crossJoin(self.scope).where(F.col("mean") >= self.c.handoff_threshold)
        hours = F.col("mean") * F.col("all_cases") * 10 / 60
        return self.finding(
            df, "high_handoff_count", F.lit("process_handoffs"), F.format_string("Cases change hands %.1f times on average", "mean"), F.col("all_cases"), F.col("mean"), F.lit(self.c.handoff_threshold), hours,
            [F.round("mean", 2).alias("mean_handoffs"), F.lit(self.c.handoff_threshold).alias("threshold"), F.col("all_cases").alias("cases_affected"), F.lit("a handoff takes ten minutes").alias("assumption"), F.round(hours, 1).alias("coordination_hours_in_window")],
        )

    def rare_expensive_variant(self) -> DataFrame:
        overall = self.quartiles.select(F.col("q2").alias("overall"))
        df = self._measure(self.variants).crossJoin(F.broadcast(overall)).crossJoin(self.scope).where(
            (F.col("overall") > 0) & (F.col("share") <= self.c.rare_variant_share) & (F.col("case_count") >= max(5, self.c.min_cases // 3))
        ).where(F.col("median_throughput") / F.col("overall") >= self.c.expensive_variant_multiple)
        hours = (F.col("median_throughput") - F.col("overall")) * F.col("case_count") / US_HOUR
        return self.finding(
            df, "rare_expensive_variant", F.concat(F.lit("variant:"), "variant_key"), F.format_string("A rare path takes %.1f times as long", F.col("median_throughput") / F.col("overall")), F.col("case_count"),
            F.col("median_throughput") / 1e6, F.col("overall") / 1e6, hours,
            [F.col("variant_key"), F.col("sequence"), F.col("case_count"), F.round("share", 4).alias("share"), F.round(F.col("median_throughput") / US_HOUR, 2).alias("median_throughput_hours"),
             F.round(F.col("overall") / US_HOUR, 2).alias("process_median_throughput_hours"), F.round(F.col("median_throughput") / F.col("overall"), 2).alias("ratio"), F.col("example_case_ids")], inner=F.col("case_count"),
        )

    def halves(self) -> DataFrame:
        """Medians of the earlier and later half of the cases, by start."""
        placed = self.cases.crossJoin(F.broadcast(last_early(self.cases)))
        late = is_late()
        each = placed.crossJoin(self.scope).select(
            "all_cases", "days", "started_at", late.alias("late"), F.when(~late, F.col("throughput")).alias("early_time"), F.when(late, F.col("throughput")).alias("late_time")
        )
        medians = quantiles(each, {"was": ("early_time", 0.5), "now": ("late_time", 0.5)})
        rest = each.groupBy("all_cases", "days").agg(F.count_if("late").alias("late"), F.min(F.when(F.col("late"), F.col("started_at"))).alias("split_at"))
        return rest.crossJoin(F.broadcast(medians))  # one row each

    def worsening_cycle_time(self) -> DataFrame:
        df = self._measure(self.halves).where((F.col("all_cases") >= max(2 * self.c.min_cases, 20)) & (F.col("was") > 0)).where((F.col("now") - F.col("was")) / F.col("was") >= self.c.trend_worsening_pct)
        change = (F.col("now") - F.col("was")) / F.col("was")
        return self.finding(
            df, "worsening_cycle_time", F.lit("cycle_time_trend"), F.format_string("Median cycle time changed by %.0f%%", change * 100), F.col("late"), F.col("now") / 1e6, F.col("was") / 1e6,
            (F.col("now") - F.col("was")) * F.col("late") / US_HOUR,
            [F.round(F.col("was") / US_HOUR, 2).alias("earlier_median_hours"), F.round(F.col("now") / US_HOUR, 2).alias("recent_median_hours"), F.round(change, 3).alias("change_pct"),
             (F.col("all_cases") - F.col("late")).alias("earlier_cases"), F.col("late").alias("recent_cases"), F.col("split_at"), F.lit("a trend within the window, not its cause").alias("note")],
            confidence(F.col("all_cases"), 400.0),
        )

    def manual_repetition(self) -> DataFrame:
        df = self._measure(self.activities).crossJoin(self.scope).where((F.col("manual_share") >= self.c.manual_repetition_share) & (F.col("case_count") >= self.c.min_cases))
        hours = monthly_hours(F.col("total_service"), F.col("days"))
        return self.finding(
            df.where(hours >= 1), "high_manual_repetition", F.concat(F.lit("manual:"), "activity"), F.format_string("'%s' is done by hand in %.0f%% of events", "activity", F.col("manual_share") * 100), F.col("case_count"),
            F.col("manual_share"), F.lit(self.c.manual_repetition_share), hours,
            [F.col("activity"), F.col("occurrence_count"), F.col("case_count").alias("cases_affected"), F.round("manual_share", 3).alias("manual_share"), F.round(F.col("median_service") / 6e7, 1).alias("median_service_minutes"),
             F.round(hours, 1).alias("hours_per_month"), F.col("distinct_actors")], inner=F.col("occurrence_count"),
        )

    def beyond(self) -> DataFrame:
        """One row of the cases above the upper fence."""
        upper = self.quartiles.select(fence(1).alias("fence"))
        df = self.cases.crossJoin(F.broadcast(upper)).where("throughput > fence")
        worst = df.orderBy(F.desc("throughput"), "started", "case_id").limit(10).agg(F.collect_list(F.struct("case_id", F.round(F.col("throughput") / 1e6, 6).alias("throughput_seconds"), "variant_key")).alias("worst"))
        return df.agg(F.count("*").alias("k"), F.max("fence").alias("fence"), F.sum(F.col("throughput") - F.col("fence")).alias("over")).crossJoin(F.broadcast(worst))

    def outliers(self) -> DataFrame:
        df = self._measure(self.beyond).where("k >= 3").crossJoin(self.scope)
        return self.finding(
            df, "cycle_time_outliers", F.lit("cycle_time_outliers"), F.format_string("%d cases take far longer than the rest", "k"), F.col("k"), F.col("k").cast("double"), F.col("fence") / 1e6, F.col("over") / US_HOUR,
            [F.col("k").alias("outlier_case_count"), F.round(F.col("fence") / US_HOUR, 2).alias("threshold_hours"), F.col("worst").alias("worst_cases"), F.lit("above the upper fence of Tukey, 1.5 quartile ranges").alias("method")], F.lit(0.75),
        )

    def all(self) -> DataFrame:
        """All findings, with what `order.ordered` takes: impact, detector, then the detector's own order (inner)."""
        out = None
        for i, detect in enumerate((self.excessive_waiting, self.repeated_activity, self.high_handoffs, self.rare_expensive_variant, self.worsening_cycle_time, self.manual_repetition, self.outliers)):
            df = detect().withColumn("detector", F.lit(i))
            out = df if out is None else out.unionByName(df)
        return out


def upsert_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored findings after a run: found again, new, or resolved where open and gone.

    old: fingerprint, status, narrative and columns of new, which are measured anew
    where the finding is found again. A resolved finding that is found again stays resolved.
    """
    shared = [c for c in new.columns if c in old.columns and c != "fingerprint"]
    o, n = old.alias("o"), new.select("fingerprint", *shared).alias("n")
    gone = F.col("n.fingerprint").isNull()
    return o.join(n, F.col("o.fingerprint") == F.col("n.fingerprint"), "full_outer").select(
        F.coalesce("o.fingerprint", "n.fingerprint").alias("fingerprint"),
        F.when(F.col("o.fingerprint").isNull(), "open").when(gone & (F.col("o.status") == "open"), "resolved").otherwise(F.col("o.status")).alias("status"),
        F.col("o.narrative").alias("narrative"), *[F.when(gone, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in shared],
    )
