"""An event log as lazy tables: steps, cases, transitions.

Everything that looks along a case partitions by case_id (or by more), so one
exchange on case_id serves all windows and the aggregate that follows.
Durations are whole microseconds until they are shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.session import Scratch
from ..functions.stats import micros, seconds

#: Between the activities of a path; names of activities are taken to lack it.
SEPARATOR = "␟"
#: Steps of a case that are put in order together.
PIECE = 4096
#: What metrics and detectors read of a step.
STEP_COLUMNS = (
    "case_id", "activity", "occurred_at", "completed_at", "occ", "fin", "service", "owner", "pos", "prev_owner", "prev_fin", "next_activity", "next_owner", "next_occ", "is_repeat",
    "is_manual", "monetary_value", "source_system",
)


def owner(team: Column, actor: Column) -> Column:
    """Team, else actor; an empty name counts as missing."""
    return F.coalesce(F.nullif(team, F.lit("")), F.nullif(actor, F.lit("")), F.lit("unassigned"))


def _in_order(by: str, text: str) -> Column:
    """An aggregate: the texts of a group as one, in the order of `by`."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, text))), lambda x: x[text]), SEPARATOR)


class EventLog:
    """Canonical events: case_id, activity, occurred_at, and what else is known."""

    def __init__(self, events: DataFrame) -> None:
        self.events = events
        self._kept: DataFrame | None = None
        self._kept_cases: DataFrame | None = None
        self.scratch: Scratch | None = None

    def keep(self) -> EventLog:
        """Computes the steps once for all that follows, until `release`."""
        self._kept = self.steps().persist()
        return self

    def release(self) -> None:
        if self._kept is not None:
            self._kept.unpersist()
            self._kept = None

    def fixed(self, *columns: str) -> EventLog:
        """Writes the steps and the cases once, in the shared folder, for all that follows.

        columns: those of the steps, by default all; metrics and detectors read STEP_COLUMNS.
        """
        self.scratch = Scratch(self.events.sparkSession, "log")
        self._kept = self.scratch.keep(self.steps().select(*columns or ("*",)))
        self._kept_cases = self.scratch.keep(self.cases().drop("sequence", "sla_breached"))
        return self

    def between(self, start: str | None = None, end: str | None = None) -> EventLog:
        """Cases that start in [start, end), with all their events."""
        first = F.min("occurred_at").over(W.Window.partitionBy("case_id"))
        df = self.events.withColumn("first_at", first)
        if start is not None:
            df = df.where(F.col("first_at") >= F.lit(start).cast("timestamp_ntz"))
        if end is not None:
            df = df.where(F.col("first_at") < F.lit(end).cast("timestamp_ntz"))
        return EventLog(df.drop("first_at"))

    def of_case(self, case_id: str) -> EventLog:
        return EventLog(self.events.where(F.col("case_id") == case_id))

    def timed(self) -> DataFrame:
        """Events with occ, fin and service in microseconds, and the owner."""
        service = (
            F.when(F.col("duration_ms").isNotNull(), F.col("duration_ms") * 1000)
            .when(F.col("completed_at").isNotNull(), F.greatest(F.col("fin") - F.col("occ"), F.lit(0)))
            .otherwise(0)
        )
        return (
            self.events.withColumn("occ", micros("occurred_at"))
            .withColumn("fin", F.coalesce(micros("completed_at"), F.col("occ")))
            .withColumn("service", service)
            .withColumn("owner", owner(F.col("team"), F.col("actor_id")))
        )

    def steps(self) -> DataFrame:
        """One row per event, with its place in the case and its neighbours."""
        if self._kept is not None:
            return self._kept
        case = W.Window.partitionBy("case_id").orderBy("occ", "activity", "source_event_id")
        same = W.Window.partitionBy("case_id", "activity").orderBy("occ", "source_event_id")
        df = self.timed()
        # Dealt once by case: the narrower window and later aggregates need no more.
        return (
            df.repartition("case_id")
            .withColumn("pos", F.row_number().over(case))
            .withColumn("prev_owner", F.lag("owner").over(case))
            .withColumn("prev_fin", F.lag("fin").over(case))
            .withColumn("next_activity", F.lead("activity").over(case))
            .withColumn("next_owner", F.lead("owner").over(case))
            .withColumn("next_occ", F.lead("occ").over(case))
            .withColumn("is_repeat", F.row_number().over(same) > 1)
        )

    def transitions(self) -> DataFrame:
        """Adjacent events of a case; the wait runs from the end of the first."""
        return (
            self.steps()
            .where(F.col("next_activity").isNotNull())
            .select(
                "case_id", "pos", F.col("activity").alias("source"), F.col("next_activity").alias("target"),
                F.greatest(F.col("next_occ") - F.col("fin"), F.lit(0)).alias("wait"), (F.col("owner") != F.col("next_owner")).alias("is_handoff"),
            )
        )

    def cases(self, sla_hours: float | None = None) -> DataFrame:
        """One row per case, in microseconds.

        `path` is the text of its activities in order, and `sequence` their list. A case is summed
        up in pieces of PIECE steps first and then over these, both where it was dealt to,
        so what a task holds of a very long case is its path, never a list of its steps.
        """
        df = self._case_rows() if self._kept_cases is None else self._kept_cases
        late = F.col("throughput") > sla_hours * 3_600_000_000 if sla_hours else F.lit(False)
        return df.withColumn("sequence", F.split("path", SEPARATOR)).withColumn("sla_breached", late)

    def _case_rows(self) -> DataFrame:
        pieces = self.steps().groupBy("case_id", F.floor((F.col("pos") - 1) / PIECE).alias("piece")).agg(
            F.min("occ").alias("started"),
            F.max("fin").alias("ended"),
            F.min(F.col("occurred_at").cast("timestamp_ntz")).alias("started_at"),
            F.max(F.coalesce("completed_at", "occurred_at").cast("timestamp_ntz")).alias("ended_at"),
            F.count("*").alias("event_count"),
            F.sum("service").alias("service"),
            F.count_if(F.col("prev_owner") != F.col("owner")).alias("handoff_count"),
            F.count_if("is_repeat").alias("rework_count"),
            F.count_if("is_manual").alias("manual_event_count"),
            F.max("monetary_value").alias("monetary_value"),
            _in_order("pos", "activity").alias("path"),
        )
        how = {"started": F.min, "started_at": F.min, "ended": F.max, "ended_at": F.max, "monetary_value": F.max}
        whole = [how.get(c, F.sum)(c).alias(c) for c in pieces.columns[2:-1]]
        df = pieces.groupBy("case_id").agg(*whole, _in_order("piece", "path").alias("path"))
        df = df.withColumn("throughput", F.greatest(F.col("ended") - F.col("started"), F.lit(0)))
        df = df.withColumn("waiting", F.greatest(F.col("throughput") - F.col("service"), F.lit(0)))
        return df.withColumn("variant_key", F.substring(F.sha1("path"), 1, 16))

    def timeline(self, case_id: str) -> DataFrame:
        """Steps of one case; the filter reaches the scan."""
        wait = F.coalesce(F.greatest(F.col("occ") - F.col("prev_fin"), F.lit(0)), F.lit(0))
        return self.of_case(case_id).steps().select(
            "case_id", "pos", "activity", "occurred_at", "completed_at", "owner", "source_system", "is_manual",
            seconds("service").alias("service_seconds"), seconds(wait).alias("wait_before_seconds"),
        )


def cases_shown(cases: DataFrame) -> DataFrame:
    """Cases with times in seconds."""
    return cases.select(
        "case_id", "variant_key", "started_at", "ended_at",
        seconds("throughput").alias("throughput_seconds"), seconds("waiting").alias("waiting_seconds"), "event_count", "handoff_count", "rework_count",
        "manual_event_count", "monetary_value", "sla_breached",
    )
