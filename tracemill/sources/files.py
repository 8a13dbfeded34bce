"""Delimited files: sniffing, reading, profiling and mapping to canonical events."""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as tx
from ..functions.session import with_checkpoints
from .records import records

# Names of columns by which a canonical field is recognised, best first.
FIELD_NAMES = {
    "case_id": ("case_id", "case", "order_id", "ticket_id", "invoice_id", "process_id", "id"),
    "activity_name": ("activity", "activity_name", "step", "task", "event", "action", "status"),
    "occurred_at": ("occurred_at", "timestamp", "time", "started_at", "start", "created_at", "date"),
    "completed_at": ("completed_at", "end", "ended_at", "finished_at", "closed_at"),
    "actor_id": ("actor", "actor_id", "user", "user_id", "assignee", "owner", "agent", "handled_by", "processed_by", "performed_by"),
    "team": ("team", "group", "department", "queue", "unit"),
    "source_system": ("source", "source_system", "system", "application"),
    "duration_ms": ("duration_ms", "duration", "elapsed_ms"),
    "monetary_value": ("amount", "value", "monetary_value", "total", "revenue", "price"),
    "object_type": ("object_type", "entity_type", "type"),
    "object_id": ("object_id", "entity_id", "reference"),
    "status_before": ("status_before", "from_status", "old_status"),
    "status_after": ("status_after", "to_status", "new_status"),
    "is_manual": ("is_manual", "manual", "channel", "automated"),
}
REQUIRED = ("case_id", "activity_name", "occurred_at")
#: Values of a column that a profile shows.
SAMPLES = 5


def sniff_delimiter(head: str) -> str:
    try:
        return csv.Sniffer().sniff(head[:4096], delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def read_delimited(spark: SparkSession, path: str, max_rows: int | None = None, breaks: bool | None = None) -> DataFrame:
    """All columns that have a name as sanitised text, with row_index from 1 in the order of the file.

    breaks: whether quoted cells may hold line breaks. If not (False), lines are records;
    else they are cut as `records` does. Either way files are split among tasks.
    """
    head = "\n".join(r.value for r in spark.read.text(path).limit(200).collect()).lstrip("\ufeff")
    sep = sniff_delimiter("\n".join(head.split("\n")[:20]))
    named = next((r for r in csv.reader(io.StringIO(head), delimiter=sep) if r), [])
    if breaks is False:
        raw = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)
        raw = number_rows(raw.toDF(*[f"c{i}" for i in range(len(raw.columns))]).withColumn("row_index", F.monotonically_increasing_id()))
    else:
        raw = _parsed_records(records(with_checkpoints(spark), path, sep), len(named), sep)
    columns = [(f"c{i}", c.strip()) for i, c in enumerate(named) if c.strip()]
    df = raw.select(*[tx.sanitize(F.col(k)).alias(c) for k, c in columns], "row_index")
    return df if max_rows is None else df.where(F.col("row_index") <= max_rows)


def _parsed_records(found: DataFrame, width: int, sep: str) -> DataFrame:
    """Cells c0, c1, ... of the records but the first of each file, with row_index from 1."""
    first = found.groupBy("file").agg(F.min("record").alias("first"))
    order = W.Window.orderBy("first")
    first = first.withColumn("heads", F.row_number().over(order))  # a row per file
    cells = F.from_csv("text", ", ".join(f"c{i} string" for i in range(width)), {"sep": sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"})
    rows = found.join(F.broadcast(first), "file").where("record > first")
    return rows.select((F.col("record") - F.col("heads")).alias("row_index"), F.regexp_replace("text", "^\ufeff", "").alias("text")).select("row_index", cells.alias("cells")).select("row_index", "cells.*")


def number_rows(df: DataFrame) -> DataFrame:
    """row_index from 1, dense, in the order of an increasing row_index.

    The rows before a partition's are counted; rows are numbered within it.
    """
    part = F.shiftright("row_index", 33)
    counts = df.groupBy(part.alias("part")).agg(F.count("*").alias("k"))
    before = counts.select("part", (F.sum("k").over(W.Window.orderBy("part")) - F.col("k")).alias("before"))
    rank = F.col("row_index").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return df.withColumn("part", part).join(F.broadcast(before), "part").withColumn("row_index", rank + F.col("before")).drop("part", "before")  # a row per partition


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, non_empty, distinct_count, samples): a row per source column."""
    long = rows.select("row_index", F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(f"`{c}`") for c in columns]))).alias("column", "value")).where("value IS NOT NULL AND value <> ''")
    values = long.groupBy("column", "value").agg(F.count("*").alias("k"), F.min("row_index").alias("first"))
    counts = values.groupBy("column").agg(F.sum("k").alias("non_empty"), F.count("*").alias("distinct_count"))
    # Each task gives its first values of a column before they meet; no task sees all of a column.
    first = values.withColumn("rank", F.row_number().over(W.Window.partitionBy("column").orderBy("first", "value"))).where(F.col("rank") <= SAMPLES)
    sample = first.groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x.value), "|").alias("samples"))
    return counts.join(sample, "column").select("column", "non_empty", "distinct_count", "samples")


def infer_types(rows: DataFrame, columns: list[str], sample: int = 200) -> DataFrame:
    """(column, inferred_type) by the first non-empty values of each column."""
    long = rows.select("row_index", F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(f"`{c}`") for c in columns]))).alias("column", "value"))
    filled = long.where("value IS NOT NULL AND value <> ''").withColumn("rank", F.row_number().over(W.Window.partitionBy("column").orderBy("row_index"))).where(F.col("rank") <= sample)
    v = F.col("value")
    stats = filled.groupBy("column").agg(
        F.count("*").alias("n"), F.every(tx.timestamp(v).isNotNull()).alias("dates"), F.every(F.translate(v, ",", ".").rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$")).alias("numbers"),
        F.countDistinct(F.lower(v)).alias("folded"), F.countDistinct(v).alias("kinds"),
    )
    kind = F.when(F.col("dates"), "datetime").when(F.col("numbers"), "number").when(F.col("folded") <= 2, "boolean").when(F.col("kinds") <= F.greatest(F.lit(2), F.floor(F.col("n") / 10)), "categorical").otherwise("string")
    every = rows.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(stats, "column", "left").select("column", F.when(F.col("n").isNull(), "empty").otherwise(kind).alias("inferred_type"))


def import_profile(rows: DataFrame, sample_rows: int = 5) -> dict:
    """What a user sees before mapping: rows, columns with type, values and suggested field, warnings, first rows.

    A row per column comes to the driver, and the first rows.
    """
    columns = [c for c in rows.columns if c != "row_index"]
    types = {r.column: r.inferred_type for r in infer_types(rows, columns).collect()}
    found = {r.column: r.asDict() for r in column_profile(rows, columns).collect()}
    mapping = suggest_mapping({c: types[c] for c in columns})
    field_of = {c: f for f, c in mapping.items()}
    n = rows.count()
    empty = {"non_empty": 0, "distinct_count": 0, "samples": ""}
    shown = [{"column": c, "inferred_type": types[c], "suggested_field": field_of.get(c)} | {k: found.get(c, empty)[k] for k in empty} for c in columns]
    warnings = [f"no column for {f}" for f in REQUIRED if f not in mapping] + [f"column {c} is empty" for c in columns if types[c] == "empty"] + (["no rows"] if not n else [])
    first = [r.asDict() for r in rows.orderBy("row_index").limit(sample_rows).collect()]
    return {"row_count": n, "columns": shown, "mapping": mapping, "warnings": warnings, "sample_rows": first}


#: What it is worth how a name is in a column's (both between underscores), best first.
FITS = (
    (100, lambda column, name: column == name),
    (60, lambda column, name: column.startswith(name) or column.endswith(name)),
    (30, lambda column, name: name.strip("_") in column),
)


def match_score(column: str, names: tuple[str, ...]) -> int:
    """How well a column fits: the first of the names that is in it decides, earlier ones count more."""
    words = "_".join(["", *re.findall(r"[a-z0-9]+", column.lower()), ""])
    worth = [next((w for w, fits in FITS if fits(words, f"_{name}_")), 0) for name in names]
    return next((w - place for place, w in enumerate(worth) if w), 0)


def suggest_mapping(types: dict[str, str]) -> dict[str, str]:
    """Canonical field -> column: each field, in their order, takes the free column that fits best, the first of equals."""
    free = list(types)
    dates = [c for c in types if types[c] == "datetime"]
    chosen: dict[str, str] = {}
    for name, keys in FIELD_NAMES.items():
        allowed = [c for c in free if c in dates] if name in ("occurred_at", "completed_at") else free
        best = max(allowed, key=lambda c: match_score(c, keys), default=None)
        if best is not None and match_score(best, keys) > 0:
            chosen[name] = best
            free.remove(best)
    spare = [c for c in dates if c in free]
    if "occurred_at" not in chosen and spare:
        chosen["occurred_at"] = spare[0]
    return chosen


@dataclass(frozen=True)
class Mapping:
    """Columns of each canonical field, and defaults."""

    columns: dict[str, str]
    source_system: str = "upload"
    manual_words: tuple[str, ...] = field(default=tx.TRUE_WORDS)

    def text(self, name: str):
        c = self.columns.get(name)
        return tx.canonical(F.col(f"`{c}`")) if c else F.lit(None).cast("string")

    def raw(self, name: str):
        c = self.columns.get(name)
        return F.col(f"`{c}`") if c else F.lit(None).cast("string")


def _parsed(rows: DataFrame, m: Mapping) -> DataFrame:
    # A generated row is computed once, however often its columns are named after it.
    texts = F.struct(m.text("case_id").alias("e_case"), m.text("activity_name").alias("e_activity"), tx.bare(m.raw("occurred_at")).alias("t_at"), tx.bare(m.raw("completed_at")).alias("t_done"))
    df = rows.select("*", F.inline(F.array(texts)))
    times = F.struct(tx.bare_timestamp(F.col("t_at")).alias("e_at"), tx.bare_timestamp(F.col("t_done")).alias("e_done"))
    df = df.select("*", F.inline(F.array(times))).drop("t_at", "t_done")
    problems = F.array_compact(F.array(
        F.when(F.col("e_case").isNull(), "missing case_id"), F.when(F.col("e_activity").isNull(), "missing activity_name"), F.when(F.col("e_at").isNull(), "unparseable occurred_at")
    ))
    return df.withColumn("problems", problems)


def iso(c):
    """ISO form of a timestamp in UTC, as identifiers carry it."""
    micro = F.when(F.date_format(c, "SSSSSS") != "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"))
    return F.concat(micro, F.lit("+00:00"))


def normalize_events(rows: DataFrame, m: Mapping) -> DataFrame:
    """Accepted rows as canonical events, with their row_index."""
    ok = _parsed(rows, m).where(F.size("problems") == 0)
    made = F.concat_ws(":", "e_case", "e_activity", iso(F.col("e_at")))
    df = ok.select(
        "row_index", F.col("e_case").alias("case_id"), F.col("e_activity").alias("activity"), F.col("e_at").alias("occurred_at"), F.when(F.col("e_done") >= F.col("e_at"), F.col("e_done")).alias("completed_at"),
        *[m.text(c).alias(c) for c in ("actor_id", "actor_type", "team", "object_type", "object_id", "status_before", "status_after")], tx.number(m.raw("duration_ms")).cast("long").alias("duration_ms"),
        tx.number(m.raw("monetary_value")).alias("monetary_value"), tx.truthy(m.raw("is_manual"), m.manual_words).alias("is_manual"), F.coalesce(m.text("source_system"), F.lit(m.source_system)).alias("source_system"),
        F.coalesce(m.text("source_event_id"), made).alias("source_event_id"),
    )
    return df


def rejected_rows(rows: DataFrame, m: Mapping) -> DataFrame:
    """(row_index, problems) of rows that are no events."""
    return _parsed(rows, m).where(F.size("problems") > 0).select("row_index", F.array_join("problems", "; ").alias("problems"))


def with_identity(events: DataFrame, default_system: str = "api") -> DataFrame:
    """Events with a source system and an id: by default the given one, and case, activity and time."""
    have = set(events.columns)
    named = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in have else F.lit(None).cast("string")
    made = F.lit(None).cast("string")
    if {"case_id", "activity", "occurred_at"} <= have:
        made = F.concat(F.col("case_id"), F.lit(":"), F.col("activity"), F.lit(":"), iso(F.col("occurred_at").cast("timestamp_ntz")))
    return events.withColumn("source_system", F.coalesce(named("source_system"), F.lit(default_system))).withColumn("source_event_id", F.coalesce(named("source_event_id"), made))


def new_events(incoming: DataFrame, stored: DataFrame, default_system: str = "api") -> DataFrame:
    """Incoming events that are not stored, first of each identity by row_index.

    Events that lack an id get one first; those that have nothing to make one of are all new.
    """
    key = ["source_system", "source_event_id"]
    known = with_identity(incoming, default_system)
    named = known.where("source_event_id IS NOT NULL")
    once = named.withColumn("k", F.row_number().over(W.Window.partitionBy(*key).orderBy("row_index"))).where("k = 1").drop("k")
    return once.join(stored.select(*key), key, "left_anti").unionByName(known.where("source_event_id IS NULL"))
