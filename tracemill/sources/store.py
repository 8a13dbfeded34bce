"""Stored tables of one root folder, partitioned by tenant and process.

Tables that pile up (events, raw rows, metrics, reports) are appended to. Tables
that are replaced keep versions of each process (see `versions`), so a reader never
meets a part of one, and what two users decide at once is both kept. Events
are stored by day, with the first and the last day of each batch's cases beside
them, so a window of time reads the days of its cases only (see `window`); and with
their identities, so a batch meets only those stored that it can repeat (see
`identities`).
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.eventlog import EventLog
from .files import Mapping, new_events, normalize_events, rejected_rows, with_identity
from .identities import LOOKUP_ROWS, Identities
from .tables import CANONICAL, conform
from .versions import ATTEMPTS, Conflict, Versions

FINDING_STATES = ("open", "acknowledged", "in_progress", "resolved", "dismissed")
OPPORTUNITY_STATES = ("proposed", "planned", "in_progress", "done", "rejected")
#: The key and the states of the tables in which users decide.
STATES = {"findings": ("fingerprint", FINDING_STATES), "opportunities": ("activity", OPPORTUNITY_STATES)}
#: Most events of a batch.
BATCH_ROWS = 10_000
#: Errors of an import that are kept.
ERRORS = 200


class Store:
    """Append, replace and read tables of a tenant."""

    def __init__(self, spark: SparkSession, root: str, tenant_id: str) -> None:
        self.spark, self.root, self.tenant_id = spark, root.rstrip("/"), tenant_id

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _folder(self, path: str):
        """(file system, path) of a folder."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, table: str) -> bool:
        fs, p = self._folder(self.path(table))
        return fs.exists(p)

    def _escaped(self, name: str) -> str:
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)

    def _numbers(self, table: str) -> str:
        return f"{self.root}/_versions/{table}/tenant_id={self._escaped(self.tenant_id)}"

    def versions(self, table: str, process_id: str) -> Versions:
        """The versions of a process's rows in a table that is replaced."""
        process = f"process_id={self._escaped(process_id)}"
        return Versions(self.spark, f"{self.path(table)}/tenant_id={self._escaped(self.tenant_id)}/{process}", f"{self._numbers(table)}/{process}")

    def _replaced(self, table: str) -> bool:
        fs, p = self._folder(f"{self.root}/_versions/{table}")
        return fs.exists(p)

    def _read_versions(self, table: str, process_id: str | None) -> DataFrame:
        """The present rows of one process, or of all of the tenant's."""
        names = [process_id]
        fs, p = self._folder(self._numbers(table))
        if process_id is None:
            unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
            names = [unescape(s.getPath().getName().removeprefix("process_id=")) for s in fs.listStatus(p)] if fs.exists(p) else []
        out, like = None, None
        for name in names:
            v = self.versions(table, name)
            content = v.current()[1]
            if content is not None:
                df = self._tagged(v.read(content), name)
                out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        if out is None:  # no version of this tenant: another's tells the columns
            fs, p = self._folder(f"{self.root}/_versions/{table}")
            for tenant in fs.listStatus(p):
                for process in fs.listStatus(tenant.getPath()):
                    like = like or Versions(self.spark, "", process.getPath().toString()).current()[1]
            out = self._tagged(self.spark.createDataFrame([], T.StructType.fromJson(like["schema"]) if like else T.StructType()), "")
        return out

    def read(self, table: str, process_id: str | None = None) -> DataFrame:
        """Rows of this tenant; tenant and process prune partitions.

        Both are read as text: by themselves, the tenants 1 and 01 would become one number.
        """
        if self._replaced(table):
            return self._read_versions(table, process_id)
        return self._read(table, process_id).drop("day")

    def _read(self, table: str, process_id: str | None) -> DataFrame:
        """Rows of a table that is appended to, with the day where it is stored by day."""
        found = self.spark.read.parquet(self.path(table)).schema
        schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in ("tenant_id", "process_id", "day") else f.dataType) for f in found])
        df = self.spark.read.schema(schema).parquet(self.path(table)).where(F.col("tenant_id") == self.tenant_id)
        return df if process_id is None else df.where(F.col("process_id") == process_id)

    def append(self, table: str, df: DataFrame, process_id: str) -> None:
        """Raw rows, metric snapshots, reports, audit rows."""
        self._tagged(df, process_id).write.mode("append").partitionBy("tenant_id", "process_id").parquet(self.path(table))

    def replace(self, table: str, df: DataFrame, process_id: str) -> None:
        """This process's rows anew, or none; those of others stay."""
        self.versions(table, process_id).write(df)

    def update(self, table: str, process_id: str, change: Callable[[DataFrame | None], DataFrame]) -> None:
        """Replaces the process's rows by what `change` makes of them (None: there are none yet).

        Where another writer comes first, `change` starts again from what it wrote.
        """
        v = self.versions(table, process_id)
        for _ in range(ATTEMPTS):
            number, content = v.current()
            try:
                v.write(change(None if content is None else v.read(content)), number)
                return
            except Conflict:
                time.sleep(random.uniform(0.0, 0.2))
        raise Conflict(f"{table}: others came first {ATTEMPTS} times")

    def insert_events(self, incoming: DataFrame, process_id: str, default_system: str = "api") -> tuple[int, int]:
        """(inserted, duplicates): events whose identity the tenant has not yet."""
        incoming = with_identity(incoming, default_system)
        total = incoming.count()
        ids = self.identities()
        if self.exists("events") and (ids.broken() or not ids.exists()):
            ids.rebuild(self.read("events"))
        if not ids.exists():
            stored = incoming.select("source_system", "source_event_id").limit(0)
        elif total <= LOOKUP_ROWS:
            stored = ids.stored(incoming)
        else:  # most of what is stored is met anyway
            stored = self.read("events").select("source_system", "source_event_id")
        fresh = new_events(incoming, stored, default_system).checkpoint()
        n = fresh.count()
        if not n:
            return 0, total
        note = ids.begin()
        rows = conform(fresh).withColumn("day", F.date_format("occurred_at", "yyyy-MM-dd"))
        self._tagged(rows, process_id).hint("rebalance", "day").write.mode("append").partitionBy("tenant_id", "process_id", "day").parquet(self.path("events"))
        days = rows.groupBy("case_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
        self.append("case_days", days, process_id)
        ids.add(fresh)
        ids.end(note)
        return n, total - n

    def identities(self) -> Identities:
        return Identities(self.spark, self.root, f"tenant_id={self._escaped(self.tenant_id)}")

    def between(self, process_id: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """Events of the process that occur in [start, end); the days outside are not read."""
        rows = self._read("events", process_id)
        time = lambda t: F.lit(t).cast("timestamp_ntz")
        if start is not None:
            rows = rows.where((F.col("day") >= F.date_format(time(start), "yyyy-MM-dd")) & (F.col("occurred_at") >= time(start)))
        if end is not None:
            rows = rows.where((F.col("day") <= F.date_format(time(end), "yyyy-MM-dd")) & (F.col("occurred_at") < time(end)))
        return rows.drop("day")

    def window(self, process_id: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """Events of the process's cases that start in [start, end), each with all its events.

        The first and the last days of cases tell which cases can start in the window, and
        the days between their ends are those whose files are read.
        """
        if start is None and end is None:
            return self.read("events", process_id)
        day = lambda t: F.date_format(F.lit(t).cast("timestamp_ntz"), "yyyy-MM-dd")
        spans = self.read("case_days", process_id).groupBy("case_id").agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))
        if start is not None:
            spans = spans.where(F.col("first_day") >= day(start))
        if end is not None:
            spans = spans.where(F.col("first_day") <= day(end))
        first, last = spans.agg(F.min("first_day"), F.max("last_day")).first()
        inside = F.col("day").between(first, last) if first is not None else F.lit(False)
        rows = self._read("events", process_id).where(inside).drop("day").join(spans.select("case_id"), "case_id", "left_semi")
        return EventLog(rows.select(*self.read("events").columns)).between(start, end).events

    def insert_batch(self, rows: list[dict], process_id: str, default_system: str = "api") -> tuple[int, int]:
        """As insert_events, of 1 to BATCH_ROWS canonical events at once."""
        if not 1 <= len(rows) <= BATCH_ROWS:
            raise ValueError(f"a batch has 1 to {BATCH_ROWS} events, not {len(rows)}")
        schema = T.StructType([f for f in CANONICAL if f.name not in ("tenant_id", "process_id")]).add("row_index", T.LongType())
        full = [{f.name: r.get(f.name) for f in schema} | {"row_index": i} for i, r in enumerate(rows)]
        return self.insert_events(self.spark.createDataFrame(full, schema), process_id, default_system)

    def set_status(self, table: str, process_id: str, key: str, status: str) -> None:
        """What a user decides on a finding (by fingerprint) or an opportunity (by activity)."""
        name, states = STATES[table]
        if status not in states:
            raise ValueError(f"{status!r} is none of {', '.join(states)}")

        def decide(rows: DataFrame | None) -> DataFrame:
            if rows is None or rows.where(F.col(name) == key).isEmpty():
                raise KeyError(f"{table} has no {name} {key!r}")
            return rows.withColumn("status", F.when(F.col(name) == key, F.lit(status)).otherwise(F.col("status")))

        self.update(table, process_id, decide)

    def create_process(self, name: str) -> str:
        """The id of the tenant's process of this name, which is made where there is none."""
        if not name.strip():
            raise ValueError("a process needs a name")
        found = self.read("processes").where(F.col("name") == name.strip()).select("process_id").first() if self.exists("processes") else None
        if found:
            return found[0]
        process_id = uuid.uuid4().hex
        self.append("processes", self.spark.createDataFrame([(name.strip(),)], "name string").withColumn("created_at", F.current_timestamp()), process_id)
        return process_id

    def import_rows(self, rows: DataFrame, mapping: Mapping, process_id: str) -> dict:
        """Raw rows as they came, then their events; what was accepted, known already and rejected.

        The raw rows stay under an import_id, from which `replay` maps them again.
        """
        import_id = uuid.uuid4().hex
        columns = [c for c in rows.columns if c != "row_index"]
        payload = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(f"`{c}`").cast("string") for c in columns]))
        self.append("raw_rows", rows.select(F.lit(import_id).alias("import_id"), "row_index", payload.alias("payload"), F.current_timestamp().alias("received_at")), process_id)
        return self._map_rows(rows, mapping, process_id, import_id)

    def raw_rows(self, process_id: str, import_id: str) -> DataFrame:
        """The rows of an import with the columns that they had."""
        raw = self.read("raw_rows", process_id).where(F.col("import_id") == import_id)
        first = raw.select(F.map_keys("payload")).first()  # all rows of an import have the same columns
        return raw.select("row_index", *[F.col("payload")[c].alias(c) for c in (first[0] if first else [])])

    def replay(self, process_id: str, import_id: str, mapping: Mapping) -> dict:
        """Maps the rows of an import again; events that are stored already stay."""
        return self._map_rows(self.raw_rows(process_id, import_id), mapping, process_id, import_id)

    def import_status(self, process_id: str, import_id: str) -> dict | None:
        """What the last mapping of an import did, with its first errors by row."""
        runs = self.read("imports", process_id).where(F.col("import_id") == import_id).orderBy(F.desc("mapped_at")).limit(1) if self.exists("imports") else None
        found = runs.select("import_id", "status", "accepted", "duplicates", "rejected", "errors").first() if runs is not None else None
        return found.asDict(True) if found else None

    def _map_rows(self, rows: DataFrame, mapping: Mapping, process_id: str, import_id: str) -> dict:
        accepted, duplicates = self.insert_events(normalize_events(rows, mapping), process_id, mapping.source_system)
        bad = rejected_rows(rows, mapping)
        errors = bad.orderBy("row_index").limit(ERRORS).agg(F.sort_array(F.collect_list(F.struct("row_index", "problems"))).alias("errors"))
        done = bad.agg(F.count("*").alias("rejected")).crossJoin(F.broadcast(errors))  # one row each
        done = done.select(F.lit(import_id).alias("import_id"), F.lit("mapped").alias("status"), F.lit(accepted).cast("long").alias("accepted"), F.lit(duplicates).cast("long").alias("duplicates"), "rejected", "errors", F.current_timestamp().alias("mapped_at"))
        self.append("imports", done, process_id)
        return self.import_status(process_id, import_id)

    def _tagged(self, df: DataFrame, process_id: str) -> DataFrame:
        return df.withColumn("tenant_id", F.lit(self.tenant_id)).withColumn("process_id", F.lit(process_id))
