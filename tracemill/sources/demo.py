"""An order log made by rule, for tests and first steps.

Every draw is a hash of seed, order and purpose, so any partition makes its own
orders and a log is the same however it is dealt. Planted: hand entry on every
order, a queue before the release of dear orders that grows in the last part of
the window, corrections of bills, and a rare complaint after which goods go out again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .tables import conform

CSV_COLUMNS = {
    "order_id": "case_id", "step": "activity", "timestamp": "occurred_at", "finished_at": "completed_at", "handled_by": "actor_id", "department": "team", "system": "source_system", "amount": "monetary_value",
}
HAND_ENTRY = "keyed in"


def _draw(seed: int, purpose: str, low: float, high: float) -> Column:
    share = F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), F.col("order")), F.lit(1_000_000)) / 1_000_000.0
    return low + (high - low) * share


def order_log(spark: SparkSession, cases: int = 420, seed: int = 7) -> DataFrame:
    """Canonical events of this many orders, one every two hours."""
    o = spark.range(cases).withColumnRenamed("id", "order")
    o = o.withColumn("kind", _draw(seed, "kind", 0, 1)).withColumn("segment", F.when(F.col("kind") < 0.6, "retail").when(F.col("kind") < 0.9, "b2b").otherwise("key_account"))
    spread = _draw(seed, "value", 0, 1)
    o = o.withColumn("value", F.round(F.when(F.col("segment") == "retail", 40 + 300 * spread).when(F.col("segment") == "b2b", 300 + 3500 * spread).otherwise(4000 + 20_000 * spread), 2))
    dear = F.col("value") > 2000
    late = F.col("order") > 0.55 * cases
    wrong = _draw(seed, "wrong", 0, 1) < 0.18
    complaint = _draw(seed, "complaint", 0, 1) < 0.05

    def step(name: str, team: str, system: str, wait: tuple[float, float], minutes: tuple[float, float], manual: bool = False, when: Column | None = None, times: Column | None = None, again: str = "") -> Column:
        hours = _draw(seed, f"wait {name}{again}", *wait) * (F.lit(1.0) if times is None else times)
        return F.struct(
            F.lit(name).alias("activity"), F.lit(team).alias("team"), F.lit(system).alias("system"), F.lit(manual).alias("manual"), F.floor(hours * 3600).alias("wait_s"),
            F.floor(_draw(seed, f"work {name}{again}", *minutes) * 60).alias("work_s"), (F.lit(True) if when is None else when).alias("happens"),
        )

    path = F.array(
        step("received", "sales", "shop", (0, 0), (1, 1)),
        step(HAND_ENTRY, "back office", "erp", (0.2, 2.5), (6, 11), manual=True),
        step("stock looked up", "warehouse", "erp", (0.1, 1.5), (1, 4)),
        step("paid", "finance", "erp", (0.2, 3), (2, 6)),
        step("release asked", "back office", "mail", (0.3, 2), (3, 6), manual=True, when=dear),
        step("released", "finance", "mail", (7, 20), (3, 6), manual=True, when=dear, times=F.when(late, F.lit(2.0)).otherwise(1.0)),
        step("billed", "finance", "erp", (0.3, 2), (2, 5)),
        step("bill corrected", "back office", "erp", (1, 6), (6, 12), manual=True, when=wrong),
        step("billed", "finance", "erp", (0.5, 3), (2, 5), when=wrong, again=" again"),
        step("packed", "warehouse", "wms", (1, 8), (4, 12)),
        step("sent", "warehouse", "wms", (0.5, 4), (2, 6)),
        step("complaint", "support", "desk", (4, 26), (10, 30), manual=True, when=complaint),
        step("sent", "warehouse", "wms", (6, 30), (2, 6), when=complaint, again=" again"),
        step("arrived", "carrier", "carrier", (12, 48), (1, 3)),
    )
    steps = o.select("order", "segment", "value", F.posexplode(F.filter(path, lambda s: s.happens)).alias("pos", "s"))
    clock = F.sum(F.col("s.wait_s") + F.col("s.work_s")).over(W.Window.partitionBy("order").orderBy("pos"))
    opened = F.col("order") * 7200 + F.floor(_draw(seed, "opened", 0, 5400))
    at = lambda s: F.lit("2026-04-01 07:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=s.cast("decimal(18,6)"))
    case = F.concat(F.lit("ORD-"), (F.col("order") + 10_000).cast("string"))
    done = opened + clock
    return conform(steps.select(
        case.alias("case_id"), F.col("s.activity").alias("activity"), at(done - F.col("s.work_s")).alias("occurred_at"), at(done).alias("completed_at"),
        F.concat(F.col("s.team"), F.lit("_"), (1 + F.pmod(F.xxhash64(F.lit(seed), "order", "pos"), F.lit(4))).cast("string")).alias("actor_id"), F.col("s.team").alias("team"), F.col("s.system").alias("source_system"),
        F.concat_ws("-", case, F.col("pos").cast("string")).alias("source_event_id"), (F.col("s.work_s") * 1000).alias("duration_ms"), F.col("value").alias("monetary_value"), F.col("s.manual").alias("is_manual"),
        F.create_map(F.lit("segment"), F.col("segment")).alias("metadata"),
    ))


def write_csv(events: DataFrame, path: str) -> None:
    """The log as a delimited file with a header, as a user would export it."""
    cols = [(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") if c in ("occurred_at", "completed_at") else F.col(c)).alias(n) for n, c in CSV_COLUMNS.items()]
    events.select(*cols, F.when(F.col("is_manual"), "manual").otherwise("system").alias("channel")).write.mode("overwrite").option("header", True).csv(path)
