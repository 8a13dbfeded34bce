"""Event logs from the driver's tables, in the canonical schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

CANONICAL = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("process_id", T.StringType()),
        T.StructField("source_system", T.StringType()),
        T.StructField("source_event_id", T.StringType()),
        T.StructField("case_id", T.StringType()),
        T.StructField("activity", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("occurred_at", T.TimestampNTZType()),
        T.StructField("completed_at", T.TimestampNTZType()),
        T.StructField("actor_id", T.StringType()),
        T.StructField("actor_type", T.StringType()),
        T.StructField("team", T.StringType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("object_type", T.StringType()),
        T.StructField("object_id", T.StringType()),
        T.StructField("status_before", T.StringType()),
        T.StructField("status_after", T.StringType()),
        T.StructField("monetary_value", T.DoubleType()),
        T.StructField("is_manual", T.BooleanType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def conform(df: DataFrame) -> DataFrame:
    """The canonical columns in order; those that are missing are null or default."""
    default = {"tenant_id": F.lit("main"), "source_system": F.lit("upload"), "event_type": F.lit("activity"), "is_manual": F.lit(False), "metadata": F.create_map().cast("map<string,string>")}
    cols = []
    for f in CANONICAL:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        cols.append((F.coalesce(c, default[f.name]) if f.name in default else c).alias(f.name))
    return df.select(*cols)


def read_events(spark: SparkSession, path: str, tenant_id: str, process_id: str | None = None) -> DataFrame:
    """Stored canonical events of a tenant; the predicates prune partitions."""
    df = spark.read.parquet(path).where(F.col("tenant_id") == tenant_id)
    return df if process_id is None else df.where(F.col("process_id") == process_id)


def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("occurred_at"), "user_id", F.col("event_type").alias("activity"), "value")
    ms = F.round(F.col("value") * 1000).cast("long")
    kind = F.col("activity")
    return e.select(
        "user_id", "activity", "occurred_at", ms.alias("duration_ms"), (F.col("occurred_at") + F.make_dt_interval(secs=ms.cast("decimal(18,6)") / 1000)).alias("completed_at"),
        F.when(kind.isin("click", "view"), "web").when(kind == "signup", "growth").when(kind == "purchase", "sales").alias("team"), F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("actor_id"),
        kind.isin("signup", "error").alias("is_manual"), F.when(kind == "purchase", F.col("value")).alias("monetary_value"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("source_system"),
        F.col("event_id").cast("string").alias("source_event_id"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("process_id"),
    )


def day_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case is a user's day."""
    df = _clicks(spark, sf_dir)
    return conform(df.withColumn("case_id", F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("occurred_at", "yyyy-MM-dd"))))


def session_log(spark: SparkSession, sf_dir: str, gap_hours: int = 6) -> DataFrame:
    """A case is a run of a user's events without a pause of gap_hours."""
    df = _clicks(spark, sf_dir)
    by = W.Window.partitionBy("user_id").orderBy("occurred_at", F.col("source_event_id").cast("long"))
    pause = F.col("occurred_at") - F.lag("occurred_at").over(by) > F.expr(f"INTERVAL '{gap_hours}' HOUR")
    df = df.withColumn("new", F.coalesce(pause, F.lit(True)).cast("int")).withColumn("k", F.sum("new").over(by))
    return conform(df.withColumn("case_id", F.concat_ws("-", F.col("user_id").cast("string"), F.col("k").cast("string"))))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case is an order: placed, then a step per line item, from the supplier's nation."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders = read("orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("at"), "o_totalprice", "o_orderpriority")
    placed = orders.select(
        F.col("o_orderkey").cast("string").alias("case_id"), F.lit("placed").alias("activity"), F.col("at").alias("occurred_at"), F.lit("sales").alias("team"), F.col("o_totalprice").alias("monetary_value"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit(":placed")).alias("source_event_id"),
    )
    items = read("lineitem").join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    shipped = items.select(
        F.col("l_orderkey").cast("string").alias("case_id"), F.concat(F.lit("ship_"), "l_returnflag", "l_linestatus").alias("activity"), F.col("l_shipdate").cast("timestamp_ntz").alias("occurred_at"),
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("team"), F.lit(None).cast("double").alias("monetary_value"),
        F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]).alias("source_event_id"),
    )
    return conform(placed.unionByName(shipped))
