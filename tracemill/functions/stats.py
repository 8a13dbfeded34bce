"""Column helpers: exact quantiles, fences, time in microseconds, scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

HOUR = 3600.0


#: Added before cutting to whole microseconds, so that neither whole nor half ones
#: nor usual fractions of quantiles are near the cut.
_NUDGE = 0.1234567


def seconds(us: Column | str) -> Column:
    """Seconds, cut to the microsecond, of a number of microseconds.

    Beyond the whole numbers that a double holds there is nothing to cut.
    """
    x = F.col(us) if isinstance(us, str) else us
    return F.when(F.abs(x) < 9e15, F.floor(x + _NUDGE) / 1e6).otherwise(x.cast("double") / 1e6)


def micros(ts: str) -> Column:
    """Microseconds since the epoch of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(`{ts}` AS TIMESTAMP_NTZ))")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or there is nothing."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


#: What microseconds are added up in: those of many rows are beyond a long.
WIDE = "decimal(20,0)"


def total(c: str) -> Column:
    """The exact sum of a column of whole numbers, then a double."""
    return F.sum(F.col(c).cast(WIDE)).cast("double")


#: Ranges of values for each doubling: some 10^5 ranges from a microsecond to centuries.
RANGES = 4096


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float | Column]], count: str | None = None) -> DataFrame:
    """One row of exact linearly interpolated quantiles; null where there are no values.

    wanted: name -> (column of whole numbers, quantile, or a place from 0 in terms of
    their number n); count: a name for the number of values of the first column. Equal values are counted first. The counts of
    ranges of values, of which there is a bounded number, tell the range that holds a
    quantile's neighbours, and only the values of those ranges are put in order.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    series = [F.struct(F.lit(i).alias("s"), F.col(c).cast("long").alias("v")) for i, c in enumerate(columns)]
    values = df.select(F.explode(F.array(*series)).alias("x")).select("x.s", "x.v").where("v IS NOT NULL")
    counts = values.groupBy("s", "v").agg(F.count("*").alias("c")).withColumn("range", value_range())
    place = W.partitionBy("s")
    below = F.sum("k").over(place.orderBy("range").rowsBetween(W.unboundedPreceding, 0)) - F.col("k")
    ranges = counts.groupBy("s", "range").agg(F.sum("c").alias("k")).select("s", "range", "k", below.alias("below"), F.sum("k").over(place).alias("n"))
    at = lambda q: q.cast("double") if isinstance(q, Column) else F.lit(float(q)) * (F.col("n") - 1)
    ends = [F.when(F.col("s") == columns.index(c), end(at(q))) for c, q in wanted.values() for end in (F.floor, F.ceil)]
    held = F.filter(F.array_distinct(F.array(*ends)), lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("k")))
    picked = ranges.select("s", "range", "below", "n", F.explode(held).alias("rank"))  # two rows a quantile at most
    through = F.col("below") + F.sum("c").over(W.partitionBy("s", "rank").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    found = counts.join(F.broadcast(picked), ["s", "range"]).withColumn("through", through).where("rank < through AND rank >= through - c")

    def one(c: str, q: float) -> Column:
        mine, p = F.col("s") == columns.index(c), at(q)
        low, high = (F.max(F.when(mine & (F.col("rank") == end(p)), F.col("v"))) for end in (F.floor, F.ceil))
        part = F.max(F.when(mine, p - F.floor(p)))
        return F.when(low == high, low.cast("double")).otherwise((1 - part) * low + part * high)

    extra = [F.coalesce(F.max(F.when(F.col("s") == 0, F.col("n"))), F.lit(0)).alias(count)] if count else []
    return found.agg(*[one(c, q).alias(name) for name, (c, q) in wanted.items()], *extra)


def value_range(v: str = "v") -> Column:
    """The range of values that a whole number falls in: a bounded number of them, in order."""
    return F.signum(v) * F.floor(F.log2(1 + F.abs(F.col(v).cast("double"))) * RANGES)


def measures_by(df: DataFrame, keys: list[str], column: str, wanted: dict[str, float], sums: dict[str, Column], total: str | None = None) -> DataFrame:
    """A row per group: exact quantiles of a column of whole numbers, and sums; 0 for quantiles of no values.

    total: a name for the sum of the column itself, which may be beyond a long: a double, null where there are no values.

    All groups at once go the way of `quantiles`: equal values of a group are counted,
    and summed with, before a shuffle by (group, value); counts of ranges, of which a
    group has a bounded number, tell those that hold a quantile's neighbours, and only
    their values are put in order. So no task receives the values of a group, and
    one pass over the rows serves quantiles and sums alike.
    """
    counted = df.groupBy(*keys, F.col(column).cast("long").alias("q_v")).agg(F.count(column).alias("q_c"), *[F.sum(x).alias(name) for name, x in sums.items()]).withColumn("q_range", value_range("q_v")).repartition(*keys, "q_range")  # serves the ranges and the join
    own = [F.sum(F.col("q_v").cast(WIDE) * F.col("q_c")).alias(total)] if total else []
    ranges = counted.groupBy(*keys, "q_range").agg(F.sum("q_c").alias("q_k"), *[F.sum(name).alias(name) for name in sums], *own)
    carried = [*sums, total] if total else [*sums]
    group = W.partitionBy(*keys)
    below = F.sum("q_k").over(group.orderBy("q_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("q_k")
    ranges = ranges.select(*keys, "q_range", "q_k", below.alias("q_below"), F.sum("q_k").over(group).alias("q_n"), *[F.sum(name).over(group).alias(name) for name in carried], F.row_number().over(group.orderBy("q_range")).alias("q_place"))
    at = {name: F.lit(float(q)) * (F.col("q_n") - 1) for name, q in wanted.items()}
    ends = F.array_distinct(F.array(*[end(p) for p in at.values() for end in (F.floor, F.ceil)]))
    held = F.filter(ends, lambda r: (r >= F.col("q_below")) & (r < F.col("q_below") + F.col("q_k")))
    picked = ranges.select(*keys, "q_range", "q_below", "q_n", *carried, "q_place", F.explode_outer(held).alias("q_rank")).where("q_rank IS NOT NULL OR (q_n = 0 AND q_place = 1)")
    same = F.lit(True)
    for c in [*keys, "q_range"]:
        same = same & F.col(f"p.`{c}`").eqNullSafe(F.col(f"c.`{c}`"))
    # One exchange by group serves the window and the sums; a group's rows are those of a few ranges.
    met = picked.alias("p").join(counted.alias("c"), same).select(*[F.col(f"p.`{c}`") for c in [*keys, "q_below", "q_n", *carried, "q_rank"]], "c.q_v", "c.q_c", *[F.col(f"c.`{c}`").alias(f"q_own_{c}") for c in sums]).repartition(*keys)
    through = F.col("q_below") + F.sum("q_c").over(W.partitionBy(*keys, "q_rank").orderBy("q_v").rowsBetween(W.unboundedPreceding, 0))
    found = met.withColumn("q_through", through).where("q_rank IS NULL OR (q_rank < q_through AND q_rank >= q_through - q_c)")

    def one(p: Column) -> Column:
        low, high = (F.max(F.when(F.col("q_rank") == end(p), F.col("q_v"))) for end in (F.floor, F.ceil))
        part = F.max(p - F.floor(p))
        return F.coalesce(F.when(low == high, low.cast("double")).otherwise((1 - part) * low + part * high), F.lit(0.0))

    # Where a group's sum is null, so are those of its values. With them both readers of the counts read the same
    # columns, so Spark counts once; without, it would drop them for one reader and go through the rows twice.
    whole = [F.coalesce(F.max(name), F.max(f"q_own_{name}")).alias(name) for name in sums] + ([F.max(total).cast("double").alias(total)] if total else [])
    return found.groupBy(*keys).agg(*[one(p).alias(name) for name, p in at.items()], *whole)


#: What fences are made of, beside the number n of values.
QUARTILES = {"q1": 0.25, "q2": 0.5, "q3": 0.75}


def quartiles(df: DataFrame, column: str) -> DataFrame:
    """One row (q1, q2, q3, n)."""
    return quantiles(df, {name: (column, q) for name, q in QUARTILES.items()}, "n")


def fence(side: int, factor: float = 1.5) -> Column:
    """Tukey's upper (1) or lower (-1) fence of quartiles; infinite for fewer than four values."""
    end = F.col("q3") if side > 0 else F.col("q1")
    return F.when(F.col("n") < 4, side * float("inf")).otherwise(end + side * factor * (F.col("q3") - F.col("q1")))


def severity(hours: Column) -> Column:
    return F.when(hours >= 80, "critical").when(hours >= 20, "high").when(hours >= 5, "medium").otherwise("low")


def impact(hours: Column, cases: Column, total: Column) -> Column:
    """0 to 100: mostly saving in hours (logarithmic up to 2000), partly share of cases."""
    time = F.when(hours > 0, F.least(F.log1p(hours) / F.log1p(F.lit(2000.0)), F.lit(1.0))).otherwise(0.0)
    share = F.least(ratio(cases, total), F.lit(1.0))
    return F.round(100 * (0.7 * time + 0.3 * share), 2)


def confidence(n: Column, per: float) -> Column:
    return F.when(n > 0, F.round(F.least(0.5 + n / per, F.lit(0.95)), 3)).otherwise(0.0)


def monthly_hours(us: Column, days: Column) -> Column:
    """Microseconds within a window of days, as hours in 30 days."""
    return F.when(days > 0, us / 1e6 / days * 30 / HOUR).otherwise(0.0)
