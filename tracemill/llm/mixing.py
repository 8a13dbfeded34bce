"""Mixing sources: temperature weights, realised as budgeted block permutations.

A source's weight is its share of the tokens to a power t, normalised: all are
equal at 0, as they come at 1, and large ones gain beyond. Entropy falls as t
rises; the largest repetition falls up to 1 and rises from there. So t is
bisected: the smallest t that keeps every source within the repetition limit and
the entropy within its target, bracketed upwards from 1 where sources are so
balanced that 1 exceeds the target. Where the limit is reached first, t is the
largest within it, and where no t meets the target (as the largest sources are
equal), t is 1; a warning says so. More tokens than the limit allows for all
sources together are an error. A source with quota q and T tokens is taken q // T times whole, and
then in part: its blocks in an order drawn for that pass, documents of the
block at the boundary likewise, as long as the quota is not exceeded. So a
document's fate depends on its own hashes and a few numbers for its source.
Every copy of a document that is taken has a place between 0 and 1, its place in
its source's sequence of passes as a share of that sequence, so any stretch of
documents in the order of their places holds sources by their weights.

Sources may be many (hosts). What comes to the driver is a histogram of their
tokens with bins of 1/4096 of a value, at most some 200,000 rows whatever the input; a bin
of one source, or of equal ones, is exact. Weights and quotas are columns of a
table of sources. Documents meet it by broadcast up to BROADCAST_SOURCES
sources, beyond by a join that spreads the documents of a large source.

Defined results: null source is a source of its own; null or wordless text has
no tokens, and is taken whenever its place in the order is; rows with the same
doc_id share a fate; an empty table gives no rows; a source without tokens gets
weight 0 and its documents only in whole passes; columns of documents keep
their names and values, and an added column whose name they have gets `_` at its end.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import Scratch, join_spread, only, partitions, tune

SEED = 20250101
#: Target entropy as a share of that of equal weights, and passes over a source.
ENTROPY_SHARE, MAX_PASSES = 0.95, 2.0
#: Bits of a histogram's values, and most sources that are broadcast (some 5 MB).
BIN_BITS, BROADCAST_SOURCES = 12, 50_000


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def temperature_weights(tokens: list[float], budget: float, entropy_share: float, max_passes: float) -> tuple[float, list[float]]:
    """(exponent, weights) of sources with so many tokens."""
    t = temperature(tokens, [1] * len(tokens), budget, entropy_share, max_passes)
    if not any(x > 0 for x in tokens):
        return t, [0.0] * len(tokens)
    raw = [(x / max(tokens)) ** t if x > 0 else 0.0 for x in tokens]
    norm = math.fsum(raw)
    return t, [r / norm for r in raw]


def temperature(tokens: list[float], counts: list[int], budget: float, entropy_share: float, max_passes: float) -> float:
    """The exponent for `counts` sources of `tokens` each."""
    live = [(x, k) for x, k in zip(tokens, counts) if x > 0]
    if not live:
        return 1.0
    total, sources = math.fsum(x * k for x, k in live), sum(k for _, k in live)
    if budget > max_passes * total * (1 + 1e-12):
        raise ValueError(f"a budget of {budget:.0f} tokens takes {budget / total:.3f} passes over all sources, more than the limit of {max_passes}")
    top = max(x for x, _ in live)
    tops = sum(k for x, k in live if x == top)
    target = entropy_share * math.log(sources) if sources > 1 else 0.0

    def weights(t: float) -> list[float]:
        raw = [(x / top) ** t for x, _ in live]
        norm = math.fsum(r * k for r, (_, k) in zip(raw, live))
        return [r / norm for r in raw]

    def entropy(w: list[float]) -> float:
        return -math.fsum(k * x * math.log(x) for x, (_, k) in zip(w, live) if x > 0)

    def repeats(w: list[float]) -> bool:
        return max(x * budget / n for x, (n, _) in zip(w, live)) > max_passes

    def bisect(low: float, high: float, upper: Callable[[list[float]], bool]) -> tuple[float, float]:
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if upper(weights(middle)) else (middle, high)
        return low, high

    fits = lambda w: entropy(w) <= target and not repeats(w)
    if fits(weights(0.0)):
        return 0.0
    if entropy(weights(1.0)) <= target:
        return bisect(0.0, 1.0, fits)[1]
    if tops > 1 and math.log(tops) >= target:
        warnings.warn(f"the largest sources are equal: no exponent has an entropy of {target:.4f}; sources keep their natural shares", stacklevel=3)
        return 1.0
    # Beyond 1, both ends hold for all larger exponents once they hold.
    ends = lambda w: entropy(w) <= target or repeats(w)
    high = 2.0
    while not ends(weights(high)):
        high *= 2
    low, high = bisect(high / 2, high, ends)
    if not repeats(weights(high)):
        return high
    warnings.warn(f"at {max_passes} passes over the largest source the entropy is {entropy(weights(low)):.4f}, above its target of {target:.4f}", stacklevel=3)
    return low


def _key(docs: DataFrame) -> Column:
    """The source, with null told from every name."""
    return F.when(docs["source"].isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), docs["source"]))


def _block(doc_id: Column, n_blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), doc_id), n_blocks)


def _block_key(src: Column, block: Column, turn: Column) -> Column:
    return F.xxhash64(F.lit(SEED + 1), src, block, turn)


def _doc_key(doc_id: Column, turn: Column) -> Column:
    return F.xxhash64(F.lit(SEED + 2), doc_id, turn)


def source_histogram(stats: DataFrame) -> DataFrame:
    """(tokens, sources, most): mean tokens of a bin's sources, their number, and the most tokens of one."""
    shift = F.greatest(F.floor(F.log2(F.col("t").cast("double"))) - BIN_BITS, F.lit(0)).cast("int")
    bins = stats.where("t > 0").withColumn("shift", shift).groupBy("shift", F.expr("shiftright(t, shift)").alias("bin"))
    return bins.agg((F.sum("t") / F.count("*")).alias("tokens"), F.count("*").alias("sources"), F.max("t").alias("most"))


def _with_plan(rows: DataFrame, plan: DataFrame, few: bool, salt: Column) -> DataFrame:
    """rows with the columns of their source's plan."""
    if few:
        return rows.join(F.broadcast(plan.drop("n")), "src")
    return join_spread(rows, plan, ["src"], "n", salt)


def source_plan(
    docs: DataFrame,
    scratch: Scratch,
    budget_ratio: float = 1.0,
    entropy_share: float = ENTROPY_SHARE,
    max_passes: float = MAX_PASSES,
) -> DataFrame:
    """One row per source: weight, whole passes and where the partial pass ends.

    The partial pass takes blocks before block_key, and of that block the
    documents up to doc_key.
    """
    d = only(docs, "doc_id", "source", "text")
    narrow = scratch.keep(d.select("doc_id", _key(d).alias("src"), word_count(d["text"]).alias("n_tokens")))
    stats = scratch.keep(narrow.groupBy("src").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")))
    sources, total = stats.agg(F.count("*"), F.coalesce(F.sum("t"), F.lit(0))).first()
    budget = budget_ratio * total
    bins = sorted(source_histogram(stats).collect())  # a bounded number of bins
    tokens, counts = [float(b.tokens) for b in bins], [b.sources for b in bins]
    exponent = temperature(tokens, counts, budget, entropy_share, max_passes)
    top = float(max((b.most for b in bins), default=1))
    norm = math.fsum(k * (x / top) ** exponent for x, k in zip(tokens, counts)) or 1.0
    weight = F.when(F.col("t") > 0, F.pow(F.col("t") / F.lit(top), F.lit(exponent)) / F.lit(norm)).otherwise(0.0)
    quota = F.floor(F.col("weight") * F.lit(budget) + F.lit(1e-6))
    plan = stats.withColumn("weight", weight).withColumn("quota", quota).withColumn("passes", F.when(F.col("t") > 0, F.expr("quota div t")).otherwise(0).cast("long"))
    plan = plan.select("src", "n", "weight", "passes", (F.col("quota") - F.col("passes") * F.col("t")).cast("long").alias("rest"), F.greatest(F.floor(F.sqrt("n")), F.lit(1)).cast("long").alias("n_blocks"))
    few = sources <= BROADCAST_SOURCES
    # Blocks and their documents are about the square root of the source each.
    of = _with_plan(narrow, plan, few, F.col("doc_id")).select(
        "src", "n_tokens", "rest", _block_key(F.col("src"), _block(F.col("doc_id"), F.col("n_blocks")), F.col("passes")).alias("bk"), _doc_key(F.col("doc_id"), F.col("passes")).alias("dk")
    )
    running = lambda part, key: W.Window.partitionBy(*part).orderBy(key).rangeBetween(W.Window.unboundedPreceding, 0)
    blocks = of.groupBy("src", "bk").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    blocks = blocks.withColumn("upto", F.sum("t").over(running(["src"], "bk")))
    edge = blocks.where("upto > rest").groupBy("src").agg(F.min_by(F.struct("bk", (F.col("rest") - F.col("upto") + F.col("t")).alias("room")), "bk").alias("e"))
    edge = scratch.keep(edge.select("src", F.col("e.bk").alias("block_key"), F.col("e.room").alias("room"), F.lit(1).alias("n")))
    inside = _with_plan(of, edge, few, F.col("dk")).where("bk = block_key").groupBy("src", "room", "dk").agg(F.sum("n_tokens").alias("t"))
    inside = inside.withColumn("upto", F.sum("t").over(running(["src"], "dk")))
    last = inside.where("upto <= room").groupBy("src").agg(F.max("dk").alias("doc_key"))
    kept = scratch.keep(plan.join(edge.select("src", "block_key"), "src", "left").join(last, "src", "left"))
    scratch.drop(narrow, edge, stats)
    return kept


def _free(name: str, taken: set[str]) -> str:
    """The name, with `_` at its end as long as it is taken."""
    while name.lower() in taken:
        name += "_"
    return name


def _share(key: Column) -> Column:
    """A hash as a number from 0 to 1."""
    return key.cast("double") / 2.0**64 + 0.5


#: Columns that `realise` adds.
ADDED = ("weight", "turn", "block", "mix_key", "mix_doc_key", "mix_at")


def realise(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """documents with a row for each time that a document is taken.

    Adds weight, turn (0 for the first pass), block (its order in the pass is
    that of the hash mix_key, ties by mix_doc_key) and mix_at, the place in the mixture.
    """
    few = plan.count() <= BROADCAST_SOURCES
    taken = {c.lower() for c in docs.columns}
    shown = {c: _free(c, taken) for c in ADDED}
    inner = {c: _free(f"mix_plan_{c}", taken) for c in (*plan.columns, "times")}
    p = {c: F.col(inner[c]) for c in inner}
    renamed = plan.select(*[F.col(c).alias(inner[c]) for c in plan.columns])
    d = docs.withColumn(inner["src"], _key(docs))
    d = d.join(F.broadcast(renamed), inner["src"]) if few else join_spread(d, renamed, [inner["src"]], inner["n"], F.col("doc_id"))
    block = _block(F.col("doc_id"), p["n_blocks"])
    bk, dk = _block_key(p["src"], block, p["passes"]), _doc_key(F.col("doc_id"), p["passes"])
    part = p["block_key"].isNotNull() & ((bk < p["block_key"]) | ((bk == p["block_key"]) & F.coalesce(dk <= p["doc_key"], F.lit(False))))
    d = d.withColumn(inner["times"], p["passes"] + part.cast("long")).where(p["times"] > 0)
    d = d.withColumn(shown["turn"], F.explode(F.sequence(F.lit(0).cast("long"), p["times"] - 1)))
    turn = F.col(shown["turn"])
    key = _block_key(p["src"], block, turn)
    span = p["passes"] + F.coalesce(_share(p["block_key"]), F.lit(0.0))
    at = F.least((turn + _share(key)) / F.greatest(span, F.lit(1e-9)), F.lit(1.0))
    return d.select(
        *[F.col(f"`{c}`") for c in docs.columns], p["weight"].alias(shown["weight"]), turn, block.alias(shown["block"]),
        key.alias(shown["mix_key"]), _doc_key(F.col("doc_id"), turn).alias(shown["mix_doc_key"]), at.alias(shown["mix_at"]),
    )


def mix(docs: DataFrame, scratch: Scratch, **targets: float) -> DataFrame:
    """documents (their own columns first) mixed to the target weights."""
    return realise(docs, source_plan(docs, scratch, **targets))


def mixture(docs: DataFrame, scratch: Scratch, **targets: float) -> DataFrame:
    """documents, with no other columns, mixed to the target weights and in the order of the mixture.

    The order is that of partitions and of the rows within them, as written files keep it.
    """
    mixed = mix(docs, scratch, **targets)
    n = len(docs.columns)
    at = lambda c: F.col(mixed.columns[n + ADDED.index(c)])
    order = [at("mix_at"), at("mix_key"), at("mix_doc_key")]
    return mixed.repartitionByRange(partitions(scratch.spark), *order).sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "source", "text")
    plan = source_plan(docs, Scratch(tune(spark), "mixing"))
    taken = realise(docs.select("doc_id", "source", word_count(docs["text"]).alias("n_tokens")), plan)
    return taken.select("doc_id", "source", "n_tokens", *ADDED)
