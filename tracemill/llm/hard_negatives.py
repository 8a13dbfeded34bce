"""Hard negatives by distributed radix selection over integer scores.

An anchor and one of its positives make a window of scores that a negative may
have. How far a negative lies below the top of its window is a whole number; its
highest digit is counted in a histogram per window in every shard, the sums tell the
bucket in which the kth negative lies, and the next round counts the next digit
within that bucket, until the kth distance is known exactly. Only then are rows
gathered: those nearer than it (fewer than k a window), and of those at it as many
of the smallest ids as are wanted. A shard sends no bucket beyond the one in which
its own kth lies, so no more of a histogram moves than can matter.

Defined results: see `vectors`; rows without a label take no part; an anchor's
own row is no positive of it, rows that repeat its id are; windows of negative
scores are empty; ties go to the smaller id; rows of a result are told
apart by the positive's place, so a repeated positive has a window of its own;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, only, tune
from .topk import Best, add_dense
from .vectors import ROW, Block, meet, pack, scores, shard_count, stated

#: A negative scores at least positive_score - positive_score // FIFTH, and at most as much.
FIFTH = 5
#: Bits of a digit; a histogram of a window has two to the power of them buckets at most.
DIGIT = 8
KEY = [*ROW, "positive_rank"]


def nearest_alike(anchors: Block, shard: Block, k: int) -> pa.RecordBatch:
    """The k best rows of an anchor's label in a shard."""
    best = Best(len(anchors), k)
    for tile in shard.tiles():
        add_dense(best, anchors, tile, (anchors.labels[:, None] == tile.labels) & ~anchors.own(tile))
    return best.rows(anchors).rename_columns([*ROW, "anchor_id", "positive_id", "positive_score"])


def _windows(anchors: Block, k: int) -> list[np.ndarray]:
    """tops, known and wanted of each anchor's windows, as matrices; -1 where an anchor lacks one."""
    lists = {c: anchors.extra.column(c).to_pylist() for c in ("ranks", "tops", "known", "wanted")}
    out = [np.full((len(anchors), k), -1, np.int64) for _ in range(3)]
    for i, ranks in enumerate(lists["ranks"]):
        for matrix, c in zip(out, ("tops", "known", "wanted")):
            matrix[i, np.array(ranks) - 1] = lists[c][i]
    return out


def _inside(anchors: Block, tile: Block, top: np.ndarray):
    """(anchor, window, distance below its top, id) of the negatives of a tile within windows."""
    s = scores(anchors, tile)
    low = np.where(top >= 0, top - top // FIFTH, np.iinfo(np.int64).max).min(1)
    qi, xi = np.nonzero((s >= low[:, None]) & (s <= top.max(1)[:, None]) & (anchors.labels[:, None] != tile.labels))
    s = s[qi, xi]
    for w in range(top.shape[1]):
        t = top[qi, w]
        kept = (t >= 0) & (s <= t)
        kept[kept] = s[kept] >= (t - t // FIFTH)[kept]
        yield w, qi[kept], (t - s)[kept], tile.ids[xi[kept]]


def count_digits(anchors: Block, shard: Block, k: int, shift: int) -> pa.RecordBatch:
    """Histogram rows (chunk, place, positive_rank, bucket, n) of the digit at `shift`, within what is known."""
    top, known, wanted = _windows(anchors, k)
    size = 1 << DIGIT
    counts = np.zeros((len(anchors), k, size), np.int64)
    for tile in shard.tiles():
        for w, qi, far, _ in _inside(anchors, tile, top):
            digit = (far >> shift) - (known[qi, w] << DIGIT)
            kept = (digit >= 0) & (digit < size)
            counts[:, w] += np.bincount(qi[kept] * size + digit[kept], minlength=len(anchors) * size).reshape(len(anchors), size)
    before = np.cumsum(counts, 2) - counts
    qi, w, digit = np.nonzero((counts > 0) & (before < wanted[:, :, None]))
    columns = (anchors.chunk[qi], anchors.place[qi], w + 1, (known[qi, w] << DIGIT) + digit, counts[qi, w, digit])
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*KEY, "bucket", "n"])


def gather(anchors: Block, shard: Block, k: int) -> pa.RecordBatch:
    """Rows (chunk, place, positive_rank, negative_id, negative_score) that can be among a window's first k."""
    top, known, wanted = _windows(anchors, k)
    out = []
    for tile in shard.tiles():
        for w, qi, far, ids in _inside(anchors, tile, top):
            kept = far <= known[qi, w]
            out.append((qi[kept], np.full(kept.sum(), w), far[kept], ids[kept]))
        if sum(len(o[0]) for o in out) > 1 << 18:  # very many at the kth distance
            out = [_fewest(*map(np.concatenate, zip(*out)), known, wanted)]
    qi, w, far, ids = _fewest(*map(np.concatenate, zip(*out)), known, wanted)
    columns = (anchors.chunk[qi], anchors.place[qi], w + 1, ids, top[qi, w] - far)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*KEY, "negative_id", "negative_score"])


def _fewest(qi, w, far, ids, known, wanted):
    """All that are nearer than the kth distance, and of those at it the wanted smallest ids."""
    order = np.lexsort((ids, far, w, qi))
    qi, w, far, ids = qi[order], w[order], far[order], ids[order]
    new = np.concatenate([[True], (qi[1:] != qi[:-1]) | (w[1:] != w[:-1]) | (far[1:] != far[:-1])])[: len(qi)]
    starts = np.flatnonzero(new)
    rank = np.arange(len(qi)) - np.repeat(starts, np.diff(np.append(starts, len(qi))))
    kept = (far < known[qi, w]) | (rank < wanted[qi, w])
    return qi[kept], w[kept], far[kept], ids[kept]


def mine(emb: DataFrame, scratch: Scratch, every: int = 100, positives: int = 5, k: int = 5) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows (vec_id, label, embedding)."""
    chunks = pack(emb.where("label IS NOT NULL"), scratch)
    shards = shard_count(chunks)
    anchors = scratch.keep(stated(chunks, every))
    alike = meet(chunks, anchors, shards, lambda q, shard: nearest_alike(q, shard, positives), "chunk long, place long, anchor_id long, positive_id long, positive_score long")
    best = W.partitionBy(*ROW).orderBy(F.desc("positive_score"), "positive_id")
    alike = alike.withColumn("positive_rank", F.row_number().over(best).cast("long")).where(F.col("positive_rank") <= positives)
    # A window that is open wants its wanted-th nearest negative within bucket `known` of the digits so far.
    state = scratch.keep(alike.withColumns({"known": F.lit(0).cast("long"), "wanted": F.lit(k).cast("long")}))
    width = F.expr(f"positive_score div {FIFTH}")
    widest = max(state.agg(F.max(width)).first()[0] or 0, 0)
    digits = -(-max(widest.bit_length(), 1) // DIGIT)
    closed = None  # windows of fewer than k negatives: all of them qualify
    for shift in range((digits - 1) * DIGIT, -1, -DIGIT):
        counts = meet(chunks, _with_windows(anchors, state), shards, lambda q, shard, at=shift: count_digits(q, shard, positives, at), "chunk long, place long, positive_rank long, bucket long, n long")
        counts = counts.groupBy(*KEY, "bucket").agg(F.sum("n").alias("n"))
        through = F.sum("n").over(W.partitionBy(*KEY).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
        found = state.drop("known").join(counts.withColumn("through", through), KEY, "left")
        place = found.where("through >= wanted AND through - n < wanted")
        kept = [c for c in state.columns if c not in ("known", "wanted")]
        old, state = state, scratch.keep(place.select(*kept, F.col("bucket").alias("known"), (F.col("wanted") - F.col("through") + F.col("n")).alias("wanted")))
        if closed is None:
            few = old.join(state.select(*KEY), KEY, "left_anti").where("positive_score >= 0")
            closed = scratch.keep(few.withColumn("known", width + 1))
        scratch.drop(old)
    state = state.unionByName(closed)
    rows = meet(chunks, _with_windows(anchors, state), shards, lambda q, shard: gather(q, shard, positives), "chunk long, place long, positive_rank long, negative_id long, negative_score long")
    first = W.partitionBy(*KEY).orderBy(F.desc("negative_score"), "negative_id")
    rows = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return rows.join(state.select(*KEY, "anchor_id", "positive_id", "positive_score"), KEY).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _with_windows(anchors: DataFrame, state: DataFrame) -> DataFrame:
    """Anchors with the state of their windows as lists in the order of positives."""
    lists = state.groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct("positive_rank", "positive_score", "known", "wanted"))).alias("w"))
    return anchors.join(lists, ROW).select(*anchors.columns, *[F.col(f"w.{c}").alias(name) for c, name in (("positive_rank", "ranks"), ("positive_score", "tops"), ("known", "known"), ("wanted", "wanted"))])


def relabelled(emb: DataFrame) -> DataFrame:
    """Labels of which one in seven is moved on by one: the mislabelled rows of the task."""
    label = F.col("label").cast("long")
    return only(emb, "vec_id", "label", "embedding").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(relabelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), Scratch(tune(spark), "negatives"))


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id AND len(c.e) = len(a.e) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
