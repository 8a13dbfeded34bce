"""Exact top-k search by inner product with MaxScore.

A term is a dimension, its postings the components of a tile of vectors, and
its bound for a query the most that a component of the tile can add. With the
terms of a query in the order of their bounds, the last ones whose bounds sum
to no more than SHARE of the score to beat are its non-essential terms.
Essential postings are traversed for all vectors of a tile; the other terms are
probed a few at a time, for those vectors only that can still reach the score to
beat with the bounds of what is left. A tile whose bounds all together fall short
is left out. Each shard gives its best of every query, and shards are merged.

Defined results: see `vectors`; rows that repeat a query's id are candidates, only
the query's own row is not; ties go to the smaller id; scores beyond the range of a
long are its ends; with fewer candidates than k there are fewer rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, only, tune
from .vectors import ROW, Block, meet, pack, precision, scores, shard_count, stated

#: Of the score to beat, the most that non-essential terms may reach together.
SHARE = 0.5
#: Terms that are probed before bounds are looked at again.
STEP = 8


class Best:
    """The k best candidates of each query so far: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, -np.inf)  # the score to reach

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = (np.concatenate(p) for p in ((self.query, query), (self.score, score.astype(np.int64)), (self.id, ids)))
        order = np.lexsort((ids, ~score, query))
        query, score, ids = query[order], score[order], ids[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        self.query, self.score, self.id, rank = query[kept], score[kept], ids[kept], rank[kept]
        full = rank == self.k - 1
        self.least[self.query[full]] = self.score[full]

    def rows(self, queries: Block) -> pa.RecordBatch:
        q = self.query
        return pa.RecordBatch.from_arrays([pa.array(a) for a in (queries.chunk[q], queries.place[q], queries.ids[q], self.id, self.score)], [*ROW, "query_id", "vec_id", "score"])


def add_dense(best: Best, queries: Block, tile: Block, allowed: np.ndarray) -> None:
    """All allowed pairs of a tile, of which each query's k best are put in order."""
    s = scores(queries, tile)
    cut = best.least.copy()
    if s.shape[1] > best.k:
        held = np.where(allowed, s.astype(np.float64), -np.inf)
        cut = np.maximum(cut, np.partition(held, -best.k, axis=1)[:, -best.k])
    qi, xi = np.nonzero(allowed & (s.astype(np.float64) >= cut[:, None]))  # no less than the cut as doubles: ties are kept
    best.add(qi, s[qi, xi], tile.ids[xi])


def add_tile(best: Best, queries: Block, tile: Block, kind: type, postings: np.ndarray, high: np.ndarray, low: np.ndarray) -> None:
    """MaxScore over one tile. postings: a row per term; high, low: ends of each term's components."""
    q = queries.x
    most = np.maximum(q * high, q * low)
    order = np.argsort(-most, axis=1, kind="stable")
    bounds = np.take_along_axis(most, order, 1)
    rest = np.concatenate([np.cumsum(bounds[:, ::-1], axis=1)[:, ::-1], np.zeros((len(q), 1))], 1)  # what the terms from each place on can add
    open_ = np.flatnonzero(rest[:, 0] >= best.least)
    if not len(open_):
        return
    small = rest[open_] <= SHARE * np.maximum(best.least[open_], 0)[:, None]
    small[:, -1] = True
    essential = small.argmax(1)
    rank = np.empty((len(open_), q.shape[1]), np.int64)
    np.put_along_axis(rank, order[open_], np.arange(q.shape[1])[None], 1)
    sums = np.where(rank < essential[:, None], q[open_], 0).astype(kind) @ postings
    need = best.least[open_] - rest[open_, essential]
    oi, xi = np.nonzero(sums >= need[:, None])
    s, at, qi = sums[oi, xi].astype(np.float64), essential[oi], open_[oi]
    del sums
    other = (queries.chunk[qi] != tile.chunk[xi]) | (queries.place[qi] != tile.place[xi])
    qi, xi, s, at = qi[other], xi[other], s[other], at[other]
    while len(at) and at.min() < q.shape[1]:
        place = at[:, None] + np.arange(STEP)
        dims = order[qi[:, None], np.minimum(place, q.shape[1] - 1)]
        s += np.where(place < q.shape[1], q[qi[:, None], dims] * postings[dims, xi[:, None]], 0).sum(1)
        at = np.minimum(at + STEP, q.shape[1])
        alive = s + rest[qi, at] >= best.least[qi]
        qi, xi, s, at = qi[alive], xi[alive], s[alive], at[alive]
    best.add(qi, s, tile.ids[xi])


def search(queries: Block, shard: Block, k: int) -> pa.RecordBatch:
    """The k best of a shard for each query."""
    best = Best(len(queries), k)
    kind = precision(queries, shard)
    for tile in shard.tiles():
        if kind is None or np.isinf(best.least).any():  # no score to beat yet, or none that is exact
            add_dense(best, queries, tile, ~queries.own(tile))
        else:
            add_tile(best, queries, tile, kind, np.ascontiguousarray(tile.x.T.astype(kind)), tile.x.max(0).astype(np.float64), tile.x.min(0).astype(np.float64))
    return best.rows(queries)


def top_k(emb: DataFrame, scratch: Scratch, every: int, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows for each row whose id is divisible by `every`."""
    chunks = pack(only(emb, "vec_id", "embedding").withColumn("label", F.lit(0)), scratch)
    found = meet(chunks, stated(chunks, every), shard_count(chunks), lambda q, shard: search(q, shard, k), "chunk long, place long, query_id long, vec_id long, score long")
    order = W.partitionBy(*ROW).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(tune(spark), "topk"), every=50)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
