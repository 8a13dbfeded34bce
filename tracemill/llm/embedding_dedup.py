"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosines.

Normalised vectors with cosine c are sqrt(2 - 2c) apart. Each of several tables
quantises a few Gaussian projections into a bucket; vectors of a label that
share a bucket are compared by exact cosine in double precision, and the
buckets give a spanning forest of true links. Within each component that these
make, all cosines are taken again in blocks, which counts the links, also those
that no table has found. Equal vectors are one representative with a count
throughout, and large buckets and components are dealt out as pairs of blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those whose label or vec_id is null, link with nothing (a null
vec_id gives a null component_id and is kept); vectors of different lengths do
not link; repeated rows are vectors of their own; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Scratch, by_task, components, groups, in_blocks, join_spread, long_column, map_batches, mix, only, tune

THRESHOLD = 0.93
#: Width of a quantisation step, and the chance wanted that a pair at the threshold meets.
STEP, RECALL = 2.0, 0.97
#: Vectors in a block of a bucket or component.
BLOCK = 1024
SEED = 13
#: A cosine is this near to the threshold where its product of blocks may be wrong about it.
CLOSE = 1e-12


def collision(distance: float, step: float = STEP) -> float:
    """Chance that one quantised Gaussian projection agrees at this distance."""
    r = step / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(projections a table, tables) for n vectors.

    The projections grow with log n, so that unrelated vectors (about sqrt(2)
    apart) in a bucket stay few; the tables follow from the recall wanted.
    """
    k = max(12, math.ceil(12 + math.log(max(n, 1) / 50_000) / -math.log(collision(math.sqrt(2)))))
    hit = collision(math.sqrt(2 - 2 * threshold)) ** k
    return k, math.ceil(math.log(1 - RECALL) / math.log(1 - hit))


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows in double precision, whatever their scale."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def reach(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which cosines of unit rows are at or above the threshold.

    The last bits of a product of blocks depend on the blocks; what is that near is
    decided by the exact sum of the products of components, for both sides alike.
    """
    s = a @ b.T
    near = s >= threshold
    for i, j in zip(*np.nonzero(np.abs(s - threshold) < CLOSE)):
        near[i, j] = math.fsum(a[i] * b[j]) >= threshold
    return near


def usable() -> Column:
    """Whether a row's vector can link (never null)."""
    v = F.col("embedding")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()
    return F.coalesce(known & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def hash_tables(reps: DataFrame, k: int, tables: int) -> DataFrame:
    """(rep, bucket) of every representative in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            for size in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == size))
                x = unit_rows(part.column(2))
                rng = np.random.default_rng([SEED, size])
                lines = rng.standard_normal((size, k * tables))
                shift = rng.uniform(0, STEP, k * tables)
                cell = np.floor((x @ lines + shift) / STEP).astype(np.int64).astype(U64).reshape(len(x), tables, k)
                key = np.broadcast_to(mix(long_column(part.column(1)).astype(U64) * U64(1 << 20) + U64(size))[:, None], cell.shape[:2]) + np.arange(tables, dtype=U64)
                for i in range(k):
                    key = mix(key + cell[:, :, i])
                ids = np.repeat(long_column(part.column(0)), tables)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(key.reshape(-1).view(np.int64))], ["rep", "bucket"])

    return map_batches(reps.select("rep", F.xxhash64("label").alias("l"), "v"), run, "rep long, bucket long")


def _linked(x: np.ndarray, threshold: float) -> np.ndarray:
    """Edges (i, j) that connect what cosines of `threshold` connect.

    Each vector reached is compared with those not reached yet, and no others.
    """
    pool = np.arange(len(x))
    edges = []
    while len(pool) > 1:
        frontier, pool = pool[:1], pool[1:]
        while len(frontier) and len(pool):
            take, frontier = frontier[:512], frontier[512:]
            near = reach(x[pool], x[take], threshold)
            hit = near.any(1)
            new = pool[hit]
            edges.append(np.stack([new, take[near[hit].argmax(1)]], 1))
            pool = pool[~hit]
            frontier = np.concatenate([frontier, new])
    return np.concatenate(edges) if edges else np.zeros((0, 2), int)


def _by_length(table: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray]]:
    column = table.column("v").combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    for size in np.unique(lengths).tolist():
        part = table.filter(pa.array(lengths == size))
        yield part, unit_rows(part.column("v"))


def bucket_edges(rows: DataFrame, threshold: float) -> DataFrame:
    """Edges of a spanning forest of each task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "task"):
            for part, x in _by_length(table):
                ids = long_column(part.column("rep").combine_chunks())
                e = _linked(x, threshold)
                if len(e):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[e[:, 0]]), pa.array(ids[e[:, 1]])], ["a", "b"])

    return map_batches(by_task(rows.select("task", "rep", "v")), run, "a long, b long")


def link_counts(rows: DataFrame, threshold: float) -> DataFrame:
    """(rep, links): copies of other representatives at or above the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "task"):
            for part, x in _by_length(table):
                side, ids, copies = (long_column(part.column(c).combine_chunks()) for c in ("side", "rep", "copies"))
                home = bool(part.column("home")[0].as_py())
                out = np.zeros(len(x), np.int64)
                for lo in range(0, len(x), 512):
                    near = reach(x[lo : lo + 512], x, threshold)
                    if home:
                        near[np.arange(len(near)), np.arange(lo, lo + len(near))] = False
                    else:
                        near &= side[lo : lo + 512, None] != side[None]
                    out[lo : lo + 512] = near @ copies
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out)], ["rep", "links"])

    return map_batches(by_task(rows.select("task", "rep", "v", "copies", "side", "home")), run, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def deduplicate(emb: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = scratch.spark
    rows = only(emb, "vec_id", "label", "embedding")
    good = rows.where(usable()).select("vec_id", "label", F.col("embedding").alias("v"))
    reps = scratch.keep(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    k, tables = plan_tables(reps.count(), threshold)
    placed = hash_tables(reps, k, tables)
    shared = placed.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").withColumn("n", F.col("k"))
    vectors = reps.select("rep", "v")
    met = join_spread(placed, shared, ["bucket"], "k", F.col("rep")).where("n IS NOT NULL").join(vectors, "rep")
    edges = bucket_edges(in_blocks(met, "bucket", F.col("n"), BLOCK), threshold)
    # A representative is the first of its copies, so components need no others.
    comp = scratch.keep(components(edges, scratch).withColumnRenamed("node", "rep"))
    sizes = comp.groupBy("component").agg(F.count("*").alias("n"))
    member = comp.join(sizes, "component").join(reps.select("rep", "v", "copies"), "rep")
    links = link_counts(in_blocks(member, "component", F.col("n"), BLOCK), threshold)
    found = reps.join(comp, "rep", "left").join(links, "rep", "left").select(
        "label", "v", "copies", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = join_spread(good, found, ["label", "v"], "copies", F.col("vec_id"))
    alone = rows.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(tune(spark), "embedding"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(node, root) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.b, r.root FROM reach r JOIN link l ON r.node = l.a AND r.root < l.b
), comp AS (
  SELECT node AS vec_id, min(root) AS component_id FROM reach GROUP BY node
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a
)
SELECT c.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM comp c LEFT JOIN n USING (vec_id)
"""
