"""Integer vectors in chunks, and a stated set of them against all, in blocks.

A chunk is a row that holds many vectors of one length as raw columns, so a
shuffle moves few rows. Chunks are dealt over shards that fit in a task, each
vector of the stated set meets every shard, and what a shard finds for it is
merged by the caller. Nothing is broadcast, and no key decides a shard.

Defined results: rows without an id take no part, nor do those whose vector is
null or empty or holds a null or a component that is not finite once scaled;
vectors of different lengths do not meet; repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, long_column, map_batches, partitions

#: A component x becomes floor(SCALE * x).
SCALE = 256.0
#: Bytes of components that a chunk and a shard hold, about.
CHUNK_BYTES, SHARD_BYTES = 1 << 15, 32 << 20
#: Candidates that a product takes at once; the first ones, which set the bounds, are few.
TILE, FIRST_TILE = 4096, 256
#: Where a row is: its chunk and its place in it.
ROW = ["chunk", "place"]
#: What tells the end of exact whole numbers in single and double precision.
SINGLE, DOUBLE = float(1 << 24), float(1 << 53)


def takes_part() -> Column:
    """Whether a row (vec_id, embedding) takes part (never null)."""
    v = F.col("embedding")
    infinite = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * SCALE) == float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & (F.size(v) > 0) & ~infinite, F.lit(False))


def _stored(x: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in as few bytes as hold all."""
    most = np.abs(x).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind, x.astype(kind).tobytes()


def pack(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(vec_id, label, embedding) -> written chunks (chunk, size, n, kind, ids, labels, data); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def chunk(size: int) -> pa.RecordBatch:
            ids, labels, x = (np.concatenate(c) for c in zip(*held.pop(size)))
            kind, data = _stored(x)
            values = [[size], [len(ids)], [kind], [ids.tobytes()], [labels.tobytes()], [data]]
            types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], ["size", "n", "kind", "ids", "labels", "data"])

        for batch in batches:
            ids, labels, column = long_column(batch.column(0)), long_column(batch.column(1)), batch.column(2)
            lengths = np.diff(column.offsets.to_numpy())
            for size in np.unique(lengths).tolist():
                mine = lengths == size
                x = column.filter(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                most = max(1, CHUNK_BYTES // (2 * size))
                for lo in range(0, len(x), most):
                    hi = lo + most
                    held.setdefault(size, []).append((ids[mine][lo:hi], labels[mine][lo:hi], np.floor(SCALE * x[lo:hi])))
                    if sum(len(h[0]) for h in held[size]) >= most:
                        yield chunk(size)
            if len(held) > 64:  # tables of very many lengths
                yield from map(chunk, list(held))
        yield from map(chunk, list(held))

    good = rows.where(takes_part()).select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(F.col("label").cast("long"), F.lit(0)).alias("label"), "embedding")
    packed = map_batches(good, run, "size long, n long, kind string, ids binary, labels binary, data binary")
    return scratch.keep(packed.select(F.monotonically_increasing_id().alias("chunk"), "*"))


def unpack(batch: pa.RecordBatch, i: int) -> np.ndarray:
    """Components of row i of a batch of chunks, a vector a row."""
    return np.frombuffer(batch.column("data")[i].as_py(), batch.column("kind")[i].as_py()).reshape(-1, batch.column("size")[i].as_py())


def stated(chunks: DataFrame, every: int) -> DataFrame:
    """(chunk, place, vec_id, label, size, kind, data): the rows whose id is divisible by `every`, one by one."""
    names = [*ROW, "vec_id", "label", "size", "kind", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("ids", "labels"))
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    x, kind = unpack(batch, i), batch.column("kind")[i].as_py()
                    one = lambda c: pa.array([batch.column(c)[i].as_py()] * len(at), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [one("chunk"), pa.array(at.astype(np.int64)), pa.array(ids[at]), pa.array(labels[at]), one("size"), pa.array([kind] * len(at)), pa.array([x[j].tobytes() for j in at], pa.binary())], names
                    )

    return map_batches(chunks.select("chunk", "size", "kind", "ids", "labels", "data"), run, "chunk long, place long, vec_id long, label long, size long, kind string, data binary")


class Block:
    """Vectors of one length that are compared at once: rows of floats that hold whole numbers."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, chunk: np.ndarray, place: np.ndarray, extra: pa.RecordBatch | None = None) -> None:
        self.x, self.ids, self.labels, self.chunk, self.place, self.extra = x, ids, labels, chunk, place, extra
        self.norm = float(np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64).max(initial=0)))

    def __len__(self) -> int:
        return len(self.ids)

    def tiles(self) -> Iterator[Block]:
        """The first few rows, then TILE at a time."""
        lo = 0
        while lo < len(self):
            hi = lo + (TILE if lo else FIRST_TILE)
            yield Block(self.x[lo:hi], self.ids[lo:hi], self.labels[lo:hi], self.chunk[lo:hi], self.place[lo:hi])
            lo = hi

    def own(self, other: Block) -> np.ndarray:
        """Where a row of this block and one of the other are the same row."""
        return (self.chunk[:, None] == other.chunk) & (self.place[:, None] == other.place)


def precision(a: Block, b: Block) -> type | None:
    """The narrowest floats in which all sums of products are exact, whatever their order; None: neither."""
    most = a.norm * b.norm
    return np.float32 if most < SINGLE else np.float64 if most < DOUBLE else None


def scores(a: Block, b: Block) -> np.ndarray:
    """Exact inner products of all rows of two blocks; beyond the range of a long they are its ends."""
    kind = precision(a, b)
    if kind is not None:
        return (a.x.astype(kind) @ b.x.astype(kind).T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    ends = np.iinfo(np.int64)
    return np.clip(whole(a.x.astype(np.float64)) @ whole(b.x.astype(np.float64)).T, ends.min, ends.max).astype(np.int64)


def shard_count(chunks: DataFrame) -> int:
    """Shards that fit in a task, at least one a partition."""
    total = chunks.agg(F.sum(F.length("data"))).first()[0] or 0
    return max(partitions(chunks.sparkSession), -(-total // SHARD_BYTES))


def meet(chunks: DataFrame, queries: DataFrame, shards: int, run: Callable[[Block, Block], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What `run` finds for queries (as of `stated`, with further columns) in each shard.

    A task holds the candidates of a shard and lets the queries pass by, so its
    memory is bounded by SHARD_BYTES; a query is sent once a shard.
    """
    more = [c for c in queries.columns if c not in (*ROW, "vec_id", "label", "size", "kind", "data")]
    none = [F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in more]
    empty = F.lit(None).cast("binary")
    here = chunks.select(F.pmod(F.xxhash64("chunk"), F.lit(shards)).alias("shard"), "size", F.lit(0).alias("role"), "chunk", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("label"), "kind", "ids", "labels", "data", *none)
    ask = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "size", F.lit(1).alias("role"), *ROW, "vec_id", "label", "kind", empty.alias("ids"), empty.alias("labels"), "data", *more)
    rows = here.union(ask).repartition(min(shards, 4 * partitions(chunks.sparkSession)), "shard").sortWithinPartitions("shard", "size", "role")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, key = None, [], None
        for batch in batches:
            tag = np.stack([long_column(batch.column(c)) for c in ("shard", "size", "role")], 1)
            cuts = [0, *(np.flatnonzero((tag[1:] != tag[:-1]).any(1)) + 1).tolist(), len(tag)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part, (*place, role) = batch.slice(lo, hi - lo), tag[lo].tolist()
                if place != key:
                    held, parts, key = None, [], place
                if role == 0:
                    parts.append(part)
                elif parts or held is not None:
                    held = held if held is not None else _candidates(parts)
                    parts = []
                    out = run(_queries(part), held)
                    if out is not None and out.num_rows:
                        yield out

    return map_batches(rows, task, schema)


def _candidates(parts: list[pa.RecordBatch]) -> Block:
    """The vectors of a shard's chunks."""
    x, ids, labels, chunk, place = [], [], [], [], []
    for batch in parts:
        for i, c in enumerate(long_column(batch.column("chunk")).tolist()):
            rows = unpack(batch, i)
            x.append(rows)
            ids.append(np.frombuffer(batch.column("ids")[i].as_py(), np.int64))
            labels.append(np.frombuffer(batch.column("labels")[i].as_py(), np.int64))
            chunk.append(np.full(len(rows), c))
            place.append(np.arange(len(rows)))
    wide = np.float32 if all(r.dtype == np.dtype("<i2") for r in x) else np.float64
    return Block(np.concatenate(x).astype(wide), *map(np.concatenate, (ids, labels, chunk, place)))


def _queries(part: pa.RecordBatch) -> Block:
    x = np.concatenate([unpack(part, i).astype(np.float64) for i in range(part.num_rows)])
    return Block(x, *[long_column(part.column(c)) for c in ("vec_id", "label", "chunk", "place")], part)
