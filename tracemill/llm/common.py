"""Helpers shared by the corpus operators.

* scratch tables in the folder that every executor shares,
* word boundaries and word hashes of whole Arrow text batches in numpy,
* connected components of an edge table as a sequence of joins and aggregates.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import Scratch, shared_dir  # noqa: F401

#: Records in an Arrow batch. Long texts make batches large, so few rows a batch.
BATCH_ROWS = 256
#: Bytes of text that the numpy passes take at once (a longer text goes alone).
BLOCK_BYTES = 1 << 19

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15 | 1)
_Q = U64(0xD6E8FEB86659FD93)
_R = U64(0xA0761D6478BD642F)


# ------------------------------------------------------------------ session


def tune(spark: SparkSession) -> SparkSession:
    """Small Arrow batches for this session: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def partitions(spark: SparkSession) -> int:
    """Partitions for explicit repartitioning: what the session shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """Size of a table by its files, or by its texts where Spark knows no files."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 60:
        return known
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever else the table holds (exact names)."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def give_back() -> None:
    """Return freed memory to the system; workers live on after a task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow by workers that keep little between tasks."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


# ------------------------------------------------------------------- hashes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (a multiply and shift finisher)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        inverse = U64(pow(int(_P), -1, 1 << 64))
        tables = []
        for base in (_P, inverse):
            t = np.full(max(n, BLOCK_BYTES) + 1, base, U64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if n > 4 * BLOCK_BYTES:
            return tables
        _powers[:] = tables
    return _powers


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a block of texts.

    start, end: byte positions in data; first: index of each document's first
    word, with the total at the end; doc: document of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        self.data = data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        solid = ~_SPACE[data]
        head = solid.copy()
        head[1:] &= ~solid[:-1]
        tail = solid.copy()
        tail[:-1] &= ~solid[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        head[inner] = solid[inner]
        tail[inner - 1] = solid[inner - 1]
        self.start = np.flatnonzero(head)
        self.end = np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return word_hashes(self.data, self.start, self.end)[0]

    def both_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each word's bytes, neither of which follows from the other."""
        return word_hashes(self.data, self.start, self.end)


#: Words of more bytes are hashed one by one.
LONG_WORD = 512


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the bytes of each word [start, end).

    Eight bytes at a time go through two chains of multiplications and shifts, in which
    no byte adds up with another as in a polynomial; each hash takes from both chains.
    """
    size = end - start
    a, b = mix(size.astype(U64) * _P), mix(size.astype(U64) * _Q + _R)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # those at each position
    at = np.flatnonzero(size <= LONG_WORD)
    done = 0
    while len(at):
        left = np.minimum(size[at] - done, 8).astype(U64)
        x = eight[start[at] + done].astype(U64) & (~U64(0) >> (U64(64) - U64(8) * left))
        a[at] = mix((a[at] ^ x) * _P + _R)
        b[at] = mix((b[at] + x * _R) ^ _Q)
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        raw = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=16).digest()
        a[i], b[i] = np.frombuffer(raw, U64)
    return mix(a ^ (b * _P)), mix(b + a * _Q)


def windows(h: np.ndarray, length: int, base: np.uint64 = _Q) -> np.ndarray:
    """Hash of each run of `length` word hashes (as many as fit in the array)."""
    m = len(h) - length + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    factor = U64(1)
    with np.errstate(over="ignore"):
        for k in range(length):
            out += h[k : k + m] * factor
            factor = factor * base
    return mix(out)


def second(h: np.ndarray) -> np.ndarray:
    """Hashes of another family, of what the given ones tell apart."""
    return mix(h ^ _R)


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of an Arrow text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most `limit` bytes."""
    data, offsets = text_column(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def long_column(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


# --------------------------------------------------------- grouped streaming


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal `key` from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = long_column(batch.column(key))
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if held and held[-1].column(key)[0].as_py() != k[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def in_blocks(df: DataFrame, key: str, size: Column, block: int) -> DataFrame:
    """df with `task`: groups above `block` rows appear in every pair of their blocks.

    Adds `side`, the block of the row, and `home`, whether the pair is of one block.
    """
    n = F.ceil(size / block).cast("long")
    own = F.pmod(F.xxhash64(F.lit(17), F.col("rep")), F.col("n_blocks"))
    df = df.withColumn("n_blocks", n).withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    low, high = F.least("side", "other"), F.greatest("side", "other")
    return df.withColumn("task", F.xxhash64(key, low, high)).withColumn("home", F.col("side") == F.col("other")).drop("other", "n_blocks")


def by_task(rows: DataFrame) -> DataFrame:
    """Rows of a task together, in the order of tasks within each partition."""
    return rows.repartition(partitions(rows.sparkSession), "task").sortWithinPartitions("task")


# --------------------------------------------------------------- components


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member index of each index's component, for n indices and edges a-b."""
    parent = np.arange(n)
    while len(a):
        ra, rb = parent[a], parent[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        apart = lo != hi
        if not apart.any():
            break
        a, b, lo, hi = a[apart], b[apart], lo[apart], hi[apart]
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition as stars about the smallest member."""
    for batch in batches:
        a, b = long_column(batch.column(0)), long_column(batch.column(1))
        if not len(a):
            continue
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = union_find(len(ids), at[: len(a)], at[len(a) :])
        far = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], ["u", "v"])


#: Keys of so many rows are hot, and at most so many of them are broadcast.
HOT_ROWS, HOT_KEYS = 1_000, 2_000
#: Edges up to which the least neighbours of all nodes are broadcast.
BROADCAST_EDGES = 300_000
#: Rows of a key from which on a join is worth being spread.
SPREAD_ROWS = 5_000
#: Tasks that the rows of a hot key are dealt over.
SALTS = 1_024


def join_spread(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, salt: Column) -> DataFrame:
    """rows left-joined to keyed, which has one row per key, with no key's rows in one task.

    count: the number of rows of each key. The HOT_KEYS keys of most rows are
    broadcast, and their rows are dealt by `salt` as well; any other key holds
    less than one in HOT_KEYS of all rows. The columns of keyed follow those of rows.
    """
    values = [c for c in keyed.columns if c not in (*keys, count)]
    name = lambda c: F.col(f"`{c}`")
    hot = keyed.where(name(count) >= HOT_ROWS).orderBy(name(count).desc(), *map(name, keys)).limit(HOT_KEYS)
    hot = hot.select(*map(name, keys), F.struct(*map(name, values)).alias("hot_row"))
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn("hot_salt", F.when(F.col("hot_row").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(salt), F.lit(SALTS))).cast("long"))
    cold = keyed.select(*map(name, keys), F.lit(0).cast("long").alias("hot_salt"), F.struct(*map(name, values)).alias("cold_row"))
    both = marked.join(cold, [*keys, "hot_salt"], "left").withColumn("found_row", F.coalesce("hot_row", "cold_row"))
    return both.select(*map(name, rows.columns), *[F.col("found_row")[v].alias(v) for v in values])


#: Keys whose hashes are broadcast, so that rows without a partner stay where they are (some 16 bytes a key).
BROADCAST_KEYS = 2_000_000


def may_match(rows: DataFrame, keyed: DataFrame, keys: list[str], of: list[str] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows that may have a key of `keyed`, the others, which surely have none).

    Up to BROADCAST_KEYS keys, whatever shares a 64-bit hash with one may; beyond, all
    rows may, and there are no others. of: the names of the keys in rows.
    """
    if keyed.count() > BROADCAST_KEYS:
        return rows, None
    hashes = F.broadcast(keyed.select(F.xxhash64(*keys).alias("may_match")).distinct())
    same = F.xxhash64(*(of or keys)) == F.col("may_match")
    return rows.join(hashes, same, "left_semi"), rows.join(hashes, same, "left_anti")


def largest(keyed: DataFrame, count: str) -> int:
    """The most rows of any key."""
    return keyed.agg(F.max(count)).first()[0] or 0


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, salt: Column, most: int) -> DataFrame:
    """As join_spread; a plain join where no key has SPREAD_ROWS rows."""
    return join_spread(rows, keyed, keys, count, salt) if most >= SPREAD_ROWS else rows.join(keyed.drop(count), keys, "left")


def _least(edges: DataFrame, with_self: bool) -> DataFrame:
    """(u, m, k): the least neighbour of each node (or itself), and its number of edges."""
    least = F.least(F.min("v"), F.first("u")) if with_self else F.min("v")
    return edges.groupBy("u").agg(least.alias("m"), F.count("*").alias("k"))


#: Edges that one file of a table between two rounds holds.
FILE_EDGES = 1 << 16


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of edges(a, b); the smallest id names it.

    Alternates the large-star and small-star steps. Each is a minimum for a
    node, combined before the shuffle, and a join that brings it to the node's
    edges: by broadcast up to BROADCAST_EDGES edges (some 10 MB), beyond by one
    that spreads the edges of a node which has very many. Rounds of few edges
    write few files.
    """
    e = edges.toDF("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = scratch.keep(map_batches(e, _local_stars, "u long, v long").distinct())
    before, count = None, e.count()

    def met(rows: DataFrame, least: DataFrame) -> DataFrame:
        if count <= BROADCAST_EDGES:
            return rows.join(F.broadcast(least.drop("k")), "u")
        return join_spread(rows, least, ["u"], "k", F.col("v"))

    while True:
        both = e.union(e.select("v", "u"))
        large = met(both, _least(both, True)).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = (
            met(large, _least(large, False))
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        files = count // FILE_EDGES + 1  # a round adds no edges
        old, e = e, scratch.keep(small.coalesce(files) if files < partitions(edges.sparkSession) else small)
        scratch.drop(old)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, count = now, now[0]
    return e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("component")).union(
        e.select(F.col("v"), F.col("v")).distinct()
    )


# ------------------------------------------------- records dealt as columns


#: Bytes of input that a bucket of dealt records stands for, and buckets of a partition.
BUCKET_BYTES, BUCKETS_EACH = 48 << 20, 16


def bucket_count(df: DataFrame) -> int:
    """Buckets for records dealt by hash: a power of two over twice the partitions.

    A task holds one bucket at a time, so there are more where the input is large.
    """
    least = max(2 * partitions(df.sparkSession), -(-input_bytes(df) // BUCKET_BYTES))
    return 1 << (least - 1).bit_length()


def by_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    """Dealt rows of a bucket together, in the order of buckets within each partition."""
    n = max(partitions(rows.sparkSession), buckets // BUCKETS_EACH)
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket")


def narrowed(x: np.ndarray) -> np.ndarray:
    """Positions in two bytes each where all fit."""
    return x.astype("<u2" if not len(x) or x.max() < 1 << 16 else "<u4")


def deal(bucket: np.ndarray, ids: np.ndarray, *columns: np.ndarray, tag: np.ndarray | None = None) -> pa.RecordBatch | None:
    """A row per bucket that has records: runs of equal ids, and raw columns.

    Rows of many records each cost a shuffle far less than a row per record.
    tag: what tells apart records of equal id; a last column has that of each
    run, or nothing where all of a row are 0.
    """
    if not len(bucket):
        return None
    order = np.argsort(bucket, kind="stable")
    b, ids = bucket[order], ids[order]
    columns = tuple(c[order] for c in columns)
    cuts = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]])
    fresh = (ids[1:] != ids[:-1]) | (b[1:] != b[:-1])
    if tag is not None:
        tag = tag[order]
        fresh |= tag[1:] != tag[:-1]
    runs = np.concatenate([[0], np.flatnonzero(fresh) + 1, [len(b)]])
    at = np.searchsorted(runs, cuts)
    heads, counts = ids[runs[:-1]], np.diff(runs).astype("<u4")
    pieces = list(zip(at[:-1].tolist(), at[1:].tolist()))
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    arrays = [pa.array(b[cuts[:-1]].astype(np.int64)), pa.array([heads[i:j].tobytes() for i, j in pieces], pa.binary()), pa.array([counts[i:j].tobytes() for i, j in pieces], pa.binary())]
    arrays += [pa.array([narrowed(c[i:j]).tobytes() if c.dtype == np.int64 else c[i:j].tobytes() for i, j in spans], pa.binary()) for c in columns]
    names = ["bucket", "ids", "counts", *[f"c{i}" for i in range(len(columns))]]
    if tag is not None:
        tags = tag[runs[:-1]]
        arrays.append(pa.array([tags[i:j].tobytes() if tags[i:j].any() else b"" for i, j in pieces], pa.binary()))
        names.append("tags")
    return pa.RecordBatch.from_arrays(arrays, names)


def dealt_schema(columns: int, tags: bool = False) -> str:
    return ", ".join(["bucket long", "ids binary", "counts binary", *[f"c{i} binary" for i in range(columns)], *(["tags binary"] if tags else [])])


def gather_tags(table: pa.Table) -> np.ndarray:
    """The tag of each record of dealt rows."""
    counts = [np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()]
    tags = [np.repeat(np.frombuffer(t, np.int64), c) if t else np.zeros(int(c.sum()), np.int64) for t, c in zip(table.column("tags").to_pylist(), counts)]
    return np.concatenate([*tags, np.zeros(0, np.int64)])


def gather(table: pa.Table, dtypes: list[str]) -> tuple[np.ndarray, ...]:
    """ids and columns of dealt rows; dtype `pos` is positions of either width."""
    counts = [np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()]
    ids = [np.repeat(np.frombuffer(x, np.int64), c) for x, c in zip(table.column("ids").to_pylist(), counts)]
    out = [np.concatenate(ids) if ids else np.zeros(0, np.int64)]
    for i, dtype in enumerate(dtypes):
        parts = []
        for raw, c in zip(table.column(f"c{i}").to_pylist(), counts):
            n = int(c.sum())
            parts.append(np.frombuffer(raw, dtype if dtype != "pos" else "<u2" if len(raw) == 2 * n else "<u4"))
        out.append(np.concatenate(parts).astype(np.int64 if dtype == "pos" else dtype) if parts else np.zeros(0, np.int64 if dtype == "pos" else dtype))
    return tuple(out)


def per_id(ids: np.ndarray, values: np.ndarray, tags: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(id, found) rows, with a tag where ids have them: the values of each id as unsigned 32-bit integers."""
    if not len(ids):
        return
    order = np.argsort(ids, kind="stable") if tags is None else np.lexsort((tags, ids))
    ids, raw = ids[order], values[order].astype("<u4")
    fresh = ids[1:] != ids[:-1]
    if tags is not None:
        tags = tags[order]
        fresh |= tags[1:] != tags[:-1]
    cuts = np.concatenate([[0], np.flatnonzero(fresh) + 1, [len(ids)]]).tolist()
    found = pa.array([raw[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())
    if tags is None:
        yield pa.RecordBatch.from_arrays([pa.array(ids[cuts[:-1]]), found], ["id", "found"])
    else:
        yield pa.RecordBatch.from_arrays([pa.array(ids[cuts[:-1]]), found, pa.array(tags[cuts[:-1]])], ["id", "found", "tag"])
