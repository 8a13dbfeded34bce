"""Removal of passages that an earlier document has, by difference-cover anchors.

A window is WINDOW consecutive words. Positions modulo PERIOD that lie in a
difference cover are anchors, hashed over ANCHOR words. For two equal windows,
however they are aligned, some shift below PERIOD puts both on the cover, and
the anchor there is within both, since PERIOD - 1 + ANCHOR = WINDOW. So:

1. anchors are dealt by hash; those of two or more documents are candidates;
2. candidates extend to the windows about them, which are dealt by 96
   bits of two hashes of their bytes; a window is removed where a document with a smaller doc_id has it too.

Before either shuffle a task settles what its own documents share, and sends
one record for all of them, so a passage of very many documents is no hot key.

Rows are told apart by doc_id and, where an id has several texts, by a hash of
the text that goes with its windows as a tag (0 for all other rows).

Defined results: words are those of the whole text, null text has none; rows
with a null doc_id keep all words and take none from others; rows with equal
doc_id do not take words from each other, and each loses what its own text
shares with smaller ids; a text without words has the digest of the empty
string; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (
    map_batches, U64, Words, blocks, bucket_count, by_bucket, deal, dealt_schema, gather, gather_tags, groups, long_column, only, per_id, tune, windows,
)

WINDOW = 13
#: Every difference modulo the period is a difference of two of these (fixed values).
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Records that a task settles among themselves at a time.
HELD = 1_500_000
_ON_COVER = np.isin(np.arange(PERIOD), COVER)


def starts_within(w: Words, length: int) -> np.ndarray:
    """Words at which a run of `length` words of one document starts."""
    left = np.repeat(w.first[1:], np.diff(w.first)) - np.arange(len(w.start))
    return np.flatnonzero(left >= length)


def _equal_runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by the keys, and where each run of equal keys begins."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def shared_anchors(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(record is of a hash that two documents have, record is the first of its hash)."""
    order, head = _equal_runs(h)
    sorted_ids = ids[order]
    several = np.minimum.reduceat(sorted_ids, head) != np.maximum.reduceat(sorted_ids, head)
    sizes = np.diff(np.concatenate([head, [len(h)]]))
    shared, first = np.zeros(len(h), bool), np.zeros(len(h), bool)
    shared[order] = np.repeat(several, sizes)
    first[order[head]] = True
    return shared, first


def later_windows(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a record's window is also of a document with a smaller id."""
    order, head = _equal_runs(h1, h2)
    least = np.minimum.reduceat(ids[order], head)
    out = np.zeros(len(ids), bool)
    out[order] = ids[order] > np.repeat(least, np.diff(np.concatenate([head, [len(ids)]])))
    return out


class _Held:
    """Arrays of records gathered until there are enough to settle."""

    def __init__(self, settle: Callable[..., Iterator[pa.RecordBatch]]) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.count = 0
        self.settle = settle

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.count += len(columns[0])
        if self.count >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.count:
            yield from self.settle(*(np.concatenate(c) for c in zip(*self.parts)))
        self.parts, self.count = [], 0


def _passing(ids: np.ndarray, values: np.ndarray, buckets: int, width: int, tag: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Settled records as dealt rows that a reducer hands on: their bucket is negative."""
    batch = deal(-1 - ids % buckets, ids, values.astype(np.int64), tag=tag)
    if batch is not None:
        empty = pa.array([b""] * batch.num_rows, pa.binary())
        columns = [*batch.columns[:3], *[empty] * (width - 1), *batch.columns[3:]]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "ids", "counts", *[f"c{i}" for i in range(width)], *batch.schema.names[4:]])


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Words, int]]:
    """(document ids, words, first row) of the blocks of a batch (id, text, ...)."""
    ids = long_column(batch.column(0))
    for lo, hi, data, offsets in blocks(batch.column(1)):
        yield ids[lo:hi], Words(data, offsets), lo


def candidate_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(id, found): word positions of anchors that another document has too.

    Of an id with several texts, these are the positions of all of them.
    """
    shift = U64(64 - buckets.bit_length() + 1)

    def settle(h: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        shared, first = shared_anchors(h, ids)
        send = ~shared | first
        batch = deal((h[send] >> shift).astype(np.int64), ids[send], h[send], pos[send])
        if batch is not None:
            yield batch
        yield from _passing(ids[shared], pos[shared], buckets, 2)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(settle)
        for batch in batches:
            for ids, w, _ in _documents(batch):
                h = windows(w.hashes(), ANCHOR)
                at = starts_within(w, ANCHOR)
                pos = at - w.first[w.doc[at]]
                use = _ON_COVER[pos % PERIOD]
                at, pos = at[use], pos[use]
                if len(at):
                    yield from held.add(h[at], ids[w.doc[at]], pos)
        yield from held.flush()

    def meet(table: pa.Table) -> tuple[np.ndarray, ...]:
        if table.column("bucket")[0].as_py() < 0:
            return _settled(table, "c1")
        ids, h, pos = gather(table, ["<u8", "pos"])
        shared, _ = shared_anchors(h, ids)
        return ids[shared], pos[shared]

    return _met(map_batches(docs, send, dealt_schema(2)), meet, buckets)


def _met(rows: DataFrame, meet: Callable, buckets: int, tags: bool = False) -> DataFrame:
    """(id, found), a row per document, of the records that `meet` finds in each bucket; with tags, (id, found, tag)."""

    def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "bucket"):
            ids, pos, *tag = meet(table)
            batch = deal(ids % buckets, ids, pos, tag=tag[0] if tags else None)
            if batch is not None:
                yield batch

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "bucket"):
            yield from per_id(*gather(table, ["pos"]), *([gather_tags(table)] if tags else []))

    parts = map_batches(by_bucket(rows, buckets), by_document, dealt_schema(1, tags))
    return map_batches(by_bucket(parts, buckets), whole, "id long, found binary" + (", tag long" if tags else ""))


def _settled(table: pa.Table, column: str) -> tuple[np.ndarray, ...]:
    """Records that only pass through."""
    return gather(table.select(["ids", "counts", column]).rename_columns(["ids", "counts", "c0"]), ["pos"])


def covered_windows(candidates: DataFrame, buckets: int) -> DataFrame:
    """(id, found, tag): starts of windows that a document with a smaller id has.

    candidates: (doc_id, text, anchors, tag).
    """
    shift = U64(64 - buckets.bit_length() + 1)

    def settle(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, pos: np.ndarray, tag: np.ndarray) -> Iterator[pa.RecordBatch]:
        later = later_windows(h1, h2, ids)
        now = ~later
        batch = deal((h1[now] >> shift).astype(np.int64), ids[now], h1[now], h2[now], pos[now], tag=tag[now])
        if batch is not None:
            yield batch
        yield from _passing(ids[later], pos[later], buckets, 3, tag[later])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(settle)
        for batch in batches:
            anchors, tags = batch.column(2).to_pylist(), long_column(batch.column(3))
            for ids, w, lo in _documents(batch):
                h1, h2 = w.both_hashes()
                h1, h2 = windows(h1, WINDOW), windows(h2, WINDOW).astype(np.uint32)
                mark = np.zeros(len(w.start) + 1, bool)
                for a, first, end in zip(anchors[lo : lo + len(ids)], w.first, w.first[1:]):
                    q = np.frombuffer(a, "<u4").astype(np.int64) + first
                    q = q[q < end]  # another text of this id may be longer
                    for back in range(PERIOD):
                        mark[np.maximum(q - back, 0)] = True
                at = starts_within(w, WINDOW)
                at = at[mark[at]]
                if len(at):
                    doc = w.doc[at]
                    yield from held.add(h1[at], h2[at], ids[doc], at - w.first[doc], tags[lo : lo + len(ids)][doc])
        yield from held.flush()

    def meet(table: pa.Table) -> tuple[np.ndarray, ...]:
        if table.column("bucket")[0].as_py() < 0:
            return *_settled(table, "c2"), gather_tags(table)
        ids, h1, h2, pos = gather(table, ["<u8", "<u4", "pos"])
        later = later_windows(h1, h2, ids)
        return ids[later], pos[later], gather_tags(table)[later]

    return _met(map_batches(candidates, send, dealt_schema(3, True)), meet, buckets, True)


SCHEMA = "doc_id long, n_words long, n_removed long, kept binary"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words kept, joined by spaces, in UTF-8."""
    d = only(docs, "doc_id", "text")
    known = d.where("doc_id IS NOT NULL")
    buckets = bucket_count(d)
    mark = F.xxhash64("text").bitwiseOR(F.lit(1))
    several = known.groupBy("doc_id").agg((F.min(mark) != F.max(mark)).alias("several")).where("several")
    anchors = candidate_anchors(known, buckets).select(F.col("id").alias("doc_id"), F.col("found").alias("anchors")).join(several, "doc_id", "left")
    # Both joins shuffle the same rows by the same key, so Spark does it once.
    candidates = known.join(anchors, "doc_id").select("doc_id", "text", "anchors", F.when(F.col("several"), mark).otherwise(0).cast("long").alias("tag"))
    covered = covered_windows(candidates, buckets).select(F.col("id").alias("of"), F.col("found").alias("covered"), "tag")
    mine = (F.col("doc_id") == F.col("of")) & ((F.col("tag") == 0) | (F.col("tag") == mark))
    rows = known.join(covered, mine, "left").select("doc_id", "text", "covered")
    rows = rows.union(d.where("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast("binary")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (text or "").encode().split()
                counts.append(len(words))
                if found:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(np.frombuffer(found, "<u4").astype(np.int64))
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + WINDOW, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    return map_batches(rows, keep, SCHEMA)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), g AS (
  SELECT doc_id, i, sha256(array_to_string(ws[i:i + 12], ' ')) AS h FROM p WHERE i + 12 <= len(ws)
), f AS (
  SELECT h, min(doc_id) AS first_id FROM g GROUP BY h
), r AS (
  SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS i FROM g JOIN f USING (h) WHERE g.doc_id > f.first_id
), k AS (
  SELECT p.doc_id, count(r.i) AS n_removed, string_agg(CASE WHEN r.i IS NULL THEN p.ws[p.i] END, ' ' ORDER BY p.i) AS kept
  FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.i = r.i GROUP BY p.doc_id
)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
