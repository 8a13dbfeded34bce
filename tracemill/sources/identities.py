"""The identities of a tenant's stored events, in segments with a Bloom filter each.

A segment holds some identities (source_system, source_event_id) by a hash, in files
of its own. Its filter, about four bytes an identity, tells which of a batch's hashes
it may hold. A batch passes by the filters, and reads those segments only that
may hold one of its own: none if all its events are new, but for some in a
million. What is read is compared as a whole, so nothing depends on hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["source_system", "source_event_id"]
#: Identities of a segment, about; events of a batch that is small enough to pass by the filters.
SEGMENT_IDS, LOOKUP_ROWS = 1_000_000, 100_000
#: Bits of a filter for an identity, and bits that an identity sets: wrong for 3 of ten million.
BITS, HASHES = 32, 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """The bits that each hash sets in a filter of so many."""
    x = h.astype(np.int64).view(np.uint64)[:, None] + _ODD * np.arange(1, HASHES + 1, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return ((x ^ (x >> np.uint64(33))) % np.uint64(bits)).astype(np.int64)


def make_filter(h: np.ndarray) -> bytes:
    """The Bloom filter of some hashes."""
    bits = np.zeros(-(-max(len(h), 1) * BITS // 8) * 8, bool)
    for lo in range(0, len(h), 1 << 16):
        bits[_places(h[lo : lo + (1 << 16)], len(bits))] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(raw: bytes, h: np.ndarray) -> np.ndarray:
    """Whether a filter may hold each hash; True for all that it holds."""
    data = np.frombuffer(raw, np.uint8)
    at = _places(h, 8 * len(data))
    return (data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool).all(1)


def hashed(events: DataFrame) -> DataFrame:
    """(source_system, source_event_id, h) of the events that have an id."""
    return events.where("source_event_id IS NOT NULL").select(*KEY, F.xxhash64(*KEY).alias("h"))


class Identities:
    """The identities of one tenant, under a folder."""

    def __init__(self, spark: SparkSession, root: str, tenant: str) -> None:
        """tenant: the tenant's part of a path."""
        self.spark = spark
        self.segments, self.filters, self.intents = (f"{root}/{t}/{tenant}" for t in ("identities", "identity_filters", "_intents"))

    def _path(self, folder: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self) -> bool:
        fs, p = self._path(self.filters)
        return fs.exists(p)

    def begin(self) -> str:
        """Notes that events are about to be stored; `end` takes the note away once their identities are."""
        name = f"{self.intents}/{uuid.uuid4().hex}"
        fs, p = self._path(name)
        fs.create(p, False).close()
        return name

    def end(self, name: str) -> None:
        fs, p = self._path(name)
        fs.delete(p, False)

    def broken(self) -> bool:
        """Whether an insertion did not end, so that stored events may lack an identity."""
        fs, p = self._path(self.intents)
        return fs.exists(p) and len(fs.listStatus(p)) > 0

    def rebuild(self, events: DataFrame) -> None:
        """All identities anew, from the stored events."""
        for folder in (self.filters, self.segments):
            fs, p = self._path(folder)
            fs.delete(p, True)
        self.add(events)
        fs, p = self._path(self.intents)
        fs.delete(p, True)

    def add(self, events: DataFrame) -> None:
        """The identities of events that are stored now."""
        rows = hashed(events)
        n = rows.count()
        if not n:
            return
        parts, name = -(-n // SEGMENT_IDS), uuid.uuid4().hex
        segment = F.concat(F.lit(f"{name}-"), F.pmod("h", F.lit(parts)).cast("string"))
        rows.withColumn("segment", segment).repartition("segment").write.mode("append").partitionBy("segment").parquet(self.segments)
        stored = self.spark.read.parquet(self.segments).where(F.col("segment").startswith(name)).select(F.col("segment").cast("string").alias("segment"), "h")

        def build(key: tuple, table: pa.Table) -> pa.Table:
            h = table.column("h").to_numpy()
            return pa.table({"segment": [key[0].as_py()], "n": [len(h)], "bits": pa.array([make_filter(h)], pa.binary())})

        stored.groupBy("segment").applyInArrow(build, "segment string, n long, bits binary").write.mode("append").parquet(self.filters)

    def hit(self, batch: DataFrame) -> list[str]:
        """Names of the segments that may hold an identity of a batch of up to LOOKUP_ROWS events."""
        h = np.array([r.h for r in hashed(batch).select("h").distinct().collect()], np.int64)
        if not len(h):
            return []
        sent = self.spark.sparkContext.broadcast(h)  # eight bytes an event of the batch

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                mine = [s for s, raw in zip(b.column(0).to_pylist(), b.column(1)) if may_hold(raw.as_py(), sent.value).any()]
                yield pa.RecordBatch.from_arrays([pa.array(mine, pa.string())], ["segment"])

        rows = self.spark.read.parquet(self.filters).select("segment", "bits").mapInArrow(test, "segment string")
        return [r.segment for r in rows.distinct().collect()]

    def stored(self, batch: DataFrame) -> DataFrame:
        """(source_system, source_event_id) of the segments that may hold some of a batch's."""
        names = self.hit(batch)
        if not names:
            return hashed(batch).select(*KEY).limit(0)
        return self.spark.read.parquet(*[f"{self.segments}/segment={n}" for n in names]).select(*KEY)
