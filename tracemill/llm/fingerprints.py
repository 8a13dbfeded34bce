"""Document fingerprints by spot signatures.

Each occurrence of a common word is an anchor; it and the next CHAIN content
words make a signature. A text's signatures form a set. The fingerprint states
the size of the set, a digest of all of it and its smallest hashes; likeness is
the Jaccard similarity of whole sets.

`near_classes` groups the near duplicates of a corpus: candidate families come
from shared prefixes of the sets, as in the n-gram join; within a family sets
are partitioned by their length, so that only sets of the same or the next
partition can be alike enough, and each set is compared with those that share
one of its rarest signatures there, by a Jaccard similarity that is given up as
soon as it cannot reach the threshold.

For `compare_edits`, documents are dealt into ranges of doc_id, in descending
order, and stream through a task with the document that follows the range.

Defined results: null text is the empty text; a text without anchors takes
every word as one, and a text without words its own bytes as the single
signature; two empty texts are alike (1.0), an empty text and another are not,
and in near_classes they link with nothing; rows without doc_id come after all
others, by text; of rows with equal doc_id the one with the smaller text comes
first; a single document follows itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, U64, Scratch, map_batches, mix, only, partitions, tune, word_hashes
from .ngram_join import Sets, classes, needed

CHAIN = 2
#: Hashes that a fingerprint spells out.
SPELLED = 48
#: Ranges of doc_id for each partition.
RANGES_EACH = 4

# Frequent words of English, German, French and Spanish.
ANCHORS = """
the of and to a in is was for that on are with as be at or by an it this from
der die das und ist in den von zu mit sich des auf ein eine nicht als auch
le la les de du des et en un une est que qui dans pour pas au
el los las y es por con para del se lo como su
""".split()

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each word of letters and digits, without case."""
    data = _FOLD[data]
    n = len(data)
    word = _WORD[data]
    head, tail = word.copy(), word.copy()
    head[1:] &= ~word[:-1]
    tail[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    head[inner], tail[inner - 1] = word[inner], word[inner - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return doc, word_hashes(data, start, end)[0]


def _anchor_hashes() -> np.ndarray:
    data = " ".join(ANCHORS).encode()
    return np.unique(_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[1])


_ANCHOR_HASHES = _anchor_hashes()


def spots(data: np.ndarray, offsets: np.ndarray) -> Sets:
    """Sets of signatures of each text of a block."""
    n = len(offsets) - 1
    doc, h = _words(data, offsets)
    at = np.searchsorted(_ANCHOR_HASHES, h)
    common = _ANCHOR_HASHES[np.minimum(at, len(_ANCHOR_HASHES) - 1)] == h
    bare = np.bincount(doc[common], minlength=n) == 0
    content = np.flatnonzero(~common | bare[doc])
    anchor = np.flatnonzero(common | bare[doc])
    sig = h[anchor]
    following = np.searchsorted(content, anchor, "right")
    for k in range(CHAIN):
        where = np.minimum(following + k, max(0, len(content) - 1))
        nxt = content[where] if len(content) else np.zeros(len(anchor), int)
        ok = (following + k < len(content)) & (doc[nxt] == doc[anchor] if len(content) else False)
        sig = mix(sig + np.where(ok, h[nxt] if len(content) else U64(0), U64(0)) + U64(k + 1))
    wordless = np.flatnonzero((np.bincount(doc, minlength=n) == 0) & (np.diff(offsets) > 0))
    own = [int.from_bytes(hashlib.blake2b(data[offsets[i] : offsets[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in wordless.tolist()]
    return Sets(np.concatenate([doc[anchor], wordless]), np.concatenate([sig, np.array(own, U64)]), n)


def signature_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct signature hashes of each text."""
    raw = [t.encode() for t in texts]
    out: list[np.ndarray] = []
    lo = 0
    while lo < len(raw):
        hi, size = lo + 1, len(raw[lo])
        while hi < len(raw) and size + len(raw[hi]) <= BLOCK_BYTES:
            size += len(raw[hi])
            hi += 1
        s = spots(np.frombuffer(b"".join(raw[lo:hi]), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw[lo:hi]])]))
        out += [s.h[a:b] for a, b in zip(s.edge, s.edge[1:])]
        lo = hi
    return out


def fingerprint(s: np.ndarray) -> str:
    """Size, digest of the whole set, and its smallest hashes."""
    return f"{len(s)}-{hashlib.blake2b(s.tobytes(), digest_size=8).hexdigest()}-" + (s[:SPELLED] >> U64(32)).astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return both / (len(a) + len(b) - both)


def reaches(a: np.ndarray, b: np.ndarray, least: int, steps: int = 4) -> bool:
    """Whether two sorted sets share `least` elements; given up where what is left cannot."""
    found, done, step = 0, 0, -(-len(a) // steps)
    for lo in range(0, len(a), step):
        part = a[lo : lo + step]
        at = np.searchsorted(b[done:], part) + done
        found += int((b[np.minimum(at, len(b) - 1)] == part).sum())
        done = int(at[-1])
        if found >= least:
            return True
        if found + min(len(a) - lo - len(part), len(b) - done) < least:
            return False
    return False


def partition_starts(largest: int) -> np.ndarray:
    """Least lengths of the partitions: linked sets are in the same or in adjacent ones."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(starts[-1] * 5 // 4 + 1)
    return np.array(starts)


class LengthPartitions:
    """The sets of one family by partitions of their length, with an inverted index of each."""

    def __init__(self, h: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> None:
        self.sets, self.sizes, self.n = h, sizes, len(sizes)
        self.edge = np.concatenate([[0], np.cumsum(sizes)])
        self.partition = np.searchsorted(partition_starts(int(sizes.max(initial=0))), sizes, "right")
        self.index: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for p in np.unique(self.partition).tolist():
            at = np.flatnonzero(self.partition[doc] == p)
            at = at[np.argsort(h[at], kind="stable")]
            self.index[p] = (h[at], doc[at])

    def search(self, q: int, among: np.ndarray) -> np.ndarray:
        """Sets that link with set q, of those that `among` marks."""
        mine = self.sets[self.edge[q] : self.edge[q + 1]]
        out = []
        for p in range(self.partition[q] - 1, self.partition[q] + 2):
            if p not in self.index:
                continue
            values, docs = self.index[p]
            first, end = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
            rare = np.argsort(end - first, kind="stable")[: len(mine) - (4 * len(mine) + 4) // 5 + 1]
            near = np.unique(np.concatenate([docs[a:b] for a, b in zip(first[rare].tolist(), end[rare].tolist())]))
            size = self.sizes[near]
            near = near[among[near] & (near != q) & (5 * np.minimum(size, len(mine)) >= 4 * np.maximum(size, len(mine)))]
            out += [y for y in near.tolist() if reaches(mine, self.sets[self.edge[y] : self.edge[y + 1]], int(needed(len(mine) + self.sizes[y])))]
        return np.array(out, int)


def near_classes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n_signatures, component_id): documents whose signature sets have a Jaccard similarity of 0.8, as op6 states its classes."""
    return classes(docs, scratch, make=spots, index=LengthPartitions).withColumnRenamed("n_shingles", "n_signatures")


def with_followers(docs: DataFrame) -> DataFrame:
    """(bin, doc_id, text, guest): the documents of ranges of doc_id, each with the one that follows its last as a guest.

    Ranges come from quantiles of doc_id, a few for each partition, so their
    bounds, first ids and guests are few. Rows without doc_id are a range of their own.
    """
    d = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = RANGES_EACH * partitions(docs.sparkSession)
    at = [i / n for i in range(1, n)]
    bounds = np.unique(np.array(d.agg(F.percentile_approx("doc_id", at, F.lit(10 * n + 10_000))).first()[0] or [], np.int64))

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), "right"))

    bins = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(place(F.coalesce("doc_id", F.lit(0).cast("long"))))
    first = sorted(((r.bin, r.top) for r in d.select("doc_id", bins.alias("bin")).groupBy("bin").agg(F.max("doc_id").alias("top")).collect()), reverse=True)
    # The range after each is the next lower one, and after the lowest the highest.
    tops = docs.sparkSession.createDataFrame([(b, top, first[i - 1][0]) for i, (b, top) in enumerate(first)], "of long, top long, bin long")
    firsts = d.join(F.broadcast(tops), F.col("doc_id").eqNullSafe(F.col("top")))
    guests = firsts.groupBy("bin").agg(F.min("text").alias("text")).select("bin", F.lit(None).cast("long").alias("doc_id"), "text", F.lit(1).alias("guest"))
    rows = d.select(bins.alias("bin"), "doc_id", "text", F.lit(0).alias("guest")).union(guests)
    return rows.repartition(partitions(docs.sparkSession), "bin").sortWithinPartitions("bin", "guest", F.desc_nulls_last("doc_id"), "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edits(ids: list[int | None], mine: list[str], last: str) -> pa.RecordBatch:
    """Rows of documents in their order, of which `last` follows the last one."""
    after = [*mine[1:], last]
    edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(mine, after)]
    sets = signature_sets([*mine, last])
    changed = signature_sets(edited)
    columns = [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in mine], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array([fingerprint(s) for s in sets[:-1]], pa.string()),
        pa.array([fingerprint(s) for s in changed], pa.string()),
        pa.array([likeness(a, b) for a, b in zip(sets, changed)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(sets, sets[1:])], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        mine: list[str] = []
        size = 0
        for batch in batches:
            for doc_id, text, guest in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                if guest or (size > BLOCK_BYTES and len(mine)):
                    yield _edits(ids, mine, text)
                    ids, mine, size = [], [], 0
                if not guest:
                    ids.append(doc_id)
                    mine.append(text)
                    size += len(text)

    return map_batches(with_followers(docs), run, SCHEMA)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(tune(spark).read.parquet(f"{sf_dir}/documents.parquet"))


def fingerprint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near duplicates that op3's sets make, by partitions of length and pruned comparisons."""
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(tune(spark), "fingerprints"))
