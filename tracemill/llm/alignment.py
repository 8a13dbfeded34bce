"""Tokens of two tokenizers aligned by a dictionary of groups.

The byte offsets at which tokens of both tokenizers end cut a text into groups.
The same few groups (a word as one token here and two there) make up most of any
corpus, so they are interned: a task takes some MB of texts as a block and numbers
the distinct groups of the block, and documents keep these numbers with how often
they have each. Spark then adds the frequencies of equal groups of all blocks,
expands the links of each distinct group once, multiplies them by its frequency,
and counts each linked pair of ids and the best of each B id. What a
group is worth goes back to the blocks that have it by its key, and each block adds
up its documents. No token occurrence is ever shuffled.

Within a group only its ends meet, or they would cut it, so its one link is of its
last tokens.

Defined results: a null, empty or unalignable text (its tokens' bytes are not those of
the space and the text) has no tokens, zeros and '' for its groups; strings of
special tokens are plain text; rows of a repeated or null doc_id stay rows of
their own; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ChunkedBpe, Decoder, vocabulary_path
from .common import Scratch, join_counted, largest, map_batches, narrowed, only, partitions, tune

#: Bytes of text whose groups are numbered together.
BLOCK_TEXT = 8 << 20
#: Bytes of text that a tokenizer takes at once.
ENCODE_TEXT = 1 << 20
#: Bits of an id, and the longest group that is told apart column by column.
ID_BITS, COLUMNS = 20, 16
#: Blocks of a partition when results go back to them.
BLOCKS_EACH = 16
BLOCK_SCHEMA = "doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, kinds array<long>, refs binary, times binary, groups array<string>, counts array<long>"


class Tokenizers:
    """Both tokenizers and the bytes of their tokens; the first encodes chunks that texts share once, as `bpe` does."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = ChunkedBpe(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = Decoder(path_a).table
        piece = self.b.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.length_a, self.length_b = (np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b))

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of each text in both; none where their bytes are not those of space and text."""
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            a, whole = self.a.segment(" " + text), b" " + text.encode()
            same = text and b"".join(map(self.bytes_a.__getitem__, a)) == whole and b"".join(map(self.bytes_b.__getitem__, b)) == whole
            yield (a, b) if same else ([], [])


@lru_cache(maxsize=1)
def _tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def intern(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(number of each group, the distinct groups as text). cut_a, cut_b: where groups start, with the end of all."""
    start_a, start_b, len_a, len_b = cut_a[:-1], cut_b[:-1], np.diff(cut_a), np.diff(cut_b)
    number, names = np.zeros(len(start_a), np.int64), []
    shapes, of_shape = np.unique(len_a << 32 | len_b, return_inverse=True)
    order = np.argsort(of_shape, kind="stable")
    ends = np.searchsorted(of_shape[order], np.arange(len(shapes) + 1))
    for k, shape in enumerate(shapes.tolist()):
        at = order[ends[k] : ends[k + 1]]
        na, nb = shape >> 32, shape & 0xFFFFFFFF
        ids = np.concatenate([a[start_a[at][:, None] + np.arange(na)], b[start_b[at][:, None] + np.arange(nb)]], 1)
        if na + nb <= COLUMNS:
            code = ids[:, 0].astype(np.int64)
            for j in range(1, na + nb):
                code = pd.factorize(code)[0] << ID_BITS | ids[:, j]
        else:
            code = np.array([row.tobytes() for row in ids], object)
        code, _ = pd.factorize(code)
        first = np.zeros(code.max() + 1, np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        number[at] = code + len(names)
        names += [",".join(map(str, r[:na])) + "|" + ",".join(map(str, r[na:])) for r in ids[first].tolist()]
    return number, names


def _block(tok: Tokenizers, doc_ids: list, texts: list[str]) -> pa.RecordBatch:
    """One row for a block of documents: their counts, and their groups as numbers of the block's own."""
    parts, lo = [], 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= ENCODE_TEXT):
            size += len(texts[hi])
            hi += 1
        parts += [(np.array(x, np.int32), np.array(y, np.int32)) for x, y in tok.encode(texts[lo:hi])]
        lo = hi
    n_a, n_b = (np.array([len(p[i]) for p in parts], np.int64) for i in (0, 1))
    a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    end_a, end_b = np.cumsum(tok.length_a[a]), np.cumsum(tok.length_b[b])
    met = np.searchsorted(end_a, end_b)  # the last ends are the same, so all are found
    common = end_a[met] == end_b if len(end_a) else np.zeros(0, bool)
    cut_a, cut_b = (np.concatenate([[0], x + 1]) for x in (met[common], np.flatnonzero(common)))
    number, names = intern(a, b, cut_a, cut_b)
    doc = np.repeat(np.arange(len(parts)), n_a)[cut_a[1:] - 1]
    n_groups = np.bincount(doc, minlength=len(parts))
    digests, lo = [], 0
    for n in n_groups.tolist():
        digests.append(hashlib.sha256(";".join(map(names.__getitem__, number[lo : lo + n].tolist())).encode()).hexdigest() if n else "")
        lo += n
    pairs, times = np.unique(doc * len(names) + number, return_counts=True)
    kinds = np.bincount(pairs // len(names), minlength=len(parts)) if len(pairs) else n_groups
    refs = pairs % len(names) if len(pairs) else pairs
    counts = np.bincount(number, minlength=len(names))
    lists = [doc_ids, n_a, n_b, n_groups, digests, kinds]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    row = [pa.array([x], pa.list_(t)) for x, t in zip(lists, types)]
    row += [pa.array([narrowed(x).tobytes()], pa.binary()) for x in (refs, times)]
    row += [pa.array([names], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(row, [c.split()[0] for c in BLOCK_SCHEMA.split(", ")])


def blocks_of(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """documents -> a row per block of some MB of texts (or one longer text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizers(path_a, path_b)
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = t or ""
                if texts and size + len(t) > BLOCK_TEXT:
                    yield _block(tok, ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield _block(tok, ids, texts)

    return map_batches(only(docs, "doc_id", "text"), run, BLOCK_SCHEMA)


def group_worth(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """(grp, best, total) of each distinct group of entries(grp, n), by the counts of linked pairs.

    best: links whose count is the highest of their B id; total: counts of its links.
    """
    last = lambda side: F.element_at(F.split(F.split("grp", r"\|")[side], ","), -1).cast("int")
    distinct = scratch.keep(entries.groupBy("grp").agg(F.sum("n").alias("n")).withColumns({"a": last(0), "b": last(1)}))
    pairs = distinct.groupBy("a", "b").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    pairs = scratch.keep(pairs)
    highest = pairs.groupBy("b").agg(F.max("total").alias("highest"))  # at most an id of the vocabulary a row
    worth = pairs.join(highest, "b").select("a", "b", (F.col("total") == F.col("highest")).cast("long").alias("best"), "total", "rows")
    return join_counted(distinct.select("grp", "a", "b"), worth, ["a", "b"], "rows", F.col("grp"), largest(pairs, "rows")).select("grp", "best", "total")


def align(docs: DataFrame, scratch: Scratch, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    blocks = scratch.keep(blocks_of(docs, path_a, path_b).select(F.monotonically_increasing_id().alias("block"), "*"))
    entries = blocks.select("block", F.posexplode(F.arrays_zip("groups", "counts")).alias("at", "e")).select("block", "at", F.col("e.groups").alias("grp"), F.col("e.counts").alias("n"))
    worth = group_worth(entries.select("grp", "n"), scratch)
    n = max(partitions(scratch.spark), blocks.count() // BLOCKS_EACH)
    back = entries.select("block", "at", "grp").join(worth, "grp").repartition(n, "block")
    lists = back.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "best", "total"))).alias("w"))
    held = blocks.drop("groups", "counts").repartition(n, "block").join(lists, "block", "left")
    lists = held.select("doc_ids", "n_a", "n_b", "n_groups", "digests", "kinds", "refs", "times", F.col("w.best").alias("best"), F.col("w.total").alias("total"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                list_of = lambda c: batch.column(c)[i].values
                kinds = list_of("kinds").to_numpy()
                doc = np.repeat(np.arange(len(kinds)), kinds)
                refs, times = (np.frombuffer(raw, "<u2" if len(raw) == 2 * len(doc) else "<u4").astype(np.int64) for raw in (batch.column(c)[i].as_py() for c in ("refs", "times")))
                sums = []
                for c in ("best", "total"):
                    out = np.zeros(len(kinds), np.int64)
                    if len(doc):
                        np.add.at(out, doc, list_of(c).to_numpy()[refs] * times)
                    sums.append(pa.array(out))
                groups = list_of("n_groups")
                columns = [list_of("doc_ids"), list_of("n_a"), list_of("n_b"), groups, groups, *sums, list_of("digests")]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return map_batches(lists, run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def pieces_path() -> str:
    """The public piece model of this environment."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, Scratch(tune(spark), "alignment"), vocabulary_path(), pieces_path())
