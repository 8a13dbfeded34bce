"""Byte-level BPE by reuse of content-defined chunks, with exact joins.

A text is cut where a rolling hash of its last bytes meets a pattern, so equal
passages of different documents fall into equal chunks. Each chunk is encoded
once by a worker and kept; the ids of a text are those of its chunks, with
each join repaired: a stretch about the cut is split and encoded again, growing
until the pieces agree with those of the chunks on either side. Where no piece
ends within a chunk (a very long word), the text from the last sure end on stays
open, and is encoded once, when a space closes it. The result is that of
encoding the whole text, in time that grows with its length.

Defined results: null text is the empty text (no ids); special tokens that
stand in a text become their single id, as the tokenizers library does; equal
rows give equal results; other columns of the table are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, _power_tables, map_batches, only, tune

#: Rolling hash over so many bytes; cut on average every AVERAGE bytes.
SPAN, AVERAGE, LEAST, MOST = 16, 1024, 256, 8192
#: A cut moves on by fewer bytes than this to a place where joins are plain.
SNAP = 64
#: Bytes of chunks that a worker keeps encoded.
CACHE_BYTES = 32 << 20
#: Where every piece ends: a space after a printed ASCII character.
CLOSED = re.compile(r"[!-~](?= )")
#: The public pattern of this vocabulary's pre-tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by the public rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def cut_points(data: np.ndarray) -> list[int]:
    """Chunk ends of a UTF-8 text, chosen by its content, at code points."""
    n, cuts, last = len(data), [], 0
    if n > LEAST:
        up, down = _power_tables(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=sums[1:])
        rolling = (sums[SPAN:] - sums[:-SPAN]) * down[: n + 1 - SPAN]
        found = np.flatnonzero((rolling >> U64(40)) % U64(AVERAGE) == 0) + SPAN
        # Where a plain space after a plain character is near, cut before it.
        easy = np.append(np.flatnonzero((data[1:] == 32) & (data[:-1] > 32) & (data[:-1] < 127)) + 1, 2 * n + SNAP)
        near = easy[np.searchsorted(easy, found)]
        found = np.where(near - found < SNAP, near, found)
        for at in [*found.tolist(), n]:
            while at - last > MOST:
                last += MOST
                while last < n and data[last] & 0xC0 == 0x80:
                    last += 1
                cuts.append(last)
            while at < n and data[at] & 0xC0 == 0x80:
                at += 1
            if at - last >= LEAST and at < n:
                cuts.append(at)
                last = at
    return cuts if cuts and cuts[-1] == n else [*cuts, n]


def _tokens(spec: dict) -> tuple[dict[str, int], dict[bytes, int]]:
    """Added tokens, and the bytes of all others, with their ids."""
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    alphabet = _byte_alphabet()
    return added, {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}


def _cost(raw: bytes, ids: list[int] | array) -> int:
    """Bytes that a kept chunk takes, about."""
    return len(raw) + 4 * len(ids) + 250


class ChunkedBpe:
    """Encoder of one vocabulary file, with a cache of chunks."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added, ranks = _tokens(spec)
        merges = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode, self.encode_piece = merges.encode_ordinary, merges._encode_single_piece
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.cache: OrderedDict[bytes, array] = OrderedDict()
        self.cached = 0

    def chunk(self, raw: bytes) -> list[int]:
        kept = self.cache.get(raw)
        if kept is not None:
            self.cache.move_to_end(raw)
            return kept.tolist()
        ids = self.encode(raw.decode())
        self.cache[raw] = array("I", ids)
        self.cached += _cost(raw, ids)
        while self.cached > CACHE_BYTES:
            self.cached -= _cost(*self.cache.popitem(last=False))
        return ids

    def ends(self, text: str) -> list[int]:
        """Ends of the pre-tokenizer's pieces of a text."""
        return [end for _, (_, end) in self.split(text)]

    def upto(self, text: str, ends: list[int], stop: int) -> list[int]:
        """Ids of a text's pieces up to `stop`, each encoded by itself."""
        out, at = [], 0
        for end in ends:
            if end > stop:
                break
            out += self.encode(text[at:end])
            at = end
        return out

    def run(self, text: str) -> list[int]:
        """Ids of a text with pieces of any length, each encoded by itself."""
        out, at = [], 0
        for end in self.ends(text):
            out += self.encode_piece(text[at:end])
            at = end
        return out

    def join(self, left: str, ids: list[int], right: str, more: list[int], whole: bool) -> tuple[list[int], list[int] | None, str]:
        """Repair the join of two encoded texts.

        Returns the ids up to a place where both sides agree, the ids from
        there on (none where they nowhere agree), and the text that the latter
        stand for. `whole`: the right text ends the document.
        """
        # Before a space that follows something else, every piece ends.
        if right[0] == " " and not left[-1].isspace():
            return ids, more, right
        at = max((m.end() for m in CLOSED.finditer(left, max(0, len(left) - 256))), default=0)
        redo = left[at:]
        ids = ids[: len(ids) - len(self.encode(redo))]
        ahead = 64
        while True:
            part = right[:ahead]
            at_end = len(part) == len(right)
            over = self.ends(redo + part)
            own = self.ends(part)
            if not (at_end and whole):
                over, own = over[:-1], own[:-1]
            common = {e - len(redo) for e in over} & set(own)
            if common:
                stop = min(common)
                skip = len(self.upto(part, own, stop))
                return ids + self.upto(redo + part, over, len(redo) + stop), more[skip:], right[stop:]
            if at_end:
                return ids, None, redo + right
            ahead *= 4

    def segment(self, text: str) -> list[int]:
        raw = text.encode()
        done: list[int] = []
        held: list[int] | None = None
        before, start = "", 0
        open_parts: list[str] = []
        for end in cut_points(np.frombuffer(raw, np.uint8)):
            part, last = raw[start:end], end == len(raw)
            now, start = part.decode(), end
            if open_parts:
                close = CLOSED.search(now)
                if close is None and not last:
                    open_parts.append(now)
                    continue
                stop = close.end() if close else len(now)
                done += self.run("".join([*open_parts, now[:stop]]))
                open_parts, before = [], now[stop:]
                held = self.encode(before) if before else None
                continue
            ids = self.chunk(part)
            if held is None:
                held, before = ids, now
                continue
            final, held, before = self.join(before, held, now, ids, last) if before else (held, ids, now)
            done += final
            if held is None:
                open_parts = [before]
        return done + (held or [])

    def encode_text(self, text: str | None) -> list[int]:
        """As the tokenizers library encodes the whole text."""
        if not text:
            return []
        if self.special is None or not self.special.search(text):
            return self.segment(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            if m.start() > at:
                out += self.segment(text[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + (self.segment(text[at:]) if at < len(text) else [])


class Decoder:
    """The bytes of every id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            added, ranks = _tokens(json.load(f))
        self.table = [b""] * (1 + max([*ranks.values(), *added.values()]))
        for token, i in ranks.items():
            self.table[i] = token
        for token, i in added.items():
            self.table[i] = token.encode()

    def decode_ids(self, ids: list[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkedBpe:
    return ChunkedBpe(path)


@lru_cache(maxsize=1)
def _decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """documents -> (doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoder(path)
        for batch in batches:
            ids = [np.array(model.encode_text(t), "<u4") for t in batch.column(1).to_pylist()]
            counts = pa.array([len(i) for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array([i.tobytes() for i in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return map_batches(only(docs, "doc_id", "text"), run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) with the decoded text beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _decoder(path)
        for batch in batches:
            texts = [model.decode_ids(np.frombuffer(i, "<u4").tolist()) for i in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return map_batches(only(encoded, "doc_id", "n_tokens", "ids"), run, "doc_id long, n_tokens long, ids binary, decoded string")


def vocabulary_path() -> str:
    """The public vocabulary file of this environment."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encoded and decoded documents as digests."""
    path = path or vocabulary_path()
    return decode(encode(docs, path), path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
