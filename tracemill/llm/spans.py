"""Spans in texts: code point offsets, digests, and cheap byte screens."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np

Span = tuple[str, int, int]


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def table_of(chars: str) -> np.ndarray:
    """Which bytes are among these ASCII characters."""
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


def runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least `least` bytes within one text."""
    n = len(inside)
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    head[inner], tail[inner - 1] = inside[inner], inside[inner - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    long = end - start >= least
    return start[long], end[long]


class CodePoints:
    """Byte positions of a block as code point positions within their text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.before = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=self.before[1:])
        self.offsets = offsets

    def at(self, doc: np.ndarray, position: np.ndarray) -> np.ndarray:
        return self.before[position] - self.before[self.offsets[doc]]


class Covered:
    """Tells whether some of a text's spans overlap a stretch, and what they leave of it, by bisection."""

    def __init__(self, spans: list[Span]) -> None:
        pairs = sorted((s, e) for _, s, e in spans)
        self.start = [s for s, _ in pairs]
        self.reach = list(accumulate((e for _, e in pairs), max))

    def free(self, start: int, end: int) -> bool:
        before = bisect_left(self.start, end)
        return not before or self.reach[before - 1] <= start

    def gaps(self, start: int, end: int) -> list[tuple[int, int]]:
        """The pieces of a stretch that no span covers."""
        out = []
        for i in range(bisect_right(self.reach, start), len(self.start)):
            if self.start[i] >= end:
                break
            if self.start[i] > start:
                out.append((start, self.start[i]))
            start = max(start, self.reach[i])
        return [*out, (start, end)] if start < end else out
