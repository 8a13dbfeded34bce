"""Secret scan: fixed patterns, and a character CNN over every candidate.

A candidate is a run of 16 or more characters of keys and tokens, and such a
piece of what pattern matches leave of a run. A
convolutional network in numpy sees the candidate with the characters around it,
a long one in overlapping windows of which the highest score counts. It is
trained on labelled tables of short and long findings, its scores are calibrated
on held-out findings, and its thresholds are the highest that keep the stated
recall there, of all secrets and of those of each shape (hex, capitals, others). Candidates that it accepts and that no match of the patterns touches
are added as spans of kind `cnn`; matches of the patterns always stay. Of the
runs that a match touches, n_seen counts those that the network saw and
n_agreed those that it accepts, which measures it on findings that are known.

Defined results: null text is empty and has no spans; `kind:start:end` counts
code points with an exclusive end, and covers the whole match; equal rows give
equal results; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import blocks, map_batches, only, tune
from .spans import CodePoints, Covered, Span, join_spans, runs, sha256, table_of

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_CUES = (b"passw", b"secret", b"token", b"apikey", b"api_key")

LEAST = 16
#: Characters before the candidate, and of the candidate and what follows.
BEFORE, AFTER = 24, 56
WIDTH, FILTERS, KERNEL = BEFORE + AFTER, 20, 5
#: Steps between the windows of a long candidate, and what the last one shows behind it.
STRIDE, BEHIND = 28, 8
RECALL = 0.98

_RUN = table_of("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
_TIED = re.compile(r"[A-Za-z0-9+/_=-]+\Z")
_HEX_RUN = table_of("0123456789abcdef")
#: Character classes that the network sees; 0 is outside the text.
_CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "_-", "+/", "=", ":", "\"'", " \t", "\n\r", ".,;()[]{}<>!?")
_CLASS = np.full(256, len(_CLASSES) + 1, np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars.encode())] = _i + 1
#: What a candidate is made of, as bits: digits, a to f, capitals, anything else.
_BITS = np.full(256, 8, np.uint8)
for _i, _chars in enumerate(("0123456789", "abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")):
    _BITS[list(_chars.encode())] = 1 << _i
#: The shape by these bits of the last characters: hex with a letter, capitals with or without digits, others.
SHAPES = ("hex", "capitals", "other")
_SHAPE = np.array([{2: 0, 3: 0, 4: 1, 5: 1}.get(i, 2) for i in range(16)])
CHANNELS = len(_CLASSES) + 3  # the classes, outside, other, and a mark on the candidate


def base_spans(text: str, raw: bytes | None = None, long_hex: bool = True) -> list[Span]:
    """Matches of the fixed patterns, by start and then kind.

    long_hex: whether the text has a run of 32 characters of hex at all.
    """
    raw = text.encode() if raw is None else raw
    found = []
    low = raw.lower()
    if any(c in low for c in _CUES):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in raw:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if long_hex:
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def labelled_findings(n: int, seed: int = 7) -> list[tuple[bytes, int, int, int]]:
    """(text, start, end, is secret): a labelled table made by rule.

    Secrets are random keys after cues of several forms; the others are long
    words in either case, identifiers, numbers, dates, paths and repeated patterns.
    """
    rng = random.Random(seed)
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "in", "ou", "ea", "st", "le")) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        secret = i % 2
        if secret:
            kind = rng.randrange(5)
            body = (
                rng.choice((pick(lower + upper + digit, rng.randint(16, 44)), rng.choice(("AKIA", "ASIA")) + pick(upper + digit, rng.randint(12, 20)))),
                rng.choice(("ghp_", "sk-", "xoxb-", "pk_live_")) + pick(lower + upper + digit, rng.randint(20, 36)),
                pick(lower + upper + digit + "+/", rng.randint(24, 44)) + rng.choice(("", "=", "==")),
                pick(digit + "abcdef", rng.choice((rng.randint(16, 24), rng.randint(16, 64)))),
                pick(lower + upper, rng.randint(20, 40)),
            )[kind]
            cue = rng.choice(("key: ", "token=", "secret: '", "Authorization: Bearer ", "credential ", " ", 'apikey="', "password=", "passwd: "))
        else:
            kind = rng.randrange(9)
            body = (
                "_".join(word() for _ in range(4)) + str(rng.randint(1, 99)),
                "-".join(word() for _ in range(5)) + "-" + str(rng.randint(1, 999)),
                f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{pick(digit, 6)}Z",
                "".join(word() for _ in range(6)) + str(rng.randint(1, 9)),
                "/".join(word() for _ in range(5)) + "/" + str(rng.randint(1, 99)),
                (pick(lower, 2) + pick(digit, 1)) * 8,
                "".join(word() for _ in range(6)),
                "".join(word() for _ in range(7)).upper(),
                pick(digit, rng.randint(16, 24)),
            )[kind].ljust(LEAST, "e")
            body = body if kind != 6 or rng.random() < 0.6 else body.capitalize()
            body = body[: rng.randint(LEAST, 30)] if kind in (6, 7) else body
            cue = rng.choice((" ", "see ", "file: ", "id ", "/", "of "))
        before = " ".join(word() for _ in range(rng.randint(0, 6))) + cue
        text = before + body + rng.choice(("", "'", '"', ".", "\n", " ")) + " ".join(word() for _ in range(rng.randint(0, 6)))
        # As in documents, a candidate is a whole run: with a cue that no other character parts from it.
        start = len(_TIED.sub("", before))
        rows.append((text.encode(), start, len(before) + len(body), secret))
    return rows


def long_findings(n: int, seed: int = 17) -> list[tuple[bytes, int, int, int, int]]:
    """(text, start, end, key start, key end) of runs of up to some 300 characters, made by rule.

    Half of them hold a key: behind a path, a name or a ruler, before one, or all
    of the run. The others are paths, names, rulers and patterns alone, with the
    key's start at its end.
    """
    rng = random.Random(seed)
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "in", "ou", "ea", "st", "le")) for _ in range(rng.randint(1, 4)))

    def plain(size: int) -> str:
        kind = rng.randrange(6)
        joint = "/-_"[kind % 3]
        unit = rng.choice(("-", "=", "_", "-=", "ab1", "=-", pick(lower, 2) + pick(digit, 1)))
        return (unit * size)[:size] if kind > 3 else joint + "".join(word() + (str(rng.randint(1, 99)) if rng.random() < 0.15 else "") + joint for _ in range(size // 5 + 1))

    rows = []
    for i in range(n):
        head = key = tail = ""
        if i % 2:
            chars = rng.choice((lower + upper + digit, lower + upper + digit + "+/", lower + upper + digit + "_-"))
            if rng.random() < 0.3:
                key = pick(chars, rng.randint(57, 300))
            else:
                key = pick(chars, rng.randint(20, 44))
                head = plain(rng.randint(20, 200))
                head += "" if head[-1] in "/-_=" else "="
                tail = rng.choice(("", "", "=", "/" + plain(rng.randint(10, 80))))
        else:
            head = plain(rng.randint(50, 250)) + str(rng.randint(1, 99))
        before = " ".join(word() for _ in range(rng.randint(0, 6))) + rng.choice((" ", "see ", "file: ", "key: ", "of "))
        text = before + head + key + tail + rng.choice(("", "'", '"', ".", "\n", " ")) + " ".join(word() for _ in range(rng.randint(0, 6)))
        at = len(before) + len(head)
        rows.append((text.encode(), len(before), at + len(key) + len(tail), at, at + len(key)))
    return rows


def places(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(candidate, start) of windows along each candidate; the last ends behind it."""
    more = -(-np.maximum(end - start + BEHIND - AFTER, 0) // STRIDE)
    of = np.repeat(np.arange(len(start)), more + 1)
    first = np.cumsum(more + 1) - more - 1
    return of, start[of] + STRIDE * (np.arange(len(of)) - first[of])


def shapes(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The place in SHAPES of each candidate, by its last LEAST characters: a cue may be tied to its beginning."""
    if not len(end):
        return np.zeros(0, np.intp)
    return _SHAPE[np.bitwise_or.reduceat(np.append(_BITS[data], np.uint8(0)), np.stack([end - LEAST, end], 1).ravel())[::2]]


def encode_windows(data: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """(window, position, channel) of candidates in texts [low, high), at their start or where `place` says."""
    at = (start if place is None else place)[:, None] - BEFORE + np.arange(WIDTH)
    inside = (at >= low[:, None]) & (at < high[:, None])
    codes = np.where(inside, _CLASS[data[np.clip(at, 0, max(0, len(data) - 1))]], 0)
    out = np.zeros((*at.shape, CHANNELS), np.float32)
    np.put_along_axis(out, codes[..., None].astype(np.intp), 1, 2)
    out[..., -1] = (at >= start[:, None]) & (at < end[:, None])
    return out


class CharCnn:
    """Convolution, maximum and mean over the window, and a logistic output."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "k": rng.normal(0, 0.15, (KERNEL * CHANNELS, FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "w": rng.normal(0, 0.15, 2 * FILTERS).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.thresholds = np.full(len(SHAPES), 0.5)

    @staticmethod
    def patches(x: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(x, KERNEL, axis=1)
        return view.transpose(0, 1, 3, 2).reshape(len(x), WIDTH - KERNEL + 1, KERNEL * CHANNELS)

    def forward(self, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        act = np.maximum(cols @ self.p["k"] + self.p["b"], 0)
        pooled = np.concatenate([act.max(1), act.mean(1)], 1)
        return pooled @ self.p["w"] + self.p["c"][0], act, pooled

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.01, seed: int = 5) -> None:
        """Adam on the logistic loss."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                cols = self.patches(x[batch])
                z, act, pooled = self.forward(cols)
                d = ((1 / (1 + np.exp(-z)) - y[batch]) / len(batch)).astype(np.float32)
                g = {"w": pooled.T @ d, "c": d.sum(keepdims=True)}
                back = d[:, None] * self.p["w"]
                grad = np.repeat(back[:, None, FILTERS:] / act.shape[1], act.shape[1], 1)
                top = act.argmax(1)
                np.put_along_axis(grad, top[:, None], np.take_along_axis(grad, top[:, None], 1) + back[:, None, :FILTERS], 1)
                grad *= act > 0
                g["k"] = cols.reshape(-1, cols.shape[2]).T @ grad.reshape(-1, FILTERS)
                g["b"] = grad.sum((0, 1))
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(self.patches(part))[0] for part in np.array_split(x, max(1, len(x) // 128))]) if len(x) else np.zeros(0)

    def calibrate(self, x: np.ndarray, y: np.ndarray, of: np.ndarray, shape: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling, then the highest thresholds that keep the recall of all secrets and of each shape's.

        of: the finding of each window, in order. shape: that of each finding.
        """
        z = best(self.raw(x), of)
        a, b = 1.0, 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            a, b = a - 0.05 * ((p - y) * z).mean(), b - 0.05 * (p - y).mean()
        self.slope, self.shift = a, b
        p = best(self.probability(x), of)

        def keeps(use: np.ndarray, otherwise: float) -> float:
            good = np.sort(p[(y == 1) & use])
            return float(good[int((1 - recall) * len(good))]) if len(good) else otherwise

        self.threshold = keeps(np.ones(len(y), bool), 0.5)
        self.thresholds = np.array([min(self.threshold, keeps(shape == i, self.threshold)) for i in range(len(SHAPES))])

    def accepts(self, p: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Which candidates of these probabilities and shapes are secrets."""
        return p >= self.thresholds[shape]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))


def best(scores: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The highest of each candidate's windows; `of` is sorted."""
    return np.maximum.reduceat(scores, np.flatnonzero(np.diff(of, prepend=-1))) if len(of) else scores


def windows_of(findings: list[tuple[bytes, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(f[0] for f in findings), np.uint8)
    edge = np.concatenate([[0], np.cumsum([len(f[0]) for f in findings])])
    start, end = (edge[:-1] + [f[i] for f in findings] for i in (1, 2))
    return encode_windows(data, edge[:-1], edge[1:], start, end), np.array([f[3] for f in findings], np.float32)


def long_windows(findings: list[tuple[bytes, int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of long findings, the finding of each, and how many characters of its key each shows."""
    data = np.frombuffer(b"".join(f[0] for f in findings), np.uint8)
    edge = np.concatenate([[0], np.cumsum([len(f[0]) for f in findings])])
    start, end, key, stop = (edge[:-1] + [f[i] for f in findings] for i in range(1, 5))
    of, place = places(start, end)
    shown = np.minimum(place + AFTER, stop[of]) - np.maximum(place - BEFORE, key[of])
    return encode_windows(data, edge[of], edge[of + 1], start[of], end[of], place), of, np.maximum(shown, 0)


def shapes_of(findings: list[tuple]) -> np.ndarray:
    edge = np.cumsum([0, *(len(f[0]) for f in findings)])[:-1]
    return shapes(np.frombuffer(b"".join(f[0] for f in findings), np.uint8), edge + [f[2] for f in findings])


@lru_cache(maxsize=1)
def train(rows: int = 3200, long_rows: int = 800) -> CharCnn:
    """Fit on labelled findings, calibrate on as many others.

    A window of a long finding is one of a secret if it shows LEAST characters of
    the key at least; windows that show fewer teach nothing.
    """
    x, y = windows_of(labelled_findings(rows))
    wide, _, shown = long_windows(long_findings(long_rows))
    use = (shown == 0) | (shown >= LEAST)
    model = CharCnn()
    model.fit(np.concatenate([x, wide[use]]), np.concatenate([y, (shown[use] > 0).astype(np.float32)]))
    short, long = labelled_findings(rows, seed=29), long_findings(long_rows, seed=31)
    x, y = windows_of(short)
    wide, of, _ = long_windows(long)
    secret = np.array([f[4] > f[3] for f in long], np.float32)
    model.calibrate(np.concatenate([x, wide]), np.concatenate([y, secret]), np.concatenate([np.arange(rows), of + rows]), shapes_of(short + long))
    return model


def scan_block(data: np.ndarray, offsets: np.ndarray, texts: list[str], model: CharCnn) -> list[tuple[list[Span], list[Span], int, int]]:
    """(pattern spans, added spans, runs with pattern spans, those that the network accepts) of each text of a block."""
    raw = data.tobytes()
    hexes = np.zeros(len(texts), bool)
    hexes[np.searchsorted(offsets, runs(_HEX_RUN[data], offsets, 32)[0], "right") - 1] = True
    base = [base_spans(t, raw[a:b], h) for t, a, b, h in zip(texts, offsets.tolist(), offsets[1:].tolist(), hexes.tolist())]
    added: list[list[Span]] = [[] for _ in texts]
    seen, agreed = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    start, end = runs(_RUN[data], offsets, LEAST)
    if len(start):
        doc = np.searchsorted(offsets, start, "right") - 1
        points = CodePoints(data, offsets)
        covered = {d: Covered(base[d]) for d in np.unique(doc).tolist()}
        # Runs are of ASCII, where a byte is a code point.
        pieces = []
        for d, at, s, e in zip(doc.tolist(), start.tolist(), points.at(doc, start).tolist(), points.at(doc, end).tolist()):
            free = [(a, b, 0) for a, b in covered[d].gaps(s, e) if b - a >= LEAST]
            if free != [(s, e, 0)]:
                free.append((s, e, 1))
            pieces += [(d, at + a - s, at + b - s, a, b, known) for a, b, known in free]
        doc, start, end, s, e, known = np.array(pieces, np.int64).reshape(-1, 6).T
        of, place = places(start, end)
        p = np.zeros(len(of))
        for part in np.array_split(np.arange(len(of)), max(1, len(of) // 512)):
            if len(part):
                c = of[part]
                p[part] = model.probability(encode_windows(data, offsets[doc[c]], offsets[doc[c] + 1], start[c], end[c], place[part]))
        accepted = model.accepts(best(p, of), shapes(data, end))
        np.add.at(seen, doc[known == 1], 1)
        np.add.at(agreed, doc[(known == 1) & accepted], 1)
        for i in np.flatnonzero(accepted & (known == 0)).tolist():
            added[doc[i]].append(("cnn", int(s[i]), int(e[i])))
    return list(zip(base, added, seen.tolist(), agreed.tolist()))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_cnn long, n_seen long, n_agreed long, base_sha256 string, spans string"


def scan(docs: DataFrame, model: CharCnn | None = None) -> DataFrame:
    """documents -> counts and spans of secrets, one row per row of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train())  # some kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            ids, texts, rows = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()], []
            for lo, hi, data, offsets in blocks(batch.column(1)):
                for i, (base, added, seen, agreed) in enumerate(scan_block(data, offsets, texts[lo:hi], net), lo):
                    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                    whole = sorted(base + added, key=lambda s: (s[1], (*KINDS, "cnn").index(s[0])))
                    rows.append((ids[i], *counts, len(added), seen, agreed, sha256(join_spans(base)), join_spans(whole)))
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            types = [pa.int64()] * 7 + [pa.string()] * 2
            cols = zip(*rows) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return map_batches(only(docs, "doc_id", "text"), run, SCHEMA)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(tune(spark).read.parquet(f"{sf_dir}/documents.parquet"))
