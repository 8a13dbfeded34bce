"""Personal data: fixed patterns, and a linear-chain CRF over word shapes.

The CRF labels words as e-mail address, network address, card number, telephone
number or none, from the shapes of the word and its neighbours. It is trained by
maximum likelihood on a small labelled table. The chain runs over all words of a
text. Where a word's score for none leads by more than any labels beside it could
make up, none is its label in the best chain, whatever the others are; such
words cut a text into stretches, which Viterbi decodes many at a time in numpy,
with the labels of the whole chain. Words that a match of the patterns touches
are taken out; runs of the words left with one label become spans of kind
`crf_...`. Matches of the patterns stay.

Defined results: null text is empty and has no spans; `kind:start:end` counts
code points with an exclusive end; equal rows give equal results; other columns
are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Words, blocks, map_batches, only, tune
from .spans import CodePoints, Covered, Span, join_spans, sha256, table_of

KINDS = ("email", "ip", "card", "phone")
#: What may stand before the @ of an address, and what follows it.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = table_of("0123456789")
_SEP = table_of(" -")
_TRIM = ".,;:!?()[]{}<>\"'"


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Addresses, found from each @ backwards: linear also in very long words."""
    out: list[Span] = []
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    return out


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, by kind and then start."""
    out = emails(text)
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# ------------------------------------------------------------------- the CRF

#: Bounds of the buckets that shapes count in.
_DIGIT_STEPS = np.array([1, 2, 3, 4, 5, 7, 10, 13, 16, 20])
_LENGTH_STEPS = np.array([3, 5, 9, 14])
_PARTS = (len(_DIGIT_STEPS) + 1, len(_LENGTH_STEPS) + 1, 2, 5, 2, 2, 2)
SHAPES = int(np.prod(_PARTS))
LABELS = 1 + len(KINDS)
#: Columns of the factored features: each part's values for the word, the one before and the one after.
_WIDTH = sum(_PARTS)


def shape_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Shape of each word: digits, length, @, dots, sign, hyphen or bracket, letters."""

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=sums[1:])
        return sums[end] - sums[start]

    parts = (
        np.searchsorted(_DIGIT_STEPS, count(_DIGIT), "right"),
        np.searchsorted(_LENGTH_STEPS, end - start, "right"),
        count(_AT) > 0,
        np.minimum(count(_DOT), 4),
        data[start] == ord("+"),
        count(_JOIN) > 0,
        count(_LETTER) > 0,
    )
    return np.ravel_multi_index([p.astype(np.intp) for p in parts], _PARTS).astype(np.int32)


_AT, _DOT, _JOIN = table_of("@"), table_of("."), table_of("-()")
_LETTER = table_of("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def _design() -> np.ndarray:
    """Indicator columns of every shape's parts."""
    at = np.stack(np.unravel_index(np.arange(SHAPES), _PARTS), 1) + np.concatenate([[0], np.cumsum(_PARTS)[:-1]])
    out = np.zeros((SHAPES, _WIDTH))
    out[np.arange(SHAPES)[:, None], at] = 1
    return out


def labelled_table(n: int = 500, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """Sentences with a label per word, made by rule."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "in", "le", "der", "que", "os", "é", "ñü")) for _ in range(rng.choice((1, 2, 3, 4, 6, 9))))

    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def item() -> tuple[list[str], int]:
        kind = rng.randrange(9)
        if kind == 0:
            return [f"{word()}{rng.choice(('.', '_', ''))}{word()}{rng.choice(('', num(2)))}@{word()}{rng.choice(('.com', '.org', '.co.uk', '.example.net'))}"], 1
        if kind == 1:
            return [".".join(str(rng.randint(1, 255)) for _ in range(4))], 2
        if kind == 2:
            return rng.choice(([num(16)], [num(4) for _ in range(4)], ["-".join(num(4) for _ in range(4))])), 3
        if kind == 3:
            return rng.choice(([f"+{rng.randint(1, 99)}", num(3), num(4), num(3)], [f"+{num(11)}"], [f"+1-{num(3)}-{num(3)}-{num(4)}"], [f"+{rng.randint(1, 99)}", f"({num(3)})", f"{num(3)}-{num(4)}"])), 4
        return [rng.choice((num(rng.randint(1, 5)), f"{rng.randint(1, 9)}.{rng.randint(0, 99)}", f"{rng.randint(1990, 2030)}-{num(2)}-{num(2)}", f"v{num(1)}.{num(1)}.{num(1)}", f"{word()}{num(2)}", f"{num(2)}:{num(2)}", num(8), hexes(32), "key=" + hexes(18), f"{word()}={num(3)}"))], 0

    rows = []
    for _ in range(n):
        words, labels = [], []
        for _ in range(rng.randint(1, 3)):
            plain = [word() for _ in range(rng.randint(2, 6))]
            got, label = item()
            if rng.random() < 0.3:
                got = [*got[:-1], got[-1] + rng.choice(".,;")]
            words += plain + got
            labels += [0] * len(plain) + [label] * len(got)
        words.append(word())
        rows.append((words, [*labels, 0]))
    return rows


class Crf:
    """Scores of labels by shape (the word's, the one before, the one after) and of label pairs."""

    def __init__(self, here: np.ndarray, before: np.ndarray, after: np.ndarray, step: np.ndarray) -> None:
        self.here, self.before, self.after, self.step = here, before, after, step

    def emissions(self, shapes: np.ndarray) -> np.ndarray:
        """(stretch, position, label) for padded shapes; -1 is no word."""
        shifted = lambda table, s: np.where((s >= 0)[..., None], table[np.maximum(s, 0)], 0)
        edge = np.full((len(shapes), 1), -1)
        return shifted(self.here, shapes) + shifted(self.before, np.hstack([edge, shapes[:, :-1]])) + shifted(self.after, np.hstack([shapes[:, 1:], edge]))

    def sure(self, scores: np.ndarray) -> np.ndarray:
        """Words (rows of scores) whose best label is none, whatever labels are beside them.

        With another label instead of none, a chain gains at most the largest
        difference of the steps to it and from it.
        """
        to = np.maximum((self.step - self.step[:, :1]).max(0), 0)
        from_ = np.maximum((self.step - self.step[:1]).max(1), 0)
        return (scores[:, :1] - scores[:, 1:] > (to + from_)[1:] + 1e-9).all(1)

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of many stretches at once (Viterbi); scores: (stretch, position, label)."""
        n, most, _ = scores.shape
        back = np.zeros((n, most, LABELS), np.int8)
        best = scores[:, 0]
        for t in range(1, most):
            through = best[:, :, None] + self.step
            back[:, t] = through.argmax(1)
            best = np.where((t < lengths)[:, None], through.max(1) + scores[:, t], best)
        out = np.zeros((n, most), np.int8)
        now, rows = best.argmax(1), np.arange(n)
        for t in range(most - 1, -1, -1):
            inside = t < lengths
            out[inside, t] = now[inside]
            now = np.where(inside, back[rows, t, now], now)
        return out

    @classmethod
    def fit(cls, shapes: np.ndarray, labels: np.ndarray, lengths: np.ndarray, steps: int = 120, rate: float = 0.25, penalty: float = 1e-3) -> Crf:
        """Maximum likelihood by forward and backward sums, with AdaGrad."""
        design = _design()
        n, most = shapes.shape
        real = np.arange(most) < lengths[:, None]
        pad = np.full((n, 1), -1)
        views = [shapes, np.hstack([pad, shapes[:, :-1]]), np.hstack([shapes[:, 1:], pad])]
        gold = np.eye(LABELS)[np.maximum(labels, 0)] * real[..., None]
        pair_real = real[:, 1:]
        gold_step = np.einsum("ntk,ntl->kl", gold[:, :-1] * pair_real[..., None], gold[:, 1:])
        weights = [np.zeros((_WIDTH, LABELS)) for _ in views]
        step = np.zeros((LABELS, LABELS))
        seen = [np.full_like(w, 1e-8) for w in (*weights, step)]
        lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        for _ in range(steps):
            scores = cls(*[design @ w for w in weights], step).emissions(shapes)
            fwd, bwd = np.zeros_like(scores), np.zeros_like(scores)
            fwd[:, 0] = scores[:, 0]
            for t in range(1, most):
                fwd[:, t] = np.where(real[:, t, None], lse(fwd[:, t - 1, :, None] + step, 1) + scores[:, t], fwd[:, t - 1])
            for t in range(most - 2, -1, -1):
                bwd[:, t] = np.where(real[:, t + 1, None], lse((bwd[:, t + 1] + scores[:, t + 1])[:, None, :] + step, 2), 0)
            total = lse(fwd[:, -1], 1)
            p = np.exp(fwd + bwd - total[:, None, None]) * real[..., None]
            pair = np.exp(fwd[:, :-1, :, None] + step + (scores[:, 1:] + bwd[:, 1:])[:, :, None, :] - total[:, None, None, None])
            diff = p - gold
            grads = []
            for view in views:
                g = np.zeros((SHAPES, LABELS))
                ok = view >= 0
                np.add.at(g, view[ok], diff[ok])
                grads.append(design.T @ g / n)
            grads.append(((pair * pair_real[..., None, None]).sum((0, 1)) - gold_step) / n)
            for w, g, s in zip((*weights, step), grads, seen):
                g += penalty * w
                s += g * g
                w -= rate * g / np.sqrt(s)
        return cls(*[design @ w for w in weights], step)


def padded(rows: list[tuple[list[str], list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shapes, labels and lengths of labelled sentences."""
    lengths = np.array([len(w) for w, _ in rows])
    shapes, labels = (np.full((len(rows), lengths.max()), -1) for _ in range(2))
    for i, (words, gold) in enumerate(rows):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        w = Words(data, np.array([0, len(data)]))
        shapes[i, : len(words)] = shape_ids(data, w.start, w.end)
        labels[i, : len(words)] = gold
    return shapes, labels, lengths


@lru_cache(maxsize=1)
def train(rows: int = 500) -> Crf:
    return Crf.fit(*padded(labelled_table(rows)))


#: Words that are scored at a time.
SCORED = 1 << 18


def word_scores(shapes: np.ndarray, doc: np.ndarray, model: Crf) -> np.ndarray:
    """Scores of the labels of words, by their shapes and those beside them in their text."""
    out = model.here[shapes]
    same = (doc[1:] == doc[:-1])[:, None]
    out[1:] += np.where(same, model.before[shapes[:-1]], 0)
    out[:-1] += np.where(same, model.after[shapes[1:]], 0)
    return out


def chain(shapes: np.ndarray, doc: np.ndarray, model: Crf) -> tuple[np.ndarray, np.ndarray]:
    """(words, labels): labels of the best chain of each text, for all words that may not be none."""
    n = len(shapes)
    open_, kept = [], []
    for lo in range(0, n, SCORED):
        a, b = max(0, lo - 2), min(n, lo + SCORED + 2)
        scores = word_scores(shapes[a:b], doc[a:b], model)
        unsure = ~model.sure(scores)
        # With each go the words beside it, whose label is then known.
        near = unsure.copy()
        near[1:] |= unsure[:-1] & (doc[a + 1 : b] == doc[a : b - 1])
        near[:-1] |= unsure[1:] & (doc[a + 1 : b] == doc[a : b - 1])
        scores[~unsure, 1:] = -1e30
        at = np.flatnonzero(near)
        at = at[(at + a >= lo) & (at + a < lo + SCORED)]
        open_.append(at + a)
        kept.append(scores[at])
    near = np.concatenate([*open_, np.zeros(0, np.int64)])
    scores = np.concatenate([*kept, np.zeros((0, LABELS))])
    labels = np.zeros(len(near), np.int8)
    if not len(near):
        return near, labels
    cut = np.flatnonzero((np.diff(near) > 1) | (np.diff(doc[near]) > 0)) + 1
    first, lengths = np.concatenate([[0], cut]), np.diff(np.concatenate([[0], cut, [len(near)]]))
    # Stretches of about equal length are decoded together.
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        top = lengths[order[at]] * 3 // 2 + 2
        stop = min(int(np.searchsorted(lengths[order], top, "right")), at + max(1, 200_000 // int(top)))
        part = order[at:stop]
        grid = np.zeros((len(part), int(lengths[part].max()), LABELS))
        inside = np.arange(grid.shape[1]) < lengths[part][:, None]
        index = first[part][:, None] + np.arange(grid.shape[1])
        grid[inside] = scores[index[inside]]
        labels[index[inside]] = model.decode(grid, lengths[part])[inside]
        at = stop
    return near, labels


def crf_spans(data: np.ndarray, offsets: np.ndarray, model: Crf, covered: list[Covered]) -> list[tuple[int, Span]]:
    """(text, span) of every run of equally labelled words of a block that no covered stretch touches."""
    w = Words(data, offsets)
    if not len(w.start):
        return []
    near, labels = chain(shape_ids(data, w.start, w.end), w.doc, model)
    hit = np.flatnonzero(labels)
    points = CodePoints(data, offsets)
    doc, at = w.doc[near[hit]], near[hit]
    places = zip(doc.tolist(), points.at(doc, w.start[at]).tolist(), points.at(doc, w.end[at]).tolist())
    hit = hit[np.array([covered[d].free(s, e) for d, s, e in places], bool)]
    if not len(hit):
        return []
    new = np.ones(len(hit), bool)
    new[1:] = (near[hit[1:]] != near[hit[:-1]] + 1) | (labels[hit[1:]] != labels[hit[:-1]]) | (w.doc[near[hit[1:]]] != w.doc[near[hit[:-1]]])
    heads = np.flatnonzero(new)
    tails = np.concatenate([heads[1:], [len(hit)]]) - 1
    doc = w.doc[near[hit[heads]]]
    start, end = w.start[near[hit[heads]]], w.end[near[hit[tails]]]
    raw = data.tobytes()
    out = []
    for d, s, e, k in zip(doc, start.tolist(), end.tolist(), labels[hit[heads]].tolist()):
        piece = raw[s:e].decode("utf-8", "replace")
        s += len(piece) - len(piece.lstrip(_TRIM))
        e -= len(piece) - len(piece.rstrip(_TRIM))
        if s < e:
            out.append((int(d), ("crf_" + KINDS[k - 1], int(points.at(d, s)), int(points.at(d, e)))))
    return out


def find_block(data: np.ndarray, offsets: np.ndarray, texts: list[str], model: Crf) -> list[tuple[list[Span], list[Span]]]:
    """(pattern spans, added spans) of each text of a block."""
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    marked = (digits[offsets[1:]] > digits[offsets[:-1]]).tolist()
    base = [base_spans(t) if m or "@" in t else [] for t, m in zip(texts, marked)]
    added: list[list[Span]] = [[] for _ in texts]
    for d, span in crf_spans(data, offsets, model, [Covered(b) for b in base]):
        added[d].append(span)
    return list(zip(base, added))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_crf long, base_sha256 string, spans string"
ORDER = {k: i for i, k in enumerate((*KINDS, *("crf_" + k for k in KINDS)))}


def find(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """documents -> counts and spans of personal data, one row per row of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train())  # some 100 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            ids, texts, rows = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()], []
            for lo, hi, data, offsets in blocks(batch.column(1)):
                for i, (base, added) in enumerate(find_block(data, offsets, texts[lo:hi], crf), lo):
                    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                    whole = sorted(base + added, key=lambda s: (ORDER[s[0]], s[1]))
                    rows.append((ids[i], *counts, len(added), sha256(join_spans(base)), join_spans(whole)))
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            types = [pa.int64()] * 6 + [pa.string()] * 2
            cols = zip(*rows) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return map_batches(only(docs, "doc_id", "text"), run, SCHEMA)


def redact_text(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.removeprefix('crf_')}]"]
            at = e
        else:
            at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """documents with personal data in text replaced; n_chars follows the text.

    Rows, columns and null texts stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train())
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            column = batch.column(names.index("text"))
            texts = column.to_pylist()
            out = list(texts)
            for lo, hi, data, offsets in blocks(column):
                for i, (base, added) in enumerate(find_block(data, offsets, [t or "" for t in texts[lo:hi]], crf), lo):
                    if base or added:
                        out[i] = redact_text(texts[i], base + added)
            cols = {n: c for n, c in zip(names, batch.columns)} | {"text": pa.array(out, pa.string())}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([n if o is t else len(o) for n, o, t in zip(cols["n_chars"].to_pylist(), out, texts)], pa.int64())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names)

    return map_batches(docs, run, docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(tune(spark).read.parquet(f"{sf_dir}/documents.parquet"))
