"""Searches over vectors, and aligned tokens, against brute force with odd rows."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracemill.llm import alignment, hard_negatives, topk, vectors
from tracemill.llm.common import Scratch, tune

SCHEMA = "vec_id long, embedding array<double>, label int, chunk string, data int, size string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", 3, "s") for i, v, l in rows], SCHEMA)


def whole(v):
    return None if not v or any(x is None or not math.isfinite(256 * x) for x in v) else [math.floor(256 * x) for x in v]


def clipped(s):
    return max(-(2**63), min(2**63 - 1, s))


def dot(a, b):
    return clipped(sum(x * y for x, y in zip(a, b)))


def clouds(seed, n, size=12, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, size))
    x = centres[rng.integers(0, 4, n)] + 0.3 * rng.standard_normal((n, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[: n // 3 if copies else 0] = x[0]
    return [(int(i), [float(c) for c in v], int(rng.integers(0, 3))) for i, v in enumerate(x)]


ODD = [
    (0, [0.5, 0.25], 1), (100, [0.5, 0.25], 1), (200, [-0.5, 0.25], 2), (300, None, 1), (400, [], 1), (500, [None, 1.0], 1), (600, [float("nan"), 1.0], 2), (700, [float("inf"), 1.0], 2),
    (800, [1.0, 2.0, 3.0], 1), (900, [1e306, 1.0], 1), (None, [0.5, 0.5], 1), (1000, [0.5, 0.5], None), (7, [0.5, 0.25], 0), (7, [0.5, 0.25], 0), (100, [0.5, 0.25], 1), (1, [0.4, 0.2], 2), (2, [0.4, 0.2], 2), (14, [0.0, 0.0], 9),
]
HUGE = [(i * 50, [(-1.0) ** i * 3e9 * (i + 1), 1e4 + i, 0.25], i % 2) for i in range(12)] + [(1100 + i, [1e15, 1e15 + i, 1.0], i % 2) for i in range(5)]


def brute_top(rows, every, k=5):
    good = [(i, w) for i, v, _ in rows if i is not None and (w := whole(v))]
    out = []
    for n, (i, w) in enumerate(good):
        if i % every == 0:
            best = sorted((-dot(w, u), j) for m, (j, u) in enumerate(good) if m != n and len(u) == len(w))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("rows", [clouds(1, 3000), clouds(2, 900, copies=1), clouds(3, 3, 2), ODD, HUGE, []])
def test_top_k(spark, rows):
    tune(spark)
    for every in (50, 100):
        got = topk.top_k(table(spark, rows), Scratch(spark, "t"), every)
        assert sorted(map(tuple, got.collect())) == brute_top(rows, every)


def test_terms_are_left_out(spark):
    """Non-essential terms are probed for few vectors only, and far tiles not at all."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.standard_normal((6000, 32)) * np.linspace(1, 0.1, 32))
    block = vectors.Block(x, np.arange(6000), np.zeros(6000, int), np.zeros(6000, int), np.arange(6000))
    queries = vectors.Block(x[:20], np.arange(20), np.zeros(20, int), np.zeros(20, int), np.arange(20))
    got = topk.search(queries, block, 5)
    s = x[:20] @ x.T
    for q in range(20):
        s[q, q] = -np.inf
        want = sorted(range(6000), key=lambda j: (-s[q, j], j))[:5]
        assert [v for a, v in zip(got.column("query_id").to_pylist(), got.column("vec_id").to_pylist()) if a == q] == want


def brute_negatives(rows, every=100, k=5):
    good = [(i, l, w) for i, v, l in rows if i is not None and l is not None and (w := whole(v))]
    out = []
    for n, (i, l, w) in enumerate(good):
        if i % every:
            continue
        others = [(dot(w, u), j, m) for m, (j, lab, u) in enumerate(good) if m != n and lab == l and len(u) == len(w)]
        unlike = [(dot(w, u), j) for j, lab, u in good if lab != l and len(u) == len(w)]
        for ps, p, _ in sorted(others, key=lambda o: (-o[0], o[1]))[:5]:
            inside = sorted((-s, j) for s, j in unlike if 80 * ps <= 100 * s <= 100 * ps)[:k]
            out += [(i, p, r, j, ps, -s) for r, (s, j) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("rows", [clouds(11, 3000), clouds(12, 900, copies=1), clouds(13, 4, 2), ODD, HUGE, []])
def test_negatives(spark, rows):
    tune(spark)
    for every in (100, 50):
        got = hard_negatives.mine(table(spark, rows), Scratch(spark, "t"), every)
        assert sorted(map(tuple, got.collect())) == brute_negatives(rows, every)


def test_relabelled(spark):
    rows = [(0, [1.0], 9), (1, [1.0], 9), (14, [1.0], None), (None, [1.0], 3), (7, None, 2)]
    got = {(r.vec_id, r.label) for r in hard_negatives.relabelled(table(spark, rows)).collect()}
    assert got == {(0, 0), (1, 9), (14, None), (None, 3), (7, 3)}


@pytest.mark.parametrize("seed", [21, 22])
def test_small_shards(spark, seed, monkeypatch):
    """Many chunks, shards and lengths."""
    monkeypatch.setattr(vectors, "CHUNK_BYTES", 256)
    monkeypatch.setattr(vectors, "SHARD_BYTES", 4096)
    tune(spark)
    rows = clouds(seed, 500, 8) + [(i + 500, v, l) for i, v, l in clouds(seed + 1, 300, 3)]
    assert sorted(map(tuple, topk.top_k(table(spark, rows), Scratch(spark, "t"), 50).collect())) == brute_top(rows, 50)
    assert sorted(map(tuple, hard_negatives.mine(table(spark, rows), Scratch(spark, "t")).collect())) == brute_negatives(rows)


# ---------------------------------------------------------------- op 12

PATHS = alignment.vocabulary_path(), alignment.pieces_path()


def brute_alignment(rows):
    tok, plain = alignment.Tokenizers(*PATHS), Tokenizer.from_file(PATHS[0])
    plain.encode_special_tokens = True
    docs, counts = [], Counter()
    for i, text in rows:
        text = text or ""
        a = plain.encode(" " + text, add_special_tokens=False).ids
        b = tok.b.encode(text)
        piece = tok.b.id_to_piece
        bytes_b = [bytes([int(piece(x)[3:5], 16)]) if tok.b.is_byte(x) else piece(x).replace("▁", " ").encode() for x in b]
        if not text or b"".join(bytes_b) != (" " + text).encode():
            docs.append((i, [], [], [], []))
            continue
        ends_a, ends_b = (np.cumsum([len(p) for p in x]).tolist() for x in ([tok.bytes_a[x] for x in a], bytes_b))
        common = sorted(set(ends_a) & set(ends_b))
        groups, links, la, lb = [], [(x, y) for x, e in zip(a, ends_a) for y, f in ([(b[ends_b.index(e)], e)] if e in common else [])], 0, 0
        for e in common:
            ua, ub = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(",".join(map(str, a[la:ua])) + "|" + ",".join(map(str, b[lb:ub])))
            la, lb = ua, ub
        counts.update(links)
        docs.append((i, a, b, groups, links))
    highest = defaultdict(int)
    for (_, y), c in counts.items():
        highest[y] = max(highest[y], c)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(i, len(a), len(b), len(g), len(n), sum(counts[x] == highest[x[1]] for x in n), sum(counts[x] for x in n), digest(g)) for i, a, b, g, n in docs]


MIXED = [
    (1, None), (2, ""), (3, " "), (4, "  \t\n x"), (5, "the cat sat on the mat, the cat's hat"), (5, "the cat sat on the mat, the cat's hat"), (None, "the cat"), (6, "é漢 \U0001f642 <|endoftext|> <s> </s> it's"),
    (7, "a▁b"), (8, "ﬁne ①  x"), (9, " ".join(f"w{i % 97}x{i % 13}" for i in range(3000))), (10, "漢字" * 300), (11, "z" * 5000), (12, "\x00\x01 \x7f"), (13, "1234567890 " * 50),
]


@pytest.mark.parametrize("rows", [MIXED, [], [(1, None)]])
@pytest.mark.parametrize("block", [8 << 20, 64])
def test_alignment(spark, docs, rows, block, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_TEXT", block)
    monkeypatch.setattr(alignment, "ENCODE_TEXT", 200)
    tune(spark)
    got = alignment.align(docs(rows), Scratch(spark, "t"), *PATHS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_alignment(rows), key=str)


def test_intern_tells_groups_apart():
    a, b = np.array([1, 2, 1, 2, 3, 1] + [7] * 20, np.int32), np.array([5, 5, 6, 5] + [8], np.int32)
    number, names = alignment.intern(a, b, np.array([0, 1, 2, 3, 6, 26]), np.array([0, 1, 2, 3, 4, 5]))
    assert [names[i] for i in number] == ["1|5", "2|5", "1|6", "2,3,1|5", ",".join(["7"] * 20) + "|8"]


def test_worth_of_groups(spark):
    entries = spark.createDataFrame([("1|5", 3), ("1|5", 2), ("9,1|5", 4), ("2|5", 9), ("3|6,5", 1)], "grp string, n long")
    got = {r.grp: (r.best, r.total) for r in alignment.group_worth(entries, Scratch(spark, "t")).collect()}
    assert got == {"1|5": (1, 9), "9,1|5": (1, 9), "2|5": (1, 9), "3|6,5": (0, 1)}
