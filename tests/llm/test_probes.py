"""Texts on which plain hashes collide, numbers beyond any digit limit, families of form letters."""

import random
import time

import numpy as np
import pytest

from tracemill.llm import embedding_dedup, fingerprints, ngram_join, pii, substring_dedup
from tracemill.llm.common import Scratch, Words, tune


def thue_morse(n, swap=False):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, True)) for n in (512, 1024, 2048, 4096)]


@pytest.mark.parametrize("a, b", PAIRS)
def test_words_that_collide_in_polynomials(spark, docs, a, b):
    tune(spark)
    rest = "some words that both of the documents have in common here ok".split()
    rows = [(1, " ".join([a, *rest])), (2, " ".join([b, *rest]))]
    assert [r.n_removed for r in substring_dedup.remove_repeats(docs(rows)).collect()] == [0, 0]
    few = [(1, " ".join([a] * 5)), (2, " ".join([b] * 5))]
    assert {(r.doc_id, r.component_id) for r in ngram_join.classes(docs(few), Scratch(spark, "t")).collect()} == {(1, 1), (2, 2)}
    x, y = fingerprints.signature_sets([f"the {a} of {b}", f"the {b} of {a}"])
    assert set(x.tolist()) != set(y.tolist())


def test_two_hashes_of_words():
    rng = random.Random(3)
    distinct = sorted({"".join(rng.choice("abcé") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 40, 600]))) for _ in range(4000)})
    raw = " ".join(distinct).encode()
    h1, h2 = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).both_hashes()
    assert len(np.unique(h1)) == len(np.unique(h2)) == len(distinct)
    moved = ("xyz " + " ".join(distinct) + " tail").encode()  # the same wherever a word stands
    g1, g2 = Words(np.frombuffer(moved, np.uint8), np.array([0, len(moved)])).both_hashes()
    assert (g1[1:-1] == h1).all() and (g2[1:-1] == h2).all()


ZEROS = "0" * 10_000


@pytest.mark.parametrize("text, kinds", [
    (f"{ZEROS}.1.1.1", ["ip"]), (f"1.{ZEROS}.{ZEROS}.255", ["ip"]), (f"{ZEROS}1.2.3.{ZEROS}256", []), (f"+{ZEROS}", []), (f"{ZEROS}", []), (f"{ZEROS} 4111 1111 1111 1111", []), (f"+1 {'9' * 10_000}", []), (f"a@{ZEROS}.{ZEROS}", ["email"]),
])
def test_very_long_numbers(spark, docs, text, kinds):
    tune(spark)
    assert [k for k, _, _ in pii.base_spans(text)] == kinds
    found = pii.find(docs([(1, text)])).collect()
    assert len(found) == 1
    kept = pii.redact(docs([(1, text), (2, "clean")])).collect()
    assert {r.doc_id for r in kept} == {1, 2} and next(r.text for r in kept if r.doc_id == 2) == "clean"


def letters(n, seed=1, common=97, own=3):
    rng = random.Random(seed)
    form = [f"w{i}" for i in range(common)]
    gap = common // (own + 1)
    out = []
    for i in range(n):
        words = list(form)
        for k in range(own):
            words.insert((k + 1) * gap + k, f"own{rng.randrange(10**9)}")
        out.append((i, " ".join(words)))
    return out


def test_form_letters_do_not_meet_in_pairs(spark, docs):
    """Alike by 0.794, so no two link; the time grows with the letters, not their pairs."""
    tune(spark)
    took = []
    for n in (200, 500, 2000):
        began = time.time()
        got = ngram_join.classes(docs(letters(n)), Scratch(spark, "t")).collect()
        took.append(time.time() - began)
        assert all(r.component_id == r.doc_id for r in got) and len(got) == n
    assert took[2] < 4 * took[1] + 5


@pytest.mark.parametrize("seed", range(6))
def test_search_in_families(seed):
    """Lists relative to what most sets have give the links of all pairs."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**62, 60)
    sets = [np.unique(np.concatenate([base[rng.random(60) > rng.choice([0.02, 0.15])], rng.integers(0, 2**62, rng.integers(0, 14)), base[:1]])).astype(np.uint64) for _ in range(80)]
    sizes = np.array([len(s) for s in sets])
    lists = ngram_join.Lists(np.concatenate(sets), np.repeat(np.arange(80), sizes), sizes)
    for q in range(80):
        among = rng.random(80) > 0.2
        both = np.array([len(np.intersect1d(sets[q], s)) for s in sets])
        want = [y for y in range(80) if y != q and among[y] and 100 * both[y] >= 80 * (sizes[q] + sizes[y] - both[y])]
        assert sorted(lists.search(q, among).tolist()) == want


def test_vectors_of_any_scale(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e200, 0.99e200], 1), (3, [1.0, 1.0], 1), (4, [1e-200, 1e-200], 1), (5, [5e-324, 5e-324], 1), (6, [-1e308, 1e308], 1), (7, [1.0, 1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.deduplicate(df, Scratch(tune(spark), "t")).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 5: (4, 1), 6: (0, 6), 7: (0, 7)}


def test_pairs_at_the_threshold_count_on_both_sides():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 33))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    threshold = float(x[3] @ x[11])  # a cosine of the table itself
    near = embedding_dedup.reach(x, x, threshold)
    assert (near == near.T).all()
    for lo in range(0, 400, 37):
        assert (embedding_dedup.reach(x[lo : lo + 37], x, threshold) == near[lo : lo + 37]).all()
