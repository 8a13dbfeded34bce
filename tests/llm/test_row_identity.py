"""Rows that share an id, and columns with names that the operators use."""

import hashlib
import random

import pytest

from tracemill.llm import mixing, substring_dedup, warc
from tracemill.llm.common import Scratch, tune

from test_operators import brute_substring, sample_texts


def test_substring_of_repeated_ids(spark, docs):
    """Each text of an id loses what it shares itself with smaller ids, and no more."""
    rng = random.Random(12)
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(1, shared), (2, shared + " tail"), (2, " ".join(f"own{i}" for i in range(20))), (2, "short"), (3, "x " * 5 + shared), (3, "x " * 5 + shared)]
    rows += [(rng.randrange(10, 25), t) for t in sample_texts(31, 60)]
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in substring_dedup.remove_repeats(docs(rows)).collect()]
    assert sorted(got) == sorted(brute_substring(rows))
    assert (2, 20, 0, rows[2][1]) in got


def test_warc_of_repeated_ids(spark):
    """A page's record follows its own payload, whatever else has its page_id."""
    rows = [(1, "u", "x" * 200), (3, "u", "x" * 200), (3, "u", "y" * 300), (3, "u", "z" * 300), (4, "u", "z" * 300), (1, "u", "x" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(df, Scratch(tune(spark), "t"))).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kinds = sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in got if r.record_type == "revisit")
    assert kinds == sorted([(3, digest("x" * 200), "revisit", 1), (4, digest("z" * 300), "revisit", 3)])
    assert {bytes(r.payload) for r in got if r.payload is not None} == {t.encode() for _, _, t in rows}
    assert len(got) == len(rows)


def test_mixing_keeps_clashing_columns(spark):
    rows = [(i, f"w{i} " * (i % 5), f"s{i % 3}", 0.5, "mine", i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double, src string, `turn` long")
    out = mixing.mix(df, Scratch(tune(spark), "t"))
    got = out.collect()
    assert out.columns[:6] == df.columns and len(set(out.columns)) == len(out.columns)
    assert got and {(r[3], r[4]) for r in got} == {(0.5, "mine")} and all(r[5] == r[0] for r in got)
