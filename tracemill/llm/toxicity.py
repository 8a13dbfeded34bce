"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector for all thresholds.
x holds the presence of hashed words and word beginnings. The severity of a
text is its expected grade.

Grades are those of the labels' column `grade` where there is one. Else they are
those that two judgements of a labelled text make: 0 is not toxic, 1 toxic, and
2 toxic and of low quality. The model is fitted on a bounded sample of labelled
rows (SAMPLE_ROWS of grade 0 and as many of the others, those with the smallest
hash of doc_id); every document is scored, whole.

Defined results: null, empty or wordless text has no features and severity 0;
a label that is null is no label, a null quality is not low; a document labelled
more than once counts with its largest grade; of rows with one doc_id the
smallest text is fitted on; with no label of either kind the severity is 0 for
all; other columns are ignored; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, _power_tables, blocks, map_batches, mix, only, tune

#: Most labelled rows of each label that the model is fitted on.
SAMPLE_ROWS = 1500
BITS = 18
#: Lengths in bytes of the word beginnings that count as features.
BEGINNINGS = (4, 5, 6)
GRADES = 3
STEPS, RATE, L1 = 160, 0.3, 2e-4
#: A feature is left out below this test value (chi-square, one degree), or if
#: toxic rows have it less than so many times as often as others.
TELLING, RATIO = 20.0, 3.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every letter word and its beginnings, with repeats."""
    data = _FOLD[data]
    n = len(data)
    letter = _LETTER[data]
    head, tail = letter.copy(), letter.copy()
    head[1:] &= ~letter[:-1]
    tail[:-1] &= ~letter[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    head[inner], tail[inner - 1] = letter[inner], letter[inner - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=sums[1:])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    docs, keys = [], []
    for k, length in enumerate((1 << 30, *BEGINNINGS)):
        use = slice(None) if not k else end - start >= length
        a, b = start[use], np.minimum(end[use], start[use] + length)
        h = mix((sums[b] - sums[a]) * down[a] + U64(k + 1))
        docs.append(doc[use])
        keys.append((h >> U64(64 - BITS)).astype(np.int32))
    return np.concatenate(docs), np.concatenate(keys)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for lo, hi, data, offsets in blocks(batch.column(1)):
            doc, key = features(data, offsets)
            both = np.unique(doc.astype(np.int64) << BITS | key)
            cuts = np.searchsorted(both, np.arange(hi - lo + 1, dtype=np.int64) << BITS)
            keys = (both & ((1 << BITS) - 1)).astype("<i4")
            found += [keys[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "grade", "keys"])


def presence(rows: list[np.ndarray], among: np.ndarray) -> np.ndarray:
    """In how many of the chosen rows each feature is."""
    chosen = [r for r, use in zip(rows, among) if use]
    return np.bincount(np.concatenate([*chosen, np.zeros(0, np.int32)]), minlength=1 << BITS)


class OrdinalModel:
    """Shared weights and ordered thresholds of a cumulative-link model."""

    def __init__(self, weights: np.ndarray, theta: np.ndarray) -> None:
        self.weights, self.theta = weights.astype(np.float32), theta

    @staticmethod
    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k."""
        return self.sigmoid(score[:, None] - self.theta)

    @staticmethod
    def telling(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
        """Features that toxic rows have far more often (likelihood ratio test)."""
        n1, n0 = max(1, toxic.sum()), max(1, (~toxic).sum())
        a, b = presence(rows, toxic).astype(float), presence(rows, ~toxic).astype(float)
        p, q = (a + b) / (n1 + n0), 1 - (a + b) / (n1 + n0)
        part = lambda x, e: x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-9))
        g = 2 * (part(a, n1 * p) + part(b, n0 * p) + part(n1 - a, n1 * q) + part(n0 - b, n0 * q))
        return (g > TELLING) & (a / n1 > RATIO * b / n0)

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray, steps: int = STEPS) -> OrdinalModel:
        """Maximum likelihood with an L1 penalty, by full proximal steps.

        Every grade weighs the same in total.
        """
        sizes = np.array([len(r) for r in rows])
        keys = np.concatenate([*rows, np.zeros(0, np.int32)])
        seen = np.bincount(keys, minlength=1 << BITS)
        keep = (seen[keys] >= 3) & cls.telling(rows, grades > 0)[keys]
        row = np.repeat(np.arange(len(rows)), sizes)[keep]
        ids, col = np.unique(keys[keep], return_inverse=True)
        counts = np.bincount(grades, minlength=GRADES)
        share = 1 / np.maximum(counts, 1)[grades] / max(1, (counts > 0).sum())
        w, theta = np.zeros(len(ids)), np.linspace(0.5, 2.5, GRADES - 1)
        gw2, gt2 = np.full(len(ids), 1e-8), np.full(GRADES - 1, 1e-8)
        for _ in range(steps):
            score = np.bincount(row, w[col], len(rows))
            edge = np.concatenate([np.full((len(rows), 1), 1.0), cls.sigmoid(score[:, None] - theta), np.zeros((len(rows), 1))], 1)
            at = np.arange(len(rows))
            upper, lower = edge[at, grades], edge[at, grades + 1]
            p = np.maximum(upper - lower, 1e-12)
            du, dl = upper * (1 - upper) / p * share, lower * (1 - lower) / p * share
            slope = dl - du  # of the loss by the score
            gt = np.zeros(GRADES - 1)
            for k in range(GRADES - 1):
                gt[k] = du[grades == k + 1].sum() - dl[grades == k].sum()
            gw = np.bincount(col, slope[row], len(ids))
            gw2 += gw * gw
            gt2 += gt * gt
            pace = RATE / np.sqrt(gw2)
            w = w - pace * gw
            w = np.sign(w) * np.maximum(np.abs(w) - pace * L1, 0)
            theta = np.maximum.accumulate(theta - RATE / np.sqrt(gt2) * gt)
        weights = np.zeros(1 << BITS)
        weights[ids] = w
        return cls(weights, theta)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labelled documents."""
    if "grade" in labels.columns:
        grade = F.when(F.col("grade").isNotNull(), F.least(F.greatest(F.col("grade"), F.lit(0)), F.lit(GRADES - 1))).cast("int")
    else:
        low = F.coalesce(F.col("quality") == 0, F.lit(False)) if "quality" in labels.columns else F.lit(False)
        grade = F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(low, 2).otherwise(1))
    return labels.select("doc_id", grade.alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on a bounded, documented sample of labelled documents."""
    known = graded(labels)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("grade > 0").orderBy(*order).limit(sample_rows).union(known.where("grade = 0").orderBy(*order).limit(sample_rows))
    # At most twice sample_rows rows, so they fit anywhere.
    rows = only(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("doc_id", "text", "grade")
    got = sorted(map_batches(rows, _sample_features, "doc_id long, grade int, keys binary").collect(), key=lambda r: r.doc_id)
    grades = np.array([r.grade for r in got], int)
    if len(set(grades > 0)) < 2:
        return OrdinalModel(np.zeros(1 << BITS), np.full(GRADES - 1, 30.0))
    return OrdinalModel.fit([np.frombuffer(r["keys"], "<i4") for r in got], grades)


SCHEMA = "doc_id long, severity double, grade int, p_toxic double, toxic boolean"


def _above(model: OrdinalModel, column: pa.Array) -> np.ndarray:
    """P(grade > k) of each text; 0 for texts without words."""
    parts = [np.zeros((0, GRADES - 1))]
    for lo, hi, data, offsets in blocks(column):
        doc, key = features(data, offsets)
        hit = model.weights[key] != 0
        both = np.unique(doc[hit].astype(np.int64) << BITS | key[hit])
        total = np.bincount(both >> BITS, model.weights[both & ((1 << BITS) - 1)], hi - lo)
        wordless = np.bincount(doc, minlength=hi - lo) == 0
        parts.append(np.where(wordless[:, None], 0.0, model.above(total)))
    return np.concatenate(parts)


def clean(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_above(shared.value, batch.column(at))[:, 0] <= 0.5))

    return map_batches(docs, run, docs.schema)


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            above = _above(m, batch.column(1))
            p = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], 1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(above.sum(1)), pa.array(p.argmax(1).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] > 0.5)],
                ["doc_id", "severity", "grade", "p_toxic", "toxic"],
            )

    return map_batches(only(docs, "doc_id", "text"), run, SCHEMA)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
