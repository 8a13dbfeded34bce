"""Records of delimited files whose quoted cells may hold line breaks, cut by many tasks.

A line leads from outside of quotes, or from inside, to one of both; so a line is
one of four functions, and so is any run of lines. Each task composes the lines of
its block of a file; the functions of the blocks before tell in which state a block
begins, and how many records do; then each task cuts its own block. Lines of
records with breaks alone are shuffled, to be put together. No file is read
by one task, whatever quotes it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Blocks whose states are broadcast to the lines (some 100 bytes each); beyond, they are joined.
BROADCAST_BLOCKS = 200_000


def _ends_inside(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a line that begins outside, or inside, of a quoted cell ends inside of one."""
    s = re.escape(sep)
    body = r'(?:[^"]|"")*+'
    cell = rf'(?:"{body}"[^{s}]*+|[^"{s}][^{s}]*+)?+'
    opened = rf'(?:{cell}{s})*+"{body}'
    return line.rlike(f"^{opened}$"), line.rlike(f'^{body}$') | line.rlike(f'^{body}"[^{s}]*+{s}{opened}$')


def _before(outside: np.ndarray, inside: np.ndarray, first: int) -> np.ndarray:
    """The state before each line of a run, and after it, where the first begins in `first`."""
    n = len(outside)
    constant = outside == inside
    swaps = np.concatenate([[0], np.cumsum(outside & ~inside)])  # outside leads inside and the other way round
    last = np.maximum.accumulate(np.concatenate([[-1], np.where(constant, np.arange(n), -1)]))
    known = last >= 0
    at = np.maximum(last, 0)
    base = np.where(known, outside[at] if n else 0, first)
    since = swaps - np.where(known, swaps[np.minimum(at + 1, n)], 0)
    return (base.astype(np.int64) + since) % 2


class _Block:
    """The lines of a block, batch by batch, from either state at its start."""

    def __init__(self) -> None:
        self.state, self.starts = [0, 1], [0, 0]

    def add(self, outside: np.ndarray, inside: np.ndarray, blank: np.ndarray) -> None:
        for k in (0, 1):
            s = _before(outside, inside, self.state[k])
            self.starts[k] += int(((s[:-1] == 0) & ~blank).sum())
            self.state[k] = int(s[-1])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The runs of lines of one block (file, at) in a batch."""
    file, at = batch.column("file").dictionary_encode(), batch.column("at").to_numpy()
    code = file.indices.to_numpy()
    cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (at[1:] != at[:-1])) + 1).tolist(), len(at)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield (batch.column("file")[lo].as_py(), int(at[lo])), batch.slice(lo, hi - lo)


def _bools(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(bool)


def block_functions(lines: DataFrame) -> DataFrame:
    """(file, at, exit0, exit1, starts0, starts1): where each block leads, and records that start in it, from either state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], _Block] = {}
        for batch in batches:
            for key, part in _runs(batch):
                held.setdefault(key, _Block()).add(_bools(part, "outside"), _bools(part, "inside"), _bools(part, "blank"))
        columns = [[f for f, _ in held], [a for _, a in held], *[[b.state[k] for b in held.values()] for k in (0, 1)], *[[b.starts[k] for b in held.values()] for k in (0, 1)]]
        types = [pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["file", "at", "exit0", "exit1", "starts0", "starts1"])

    return lines.select("file", "at", "outside", "inside", "blank").mapInArrow(run, "file string, at long, exit0 long, exit1 long, starts0 long, starts1 long")


def block_states(functions: DataFrame) -> DataFrame:
    """(file, at, state, records): the state in which each block begins, and the records of all files that start before it.

    A block leads to the same state from either, or keeps or swaps it; so its state
    follows from the last of the first kind before it and the swaps since.
    """
    file = W.Window.partitionBy("file").orderBy("at")
    upto, earlier = file.rowsBetween(W.Window.unboundedPreceding, 0), file.rowsBetween(W.Window.unboundedPreceding, -1)
    swaps = F.sum(F.when((F.col("exit0") == 1) & (F.col("exit1") == 0), 1).otherwise(0)).over(upto)
    df = functions.withColumn("swaps", swaps)
    fixed = F.last(F.when(F.col("exit0") == F.col("exit1"), F.struct("exit0", "swaps")), ignorenulls=True).over(earlier)
    df = df.withColumn("fixed", fixed).withColumn("now", F.coalesce(F.lag("swaps").over(file), F.lit(0)))
    state = F.when(F.col("fixed").isNull(), F.col("now")).otherwise(F.col("fixed.exit0") + F.col("now") - F.col("fixed.swaps")) % 2
    df = df.withColumn("state", state).withColumn("starts", F.when(F.col("state") == 0, F.col("starts0")).otherwise(F.col("starts1")))
    files = df.groupBy("file").agg(F.sum("starts").alias("all"))
    files = files.select("file", (F.sum("all").over(W.Window.orderBy("file")) - F.col("all")).alias("files_before"))  # a row per file
    return df.join(files, "file").select("file", "at", "state", (F.col("files_before") + F.sum("starts").over(upto) - F.col("starts")).alias("records"))


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, record, text): the records of delimited files, numbered from 1 through all files in the order of their names.

    Empty lines outside of quotes are no records. Line breaks within one are "\\n".
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    outside, inside = _ends_inside(F.col("value"), sep)
    lines = raw.select("*", outside.alias("outside"), inside.alias("inside"), (F.trim("value") == "").alias("blank"))
    states = block_states(block_functions(lines)).checkpoint()
    if states.count() <= BROADCAST_BLOCKS:
        lines = lines.join(F.broadcast(states), ["file", "at"])  # lines stay in their order
    else:
        lines = lines.withColumn("line", F.monotonically_increasing_id()).join(states, ["file", "at"]).sortWithinPartitions("file", "at", "line").drop("line")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for key, part in _runs(batch):
                state, count, line = held.get(key) or [part.column("state")[0].as_py(), part.column("records")[0].as_py(), 0]
                s = _before(_bools(part, "outside"), _bools(part, "inside"), state)
                starts = (s[:-1] == 0) & ~_bools(part, "blank")
                number = count + np.cumsum(starts)
                held[key] = [int(s[-1]), int(number[-1]), line + len(starts)]
                kept = pa.array(starts | (s[:-1] == 1))
                columns = [part.column("file"), part.column("at"), pa.array(number), pa.array(line + np.arange(len(starts))), pa.array(starts & (s[1:] == 0)), part.column("value")]
                yield pa.RecordBatch.from_arrays([c.filter(kept) for c in columns], ["file", "at", "record", "line", "whole", "text"])

    pieces = lines.select("file", "at", "value", "outside", "inside", "blank", "state", "records").mapInArrow(cut, "file string, at long, record long, line long, whole boolean, text string")
    joined = pieces.where("NOT whole").groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line", "text"))), lambda x: x.text), "\n").alias("text"))
    return pieces.where("whole").select("file", "record", "text").unionByName(joined)
