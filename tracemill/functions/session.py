"""Session settings, and tables written once and read back."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where none is named, a local master gets a folder of its own; elsewhere that
    would lose tables without a word, so it is an error.
    """
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        got = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Make sure that checkpoint() has a folder; the cluster's own goes first."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return spark


class Scratch:
    """Tables written once and read back, to cut lineage and share results.

    They survive the loss of any executor. A dropped table goes at once, the
    others when the application ends, since results read them until then.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tracemill-{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.kept: dict[int, tuple[DataFrame, str]] = {}
        fs, path = self._file_system(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _file_system(self, path: str):
        """(file system, path) of a folder, as Hadoop has them."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/t{self.count}"

    def keep(self, df: DataFrame) -> DataFrame:
        """Write and reread."""
        return self.keep_all([df])[0]

    def keep_all(self, tables: list[DataFrame]) -> list[DataFrame]:
        """Write and reread tables that do not read each other, all at the same time."""
        places = [(df, self.path()) for df in tables]
        # Each thread gets properties of its own: those of jobs are kept there.
        writes = [inheritable_thread_target(partial(df.write.option("compression", "zstd").parquet, at)) for df, at in places]
        with ThreadPoolExecutor(len(writes)) as pool:
            list(pool.map(lambda write: write(), writes))
        out = [self.spark.read.schema(df.schema).parquet(at) for df, at in places]
        self.kept |= {id(df): (df, at) for df, (_, at) in zip(out, places)}
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete kept tables that nothing reads any more."""
        for t in tables:
            self._delete(self.kept.pop(id(t))[1])

    def close(self) -> None:
        """Delete all of them."""
        self.kept.clear()
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        fs, p = self._file_system(path)
        fs.delete(p, True)
