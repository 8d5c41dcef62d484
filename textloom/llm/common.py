"""Session helpers of the subpackage: inputs, scratch tables in the shared folder, sizes."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is named a local one is set, but in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="textloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


class Scratch:
    """Parquet tables in the shared folder that cut lineage and can be pruned by column.

    Tables live as long as the driver: a lazily returned plan may still read them. ``clear`` removes them earlier,
    once nothing that reads them is left to run.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.count = 0
        self._open = True
        atexit.register(self._at_exit)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count}-{name}"

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(name)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _at_exit(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            self.clear()

    def clear(self) -> None:
        if self._open:
            self._open = False
            self.drop(self.root)


def partitions(docs: DataFrame, each: int = 64 << 20) -> int:
    """Partitions for all texts of docs: as Spark is set, or more where its estimate of the bytes (a file's size, mostly)
    asks for it. Estimates of tables that aren't files say nothing and are left aside."""
    held = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(held, -(-size // each)) if size < 1 << 60 else held


BROADCAST_ROWS = 1_000_000


def chosen(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """rows that have one of the keys (or, by "left_anti", none). Only a counted, small set is broadcast; a larger one is
    a shuffled join."""
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if small else keys, on, how)


def seeded(*cols, seed: int = 0):
    """A 64-bit seeded hash column."""
    return F.xxhash64(F.lit(seed), *cols)
