"""Session settings and the one place that cuts lineage.

Iterative operators (components, communities, shortest paths) must not let
their plan grow with the number of rounds, and must survive the loss of an
executor. `Rounds` writes each round as a Parquet table under the shared folder
named by ``spark.checkpoint.dir`` and reads it back; a lost executor re-reads
files instead of replaying the loop, and the file sizes give the next round's
joins a real size estimate.
"""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
PARTITIONS_KEY = "spark.sql.shuffle.partitions"
COALESCE_KEY = "spark.sql.adaptive.coalescePartitions.enabled"
ROWS_PER_PARTITION = 500_000
# hashes and ids, most of what wide tables hold, take half their letters that way
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", app: str = "paperweave", **extra: str) -> SparkSession:
    """A local or cluster session with the settings the operators expect."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path as Spark itself would resolve it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


@lru_cache(maxsize=None)
def _root_of(spark: SparkSession, configured: str, application: str) -> str:
    """One folder per application, deleted when the application's JVM ends."""
    fs, where = _filesystem(spark, f"{configured.rstrip('/')}/paperweave-{application}")
    where = fs.makeQualified(where)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return re.sub("^file:/+", "file:///", where.toString())


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder and what is in it; nothing happens where there is none."""
    fs, where = _filesystem(spark, path)
    fs.delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    fs, where = _filesystem(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def checkpoint_root(spark: SparkSession) -> str:
    """This application's folder for round tables, below a place that driver and executors share.

    That is `spark.checkpoint.dir`, or the session's warehouse where it is unset.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.conf.get("spark.sql.warehouse.dir")
    return _root_of(spark, configured, spark.sparkContext.applicationId)


@contextmanager
def partitions_for(spark: SparkSession, rows: int, per: int = ROWS_PER_PARTITION):
    """Shuffles that run inside have at least a partition for every `per` rows, so a task's memory does not grow with the input.

    Gives their number. Where it is more than the session's, adaptive execution
    does not put them together again: it goes by compressed bytes, which say little of rows.
    """
    before, merged = spark.conf.get(PARTITIONS_KEY), spark.conf.get(COALESCE_KEY)
    count = max(int(before), -(-rows // per))
    spark.conf.set(PARTITIONS_KEY, str(count))
    if count > int(before):
        spark.conf.set(COALESCE_KEY, "false")
    try:
        yield count
    finally:
        spark.conf.set(PARTITIONS_KEY, before)
        spark.conf.set(COALESCE_KEY, merged)


def drop_round(df: DataFrame) -> None:
    """Delete the files of a round table, whichever job wrote it; no frame may read them later."""
    if path := getattr(df, "_round_path", ""):
        delete_path(df.sparkSession, path)


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, and known to have none while a query is planned: joins with it fall away before anything is shuffled for them."""
    columns = (c.split() for c in schema.split(", "))
    out = spark.range(1).select(*[F.lit(None).cast(kind).alias(name) for name, kind in columns]).where(F.lit(False))
    out._no_rows = True
    return out


def has_none(df: DataFrame) -> bool:
    """Is the frame known to have no rows, being one of `no_rows` or `Rounds.kept`? Others may have none, too."""
    return getattr(df, "_no_rows", False)


class Rounds:
    """Round tables of one iterative job."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._step = 0

    def cut(self, df: DataFrame) -> DataFrame:
        """Write `df`, return the same rows read back with a one-scan plan."""
        return self.measure(df)[0]

    def measure(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        """Like `cut`, with aggregates of the rows collected while they are written.

        A lost task may be counted twice, so metrics should only steer a loop in
        ways that stay right then (is anything left? did anything change?).
        """
        self._step += 1
        path = f"{self.base}/{self._step:04d}"
        schema, watch = df.schema, None
        if metrics:
            watch = Observation()
            df = df.observe(watch, *[m.alias(name) for name, m in metrics.items()])
        df.write.options(**PACKED).parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._round_path = path
        return out, (watch.get if watch else {})

    def kept(self, df: DataFrame) -> DataFrame:
        """Like `cut`; rows that turn out to be none are known as such when later frames are planned."""
        out = self.cut(df)
        if not out.isEmpty():
            return out
        none = out.where("false")
        none._no_rows = True
        return none

    def bucketed(self, df: DataFrame, column: str) -> DataFrame:
        """Like `cut`, in hash buckets of one column: joins on it move only their other side."""
        self._step += 1
        path, name = f"{self.base}/{self._step:04d}", f"round_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.options(**PACKED).bucketBy(buckets, column).sortBy(column).option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        out._round_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete the files of an earlier round that no later frame reads."""
        path = getattr(df, "_round_path", "")
        if path.startswith(self.base):
            delete_path(self.spark, path)

    def clear(self) -> None:
        """Delete all round tables of the job; no frame may read them later."""
        delete_path(self.spark, self.base)
