"""Small pieces shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.session import Rounds

BATCH_BYTES = 8 << 20
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in Arrow batches of at most BATCH_BYTES, so long texts cost no more memory than short ones."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Memory that a task has freed goes back to the system, since its Python worker lives on, idle beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def meet_in_blocks(members: DataFrame, cell: Sequence[str], spread: str, rounds: Rounds, size: int, weight: Column | None = None) -> DataFrame:
    """Copies of the members such that every two members of a cell share a block.

    Adds `block`, the pair of halves that meet there, `half`, this row's own
    one, and `parts`, the number of halves of its cell. A cell of at most `size` members is one block. A larger one is cut
    by `spread` (a column of well mixed integers) into parts of about `size`
    that meet two by two, so no task ever holds more than two parts, whatever
    share of all rows one cell has. Only cells beyond `size` enter the join.
    With `weight`, sizes are sums of it instead of numbers of members.
    """
    hot = (
        members.groupBy(*cell).agg((F.count("*") if weight is None else F.sum(weight)).alias("n")).where(F.col("n") > size)
        .select(*cell, F.ceil(F.col("n") / size).cast("int").alias("parts"))
    )
    hot, seen = rounds.measure(hot, rows=F.count("*"))
    if not seen["rows"]:
        return members.withColumns({"half": F.lit(0), "block": F.lit(0).cast("long"), "parts": F.lit(1)})
    dealt = (
        members.join(hot, list(cell), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("half", F.pmod(F.col(spread), F.col("parts")).cast("int"))
    )
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        *members.columns, "half",
        (F.least("half", "other").cast("long") * F.col("parts") + F.greatest("half", "other")).alias("block"), "parts",
    )
