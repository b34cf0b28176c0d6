"""Operator 5: embedding near-duplicates by a pivot-permutation index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperweave.llm.anchor_simhash import star_edges
from paperweave.llm.common import meet_in_blocks, small_batches, table
from paperweave.operators.components import connected_components
from paperweave.session import Rounds

PIVOTS, MOST_PIVOTS, PIVOTS_PER_ROOT = 1024, 16_384, 4
NEAREST = 8
MIN_SHARED = 2
SAMPLE_PER_PIVOT = 4
MAX_PIVOT_COSINE = 0.7
MIN_COSINE = 0.93
BLOCK = 8_192
ROWS_AT_ONCE = 512


def _unit(vectors: pd.Series) -> np.ndarray:
    flat = np.array(vectors.tolist(), np.float64)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def pivots_for(vectors: int) -> int:
    """A number that grows with the root of the vectors, so lists do too and not in proportion; bounded, as the driver holds it."""
    return min(MOST_PIVOTS, max(PIVOTS, PIVOTS_PER_ROOT * math.isqrt(vectors)))


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """Unit reference points per dimension, spread out, from a bounded sample.

    The sample are the distinct vectors with the lowest hashes, SAMPLE_PER_PIVOT
    for each point. A vector
    becomes a reference point if it is no closer than MAX_PIVOT_COSINE to an
    earlier one, so a crowd of near copies has one, and agrees on its others.
    """
    order = Window.partitionBy("dim").orderBy("a", "b")
    rows = (
        vectors.select("dim", F.col("key.a").alias("a"), F.col("key.b").alias("b"))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE_PER_PIVOT * pivots)
    )
    found = vectors.join(F.broadcast(rows.select(F.struct("a", "b").alias("key"))), "key", "left_semi")
    sample = found.select("dim", "key.a", "key.b", "embedding").toPandas()
    out = {}
    for dim, group in sample.groupby("dim"):
        points = _unit(group.sort_values(["a", "b"])["embedding"])
        free, taken = np.ones(len(points), bool), []
        for i in range(len(points)):
            if free[i] and len(taken) < pivots:
                taken.append(i)
                free &= points @ points[i] < MAX_PIVOT_COSINE
        out[int(dim)] = points[taken]
    return out


def describe(vectors: DataFrame, pivots: dict[int, np.ndarray], nearest: int = NEAREST) -> DataFrame:
    """Adds `near`: the numbers of each vector's nearest reference points, the closest first."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("array<int>")
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = [None] * len(batch)
            sizes = batch.map(len).to_numpy() if len(batch) else np.zeros(0, int)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                points = shared.value[int(dim)]
                for lo in range(0, len(at), 2_000):
                    rows = at[lo:lo + 2_000]
                    cosines = _unit(batch.iloc[rows]) @ points.T
                    k = min(nearest, points.shape[0])
                    for i, best in zip(rows, np.argsort(-cosines, axis=1, kind="stable")[:, :k].astype(np.int32)):
                        out[i] = best
            yield pd.Series(out, dtype=object)

    return vectors.withColumn("near", near("embedding"))


def _compare(min_shared: int, min_cosine: float):
    def compare(members: pd.DataFrame) -> pd.DataFrame:
        """Link counts and a star per local component of one pivot's list, or of two parts of it."""
        members = members.sort_values("node", kind="stable")  # so roots of stars are smallest nodes
        pivot = int(members["pivot"].iloc[0])
        n = len(members)
        vectors = _unit(members["embedding"])
        lists = np.array(members["near"].tolist(), np.int64)
        used, at = np.unique(lists, return_inverse=True)
        has = np.zeros((n, len(used)), np.float32)
        has[np.arange(n)[:, None], at.reshape(lists.shape)] = 1
        before, after = has[:, used < pivot], has[:, used >= pivot]
        copies, half = members["copies"].to_numpy(), members["half"].to_numpy()
        across = half.min() != half.max()
        counted = np.zeros(n, np.int64)

        def links() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for lo in range(0, n, ROWS_AT_ONCE):
                rows = slice(lo, lo + ROWS_AT_ONCE)
                # A pair counts in the list of its first shared pivot only.
                first = before[rows] @ before.T == 0
                shared = after[rows] @ after.T
                candidate = first & (shared >= min(min_shared, lists.shape[1]))
                if across:
                    candidate &= half[rows, None] != half[None, :]
                a, b = np.nonzero(candidate & (vectors[rows] @ vectors.T >= min_cosine))
                a += lo
                keep = a != b
                a, b = a[keep], b[keep]
                np.add.at(counted, a, copies[b])
                yield a, b

        root = star_edges(links(), n)
        nodes = members["node"].to_numpy()
        linked = np.flatnonzero(counted)
        return pd.DataFrame({"node": nodes[linked], "root": nodes[root[linked]], "links": counted[linked]})

    return compare


def near_vectors(
    embeddings: DataFrame, min_cosine: float = MIN_COSINE, nearest: int = NEAREST, min_shared: int = MIN_SHARED,
    pivots: int | None = None,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of (vec_id, label, embedding).

    Vectors of one label link at a cosine of `min_cosine` or more in double
    precision, if they share `min_shared` of their `nearest` reference points, or
    all where there are fewer (equal vectors always link). Retrieval goes through one list per label and
    reference point; a pair is verified and counted in the list of its first
    shared point only, so counts need no list of pairs. Equal vectors are one
    entry with its number of copies. Long lists are cut into blocks. The number
    of reference points follows `pivots_for` unless given.

    Null label, and vectors that are null, empty, zero or hold null or
    non-finite values, link with nothing and are their own component. Vectors
    of different lengths never link. Repeated rows are vectors of their own;
    other columns are ignored.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    rounds = Rounds(spark, "pivots")
    narrow = embeddings.schema["embedding"].dataType.elementType.simpleString() == "float"
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<float>" if narrow else "array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(
        F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )
    key = F.struct(F.xxhash64("label", "embedding").alias("a"), F.xxhash64("embedding", "label", F.lit(1)).alias("b"))
    rows = rows.withColumn("key", F.when(usable, key))
    # Doubles are scaled by the largest value, so neither norms nor products leave their range; floats cannot.
    scaled = F.col("embedding") if narrow else F.transform(
        "embedding", lambda x: x / F.array_max(F.transform("embedding", F.abs)))
    distinct, seen = rounds.measure(
        rows.where(F.col("key").isNotNull()).groupBy("key").agg(
            F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"),
            F.first("embedding").alias("embedding"),
        ).select("key", "least", "copies", "label", scaled.alias("embedding"), F.size("embedding").alias("dim"))
        .withColumn("node", F.monotonically_increasing_id()), rows=F.count("*"),
    )
    points = choose_pivots(distinct, pivots or pivots_for(seen["rows"]))
    listed = (
        describe(distinct, points, nearest)
        .select("node", "copies", "label", "dim", "embedding", "near", F.explode("near").alias("pivot"))
        .withColumn("mixed", F.xxhash64("node"))
    )
    dealt = meet_in_blocks(rounds.cut(listed), ["label", "dim", "pivot"], "mixed", rounds, BLOCK)
    found = rounds.cut(dealt.drop("parts", "mixed").groupBy("label", "dim", "pivot", "block").applyInPandas(
        _compare(min_shared, min_cosine), "node long, root long, links long"
    ))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("node").alias("source"), F.col("root").alias("target"))
    groups = connected_components(distinct.select(F.col("node").alias("id")), edges)
    known = (
        distinct.select("key", "node", "least", "copies")
        .join(groups.withColumnRenamed("id", "node"), "node").join(counts, "node", "left")
    )
    lowest = known.groupBy("component_id").agg(F.min("least").alias("lowest"))
    known = rounds.cut(known.join(lowest, "component_id").select(
        "key", "lowest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    ))
    component = F.coalesce("lowest", "vec_id")
    return rows.select("vec_id", "key").join(known, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"), (F.col("vec_id") == component).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
