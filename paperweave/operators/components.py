"""Iterative graph jobs: connected components and communities.

Every round is written to the shared round folder and read back, so plans stay
short, a lost executor costs one round at most, and the small per-node tables
get broadcast only when their real file size allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.operators.graph import both_ways, induced_subgraph
from paperweave.session import Rounds


def _mark() -> dict:
    """Aggregates that change whenever the set of arcs changes."""
    return {"n": F.count("*"), "x": F.bit_xor(F.xxhash64("hi", "lo"))}


def _large_star(arcs: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    ways = arcs.select("hi", "lo").union(arcs.select("lo", "hi")).toDF("u", "v")
    root = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        ways.where(F.col("v") > F.col("u")).join(root, "u")
        .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    )


def _small_star(arcs: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    root = arcs.groupBy("hi").agg(F.min("lo").alias("m"))
    linked = arcs.join(root, "hi")
    return (
        linked.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where(F.col("hi") != F.col("lo"))
        .union(root.select("hi", "m").toDF("hi", "lo"))
        .distinct()
    )


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component_id) with the smallest node id of the component as its id.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the
    arcs form stars: O(log^2 n) rounds, each a partial aggregate and a join in
    which a hub is only ever on the side that can be split.
    """
    rounds = Rounds(edges.sparkSession, "components")
    arcs, mark = rounds.measure(
        edges.where(F.col("source") != F.col("target"))
        .select(F.greatest("source", "target").alias("hi"), F.least("source", "target").alias("lo"))
        .distinct(), **_mark()
    )
    before = None if mark["n"] else mark
    while mark != before:
        after, new = rounds.measure(_small_star(_large_star(arcs)), **_mark())
        rounds.drop(arcs)
        arcs, before, mark = after, mark, new
    roots = arcs.select(F.col("hi").alias("id"), F.col("lo").alias("component_id"))
    return nodes.select("id").join(roots, "id", "left").select(
        "id", F.coalesce("component_id", "id").alias("component_id")
    )


def largest_component(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of the biggest component among the selected nodes; ties by smallest id."""
    parts = connected_components(selected, induced_subgraph(edges, selected))
    best = parts.groupBy("component_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component_id").limit(1)
    return parts.join(F.broadcast(best), "component_id", "left_semi").select("id")


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community_id) after at most `rounds` synchronous weighted rounds.

    Each node takes the label with the largest total weight around it, the
    smallest label on a tie, so the result is reproducible. It stops when no label
    changes, as later rounds would then give the same. Isolated nodes keep their
    own id. Edges lie in buckets of the end whose label they need, so a round
    moves labels to edges and partial sums to nodes, but no edges.
    """
    table = Rounds(edges.sparkSession, "labels")
    ways = table.bucketed(both_ways(edges, "weight"), "other")
    labels = ways.select("id").distinct().withColumn("community_id", F.col("id"))
    mark = {"x": F.bit_xor(F.xxhash64("id", "community_id"))}
    seen = None
    for _ in range(rounds):
        before, (labels, new) = labels, table.measure(
            ways.join(labels.withColumnRenamed("id", "other"), "other")
            .groupBy("id", "community_id").agg(F.sum("weight").alias("w"))
            .groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("w"), "community_id")).alias("best"))
            .select("id", F.col("best.community_id").alias("community_id")), **mark
        )
        table.drop(before)
        if new == seen:
            break
        seen = new
    return nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("community_id", "id").alias("community_id"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: weighted modularity of a partition."""
    s, t = (communities.select(F.col("id").alias(c), F.col("community_id").alias(f"c_{c}")) for c in ("source", "target"))
    rows = edges.join(s, "source").join(t, "target")
    share = rows.select(
        F.explode(F.array("c_source", "c_target")).alias("c"),
        F.col("weight"),
        (F.when(F.col("c_source") == F.col("c_target"), F.col("weight")).otherwise(0) / 2).alias("inner"),
    )
    per = share.groupBy("c").agg(F.sum("weight").alias("k"), F.sum("inner").alias("w_in"))
    total = F.sum("k") / 2
    return per.agg(
        (F.sum("w_in") / total - F.sum(F.col("k") * F.col("k")) / (4 * total * total)).alias("modularity")
    )
