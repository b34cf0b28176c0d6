"""Hot groups: results must not depend on how a group is cut."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from paperweave.operators.grouping import group_pairs, group_sizes, member_counts, pair_counts, top_k_per_key
from paperweave.operators.positions import assign_author_positions


def hot_rows(seed=2, n=600):
    """A third of all rows in group 0, with repeats."""
    rng = random.Random(seed)
    rows = [(0, rng.randrange(90)) for _ in range(n // 3)]
    return rows + [(rng.randrange(1, 60), rng.randrange(90)) for _ in range(n - n // 3)]


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("block", [2_000, 16, 3])
def test_pair_counts_of_a_hot_group(spark, strict, block):
    rows = hot_rows()
    want = {}
    groups = {}
    for g, m in rows:
        groups.setdefault(g, []).append(m)
    for members in groups.values():
        counts = {m: members.count(m) for m in members}
        for a, b in combinations(sorted(counts), 2):
            want[(a, b)] = want.get((a, b), 0) + counts[a] * counts[b]
        if not strict:
            for a in counts:
                want[(a, a)] = want.get((a, a), 0) + counts[a] ** 2
    df = spark.createDataFrame(rows, "g long, m long")
    got = {(r.left, r.right): r["count"] for r in pair_counts(df, "g", "m", strict=strict, block=block).collect()}
    assert got == want


def test_blocked_pairs_are_cut_by_an_equi_join(spark):
    df = spark.createDataFrame(hot_rows(), "g long, m long")
    pairs = group_pairs(member_counts(df, "g", "m"), group_sizes(df, "g"), block=8)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_top_k_is_pruned_before_the_shuffle(spark):
    df = spark.createDataFrame(hot_rows(), "g long, m long")
    plan = top_k_per_key(df, ["g"], [F.desc("m")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def greedy(rows):
    out = {}
    for pub, who, rank, at in sorted(rows, key=lambda r: (r[0], r[3])):
        given, used = out.setdefault(pub, ({}, set()))
        if who in given:
            continue
        pos = rank if rank is not None and rank >= 1 and rank not in used else next(
            i for i in range(1, len(used) + 2) if i not in used)
        given[who] = pos
        used.add(pos)
    return sorted((pub, who, pos) for pub, (given, _) in out.items() for who, pos in given.items())


@pytest.mark.parametrize("fold_limit, chunk", [(256, 4096), (2, 16), (30, 50)])
def test_author_positions_of_a_huge_publication(spark, fold_limit, chunk):
    rng = random.Random(5)
    rows = []
    for pub, n in enumerate([3, 9, 40, 300, 600]):
        for i in range(n):
            rank = rng.choice([None, 0, i + 1, rng.randrange(1, n + 3), rng.randrange(1, max(2, n // 3)), 10**6 + i])
            rows.append((pub, rng.randrange(2 * n), rank, i * 3))
    df = spark.createDataFrame(rows, "publication_id long, researcher_id long, rank int, arrival long")
    got = sorted(tuple(r) for r in assign_author_positions(df, fold_limit, chunk).collect())
    assert got == greedy(rows)


def test_adaptive_execution_splits_the_hot_side_of_a_label_join(spark):
    """A unique per-key frame joined to rows of which a third share one key."""
    keys = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 60_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
        labels = spark.range(0, 60_000).select(F.col("id").alias("k"), (F.col("id") + 1).alias("label"))
        joined = rows.join(labels, "k")
        assert joined.count() == 60_000
        joined.write.format("noop").mode("overwrite").save()
        result = rows.join(labels, "k")
        result.collect()
        assert "skew=true" in result._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
