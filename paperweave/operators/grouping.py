"""Group-wise building blocks that stay parallel when one group is huge.

Everything here assumes that a single key may hold a third of all rows:

* per-key summaries are partial aggregates, then one row per key;
* top-k per key is a ranking window Spark prunes on the map side
  (`WindowGroupLimit`), so a hot key ships at most k rows per input partition;
* pairs inside a group are built cell by cell, a big group being cut into
  blocks whose pairs meet in separate tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperweave.session import Rounds

PAIR_BLOCK = 2_000


def top_k_per_key(
    df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """First `k` rows of every key in the given order; `rank` keeps the position."""
    name = rank or "_rank"
    window = Window.partitionBy(*key).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def latest_row(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in `order`."""
    return top_k_per_key(df, key, order, 1)


def member_counts(df: DataFrame, group: str, member: str) -> DataFrame:
    """(group, member, copies): repeated rows collapse before anything is paired."""
    return (
        df.where(F.col(group).isNotNull() & F.col(member).isNotNull())
        .groupBy(F.col(group).alias("grp"), F.col(member).alias("member"))
        .agg(F.count("*").alias("copies"))
    )


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """(grp, n): rows per group, an upper bound of its distinct members."""
    return df.groupBy(F.col(group).alias("grp")).agg(F.count("*").alias("n"))


def group_pairs(
    members: DataFrame,
    sizes: DataFrame,
    *,
    strict: bool = True,
    carry: Sequence[str] = (),
    block: int = PAIR_BLOCK,
) -> DataFrame:
    """Unordered member pairs of each group, from distinct (grp, member, carry...) rows.

    Output: grp, left, right (left < right, or <= when not strict) and every
    carried column as `<name>_left` / `<name>_right`.

    One small counting job over `sizes` (an upper bound per group) looks for groups
    above `block`. Without any, the plan is a plain equi-join on the group.
    Otherwise the distinct members of those groups are counted and each group of n
    is cut into ceil(n / block) blocks by a hash of the member; every (block, block)
    combination is its own join key: no task sees more than about 2 x `block` rows
    of one group, and every pair is produced exactly once.
    """
    big = sizes.where(F.col("n") > block)
    left, right = F.col("l.member"), F.col("r.member")
    picked = [F.col("l.grp").alias("grp"), left.alias("left"), right.alias("right")]
    for name in carry:
        picked += [F.col(f"l.{name}").alias(f"{name}_left"), F.col(f"r.{name}").alias(f"{name}_right")]
    meet = (F.col("l.grp") == F.col("r.grp")) & (left < right if strict else left <= right)

    if not big.isEmpty():
        exact = group_sizes(members.join(big.select("grp"), "grp", "left_semi"), "grp")
        cells = exact.select("grp", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks"))
        members = (
            members.join(cells, "grp", "left")
            .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            .withColumn("own", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        )
        meet &= (F.col("l.own") == F.col("r.other")) & (F.col("l.other") == F.col("r.own"))
    return members.alias("l").join(members.alias("r"), meet).select(*picked)


def pair_counts(
    df: DataFrame, group: str, member: str, *, strict: bool = True, block: int = PAIR_BLOCK
) -> DataFrame:
    """(left, right, count): how many row pairs of the same group carry both members.

    Repeats inside a group are counted once and multiplied, never paired. The
    collapsed rows are written once: the size check and both sides of the join
    read them back instead of repeating what made them.
    """
    members = Rounds(df.sparkSession, "pairs").cut(member_counts(df, group, member))
    pairs = group_pairs(members, group_sizes(members, "grp"), strict=strict, carry=["copies"], block=block)
    return pairs.groupBy("left", "right").agg(
        F.sum(F.col("copies_left") * F.col("copies_right")).alias("count")
    )


def sorted_sets(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Per key, the distinct non-null values of each column as a sorted array."""
    return df.groupBy(key).agg(
        *[F.sort_array(F.collect_set(c)).alias(c) for c in cols]
    )


def member_overlap(links: DataFrame, pairs: DataFrame, entity: str, member: str) -> DataFrame:
    """Add `overlap`: number of distinct members both `left` and `right` are linked to.

    Starts from the members of `right`, the copies: many copies of one `left` then
    cost their own members each, never those of `left` over and over.
    """
    sets = links.select(entity, member).where(F.col(member).isNotNull()).distinct()
    wanted = pairs.select("left", "right").distinct()
    common = (
        wanted.join(sets.withColumnRenamed(entity, "right"), "right")
        .join(sets.withColumnRenamed(entity, "left"), ["left", member])
        .groupBy("left", "right")
        .agg(F.count("*").alias("overlap"))
    )
    return pairs.join(common, ["left", "right"], "left").withColumn(
        "overlap", F.coalesce("overlap", F.lit(0)).cast("bigint")
    )
