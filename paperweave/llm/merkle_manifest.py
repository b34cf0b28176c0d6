"""Operator 12: a Merkle manifest of a dataset, by pivoting children into slot columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperweave.llm.common import fold_of, table
from paperweave.session import Rounds

FANOUT = 2
SLOTS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def written(field: Column) -> Column:
    """A field as leaves hold it: `-` for null, else its UTF-8 byte count, a colon and its value."""
    text = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    """Digest of a row's FIELDS, some of them replaced."""
    return digest(*[written(changed.get(name, F.col(name))) for name in FIELDS])


def placed(rows: DataFrame, tree: str, order: list[str], rounds: Rounds) -> DataFrame:
    """Adds `place`, the rank from 0 within `tree` by `order`, and `n`, the rows of the tree.

    Rows are sorted in ranges of (tree, order) over all tasks and numbered where
    they lie; a row per task and tree makes the numbers global. One tree may hold
    all rows: its ranges are tasks of their own.
    """
    lies = F.monotonically_increasing_id()
    laid = rounds.cut(
        rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("lies", lies)
        .withColumns({"range": F.shiftright("lies", 33), "lies": F.col("lies").bitwiseAND((1 << 33) - 1)})
    )
    sizes = laid.groupBy(tree, "range").agg(F.count("*").alias("rows"), F.min("lies").alias("first"))
    whole = Window.partitionBy(tree)
    before = F.sum("rows").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = rounds.cut(sizes.select(
        tree, "range", "first", F.coalesce(before, F.lit(0)).alias("start"), F.sum("rows").over(whole).alias("n")))
    return laid.join(starts, [tree, "range"]).withColumn("place", F.col("start") + F.col("lies") - F.col("first")).drop(
        "lies", "range", "first", "start")


class Forest:
    """Trees over the rows of (tree, place, n, node, payload): one tree per `tree`, its nodes in order of `place`.

    `fanout` consecutive nodes become one while a tree has several; the last run
    may be shorter, even of one. A tier is one aggregation: a group of `slots`
    consecutive nodes, a power of the fanout, has each of its nodes in a column
    of its own by a conditional aggregate, and the levels above them are hashes
    of neighbouring columns. So a tree of n nodes takes log n to base `slots`
    jobs, and a tier has a `slots`th of the rows of the one below.
    """

    def __init__(self, nodes: DataFrame, fanout: int, slots: int, rounds: Rounds):
        self.fanout, self.rounds, self.tiers = fanout, rounds, []
        self.height = 1
        while fanout ** (self.height + 1) <= slots:
            self.height += 1
        self.slots = fanout ** self.height
        rows, many = nodes, True
        while many:
            tier, seen = rounds.measure(self._tier(rows), most=F.max("n"))
            self.tiers.append(tier)
            rows = tier.select("tree", F.col("group").alias("place"), F.expr(self._left(self.height)).alias("n"),
                               F.col(f"level{self.height}_0").alias("node"), F.lit(None).cast("string").alias("payload"))
            many = (seen["most"] or 0) > self.slots
        self.tops = rows.select("tree", "node")

    def _left(self, levels: int) -> str:
        """Nodes left of n after so many levels."""
        return reduce(lambda left, _: f"((({left}) + {self.fanout - 1}) div {self.fanout})", range(levels), "n")

    def _tier(self, rows: DataFrame) -> DataFrame:
        spread = [F.expr(f"max(CASE WHEN place % {self.slots} = {i} THEN struct(node, payload) END)").alias(f"slot{i}")
                  for i in range(self.slots)]
        tier = rows.groupBy("tree", F.expr(f"place div {self.slots}").alias("group")).agg(F.max("n").alias("n"), *spread)
        columns = [f"slot{i}.payload AS payload{i}" for i in range(self.slots)]
        tier = tier.selectExpr("tree", "group", "n", *columns, *[f"slot{i}.node AS level0_{i}" for i in range(self.slots)])
        for level in range(self.height):
            runs = [self._run(level, i) for i in range(self.slots // self.fanout ** (level + 1))]
            tier = tier.selectExpr("*", *[
                f"CASE WHEN {run[0]} IS NULL OR {self._left(level)} <= 1 THEN {run[0]} ELSE sha2(CAST({_joined(run)} AS BINARY), 256) END"
                f" AS level{level + 1}_{i}" for i, run in enumerate(runs)
            ])
        return tier

    def _run(self, level: int, parent: int) -> list[str]:
        return [f"level{level}_{parent * self.fanout + i}" for i in range(self.fanout)]

    def _siblings(self, slot: int) -> str:
        """Path of one slot within its group: the other columns of its run, before and after it, level by level."""
        path = []
        for level in range(self.height):
            at = slot // self.fanout ** level
            run, own = self._run(level, at // self.fanout), at % self.fanout
            step = f"array(struct({_joined(run[:own])} AS before, {_joined(run[own + 1:])} AS after))"
            path.append(f"CASE WHEN {self._left(level)} > 1 THEN {step} ELSE CAST(array() AS {PATH}) END")
        return ", ".join(path)

    def paths(self, above: DataFrame) -> DataFrame:
        """(tree, place, node, payload, path, ...) of every leaf, `above` giving (tree, path, ...) of every tree's top.

        `path` has a step per level from the leaf to the end of the path above:
        the siblings before and after the node. It is handed down tier by tier,
        so only groups are joined, never leaves.
        """
        more = [c for c in above.columns if c not in ("tree", "path")]
        above = above.withColumn("group", F.lit(0).cast("long"))
        for k, tier in reversed(list(enumerate(self.tiers))):
            slots = F.expr("array(" + ", ".join(
                f"CASE WHEN level0_{i} IS NOT NULL THEN struct(group * {self.slots} + {i} AS place, level0_{i} AS node, "
                f"payload{i} AS payload, concat({self._siblings(i)}, path) AS path) END" for i in range(self.slots)) + ")")
            found = tier.join(above, ["tree", "group"]).select(
                "tree", *more, F.explode(F.filter(slots, lambda s: s.isNotNull())).alias("s")).select("tree", "s.*", *more)
            if not k:
                return found
            above = self.rounds.cut(found.select("tree", F.col("place").alias("group"), "path", *more))
        return above


def _joined(columns: list[str]) -> str:
    """SQL for the columns one after the other, without those that are null."""
    return f"concat({', '.join(f"coalesce({c}, '')" for c in columns)})" if columns else "''"


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["before"], node, step["after"]))


def manifest(docs: DataFrame, tampered: Column | None = None, n_chars: Column | None = None, fanout: int = FANOUT,
             slots: int = SLOTS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): a row per row of `docs`.

    Leaves are digests of doc_id, source, lang, n_chars and text; other columns
    take no part. Per lang they ascend by doc_id, null first, equal ids by leaf;
    every `fanout` consecutive nodes become their digest until one is left, the
    subroot, and the subroots by lang, null first, likewise give the root. The
    proof is the digest of all siblings on the way up, in order; `folded_root` is
    computed from leaf and siblings alone, where `tampered` holds from a leaf with
    `n_chars` instead. An empty table has no rows. Repeated rows are leaves each.
    An empty lang is a lang of its own, not null.
    """
    rounds = Rounds(docs.sparkSession, "merkle")
    changed = F.when(F.coalesce(tampered, F.lit(False)), leaf_of(n_chars=n_chars)) if tampered is not None else F.lit(None)
    leaves = rounds.cut(docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("tree"), "doc_id", leaf_of().alias("node"),
        changed.cast("string").alias("payload"), F.monotonically_increasing_id().alias("spread"),
    ))
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("payload").alias("other"))
    nodes = placed(leaves, "tree", ["doc_id", "node", "spread"], rounds).withColumn("payload", own)
    forest = Forest(nodes.select("tree", "place", "n", "node", "payload"), fanout, slots, rounds)
    tops = placed(
        forest.tops.select(F.lit("").alias("tree"), "node", F.col("tree").alias("payload")), "tree", ["payload"], rounds)
    crown = Forest(tops.select("tree", "place", "n", "node", "payload"), fanout, slots, rounds)
    above = rounds.cut(
        crown.paths(crown.tops.select("tree", F.array().cast(PATH).alias("path"), F.col("node").alias("root"))).select(
            F.col("payload").alias("tree"), "path", F.col("node").alias("subroot"), "root"))
    proof = F.concat_ws("", F.transform("path", lambda s: F.concat(s["before"], s["after"])))
    out = forest.paths(above).select(
        F.col("payload.doc_id").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root",
        F.sha2(proof.cast("binary"), 256).alias("proof_sha256"),
        folded(F.coalesce("payload.other", "node"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return manifest(docs, fold_of(F.col("doc_id"), 7) == 0, F.col("n_chars") + 1)


CRC_TABLE = """crc_bits(k, c, step) AS (SELECT i, i, 0 FROM range(256) t(i)
      UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM crc_bits WHERE step < 8),
    crc_table AS MATERIALIZED (SELECT list(c ORDER BY k) AS t FROM crc_bits WHERE step = 8)"""


def crc32_sql(text: str, table_column: str) -> str:
    """SQL for the unsigned crc32 of a UTF-8 text, from a column of CRC_TABLE."""
    data = f"[('0x' || h)::BIGINT FOR h IN regexp_extract_all(hex(encode({text})), '..')]"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda a, b: xor(a >> 8, {table_column}[xor(a & 255, b) + 1])))"


def _field_sql(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(n_chars if f == "n_chars" else f) for f in FIELDS) + ")"


SQL = f"""WITH RECURSIVE {CRC_TABLE},
    leaves AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_leaf_sql('n_chars')} AS leaf,
        CASE WHEN {crc32_sql('doc_id::VARCHAR', 't')} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} ELSE {_leaf_sql('n_chars')} END AS given
      FROM documents, crc_table),
    placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
      count(*) OVER (PARTITION BY tree) AS n FROM leaves),
    nodes(tree, level, place, n, node) AS (SELECT tree, 0, place, n, leaf FROM placed
      UNION ALL SELECT tree, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY 1, 2, 3, 4),
    subroots AS MATERIALIZED (SELECT tree, level, node, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
    crown(level, place, n, node) AS (SELECT 0, place, n, node FROM subroots
      UNION ALL SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY place)) FROM crown WHERE n > 1 GROUP BY 1, 2, 3),
    steps AS MATERIALIZED (
      SELECT d.doc_id, d.leaf, d.place, a.level AS step, a.n > 1 AND (a.place & 1) = 1 AS is_left, a.node
      FROM placed d JOIN nodes a ON a.tree = d.tree AND a.n > 1 AND a.place = xor(d.place >> a.level, 1)
      UNION ALL SELECT d.doc_id, d.leaf, d.place, s.level + c.level, (c.place & 1) = 1, c.node
      FROM placed d JOIN subroots s ON s.tree = d.tree JOIN crown c ON c.n > 1 AND c.place = xor(s.place >> c.level, 1)),
    tops AS (SELECT s.tree, s.level, s.node AS subroot, c.node AS root, s.level + c.level AS height FROM subroots s, crown c WHERE c.n = 1),
    fold(doc_id, leaf, place, step, node, height) AS (SELECT doc_id, leaf, place, 0, given, height FROM placed JOIN tops USING (tree)
      UNION ALL SELECT f.doc_id, f.leaf, f.place, f.step + 1, sha256(CASE WHEN s.node IS NULL THEN f.node
          WHEN s.is_left THEN f.node || s.node ELSE s.node || f.node END), f.height
        FROM fold f LEFT JOIN steps s ON s.doc_id = f.doc_id AND s.leaf = f.leaf AND s.place = f.place AND s.step = f.step
        WHERE f.step < f.height),
    proofs AS (SELECT doc_id, leaf, place, string_agg(node, '' ORDER BY step) AS p FROM steps GROUP BY 1, 2, 3)
    SELECT d.doc_id, d.leaf, subroot, root, sha256(coalesce(p, '')) AS proof_sha256, f.node AS folded_root, f.node = root AS verified
    FROM placed d JOIN tops USING (tree) JOIN fold f ON f.doc_id = d.doc_id AND f.leaf = d.leaf AND f.place = d.place AND f.step = f.height
    LEFT JOIN proofs ON proofs.doc_id = d.doc_id AND proofs.leaf = d.leaf AND proofs.place = d.place"""
