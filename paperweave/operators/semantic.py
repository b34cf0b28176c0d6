"""Nearest-neighbour graph over embedding vectors."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweave.functions.payload import publication_year
from paperweave.functions.text import nonblank, normalize_text, publication_label
from paperweave.operators.grouping import sorted_sets, top_k_per_key
from paperweave.session import Rounds

BLOCK_ROWS = 4_096
SLAB_ROWS = 512
SCORE_DIGITS = 9
LSH_TABLES = 8
LSH_TABLES_PER_ROOT = 3
LSH_BITS = 32


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit-length float64 rows of a list<float> column without nulls."""
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
    lengths = pa.compute.list_value_length(flat)
    if flat.null_count or flat.flatten().null_count or pa.compute.count_distinct(lengths).as_py() > 1:
        raise ValueError("vectors must have one length and no nulls")
    rows = np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1, norms)


def _best(scores: np.ndarray, ids: np.ndarray, m: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's m best scores at or above the threshold; ties by smaller id.

    Rounding keeps the order, so only the scores near a row's m-th are rounded.
    """
    keep = scores >= threshold
    floor = None
    if scores.shape[1] > m:
        floor = np.round(np.partition(scores, scores.shape[1] - m, axis=1)[:, -m], SCORE_DIGITS)
        keep &= scores >= (floor - 10.0 ** -SCORE_DIGITS)[:, None]
    row, col = np.nonzero(keep)
    shown = np.round(scores[row, col], SCORE_DIGITS)
    if floor is not None:
        high = shown >= floor[row]
        row, col, shown = row[high], col[high], shown[high]
    order = np.lexsort((ids[col], -shown, row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(scores.shape[0]))
    within = np.arange(len(row)) - first[row]
    return row[within < m], col[within < m]


def _hits(src: np.ndarray, dst: np.ndarray, scores: np.ndarray, row, col, kind: pa.DataType) -> pa.Table:
    return pa.table({
        "source": pa.array(src[row], type=kind),
        "target": pa.array(dst[col], type=kind),
        "score": np.round(scores[row, col], SCORE_DIGITS),
    })


def _best_among(ids: np.ndarray, rows: np.ndarray, others: np.ndarray, against: np.ndarray, m: int, threshold: float,
                kind: pa.DataType) -> pa.Table:
    """Best m targets of each row among other rows, a slab of scores at a time."""
    found = [_hits(ids[:0], others, rows[:0] @ against.T, [], [], kind)]
    for at in range(0, len(rows), SLAB_ROWS):
        scores = rows[at:at + SLAB_ROWS] @ against.T
        found.append(_hits(ids[at:at + SLAB_ROWS], others, scores, *_best(scores, others, m, threshold), kind))
    return pa.concat_tables(found)


def _best_inside(ids: np.ndarray, rows: np.ndarray, m: int, threshold: float, kind: pa.DataType) -> pa.Table:
    """Best m targets of each row among all rows, a slab of scores at a time."""
    return _best_among(ids, rows, ids, rows, m, threshold, kind)


def _exact_hits(vectors: DataFrame, m: int, threshold: float, block_rows: int) -> DataFrame:
    """Best m targets of each vector within every pair of blocks.

    Vectors are dealt into equal blocks by a hash of their id; a group holds two
    blocks, multiplies slabs of one with the other, each way, and emits at most m
    rows per vector. Memory per task is fixed by the block and slab sizes, copies of
    one vector are spread over all blocks, and no pair of rows is ever materialized.
    """
    blocks = max(1, math.ceil(vectors.count() / block_rows))
    kind = vectors.schema["id"].dataType
    arrow = pa.int64() if isinstance(kind, T.LongType) else pa.string()
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    cells = (
        vectors.select("id", "embedding", own.alias("own"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select("id", "embedding", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    )

    def kernel(key, table):
        lo, hi = key[0].as_py(), key[1].as_py()
        ids = np.asarray(table.column("id").to_numpy(zero_copy_only=False))
        rows, own_block = _matrix(table.column("embedding")), np.asarray(table.column("own"))
        a, b = own_block == lo, own_block == hi
        found = [_best_among(ids[a], rows[a], ids[b], rows[b], m, threshold, arrow)]
        if lo != hi:
            found.append(_best_among(ids[b], rows[b], ids[a], rows[a], m, threshold, arrow))
        return pa.concat_tables(found)

    schema = f"source {kind.simpleString()}, target {kind.simpleString()}, score double"
    # cells are small and heavy: adaptive execution, which goes by bytes, must not put them together
    return cells.repartition(blocks * (blocks + 1) // 2, "lo", "hi").groupBy("lo", "hi").applyInArrow(kernel, schema)


def _plane(table: int, bit: int, dims: int) -> list[int]:
    """+1 or -1 per dimension, from an md5 that any engine can restate."""
    return [1 if hashlib.md5(f"{table}:{bit}:{d}".encode()).hexdigest()[0] >= "8" else -1 for d in range(dims)]


def _global_rank(df: DataFrame, by: str, order: list[str], rounds: Rounds) -> DataFrame:
    """Add `rank`: place from 0 of each row among the rows of its `by`, in `order`, over all partitions.

    The rows are sorted in ranges over all tasks; a task's rows are numbered where
    they lie, and the ranges' sizes, a row per task and key, make the numbers global.
    """
    lies = F.monotonically_increasing_id()
    sorted_rows = rounds.cut(
        df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("lies", lies)
        .withColumns({"part": F.shiftright("lies", 33), "lies": F.col("lies").bitwiseAND((1 << 33) - 1)})
    )
    sizes = sorted_rows.groupBy(by, "part").agg(F.count("*").alias("n"), F.min("lies").alias("first"))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(by, "part", "first", F.coalesce(before, F.lit(0)).alias("start"))
    return sorted_rows.join(starts, [by, "part"]).withColumn(
        "rank", F.col("start") + F.col("lies") - F.col("first")
    ).drop("part", "lies", "first", "start")


def _lsh_tables(rows: int, block_rows: int) -> int:
    """Tables that keep the recall of `_lsh_hits` as rows grow.

    A window is a smaller share of a longer order, and the chance that two
    neighbours share one falls with about the root of the number of blocks.
    """
    blocks = math.ceil(rows / block_rows)
    return 1 if blocks <= 2 else max(LSH_TABLES, math.ceil(LSH_TABLES_PER_ROOT * math.sqrt(blocks)))


def _lsh_hits(vectors: DataFrame, m: int, threshold: float, block_rows: int, tables: int | None) -> DataFrame:
    """Best m targets of each vector among its neighbours in several hash orders.

    Each table signs the vectors with hyperplanes and ranks them by the signature
    over all partitions; a vector meets all rows less than `block_rows` ranks away,
    in windows that overlap their successors. Work is linear in the rows of a table
    whatever their distribution, and the result does not depend on how they are
    partitioned. Without `tables`, their number grows with the root of the blocks.
    """
    count = vectors.count()
    if tables is None:
        tables = _lsh_tables(count, block_rows)
    kind = vectors.schema["id"].dataType
    arrow = pa.int64() if isinstance(kind, T.LongType) else pa.string()
    id_type = kind.simpleString()
    rounds = Rounds(vectors.sparkSession, "lsh")

    def sign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(pa.chunked_array([batch.column("embedding")]))
            for t in range(tables):
                planes = np.array([_plane(t, bit, rows.shape[1]) for bit in range(LSH_BITS)], dtype=np.float64).T
                signature = ((rows @ planes) > 0) @ (1 << np.arange(LSH_BITS, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), t, dtype=np.int32)), pa.array(signature.astype(np.int64)), batch.column("id")],
                    names=["t", "signature", "id"],
                )

    def compare(table):
        ids = np.asarray(table.column("id").to_numpy(zero_copy_only=False))
        return _best_inside(ids, _matrix(table.column("embedding")), m, threshold, arrow)

    signed = vectors.select("id", "embedding").mapInArrow(sign, f"t int, signature bigint, id {id_type}")
    window = F.floor(F.col("rank") / block_rows)
    dealt = _global_rank(signed, "t", ["signature", "id"], rounds).select(
        "t", "id", F.explode(F.array(window, window - 1)).alias("window")
    ).where(F.col("window") >= 0)
    # the last window lies within the one before it, unless there is no other
    last = dealt.groupBy("t").agg(F.max("window").alias("last"))
    dealt = dealt.join(last, "t").where((F.col("window") < F.col("last")) | (F.col("last") == 0)).drop("last")
    # windows are small and heavy, like the cells of the exact search
    heavy = dealt.join(vectors.select("id", "embedding"), "id").repartition(
        max(1, tables * math.ceil(count / block_rows)), "t", "window")
    hits = heavy.groupBy("t", "window").applyInArrow(
        compare, f"source {id_type}, target {id_type}, score double"
    )
    return hits.groupBy("source", "target").agg(F.max("score").alias("score"))


def knn(vectors: DataFrame, k: int = 5, threshold: float | None = 0.75, candidate_limit: int | str | None = "auto",
        method: str = "exact", selected: DataFrame | None = None, block_rows: int = BLOCK_ROWS,
        tables: int | None = None) -> DataFrame:
    """(source, target, score, rank): up to k nearest vectors by cosine, at or above the threshold.

    The nearest `candidate_limit` points of the whole collection, the vector
    itself included, are taken first ("auto": max(4k, k + 10)); then the vector
    itself and unselected points are dropped and the first k kept, so a narrow
    selection can leave fewer than k. `selected` is a frame of ids. Scores carry
    nine decimals; equal scores rank by id. Rows without a vector have no
    neighbours; vectors of different lengths are an error. `tables` is the number
    of hash orders of method "lsh"; by default as many as the size asks for.
    """
    vectors = vectors.where(F.col("embedding").isNotNull())
    if candidate_limit == "auto":
        candidate_limit = max(4 * k, k + 10)
    limit = candidate_limit if candidate_limit is not None else (k + 1 if selected is None else None)
    floor = -2.0 if threshold is None else threshold
    if limit is None:
        # without a candidate limit only selected points can matter as targets
        vectors, limit = vectors.join(selected.select("id"), "id", "left_semi"), k + 1
    if method == "exact":
        hits = _exact_hits(vectors, limit, floor, block_rows)
    elif method == "lsh":
        hits = _lsh_hits(vectors, limit, floor, block_rows, tables)
    else:
        raise ValueError("method must be 'exact' or 'lsh'")
    order = [F.desc("score"), F.asc("target")]
    near = top_k_per_key(hits, ["source"], order, limit).where(F.col("source") != F.col("target"))
    if selected is not None:
        ids = selected.select("id")
        near = near.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
            ids.withColumnRenamed("id", "target"), "target", "left_semi"
        )
    return top_k_per_key(near, ["source"], order, k, rank="rank").select("source", "target", "score", "rank")


def symmetrize(directed: DataFrame, policy: str = "max_score_union", mutual_knn: bool = False) -> DataFrame:
    """Undirected edges from directed neighbours: the better score of the two directions.

    `mutual_only`, or `mutual_knn`, keeps pairs found from both ends.
    """
    if policy not in ("max_score_union", "mutual_only"):
        raise ValueError("policy must be 'max_score_union' or 'mutual_only'")
    forward = F.col("source") < F.col("target")
    edges = directed.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(
        F.max("score").alias("weight"),
        F.max("score").alias("similarity_score"),
        F.min("rank").alias("rank"),
        (F.count("*") == 2).alias("mutual_match"),
        F.max(F.when(forward, F.col("rank"))).alias("source_rank"),
        F.max(F.when(~forward, F.col("rank"))).alias("target_rank"),
        F.max(F.when(forward, F.col("score"))).alias("source_score"),
        F.max(F.when(~forward, F.col("score"))).alias("target_score"),
    )
    if mutual_knn or policy == "mutual_only":
        edges = edges.where("mutual_match")
    return edges.withColumnsRenamed({"a": "source", "b": "target"})


def select_embedded(publication: DataFrame, embedding: DataFrame, provider: str, model: str, version: str,
                    publication_type: str | None = None, language: str | None = None,
                    year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """Publications with a vector of the configuration and the given type, language and years, newest first."""
    active = embedding.where(
        (F.col("embedding_provider") == provider) & (F.col("embedding_model") == model)
        & (F.col("embedding_version") == version)
    ).select("publication_id")
    out = publication.join(active, "publication_id", "left_semi")
    if publication_type is not None:
        out = out.where(F.col("publication_type") == publication_type)
    if language is not None:
        out = out.where(F.col("language_code") == language)
    if year_from is not None:
        out = out.where(F.col("publication_year") >= year_from)
    if year_to is not None:
        out = out.where(F.col("publication_year") <= year_to)
    return out.orderBy(F.desc("created_at"), "publication_id")


def author_names(authorship: DataFrame, researcher: DataFrame) -> DataFrame:
    """(publication_id, authors): names in author order, list name when the full name is blank."""
    listed = F.col("author_list_name") if "author_list_name" in authorship.columns else F.lit(None).cast("string")
    named = authorship.withColumn("_listed", listed).join(
        researcher.select("researcher_id", "full_name"), "researcher_id", "left"
    )
    name = F.coalesce(nonblank(F.col("full_name")), nonblank(F.col("_listed")))
    return (
        named.select("publication_id", "author_position", "researcher_id", name.alias("name"))
        .where(F.col("name").isNotNull())
        .groupBy("publication_id")
        .agg(F.sort_array(F.collect_list(F.struct("author_position", "researcher_id", "name"))).alias("a"))
        .select("publication_id", F.transform("a", lambda x: x["name"]).alias("authors"))
    )


def semantic_nodes(publication: DataFrame, authorship: DataFrame, researcher: DataFrame,
                   publication_organization: DataFrame, organization: DataFrame,
                   edges: DataFrame | None = None, include_isolated: bool = False) -> DataFrame:
    """Publication nodes with label, authors in order and sorted organization arrays."""
    base = publication
    if not include_isolated:
        if edges is None:
            raise ValueError("edges are needed to leave out isolated nodes")
        ends = edges.select(F.explode(F.array("source", "target")).alias("publication_id")).distinct()
        base = base.join(ends, "publication_id", "left_semi")
    keep = base.select("publication_id")
    orgs = publication_organization.join(keep, "publication_id", "left_semi").select(
        "publication_id", "organization_id"
    ).distinct().join(organization.select("organization_id", F.nullif("name", F.lit("")).alias("name")), "organization_id")
    sets = sorted_sets(
        orgs.withColumnsRenamed({"organization_id": "organization_ids", "name": "organization_names"}),
        "publication_id", ["organization_ids", "organization_names"],
    )
    authors = author_names(authorship.join(keep, "publication_id", "left_semi"), researcher)
    optional = [c for c in ("doi", "openaire_id", "publication_type", "language_code", "journal_name", "venue_name")
                if c in base.columns]
    empty = F.array().cast("array<string>")
    year = F.col("publication_year")
    if "publication_date" in base.columns:
        year = publication_year(year, F.col("publication_date"))
    return (
        base.join(authors, "publication_id", "left").join(sets, "publication_id", "left")
        .select(
            F.col("publication_id").alias("id"), publication_label(F.col("title")).alias("label"), "title",
            normalize_text(F.col("title")).alias("normalized_title"), year.alias("publication_year"), *optional,
            F.coalesce("authors", empty).alias("authors"),
            F.coalesce("organization_ids", empty).alias("organization_ids"),
            F.coalesce("organization_names", empty).alias("organization_names"),
        )
    )
