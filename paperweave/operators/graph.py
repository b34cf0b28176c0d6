"""Graph construction and the metrics that need only joins and aggregates.

Nodes are frames with an `id`; edges have `source < target` and a `weight`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.functions.payload import publication_year
from paperweave.functions.text import display_label, normalize_text
from paperweave.operators.grouping import PAIR_BLOCK, group_pairs, group_sizes
from paperweave.session import Rounds, partitions_for

CELL_ARCS = 2_000_000
WEDGES = 2_000_000
BIT_BYTES = 1 << 27
BITS_AT_ONCE = 1 << 24
WORDS_OF_A_WEDGE = 32


def enrich_authorship(authorship: DataFrame, researcher: DataFrame, publication: DataFrame,
                      organization: DataFrame, affiliation: DataFrame) -> DataFrame:
    """Authorship with researcher, publication, primary organization and number of affiliations."""
    people = researcher.join(
        organization.select(F.col("organization_id").alias("primary_organization_id"), F.col("name").alias("organization_name")),
        "primary_organization_id", "left",
    ).join(affiliation.groupBy("researcher_id").agg(F.count("*").alias("affiliations")), "researcher_id", "left")
    papers = publication.select("publication_id", "publication_year", "publication_date")
    return (
        authorship.join(people.select("researcher_id", "full_name", "display_name", "organization_name",
                                      F.coalesce("affiliations", F.lit(0)).cast("bigint").alias("affiliations")), "researcher_id")
        .join(papers, "publication_id")
    )


def coauthor_pairs(authorship: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """(publication_id, source, target): one row per publication and author pair."""
    members = (
        authorship.where(F.col("publication_id").isNotNull() & F.col("researcher_id").isNotNull())
        .select(F.col("publication_id").alias("grp"), F.col("researcher_id").alias("member"))
        .distinct()
    )
    members = Rounds(authorship.sparkSession, "members").cut(members)
    pairs = group_pairs(members, group_sizes(members, "grp"), block=block)
    return pairs.select(
        F.col("grp").alias("publication_id"), F.col("left").alias("source"), F.col("right").alias("target")
    )


def coauthor_edges(authorship: DataFrame, publication: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """Weighted coauthor edges with the first and last year of collaboration.

    The year joins the (publication, author) rows before they are paired, so the
    pair rows themselves are only aggregated. Publication ids of an edge are not
    gathered into one cell; `coauthor_edge_publications` lists them row by row.
    The edges are written once, by shuffles whose partitions follow the numbers of
    links and pairs, so a task holds no more of a larger graph.
    """
    spark = authorship.sparkSession
    years = publication.select(
        F.col("publication_id").alias("grp"),
        publication_year(F.col("publication_year"), F.col("publication_date")).alias("year"),
    )
    links = authorship.where(F.col("publication_id").isNotNull() & F.col("researcher_id").isNotNull()).select(
        F.col("publication_id").alias("grp"), F.col("researcher_id").alias("member"))
    rounds = Rounds(spark, "members")
    with partitions_for(spark, links.count()) as count:
        # rows are dealt before they are grouped: a partial aggregate over a scan would hold the keys of a whole input split
        members = rounds.cut(links.repartition(count, "grp", "member").distinct().join(years, "grp", "left"))
        sizes, seen = rounds.measure(group_sizes(members.repartition(count, "grp", "member"), "grp"), pairs=F.sum(F.col("n") * (F.col("n") - 1) / 2))
    with partitions_for(spark, int(seen["pairs"] or 0)):
        pairs = group_pairs(members, sizes, carry=["year"], block=block)
        edges = rounds.cut(pairs.groupBy(F.col("left").alias("source"), F.col("right").alias("target")).agg(
            F.count("*").alias("weight"),
            F.count("*").alias("shared_publication_count"),
            F.min("year_left").alias("first_collaboration_year"),
            F.max("year_left").alias("last_collaboration_year"),
        ))
    rounds.drop(sizes)
    rounds.drop(members)
    return edges


def edges_around(authorship: DataFrame, publication: DataFrame, center) -> DataFrame:
    """The coauthor edges of one researcher, from the center's own publications."""
    papers = authorship.where(F.col("researcher_id") == F.lit(center)).select("publication_id").distinct()
    near = authorship.join(papers, "publication_id", "left_semi")
    return incident(coauthor_edges(near, publication), center)


def edges_within(authorship: DataFrame, publication: DataFrame, ids: DataFrame) -> DataFrame:
    """The coauthor edges among some researchers (id), from their own authorship."""
    theirs = authorship.join(ids.select(F.col("id").alias("researcher_id")), "researcher_id", "left_semi")
    return coauthor_edges(theirs, publication)


def ego_edges(authorship: DataFrame, publication: DataFrame, center) -> DataFrame:
    """All coauthor edges among one researcher and their coauthors, without the rest of the graph."""
    papers = authorship.where(F.col("researcher_id") == F.lit(center)).select("publication_id").distinct()
    near = authorship.join(papers, "publication_id", "left_semi").select(F.col("researcher_id").alias("id")).distinct()
    return edges_within(authorship, publication, near)


def coauthor_edge_publications(authorship: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """(source, target, publication_id): the shared publications behind every edge."""
    return coauthor_pairs(authorship, block).select("source", "target", "publication_id")


def coauthor_nodes(authorship: DataFrame, researcher: DataFrame, attribution: DataFrame | None = None,
                   edges: DataFrame | None = None, include_isolated: bool = True) -> DataFrame:
    """Researchers with at least one authorship, with label and attribution columns.

    `attribution` has researcher_id, primary_organization_id/name and university_code/name.
    """
    writing = authorship.select("researcher_id").distinct()
    base = researcher.join(writing, "researcher_id", "left_semi").select(
        F.col("researcher_id").alias("id"),
        display_label(F.col("display_name"), F.col("full_name")).alias("label"),
        "full_name",
        normalize_text(F.col("full_name")).alias("normalized_name"),
    )
    if attribution is not None:
        base = base.join(
            attribution.withColumnRenamed("researcher_id", "id"), "id", "left"
        ).withColumn("is_alliance_university", F.col("university_code").isNotNull())
    if not include_isolated:
        if edges is None:
            raise ValueError("edges are needed to leave out isolated nodes")
        base = base.join(edge_ends(edges).distinct(), "id", "left_semi")
    return base


def edge_ends(edges: DataFrame) -> DataFrame:
    """(id): both ends of every edge."""
    return edges.select(F.explode(F.array("source", "target")).alias("id"))


def both_ways(edges: DataFrame, *carry: str) -> DataFrame:
    """(id, other, carry...): every edge seen from each of its ends."""
    ends = F.array(
        F.struct(F.col("source").alias("id"), F.col("target").alias("other")),
        F.struct(F.col("target").alias("id"), F.col("source").alias("other")),
    )
    return edges.select(F.explode(ends).alias("e"), *carry).select("e.id", "e.other", *carry)


def degree_strength(nodes: DataFrame, edges: DataFrame, round_to: int | None = None) -> DataFrame:
    """(id, degree, strength) of every node; isolated nodes have zeros.

    With `round_to`, fractional weights are added as decimals, so the result does
    not depend on the order of the additions.
    """
    weight = F.col("weight") if round_to is None else F.col("weight").cast("decimal(28,9)")
    sums = both_ways(edges, "weight").groupBy("id").agg(
        F.count("*").alias("degree"), F.sum(weight).alias("strength")
    )
    strength = F.coalesce("strength", F.lit(0))
    if round_to is not None:
        strength = F.round(strength, round_to).cast("double")
    return nodes.select("id").join(sums, "id", "left").select(
        "id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"), strength.alias("strength")
    )


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    return nodes.join(edge_ends(edges), "id", "left_anti")


def connected_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with an edge."""
    return nodes.join(edge_ends(edges), "id", "left_semi")


def induced_subgraph(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges with both ends among the selected ids."""
    ids = selected.select("id")
    return (
        edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
        .join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
        .select(*edges.columns)
    )


def incident(edges: DataFrame, node) -> DataFrame:
    return edges.where((F.col("source") == F.lit(node)) | (F.col("target") == F.lit(node)))


def ego_network(edges: DataFrame, center, order: int = 1) -> DataFrame:
    """Edges among all nodes at most `order` steps from the center, itself included."""
    spark = edges.sparkSession
    dtype = edges.schema["source"].dataType
    reached = spark.range(1).select(F.lit(center).cast(dtype).alias("id"))
    ways = both_ways(edges)
    for _ in range(order):
        step = ways.join(reached, "id", "left_semi").select(F.col("other").alias("id"))
        reached = reached.unionByName(step).distinct()
    return induced_subgraph(edges, reached)


def node_neighbors(edges: DataFrame, node, kind: str = "coauthor") -> DataFrame:
    """Neighbours of one node, strongest first."""
    other = F.when(F.col("source") == F.lit(node), F.col("target")).otherwise(F.col("source"))
    rows = incident(edges, node).withColumn("neighbor", other)
    if kind == "coauthor":
        cols = ["neighbor", "shared_publication_count", "first_collaboration_year", "last_collaboration_year", "weight"]
        return rows.select(*cols).orderBy(F.desc("weight"), F.desc("neighbor"))
    cols = ["neighbor", "weight", "similarity_score", "rank", "mutual_match"]
    return rows.select(*cols).orderBy(F.desc("weight"), F.desc("mutual_match"), F.asc("rank"), F.desc("neighbor"))


def node_detail(nodes: DataFrame, node) -> DataFrame:
    """The node's row; an unknown node is an error."""
    found = nodes.where(F.col("id") == F.lit(node))
    if found.isEmpty():
        raise LookupError(f"node {node!r} is not in the graph")
    return found


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes, edges, components and communities of a measured graph.

    Communities are 0 on an empty graph and null when there are nodes but no
    community was found (for example, no edges).
    """
    edge_count = edges.agg(F.count("*")).scalar()
    counts = nodes.agg(
        F.count("*").alias("node_count"),
        F.count_distinct("component_id").alias("component_count"),
        F.count_distinct("community_id").alias("found"),
    )
    communities = F.when(F.col("node_count") == 0, 0).otherwise(F.nullif(F.col("found"), F.lit(0)))
    return counts.select(
        "node_count", edge_count.alias("edge_count"), "component_count",
        communities.cast("bigint").alias("community_count"),
    )


def graph_version(nodes: DataFrame, edges: DataFrame, params: str = "") -> DataFrame:
    """One SHA-256 that depends on the content only, not on row order or partitioning.

    Every row is hashed where it lies and the eight 32-bit words of the hashes are
    added up over the graph; the sums and the row count are hashed into the
    version. Sums are partial aggregates, so nothing but one row per task moves.
    """
    node_cols = [c for c in ("id", "primary_organization_id", "university_code", "publication_year",
                             "organization_ids") if c in nodes.columns]
    edge_cols = [c for c in ("source", "target", "weight", "first_collaboration_year", "last_collaboration_year",
                             "rank", "mutual_match") if c in edges.columns]

    def hashed(df: DataFrame, kind: str, cols: list[str]) -> DataFrame:
        body = F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]))
        return df.select(F.sha2(F.concat(F.lit(kind), body), 256).alias("h"))

    rows = hashed(nodes, "n", node_cols).unionByName(hashed(edges, "e", edge_cols))
    words = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    sums = rows.agg(F.count("*").cast("string").alias("n"), *[
        F.coalesce(F.sum(w), F.lit(0)).cast("string").alias(f"w{i}") for i, w in enumerate(words)
    ])
    return sums.select(
        F.sha2(F.concat_ws("|", F.lit(params), "n", *[f"w{i}" for i in range(8)]), 256).alias("graph_version")
    )


def _bit_rows(node: np.ndarray, spot: np.ndarray, n: int, width: int) -> np.ndarray:
    """A row of bits for each of n nodes, set at its spots below `width`."""
    words = -(-width // 64)
    rows = np.zeros((n, words * 8), np.uint8)
    order = np.argsort(node, kind="stable")
    node, spot = node[order], spot[order]
    step = max(1, BITS_AT_ONCE // (words * 64))
    for lo in range(0, n, step):
        a, b = np.searchsorted(node, (lo, lo + step))
        dense = np.zeros((min(step, n - lo), words * 64), bool)
        dense[node[a:b] - lo, spot[a:b]] = True
        rows[lo:lo + step] = np.packbits(dense, axis=1)
    return rows.view(np.uint64)


def _closed_by_bits(tail: np.ndarray, head: np.ndarray, colour: np.ndarray, trio: tuple[int, int, int], wedges: int) -> np.ndarray | None:
    """Triangles of each node of a cell: rows of neighbours' bits meet where an arc runs, word by word.

    Arcs are listed once and none is a loop. None where rows would be longer than
    the wedges that they spare, as in a cell of few arcs between many nodes.
    """
    a, b, c = trio if trio[0] != trio[1] else trio[::-1]  # two equal colours last
    spots = np.zeros(len(colour), np.int64)
    size = {}
    for x in {a, b, c}:
        own = np.flatnonzero(colour == x)
        spots[own], size[x] = np.arange(len(own)), len(own)

    def between(x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
        there = (colour[tail] == x) & (colour[head] == y)
        if x == y:
            return tail[there], head[there]
        back = (colour[tail] == y) & (colour[head] == x)
        return np.concatenate([tail[there], head[back]]), np.concatenate([head[there], tail[back]])

    def neighbours(x: int, y: int) -> np.ndarray:
        """The bits of the neighbours of colour y of the nodes of colour x."""
        u, v = between(x, y)
        if x == y:
            u, v = np.concatenate([u, v]), np.concatenate([v, u])
        return _bit_rows(spots[u], spots[v], size[x], size[y])

    def shared(x: int, y: int, third: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(u, v, n): arcs from colour x to colour y, and the neighbours of colour `third` that their ends share."""
        u, v = between(x, y)
        left, right = neighbours(x, third), neighbours(y, third) if x != y else None
        right = left if right is None else right
        n = np.zeros(len(u), np.int64)
        step = max(1, BITS_AT_ONCE // 64 // max(1, left.shape[1]))
        for lo in range(0, len(u), step):
            both = left[spots[u[lo:lo + step]]]
            both &= right[spots[v[lo:lo + step]]]
            n[lo:lo + step] = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        return u, v, n

    passes = [(a, b, c)] if b == c else [(a, b, c), (a, c, b)]
    words = sum(len(between(x, y)[0]) * -(-size[z] // 64) for x, y, z in passes)
    held = max((size[x] + size[y]) * -(-size[z] // 64) * 8 for x, y, z in passes)
    if held > BIT_BYTES or words > WORDS_OF_A_WEDGE * wedges:
        return None
    total = np.zeros(len(colour), np.int64)
    u, v, n = shared(*passes[0])
    # a triangle is met once for each of its arcs between these colours
    first = np.bincount(u, n, len(colour)).astype(np.int64)
    second = np.bincount(v, n, len(colour)).astype(np.int64)
    if b != c:
        total += first + second
        _, v, n = shared(*passes[1])
        total += np.bincount(v, n, len(colour)).astype(np.int64)
    elif a != b:
        total += first // 2 + second
    else:
        total += (first + second) // 2
    return total


def _closed(out: pa.Table, trio: tuple[int, int, int]) -> pa.Table:
    """(no, triangles) of one cell: triangles of the listed arcs whose nodes have the cell's three colours."""
    heads = out.column("heads").combine_chunks()
    heads = heads if isinstance(heads, pa.Array) else heads.chunk(0)
    sizes = pc.list_value_length(heads).to_numpy(zero_copy_only=False)
    names, codes = np.unique(np.concatenate([
        np.repeat(out.column("tail").to_numpy(), sizes), heads.flatten().to_numpy(zero_copy_only=False)]), return_inverse=True)
    n, half = len(names), int(sizes.sum())
    colour = np.zeros(n, np.int32)
    colour[codes[:half]] = np.repeat(out.column("tail_colour").to_numpy(), sizes)
    colour[codes[half:]] = np.repeat(out.column("head_colour").to_numpy(), sizes)
    # an arc's key is its tail and head, the smaller number first; arcs that are listed twice count twice
    arcs, copies = np.unique(codes[:half].astype(np.int64) * n + codes[half:], return_counts=True)
    tail, head = arcs // n, arcs % n
    partners = np.searchsorted(tail, tail, "right") - np.arange(len(arcs)) - 1
    upto = np.cumsum(partners)
    if len(arcs) and (copies == 1).all() and (tail != head).all():
        total = _closed_by_bits(tail, head, colour, trio, int(upto[-1]))
        if total is not None:
            seen = total > 0
            return pa.table({"no": pa.array(names[seen], pa.int64()), "triangles": pa.array(total[seen], pa.int64())})
    total = np.zeros(n, np.int64)
    at = 0
    while at < len(arcs):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WEDGES, "right")))
        first = np.repeat(np.arange(at, end), partners[at:end])
        start = upto[at:end] - partners[at:end] - (upto[at - 1] if at else 0)
        second = first + 1 + np.arange(len(first)) - np.repeat(start, partners[at:end])
        key = head[first] * n + head[second]
        place = np.minimum(np.searchsorted(arcs, key), len(arcs) - 1)
        hit = arcs[place] == key
        i, j, k = first[hit], second[hit], place[hit]
        if trio[0] == trio[1] or trio[1] == trio[2]:
            three = np.sort(np.stack([colour[tail[i]], colour[head[i]], colour[head[j]]]), axis=0)
            own = (three == np.array(trio)[:, None]).all(axis=0)
            i, j, k = i[own], j[own], k[own]
        found = copies[i] * copies[j] * copies[k]
        for corner in (tail[i], head[i], head[j]):
            total += np.bincount(corner, found, n).astype(np.int64)
        at = end
    seen = total > 0
    return pa.table({"no": pa.array(names[seen], pa.int64()), "triangles": pa.array(total[seen], pa.int64())})


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers that ascend or lie near each other, as compressed planes of the bytes of their steps."""
    steps = np.diff(numbers.astype(np.int64), prepend=0)
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unsqueezed(body: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(body, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def _packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """All arcs between two colours as one row, by tail and head."""
    tail, head = table.column("tail").to_numpy(), table.column("head").to_numpy()
    order = np.lexsort((head, tail))
    return pa.table({
        "tail_colour": pa.array([key[0].as_py()], pa.int32()), "head_colour": pa.array([key[1].as_py()], pa.int32()),
        "n": pa.array([len(order)], pa.int64()), "tails": pa.array([_squeezed(tail[order])], pa.binary()),
        "heads": pa.array([_squeezed(head[order])], pa.binary())})


def _unpacked(table: pa.Table) -> pa.Table:
    """The arcs of packed rows, each as a list of one head."""
    rows = table.to_pylist()
    n = [r["n"] for r in rows]
    heads = np.concatenate([_unsqueezed(r["heads"], r["n"]) for r in rows])
    return pa.table({
        "tail": np.concatenate([_unsqueezed(r["tails"], r["n"]) for r in rows]),
        "tail_colour": np.repeat(np.array([r["tail_colour"] for r in rows], np.int32), n),
        "head_colour": np.repeat(np.array([r["head_colour"] for r in rows], np.int32), n),
        "heads": pa.ListArray.from_arrays(pa.array(np.arange(len(heads) + 1, dtype=np.int32)), pa.array(heads))})


def triangle_counts(arcs: DataFrame, rows: int, cell_arcs: int = CELL_ARCS) -> DataFrame:
    """(no, triangles) from `rows` arcs (tail, head) between numbered nodes, tail < head.

    Nodes are dealt into colours by a hash, arcs into cells of three colours: an
    arc goes to every cell that holds its two (Suri and Vassilvitskii, 2011). All
    arcs of a triangle meet in the cell of its colours, so triangles are closed
    where arcs lie and no wedge is ever a row. The number of colours grows with
    the root of the arcs, so a cell holds about `cell_arcs` of them. All arcs of
    two colours travel as one compressed row, as each goes to as many cells as
    there are colours.
    """
    colours = max(1, math.ceil(math.sqrt(6 * rows / cell_arcs)))
    colour = lambda c: F.pmod(F.xxhash64(c), F.lit(colours)).cast("int")
    packed = arcs.withColumns({"tail_colour": colour("tail"), "head_colour": colour("head")}).groupBy(
        "tail_colour", "head_colour").applyInArrow(_packed, "tail_colour int, head_colour int, n bigint, tails binary, heads binary")
    cells = packed.withColumn("third", F.explode(F.sequence(F.lit(0), F.lit(colours - 1)))).withColumn(
        "trio", F.array_sort(F.array("tail_colour", "head_colour", "third"))
    ).select("tail_colour", "head_colour", "n", "tails", "heads", *[F.col("trio")[i].alias(f"c{i}") for i in range(3)])
    count = colours * (colours + 1) * (colours + 2) // 6

    def closed(key, table):
        return _closed(_unpacked(table), tuple(k.as_py() for k in key))

    # cells are few and heavy: small ones must not be put together
    found = cells.repartition(count, "c0", "c1", "c2").groupBy("c0", "c1", "c2").applyInArrow(closed, "no bigint, triangles bigint")
    return found.groupBy("no").agg(F.sum("triangles").alias("triangles"))


def clustering_coefficient(nodes: DataFrame, edges: DataFrame, cell_arcs: int = CELL_ARCS) -> DataFrame:
    """(id, triangles, clustering) per node; nodes below degree 2 have no coefficient.

    Each edge points from its lower-degree end to the higher one, so even a hub
    has few outgoing edges and wedges are formed at their cheapest corner.
    """
    rounds = Rounds(edges.sparkSession, "clustering")
    if not getattr(edges, "_round_path", ""):  # written edges are read as they are
        edges = rounds.cut(edges.select("source", "target", "weight"))
    degrees = rounds.cut(degree_strength(nodes, edges).select("id", "degree"))
    # numbers ascend with the degree: partitions of a sort are in its order, and so are the rows in them
    numbered = rounds.cut(degrees.where(F.col("id").isNotNull()).distinct().orderBy("degree", "id").withColumn(
        "no", F.monotonically_increasing_id()))
    s, t = (numbered.select(F.col("id").alias(c), F.col("no").alias(f"n_{c}")) for c in ("source", "target"))
    ranked = edges.select("source", "target").join(s, "source").join(t, "target")
    arcs, seen = rounds.measure(ranked.select(
        F.least("n_source", "n_target").alias("tail"), F.greatest("n_source", "n_target").alias("head"),
    ), rows=F.count("*"))
    corners = numbered.join(triangle_counts(arcs, seen["rows"], cell_arcs), "no").select("id", "triangles")
    possible = F.col("degree") * (F.col("degree") - 1) / 2
    return degrees.join(corners, "id", "left").select(
        "id",
        F.coalesce("triangles", F.lit(0)).cast("bigint").alias("triangles"),
        F.when(F.col("degree") >= 2, F.coalesce("triangles", F.lit(0)) / possible).alias("clustering"),
    )
