import heapq
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from paperweave.operators import centrality, components, graph, subgraph


def frame(spark, edges):
    return spark.createDataFrame(edges, "source long, target long, weight long")


def nodes_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def random_edges(seed, n, m):
    rng = random.Random(seed)
    picked = rng.sample(list(combinations(range(n), 2)), m)
    return [(a, b, rng.randrange(1, 4)) for a, b in picked]


def brandes(ids, edges, length):
    near = {i: [] for i in ids}
    for a, b, w in edges:
        near[a].append((b, length(w)))
        near[b].append((a, length(w)))
    score = dict.fromkeys(ids, 0.0)
    for s in ids:
        dist, sigma, preds, order, heap = {s: 0.0}, dict.fromkeys(ids, 0.0), {i: [] for i in ids}, [], [(0.0, s)]
        sigma[s], done = 1.0, set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            order.append(u)
            for v, w in near[u]:
                if v in done:
                    continue
                if v not in dist or d + w < dist[v] - 1e-9:
                    dist[v], sigma[v], preds[v] = d + w, sigma[u], [u]
                    heapq.heappush(heap, (d + w, v))
                elif abs(d + w - dist[v]) <= 1e-9:
                    sigma[v] += sigma[u]
                    preds[v].append(u)
        delta = dict.fromkeys(ids, 0.0)
        for v in reversed(order):
            for u in preds[v]:
                delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
            if v != s:
                score[v] += delta[v]
    return {i: x / 2 for i, x in score.items()}


@pytest.mark.parametrize("length", ["weight", "inverse"])
def test_betweenness_matches_brute_force(spark, length):
    edges = random_edges(3, 25, 45)
    ids = list(range(27))
    want = brandes(ids, edges, (lambda w: float(w)) if length == "weight" else (lambda w: 1 / w))
    got = centrality.betweenness(nodes_of(spark, ids), frame(spark, edges), length=length, normalized=False)
    for row in got.collect():
        assert row.betweenness == pytest.approx(want[row.id], abs=1e-6)
    full = centrality.betweenness(nodes_of(spark, ids), frame(spark, edges), length=length, pivots=27)
    scale = 26 * 25 / 2
    for row in full.collect():
        assert row.betweenness == pytest.approx(want[row.id] / scale, abs=1e-9)


@pytest.mark.parametrize("seed, n, m", [(1, 60, 40), (2, 40, 39), (3, 30, 100)])
def test_components(spark, seed, n, m):
    edges = random_edges(seed, n, m)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b, _ in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.component_id for r in components.connected_components(nodes_of(spark, range(n)), frame(spark, edges)).collect()}
    assert got == {i: find(i) for i in range(n)}


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1, 1) for i in range(200)]
    star = [(1000, 1001 + i, 1) for i in range(300)]
    ids = list(range(201)) + list(range(1000, 1301))
    got = {r.id: r.component_id for r in components.connected_components(nodes_of(spark, ids), frame(spark, path + star)).collect()}
    assert all(got[i] == (0 if i < 1000 else 1000) for i in ids)


def test_no_edges(spark):
    nodes, edges = nodes_of(spark, [1, 2]), frame(spark, [])
    assert sorted(tuple(r) for r in components.connected_components(nodes, edges).collect()) == [(1, 1), (2, 2)]
    assert [r.betweenness for r in centrality.betweenness(nodes, edges).collect()] == [0.0, 0.0]
    assert components.label_propagation(nodes, edges, 2).count() == 2


AUTHORS = [(1, "A", 1), (1, "B", 2), (2, "A", 1), (2, "B", 2), (2, "C", 3), (3, "D", 1)]
PAPERS = [(1, 2020, None), (2, None, "2022-05-01"), (3, 2024, None)]


@pytest.fixture(scope="module")
def golden(spark):
    auth = spark.createDataFrame(AUTHORS, "publication_id long, researcher_id string, author_position int")
    pubs = spark.createDataFrame(PAPERS, "publication_id long, publication_year int, d string").select(
        "publication_id", "publication_year", F.to_date("d").alias("publication_date"))
    return auth, pubs, graph.coauthor_edges(auth, pubs)


def test_coauthor_edges_golden(golden):
    got = sorted(tuple(r) for r in golden[2].collect())
    assert got == [("A", "B", 2, 2, 2020, 2022), ("A", "C", 1, 1, 2022, 2022), ("B", "C", 1, 1, 2022, 2022)]


def test_solo_author_is_isolated(spark, golden):
    people = spark.createDataFrame([(x, f"Name {x}", "" if x == "A" else f"Show {x}") for x in "ABCDE"],
                                   "researcher_id string, full_name string, display_name string")
    every = graph.coauthor_nodes(golden[0], people)
    assert sorted((r.id, r.label) for r in every.collect()) == [
        ("A", "Name A"), ("B", "Show B"), ("C", "Show C"), ("D", "Show D")]
    linked = graph.coauthor_nodes(golden[0], people, edges=golden[2], include_isolated=False)
    assert sorted(r.id for r in linked.collect()) == ["A", "B", "C"]
    assert [r.id for r in graph.isolated_nodes(every, golden[2]).collect()] == ["D"]
    degrees = {r.id: (r.degree, r.strength) for r in graph.degree_strength(every, golden[2]).collect()}
    assert degrees == {"A": (2, 3), "B": (2, 3), "C": (2, 2), "D": (0, 0)}


def measured(spark, rows, edges):
    nodes = spark.createDataFrame(
        rows, "id string, label string, primary_organization_id string, university_code string, degree long, strength long, "
              "component_id int, community_id int")
    links = spark.createDataFrame(edges, "source string, target string, weight long, shared_publication_count long")
    return nodes, links


def ids(df):
    return sorted(r.id for r in df.collect())


def test_subgraph_ego_with_budget(spark):
    nodes, edges = measured(
        spark, [(x, x, None, None, 1, 1, 0, None) for x in "abc"], [("a", "b", 3, 3), ("a", "c", 1, 1)])
    n, e, s = subgraph.subgraph(nodes, edges, node="a", max_nodes=2, min_edge_weight=2)
    assert ids(n) == ["a", "b"] and e.count() == 1
    assert tuple(s.first()) == (2, 1, 1, None)
    assert ids(subgraph.subgraph(nodes, edges, node="a", max_nodes=1)[0]) == ["a"]


def test_subgraph_ego_keeps_a_filtered_center(spark):
    nodes, edges = measured(
        spark, [("a", "a", "o1", None, 1, 1, 0, 1), ("b", "b", "o2", None, 1, 1, 0, 1)], [("a", "b", 3, 3)])
    n, e, _ = subgraph.subgraph(nodes, edges, node="a", organization="o2")
    assert ids(n) == ["a"] and e.count() == 0


def test_subgraph_rank_prefers_attribution(spark):
    nodes, edges = measured(
        spark, [("a", "a", None, None, 9, 90, 0, 1), ("b", "b", "o", None, 1, 1, 0, 1), ("c", "c", None, "u", 1, 2, 0, 2)],
        [("a", "b", 1, 1), ("b", "c", 1, 1)])
    n, e, s = subgraph.subgraph(nodes, edges, max_nodes=2)
    assert ids(n) == ["b", "c"] and e.count() == 1 and s.first()["community_count"] == 2


def test_subgraph_min_degree_then_largest_component(spark):
    rows = [(x, x, None, None, 2 if x == "b" else 1, 5, 0, None) for x in "abc"]
    nodes, edges = measured(spark, rows, [("a", "b", 2, 2), ("b", "c", 3, 3)])
    n, e, _ = subgraph.subgraph(nodes, edges, min_degree=2, largest_component_only=True)
    assert [(r.id, r.degree) for r in n.collect()] == [("b", 2)] and e.count() == 0
    assert ids(subgraph.subgraph(nodes, edges, min_degree=0)[0]) == ["a", "b", "c"]


def test_subgraph_without_filters_is_the_graph(spark):
    rows = [(x, x, None, None, 1, 1, 0, 1) for x in "abcd"]
    nodes, edges = measured(spark, rows, [("a", "b", 2, 2), ("c", "d", 3, 3)])
    n, e, s = subgraph.subgraph(nodes, edges)
    assert ids(n) == list("abcd") and e.count() == 2 and s.first()["node_count"] == 4
    best = subgraph.subgraph(nodes, edges, largest_component_only=True)[0]
    assert ids(best) == ["a", "b"]


def test_graph_version_ignores_order_and_partitions(spark, golden):
    edges = golden[2]
    nodes = spark.createDataFrame([(x, None) for x in "ABCD"], "id string, primary_organization_id string")
    one = graph.graph_version(nodes, edges).first()[0]
    two = graph.graph_version(nodes.orderBy(F.desc("id")).repartition(3), edges.repartition(5)).first()[0]
    other = graph.graph_version(nodes, edges.withColumn("weight", F.col("weight") + 1)).first()[0]
    assert one == two != other


def test_summary_of_empty_graphs(spark):
    schema = "id long, component_id long, community_id long"
    edges = frame(spark, [])
    assert tuple(graph.graph_summary(spark.createDataFrame([], schema), edges).first()) == (0, 0, 0, 0)
    alone = spark.createDataFrame([(1, 1, None)], schema)
    assert tuple(graph.graph_summary(alone, edges).first()) == (1, 0, 1, None)


def test_unknown_node_is_an_error(spark):
    with pytest.raises(LookupError):
        graph.node_detail(nodes_of(spark, [1]), 2)


def test_edges_do_not_depend_on_how_a_big_paper_is_cut(spark):
    rng = random.Random(11)
    links = [(0, a) for a in range(60)] + [(rng.randrange(1, 40), rng.randrange(60)) for _ in range(120)]
    auth = spark.createDataFrame(links, "publication_id long, researcher_id long")
    pubs = spark.createDataFrame([(p, 2000 + p % 5, None) for p in range(40)],
                                 "publication_id long, publication_year int, publication_date date")
    plain = sorted(tuple(r) for r in graph.coauthor_edges(auth, pubs).collect())
    assert plain == sorted(tuple(r) for r in graph.coauthor_edges(auth, pubs, block=4).collect())
    assert len(plain) == 60 * 59 // 2
