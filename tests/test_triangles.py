"""Triangles are closed in cells of three colours, without wedge rows."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from paperweave.operators import graph


@pytest.mark.parametrize("cell_arcs", [40, 100_000])
def test_triangles_against_a_plain_count(spark, cell_arcs):
    random.seed(5)
    pairs = [(a, b) for a, b in itertools.combinations(range(60), 2) if random.random() < (0.9 if b < 12 else 0.15)]
    near = {i: {a + b - i for a, b in pairs if i in (a, b)} for i in range(60)}
    want = {i: sum(y in near[x] for x, y in itertools.combinations(sorted(near[i]), 2)) for i in range(60)}
    edges = spark.createDataFrame([(f"n{a:02}", f"n{b:02}", 1) for a, b in pairs], "source string, target string, weight long")
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(60)], "id string")
    got = graph.clustering_coefficient(nodes, edges, cell_arcs)
    assert {int(r.id[1:]): r.triangles for r in got.collect()} == want


def test_triangles_make_no_wedge_rows(spark):
    """The plan pairs no rows of a node: what is shuffled follows the arcs, not the wedges."""
    edges = spark.createDataFrame([(1, 2, 1), (1, 3, 1), (2, 3, 1)], "source long, target long, weight long")
    plan = graph.clustering_coefficient(graph.edge_ends(edges).distinct(), edges)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan


def cell(trio, n, arcs, seed=3):
    """The arcs of one cell of a random graph, as a task gets them."""
    r = np.random.default_rng(seed)
    colour = r.integers(0, 3, n)
    ends = np.sort(r.integers(0, n, (arcs, 2)), axis=1)
    ends = np.unique(ends[ends[:, 0] < ends[:, 1]], axis=0)
    sides = [sorted(x) for x in itertools.combinations(trio, 2)]
    listed = {}
    for a, b in ends.tolist():
        if sorted((colour[a], colour[b])) in sides:
            listed.setdefault((a * 7, int(colour[a]), int(colour[b])), []).append(b * 7)
    columns = [pa.array([k[i] for k in listed], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]
    return pa.table([*columns, pa.array(list(listed.values()), pa.list_(pa.int64()))], names=["tail", "tail_colour", "head_colour", "heads"])


@pytest.mark.parametrize("trio", [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 2), (1, 2, 2)])
def test_dense_cells_are_closed_by_bits(trio, monkeypatch):
    """Rows of bits give what wedges give; they are taken where they are shorter, and where no arc comes twice."""
    by_bits, used = graph._closed_by_bits, []
    monkeypatch.setattr(graph, "_closed_by_bits", lambda *a: used.append(by_bits(*a)) or used[-1])
    monkeypatch.setattr(graph, "BITS_AT_ONCE", 1 << 12)
    dense, sparse = cell(trio, 300, 20_000), cell(trio, 20_000, 2_000)
    found = graph._closed(dense, trio)
    assert used[-1] is not None and sum(found["triangles"].to_pylist()) > 1_000
    graph._closed(sparse, trio)
    assert used[-1] is None
    twice = graph._closed(pa.concat_tables([dense, dense]), trio)
    assert len(used) == 2 and twice["triangles"].to_pylist() == [8 * n for n in found["triangles"].to_pylist()]
    monkeypatch.setattr(graph, "_closed_by_bits", lambda *a: None)
    assert graph._closed(dense, trio) == found


def test_arcs_travel_packed(spark):
    """Cells get the arcs of two colours as one row, in a few bytes an arc, and unpack what was packed."""
    r = np.random.default_rng(1)
    ends = r.integers(0, 5_000, (100_000, 2)) + (r.integers(0, 3, (100_000, 2)) << 33)
    table = pa.table({"tail": ends.min(axis=1), "head": ends.max(axis=1)})
    one = graph._packed((pa.scalar(4), pa.scalar(2)), table)
    assert len(one["tails"][0].as_py()) + len(one["heads"][0].as_py()) < 5 * len(ends)
    back = graph._unpacked(pa.concat_tables([one, one.slice(0, 0), one]))
    assert back["tail_colour"].unique().to_pylist() == [4] and back["head_colour"].unique().to_pylist() == [2]
    got = list(zip(back["tail"].to_pylist(), back["heads"].combine_chunks().flatten().to_pylist()))
    assert sorted(got) == sorted(2 * list(zip(table["tail"].to_pylist(), table["head"].to_pylist())))
    edges = spark.createDataFrame([(a, b, 1) for a, b in itertools.combinations(range(30), 2)], "source long, target long, weight long")
    plan = graph.clustering_coefficient(graph.edge_ends(edges).distinct(), edges, 40)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 2 and "collect_list" not in plan
