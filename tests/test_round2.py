"""Answers that must not change with size, partitioning or order of arrival."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperweave.operators import attribution, centrality, graph, ingest, positions, quality, resolve, semantic
from paperweave.plans.views import Views
from paperweave.session import Rounds, checkpoint_root
from paperweave.sources import readers


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_lineage_of_any_depth(spark):
    chain = [(f"o{i}", f"o{i + 1}" if i < 149 else None) for i in range(150)]
    out = attribution.org_lineage(spark.createDataFrame(chain, "organization_id string, parent_organization_id string"))
    assert out.count() == 150 * 151 // 2
    assert out.agg(F.max("depth")).first()[0] == 149


def test_fetches_end_by_themselves(spark):
    schema = "f string, page_number long, header struct<pageSize:long,page:long,numFound:long>, results array<struct<id:string>>"
    pages = spark.createDataFrame([
        ("a", 1, (2, 1, None), [("a1",), ("a2",)]), ("b", 1, (2, 1, None), [("b1",)]), ("a", 2, (2, 2, None), [("a3",), ("a4",)]),
        ("b", 2, (2, 2, None), [("late",)]), ("a", 3, (2, 3, None), [("a5",)]), ("c", 1, (2, 1, 4), [("c1",), ("c2",)]),
        ("c", 2, (2, 2, 4), [("c3",), ("c4",)]), ("c", 3, (2, 3, 4), [("beyond",), ("all",)]), (None, 1, (2, 1, None), [("n1",)]),
    ], schema)
    out = readers.explode_pages(pages, fetch=["f"])
    assert sorted(r.id for r in out.collect()) == ["a1", "a2", "a3", "a4", "a5", "b1", "c1", "c2", "c3", "c4", "n1"]
    assert sorted(r.id for r in readers.explode_pages(pages, 2, ["f"]).collect()) == ["a1", "a2", "b1", "c1", "c2", "n1"]


@pytest.mark.parametrize("n", [6, 40])
def test_betweenness_of_a_path_at_two_sizes(spark, n):
    edges = spark.createDataFrame([(i, i + 1, 1) for i in range(n - 1)], "source long, target long, weight long")
    out = dict(rows(centrality.betweenness(spark.range(n), edges, normalized=False), "id", "betweenness"))
    assert out == {i: float(i * (n - 1 - i)) for i in range(n)}


ORGS = "organization_id string, name string, normalized_name string, ror_id string, openaire_id string"


def test_one_short_name_does_not_make_one_organization(spark):
    raw = spark.createDataFrame(
        [("a", "Consiglio Nazionale delle Ricerche", "CNR", 1), ("b", "Centre National de Recherche", "CNR", 2), ("c", "CNR", None, 3)],
        "id string, legalname string, legalshortname string, arrival long")
    table, who = ingest.upsert_organizations(spark.createDataFrame([], ORGS), ingest.map_organizations(raw))
    assert rows(table, "name", "openaire_id") == [("CNR", "b"), ("CNR", "c")]  # the third's legal name is the first's key
    stored = spark.createDataFrame([("k", "CNR", "cnr", None, None)], ORGS)
    assert rows(ingest.upsert_organizations(stored, ingest.map_organizations(raw))[0], "openaire_id") == [("a",), ("b",), ("c",)]
    assert who.count() == 3


def test_merges_keep_one_researcher_per_position(spark):
    docs = spark.createDataFrame([(1, "d", 1), (2, "d", 2), (3, "d", 3), (4, "d", 4)], "publication_id long, doi string, created_at long")
    links = spark.createDataFrame([(1, 1, 10), (2, 2, 20), (3, 2, 30), (4, 3, 40)], "publication_id long, author_position int, researcher_id long")
    found = resolve.exact_duplicates(docs, "doi", "publication_id", authorship=links)
    assert rows(found, "candidate_entity_id", "auto_applied") == [(2, True), (3, False), (4, True)]
    mapping = found.where("auto_applied").select(F.col("candidate_entity_id").alias("loser"), F.col("entity_id").alias("survivor"))
    tables = resolve.merge_entities({"publication": docs, "publication_author": links}, mapping, resolve.PUBLICATION_MERGE)
    assert rows(tables["publication_author"], "publication_id", "author_position", "researcher_id") == [
        (1, 1, 10), (1, 2, 20), (1, 3, 40), (3, 2, 30)]
    assert quality.audit_unique({"publication_author": tables["publication_author"]}).count() == 0


def test_the_oldest_row_survives_its_cluster(spark):
    rows_ = spark.createDataFrame([(1, 20), (2, 10), (3, 30), (4, 5)], "id long, created_at long")
    pairs = spark.createDataFrame([(2, 1, True), (1, 3, True), (3, 4, False)], "entity_id long, candidate_entity_id long, mergeable boolean")
    assert rows(resolve.duplicate_clusters(pairs, rows_, "id"), "loser", "survivor") == [(1, 2), (3, 2)]


def test_identifiers_are_tried_in_order(spark):
    pubs = spark.createDataFrame([(1, "d", "x", 1), (2, "d", "x", 2), (3, None, "x", 3)],
                                 "publication_id long, doi string, openaire_id string, created_at long")
    none = spark.createDataFrame([], "publication_id long, author_position int, researcher_id long")
    out = resolve.identifier_duplicates({"publication": pubs}, none)
    assert rows(out, "entity_id", "candidate_entity_id", "identifier") == [("1", "2", "doi"), ("1", "3", "openaire_id")]


def test_vectors_that_are_null_have_no_neighbours(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.1]), (3, None), (4, [0.0, 1.0])], "id long, embedding array<float>")
    assert rows(semantic.knn(df, 1, 0.5), "source", "target") == [(1, 2), (2, 1)]
    ragged = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99])], "id long, embedding array<float>")
    with pytest.raises(Exception, match="one length"):
        semantic.knn(ragged, 1, 0.5).collect()


def test_approximate_neighbours_do_not_depend_on_partitions(spark):
    vectors = Views(spark, "/root/testdata/sf0.001").vectors()
    got = [rows(semantic.knn(vectors.repartition(n), 5, 0.3, method="lsh", block_rows=32, tables=3), "source", "target", "score")
           for n in (2, 8, 64)]
    assert got[0] == got[1] == got[2] and got[0]


def test_earlier_smaller_values():
    values = np.random.default_rng(0).integers(0, 50, 1_000)
    want = [int((values[:i] < values[i]).sum()) for i in range(len(values))]
    assert positions.earlier_smaller(values).tolist() == want
    assert positions.earlier_smaller(np.array([], int)).tolist() == []


def test_one_node_without_the_whole_graph(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    whole = graph.coauthor_edges(v.authorship(), v.publication())
    cols = ("source", "target", "weight", "first_collaboration_year")
    assert rows(graph.edges_around(v.authorship(), v.publication(), 17), *cols) == rows(graph.incident(whole, 17), *cols)
    assert rows(graph.ego_edges(v.authorship(), v.publication(), 17), *cols) == rows(graph.ego_network(whole, 17), *cols)


def test_common_beginnings_do_not_meet(spark):
    names = spark.createDataFrame([(f"university of place{i}", None) for i in range(300)], "name string, country_code string")
    aliases = spark.createDataFrame([(f"c{i}", None, f"university of place{i}") for i in range(0, 300, 3)],
                                    "code string, country_code string, alias string")
    out = attribution.alias_match(names, aliases)
    exact = [(f"university of place{i}", f"c{i}") for i in range(0, 300, 3)]
    assert set(exact) <= set(rows(out, "name", "code"))
    want = {(f"university of place{i}", f"c{j}") for i in range(300) for j in range(0, 300, 3)
            if str(j) == str(i) or str(i).startswith(str(j)) or str(j).startswith(str(i))}
    assert set(rows(out, "name", "code")) == want


def test_rounds_lie_in_one_place_and_go(spark):
    root = checkpoint_root(spark)
    assert root == checkpoint_root(spark) and spark.sparkContext.applicationId in root
    rounds = Rounds(spark, "t")
    kept = rounds.cut(spark.range(3))
    folder = rounds.base.removeprefix("file://")
    import os
    assert len(os.listdir(folder)) == 1
    rounds.drop(kept)
    assert os.listdir(folder) == []
