"""Entities are matched and linked once per distinct key."""

from pyspark.sql import functions as F

from paperweave.operators import ingest


def test_rows_of_one_name_are_linked_once(spark, monkeypatch):
    """3,000 rows of three names and no ORCID: three nodes to connect, not 3,000."""
    seen, plain = [], ingest.connected_components

    def counted(nodes, edges):
        seen.append((nodes.count(), edges.count()))
        return plain(nodes, edges)

    monkeypatch.setattr(ingest, "connected_components", counted)
    rows = spark.range(3_000).select(
        F.col("id").alias("arrival"), F.lit(None).cast("string").alias("orcid"),
        F.concat(F.lit("name "), (F.col("id") % 3).cast("string")).alias("normalized_name"))
    old = spark.createDataFrame([("r1", None, "name 1")], "researcher_id string, orcid string, normalized_name string")
    got = ingest.assign_entities(old, rows, "researcher_id", ingest.RESEARCHER_KEYS, "researcher")
    found = got.groupBy((F.col("arrival") % 3).alias("m")).agg(
        F.count("*").alias("n"), F.collect_set("researcher_id").alias("ids"), F.bool_or("is_new").alias("new")).orderBy("m").collect()
    assert seen == [(3, 0)]
    assert [(r.n, len(r.ids), r.new) for r in found] == [(1_000, 1, True), (1_000, 1, False), (1_000, 1, True)]
    assert found[1].ids == ["r1"]


def test_rows_without_own_keys_stay_apart(spark):
    """Equal match names tie nothing unless a row stores them; rows without any key are entities of their own."""
    schema = "arrival bigint, openaire_id string, ror_id string, match_name string, normalized_name string"
    rows = spark.createDataFrame([
        (1, None, None, "m", "x"), (2, None, None, "m", "x"), (3, None, None, None, "m"), (4, None, None, "m", "x"),
        (5, "", None, None, None), (6, "", None, None, None)], schema)
    old = spark.createDataFrame([], "organization_id string, openaire_id string, ror_id string, normalized_name string")
    got = ingest.assign_entities(old, rows, "organization_id", ingest.ORGANIZATION_KEYS, "organization", ingest.ORGANIZATION_STORED)
    ids = {r.arrival: r.organization_id for r in got.collect()}
    assert len(ids) == 6
    assert ids[3] == ids[4]  # row 3 stores the name that row 4, after it, looks up
    assert len({ids[1], ids[5], ids[6]}) == 3
