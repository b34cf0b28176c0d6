"""A load moves no rows for empty tables, for records that nobody shares, or to look up what rows know."""

from pyspark.sql import functions as F

from paperweave.operators import ingest, provenance
from paperweave.plans import load


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_first_load_joins_nothing_with_its_empty_tables(spark):
    empty = load.empty_tables(spark)
    assert {n: t.schema.simpleString() for n, t in empty.items()} == {
        n: spark.createDataFrame([], s).schema.simpleString() for n, s in load.TABLES.items()}
    assert all(t.count() == 0 for t in empty.values())
    new = spark.createDataFrame([("p", "o", "r"), ("q", "o", "r")], "publication_id string, organization_id string, relation_type string")
    links = load._new_links(empty["publication_organization"], new, ["publication_id", "organization_id", "relation_type"])
    assert "Join" not in plan(links) and links.count() == 2


def test_rows_keep_the_entity_they_were_given(spark):
    """Authors carry their researcher, so neither the table nor the links look it up by arrival."""
    authors = spark.createDataFrame(
        [(1, "Ann A", "ann a", None), (2, "ANN A", "ann a", None), (3, "Bob", "bob", "0-1"), (None, "Cy", "cy", None)],
        "arrival long, full_name string, normalized_name string, orcid string")
    old = load.empty_tables(spark)["researcher"]
    table, who = ingest.upsert_researchers(old, authors)
    assert "arrival#" not in "".join(x for x in plan(table).splitlines() if "Join" in x)
    assert {"researcher_id", "full_name", "arrival"} <= set(who.columns) and "Join" not in plan(who)
    ids = {int(r.arrival): r.researcher_id for r in who.collect()}
    assert sorted(ids) == [1, 2, 3] and ids[1] == ids[2] != ids[3]
    assert sorted((r.researcher_id, r.full_name) for r in table.collect()) == sorted([(ids[1], "Ann A"), (ids[3], "Bob")])


def test_only_records_that_share_a_key_are_sorted(spark):
    rows = [(i, "r", "p", f"k{i % 40}" if i < 50 else f"u{i}", f"{{{i % 3}}}") for i in range(200)]
    rows += [(None, "r", "p", "never", "{}"), (900, "r", None, None, None), (901, "r", None, None, "{}")]
    recs = spark.createDataFrame(rows, "record_id long, ingestion_run_id string, entity_type string, source_identifier string, raw_payload string")
    some, every = provenance.dedupe_source_records(recs), provenance.dedupe_source_records(recs, shared_keys=0)
    order = lambda df: sorted(map(str, df.collect()))
    assert some.columns == every.columns and order(some) == order(every) and some.count() == 192
    assert "LeftAnti" in plan(some) and "LeftAnti" not in plan(every)


def test_only_relations_that_can_be_resolved_are_kept(spark):
    rel = spark.createDataFrame(
        [("o", "p", "organization", "result"), ("p", "o", "Publication", "org"), ("p", "q", "result", "result"), ("o", "x", "organization", "project")],
        "source string, target string, sourceType string, targetType string").withColumn("reltype", F.lit("affiliation"))
    mapped = ingest.map_relations(rel)
    assert sorted((r.source, r.target) for r in ingest.linking(mapped).collect()) == [("o", "p"), ("p", "o")]
    orgs = spark.createDataFrame([("O", "o")], "organization_id string, openaire_id string")
    pubs = spark.createDataFrame([("P", "p")], "publication_id string, openaire_id string")
    assert ingest.resolve_relations(mapped, orgs, pubs).count() == 2
