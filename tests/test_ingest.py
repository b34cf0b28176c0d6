import random

import pytest
from pyspark.sql import functions as F

from paperweave.operators import attribution, ingest, provenance, quality, resolve
from paperweave.operators.positions import assign_author_positions
from paperweave.plans.load import run_load
from paperweave.sources import schemas


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_author_positions_golden(spark):
    links = spark.createDataFrame([(1, "ada", 1, 1), (1, "ada", 1, 2), (1, "grace", 1, 3)],
                                  "publication_id long, researcher_id string, rank int, arrival long")
    assert rows(assign_author_positions(links), "researcher_id", "author_position") == [("ada", 1), ("grace", 2)]


def test_affiliation_rules(spark):
    auth = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c")], "publication_id long, researcher_id string")
    orgs = spark.createDataFrame([(1, "X"), (2, "X"), (2, "Y"), (3, "Z")], "publication_id long, organization_id string")
    linked, ambiguous = ingest.affiliations_single_org(orgs, auth)
    assert rows(linked, "researcher_id", "organization_id") == [("a", "X"), ("b", "X"), ("c", "Z")]
    assert rows(ambiguous, "publication_id") == [(2,)]
    resolved = orgs.withColumn("is_affiliation", F.lit(True))
    solo = ingest.affiliations_solo(resolved, auth)
    assert rows(solo, "researcher_id", "organization_id") == [("a", "X"), ("a", "Y"), ("c", "Z")]
    people = spark.createDataFrame([("a", "old"), ("c", None), ("d", "kept")], "researcher_id string, primary_organization_id string")
    fresh, links = ingest.refresh_primary(people, solo.withColumn("is_primary", F.lit(None).cast("boolean")))
    assert rows(fresh, "researcher_id", "primary_organization_id") == [("a", None), ("c", "Z"), ("d", "kept")]
    assert rows(links, "researcher_id", "organization_id", "is_primary") == [("a", "X", False), ("a", "Y", False), ("c", "Z", True)]


def test_embedded_org_variants_collapse_to_the_stable_one(spark):
    aliases = attribution.alliance_aliases(spark)
    pubs = spark.createDataFrame(
        [(1, [("pending_org_::1", "University of Catania", None, None), ("org::9", "Università di Catania", "UNICT", [("ror", "r")]),
              (None, "Universita di Catania", None, None), (None, "Other", None, None), (None, " other ", None, None)])],
        "publication_id long, organizations array<struct<id:string,legalName:string,acronym:string,"
        "pids:array<struct<scheme:string,value:string>>>>")
    got = rows(attribution.dedupe_embedded_orgs(pubs, aliases), "dedupe_key", "org_id", "legal_name")
    assert got == [("code::unict", "org::9", "Università di Catania"), ("name::other", None, "Other")]


def test_first_publication_owns_an_identifier(spark):
    pubs = spark.createDataFrame(
        [("p1", 1, "10.1/a", [("DOI", "10.1/a"), ("doi", " 10.1/a ")], ["o1", " "]), ("p2", 2, "10.1/b", [("doi", "10.1/a"), ("x", "")], ["o1"])],
        "publication_id string, arrival long, doi string, pid array<struct<scheme:string,value:string>>, originalId array<string>")
    got = rows(ingest.external_identifiers(pubs), "identifier_type", "identifier_value", "publication_id", "is_primary")
    assert got == [("doi", "10.1/a", "p1", True), ("original_id", "o1", "p1", False)]


def test_unique_value_stays_with_its_owner(spark):
    df = spark.createDataFrame([("a", 2, "v", None), ("b", 1, "v", "w"), ("c", 3, "x", None), ("d", 0, None, "keep"), ("e", 9, "z", "z"), ("f", 1, "z", None)],
                               "owner string, arrival int, value string, current string")
    got = rows(quality.assign_unique(df, "value", "owner", "arrival", "current"), "owner", "assigned")
    assert got == [("a", None), ("b", "v"), ("c", "x"), ("d", "keep"), ("e", "z"), ("f", None)]


def test_anomalies_golden(spark):
    pubs = spark.createDataFrame([(1, "bad", "x", 2020)], "publication_id long, doi string, openaire_id string, publication_year int")
    people = spark.createDataFrame([(1, "bad", "ada")], "researcher_id long, orcid string, normalized_name string")
    orgs = spark.createDataFrame([(1, "bad", "name")], "organization_id long, ror_id string, normalized_name string")
    assert (quality.publication_anomalies(pubs).count(), quality.researcher_anomalies(people).count(),
            quality.organization_anomalies(orgs).count()) == (1, 2, 1)


def test_merge_safety_golden(spark):
    auth = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, "a"), (3, 2, "c")],
                                 "publication_id long, author_position int, researcher_id string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "entity_id long, candidate_entity_id long")
    assert rows(resolve.unsafe_publications(pairs, auth), "entity_id", "candidate_entity_id") == [(1, 2)]
    same = spark.createDataFrame([("a", "b"), ("a", "c")], "entity_id string, candidate_entity_id string")
    assert rows(resolve.unsafe_researchers(same, auth), "entity_id", "candidate_entity_id") == [("a", "c")]


def test_merge_moves_children_and_fills_nulls(spark):
    pubs = spark.createDataFrame([(1, None, None, 1), (2, "abs2", None, 2), (3, "abs3", 1999, 3), (4, None, None, 4)],
                                 "publication_id long, abstract string, publication_year int, created_at int")
    auth = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (2, "b", 2), (3, "b", 2), (4, "z", 1)],
                                 "publication_id long, researcher_id string, author_position int")
    mapping = spark.createDataFrame([(2, 1), (3, 1)], "loser long, survivor long")
    out = resolve.merge_entities({"publication": pubs, "publication_author": auth}, mapping, resolve.PUBLICATION_MERGE)
    assert rows(out["publication"], "publication_id", "abstract", "publication_year") == [(1, "abs2", 1999), (4, None, None)]
    assert rows(out["publication_author"], "publication_id", "researcher_id", "author_position") == [(1, "a", 1), (1, "b", 2), (4, "z", 1)]
    assert quality.unique_violations(out["publication_author"], {"u": ["publication_id", "researcher_id"]}).isEmpty()
    assert quality.orphans(out["publication_author"], out["publication"], "publication_id", "publication_id").isEmpty()


def test_organization_merge_repoints_parents_and_people(spark):
    orgs = spark.createDataFrame([("o1", None, None, 1), ("o2", "Rome", None, 2), ("o3", None, "o2", 3)],
                                 "organization_id string, city string, parent_organization_id string, created_at int")
    people = spark.createDataFrame([("r", "o2")], "researcher_id string, primary_organization_id string")
    mapping = spark.createDataFrame([("o2", "o1")], "loser string, survivor string")
    out = resolve.merge_entities({"organization": orgs, "researcher": people}, mapping, resolve.ORGANIZATION_MERGE)
    assert rows(out["organization"], "organization_id", "city", "parent_organization_id") == [("o1", "Rome", None), ("o3", None, "o1")]
    assert rows(out["researcher"], "primary_organization_id") == [("o1",)]


def test_source_records_keep_the_first(spark):
    recs = spark.createDataFrame([(1, "r", "p", "x", "{1}"), (2, "r", "p", "x", "{2}"), (3, "r", "p", "y", "{1}"), (4, "r", "p", "y", "{1}")],
                                 "record_id long, ingestion_run_id string, entity_type string, source_identifier string, raw_payload string")
    got = rows(provenance.dedupe_source_records(recs), "record_id", "arrivals", "payload_changed")
    assert got == [(1, 2, True), (3, 2, False)]


def test_registry(spark):
    reg = spark.createDataFrame(
        [("b1", "co", "completed", True, 1), ("b2", "co", "completed", False, 2), ("b3", "co", "failed", False, 3), ("s1", "sem", "completed", False, 1)],
        "build_id string, graph_type string, status string, is_active boolean, started_at int")
    assert rows(provenance.active_build(reg), "build_id") == [("b1",), ("s1",)]
    after = provenance.activate_build(reg, "b2")
    assert rows(after.where("is_active"), "build_id") == [("b2",)]
    assert rows(provenance.activate_build(reg, "b3").where("is_active"), "build_id") == [("b1",)]


def test_attribution_golden(spark):
    orgs = spark.createDataFrame(
        [("d", "Dept of Physics", "c", "IT"), ("c", "Università di Catania", None, "IT"), ("x", "Loop A", "y", None), ("y", "Loop B", "x", None),
         ("t", "Karlstad University and University of Vaasa", None, None)],
        "organization_id string, name string, parent_organization_id string, country_code string")
    aliases = attribution.alliance_aliases(spark)
    got = rows(attribution.match_organizations(orgs, aliases), "organization_id", "code", "score")
    assert got == [("c", "unict", 130), ("d", "unict", 130)]
    lineage = rows(attribution.org_lineage(orgs).where("organization_id = 'x'"), "ancestor_id", "depth")
    assert lineage == [("x", 0), ("y", 1)]
    people = spark.createDataFrame([("r1", "d"), ("r2", None), ("r3", None)], "researcher_id string, primary_organization_id string")
    links = spark.createDataFrame([("r2", "c"), ("r3", "t")], "researcher_id string, organization_id string")
    assert rows(attribution.attribute_universities(people, links, orgs, aliases), "researcher_id", "university_code") == [
        ("r1", "unict"), ("r2", "unict")]
    assert rows(attribution.display_organization(people, links, orgs), "researcher_id", "primary_organization_id") == [
        ("r1", "d"), ("r2", "c"), ("r3", "t")]


def test_long_dictionaries_match_like_short_ones(spark):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(n))
    names = spark.createDataFrame([(text(rng.randrange(1, 6)), rng.choice(["IT", "SE", None])) for _ in range(80)],
                                  "name string, country_code string")
    aliases = spark.createDataFrame([(f"c{i % 7}", rng.choice(["IT", "", None]), text(rng.randrange(1, 8))) for i in range(40)],
                                    "code string, country_code string, alias string")
    cols = ("name", "country_code", "code", "score")
    short = rows(attribution.alias_match(names, aliases), *cols)
    assert short and short == rows(attribution.alias_match(names, aliases), *cols)


PUBS = [
    ("p1", "First paper", "2020-01-02", "10.1/a", [("Ada Lovelace", 1, "0000-0001-0000-0001"), ("Grace Hopper", 1, None)], 1),
    ("p2", "First  Paper!", "2020-05-05", None, [("Lovelace, A.", 1, "0000-0001-0000-0001")], 2),
    ("p3", "Solo paper", "2021-01-01", "10.1/c", [("Grace Hopper", 3, None), (" ", 1, None)], 3),
]


def load_inputs(spark):
    pubs = spark.createDataFrame(
        [(i, t, d, [("doi", doi)], [(n, r, (("orcid", o),) if o else None) for n, r, o in a], k) for i, t, d, doi, a, k in PUBS],
        "id string, maintitle string, publicationdate string, pid array<struct<scheme:string,value:string>>, "
        "author array<struct<fullname:string,rank:long,pid:struct<id:struct<scheme:string,value:string>>>>, arrival long"
    ).withColumn("originalId", F.array(F.concat(F.lit("o-"), "id")))
    orgs = spark.createDataFrame([("x1", "Uni X", 1), ("x2", "uni x", 2), ("y1", "Uni Y", 3)], "id string, legalname string, arrival long")
    rel = spark.createDataFrame([("y1", "p3", "organization", "result", ("hasAuthorInstitution", "affiliation"))],
                                "source string, target string, sourceType string, targetType string, reltype struct<name:string,type:string>")
    return {"publications": pubs, "organizations": orgs, "relations": rel}


@pytest.fixture(scope="module")
def loaded(spark):
    return run_load(spark, load_inputs(spark))


def test_load_builds_canonical_tables(loaded):
    tables, delta = loaded
    assert rows(tables["publication"], "title", "doi", "openaire_id") == [("First  Paper!", "10.1/a", "p2"), ("Solo paper", "10.1/c", "p3")]
    assert rows(tables["organization"], "name") == [("Uni Y",), ("uni x",)]
    assert rows(tables["researcher"], "full_name", "orcid") == [("Ada Lovelace", "0000-0001-0000-0001"), ("Grace Hopper", None)]
    names = tables["publication_author"].join(tables["researcher"], "researcher_id").join(
        tables["publication"].select("publication_id", "openaire_id"), "publication_id")
    assert rows(names, "openaire_id", "full_name", "author_position") == [
        ("p2", "Ada Lovelace", 1), ("p2", "Grace Hopper", 2), ("p3", "Grace Hopper", 3)]
    linked = tables["researcher_affiliation"].join(tables["researcher"], "researcher_id")
    assert rows(linked, "full_name", "is_primary") == [("Grace Hopper", True)]
    assert {r.table_name: r.delta for r in delta.collect()}["external_identifier"] == 2 + 3


def test_loading_again_changes_nothing(spark, loaded):
    again, delta = run_load(spark, load_inputs(spark), loaded[0])
    assert all(r.delta == 0 for r in delta.collect())
    assert rows(again["publication_author"], "publication_id", "researcher_id", "author_position") == rows(
        loaded[0]["publication_author"], "publication_id", "researcher_id", "author_position")


def test_patch_and_links(spark):
    base = spark.createDataFrame([(1, "Old", "old", "x")], "id long, title string, normalized_title string, doi string")
    patch = spark.createDataFrame([(1, "Né w", None)], "id long, title string, doi string")
    assert rows(ingest.patch_upsert(base, patch, "id", {"normalized_title": "title"}), "title", "normalized_title", "doi") == [("Né w", "ne w", "x")]
    links = spark.createDataFrame([(1, "a", 1)], "publication_id long, researcher_id string, author_position int")
    new = spark.createDataFrame([(1, "a", 2), (1, "b", 2), (9, "a", 1)], "publication_id long, researcher_id string, author_position int")
    pubs, people = spark.createDataFrame([(1,)], "publication_id long"), spark.createDataFrame([("a",), ("b",)], "researcher_id string")
    table, bad = ingest.add_links(links, new, ["publication_id", "researcher_id"],
                                  {"publication_id": (pubs, "publication_id"), "researcher_id": (people, "researcher_id")})
    assert rows(table, "publication_id", "researcher_id") == [(1, "a"), (1, "b")]
    assert rows(bad, "reason") == [("duplicate key",), ("missing publication_id",)]


def test_embedded_organizations_are_linked(spark):
    orgs = spark.createDataFrame([("k1", "Uni X", "uni x", None, None)],
                                 "organization_id string, name string, normalized_name string, ror_id string, openaire_id string")
    emb = spark.createDataFrame([(1, "id::a", "a", "Uni X", None, None), (2, "name::n", None, "New", None, None)],
                                "publication_id long, dedupe_key string, org_id string, legal_name string, acronym string, "
                                "pids array<struct<scheme:string,value:string>>")
    table, links = ingest.link_embedded_orgs(emb, orgs)
    assert rows(table, "name", "openaire_id") == [("New", None), ("Uni X", "a")]
    assert rows(links, "publication_id", "organization_id") == [(1, "k1")]


def test_mapping_reads_the_dump_schema(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"id":"a","maintitle":"T","publicationdate":"2020-01-01","subjects":[]}\n')
    raw = spark.read.schema(schemas.PUBLICATION).json(str(tmp_path))
    row = ingest.map_publications(raw).first()
    assert (row.openaire_id, row.title, row.publication_year, row.open_access) == ("a", "T", 2020, None)
