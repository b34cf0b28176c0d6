"""Registered catalog, text, quality, provenance and registry queries."""

from pyspark.sql import functions as F

from paperweave.functions import payload as px
from paperweave.functions import text as tx
from paperweave.operators import catalog, graph, ingest, provenance, quality
from paperweave.operators.grouping import member_overlap, sorted_sets, top_k_per_key
from paperweave.plans.registry import query

NORMAL = "trim(regexp_replace(replace(lower(strip_accents({0})), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))"
CLEAN = "nullif(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '')"
DOI = "regexp_matches({0}, '^10\\.[0-9]{{4,9}}/[-._;()/:a-z0-9]+$', 'i')"


# text -----------------------------------------------------------------------------------


@query("normalize_text", "document_publication", f"""
    SELECT publication_id, {NORMAL.format('title')} AS normalized_title,
      sha256({NORMAL.format('abstract')}) AS normalized_abstract_hash FROM document_publication""")
def normalize_text(v):
    return v.document_publication().select(
        "publication_id", tx.normalize_text(F.col("title")).alias("normalized_title"),
        F.sha2(tx.normalize_text(F.col("abstract")), 256).alias("normalized_abstract_hash"),
    )


@query("clean_text", "document_publication", f"""
    SELECT publication_id, {CLEAN.format('title')} AS title, sha256({CLEAN.format('abstract')}) AS abstract_hash
    FROM document_publication""")
def clean_text(v):
    return v.document_publication().select(
        "publication_id", tx.clean_text(F.col("title")).alias("title"),
        F.sha2(tx.clean_text(F.col("abstract")), 256).alias("abstract_hash"),
    )


@query("clip_text", "document_publication", """
    SELECT publication_id, CASE WHEN length(abstract) <= 255 THEN abstract
      ELSE regexp_replace(substr(abstract, 1, 255), '\\s+$', '') END AS clipped FROM document_publication""")
def clip_text(v):
    return v.document_publication().select("publication_id", tx.clip_text(F.col("abstract"), 255).alias("clipped"))


@query("publication_label", "document_publication", f"""
    SELECT publication_id, CASE WHEN length(t) <= 120 THEN t ELSE substr(t, 1, 117) || '...' END AS label
    FROM (SELECT publication_id, coalesce({CLEAN.format('title')}, '') AS t FROM document_publication)""")
def publication_label(v):
    return v.document_publication().select("publication_id", tx.publication_label(F.col("title")).alias("label"))


@query("identifier_validation", "document_publication", f"""
    SELECT publication_id, {DOI.format('doi')} AS doi_ok,
      regexp_matches(orcid, '^[0-9]{{4}}-[0-9]{{4}}-[0-9]{{4}}-[0-9]{{3}}[0-9X]$', 'i') AS orcid_ok,
      regexp_matches(ror, '^https://ror\\.org/[a-z0-9]{{9}}$', 'i') AS ror_ok
    FROM (SELECT publication_id, doi, lpad(CAST(publication_id AS VARCHAR), 4, '0') || '-0001-5109-'
        || CASE WHEN publication_id % 5 = 0 THEN '37x' ELSE '370x' END AS orcid,
      'https://ror.org/' || lpad(CAST(publication_id AS VARCHAR), CASE WHEN publication_id % 4 = 0 THEN 8 ELSE 9 END, 'a') AS ror
      FROM document_publication)""")
def identifier_validation(v):
    ident = F.col("publication_id").cast("string")
    orcid = F.concat(F.lpad(ident, 4, "0"), F.lit("-0001-5109-"),
                     F.when(F.col("publication_id") % 5 == 0, "37x").otherwise("370x"))
    ror = F.concat(F.lit("https://ror.org/"), F.when(F.col("publication_id") % 4 == 0, F.lpad(ident, 8, "a"))
                   .otherwise(F.lpad(ident, 9, "a")))
    return v.document_publication().select(
        "publication_id", px.is_valid_doi(F.col("doi")).alias("doi_ok"), px.is_valid_orcid(orcid).alias("orcid_ok"),
        px.is_valid_ror(ror).alias("ror_ok"),
    )


@query("parse_date", "publication", """
    SELECT publication_id, CASE WHEN publication_id % 10 = 0 THEN NULL
      ELSE CAST(publication_date AS VARCHAR) END AS parsed,
      CASE WHEN publication_id % 10 = 0 THEN '1999-13-45' WHEN publication_id % 10 = 1 THEN NULL
        ELSE CAST(publication_date AS VARCHAR) || 'T00:00' END AS sanitized FROM publication""")
def parse_date(v):
    digit = F.col("publication_id") % 10
    iso = F.date_format("publication_date", "yyyy-MM-dd")
    raw = F.when(digit == 0, "1999-13-45").otherwise(F.concat(iso, F.lit("T00:00")))
    odd = F.when(digit == 1, F.concat(F.lit("3999"), F.substring(raw, 5, 20))).otherwise(F.concat(F.lit("  "), raw))
    return v.publication().select(
        "publication_id", px.parse_iso_date(raw).cast("string").alias("parsed"),
        px.sanitize_publication_date(odd).alias("sanitized"),
    )


@query("point_id", "document_publication", """
    SELECT publication_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
      || substr('89ab', 1 + (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
    FROM (SELECT publication_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8')
      || encode('publication:' || publication_id || ':provider:model:v1')) AS h FROM document_publication)""")
def point_id(v):
    return v.document_publication().select(
        "publication_id", px.point_id(F.col("publication_id"), "provider", "model", "v1").alias("point_id")
    )


# catalog --------------------------------------------------------------------------------------


@query("table_counts", "", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in
    ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
     "pages", "benchmark", "labels", "conversations")))
def table_counts(v):
    names = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
             "labels conversations").split()
    return catalog.table_counts({n: v.table(n) for n in names})


@query("data_snapshot", "publication authorship source_record", """
    SELECT 'publication' AS table_name, count(*) AS row_count, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_change FROM publication
    UNION ALL SELECT 'authorship', count(*), strftime(max(created_at), '%Y-%m-%d %H:%M:%S') FROM authorship
    UNION ALL SELECT 'source_record', count(*), strftime(max(ingested_at), '%Y-%m-%d %H:%M:%S') FROM source_record""")
def data_snapshot(v):
    return catalog.data_snapshot({
        "publication": (v.publication(), "created_at"), "authorship": (v.authorship(), "created_at"),
        "source_record": (v.source_record(), "ingested_at"),
    })


@query("load_delta", "source_record authorship publication", """
    SELECT 'record' AS table_name, count(*) AS rows_after, count(*) FILTER (WHERE ingested_at < TIMESTAMP '2024-01-08') AS rows_before,
      count(*) FILTER (WHERE ingested_at >= TIMESTAMP '2024-01-08') AS delta FROM source_record
    UNION ALL SELECT 'publication', count(*), count(*) FILTER (WHERE publication_year < 1998),
      count(*) FILTER (WHERE publication_year >= 1998) FROM publication""")
def load_delta(v):
    records, pubs = v.source_record(), v.publication()
    before = catalog.table_counts({
        "record": records.where(F.col("ingested_at") < F.lit("2024-01-08").cast("timestamp_ntz")),
        "publication": pubs.where(F.col("publication_year") < 1998),
    })
    return catalog.load_delta(before, catalog.table_counts({"record": records, "publication": pubs}))


@query("year_range", "publication", """
    SELECT CAST(min(publication_year) AS INT) AS first_year, CAST(max(publication_year) AS INT) AS last_year FROM publication""")
def year_range(v):
    return catalog.year_range(v.publication(), px.publication_year(F.col("publication_year"), F.col("publication_date")))


@query("entity_lookup", "document_publication", """
    SELECT publication_id, title, doi FROM document_publication WHERE publication_id = 42""")
def entity_lookup(v):
    return catalog.entity_lookup(v.document_publication(), publication_id=42).select("publication_id", "title", "doi")


FOUND = f"contains({NORMAL.format('title')}, 'que') AND language_code IN ('fr', 'es')"


@query("list_publications", "document_publication", f"""
    SELECT publication_id, title, language_code FROM document_publication WHERE {FOUND}
    ORDER BY publication_id DESC LIMIT 50 OFFSET 10""")
def list_publications(v):
    page = catalog.list_entities(
        v.document_publication(), [F.desc("publication_id")], limit=50, offset=10,
        contains={"title": "Qué"}, equals={"language_code": ["fr", "es"]},
    )
    return page.select("publication_id", "title", "language_code")


@query("count_publications", "document_publication", f"SELECT count(*) AS count FROM document_publication WHERE {FOUND}")
def count_publications(v):
    return catalog.count_entities(
        v.document_publication(), contains={"title": "Qué"}, equals={"language_code": ["fr", "es"]}
    )


@query("count_by_year", "publication", """
    SELECT count(*) AS count FROM publication WHERE publication_year BETWEEN 1996 AND 1998""")
def count_by_year(v):
    return catalog.count_entities(v.publication(), year_from=1996, year_to=1998)


@query("quick_search", "document_publication researcher organization", f"""
    SELECT * FROM (SELECT 'publication' AS entity_type, CAST(publication_id AS VARCHAR) AS entity_id, title AS label
      FROM document_publication WHERE contains({NORMAL.format('title')}, 'in') ORDER BY publication_id DESC LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'researcher', CAST(researcher_id AS VARCHAR), full_name FROM researcher
      WHERE contains({NORMAL.format('full_name')}, 'in') ORDER BY researcher_id DESC LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'organization', organization_id, name FROM organization
      WHERE contains({NORMAL.format('name')}, 'in') ORDER BY organization_id DESC LIMIT 5)""")
def quick_search(v):
    return catalog.quick_search({
        "publication": (v.document_publication(), "publication_id", "title", [F.desc("publication_id")]),
        "researcher": (v.researcher(), "researcher_id", "full_name", [F.desc("researcher_id")]),
        "organization": (v.organization(), "organization_id", "name", [F.desc("organization_id")]),
    }, "in")


@query("publication_detail", "publication authorship researcher publication_organization organization", """
    SELECT p.publication_id, p.publication_year, 'author' AS line_type, CAST(author_position AS BIGINT) AS position,
      CAST(r.researcher_id AS VARCHAR) AS entity_id, full_name AS name
    FROM publication p JOIN authorship a ON a.publication_id = p.publication_id
    JOIN researcher r ON r.researcher_id = a.researcher_id
    UNION ALL SELECT p.publication_id, p.publication_year, 'organization', NULL, o.organization_id, o.name
    FROM publication p JOIN publication_organization l ON l.publication_id = p.publication_id
    JOIN organization o ON o.organization_id = l.organization_id""".replace("p.publication_year", "CAST(p.publication_year AS INT) AS publication_year", 1))
def publication_detail(v):
    return catalog.publication_detail(
        v.authorship(), v.researcher(), v.publication_organization(), v.organization(), v.publication()
    )


@query("authorship_enriched", "authorship researcher publication organization researcher_affiliation", """
    SELECT a.publication_id, a.researcher_id, a.author_position, r.full_name, p.publication_year,
      o.name AS organization_name, coalesce(n.affiliations, 0) AS affiliations
    FROM authorship a JOIN researcher r ON r.researcher_id = a.researcher_id
    JOIN publication p ON p.publication_id = a.publication_id
    LEFT JOIN organization o ON o.organization_id = r.primary_organization_id
    LEFT JOIN (SELECT researcher_id, count(*) AS affiliations FROM researcher_affiliation GROUP BY 1) n
      ON n.researcher_id = a.researcher_id""")
def authorship_enriched(v):
    return graph.enrich_authorship(
        v.authorship(), v.researcher(), v.publication(), v.organization(), v.researcher_affiliation()
    ).select("publication_id", "researcher_id", "author_position", "full_name", "publication_year",
             "organization_name", "affiliations")


@query("author_overlap", "authorship", """
    SELECT l.publication_id AS "left", r.publication_id AS "right", count(*) AS overlap
    FROM (SELECT DISTINCT publication_id, researcher_id FROM authorship) l
    JOIN (SELECT DISTINCT publication_id, researcher_id FROM authorship) r
      ON r.publication_id = l.publication_id + 1 AND r.researcher_id = l.researcher_id GROUP BY 1, 2""")
def author_overlap(v):
    ids = v.authorship().select("publication_id").distinct()
    pairs = ids.select(F.col("publication_id").alias("left"), (F.col("publication_id") + 1).alias("right"))
    return member_overlap(v.authorship(), pairs, "publication_id", "researcher_id").where(F.col("overlap") > 0)


@query("publication_org_arrays", "publication_organization organization", """
    SELECT publication_id, string_agg(organization_id, ',' ORDER BY organization_id) AS organization_ids,
      string_agg(name, ',' ORDER BY name) AS organization_names
    FROM publication_organization JOIN organization USING (organization_id) GROUP BY 1""")
def publication_org_arrays(v):
    rows = v.publication_organization().join(v.organization().select("organization_id", "name"), "organization_id")
    sets = sorted_sets(
        rows.withColumnsRenamed({"organization_id": "organization_ids", "name": "organization_names"}),
        "publication_id", ["organization_ids", "organization_names"],
    )
    return sets.select("publication_id", F.array_join("organization_ids", ",").alias("organization_ids"),
                       F.array_join("organization_names", ",").alias("organization_names"))


@query("top_k_per_key", "authorship publication", """
    SELECT researcher_id, publication_id, CAST(place AS INT) AS place FROM (SELECT researcher_id, publication_id,
      row_number() OVER (PARTITION BY researcher_id ORDER BY created_at DESC, publication_id DESC) AS place
      FROM (SELECT DISTINCT researcher_id, publication_id, created_at FROM authorship)) WHERE place <= 3""")
def newest_papers(v):
    rows = v.authorship().select("researcher_id", "publication_id", "created_at").distinct()
    return top_k_per_key(rows, ["researcher_id"], [F.desc("created_at"), F.desc("publication_id")], 3, rank="place").drop(
        "created_at")


# quality ------------------------------------------------------------------------------------------


@query("unique_violations", "authorship document_publication source_record", """
    SELECT 'publication_researcher' AS constraint_name, publication_id || '|' || researcher_id AS key_value, count(*) AS row_count
      FROM authorship GROUP BY publication_id, researcher_id HAVING count(*) > 1
    UNION ALL SELECT 'publication_position', publication_id || '|' || author_position, count(*)
      FROM authorship GROUP BY publication_id, author_position HAVING count(*) > 1
    UNION ALL SELECT 'publication_doi', doi, count(*) FROM document_publication WHERE doi IS NOT NULL
      GROUP BY doi HAVING count(*) > 1
    UNION ALL SELECT 'publication_source', 's' || publication_id % 500, count(*) FROM document_publication GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'organization_ror', 'r' || c_custkey % 90, count(*) FROM customer WHERE c_custkey % 2 = 0 GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'organization_source', 'n' || c_nationkey, count(*) FROM customer GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'researcher_orcid', p_brand, count(*) FROM part GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'publication_organization', l_orderkey || '|' || l_suppkey || '|' || l_returnflag, count(*) FROM lineitem
      GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'publication_embedding', (l_partkey % 9) || '|p|m|' || l_linenumber, count(*) FROM lineitem GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'external_identifier', 'publication|' || l_linenumber || '|' || l_orderkey, count(*) FROM lineitem GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'source_record', ingestion_run_id || '|' || entity_type || '|' || source_identifier, count(*) FROM source_record
      GROUP BY 2 HAVING count(*) > 1""")
def unique_violations(v):
    """Every unique key of the canonical tables, over tables that break each of them."""
    text = lambda c: F.col(c).cast("string")
    lines = v.table("lineitem")
    return quality.audit_unique({
        "publication": v.document_publication().select(
            "doi", F.concat(F.lit("s"), (F.col("publication_id") % 500).cast("string")).alias("openaire_id")),
        "organization": v.table("customer").select(
            F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("r"), (F.col("c_custkey") % 90).cast("string"))).alias("ror_id"),
            F.concat(F.lit("n"), text("c_nationkey")).alias("openaire_id")),
        "researcher": v.table("part").select(F.col("p_brand").alias("orcid")),
        "publication_author": v.authorship(),
        "publication_organization": lines.select(
            F.col("l_orderkey").alias("publication_id"), F.col("l_suppkey").alias("organization_id"), F.col("l_returnflag").alias("relation_type")),
        "publication_embedding": lines.select(
            (F.col("l_partkey") % 9).alias("publication_id"), F.lit("p").alias("embedding_provider"), F.lit("m").alias("embedding_model"),
            F.col("l_linenumber").alias("embedding_version")),
        "external_identifier": lines.select(
            F.lit("publication").alias("entity_type"), F.col("l_linenumber").alias("identifier_type"), F.col("l_orderkey").alias("identifier_value")),
        "source_record": v.source_record(),
    })


@query("orphan_links", "authorship publication_organization researcher researcher_affiliation organization", """
    SELECT t AS table_name, k AS foreign_key, CAST(x AS VARCHAR) AS key_value, count(*) AS row_count FROM (
      SELECT 'publication_author' AS t, 'publication_id' AS k, CAST(publication_id AS VARCHAR) AS x FROM authorship WHERE publication_id % 9 = 0
      UNION ALL SELECT 'publication_author', 'researcher_id', researcher_id FROM authorship WHERE researcher_id % 10 = 0
      UNION ALL SELECT 'publication_organization', 'publication_id', publication_id FROM publication_organization WHERE publication_id % 9 = 0
      UNION ALL SELECT 'publication_organization', 'organization_id', organization_id FROM publication_organization WHERE organization_id LIKE '%2'
      UNION ALL SELECT 'researcher_affiliation', 'researcher_id', researcher_id FROM researcher_affiliation WHERE researcher_id % 10 = 0
      UNION ALL SELECT 'researcher_affiliation', 'organization_id', organization_id FROM researcher_affiliation WHERE organization_id LIKE '%2'
      UNION ALL SELECT 'researcher', 'primary_organization_id', primary_organization_id FROM researcher
        WHERE researcher_id % 10 <> 0 AND primary_organization_id NOT IN (SELECT organization_id FROM organization WHERE organization_id NOT LIKE '%2')
      UNION ALL SELECT 'organization', 'parent_organization_id', parent_organization_id FROM organization
        WHERE organization_id NOT LIKE '%2' AND parent_organization_id LIKE '%2')
    GROUP BY 1, 2, 3""")
def orphan_links(v):
    """All links, with every ninth publication, tenth person and the organizations on 2 taken away."""
    return quality.audit_links({
        "publication": v.publication().where(F.col("publication_id") % 9 != 0),
        "researcher": v.researcher().where(F.col("researcher_id") % 10 != 0),
        "organization": v.organization().where(~F.col("organization_id").endswith("2")),
        "publication_author": v.authorship(), "publication_organization": v.publication_organization(),
        "researcher_affiliation": v.researcher_affiliation(),
    })


@query("range_violations", "document_publication publication authorship", """
    SELECT 'title_length' AS rule, CAST(publication_id AS VARCHAR) AS entity_id FROM document_publication WHERE length(title) > 100
    UNION ALL SELECT 'language_length', CAST(publication_id AS VARCHAR) FROM document_publication WHERE length(language_code) > 16
    UNION ALL SELECT 'position_range', CAST(publication_id AS VARCHAR) FROM authorship WHERE author_position > 6
    UNION ALL SELECT 'year_range', CAST(publication_id AS VARCHAR) FROM publication WHERE publication_year NOT BETWEEN 1000 AND 3000""")
def range_violations(v):
    docs = quality.range_violations(v.document_publication(), "publication_id", {
        "title_length": quality.length_at_most("title", 100), "language_length": quality.length_at_most("language_code", 16),
    })
    links = quality.range_violations(v.authorship(), "publication_id", {"position_range": F.col("author_position").between(1, 6)})
    years = quality.range_violations(v.publication(), "publication_id", {"year_range": quality.year_in_range()})
    return docs.unionByName(links).unionByName(years)


def doc_catalog(v):
    """Documents as publications, with date columns of the order of the same number."""
    dates = v.publication().select("publication_id", "publication_year", "publication_date", "created_at")
    docs = v.document_publication().join(dates, "publication_id", "left")
    return docs.withColumns({
        "openaire_id": F.when(F.col("publication_id") % 7 != 0, F.concat(F.lit("id::"), F.col("publication_id").cast("string"))),
        "publication_year": F.when(F.col("publication_id") % 3 != 0, F.col("publication_year")),
        "normalized_title": tx.normalize_text(F.col("title")),
        "journal_name": F.lit(None).cast("string"),
    })


DOC_CATALOG = f"""docs AS (SELECT d.publication_id, d.title, d.abstract, d.language_code, d.venue_name, d.doi,
      CASE WHEN d.publication_id % 7 <> 0 THEN 'id::' || d.publication_id END AS openaire_id,
      CASE WHEN d.publication_id % 3 <> 0 THEN p.publication_year END AS publication_year,
      {NORMAL.format('title')} AS normalized_title, p.created_at
    FROM document_publication d LEFT JOIN publication p ON p.publication_id = d.publication_id)"""


@query("publication_anomalies", "document_publication publication", f"""
    SELECT 'publication' AS entity_type, CAST(publication_id AS VARCHAR) AS entity_id, 'incomplete_record' AS finding_type,
      'manual_review_needed' AS confidence FROM docs WHERE doi IS NULL AND openaire_id IS NULL AND publication_year IS NULL
    UNION ALL SELECT 'publication', CAST(publication_id AS VARCHAR), 'malformed_identifier', 'manual_review_needed'
      FROM docs WHERE doi IS NOT NULL AND NOT {DOI.format('doi')}""", DOC_CATALOG)
def publication_anomalies(v):
    return quality.publication_anomalies(doc_catalog(v)).drop("message")


def people(v):
    ident = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 6 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(F.col("p_name"))
    return v.table("part").select(
        F.col("p_partkey").alias("researcher_id"), name.alias("full_name"),
        tx.normalize_text(name).alias("normalized_name"),
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("0000-0002-"), F.lpad(ident, 4, "0"), F.lit("-000"),
               F.when(F.col("p_partkey") % 8 == 0, "").otherwise("X"))).alias("orcid"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("S:"), (F.col("p_partkey") % 10).cast("string")))
        .alias("primary_organization_id"),
        F.col("p_partkey").alias("created_at"),
    )


PEOPLE = f"""people AS (SELECT p_partkey AS researcher_id,
      CASE WHEN p_partkey % 6 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END AS full_name,
      {NORMAL.format("CASE WHEN p_partkey % 6 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END")} AS normalized_name,
      CASE WHEN p_partkey % 4 = 0 THEN '0000-0002-' || lpad(CAST(p_partkey AS VARCHAR), 4, '0') || '-000'
        || CASE WHEN p_partkey % 8 = 0 THEN '' ELSE 'X' END END AS orcid,
      CASE WHEN p_partkey % 3 = 0 THEN 'S:' || (p_partkey % 10) END AS primary_organization_id FROM part)"""


@query("researcher_anomalies", "", """
    SELECT 'researcher' AS entity_type, CAST(researcher_id AS VARCHAR) AS entity_id, 'malformed_identifier' AS finding_type,
      'manual_review_needed' AS confidence FROM people
      WHERE orcid IS NOT NULL AND NOT regexp_matches(orcid, '^[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]$', 'i')
    UNION ALL SELECT 'researcher', CAST(researcher_id AS VARCHAR), 'incomplete_record', 'possible_match' FROM people
      WHERE normalized_name NOT LIKE '% %'""", PEOPLE)
def researcher_anomalies(v):
    return quality.researcher_anomalies(people(v)).drop("message")


@query("organization_anomalies", "organization", f"""
    SELECT 'organization' AS entity_type, organization_id AS entity_id, 'malformed_identifier' AS finding_type,
      'manual_review_needed' AS confidence FROM organization
      WHERE organization_type = 'supplier' AND length(organization_id) % 2 = 0
    UNION ALL SELECT 'organization', organization_id, 'incomplete_record', 'manual_review_needed' FROM organization
      WHERE organization_type = 'region'""")
def organization_anomalies(v):
    kind = F.col("organization_type")
    orgs = v.organization().withColumns({
        "ror_id": F.when(kind == "supplier", F.concat(
            F.lit("https://ror.org/0abcdefg"), F.when(F.length("organization_id") % 2 == 0, "").otherwise("1"))),
        "normalized_name": F.when(kind == "region", "").otherwise(tx.normalize_text(F.col("name"))),
    })
    return quality.organization_anomalies(orgs).drop("message")


def all_findings(v):
    docs = doc_catalog(v)
    stamped = docs.select(F.col("publication_id").cast("string").alias("entity_id"), "created_at")
    return quality.publication_anomalies(docs).drop("message").join(stamped, "entity_id").withColumn("auto_applied", F.lit(False))


@query("findings_filter", "document_publication publication", f"""
    SELECT 'publication' AS entity_type, CAST(publication_id AS VARCHAR) AS entity_id, 'malformed_identifier' AS finding_type
    FROM docs WHERE doi IS NOT NULL AND NOT {DOI.format('doi')}
    ORDER BY created_at DESC, CAST(publication_id AS VARCHAR) LIMIT 100""", DOC_CATALOG)
def findings_filter(v):
    return quality.list_findings(
        all_findings(v), limit=100, finding_type="malformed_identifier", confidence="manual_review_needed", auto_applied=False
    ).select("entity_type", "entity_id", "finding_type")


@query("assign_unique", "document_publication", """
    SELECT publication_id, CASE WHEN publication_id = min(publication_id) OVER (PARTITION BY doi) THEN doi END AS doi
    FROM document_publication""")
def assign_unique(v):
    docs = v.document_publication().select("publication_id", "doi").withColumn("current_doi", F.lit(None).cast("string"))
    return quality.assign_unique(docs, "doi", "publication_id", "publication_id", "current_doi").select(
        "publication_id", F.col("assigned").alias("doi"))


# provenance and registry -----------------------------------------------------------------------------


@query("source_record_dedupe", "source_record", """
    SELECT ingestion_run_id, entity_type, source_identifier, min(record_id) AS record_id,
      arg_min(raw_payload, record_id) AS raw_payload, count(*) AS arrivals,
      count(DISTINCT raw_payload) > 1 AS payload_changed
    FROM source_record GROUP BY 1, 2, 3""")
def source_record_dedupe(v):
    return provenance.dedupe_source_records(v.source_record()).select(
        "ingestion_run_id", "entity_type", "source_identifier", "record_id", "raw_payload", "arrivals", "payload_changed")


def sources(v):
    kinds = v.source_record().select("entity_type").distinct()
    return kinds.select(
        F.col("entity_type").alias("data_source_id"), F.concat(F.lit("source "), "entity_type").alias("name"),
        F.when(F.col("entity_type").isin("view", "click"), "dump").otherwise("manual").alias("source_type"),
    )


@query("provenance_by_source", "source_record", """
    SELECT record_id, source_identifier, 'source ' || entity_type AS name FROM source_record WHERE entity_type IN ('view', 'click')""")
def provenance_by_source(v):
    records = v.source_record().withColumn("data_source_id", F.col("entity_type"))
    return catalog.provenance_by_source(records, sources(v), "dump").select("record_id", "source_identifier", "name")


@query("provenance_filter", "source_record", """
    SELECT record_id, source_identifier, raw_payload FROM source_record
    WHERE entity_type = 'click' AND source_identifier = 'u:46' ORDER BY ingested_at DESC, record_id DESC LIMIT 20""")
def provenance_filter(v):
    return provenance.filter_provenance(v.source_record(), limit=20, entity_type="click", source_identifier="u:46").select(
        "record_id", "source_identifier", "raw_payload")


@query("provenance_records", "source_record", """
    SELECT 'event' AS entity_type, CAST(record_id AS VARCHAR) AS source_identifier, 'create' AS action,
      sha256('{"action":"create","canonical_entity_id":"' || record_id || '","entity_type":"event","payload":{"kind":"'
        || entity_type || '","record_id":' || record_id || '}}') AS checksum FROM source_record""")
def provenance_records(v):
    rows = v.source_record().select("record_id", F.col("entity_type").alias("kind"))
    return provenance.provenance_records(rows, "create", "event", "record_id").drop("raw_payload")


@query("payload_checksum", "source_record", """
    SELECT record_id, sha256('{"entity_type":"' || entity_type || '","record_id":' || record_id
      || ',"source_identifier":"' || source_identifier || '"}') AS checksum FROM source_record""")
def payload_checksum(v):
    records = v.source_record().select("source_identifier", "record_id", "entity_type")
    return records.select("record_id", px.checksum(records).alias("checksum"))


@query("payload_identifier", "source_record", """
    SELECT record_id, CASE WHEN record_id % 10 = 0 THEN 'generated::' || sha256('{"id":" ","originalId":["",null]}')
      WHEN record_id % 10 = 1 THEN 'orig ' || record_id ELSE source_identifier END AS identifier FROM source_record""")
def payload_identifier(v):
    digit = F.col("record_id") % 10
    raw = v.source_record().select(
        "record_id",
        F.when(digit <= 1, " ").otherwise(F.concat(F.lit(" "), "source_identifier")).alias("id"),
        F.when(digit == 1, F.array(F.lit(" "), F.concat(F.lit("orig "), F.col("record_id").cast("string"))))
        .when(digit == 0, F.array(F.lit(""), F.lit(None))).alias("originalId"),
    )
    return raw.select("record_id", px.payload_identifier(raw.drop("record_id")).alias("identifier"))


def runs(v):
    """One run per day of records: its status and start."""
    per_day = v.source_record().groupBy("ingestion_run_id").agg(
        F.count("*").alias("records"), F.min("ingested_at").alias("started_at"))
    return per_day.select(
        F.col("ingestion_run_id").alias("run_id"), F.col("ingestion_run_id").alias("build_id"),
        F.when(F.col("records") % 2 == 0, "a").otherwise("b").alias("source"),
        F.when(F.col("records") % 3 == 0, "failed").otherwise("completed").alias("status"),
        F.when(F.col("records") % 2 == 0, "coauthorship").otherwise("semantic").alias("graph_type"),
        (F.col("records") % 5 == 1).alias("is_active"), "started_at",
    )


RUNS = """runs AS (SELECT ingestion_run_id AS run_id, ingestion_run_id AS build_id,
      CASE WHEN count(*) % 2 = 0 THEN 'a' ELSE 'b' END AS source,
      CASE WHEN count(*) % 3 = 0 THEN 'failed' ELSE 'completed' END AS status,
      CASE WHEN count(*) % 2 = 0 THEN 'coauthorship' ELSE 'semantic' END AS graph_type,
      count(*) % 5 = 1 AS is_active, min(ingested_at) AS started_at FROM source_record GROUP BY 1)"""


@query("latest_run", "source_record", """
    SELECT source, run_id, status FROM runs QUALIFY row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC) = 1""", RUNS)
def latest_run(v):
    return catalog.latest_run(runs(v), "source", "started_at", "run_id").select("source", "run_id", "status")


@query("active_build", "source_record", """
    SELECT graph_type, build_id, is_active FROM runs WHERE status = 'completed' QUALIFY row_number()
      OVER (PARTITION BY graph_type ORDER BY is_active DESC, started_at DESC, build_id DESC) = 1""", RUNS)
def active_build(v):
    return provenance.active_build(runs(v)).select("graph_type", "build_id", "is_active")


@query("activate_build", "source_record", """
    SELECT build_id, graph_type, CASE WHEN graph_type = (SELECT graph_type FROM runs WHERE build_id = '2024-01-05' AND status = 'completed')
      THEN build_id = '2024-01-05' ELSE is_active END AS is_active FROM runs""", RUNS)
def activate_build(v):
    return provenance.activate_build(runs(v), "2024-01-05").select("build_id", "graph_type", "is_active")


@query("ingestion_status", "source_record publication", """
    SELECT table_name, row_count, (SELECT run_id FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1) AS last_run_id,
      (SELECT status FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1) AS last_run_status
    FROM (SELECT 'publication' AS table_name, count(*) AS row_count FROM publication
      UNION ALL SELECT 'source_record', count(*) FROM source_record)""", RUNS)
def ingestion_status(v):
    counts = catalog.table_counts({"publication": v.publication(), "source_record": v.source_record()})
    return provenance.ingestion_status(counts, runs(v))


@query("patch_upsert", "document_publication", f"""
    SELECT publication_id, CASE WHEN publication_id % 2 = 0 THEN 'New ' || title ELSE title END AS title, venue_name,
      {NORMAL.format("CASE WHEN publication_id % 2 = 0 THEN 'New ' || title ELSE title END")} AS normalized_title
    FROM document_publication""")
def patch_upsert(v):
    docs = v.document_publication()
    base = docs.select("publication_id", "title", "venue_name", tx.normalize_text(F.col("title")).alias("normalized_title"))
    patch = docs.select(
        "publication_id", F.when(F.col("publication_id") % 2 == 0, F.concat(F.lit("New "), "title")).alias("title"),
        F.lit(None).cast("string").alias("venue_name"),
    )
    return ingest.patch_upsert(base, patch, "publication_id", {"normalized_title": "title"})
