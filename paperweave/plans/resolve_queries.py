"""Registered entity-resolution and ingest queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperweave.functions import text as tx
from paperweave.operators import attribution, ingest, quality, resolve
from paperweave.operators.positions import assign_author_positions
from paperweave.plans.catalog_queries import DOC_CATALOG, NORMAL, PEOPLE, doc_catalog, people
from paperweave.plans.graph_queries import nation_aliases
from paperweave.plans.registry import query
from paperweave.session import Rounds
from paperweave.sources import legacy, readers

DOCS = "document_publication publication"
LINKS = """links AS (SELECT DISTINCT publication_id, author_position, researcher_id FROM authorship)"""


# normalization and duplicates ----------------------------------------------------------------


@query("normalize_tables", "document_publication", f"""
    SELECT publication_id, coalesce(c, t) AS title, n AS normalized_title, v AS venue_name,
      c IS DISTINCT FROM t OR n IS DISTINCT FROM o OR v IS DISTINCT FROM venue_name AS changed
    FROM (SELECT publication_id, t, venue_name, nullif(trim(regexp_replace(t, '\\s+', ' ', 'g')), '') AS c,
        {NORMAL.format("coalesce(t, '')")} AS n, {NORMAL.format('title')} AS o,
        nullif(trim(regexp_replace(venue_name, '\\s+', ' ', 'g')), '') AS v
      FROM (SELECT *, CASE WHEN publication_id % 4 = 0 THEN '  ' || title ELSE title END AS t FROM document_publication))""")
def normalize_tables(v):
    docs = v.document_publication().withColumn("normalized_title", tx.normalize_text(F.col("title"))).withColumn(
        "title", F.when(F.col("publication_id") % 4 == 0, F.concat(F.lit("  "), "title")).otherwise(F.col("title")))
    return resolve.normalize_table(docs, resolve.PUBLICATIONS).select(
        "publication_id", "title", "normalized_title", "venue_name", "changed")


def star_sql(key: str, rows: str, ident: str, created: str) -> str:
    """entity/candidate pairs of each key group against its oldest row."""
    return f"""stars AS (SELECT t.{ident} AS entity_id, c.{ident} AS candidate_entity_id, c.{key} AS identifier_value
      FROM (SELECT {key}, arg_min({ident}, ROW({created}, {ident})) AS {ident} FROM {rows}
        WHERE coalesce({key}, '') <> '' GROUP BY {key} HAVING count(*) > 1) t
      JOIN {rows} c ON c.{key} = t.{key} AND c.{ident} <> t.{ident})"""


def unsafe_sql(entity: str, place: str, value: str, born: str, p: str = "") -> str:
    """Pairs whose copy disagrees with the oldest claimant of a place; `born` is (id, created), `p` prefixes all names."""
    return f"""{p}claims AS (SELECT entity_id, claimant, place, min(value) AS lo, max(value) AS hi,
        any_value(ROW(later, created, claimant)) AS age FROM (
          SELECT DISTINCT s.entity_id, s.entity_id AS claimant, 0 AS later, {place} AS place, {value} AS value
            FROM {p}stars s JOIN links l ON l.{entity} = s.entity_id
          UNION ALL SELECT DISTINCT s.entity_id, s.candidate_entity_id, 1, {place}, {value}
            FROM {p}stars s JOIN links l ON l.{entity} = s.candidate_entity_id) c
        JOIN ({born}) b ON b.id = c.claimant GROUP BY 1, 2, 3),
      {p}oldest AS (SELECT entity_id, place, arg_min(claimant, age) AS claimant, arg_min(lo, age) AS lo, arg_min(hi, age) AS hi
        FROM {p}claims GROUP BY 1, 2),
      {p}unsafe AS (SELECT DISTINCT c.entity_id, c.claimant AS candidate_entity_id FROM {p}claims c
        JOIN {p}oldest o ON o.entity_id = c.entity_id AND o.place = c.place
        WHERE c.claimant <> c.entity_id AND c.claimant <> o.claimant
          AND NOT (c.lo = c.hi AND o.lo = o.hi AND c.lo = o.lo))"""


UNSAFE_PUB = unsafe_sql("publication_id", "author_position", "researcher_id",
                        "SELECT publication_id AS id, created_at AS created FROM docs")


@query("exact_duplicates", DOCS + " authorship", """
    SELECT 'publication' AS entity_type, s.*, CASE WHEN u.entity_id IS NULL THEN 'exact_match' ELSE 'manual_review_needed' END AS confidence,
      u.entity_id IS NULL AS auto_applied
    FROM stars s LEFT JOIN unsafe u ON u.entity_id = s.entity_id AND u.candidate_entity_id = s.candidate_entity_id""",
       ", ".join([DOC_CATALOG, LINKS, star_sql("doi", "docs", "publication_id", "created_at"), UNSAFE_PUB]))
def exact_duplicates(v):
    return resolve.exact_duplicates(doc_catalog(v), "doi", "publication_id", authorship=v.authorship())


@query("merge_safety", DOCS + " authorship", """
    SELECT s.entity_id, s.candidate_entity_id, u.entity_id IS NULL AS mergeable
    FROM stars s LEFT JOIN unsafe u ON u.entity_id = s.entity_id AND u.candidate_entity_id = s.candidate_entity_id""",
       ", ".join([DOC_CATALOG, LINKS, star_sql("doi", "docs", "publication_id", "created_at"), UNSAFE_PUB]))
def merge_safety(v):
    pairs = resolve.star_candidates(doc_catalog(v), ["doi"], "publication_id", "created_at")
    unsafe = resolve.unsafe_publications(pairs, v.authorship())
    return resolve.with_safety(pairs, unsafe).select("entity_id", "candidate_entity_id", "mergeable")


PUB_STARS = f"""stars AS (SELECT t.publication_id AS entity_id, c.publication_id AS candidate_entity_id,
      {NORMAL.format('t.venue_name')} = {NORMAL.format('c.venue_name')} AS venue_match
    FROM (SELECT normalized_title, publication_year, arg_min(publication_id, ROW(created_at, publication_id)) AS publication_id,
        arg_min(venue_name, ROW(created_at, publication_id)) AS venue_name FROM docs WHERE normalized_title <> ''
        GROUP BY 1, 2 HAVING count(*) > 1) t
    JOIN docs c ON c.normalized_title = t.normalized_title AND c.publication_year IS NOT DISTINCT FROM t.publication_year
      AND c.publication_id <> t.publication_id)"""
NAMED = f"""named AS (SELECT DISTINCT publication_id, {NORMAL.format('full_name')} AS name
      FROM authorship JOIN researcher USING (researcher_id)),
    common AS (SELECT s.entity_id, s.candidate_entity_id, count(*) AS author_overlap FROM stars s
      JOIN named a ON a.publication_id = s.entity_id JOIN named b ON b.publication_id = s.candidate_entity_id AND b.name = a.name
      GROUP BY 1, 2)"""


def author_keys(v):
    names = v.researcher().select("researcher_id", tx.normalize_text(F.col("full_name")).alias("normalized_name"))
    return v.authorship().join(names, "researcher_id").select("publication_id", "normalized_name")


@query("publication_duplicates", DOCS + " authorship researcher", """
    SELECT s.*, coalesce(author_overlap, 0) AS author_overlap,
      CASE WHEN venue_match OR coalesce(author_overlap, 0) > 0 THEN 'strong_match' ELSE 'possible_match' END AS confidence,
      (venue_match OR coalesce(author_overlap, 0) > 0) AND u.entity_id IS NULL AS auto_applied
    FROM stars s LEFT JOIN common c ON c.entity_id = s.entity_id AND c.candidate_entity_id = s.candidate_entity_id
    LEFT JOIN unsafe u ON u.entity_id = s.entity_id AND u.candidate_entity_id = s.candidate_entity_id""",
       ", ".join([DOC_CATALOG, LINKS, PUB_STARS, UNSAFE_PUB, NAMED]))
def publication_duplicates(v):
    docs = doc_catalog(v).select(
        "publication_id", "normalized_title", "publication_year", "journal_name", "venue_name", "created_at")
    return resolve.publication_candidates(Rounds(v.spark, "docs").cut(docs), v.authorship(), author_keys(v))


@query("researcher_duplicates", "authorship", """
    SELECT s.entity_id, s.candidate_entity_id, s.same_org AS same_primary_organization, coalesce(shared, 0) AS shared_publications,
      CASE WHEN s.same_org OR coalesce(shared, 0) > 0 THEN 'strong_match' ELSE 'possible_match' END AS confidence,
      s.same_org AND u.entity_id IS NULL AS auto_applied
    FROM stars s LEFT JOIN common c ON c.entity_id = s.entity_id AND c.candidate_entity_id = s.candidate_entity_id
    LEFT JOIN unsafe u ON u.entity_id = s.entity_id AND u.candidate_entity_id = s.candidate_entity_id""",
       ", ".join([PEOPLE, LINKS, """stars AS (SELECT t.researcher_id AS entity_id, c.researcher_id AS candidate_entity_id,
           coalesce(o.primary_organization_id = c.primary_organization_id, FALSE) AS same_org
         FROM (SELECT normalized_name, min(researcher_id) AS researcher_id FROM people GROUP BY 1 HAVING count(*) > 1) t
         JOIN people o ON o.researcher_id = t.researcher_id
         JOIN people c ON c.normalized_name = t.normalized_name AND c.researcher_id <> t.researcher_id)""",
                  """common AS (SELECT s.entity_id, s.candidate_entity_id, count(DISTINCT a.publication_id) AS shared FROM stars s
         JOIN links a ON a.researcher_id = s.entity_id JOIN links b ON b.researcher_id = s.candidate_entity_id
           AND b.publication_id = a.publication_id GROUP BY 1, 2)""",
                  unsafe_sql("researcher_id", "publication_id", "author_position",
                             "SELECT researcher_id AS id, 0 AS created FROM people")]))
def researcher_duplicates(v):
    return resolve.researcher_candidates(people(v), v.authorship())


def shops(v):
    """Customers as organizations: few names, the nation as parent, segment as city."""
    return v.table("customer").select(
        F.col("c_custkey").alias("organization_id"), F.concat(F.lit("Société "), "c_mktsegment").alias("name"),
        tx.normalize_text(F.concat(F.lit("Société "), "c_mktsegment")).alias("normalized_name"),
        F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("parent_organization_id"),
        F.when(F.col("c_acctbal") > 0, "Köln").otherwise("koln ").alias("city"),
        F.when(F.col("c_nationkey") % 2 == 0, "DE").alias("country_code"), F.col("c_custkey").alias("created_at"),
    )


@query("organization_duplicates", "", """
    SELECT t.organization_id AS entity_id, c.organization_id AS candidate_entity_id,
      t.parent IS NOT DISTINCT FROM c.parent AS same_parent, t.country IS NOT DISTINCT FROM c.country AS same_location,
      CASE WHEN t.parent IS NOT DISTINCT FROM c.parent OR t.country IS NOT DISTINCT FROM c.country THEN 'strong_match'
        ELSE 'possible_match' END AS confidence,
      t.parent IS NOT DISTINCT FROM c.parent OR t.country IS NOT DISTINCT FROM c.country AS auto_applied
    FROM shops t JOIN shops c ON c.name = t.name AND c.organization_id <> t.organization_id
    WHERE t.organization_id IN (SELECT min(organization_id) FROM shops GROUP BY name)""",
       """shops AS (SELECT c_custkey AS organization_id, c_mktsegment AS name,
         CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS parent, CASE WHEN c_nationkey % 2 = 0 THEN 'DE' END AS country FROM customer)""")
def organization_duplicates(v):
    return resolve.organization_candidates(shops(v))


@query("duplicate_clusters", DOCS, """
    SELECT publication_id AS loser, survivor FROM (SELECT publication_id, arg_min(publication_id, ROW(created_at, publication_id))
        OVER (PARTITION BY root) AS survivor FROM reach JOIN docs USING (publication_id)) WHERE publication_id <> survivor""",
       DOC_CATALOG + """, same AS (SELECT a.publication_id AS l, b.publication_id AS r FROM docs a JOIN docs b
         ON (a.doi = b.doi AND a.doi <> 'bad-doi') OR a.normalized_title = b.normalized_title),
       reach(publication_id, root) USING KEY (publication_id) AS (SELECT publication_id, publication_id FROM docs
         UNION SELECT s.l, min(r.root) FROM same s JOIN reach r ON r.publication_id = s.r
         JOIN recurring.reach c ON c.publication_id = s.l WHERE r.root < c.root GROUP BY s.l)""")
def duplicate_clusters(v):
    docs = Rounds(v.spark, "docs").cut(doc_catalog(v).select("publication_id", "doi", "normalized_title", "created_at"))
    by_doi = resolve.star_candidates(docs.where(F.col("doi") != "bad-doi"), ["doi"], "publication_id", "created_at")
    by_title = resolve.star_candidates(docs, ["normalized_title"], "publication_id", "created_at")
    pair = ["entity_id", "candidate_entity_id"]
    return resolve.duplicate_clusters(
        by_doi.select(*pair).unionByName(by_title.select(*pair)), docs, "publication_id")


def merged_tables(v):
    rounds = Rounds(v.spark, "merge")
    docs = rounds.cut(doc_catalog(v))
    found = resolve.exact_duplicates(docs, "doi", "publication_id", authorship=v.authorship())
    mapping = rounds.cut(found.where("auto_applied").select(
        F.col("candidate_entity_id").alias("loser"), F.col("entity_id").alias("survivor")))
    return resolve.merge_entities({
        "publication": docs,
        "publication_author": v.authorship(), "publication_organization": v.publication_organization(),
    }, mapping, resolve.PUBLICATION_MERGE)


MERGED = ", ".join([DOC_CATALOG, LINKS, star_sql("doi", "docs", "publication_id", "created_at"), UNSAFE_PUB, """
    mapping AS (SELECT candidate_entity_id AS loser, entity_id AS survivor FROM stars WHERE NOT EXISTS (SELECT 1 FROM unsafe u
      WHERE u.entity_id = stars.entity_id AND u.candidate_entity_id = stars.candidate_entity_id))"""])


@query("merge_entities", DOCS + " authorship", """
    SELECT d.publication_id, d.title, d.doi, CAST(coalesce(d.publication_year, (SELECT arg_min(l.publication_year, ROW(l.created_at, l.publication_id))
        FILTER (WHERE l.publication_year IS NOT NULL) FROM mapping m JOIN docs l ON l.publication_id = m.loser
        WHERE m.survivor = d.publication_id)) AS INT) AS publication_year
    FROM docs d WHERE d.publication_id NOT IN (SELECT loser FROM mapping)""", MERGED)
def merge_entities(v):
    return merged_tables(v)["publication"].select("publication_id", "title", "doi", "publication_year")


@query("merge_links", DOCS + " authorship publication_organization", """
    SELECT DISTINCT coalesce(survivor, publication_id) AS publication_id, organization_id
    FROM publication_organization LEFT JOIN mapping ON loser = publication_id""", MERGED)
def merge_links(v):
    return merged_tables(v)["publication_organization"].select("publication_id", "organization_id")


SUMMARY = MERGED + ", " + PEOPLE + """,
    r_stars AS (SELECT * FROM (SELECT min(researcher_id) OVER (PARTITION BY left(orcid, 13)) AS entity_id, researcher_id AS candidate_entity_id
      FROM people WHERE orcid <> '') WHERE entity_id <> candidate_entity_id),
    o_stars AS (SELECT * FROM (SELECT min(c_custkey) OVER (PARTITION BY c_custkey % 40) AS entity_id, c_custkey AS candidate_entity_id FROM customer)
      WHERE entity_id <> candidate_entity_id), """ + unsafe_sql(
    "researcher_id", "publication_id", "author_position", "SELECT researcher_id AS id, 0 AS created FROM people", "r_")


@query("normalization_summary", DOCS + " authorship", f"""
    SELECT (SELECT count(*) FROM docs WHERE {NORMAL.format('title')} IS DISTINCT FROM title) AS normalized_publications,
      (SELECT count(*) FROM people WHERE normalized_name IS DISTINCT FROM full_name) AS normalized_researchers,
      (SELECT count(*) FROM customer) AS normalized_organizations,
      (SELECT count(*) FROM mapping) AS auto_merged_publications,
      (SELECT count(*) FROM r_stars) - (SELECT count(*) FROM r_unsafe) AS auto_merged_researchers,
      (SELECT count(*) FROM o_stars) AS auto_merged_organizations,
      (SELECT count(*) FROM docs WHERE doi IS NULL AND openaire_id IS NULL AND publication_year IS NULL)
        + (SELECT count(*) FROM docs WHERE doi = 'bad-doi')
        + (SELECT count(*) FROM people WHERE normalized_name NOT LIKE '% %')
        + (SELECT count(*) FROM people WHERE orcid <> '' AND NOT regexp_full_match(orcid, '[0-9]{{4}}-[0-9]{{4}}-[0-9]{{4}}-[0-9]{{3}}[0-9Xx]')) AS findings_count,
      (SELECT count(*) FROM stars) + (SELECT count(*) FROM r_stars) + (SELECT count(*) FROM o_stars) AS identifier_findings""", SUMMARY)
def normalization_summary(v):
    """Counters of one run over publications, people and organizations."""
    docs, persons = doc_catalog(v), people(v)
    orgs = shops(v).withColumn("ror_id", F.concat(F.lit("r"), (F.col("organization_id") % 40).cast("string")))
    exact = resolve.identifier_duplicates({
        "publication": docs.drop("openaire_id"), "researcher": persons.withColumn("orcid", F.substring("orcid", 1, 13)), "organization": orgs,
    }, v.authorship()).select("entity_type", "auto_applied", F.lit(True).alias("by_identifier"))
    odd = quality.publication_anomalies(docs).unionByName(quality.researcher_anomalies(persons)).select(
        "entity_type", F.lit(False).alias("auto_applied"), F.lit(False).alias("by_identifier"))
    differs = lambda df, a, b: df.select((~F.col(a).eqNullSafe(F.col(b))).alias("changed"))
    return quality.run_summary({
        "publication": differs(docs, "normalized_title", "title"), "researcher": differs(persons, "normalized_name", "full_name"),
        "organization": differs(orgs, "normalized_name", "name"),
    }, exact.unionByName(odd))


# mapping of raw records --------------------------------------------------------------------------


def raw_publications(v):
    """Documents packed into dump records, with odd values injected by the last digit of the id."""
    n = F.col("publication_id")
    digit = n % 10
    ident = n.cast("string")
    return v.document_publication().select(
        n.alias("arrival"),
        F.when(digit != 9, F.concat(F.lit(" doc::"), ident)).alias("id"),
        F.array(F.lit(" "), F.concat(F.lit("orig::"), ident)).alias("originalId"),
        F.when(digit != 8, F.col("title")).otherwise("  ").alias("maintitle"),
        F.array(F.lit(None).cast("string"), F.col("abstract")).alias("description"),
        F.when(digit == 7, "2021-02-30").otherwise(F.concat(F.lit("20"), F.lpad(n % 25, 2, "0"), F.lit("-03-04T00:00")))
        .alias("publicationdate"),
        F.array(
            F.struct(F.lit("handle").alias("scheme"), F.lit("1/2").alias("value")),
            F.struct(F.lit(" DOI ").alias("scheme"), F.concat(F.lit("  "), "doi").alias("value")),
        ).alias("pid"),
        F.struct(F.lit(" ").alias("code"), F.col("language_code").alias("label")).alias("language"),
        F.struct(F.when(digit < 5, "OPEN").when(digit < 7, "Closed Access").alias("label")).alias("bestaccessright"),
        F.struct(F.when(digit != 3, F.concat(F.lit("J "), "venue_name")).alias("name")).alias("container"),
        F.array("venue_name").alias("source"),
        F.lit("publication").alias("type"),
        F.array(F.struct(F.array(F.lit(""), F.concat(F.lit("http://x/"), ident)).alias("url"))).alias("instance"),
    )


@query("map_publications", "document_publication", f"""
    SELECT CASE WHEN d <> 9 THEN 'doc::' || n ELSE 'orig::' || n END AS openaire_id,
      CASE WHEN d = 8 OR trim(title) = '' THEN 'Untitled' ELSE trim(title) END AS title,
      CASE WHEN d = 8 OR trim(title) = '' THEN 'untitled' ELSE {NORMAL.format('title')} END AS normalized_title,
      sha256(nullif(regexp_replace(regexp_replace(abstract, '^\\s+', ''), '\\s+$', ''), '')) AS abstract_hash,
      CASE WHEN d = 7 THEN NULL ELSE CAST(2000 + n % 25 AS INT) END AS publication_year,
      CASE WHEN d = 7 THEN NULL ELSE '20' || lpad(CAST(n % 25 AS VARCHAR), 2, '0') || '-03-04' END AS publication_date,
      doi, 'publication' AS publication_type, language_code,
      CASE WHEN d <> 3 THEN 'J ' || venue_name END AS journal_name, venue_name,
      CASE WHEN d < 5 THEN TRUE WHEN d < 7 THEN FALSE END AS open_access, 'http://x/' || n AS source_url
    FROM (SELECT *, publication_id AS n, publication_id % 10 AS d FROM document_publication)""")
def map_publications(v):
    mapped = ingest.map_publications(raw_publications(v))
    return mapped.select(
        "openaire_id", "title", "normalized_title", F.sha2("abstract", 256).alias("abstract_hash"), "publication_year",
        F.col("publication_date").cast("string").alias("publication_date"), "doi", "publication_type", "language_code",
        "journal_name", "venue_name", "open_access", "source_url",
    )


def raw_organizations(v):
    n = F.col("s_suppkey")
    return v.table("supplier").select(
        n.alias("arrival"),
        F.concat(F.lit("S:"), n.cast("string"), F.lit(" ")).alias("id"),
        F.col("s_name").alias("legalname"),
        F.when(n % 3 == 0, F.concat(F.lit("Sup "), n.cast("string"))).when(n % 3 == 1, " ").alias("legalshortname"),
        F.struct(F.when(n % 2 == 0, "it").otherwise("Italy").alias("code"), F.when(n % 5 == 0, "FR").alias("label")).alias("country"),
        F.array(F.struct(F.lit("ROR").alias("scheme"), F.concat(F.lit("https://ror.org/"), F.lpad(n.cast("string"), 9, "0"))
                         .alias("value"))).alias("pid"),
        F.concat(F.lit("  http://org/"), n.cast("string")).alias("websiteurl"),
        F.lit("organization").alias("type"),
    )


@query("map_organizations", "", f"""
    SELECT 'S:' || s_suppkey AS openaire_id, CASE WHEN s_suppkey % 3 = 0 THEN 'Sup ' || s_suppkey ELSE s_name END AS name,
      {NORMAL.format("CASE WHEN s_suppkey % 3 = 0 THEN 'Sup ' || s_suppkey ELSE s_name END")} AS normalized_name,
      {NORMAL.format('s_name')} AS match_name, 'organization' AS organization_type,
      CASE WHEN s_suppkey % 2 = 0 THEN 'IT' WHEN s_suppkey % 5 = 0 THEN 'FR' END AS country_code,
      'https://ror.org/' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS ror_id, 'http://org/' || s_suppkey AS website
    FROM supplier""")
def map_organizations(v):
    return ingest.map_organizations(raw_organizations(v)).select(
        "openaire_id", "name", "normalized_name", "match_name", "organization_type", "country_code", "ror_id", "website")


@query("map_relations", "relations", """
    SELECT source, target, rel_name AS relation_type, source_type, target_type,
      rel_type = 'affiliation' AS is_affiliation FROM relations""")
def map_relations(v):
    return ingest.map_relations(v.relations())


@query("extract_pid", "document_publication", """
    SELECT publication_id, doi, '1/2' AS handle FROM document_publication""")
def extract_pid(v):
    from paperweave.functions.payload import extract_pid as pid

    return raw_publications(v).select(
        F.col("arrival").alias("publication_id"), pid(F.col("pid"), "doi").alias("doi"), pid(F.col("pid"), "handle").alias("handle"))


# matching and links ----------------------------------------------------------------------------------


def pub_keys(v):
    return v.publication().select(
        F.col("publication_id"), F.concat(F.lit("O:"), F.col("publication_id").cast("string")).alias("openaire_id"))


def org_keys(v):
    return v.organization().select("organization_id", F.col("organization_id").alias("openaire_id"))


RESOLVED = """resolved AS (SELECT p.publication_id, r.source AS organization_id, r.rel_name AS relation_type,
      rel_type = 'affiliation' AS is_affiliation FROM relations r
    JOIN publication p ON 'O:' || p.publication_id = r.target JOIN organization o ON o.organization_id = r.source
    WHERE source_type = 'organization' AND target_type = 'result')"""
REL_USES = "relations publication organization authorship"


def resolved(v):
    mapped = ingest.map_relations(v.relations())
    return ingest.resolve_relations(mapped, org_keys(v), pub_keys(v))


@query("relation_resolution", REL_USES, "SELECT * FROM resolved", RESOLVED)
def relation_resolution(v):
    return resolved(v)


@query("publication_organizations", REL_USES,
       "SELECT DISTINCT publication_id, organization_id, relation_type FROM resolved", RESOLVED)
def publication_organizations(v):
    return ingest.publication_org_links(resolved(v))


@query("affiliations_solo", REL_USES, """
    SELECT DISTINCT s.researcher_id, r.organization_id FROM resolved r
    JOIN (SELECT publication_id, min(researcher_id) AS researcher_id FROM authorship GROUP BY 1 HAVING count(*) = 1) s
      ON s.publication_id = r.publication_id WHERE is_affiliation""", RESOLVED)
def affiliations_solo(v):
    return ingest.affiliations_solo(resolved(v), v.authorship())


@query("affiliations_single_org", "publication_organization authorship", """
    SELECT DISTINCT a.researcher_id, s.organization_id FROM authorship a
    JOIN (SELECT publication_id, min(organization_id) AS organization_id FROM publication_organization
      GROUP BY 1 HAVING count(DISTINCT organization_id) = 1) s ON s.publication_id = a.publication_id""")
def affiliations_single_org(v):
    return ingest.affiliations_single_org(v.publication_organization(), v.authorship())[0]


@query("affiliations_ambiguous", "publication_organization", """
    SELECT publication_id FROM publication_organization GROUP BY 1 HAVING count(DISTINCT organization_id) > 1""")
def affiliations_ambiguous(v):
    return ingest.affiliations_single_org(v.publication_organization(), v.authorship())[1]


@query("primary_organization", "researcher researcher_affiliation", """
    SELECT researcher_id, CASE WHEN count(DISTINCT organization_id) = 1 THEN min(organization_id) END AS primary_organization_id
    FROM researcher_affiliation JOIN researcher USING (researcher_id) GROUP BY 1""")
def primary_organization(v):
    return ingest.primary_organization(v.researcher(), v.researcher_affiliation())


@query("cascade_match", DOCS, """
    SELECT n.publication_id, coalesce(m1, m2, m3) AS matched_id,
      CAST(CASE WHEN m1 IS NOT NULL THEN 1 WHEN m2 IS NOT NULL THEN 2 WHEN m3 IS NOT NULL THEN 3 END AS INT) AS match_rank
    FROM docs n
    LEFT JOIN (SELECT openaire_id AS k, min(publication_id) AS m1 FROM old WHERE openaire_id IS NOT NULL GROUP BY 1) a ON a.k = n.openaire_id
    LEFT JOIN (SELECT doi AS k, min(publication_id) AS m2 FROM old WHERE doi IS NOT NULL GROUP BY 1) b ON b.k = n.doi
    LEFT JOIN (SELECT normalized_title AS k, publication_year AS y, min(publication_id) AS m3 FROM old WHERE normalized_title <> ''
      GROUP BY 1, 2) c ON c.k = n.normalized_title AND c.y IS NOT DISTINCT FROM n.publication_year""",
       DOC_CATALOG + ", old AS (SELECT * FROM docs WHERE language_code IN ('en', 'fr'))")
def cascade_match(v):
    docs = doc_catalog(v).select("publication_id", "openaire_id", "doi", "normalized_title", "publication_year", "language_code")
    old = docs.where(F.col("language_code").isin("en", "fr"))
    return ingest.cascade_match(
        docs, old, ["openaire_id", "doi", ("normalized_title", "publication_year")], "publication_id"
    ).select("publication_id", "matched_id", "match_rank")


@query("author_positions", "authorship", """
    SELECT publication_id, u.r AS researcher_id, CAST(u.p AS INT) AS author_position FROM (
      SELECT publication_id, unnest(list_reduce(xs, lambda acc, x: list_concat(acc, [{
          r: x[1].r, a: x[1].a, k: x[1].k, p: CASE WHEN NOT list_contains(list_transform(acc, lambda y: y.p), x[1].k) THEN x[1].k
            ELSE list_min(list_filter(range(1, len(acc) + 2), lambda i: NOT list_contains(list_transform(acc, lambda y: y.p), i))) END}]),
          []::STRUCT(r BIGINT, a BIGINT, k BIGINT, p BIGINT)[])) AS u
      FROM (SELECT publication_id, list([{r: researcher_id, a: arrival, k: rank, p: CAST(0 AS BIGINT)}] ORDER BY arrival) AS xs FROM (
        SELECT publication_id, researcher_id, min(arrival) AS arrival, CAST(arg_min(rank, arrival) AS BIGINT) AS rank FROM arrivals
        GROUP BY 1, 2) GROUP BY 1))""",
       """arrivals AS (SELECT publication_id, researcher_id, author_position AS rank,
         researcher_id * 8 + author_position AS arrival FROM authorship)""")
def author_positions(v):
    links = v.authorship().select(
        "publication_id", "researcher_id", F.col("author_position").alias("rank"),
        (F.col("researcher_id") * 8 + F.col("author_position")).alias("arrival"),
    )
    return assign_author_positions(links)


@query("external_identifiers", "document_publication", """
    SELECT identifier_type, identifier_value, min(publication_id) AS publication_id,
      identifier_type = 'doi' AND identifier_value = arg_min(doi, publication_id) AND arg_min(doi, publication_id) IS NOT NULL AS is_primary
    FROM (SELECT 'handle' AS identifier_type, '1/2' AS identifier_value, publication_id, doi FROM document_publication
      UNION ALL SELECT 'doi', doi, publication_id, doi FROM document_publication WHERE doi IS NOT NULL
      UNION ALL SELECT 'original_id', 'orig::' || publication_id, publication_id, doi FROM document_publication) GROUP BY 1, 2""")
def external_identifiers(v):
    raw = raw_publications(v)
    from paperweave.functions.payload import extract_pid as pid

    named = raw.select(F.col("arrival").alias("publication_id"), "arrival", "pid", "originalId", pid(F.col("pid"), "doi").alias("doi"))
    return ingest.external_identifiers(named)


def embedded(v):
    """Publications with the organizations of their lines embedded, in line order."""
    line = v.table("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey")
    org = F.struct(
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("pending_org_"), F.col("l_partkey").cast("string")))
        .when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("S:"), F.col("l_suppkey").cast("string"))).alias("id"),
        F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("legalName"),
        F.when(F.col("l_suppkey") % 10 == 0, "NATION 7").alias("acronym"),
        F.when(F.col("l_suppkey") % 4 == 0, F.array(F.struct(
            F.lit("ror").alias("scheme"), F.concat(F.lit("r"), F.col("l_suppkey").cast("string")).alias("value")))).alias("pids"),
    )
    rows = line.select(F.col("l_orderkey").alias("publication_id"),
                       F.struct("l_linenumber", "l_partkey", "l_suppkey", org.alias("o")).alias("x"))
    listed = rows.groupBy("publication_id").agg(F.sort_array(F.collect_list(F.struct(
        "x.l_linenumber", "x.l_partkey", "x.l_suppkey", "x.o"))).alias("xs"))
    return listed.select("publication_id", F.transform("xs", lambda x: x["o"]).alias("organizations"))


@query("embedded_org_dedupe", "", """
    SELECT publication_id, dedupe_key, arg_max({o: org_id}, best).o AS org_id, arg_max(legal_name, best) AS legal_name FROM (
      SELECT *, ROW(CASE WHEN org_id IS NOT NULL AND NOT starts_with(org_id, 'pending_org_') THEN 1 ELSE 0 END,
          CASE WHEN has_pids THEN 1 ELSE 0 END, length(legal_name), -pos) AS best,
        CASE WHEN l_suppkey % 10 = 0 THEN 'code::N:7' WHEN has_pids THEN 'ror::r' || l_suppkey
          WHEN org_id IS NOT NULL AND NOT starts_with(org_id, 'pending_org_') THEN 'id::' || org_id
          ELSE 'name::supplier ' || l_suppkey END AS dedupe_key
      FROM (SELECT l_orderkey AS publication_id, l_suppkey, 'Supplier ' || l_suppkey AS legal_name, l_suppkey % 4 = 0 AS has_pids,
          CASE l_linenumber % 3 WHEN 0 THEN 'pending_org_' || l_partkey WHEN 1 THEN 'S:' || l_suppkey END AS org_id,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem))
    GROUP BY 1, 2""")
def embedded_org_dedupe(v):
    return attribution.dedupe_embedded_orgs(embedded(v), nation_aliases(v)).select(
        "publication_id", "dedupe_key", "org_id", "legal_name")


@query("explode_pages", "source_record", """
    SELECT entity_type, record_id, source_identifier, page_number FROM (
      SELECT *, CAST(floor((row_number() OVER (PARTITION BY entity_type ORDER BY record_id) - 1) / 100) AS BIGINT) + 1 AS page_number
      FROM source_record) WHERE page_number < 3 OR entity_type <> 'click'""")
def explode_pages(v):
    """One fetch per entity type, each with its own short last page; clicks say that 200 were found."""
    place = F.row_number().over(Window.partitionBy("entity_type").orderBy("record_id"))
    rows = v.source_record().withColumn("page_number", F.floor((place - 1) / 100) + 1)
    found = F.when(F.col("entity_type") == "click", 200).cast("bigint")
    pages = rows.groupBy("entity_type", "page_number").agg(
        F.sort_array(F.collect_list(F.struct("record_id", "source_identifier"))).alias("results"),
    ).withColumn("header", F.struct(
        F.lit(100).cast("bigint").alias("pageSize"), F.col("page_number").alias("page"), found.alias("numFound")))
    return readers.explode_pages(pages, fetch=["entity_type"]).select(
        "entity_type", "record_id", "source_identifier", "page_number")


@query("legacy_publications", "document_publication", """
    SELECT 'doc::' || publication_id AS openaire_id, coalesce(nullif(trim(title), ''), 'Untitled') AS title, doi,
      CASE WHEN publication_id % 10 = 7 THEN NULL ELSE CAST(2001 AS INT) END AS publication_year FROM document_publication""")
def legacy_publications(v):
    n = F.col("publication_id")
    service = v.document_publication().select(
        F.concat(F.lit("doc::"), n.cast("string")).alias("id"), F.col("title").alias("mainTitle"),
        F.when(n % 10 == 7, "0001-01-01").otherwise("2001-05-06").alias("publicationDate"),
        F.array(F.struct(F.lit("doi").alias("scheme"), F.col("doi").alias("value"))).alias("pids"),
        F.array(F.struct(F.lit("A B").alias("fullName"), F.lit(1).alias("rank"))).alias("authors"),
    )
    return ingest.map_publications(legacy.to_legacy_publication(service)).select(
        "openaire_id", "title", "doi", "publication_year")
