"""Registered report queries."""

from pyspark.sql import functions as F

from paperweave.operators import reports
from paperweave.plans.registry import query

ORG = "coalesce(legalshortname, legalname)"


@query("relation_counts", "relations",
       "SELECT rel_name AS name, count(*) AS count FROM relations GROUP BY rel_name")
def relation_counts(v):
    return reports.relation_counts(v.relations())


@query("venues", "results", """
    SELECT 'L-' || substr(container_name, 1, 1) AS "issnLinking", 'E-' || substr(container_name, 1, 1) AS "issnOnline",
           'P-' || substr(container_name, 1, 1) AS "issnPrinted", container_name AS name
    FROM results WHERE type = 'publication' AND container_name IS NOT NULL""")
def venues(v):
    return reports.venues(v.results_of("publication"))


CITED = """SELECT results.id, '10.5555/' || substr(results.id, 3) AS pid, count(*) AS count
    FROM results JOIN relations ON results.id = relations.{side} AND rel_name = '{name}'
    WHERE type = 'publication' GROUP BY 1, 2"""


@query("citations_in", "results relations", CITED.format(side="source", name="IsCitedBy"))
def citations_in(v):
    out = reports.citation_counts(v.results_of("publication"), v.relations(), "in")
    return out.withColumn("pid", F.array_join("pid", ","))


@query("citations_dual", "results relations", CITED.format(side="target", name="Cites"))
def citations_dual(v):
    out = reports.citation_counts(v.results_of("publication"), v.relations(), "dual")
    return out.withColumn("pid", F.array_join("pid", ","))


@query("subject_counts", "publication_subjects",
       "SELECT value AS term, count(*) AS count FROM publication_subjects GROUP BY value")
def subject_counts(v):
    return reports.subject_counts(v.publication_subjects())


@query("journal_counts", "results", """
    SELECT container_name AS name, count(*) AS count FROM results
    WHERE type = 'publication' AND container_name IS NOT NULL GROUP BY 1""")
def journal_counts(v):
    return reports.journal_counts(v.results_of("publication"))


@query("projects_per_org", "organizations relations", f"""
    SELECT {ORG} AS name, count(*) AS count FROM organizations JOIN relations
      ON organizations.id = relations.source AND rel_name = 'isParticipant' GROUP BY 1""")
def projects_per_org(v):
    return reports.projects_per_org(v.organizations(), v.relations())


@query("results_per_project", "projects relations", """
    SELECT coalesce(funder, '') AS "shortName", code, title, count(*) AS count FROM projects JOIN relations
      ON projects.id = relations.source AND rel_name = 'produces' AND NOT title ILIKE '%unidentified%'
    GROUP BY 1, 2, 3""")
def results_per_project(v):
    out = reports.results_per_project(v.projects(), v.relations())
    return out.withColumn("shortName", F.array_join("shortName", ","))


@query("project_label_counts", "projects relations", """
    SELECT coalesce(funder, '?') || ' / ' || coalesce(code, '?') || ' / ' || substr(title, 1, 50) AS project,
           count(*) AS count
    FROM projects JOIN relations ON projects.id = relations.source AND rel_name = 'produces'
      AND NOT title ILIKE '%unidentified%' GROUP BY 1""")
def project_label_counts(v):
    return reports.results_per_project(v.projects(), v.relations(), composed=True)


@query("subject_cooccurrence", "publication_subjects", """
    SELECT l.value AS "left", r.value AS "right", count(*) AS count
    FROM publication_subjects l JOIN publication_subjects r ON l.id = r.id AND l.value < r.value
    WHERE l.scheme <> 'keyword' AND r.scheme <> 'keyword' GROUP BY 1, 2""")
def subject_cooccurrence(v):
    return reports.subject_cooccurrence(v.publication_subjects())


@query("orgs_missing_short_name", "organizations", """
    SELECT legalshortname, legalname FROM organizations WHERE legalshortname IS NULL AND legalname IS NOT NULL""")
def orgs_missing_short_name(v):
    return reports.orgs_missing_short_name(v.organizations())


@query("results_per_org", "organizations relations", f"""
    SELECT {ORG} AS organization, count(*) AS count FROM organizations JOIN relations
      ON organizations.id = relations.source AND rel_name = 'isAuthorInstitutionOf' GROUP BY 1""")
def results_per_org(v):
    return reports.results_per_org(v.organizations(), v.relations())


THREE_WAY = """FROM organizations JOIN relations ON organizations.id = relations.source
      AND rel_name = 'isAuthorInstitutionOf' JOIN results ON results.id = relations.target"""
ACCESS = """count(*) AS total, count(CASE WHEN access_label = 'OPEN' THEN 1 END) AS open,
      count(CASE WHEN access_label = 'EMBARGO' THEN 1 END) AS embargo,
      count(CASE WHEN access_label = 'CLOSED' THEN 1 END) AS closed"""


@query("results_by_type_per_org", "organizations relations results", f"""
    SELECT {ORG} AS organization, count(*) AS total,
      count(CASE WHEN type = 'publication' THEN 1 END) AS publication,
      count(CASE WHEN type = 'dataset' THEN 1 END) AS dataset,
      count(CASE WHEN type = 'software' THEN 1 END) AS software,
      count(CASE WHEN type = 'other' THEN 1 END) AS other {THREE_WAY} GROUP BY 1""")
def results_by_type_per_org(v):
    return reports.results_by_type_per_org(v.organizations(), v.relations(), v.results())


@query("access_per_org", "organizations relations results",
       f"SELECT {ORG} AS organization, {ACCESS} {THREE_WAY} GROUP BY 1")
def access_per_org(v):
    return reports.access_per(v.organizations(), v.relations(), v.results(), "organization")


@query("access_per_country", "organizations relations results",
       f"SELECT country, {ACCESS} {THREE_WAY} WHERE country IS NOT NULL GROUP BY 1")
def access_per_country(v):
    return reports.access_per(v.organizations(), v.relations(), v.results(), "country")


PAIRS = """, members AS (SELECT {label} AS label, target AS id FROM organizations JOIN relations
      ON organizations.id = relations.source AND rel_name = '{name}' WHERE {where})"""
PAIR_SQL = """SELECT l.label AS "left", r.label AS "right", count(*) AS count
    FROM members l JOIN members r ON l.id = r.id AND l.label {op} r.label GROUP BY 1, 2"""


def _members(label: str, name: str, where: str = "TRUE") -> str:
    return PAIRS.format(label=label, name=name, where=where).lstrip(", ")


@query("country_network", "organizations relations", PAIR_SQL.format(op="<="),
       _members("country", "isParticipant", "country IS NOT NULL"))
def country_network(v):
    return reports.country_network(v.organizations(), v.relations())


@query("country_network_intl", "organizations relations", PAIR_SQL.format(op="<"),
       _members("country", "isParticipant", "country IS NOT NULL"))
def country_network_intl(v):
    return reports.country_network(v.organizations(), v.relations(), strict=True)


@query("org_project_pairs", "organizations relations", PAIR_SQL.format(op="<"), _members(ORG, "isParticipant"))
def org_project_pairs(v):
    return reports.org_pairs(v.organizations(), v.relations(), "isParticipant")


@query("org_paper_pairs", "organizations relations", PAIR_SQL.format(op="<"), _members(ORG, "isAuthorInstitutionOf"))
def org_paper_pairs(v):
    return reports.org_pairs(v.organizations(), v.relations(), "isAuthorInstitutionOf")


@query("access_by_year", "results", """
    SELECT access_label AS accessright, substr(publicationdate, 1, 4) AS year, count(*) AS count
    FROM results WHERE publicationdate IS NOT NULL GROUP BY 1, 2""")
def access_by_year(v):
    return reports.access_by_year(v.results())


@query("supplemented_count", "relations results", """
    SELECT count(*) AS count FROM relations JOIN results p ON rel_name = 'IsSupplementedBy'
      AND p.id = relations.source AND p.type = 'publication'
    JOIN results d ON d.id = relations.target AND d.type = 'dataset'""")
def supplemented_count(v):
    return reports.supplemented_count(v.relations(), v.results_of("publication"), v.results_of("dataset"))
