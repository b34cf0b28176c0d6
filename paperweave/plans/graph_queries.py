"""Registered coauthorship-graph queries."""

from pyspark.sql import functions as F

from paperweave.functions.text import normalize_text
from paperweave.operators import attribution, blocks, catalog, centrality, components, graph, subgraph
from paperweave.operators.grouping import pair_counts
from paperweave.plans.registry import query
from paperweave.session import Rounds

MEMBERS = """coauthor_members AS (SELECT DISTINCT publication_id, researcher_id FROM authorship)"""
EDGES = MEMBERS + """,
    edges AS (SELECT l.researcher_id AS source, r.researcher_id AS target, count(*) AS weight,
        count(*) AS shared_publication_count,
        min(CAST(coalesce(p.publication_year, year(p.publication_date)) AS INT)) AS first_collaboration_year,
        max(CAST(coalesce(p.publication_year, year(p.publication_date)) AS INT)) AS last_collaboration_year
      FROM coauthor_members l JOIN coauthor_members r
        ON l.publication_id = r.publication_id AND l.researcher_id < r.researcher_id
      LEFT JOIN publication p ON p.publication_id = l.publication_id GROUP BY 1, 2)"""
WAYS = EDGES + """,
    ways AS (SELECT source AS id, target AS other, weight FROM edges
      UNION ALL SELECT target, source, weight FROM edges)"""
METRICS = WAYS + """,
    people AS (SELECT DISTINCT researcher_id AS id FROM authorship WHERE researcher_id IS NOT NULL),
    metrics AS (SELECT people.id, count(other) AS degree, CAST(coalesce(sum(weight), 0) AS BIGINT) AS strength
      FROM people LEFT JOIN ways USING (id) GROUP BY 1)"""
# organizations linked through shared publications: a small, dense graph over the whole table
ORG_EDGES = """org_members AS (SELECT DISTINCT publication_id, organization_id FROM publication_organization),
    edges AS (SELECT l.organization_id AS source, r.organization_id AS target, count(*) AS weight
      FROM org_members l JOIN org_members r
        ON l.publication_id = r.publication_id AND l.organization_id < r.organization_id GROUP BY 1, 2)"""
USES = "authorship publication"


def edges_of(v):
    return graph.coauthor_edges(v.authorship(), v.publication())


def people_of(v):
    return v.authorship().select(F.col("researcher_id").alias("id")).distinct()


@query("coauthor_edges", USES, """SELECT source, target, weight, shared_publication_count,
       first_collaboration_year, last_collaboration_year FROM edges""", EDGES)
def coauthor_edges(v):
    return edges_of(v)


@query("coauthor_edge_publications", "authorship", """
    SELECT l.researcher_id AS source, r.researcher_id AS target, l.publication_id
    FROM coauthor_members l JOIN coauthor_members r
      ON l.publication_id = r.publication_id AND l.researcher_id < r.researcher_id""", MEMBERS)
def coauthor_edge_publications(v):
    return graph.coauthor_edge_publications(v.authorship())


SINGLE_ORG = """single_org AS (SELECT researcher_id, min(organization_id) AS only_org FROM researcher_affiliation
      JOIN organization USING (organization_id) GROUP BY 1 HAVING count(DISTINCT organization_id) = 1)"""
DISPLAY = """SELECT r.researcher_id, coalesce(p.organization_id, only_org) AS primary_organization_id,
      o.name AS primary_organization_name
    FROM researcher r LEFT JOIN organization p ON p.organization_id = r.primary_organization_id
    LEFT JOIN single_org s ON s.researcher_id = r.researcher_id
    LEFT JOIN organization o ON o.organization_id = coalesce(p.organization_id, only_org)"""


@query("display_organization", "researcher researcher_affiliation organization", DISPLAY, SINGLE_ORG)
def display_organization(v):
    return attribution.display_organization(v.researcher(), v.researcher_affiliation(), v.organization())


LINEAGE = """lineage AS (SELECT organization_id, organization_id AS ancestor_id, 0 AS depth FROM organization
      UNION ALL SELECT l.organization_id, o.parent_organization_id, l.depth + 1 FROM lineage l
      JOIN organization o ON o.organization_id = l.ancestor_id WHERE o.parent_organization_id IS NOT NULL)"""


@query("org_lineage", "organization", "SELECT organization_id, ancestor_id, CAST(depth AS INT) AS depth FROM lineage", LINEAGE)
def org_lineage(v):
    return attribution.org_lineage(v.organization())


def nation_aliases(v):
    """Alias dictionary made of the nation names; each is one code."""
    orgs = v.organization().where(F.col("organization_type") == "nation")
    return orgs.select(
        F.col("organization_id").alias("code"), "name", F.lit(None).cast("string").alias("country_code"),
        F.col("name").alias("alias"),
        F.xxhash64("organization_id").alias("spec_order"),
    )


NORMAL = "trim(regexp_replace(replace(lower(strip_accents({0})), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))"
WORDS = f"""words AS (SELECT organization_id AS code, {NORMAL.format('name')} AS alias FROM organization
      WHERE organization_type = 'nation'),
    named AS (SELECT organization_id, {NORMAL.format('name')} AS name FROM organization),
    scored AS (SELECT n.organization_id, n.name, w.code, max(CASE WHEN n.name = w.alias THEN 120
        WHEN contains(n.name, w.alias) THEN 100
        WHEN contains(w.alias, n.name) AND length(n.name) >= 10 THEN 80 ELSE 0 END) AS score
      FROM named n CROSS JOIN words w WHERE n.name <> '' GROUP BY 1, 2, 3)"""


@query("alias_match_score", "organization",
       "SELECT DISTINCT name, code, CAST(score AS INT) AS score FROM scored WHERE score > 0", WORDS)
def alias_match_score(v):
    names = v.organization().select(
        normalize_text(F.col("name")).alias("name"), F.lit(None).cast("string").alias("country_code")
    )
    return attribution.alias_match(names, nation_aliases(v)).drop("country_code")


MATCHED = LINEAGE + ", " + WORDS + """,
    per_code AS (SELECT l.organization_id, s.code, max(s.score) AS score FROM lineage l
      JOIN scored s ON s.organization_id = l.ancestor_id AND s.score > 0 GROUP BY 1, 2),
    best AS (SELECT organization_id, max(score) AS score FROM per_code GROUP BY 1),
    matched AS (SELECT organization_id, min(code) AS code, score FROM per_code JOIN best USING (organization_id, score)
      GROUP BY organization_id, score HAVING count(*) = 1),
    by_link AS (SELECT researcher_id, min(code) AS code FROM researcher_affiliation JOIN matched USING (organization_id)
      GROUP BY 1 HAVING count(DISTINCT code) = 1),
    attributed AS (SELECT r.researcher_id, coalesce(m.code, b.code) AS university_code FROM researcher r
      LEFT JOIN matched m ON m.organization_id = r.primary_organization_id
      LEFT JOIN by_link b ON b.researcher_id = r.researcher_id WHERE coalesce(m.code, b.code) IS NOT NULL)"""


@query("university_attribution", "researcher researcher_affiliation organization", """
    SELECT a.researcher_id, a.university_code, o.name AS university_name
    FROM attributed a JOIN organization o ON o.organization_id = a.university_code""", MATCHED)
def university_attribution(v):
    return attribution.attribute_universities(
        v.researcher(), v.researcher_affiliation(), v.organization(), nation_aliases(v)
    )


def attributed_nodes(v, edges=None, include_isolated=True):
    shown = attribution.display_organization(v.researcher(), v.researcher_affiliation(), v.organization())
    return graph.coauthor_nodes(
        v.authorship(), v.researcher(), shown.join(university_attribution(v), "researcher_id", "left"), edges, include_isolated
    )


NODES = MATCHED + ", " + SINGLE_ORG + f""",
    shown AS ({DISPLAY}),
    nodes AS (SELECT r.researcher_id AS id, coalesce(nullif(r.display_name, ''), r.full_name) AS label, r.full_name,
        {NORMAL.format('r.full_name')} AS normalized_name, s.primary_organization_id, s.primary_organization_name,
        a.university_code, u.name AS university_name, a.university_code IS NOT NULL AS is_alliance_university
      FROM researcher r SEMI JOIN authorship w ON w.researcher_id = r.researcher_id
      LEFT JOIN shown s ON s.researcher_id = r.researcher_id
      LEFT JOIN attributed a ON a.researcher_id = r.researcher_id
      LEFT JOIN organization u ON u.organization_id = a.university_code)"""
NODE_USES = "authorship researcher researcher_affiliation organization"


@query("coauthor_nodes", NODE_USES, "SELECT * FROM nodes", NODES)
def coauthor_nodes(v):
    return attributed_nodes(v)


@query("attribution_legend", NODE_USES, """
    SELECT CASE WHEN primary_organization_id IS NOT NULL THEN 'organization'
             WHEN university_code IS NOT NULL THEN 'university' ELSE 'fallback' END AS kind,
           coalesce(primary_organization_id, university_code) AS key,
           min(coalesce(primary_organization_name, university_name, 'Not attributed')) AS label,
           count(*) AS node_count
    FROM nodes GROUP BY 1, 2""", NODES)
def attribution_legend(v):
    return catalog.attribution_legend(attributed_nodes(v))


@query("has_unassigned", NODE_USES, """
    SELECT bool_or(primary_organization_id IS NULL AND university_code IS NULL) AS has_unassigned FROM nodes""", NODES)
def has_unassigned(v):
    return catalog.has_unassigned(attributed_nodes(v))


@query("degree_strength", USES + " researcher", "SELECT id, degree, strength FROM metrics", METRICS)
def degree_strength(v):
    return graph.degree_strength(people_of(v), edges_of(v))


@query("isolated_nodes", "authorship publication researcher", """
    SELECT researcher_id AS id, full_name FROM researcher
    WHERE researcher_id NOT IN (SELECT source FROM edges WHERE weight >= 2 UNION ALL SELECT target FROM edges WHERE weight >= 2)""", WAYS)
def isolated_nodes(v):
    """People without a tie of at least two papers."""
    nodes = v.researcher().select(F.col("researcher_id").alias("id"), "full_name")
    return graph.isolated_nodes(nodes, edges_of(v).where(F.col("weight") >= 2))


@query("connected_nodes", "authorship publication researcher", """
    SELECT researcher_id AS id, full_name FROM researcher WHERE researcher_id IN (SELECT id FROM ways)""", WAYS)
def connected_nodes(v):
    nodes = v.researcher().select(F.col("researcher_id").alias("id"), "full_name")
    return graph.connected_nodes(nodes, edges_of(v))


REACH = """reach(id, component_id) USING KEY (id) AS (SELECT id, id FROM people
      UNION SELECT w.id, min(r.component_id) FROM ways w JOIN reach r ON r.id = w.other
        JOIN recurring.reach c ON c.id = w.id WHERE r.component_id < c.component_id GROUP BY w.id)"""


@query("connected_components", USES + " researcher", "SELECT id, component_id FROM reach", METRICS + ", " + REACH)
def connected_components(v):
    return components.connected_components(people_of(v), edges_of(v))


def heard_ctes(rounds: int, nodes: str) -> str:
    """One pair of CTEs per propagation round."""
    out = [f"l0 AS MATERIALIZED (SELECT id, id AS community_id FROM {nodes})"]
    for i in range(1, rounds + 1):
        out.append(f"""h{i} AS MATERIALIZED (SELECT id, community_id, row_number() OVER (PARTITION BY id
            ORDER BY w DESC, community_id) AS place FROM (SELECT w.id, l.community_id, sum(w.weight) AS w
            FROM ways w JOIN l{i - 1} l ON l.id = w.other GROUP BY 1, 2))""")
        out.append(f"""l{i} AS MATERIALIZED (SELECT l.id, coalesce(h.community_id, l.community_id) AS community_id
            FROM l{i - 1} l LEFT JOIN h{i} h ON h.id = l.id AND h.place = 1)""")
    return ", ".join(out)


LPA_ROUNDS = 10


@query("communities_lpa", USES + " researcher", f"SELECT id, community_id FROM l{LPA_ROUNDS}",
       METRICS + ", " + heard_ctes(LPA_ROUNDS, "people"))
def communities_lpa(v):
    return components.label_propagation(people_of(v), edges_of(v), LPA_ROUNDS)


@query("communities_multilevel", USES)
def communities_multilevel(v):
    """Rounds of moves have no SQL; tests hold the partition against planted ones and against label propagation."""
    return blocks.multilevel_communities(people_of(v), edges_of(v))


def measured(v, rounds_of_labels: int = 2):
    """Nodes with degree, strength, component and community; edges of the same graph."""
    table = Rounds(v.spark, "measured")
    edges = edges_of(v)
    nodes = table.cut(people_of(v).join(
        v.researcher().select(F.col("researcher_id").alias("id"), F.col("full_name").alias("label"),
                              "primary_organization_id"), "id"))
    nodes = (
        nodes.join(graph.degree_strength(nodes, edges), "id")
        .join(components.connected_components(nodes, edges), "id")
        .join(components.label_propagation(nodes, edges, rounds_of_labels), "id")
        .withColumn("university_code", F.lit(None).cast("string"))
    )
    return table.cut(nodes), edges


MEASURED = METRICS + ", " + REACH + ", " + heard_ctes(2, "people") + """,
    nodes AS (SELECT m.id, r.full_name AS label, r.primary_organization_id, m.degree, m.strength,
        c.component_id, l.community_id
      FROM metrics m JOIN researcher r ON r.researcher_id = m.id JOIN reach c ON c.id = m.id JOIN l2 l ON l.id = m.id)"""
MEASURED_USES = USES + " researcher"


@query("modularity", MEASURED_USES, """
    SELECT round(sum(w_in) / max(total) - sum(k * k) / (4 * max(total) * max(total)), 6) AS modularity FROM (
      SELECT c, CAST(sum(k) AS DOUBLE) AS k, CAST(sum(w) AS DOUBLE) AS w_in,
             (SELECT CAST(sum(weight) AS DOUBLE) FROM edges) AS total FROM (
        SELECT l.community_id AS c, w.weight AS k, CASE WHEN l.community_id = o.community_id THEN w.weight ELSE 0 END / 2 AS w
        FROM ways w JOIN l2 l ON l.id = w.id JOIN l2 o ON o.id = w.other) GROUP BY c)""",
       METRICS + ", " + heard_ctes(2, "people"))
def modularity(v):
    edges = edges_of(v)
    labels = components.label_propagation(people_of(v), edges, 2)
    return components.modularity(edges, labels).select(F.round("modularity", 6).alias("modularity"))


@query("graph_summary", MEASURED_USES, """
    SELECT count(*) AS node_count, (SELECT count(*) FROM edges) AS edge_count,
           count(DISTINCT component_id) AS component_count, count(DISTINCT community_id) AS community_count
    FROM nodes""", MEASURED)
def graph_summary(v):
    return graph.graph_summary(*measured(v))


WORD_SUMS = " || '|' || ".join(
    f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))


@query("graph_version", USES + " researcher", f"""
    SELECT sha256('' || '|' || count(*) || '|' || {WORD_SUMS}) AS graph_version FROM (
      SELECT sha256('n{{"id":' || researcher_id || coalesce(',"primary_organization_id":"' || primary_organization_id || '"', '') || '}}') AS h
        FROM researcher
      UNION ALL SELECT sha256('e{{"first_collaboration_year":' || first_collaboration_year || ',"last_collaboration_year":'
        || last_collaboration_year || ',"source":' || source || ',"target":' || target || ',"weight":' || weight || '}}') FROM edges)""", EDGES)
def graph_version(v):
    nodes = v.researcher().select(F.col("researcher_id").alias("id"), "primary_organization_id")
    return graph.graph_version(nodes, edges_of(v))


@query("top_nodes", MEASURED_USES, """
    SELECT id, label, degree, strength FROM nodes ORDER BY degree DESC, strength DESC, label DESC, id DESC LIMIT 10""", MEASURED)
def top_nodes(v):
    return catalog.top_nodes(labelled(v), "degree").select("id", "label", "degree", "strength")


@query("top_nodes_strength", MEASURED_USES, """
    SELECT id, label, degree, strength FROM nodes ORDER BY strength DESC, degree DESC, label DESC, id DESC LIMIT 10""", MEASURED)
def top_nodes_strength(v):
    return catalog.top_nodes(labelled(v), "strength").select("id", "label", "degree", "strength")


def labelled(v):
    people = people_of(v).join(
        v.researcher().select(F.col("researcher_id").alias("id"), F.col("full_name").alias("label")), "id")
    return people.join(graph.degree_strength(people, edges_of(v)), "id")


@query("clustering_coefficient", "publication_organization", """
    SELECT d.id, count(t.id) AS triangles,
      CASE WHEN degree >= 2 THEN round(count(t.id) / (degree * (degree - 1) / 2.0), 6) END AS clustering
    FROM (SELECT id, count(*) AS degree FROM ways GROUP BY 1) d LEFT JOIN (
      SELECT a.id FROM ways a JOIN ways b ON a.id = b.id AND a.other < b.other
      JOIN edges e ON e.source = a.other AND e.target = b.other) t ON t.id = d.id
    GROUP BY d.id, degree""", ORG_EDGES + """,
    ways AS (SELECT source AS id, target AS other FROM edges UNION ALL SELECT target, source FROM edges)""")
def clustering_coefficient(v):
    edges = Rounds(v.spark, "organizations").cut(org_edges(v))
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return graph.clustering_coefficient(nodes, edges).withColumn("clustering", F.round("clustering", 6))


@query("clustering_coauthors", USES, """
    SELECT d.id, coalesce(t.n, 0) AS triangles, CASE WHEN degree >= 2 THEN round(coalesce(t.n, 0) / (degree * (degree - 1) / 2), 6) END AS clustering
    FROM (SELECT id, count(*) AS degree FROM ways GROUP BY 1) d LEFT JOIN (
      SELECT id, count(*) AS n FROM (SELECT unnest([a.source, a.target, b.target]) AS id FROM edges a JOIN edges b ON b.source = a.target
        JOIN edges c ON c.source = a.source AND c.target = b.target) GROUP BY 1) t ON t.id = d.id""", WAYS)
def clustering_coauthors(v):
    edges = edges_of(v)
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return graph.clustering_coefficient(nodes, edges).withColumn("clustering", F.round("clustering", 6))


def org_edges(v):
    pairs = pair_counts(v.publication_organization(), "publication_id", "organization_id")
    return pairs.select(F.col("left").alias("source"), F.col("right").alias("target"), F.col("count").alias("weight"))


SHORTEST = ORG_EDGES + """,
    ways AS (SELECT source AS id, target AS other, weight FROM edges UNION ALL SELECT target, source, weight FROM edges),
    ids AS (SELECT DISTINCT id FROM ways),
    dist(s, t, d) USING KEY (s, t) AS (SELECT a.id, b.id, CASE WHEN a.id = b.id THEN 0 ELSE 1000000000 END FROM ids a, ids b
      UNION SELECT r.s, w.other, min(r.d + w.weight) FROM dist r JOIN ways w ON w.id = r.t
        JOIN recurring.dist c ON c.s = r.s AND c.t = w.other WHERE r.d + w.weight < c.d GROUP BY 1, 2),
    arcs AS MATERIALIZED (SELECT a.s, a.t AS u, b.t AS v FROM dist a JOIN ways w ON w.id = a.t
      JOIN dist b ON b.s = a.s AND b.t = w.other AND b.d = a.d + w.weight),
    steps AS (SELECT id AS s, id AS v, CAST(1 AS DOUBLE) AS n, 0 AS hop FROM ids
      UNION ALL SELECT p.s, arcs.v, sum(p.n), p.hop + 1 FROM steps p JOIN arcs ON arcs.s = p.s AND arcs.u = p.v GROUP BY 1, 2, 4),
    sigma AS MATERIALIZED (SELECT dist.s, dist.t, any_value(d) AS d, sum(n) AS n FROM dist JOIN steps ON steps.s = dist.s AND steps.v = dist.t GROUP BY 1, 2),
    through AS (SELECT a.t AS id, sum(a.n * b.n / c.n) AS total FROM sigma a JOIN sigma b ON b.s = a.t
      JOIN sigma c ON c.s = a.s AND c.t = b.t AND c.d = a.d + b.d WHERE a.s <> a.t AND b.t <> a.t AND a.s <> b.t GROUP BY 1)"""


@query("betweenness", "publication_organization", """
    SELECT ids.id, round(coalesce(total, 0) / ((SELECT count(*) FROM ids) - 1) / ((SELECT count(*) FROM ids) - 2), 9) AS betweenness
    FROM ids LEFT JOIN through ON through.id = ids.id""", SHORTEST)
def betweenness(v):
    edges = Rounds(v.spark, "betweenness").cut(org_edges(v))
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return centrality.betweenness(nodes, edges).withColumn("betweenness", F.round("betweenness", 9))


CENTER = 17


# from the node's own publications outwards, each step once, so that no plan needs all edges of the graph
AROUND = f"""members AS MATERIALIZED (SELECT DISTINCT publication_id, researcher_id FROM authorship),
    around AS MATERIALIZED (SELECT r.researcher_id AS id, count(*) AS weight FROM members r
      SEMI JOIN (SELECT publication_id FROM members WHERE researcher_id = {CENTER}) own ON r.publication_id = own.publication_id
      WHERE r.researcher_id <> {CENTER} GROUP BY 1)"""
INSIDE = """inside AS MATERIALIZED (SELECT m.publication_id, m.researcher_id FROM members m SEMI JOIN chosen ON m.researcher_id = chosen.id)"""
INSIDE_EDGES = """SELECT l.researcher_id AS source, r.researcher_id AS target, count(*) AS weight
    FROM inside l JOIN inside r ON l.publication_id = r.publication_id AND l.researcher_id < r.researcher_id GROUP BY 1, 2"""


@query("ego_network", "authorship", INSIDE_EDGES, AROUND + f""",
    chosen AS MATERIALIZED (SELECT CAST({CENTER} AS BIGINT) AS id UNION ALL SELECT id FROM around),
    """ + INSIDE)
def ego_network(v):
    return graph.ego_edges(v.authorship(), v.publication(), CENTER).select("source", "target", "weight")


@query("node_neighbors", USES, f"""
    SELECT CASE WHEN source = {CENTER} THEN target ELSE source END AS neighbor, shared_publication_count,
      first_collaboration_year, last_collaboration_year, weight
    FROM edges WHERE source = {CENTER} OR target = {CENTER}""", EDGES)
def node_neighbors(v):
    return graph.node_neighbors(graph.edges_around(v.authorship(), v.publication(), CENTER), CENTER)


OF_ORG = "SELECT researcher_id FROM researcher WHERE primary_organization_id = 'S:3'"


@query("induced_subgraph", USES + " researcher", f"""
    SELECT source, target, weight FROM edges WHERE source IN ({OF_ORG}) AND target IN ({OF_ORG})""", EDGES)
def induced_subgraph(v):
    chosen = v.researcher().where(F.col("primary_organization_id") == "S:3").select(F.col("researcher_id").alias("id"))
    return graph.induced_subgraph(edges_of(v), chosen).select("source", "target", "weight")


MIN_DEGREE = """inside AS (SELECT e.* FROM edges e WHERE weight >= 2),
    deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM inside UNION ALL SELECT target FROM inside) GROUP BY 1),
    kept AS (SELECT id FROM deg WHERE degree >= 3)"""


@query("min_degree_filter", USES, """
    SELECT source, target, weight FROM inside WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept)""",
       EDGES + ", " + MIN_DEGREE)
def min_degree_filter(v):
    edges = edges_of(v).where(F.col("weight") >= 2)
    return subgraph.min_degree_filter(people_of(v), edges, 3)[1].select("source", "target", "weight")


HEAVY = """heavy AS (SELECT source AS id, target AS other FROM edges WHERE weight >= 3
      UNION ALL SELECT target, source FROM edges WHERE weight >= 3),
    parts(id, component_id) USING KEY (id) AS (SELECT DISTINCT researcher_id, researcher_id FROM authorship
      UNION SELECT w.id, min(r.component_id) FROM heavy w JOIN parts r ON r.id = w.other
        JOIN recurring.parts c ON c.id = w.id WHERE r.component_id < c.component_id GROUP BY w.id)"""


@query("largest_component", USES, """
    SELECT id FROM parts WHERE component_id = (SELECT component_id FROM parts GROUP BY 1
      ORDER BY count(*) DESC, component_id LIMIT 1)""", EDGES + ", " + HEAVY)
def largest_component(v):
    edges = edges_of(v).where(F.col("weight") >= 3)
    return components.largest_component(people_of(v), edges)


@query("ego_budget", USES, f"""
    SELECT CAST({CENTER} AS BIGINT) AS id UNION ALL (SELECT CASE WHEN source = {CENTER} THEN target ELSE source END
      FROM edges WHERE source = {CENTER} OR target = {CENTER}
      ORDER BY weight DESC, shared_publication_count DESC, target DESC, source DESC LIMIT 49)""", EDGES)
def ego_budget(v):
    return subgraph.ego_budget(people_of(v), graph.edges_around(v.authorship(), v.publication(), CENTER), CENTER, 50)


@query("ranked_cap", MEASURED_USES, """
    SELECT id FROM metrics JOIN researcher ON researcher_id = id
    ORDER BY primary_organization_id IS NOT NULL DESC, strength DESC, degree DESC, full_name DESC, id DESC LIMIT 250""", METRICS)
def ranked_cap(v):
    people = people_of(v)
    nodes = people.join(
        v.researcher().select(F.col("researcher_id").alias("id"), F.col("full_name").alias("label"), "primary_organization_id",
                              F.lit(None).cast("string").alias("university_code")), "id"
    ).join(graph.degree_strength(people, edges_of(v)), "id")
    return subgraph.ranked_cap(people, nodes, 250)


SUBGRAPH = MEASURED + """,
    light AS (SELECT * FROM edges WHERE weight >= 2),
    ranked AS (SELECT id FROM nodes ORDER BY primary_organization_id IS NOT NULL DESC, strength DESC, degree DESC,
      label DESC, id DESC LIMIT 500),
    chosen AS (SELECT n.* FROM nodes n JOIN ranked USING (id))"""


@query("subgraph", MEASURED_USES, """
    SELECT source, target, weight, first_collaboration_year, last_collaboration_year FROM light
    WHERE source IN (SELECT id FROM chosen) AND target IN (SELECT id FROM chosen)""", SUBGRAPH)
def subgraph_edges(v):
    nodes, edges = measured(v)
    found = subgraph.subgraph(nodes, edges, min_edge_weight=2, max_nodes=500)
    return found[1].select("source", "target", "weight", "first_collaboration_year", "last_collaboration_year")


@query("subgraph_summary", MEASURED_USES, """
    SELECT count(*) AS node_count, count(DISTINCT component_id) AS component_count,
      nullif(count(DISTINCT community_id), 0) AS community_count,
      (SELECT count(*) FROM light WHERE source IN (SELECT id FROM chosen) AND target IN (SELECT id FROM chosen)) AS edge_count
    FROM chosen""", SUBGRAPH)
def subgraph_summary(v):
    nodes, edges = measured(v)
    return subgraph.subgraph(nodes, edges, min_edge_weight=2, max_nodes=500)[2]


@query("subgraph_ego", "authorship", INSIDE_EDGES, AROUND + f""",
    best AS (SELECT id FROM around ORDER BY weight DESC, greatest(id, {CENTER}) DESC, least(id, {CENTER}) DESC LIMIT 49),
    chosen AS MATERIALIZED (SELECT CAST({CENTER} AS BIGINT) AS id UNION ALL SELECT id FROM best),
    """ + INSIDE)
def subgraph_ego(v):
    nodes = people_of(v).withColumns({"component_id": F.lit(0), "community_id": F.lit(0)})
    edges = graph.ego_edges(v.authorship(), v.publication(), CENTER)
    found = subgraph.subgraph(nodes, edges, node=CENTER, max_nodes=50)
    return found[1].select("source", "target", "weight")
