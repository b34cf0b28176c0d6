"""Registered queries that write driver tables in a source's own form and read them back."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperweave.functions import payload as px
from paperweave.operators import embeddings as em
from paperweave.operators import quality, resolve
from paperweave.plans.catalog_queries import DOC_CATALOG, PEOPLE, doc_catalog, people
from paperweave.plans.registry import query
from paperweave.plans.resolve_queries import LINKS, shops
from paperweave.plans.semantic_queries import TEXT_USES, TEXTS, texts
from paperweave.session import Rounds, checkpoint_root
from paperweave.sources import builds, readers

DUMP = "id string, title string, venue string"


def folder(v, name):
    return f"{checkpoint_root(v.spark)}/{name}-{uuid.uuid4().hex}"


def dump_lines(v, papers=None):
    """Documents as lines of a JSON dump; every thirteenth is cut short."""
    line = F.to_json(F.struct(
        F.concat(F.lit("d"), F.col("publication_id").cast("string")).alias("id"), "title", F.col("venue_name").alias("venue")))
    broken = F.col("publication_id") % 13 == 0
    return (papers or v.document_publication()).select(F.when(broken, F.substring(line, 1, 9)).otherwise(line).alias("value"))


@query("read_entities", "document_publication", """
    SELECT 'd' || publication_id AS id, title, venue_name AS venue FROM document_publication WHERE publication_id % 13 <> 0""")
def read_entities(v):
    """Gzipped JSON lines, written and read back; bad lines are set aside."""
    path = folder(v, "dump")
    dump_lines(v).write.option("compression", "gzip").text(path)
    return readers.split_malformed(readers.read_entities(v.spark, path, DUMP, "QUARANTINE"))[0].select("id", "title", "venue")


@query("malformed_report", "document_publication", """
    SELECT count(*) AS bad_lines, min('{"id":"d' || left(publication_id || '"', 1)) AS sample
    FROM document_publication WHERE publication_id % 13 = 0""")
def malformed_report(v):
    path = folder(v, "dump")
    dump_lines(v).repartition(1).write.text(path)
    rejects = readers.split_malformed(readers.read_entities(v.spark, path, DUMP, "QUARANTINE"))[1]
    return readers.malformed_report(rejects).select("bad_lines", "sample")


@query("malformed_lines", "document_publication", """
    SELECT place AS line_number, left('{"id":"d' || publication_id || '"', 9) AS line
    FROM (SELECT *, row_number() OVER (ORDER BY publication_id) AS place FROM document_publication) WHERE publication_id % 13 = 0""")
def malformed_lines(v):
    """Bad lines of a dump in the order of the documents, numbered over its files, which Spark reads in blocks of 64 KB."""
    path, key = folder(v, "dump"), "spark.sql.files.maxPartitionBytes"
    dump_lines(v, v.document_publication().orderBy("publication_id")).write.text(path)
    before = v.spark.conf.get(key)
    v.spark.conf.set(key, str(1 << 16))
    try:
        # the files of a sort follow each other in the order of their names
        files = readers.numbered_lines(v.spark, path).groupBy("source_file").agg(F.max("line_number").alias("n"))
        earlier = Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)
        starts = files.select("source_file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
        lines = readers.malformed_lines(v.spark, path, DUMP).join(starts, "source_file")
        return Rounds(v.spark, "lines").cut(lines.select((F.col("start") + F.col("line_number")).alias("line_number"), "line"))
    finally:
        v.spark.conf.set(key, before)


@query("limit_per_input", "publication researcher", """
    SELECT 'publication' AS input, least(count(*), 700) AS row_count FROM publication
    UNION ALL SELECT 'researcher', least(count(*), 700) FROM researcher""")
def limit_per_input(v):
    """The caller's cap on each input, as an option of a trial load."""
    cut = readers.limit_per_input({"publication": v.publication(), "researcher": v.researcher()}, 700)
    counted = [df.agg(F.lit(name).alias("input"), F.count("*").alias("row_count")) for name, df in cut.items()]
    return counted[0].unionByName(counted[1])


@query("union_results", "publication document_publication", """
    SELECT publication_id, publication_type, CAST(NULL AS VARCHAR) AS language_code FROM publication
    UNION ALL SELECT publication_id, NULL, language_code FROM document_publication""")
def union_results(v):
    return readers.union_results(
        v.publication().select("publication_id", "publication_type"),
        v.document_publication().select("publication_id", "language_code"),
    ).select("publication_id", "publication_type", "language_code")


@query("stored_build", "publication_organization", """
    SELECT organization_id AS id, count(DISTINCT publication_id) AS degree FROM publication_organization GROUP BY 1""")
def stored_build(v):
    """A build written, activated and loaded; an older one of the same type is not."""
    path = folder(v, "build")
    nodes = v.publication_organization().groupBy(F.col("organization_id").alias("id")).agg(
        F.count_distinct("publication_id").alias("degree"))
    edges = v.publication_organization().select("publication_id", "organization_id")
    builds.write_build(nodes.withColumn("degree", F.lit(0).cast("bigint")), edges, nodes.agg(F.count("*").alias("n")), path, "old")
    builds.write_build(nodes, edges, nodes.agg(F.count("*").alias("n")), path, "new")
    registry = v.spark.createDataFrame(
        [("old", "publications", "completed", False, 1), ("new", "publications", "completed", True, 2)],
        "build_id string, graph_type string, status string, is_active boolean, started_at int")
    return builds.load_active_build(v.spark, registry, path, "publications")[0].select("id", "degree")


@query("extract_nested_pid", "", """
    SELECT p_partkey AS researcher_id, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 5 <> 0 THEN 'o-' || p_partkey END AS orcid FROM part""")
def extract_nested_pid(v):
    key = F.col("p_partkey")
    pid = F.struct(F.struct(
        F.when(key % 2 == 0, " ORCID").otherwise("isni").alias("scheme"),
        F.when(key % 5 == 0, " ").otherwise(F.concat(F.lit("o-"), key.cast("string"))).alias("value")).alias("id"))
    return v.table("part").select(key.alias("researcher_id"), pid.alias("pid")).select(
        "researcher_id", px.extract_nested_pid(F.col("pid"), "orcid").alias("orcid"))


@query("input_checks", "", """
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE upper(substr(c_mktsegment, 1, 2)) END AS country_code,
      CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'c' || c_custkey END AS identifier, c_custkey % 7 <= 3 AS in_order FROM customer""")
def input_checks(v):
    key = F.col("c_custkey")
    rows = v.table("customer").withColumns({
        "start_date": F.date_add(F.lit("2020-01-01").cast("date"), (key % 7).cast("int")), "end_date": F.lit("2020-01-04").cast("date")})
    return rows.select(
        "c_custkey",
        px.input_country_code(F.when(key % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), F.lower(F.substring("c_mktsegment", 1, 2))))).alias("country_code"),
        px.input_identifier(F.when(key % 4 == 0, " ").otherwise(F.concat(F.lit(" c"), key.cast("string"), F.lit("\t")))).alias("identifier"),
        quality.ends_after_start().alias("in_order"),
    )


def pure_provider(texts):
    """Stands for a remote service: length, words and a constant."""
    return [[float(len(t)), float(len(t.split(" "))), 1.0] for t in texts]


@query("embed_provider", TEXT_USES, """
    SELECT publication_id, 'generated' AS status, CAST(length(content_text) AS DOUBLE) AS chars,
      CAST(len(string_split(content_text, ' ')) AS DOUBLE) AS words FROM texts WHERE content_text IS NOT NULL""", TEXTS)
def embed_provider(v):
    done = em.embed(texts(v), pure_provider)
    return done.select("publication_id", "status", F.col("embedding")[0].alias("chars"), F.col("embedding")[1].alias("words"))


@query("identifier_duplicates", "document_publication publication authorship", """
    SELECT * FROM (
      SELECT 'publication' AS entity_type, CAST(t AS VARCHAR) AS entity_id, CAST(c AS VARCHAR) AS candidate_entity_id, identifier_value, identifier
      FROM (SELECT arg_min(publication_id, ROW(created_at, publication_id)) OVER (PARTITION BY doi) AS t, publication_id AS c,
          doi AS identifier_value, 'doi' AS identifier FROM docs WHERE doi <> '') WHERE t <> c
      UNION ALL SELECT 'researcher', CAST(t AS VARCHAR), CAST(c AS VARCHAR), orcid, 'orcid'
      FROM (SELECT min(researcher_id) OVER (PARTITION BY orcid) AS t, researcher_id AS c, orcid FROM (
        SELECT researcher_id, left(orcid, 13) AS orcid FROM people) WHERE orcid <> '') WHERE t <> c
      UNION ALL SELECT 'organization', CAST(t AS VARCHAR), CAST(c AS VARCHAR), v, k FROM (
        SELECT min(c_custkey) OVER (PARTITION BY c_custkey % 400) AS t, c_custkey AS c, 'ror' || (c_custkey % 400) AS v, 'ror_id' AS k FROM customer
        WHERE c_custkey % 2 = 0) WHERE t <> c
      UNION ALL SELECT 'organization', CAST(t AS VARCHAR), CAST(c AS VARCHAR), v, k FROM (
        SELECT min(c_custkey) OVER (PARTITION BY c_custkey % 600) AS t, c_custkey AS c, 'src' || (c_custkey % 600) AS v, 'openaire_id' AS k FROM customer)
        WHERE t <> c AND NOT (c % 2 = 0 AND t % 2 = 0 AND t = c % 400))""",
       ", ".join([DOC_CATALOG, LINKS, PEOPLE]))
def identifier_duplicates(v):
    key = F.col("organization_id")
    tables = {
        "publication": doc_catalog(v),
        "researcher": people(v).withColumn("orcid", F.substring("orcid", 1, 13)),
        "organization": shops(v).withColumns({
            "ror_id": F.when(key % 2 == 0, F.concat(F.lit("ror"), (key % 400).cast("string"))),
            "openaire_id": F.concat(F.lit("src"), (key % 600).cast("string"))}),
    }
    return resolve.identifier_duplicates(tables, v.authorship()).select(
        "entity_type", "entity_id", "candidate_entity_id", "identifier_value", "identifier")
