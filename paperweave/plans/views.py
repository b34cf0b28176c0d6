"""Logical tables over the driver's Parquet files.

`Views(spark, sf_dir)` gives each logical table as a DataFrame; `VIEW_SQL` states
the same flat tables for the SQL side of the checks. Nested columns (container,
reltype, country, author, ...) exist on the Spark side only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _key(prefix: str, col: str) -> Column:
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # catalog tables -----------------------------------------------------------
    def publication(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("publication_id"),
            F.to_date("o_orderdate").alias("publication_date"),
            F.year("o_orderdate").alias("publication_year"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderpriority").alias("publication_type"),
            F.col("o_orderstatus").alias("access_label"),
            F.col("o_custkey").alias("owner_id"),
        )

    def authorship(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("publication_id"),
            F.col("l_partkey").alias("researcher_id"),
            F.col("l_linenumber").alias("author_position"),
            F.col("l_shipdate").alias("created_at"),
        )

    def researcher(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("researcher_id"),
            F.col("p_name").alias("full_name"),
            F.col("p_brand").alias("display_name"),
            F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("S:"), (F.col("p_partkey") % 10).cast("string")))
            .alias("primary_organization_id"),
        )

    def researcher_affiliation(self) -> DataFrame:
        """A made-up table: people belong to the suppliers of their large first lines, so some have none and some several."""
        return (
            self.table("lineitem")
            .where((F.col("l_linenumber") == 1) & (F.col("l_quantity") > 30))
            .select("l_partkey", "l_suppkey").distinct()
            .select(F.col("l_partkey").alias("researcher_id"), _key("S:", "l_suppkey").alias("organization_id"))
        )

    def publication_organization(self) -> DataFrame:
        return (
            self.table("lineitem")
            .select("l_orderkey", "l_suppkey").distinct()
            .select(F.col("l_orderkey").alias("publication_id"), _key("S:", "l_suppkey").alias("organization_id"),
                    F.lit("affiliation").alias("relation_type"))
        )

    def organization(self) -> DataFrame:
        suppliers = self.table("supplier").select(
            _key("S:", "s_suppkey").alias("organization_id"),
            F.col("s_name").alias("name"),
            F.lit("supplier").alias("organization_type"),
            _key("N:", "s_nationkey").alias("parent_organization_id"),
        )
        nations = self.table("nation").select(
            _key("N:", "n_nationkey").alias("organization_id"),
            F.col("n_name").alias("name"),
            F.lit("nation").alias("organization_type"),
            _key("R:", "n_regionkey").alias("parent_organization_id"),
        )
        regions = self.table("region").select(
            _key("R:", "r_regionkey").alias("organization_id"),
            F.col("r_name").alias("name"),
            F.lit("region").alias("organization_type"),
            F.lit(None).cast("string").alias("parent_organization_id"),
        )
        return suppliers.unionByName(nations).unionByName(regions)

    # dump-style tables of the reports --------------------------------------------
    def organizations(self) -> DataFrame:
        """id, legalname, legalshortname, country struct<code,label>."""
        nation = _key("N:", "s_nationkey")
        return self.table("supplier").select(
            _key("S:", "s_suppkey").alias("id"),
            F.col("s_name").alias("legalname"),
            F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("Org "), (F.col("s_suppkey") % 50).cast("string")))
            .alias("legalshortname"),
            F.when(F.col("s_acctbal") > -900, F.struct(nation.alias("code"), nation.alias("label"))).alias("country"),
        )

    def relations(self) -> DataFrame:
        """source, target, sourceType, targetType, reltype struct<name,type>."""
        line = self.table("lineitem")

        def rel(source: str, target: str, name: str, kind: str, st: str, tt: str, rows: DataFrame = line):
            """Distinct key pairs first, labels afterwards: the shuffle moves numbers only."""
            (sp, sc), (tp, tc) = source.split(), target.split()
            return rows.select(F.col(sc).alias("s"), F.col(tc).alias("t")).distinct().select(
                _key(sp, "s").alias("source"),
                _key(tp, "t").alias("target"),
                F.lit(st).alias("sourceType"),
                F.lit(tt).alias("targetType"),
                F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type")).alias("reltype"),
            )

        org, pub, part, proj = "S: l_suppkey", "O: l_orderkey", "O: l_partkey", "P: l_partkey"
        first = line.where(F.col("l_linenumber") == 1).withColumn("next_order", F.col("l_orderkey") + 1)
        frames = [
            rel(org, pub, "isAuthorInstitutionOf", "affiliation", "organization", "result"),
            rel(pub, part, "Cites", "citation", "result", "result"),
            rel(part, pub, "IsCitedBy", "citation", "result", "result"),
            rel(org, proj, "isParticipant", "participation", "organization", "project"),
            rel(proj, pub, "produces", "outcome", "project", "result"),
            rel(pub, "O: next_order", "IsSupplementedBy", "supplement", "result", "result", first),
        ]
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    def results(self) -> DataFrame:
        """id, type, publicationdate, bestaccessright, container, pid."""
        kind = F.col("o_orderkey") % 4
        return self.table("orders").select(
            _key("O:", "o_orderkey").alias("id"),
            F.when(kind == 0, "publication").when(kind == 1, "dataset").when(kind == 2, "software")
            .otherwise("other").alias("type"),
            F.struct(
                F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "F", "CLOSED")
                .otherwise("EMBARGO").alias("label")
            ).alias("bestaccessright"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("publicationdate"),
            F.array(F.struct(F.lit("doi").alias("scheme"), _key("10.5555/", "o_orderkey").alias("value"))).alias("pid"),
            F.when(
                F.col("o_orderstatus") != "P",
                F.struct(
                    F.col("o_orderpriority").alias("name"),
                    F.concat(F.lit("L-"), F.substring("o_orderpriority", 1, 1)).alias("issnLinking"),
                    F.concat(F.lit("E-"), F.substring("o_orderpriority", 1, 1)).alias("issnOnline"),
                    F.concat(F.lit("P-"), F.substring("o_orderpriority", 1, 1)).alias("issnPrinted"),
                ),
            ).alias("container"),
        )

    def results_of(self, kind: str) -> DataFrame:
        return self.results().where(F.col("type") == kind)

    def projects(self) -> DataFrame:
        return self.table("part").select(
            _key("P:", "p_partkey").alias("id"),
            F.col("p_brand").alias("code"),
            F.when(F.col("p_size") % 13 == 0, F.concat(F.lit("unidentified "), "p_name"))
            .otherwise(F.col("p_name")).alias("title"),
            F.when(
                F.col("p_size") % 7 != 0,
                F.array(F.struct(F.col("p_type").alias("shortName"), F.lit("EU").alias("jurisdiction"))),
            ).otherwise(F.array().cast("array<struct<shortName:string,jurisdiction:string>>")).alias("funding"),
        )

    def publication_subjects(self) -> DataFrame:
        """One row per (publication, subject): id, subject struct<scheme,value>."""
        line = self.table("lineitem").select("l_orderkey", "l_partkey")
        part = self.table("part").select("p_partkey", "p_brand", "p_type")
        return (
            line.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select("l_orderkey", "p_brand", "p_type").distinct()
            .select(
                _key("O:", "l_orderkey").alias("id"),
                F.struct(
                    F.when(F.col("p_brand") == "Brand#1", "keyword").otherwise(F.col("p_brand")).alias("scheme"),
                    F.concat_ws(" ", "p_type", "p_brand").alias("value"),
                ).alias("subject"),
            )
        )

    # text, records, vectors --------------------------------------------------------
    def document_publication(self) -> DataFrame:
        digit = F.col("doc_id") % 10
        return self.table("documents").select(
            F.col("doc_id").alias("publication_id"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.col("text").alias("abstract"),
            F.col("lang").alias("language_code"),
            F.col("source").alias("venue_name"),
            F.when(digit == 0, "bad-doi")
            .when(digit == 1, F.lit(None))
            .otherwise(F.concat(F.lit("10.1234/d"), (F.col("doc_id") - F.col("doc_id") % 4).cast("string")))
            .alias("doi"),
        )

    def source_record(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("record_id"),
            F.date_format("ts", "yyyy-MM-dd").alias("ingestion_run_id"),
            F.col("event_type").alias("entity_type"),
            F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("source_identifier"),
            F.col("props").alias("raw_payload"),
            F.col("ts").alias("ingested_at"),
        )

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


VIEW_SQL = {
    "publication": """SELECT o_orderkey AS publication_id, CAST(o_orderdate AS DATE) AS publication_date,
        CAST(year(o_orderdate) AS INT) AS publication_year, o_orderdate AS created_at,
        o_orderpriority AS publication_type, o_orderstatus AS access_label, o_custkey AS owner_id FROM orders""",
    "authorship": """SELECT l_orderkey AS publication_id, l_partkey AS researcher_id,
        l_linenumber AS author_position, l_shipdate AS created_at FROM lineitem""",
    "researcher": """SELECT p_partkey AS researcher_id, p_name AS full_name, p_brand AS display_name,
        CASE WHEN p_partkey % 3 = 0 THEN 'S:' || (p_partkey % 10) END AS primary_organization_id FROM part""",
    "researcher_affiliation": """SELECT DISTINCT l_partkey AS researcher_id, 'S:' || l_suppkey AS organization_id
        FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 30""",
    "publication_organization": """SELECT DISTINCT l_orderkey AS publication_id,
        'S:' || l_suppkey AS organization_id, 'affiliation' AS relation_type FROM lineitem""",
    "organization": """SELECT 'S:' || s_suppkey AS organization_id, s_name AS name,
          'supplier' AS organization_type, 'N:' || s_nationkey AS parent_organization_id FROM supplier
        UNION ALL SELECT 'N:' || n_nationkey, n_name, 'nation', 'R:' || n_regionkey FROM nation
        UNION ALL SELECT 'R:' || r_regionkey, r_name, 'region', NULL FROM region""",
    "organizations": """SELECT 'S:' || s_suppkey AS id, s_name AS legalname,
          CASE WHEN s_acctbal >= 0 THEN 'Org ' || (s_suppkey % 50) END AS legalshortname,
          CASE WHEN s_acctbal > -900 THEN 'N:' || s_nationkey END AS country FROM supplier""",
    "relations": """SELECT DISTINCT 'S:' || l_suppkey AS source, 'O:' || l_orderkey AS target,
          'isAuthorInstitutionOf' AS rel_name, 'affiliation' AS rel_type,
          'organization' AS source_type, 'result' AS target_type FROM lineitem
        UNION ALL SELECT DISTINCT 'O:' || l_orderkey, 'O:' || l_partkey, 'Cites', 'citation', 'result', 'result' FROM lineitem
        UNION ALL SELECT DISTINCT 'O:' || l_partkey, 'O:' || l_orderkey, 'IsCitedBy', 'citation', 'result', 'result' FROM lineitem
        UNION ALL SELECT DISTINCT 'S:' || l_suppkey, 'P:' || l_partkey, 'isParticipant', 'participation', 'organization', 'project' FROM lineitem
        UNION ALL SELECT DISTINCT 'P:' || l_partkey, 'O:' || l_orderkey, 'produces', 'outcome', 'project', 'result' FROM lineitem
        UNION ALL SELECT DISTINCT 'O:' || l_orderkey, 'O:' || (l_orderkey + 1), 'IsSupplementedBy', 'supplement', 'result', 'result'
          FROM lineitem WHERE l_linenumber = 1""",
    "results": """SELECT 'O:' || o_orderkey AS id,
          CASE o_orderkey % 4 WHEN 0 THEN 'publication' WHEN 1 THEN 'dataset' WHEN 2 THEN 'software' ELSE 'other' END AS type,
          CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'CLOSED' ELSE 'EMBARGO' END AS access_label,
          CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS publicationdate,
          CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS container_name FROM orders""",
    "projects": """SELECT 'P:' || p_partkey AS id, p_brand AS code,
          CASE WHEN p_size % 13 = 0 THEN 'unidentified ' || p_name ELSE p_name END AS title,
          CASE WHEN p_size % 7 <> 0 THEN p_type END AS funder FROM part""",
    "publication_subjects": """SELECT DISTINCT 'O:' || l_orderkey AS id,
          CASE WHEN p_brand = 'Brand#1' THEN 'keyword' ELSE p_brand END AS scheme,
          p_type || ' ' || p_brand AS value
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "document_publication": """SELECT doc_id AS publication_id, split_part(text, chr(10), 1) AS title,
          text AS abstract, lang AS language_code, source AS venue_name,
          CASE WHEN doc_id % 10 = 0 THEN 'bad-doi' WHEN doc_id % 10 = 1 THEN NULL
            ELSE '10.1234/d' || (doc_id - doc_id % 4) END AS doi FROM documents""",
    "source_record": """SELECT event_id AS record_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS ingestion_run_id,
          event_type AS entity_type, 'u:' || user_id AS source_identifier, props AS raw_payload,
          ts AS ingested_at FROM events""",
    "vectors": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings",
}
