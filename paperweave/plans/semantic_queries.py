"""Registered embedding, nearest-neighbour and streaming queries."""

import uuid

from pyspark.sql import functions as F

from paperweave.functions import payload as px
from paperweave.operators import embeddings as em
from paperweave.operators import graph, semantic
from paperweave.plans import load
from paperweave.plans.catalog_queries import NORMAL
from paperweave.plans.registry import query
from paperweave.plans.resolve_queries import raw_organizations, raw_publications
from paperweave.session import Rounds, checkpoint_root
from paperweave.streaming.ingest import RECORD, read_records, stream_ingest

K, THRESHOLD = 5, 0.30
CONFIG = {"embedding_provider": "offline", "embedding_model": "tfidf", "embedding_version": "v1", "collection": "publications"}
KNN = f"""hits AS MATERIALIZED (SELECT a.id AS source, b.id AS target,
      list_dot_product(a.embedding, b.embedding) / sqrt(list_dot_product(a.embedding, a.embedding) * list_dot_product(b.embedding, b.embedding)) AS raw
    FROM vectors a CROSS JOIN vectors b),
    near AS (SELECT source, target, round(raw, 9) AS score FROM hits WHERE raw >= {THRESHOLD} QUALIFY
      row_number() OVER (PARTITION BY source ORDER BY round(raw, 9) DESC, target) <= {max(4 * K, K + 10)}),
    knn AS MATERIALIZED (SELECT source, target, score, CAST(place AS INT) AS rank FROM (SELECT source, target, score,
      row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS place FROM near WHERE source <> target) WHERE place <= {K}),
    pairs AS (SELECT least(source, target) AS source, greatest(source, target) AS target, max(score) AS weight, min(rank) AS rank,
      count(*) = 2 AS mutual_match, max(CASE WHEN source < target THEN rank END) AS source_rank,
      max(CASE WHEN source > target THEN rank END) AS target_rank FROM knn GROUP BY 1, 2)"""
EDGE_COLS = "source, target, round(weight, 6) AS weight, rank, mutual_match, source_rank, target_rank"


def knn(v):
    return semantic.knn(v.vectors(), K, THRESHOLD)


def shown(edges):
    return edges.select("source", "target", F.round("weight", 6).alias("weight"), "rank", "mutual_match", "source_rank", "target_rank")


@query("knn_edges_directed", "vectors", "SELECT source, target, round(score, 6) AS score, rank FROM knn", KNN)
def knn_edges_directed(v):
    return knn(v).withColumn("score", F.round("score", 6))


# as many hash orders as the operator takes for this number of vectors
TABLES = f"""(SELECT CASE WHEN blocks <= 2 THEN 1 ELSE greatest({semantic.LSH_TABLES}, ceil({semantic.LSH_TABLES_PER_ROOT} * sqrt(blocks))::BIGINT) END
      FROM (SELECT ceil(count(*) / {semantic.BLOCK_ROWS}) AS blocks FROM vectors))"""
LSH = f"""planes AS MATERIALIZED (SELECT t, bit, list(CASE WHEN md5(t || ':' || bit || ':' || d)[1] >= '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY d) AS plane
      FROM range({TABLES}) a(t), range({semantic.LSH_BITS}) b(bit), range((SELECT len(any_value(embedding)) FROM vectors)) c(d) GROUP BY 1, 2),
    unit AS MATERIALIZED (SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM vectors),
    ranked AS MATERIALIZED (SELECT t, id, CAST(row_number() OVER (PARTITION BY t ORDER BY signature, id) - 1 AS BIGINT) AS place FROM (
      SELECT t, id, sum(CASE WHEN list_dot_product(e, plane) > 0 THEN 1::BIGINT << bit::INT ELSE 0 END)::BIGINT AS signature
      FROM unit CROSS JOIN planes GROUP BY 1, 2)),
    spans AS (SELECT t, id, place // {semantic.BLOCK_ROWS} AS w FROM ranked UNION ALL SELECT t, id, place // {semantic.BLOCK_ROWS} - 1 FROM ranked WHERE place >= {semantic.BLOCK_ROWS}),
    met AS (SELECT DISTINCT a.id AS source, b.id AS target FROM spans a JOIN spans b ON a.t = b.t AND a.w = b.w),
    hits AS MATERIALIZED (SELECT source, target, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS raw
      FROM met JOIN unit a ON a.id = source JOIN unit b ON b.id = target)"""


def knn_near(v):
    return semantic.knn(v.vectors(), K, THRESHOLD, method="lsh")


@query("knn_lsh", "vectors", "SELECT source, target, round(score, 6) AS score, rank FROM knn",
       LSH + "," + KNN.split("CROSS JOIN vectors b),", 1)[1])
def knn_lsh(v):
    return knn_near(v).withColumn("score", F.round("score", 6))


@query("knn_recall", "vectors", f"""
    SELECT (SELECT count(*) FROM exact) AS exact_edges, count(*) AS found_edges FROM exact SEMI JOIN approx USING (source, target)""",
       LSH.replace("hits AS", "met_hits AS") + ", " + KNN.split("CROSS JOIN vectors b),", 1)[1].split("pairs AS")[0].rstrip().rstrip(",")
       .replace("FROM hits", "FROM met_hits").replace("near AS", "near_some AS").replace("FROM near ", "FROM near_some ").replace("knn AS", "approx AS")
       + ", " + KNN.split("pairs AS")[0].rstrip().rstrip(",").replace("knn AS", "exact AS"))
def knn_recall(v):
    """How many edges of the exact neighbour graph the approximate one has."""
    both = knn(v).select("source", "target").join(
        knn_near(v).select("source", "target", F.lit(True).alias("found")), ["source", "target"], "left")
    return both.agg(F.count("*").alias("exact_edges"), F.count("found").alias("found_edges"))


@query("semantic_edges", "vectors", f"SELECT {EDGE_COLS} FROM pairs", KNN)
def semantic_edges(v):
    return shown(semantic.symmetrize(knn(v)))


@query("semantic_edges_mutual", "vectors", f"SELECT {EDGE_COLS} FROM pairs WHERE mutual_match", KNN)
def semantic_edges_mutual(v):
    return shown(semantic.symmetrize(knn(v), "mutual_only"))


@query("semantic_neighbors", "vectors", """
    SELECT CASE WHEN source = 11 THEN target ELSE source END AS neighbor, round(weight, 6) AS weight, rank, mutual_match
    FROM pairs WHERE source = 11 OR target = 11""", KNN)
def semantic_neighbors(v):
    return graph.node_neighbors(semantic.symmetrize(knn(v)), 11, "semantic").select(
        "neighbor", F.round("weight", 6).alias("weight"), "rank", "mutual_match")


@query("semantic_strength", "vectors", """
    SELECT v.id, count(w.weight) AS degree, CAST(round(coalesce(sum(CAST(w.weight AS DECIMAL(28,9))), 0), 6) AS DOUBLE) AS strength FROM vectors v
    LEFT JOIN (SELECT source AS id, weight FROM pairs UNION ALL SELECT target, weight FROM pairs) w ON w.id = v.id GROUP BY 1""", KNN)
def semantic_strength(v):
    return graph.degree_strength(v.vectors().select("id"), semantic.symmetrize(knn(v)), round_to=6)


def semantic_publications(v):
    """One publication per vector: the document of the same number, dated by the order of that number."""
    docs = v.document_publication().withColumnRenamed("publication_id", "id")
    dates = v.publication().select(F.col("publication_id").alias("id"), "publication_year", "created_at")
    return v.vectors().select("id", "label").join(docs, "id").join(dates, "id").select(
        F.col("id").alias("publication_id"), "title", "language_code", "venue_name", "publication_year", "created_at", "doi",
        F.concat(F.lit("type "), F.col("label").cast("string")).alias("publication_type"),
    )


SEM_PUB = """sem AS (SELECT v.id AS publication_id, d.title, d.language_code, d.venue_name, CAST(p.publication_year AS INT) AS publication_year,
      p.created_at, d.doi, 'type ' || v.label AS publication_type
    FROM vectors v JOIN document_publication d ON d.publication_id = v.id JOIN publication p ON p.publication_id = v.id)"""
SEM_USES = "vectors document_publication publication"


def stored_vectors(v):
    """Embedding rows: even publications under the active model, the others under an old one."""
    ident = F.col("id")
    return v.vectors().select(
        ident.alias("publication_id"), F.lit("offline").alias("embedding_provider"),
        F.when(ident % 2 == 0, "tfidf").otherwise("old").alias("embedding_model"), F.lit("v1").alias("embedding_version"),
        F.lit("publications").alias("collection"), "embedding",
        F.timestamp_seconds(F.lit(1_700_000_000) + ident).alias("updated_at"),
    )


@query("semantic_selection", SEM_USES, """
    SELECT publication_id, publication_year, language_code FROM sem
    WHERE publication_id % 2 = 0 AND language_code = 'en' AND publication_year BETWEEN 1996 AND 2000""", SEM_PUB)
def semantic_selection(v):
    return semantic.select_embedded(
        semantic_publications(v), stored_vectors(v), "offline", "tfidf", "v1", language="en", year_from=1996, year_to=2000
    ).select("publication_id", "publication_year", "language_code")


@query("semantic_nodes", SEM_USES + " authorship researcher publication_organization organization", """
    SELECT s.publication_id AS id, s.publication_year, s.publication_type,
      coalesce((SELECT string_agg(trim(full_name), '|' ORDER BY author_position, researcher_id) FROM authorship JOIN researcher USING (researcher_id)
        WHERE authorship.publication_id = s.publication_id), '') AS authors,
      coalesce((SELECT string_agg(organization_id, '|' ORDER BY organization_id) FROM publication_organization JOIN organization USING (organization_id)
        WHERE publication_organization.publication_id = s.publication_id), '') AS organization_ids
    FROM sem s WHERE s.publication_id IN (SELECT source FROM pairs UNION ALL SELECT target FROM pairs)""", KNN + ", " + SEM_PUB)
def semantic_nodes(v):
    nodes = semantic.semantic_nodes(
        semantic_publications(v), v.authorship(), v.researcher(), v.publication_organization(), v.organization(),
        semantic.symmetrize(knn(v)),
    )
    return nodes.select("id", "publication_year", "publication_type", F.array_join("authors", "|").alias("authors"),
                        F.array_join("organization_ids", "|").alias("organization_ids"))


# embedding texts and plans ---------------------------------------------------------------------------------


TEXTS = """names AS (SELECT publication_id, string_agg(trim(full_name), ', ' ORDER BY author_position, researcher_id) AS authors
      FROM authorship JOIN researcher USING (researcher_id) GROUP BY 1),
    texts AS (SELECT d.publication_id, nullif(concat_ws(chr(10) || chr(10),
        'Title: ' || nullif(regexp_replace(regexp_replace(title, '^\\s+', ''), '\\s+$', ''), ''), 'Authors: ' || authors,
        'Abstract: ' || nullif(regexp_replace(regexp_replace(abstract, '^\\s+', ''), '\\s+$', ''), '')), '') AS content_text
      FROM document_publication d LEFT JOIN names USING (publication_id))"""
TEXT_USES = "document_publication authorship researcher"


def texts(v):
    return em.embedding_text(v.document_publication(), v.authorship(), v.researcher())


@query("embedding_text", TEXT_USES, "SELECT publication_id, content_text FROM texts", TEXTS)
def embedding_text(v):
    return texts(v).select("publication_id", "content_text")


@query("content_hash", TEXT_USES, "SELECT publication_id, sha256(content_text) AS content_hash FROM texts", TEXTS)
def content_hash(v):
    return texts(v).select("publication_id", px.content_hash(F.col("content_text")).alias("content_hash"))


def known_hashes(v):
    """Half of the publications already embedded; every seventh of those under another text."""
    ident = F.col("publication_id")
    changed = F.concat(F.col("content_text"), F.when(ident % 7 == 0, "!").otherwise(""))
    return texts(v).where(ident % 2 == 0).select(
        "publication_id", F.sha2(changed, 256).alias("content_hash"), *[F.lit(x).alias(k) for k, x in CONFIG.items()])


PLAN = TEXTS + """, plan AS (SELECT publication_id, sha256(content_text) AS content_hash,
      CASE WHEN content_text IS NULL THEN 'failed' WHEN publication_id % 2 = 0 AND publication_id % 7 <> 0 THEN 'skipped'
        ELSE 'generated' END AS status FROM texts)"""


@query("embedding_plan", TEXT_USES, """
    SELECT publication_id, content_hash, status, CASE status WHEN 'skipped' THEN 'content_unchanged' WHEN 'failed' THEN 'no embeddable content' END AS reason
    FROM plan""", PLAN)
def embedding_plan(v):
    return em.embedding_plan(texts(v), known_hashes(v), CONFIG)


@query("embedding_summary", TEXT_USES, """
    SELECT count(*) AS processed, count(*) FILTER (WHERE status = 'generated') AS generated,
      count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'failed') AS failed FROM plan""", PLAN)
def embedding_summary(v):
    return em.embedding_summary(em.embedding_plan(texts(v), known_hashes(v), CONFIG))


@query("embedding_payload", TEXT_USES, """
    SELECT d.publication_id, CAST(d.publication_id AS VARCHAR) AS payload_id, d.title, sha256(content_text) AS text_hash, d.doi,
      d.doi IS NOT NULL AS has_doi, sha256(nullif(abstract, '')) AS abstract_hash,
      (SELECT min(researcher.full_name) FROM authorship JOIN researcher USING (researcher_id)
        WHERE authorship.publication_id = d.publication_id AND author_position = (SELECT min(author_position) FROM authorship a
          WHERE a.publication_id = d.publication_id) AND researcher_id = (SELECT min(researcher_id) FROM authorship b
          WHERE b.publication_id = d.publication_id AND b.author_position = authorship.author_position)) AS first_author
    FROM document_publication d JOIN texts t ON t.publication_id = d.publication_id WHERE content_text IS NOT NULL""", TEXTS)
def embedding_payload(v):
    payload = em.embedding_payload(texts(v), v.document_publication(), v.authorship(), v.researcher())
    get = lambda path: F.get_json_object("payload", path)
    return payload.select(
        "publication_id", get("$.publication_id").alias("payload_id"), get("$.title").alias("title"),
        F.sha2(get("$.content_text"), 256).alias("text_hash"), get("$.doi").alias("doi"),
        F.array_contains(F.json_object_keys("payload"), "doi").alias("has_doi"),
        F.sha2(get("$.abstract"), 256).alias("abstract_hash"), get("$.authors[0]").alias("first_author"),
    )


TFIDF = TEXTS + """, tokens AS (SELECT publication_id, unnest(regexp_split_to_array(lower(content_text), '[^a-z0-9_]+')) AS word
      FROM texts WHERE content_text IS NOT NULL),
    tf AS (SELECT publication_id, CAST('0x' || left(md5(word), 8) AS BIGINT) % 64 AS bucket, count(*) AS tf FROM tokens WHERE word <> '' GROUP BY 1, 2),
    weighted AS (SELECT publication_id, bucket, tf * ln(((SELECT count(*) FROM texts WHERE content_text IS NOT NULL) + 1)
      / (count(*) OVER (PARTITION BY bucket) + 1)) AS w FROM tf)"""


@query("embed_documents", TEXT_USES, """
    SELECT publication_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY publication_id)), 6) AS weight
    FROM weighted QUALIFY w > 0""", TFIDF)
def embed_documents(v):
    """The offline vectors, a row per entry that is not zero; texts and weights are made once."""
    rounds = Rounds(v.spark, "embed")
    written = rounds.cut(texts(v))
    weights = rounds.cut(em.tfidf_weights(written))
    entries = em.tfidf_vectors(written, weights=weights).select("publication_id", F.posexplode("embedding").alias("bucket", "x"))
    return weights.join(
        entries.where(F.col("x") > 0).select("publication_id", F.col("bucket").cast("bigint").alias("bucket")), ["publication_id", "bucket"]
    ).select("publication_id", "bucket", F.round("weight", 6).alias("weight"))


@query("embedding_status", "document_publication vectors", """
    SELECT (SELECT count(*) FROM document_publication) AS publication_count, count(*) AS embedding_count,
      strftime(to_timestamp(max(1700000000 + id)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last_updated_at
    FROM vectors WHERE id % 2 = 0""")
def embedding_status(v):
    return em.embedding_status(v.document_publication(), stored_vectors(v), CONFIG)


@query("upsert_vectors", "vectors", """
    SELECT id AS publication_id, CASE WHEN id % 2 = 0 THEN 'tfidf' ELSE 'old' END AS embedding_model,
      CASE WHEN id % 2 = 0 THEN 'new' ELSE 'publications' END AS collection FROM vectors""")
def upsert_vectors(v):
    base = stored_vectors(v)
    new = base.where(F.col("embedding_model") == "tfidf").withColumn("collection", F.lit("new"))
    return em.upsert_vectors(base, new).select("publication_id", "embedding_model", "collection")


@query("drop_configuration", "vectors", "SELECT id AS publication_id FROM vectors WHERE id % 2 <> 0")
def drop_configuration(v):
    return em.drop_configuration(stored_vectors(v), CONFIG).select("publication_id")


# loads ------------------------------------------------------------------------------------------------------


def load_inputs(v):
    pubs = raw_publications(v).withColumn(
        "author", F.array(F.struct(
            F.concat(F.lit("Author "), (F.col("arrival") % 97).cast("string")).alias("fullname"),
            F.lit(1).cast("bigint").alias("rank"),
        )))
    rel = v.table("supplier").select(
        F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("source"),
        F.concat(F.lit("doc::"), F.col("s_suppkey").cast("string")).alias("target"),
        F.lit("organization").alias("sourceType"), F.lit("result").alias("targetType"),
        F.struct(F.lit("hasAuthorInstitution").alias("name"), F.lit("affiliation").alias("type")).alias("reltype"),
    )
    return {"publications": pubs, "organizations": raw_organizations(v), "relations": rel}


LOADED = f"""m AS (SELECT publication_id AS n, doi, CASE WHEN publication_id % 10 <> 9 THEN 'doc::' || publication_id
        ELSE 'orig::' || publication_id END AS key,
      CASE WHEN publication_id % 10 = 8 OR trim(title) = '' THEN 'untitled' ELSE {NORMAL.format('title')} END AS title,
      CASE WHEN publication_id % 10 = 7 THEN NULL ELSE publication_id % 25 END AS year FROM document_publication),
    same AS (SELECT a.n AS l, b.n AS r FROM m a JOIN m b ON a.doi = b.doi
      OR (a.title <> '' AND a.title = b.title AND a.year IS NOT DISTINCT FROM b.year)),
    reach(n, root) USING KEY (n) AS (SELECT n, n FROM m UNION SELECT s.l, min(r.root) FROM same s JOIN reach r ON r.n = s.r
      JOIN recurring.reach c ON c.n = s.l WHERE r.root < c.root GROUP BY s.l),
    links AS (SELECT DISTINCT root, n % 97 AS author FROM reach),
    newest AS (SELECT root, max(n) AS n FROM reach GROUP BY 1),
    found AS (SELECT newest.root, s_suppkey FROM supplier JOIN newest ON newest.n = s_suppkey AND newest.n % 10 <> 9),
    solo AS (SELECT root, min(author) AS author FROM links GROUP BY 1 HAVING count(*) = 1)"""


@query("run_load", "document_publication", """
    SELECT t AS table_name, CAST(0 AS BIGINT) AS rows_before, c AS rows_after, c AS delta FROM (
      SELECT 'publication' AS t, count(DISTINCT root) AS c FROM reach
      UNION ALL SELECT 'organization', count(*) FROM supplier
      UNION ALL SELECT 'researcher', count(DISTINCT author) FROM links
      UNION ALL SELECT 'publication_author', count(*) FROM links
      UNION ALL SELECT 'publication_organization', count(*) FROM found
      UNION ALL SELECT 'researcher_affiliation', count(*) FROM (SELECT DISTINCT author, s_suppkey FROM found JOIN solo USING (root))
      UNION ALL SELECT 'external_identifier', 1 + count(*) + count(DISTINCT doi) FROM m
      UNION ALL SELECT 'source_record', (SELECT count(*) FROM m) + 2 * count(*) FROM supplier)""", LOADED)
def run_load(v):
    return load.run_load(v.spark, load_inputs(v))[1]


@query("stream_ingest", "source_record", """
    SELECT entity_type, source_identifier, min(record_id) AS record_id, count(*) AS arrivals,
      count(DISTINCT raw_payload) > 1 AS payload_changed FROM source_record GROUP BY 1, 2""")
def stream(v):
    base = f"{checkpoint_root(v.spark)}/stream-{uuid.uuid4().hex}"
    v.source_record().select(*[c.split(" ")[0] for c in RECORD.split(", ")]).repartitionByRange(4, "record_id").write.parquet(f"{base}/in")
    stream_ingest(v.spark, f"{base}/in", f"{base}/tables", f"{base}/state", fmt="parquet",
                  schema=RECORD.replace("timestamp", "timestamp_ntz")).awaitTermination()
    return read_records(v.spark, f"{base}/tables").select(
        "entity_type", "source_identifier", "record_id", "arrivals", "payload_changed")
