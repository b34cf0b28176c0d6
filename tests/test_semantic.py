import math
import random

import pytest
from pyspark.sql import functions as F

from paperweave.operators import embeddings as em
from paperweave.operators import semantic


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def random_vectors(seed, n, d=8, copies=0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(d)]) for i in range(n)]
    return rows + [(n + i, rows[0][1]) for i in range(copies)]


def brute(rows, k, threshold, limit):
    def unit(x):
        norm = math.sqrt(sum(c * c for c in x)) or 1
        return [c / norm for c in x]

    import numpy as np
    points = [(i, unit([float(np.float32(c)) for c in x])) for i, x in rows]
    out = set()
    for i, x in points:
        near = sorted((-round(sum(a * b for a, b in zip(x, y)), 9), j) for j, y in points)
        near = [(s, j) for s, j in near if -s >= threshold][:limit]
        near = [(s, j) for s, j in near if j != i][:k]
        out |= {(i, j, r) for r, (_, j) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize("block_rows", [4096, 17])
def test_exact_knn_with_a_group_of_copies(spark, block_rows):
    rows = random_vectors(4, 60, copies=30)
    got = semantic.knn(vectors(spark, rows), 4, 0.2, block_rows=block_rows)
    assert {(r.source, r.target, r["rank"]) for r in got.collect()} == brute(rows, 4, 0.2, 16)


def test_selection_narrows_after_the_candidate_limit(spark):
    rows = random_vectors(6, 50)
    df = vectors(spark, rows)
    chosen = df.where(F.col("id") % 2 == 0).select("id")
    narrow = semantic.knn(df, 3, -1.0, candidate_limit=4, selected=chosen)
    assert narrow.where(F.col("target") % 2 != 0).isEmpty()
    assert narrow.groupBy("source").count().where(F.col("count") > 3).isEmpty()
    wide = semantic.knn(df, 3, -1.0, candidate_limit=None, selected=chosen)
    assert wide.count() == 25 * 3


def test_lsh_recall(spark):
    rows = random_vectors(8, 400, d=16, copies=20)
    df = vectors(spark, rows)
    exact = {(r.source, r.target) for r in semantic.knn(df, 5, 0.3).collect()}
    near = {(r.source, r.target) for r in semantic.knn(df, 5, 0.3, method="lsh", block_rows=64, tables=12).collect()}
    assert len(exact & near) / len(exact) > 0.6


HITS = [(1, 2, 0.91, 1), (2, 1, 0.91, 1), (2, 3, 0.82, 2), (3, 2, 0.82, 1)]
SCHEMA = "source long, target long, score double, rank int"


def test_symmetrize(spark):
    got = sorted(tuple(r) for r in semantic.symmetrize(spark.createDataFrame(HITS, SCHEMA)).select(
        "source", "target", "weight", "rank", "mutual_match", "source_rank", "target_rank").collect())
    assert got == [(1, 2, 0.91, 1, True, 1, 1), (2, 3, 0.82, 1, True, 2, 1)]
    one_way = spark.createDataFrame([(1, 2, 0.9, 3)], SCHEMA)
    row = semantic.symmetrize(one_way).first()
    assert (row.mutual_match, row.source_score, row.target_score) == (False, 0.9, None)
    assert semantic.symmetrize(one_way, "mutual_only").isEmpty()
    assert semantic.symmetrize(one_way, mutual_knn=True).isEmpty()


def papers(spark):
    pubs = spark.createDataFrame([(1, " Title one ", "About it"), (2, " ", None), (3, None, " ")],
                                 "publication_id long, title string, abstract string")
    auth = spark.createDataFrame([(1, 20, 2, "x"), (1, 10, 1, "y"), (1, 30, 3, "Listed Name")],
                                 "publication_id long, researcher_id long, author_position int, author_list_name string")
    people = spark.createDataFrame([(10, "Ada Lovelace"), (20, " Grace Hopper "), (30, " ")], "researcher_id long, full_name string")
    return pubs, auth, people


def test_embedding_text_template(spark):
    rows = {r.publication_id: r for r in em.embedding_text(*papers(spark)).collect()}
    assert rows[1].content_text == "Title: Title one\n\nAuthors: Ada Lovelace, Grace Hopper, Listed Name\n\nAbstract: About it"
    assert rows[2].content_text is None and rows[2].error and rows[3].error
    with pytest.raises(ValueError):
        em.embedding_text(*papers(spark), fields=["venue"])


CONFIG = {"embedding_provider": "p", "embedding_model": "m", "embedding_version": "v", "collection": "c"}


def test_embedding_plan_skips_unchanged(spark):
    texts = em.embedding_text(*papers(spark))
    known = texts.where("publication_id = 1").select(
        "publication_id", F.sha2("content_text", 256).alias("content_hash"), *[F.lit(v).alias(k) for k, v in CONFIG.items()])
    plan = em.embedding_plan(texts, known, CONFIG)
    assert tuple(em.embedding_summary(plan).first()) == (3, 0, 1, 2)
    assert tuple(em.embedding_summary(em.embedding_plan(texts, known, CONFIG, force=True)).first()) == (3, 1, 0, 2)
    moved = em.embedding_plan(texts, known.withColumn("collection", F.lit("d")), CONFIG)
    assert tuple(em.embedding_summary(moved).first()) == (3, 1, 0, 2)


def test_provider_failures_stay_in_their_batch(spark):
    texts = spark.range(0, 40, 1, 1).select(F.col("id").alias("publication_id"), F.concat(F.lit("t"), F.col("id")).alias("content_text"))

    def provider(batch):
        if "t17" in batch:
            raise RuntimeError("no service")
        return [[float(len(t)), 1.0] for t in batch]

    got = em.embed(texts, provider, batch_size=16).collect()
    assert sum(r.status == "generated" for r in got) == 24
    assert {r.reason for r in got if r.status == "failed"} == {"no service"}
    assert all(r.embedding == [2.0 if r.publication_id < 10 else 3.0, 1.0] for r in got if r.status == "generated")


def test_tfidf_vectors_are_unit_length(spark):
    texts = spark.createDataFrame([(1, "a b c"), (2, "a b d"), (3, "x y z")], "publication_id long, content_text string")
    for row in em.tfidf_vectors(texts, 32).collect():
        assert math.sqrt(sum(x * x for x in row.embedding)) == pytest.approx(1, abs=1e-5)


def test_vector_table_upsert_and_drop(spark):
    base = spark.createDataFrame([(1, "p", "m", "v", "old"), (2, "p", "m", "v", "old"), (1, "p", "n", "v", "old")],
                                 "publication_id long, embedding_provider string, embedding_model string, embedding_version string, h string")
    new = base.where("publication_id = 1 and embedding_model = 'm'").withColumn("h", F.lit("new"))
    got = sorted((r.publication_id, r.embedding_model, r.h) for r in em.upsert_vectors(base, new).collect())
    assert got == [(1, "m", "new"), (1, "n", "old"), (2, "m", "old")]
    assert em.drop_configuration(base, CONFIG).count() == 1
