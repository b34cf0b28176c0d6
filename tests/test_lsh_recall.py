"""Recall of approximate neighbours with the operator's own number of tables."""

import pytest
from pyspark.sql import functions as F

import oracle
from paperweave.operators import semantic
from paperweave.plans import load_all
from paperweave.plans.registry import QUERIES

load_all()


@pytest.mark.parametrize("block_rows", [64, 256])
def test_recall_in_tables_of_many_blocks(spark, block_rows):
    vectors = spark.read.parquet(f"{oracle.ROOT}/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    assert vectors.count() > 4 * block_rows
    exact = {(r.source, r.target) for r in semantic.knn(vectors, 5, 0.3).collect()}
    near = {(r.source, r.target) for r in semantic.knn(vectors, 5, 0.3, method="lsh", block_rows=block_rows).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_recall_of_the_registered_query(spark):
    got = QUERIES["knn_recall"](spark, f"{oracle.ROOT}/sf0.1").first()
    assert got.exact_edges > 9_000 and got.found_edges >= 0.9 * got.exact_edges
