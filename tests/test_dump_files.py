"""The dump of `malformed_lines` is written by several tasks and numbered over its files."""

from pyspark.sql import functions as F

from paperweave.plans import source_queries
from paperweave.plans.views import Views
from paperweave.session import children


def test_dump_in_several_files(spark, tmp_path, monkeypatch):
    docs = spark.range(400).select(
        ((F.col("id") * 7) % 400).alias("doc_id"), F.lit("title\nbody").alias("text"), F.lit("en").alias("lang"),
        F.lit("s").alias("source"), F.lit(10).cast("bigint").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(source_queries, "folder", lambda v, name: f"{tmp_path}/{name}")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = source_queries.malformed_lines(Views(spark, str(tmp_path))).collect()
    finally:
        spark.conf.set(key, before)
    assert len([n for n in children(spark, f"{tmp_path}/dump") if n.startswith("part-")]) > 1
    assert sorted((r.line_number, r.line) for r in got) == [(i + 1, f'{{"id":"d{i}"'[:9]) for i in range(0, 400, 13)]
