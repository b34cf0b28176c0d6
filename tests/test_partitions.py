"""Shuffles of coauthor edges and of candidate researchers hold a bounded number of rows a task."""

import pytest
from pyspark.sql import functions as F

from paperweave.operators import graph, resolve
from paperweave.session import COALESCE_KEY, PARTITIONS_KEY, Rounds, partitions_for


def test_partitions_that_follow_rows_are_not_put_together_again(spark):
    before = spark.conf.get(PARTITIONS_KEY), spark.conf.get(COALESCE_KEY)
    with pytest.raises(RuntimeError), partitions_for(spark, 400, per=10) as count:
        sums = spark.range(400).groupBy(F.hash("id")).count().select(F.spark_partition_id().alias("p")).collect()
        assert count == 40 and len({r.p for r in sums}) > 30
        raise RuntimeError
    assert (spark.conf.get(PARTITIONS_KEY), spark.conf.get(COALESCE_KEY)) == before


def test_few_rows_keep_the_sessions_partitions(spark):
    before = spark.conf.get(COALESCE_KEY)
    with partitions_for(spark, 40, per=10) as count:
        assert count == int(spark.conf.get(PARTITIONS_KEY)) == 4 and spark.conf.get(COALESCE_KEY) == before


def test_links_are_dealt_before_they_are_made_distinct(spark, monkeypatch):
    plans, measure = [], Rounds.measure

    def watched(self, df, **metrics):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return measure(self, df, **metrics)

    monkeypatch.setattr(Rounds, "measure", watched)
    links = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (2, 2), (None, 1)], "publication_id long, researcher_id long")
    papers = spark.createDataFrame([(1, 2001, None), (2, 2003, None)], "publication_id long, publication_year int, publication_date date")
    edges = graph.coauthor_edges(links, papers).collect()
    assert [(r.source, r.target, r.weight, r.first_collaboration_year, r.last_collaboration_year) for r in edges] == [(1, 2, 2, 2001, 2003)]
    assert all("RepartitionByExpression" in p for p in plans[:2])


def test_people_and_papers_are_dealt_before_they_are_grouped(spark, monkeypatch):
    plans, measure = [], Rounds.measure

    def watched(self, df, **metrics):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return measure(self, df, **metrics)

    monkeypatch.setattr(Rounds, "measure", watched)
    people = spark.createDataFrame([(1, "ann", "o", 1), (2, "ann", "o", 2), (3, "ann", None, 3), (4, "bob", "o", 1)],
                                   "researcher_id long, normalized_name string, primary_organization_id string, created_at long")
    links = spark.createDataFrame([(1, 7, 1), (2, 8, 1), (3, 7, 2), (4, 7, 3)], "researcher_id long, publication_id long, author_position int")
    got = {(r.entity_id, r.candidate_entity_id, r.shared_publications, r.confidence, r.auto_applied)
           for r in resolve.researcher_candidates(people, links).collect()}
    assert got == {(1, 2, 0, "strong_match", True), (1, 3, 1, "strong_match", False)}
    assert plans[-1].count("RepartitionByExpression") >= 3
