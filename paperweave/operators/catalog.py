"""Catalog queries: lookups, filtered lists and counts, quick search, snapshots."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.functions.text import normalize_text
from paperweave.operators.grouping import latest_row

def entity_lookup(df: DataFrame, **equals) -> DataFrame:
    """The row whose columns equal the given values (at most one)."""
    for name, value in equals.items():
        df = df.where(F.col(name) == F.lit(value))
    return df.limit(1)


def matching(df: DataFrame, contains: Mapping[str, str] | None = None, equals: Mapping | None = None,
             year_from: int | None = None, year_to: int | None = None,
             year: str = "publication_year") -> DataFrame:
    """Rows whose normalized text contains, whose fields equal and whose year lies in range."""
    for name, text in (contains or {}).items():
        df = df.where(normalize_text(F.col(name)).contains(normalize_text(F.lit(text))))
    for name, value in (equals or {}).items():
        df = df.where(F.col(name).isin(value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    if year_from is not None:
        df = df.where(F.col(year) >= year_from)
    if year_to is not None:
        df = df.where(F.col(year) <= year_to)
    return df


def list_entities(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """One page of the filtered rows in the given order."""
    if limit < 1:
        raise ValueError("limit must be positive")
    page = matching(df, **filters).orderBy(*order)
    return (page.offset(offset) if offset else page).limit(limit)


def count_entities(df: DataFrame, **filters) -> DataFrame:
    return matching(df, **filters).agg(F.count("*").alias("count"))


def quick_search(branches: Mapping[str, tuple[DataFrame, str, str, list[Column]]], text: str,
                 per_type: int = 5) -> DataFrame:
    """Up to `per_type` hits per entity type, in each branch's own order.

    `branches` maps type -> (rows, id column, label column, order). A search text
    under two characters finds nothing.
    """
    hits = []
    for kind, (df, key, label, order) in branches.items():
        found = matching(df, contains={label: text}) if len(text.strip()) >= 2 else df.limit(0)
        hits.append(
            found.orderBy(*order).limit(per_type).select(
                F.lit(kind).alias("entity_type"),
                F.col(key).cast("string").alias("entity_id"),
                F.col(label).alias("label"),
            )
        )
    return reduce(DataFrame.unionByName, hits)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of every table."""
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def data_snapshot(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table_name, row_count, last_change) with the newest value of each table's time column."""
    rows = [
        df.agg(
            F.count("*").alias("row_count"),
            F.date_format(F.max(when), "yyyy-MM-dd HH:mm:ss").alias("last_change"),
        ).select(F.lit(name).alias("table_name"), "row_count", "last_change")
        for name, (df, when) in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def load_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row-count change per table between two `table_counts` frames."""
    old = before.select("table_name", F.col("row_count").alias("rows_before"))
    new = after.select("table_name", F.col("row_count").alias("rows_after"))
    return old.join(new, "table_name", "full").select(
        "table_name",
        F.coalesce("rows_before", F.lit(0)).cast("bigint").alias("rows_before"),
        F.coalesce("rows_after", F.lit(0)).cast("bigint").alias("rows_after"),
        (F.coalesce("rows_after", F.lit(0)) - F.coalesce("rows_before", F.lit(0))).cast("bigint").alias("delta"),
    )


def year_range(df: DataFrame, year: Column) -> DataFrame:
    return df.agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"))


def latest_run(runs: DataFrame, key: str, started: str, tie: str) -> DataFrame:
    """The newest row per key."""
    return latest_row(runs, [key], [F.desc(started), F.desc(tie)])


def provenance_by_source(records: DataFrame, sources: DataFrame, source_type: str) -> DataFrame:
    """Source records of the data sources of one type."""
    wanted = sources.where(F.col("source_type") == source_type).select("data_source_id", "name")
    return records.join(wanted, "data_source_id")


def publication_detail(authorship: DataFrame, researcher: DataFrame, publication_organization: DataFrame,
                       organization: DataFrame, publication: DataFrame,
                       publication_id=None) -> DataFrame:
    """Author and organization lines of publications, in display order.

    One row per line (line_type, position, id, name), so a publication with very
    many authors stays spread over rows. All publications when no id is given.
    """
    if publication_id is not None:
        publication = publication.where(F.col("publication_id") == publication_id)
        authorship = authorship.where(F.col("publication_id") == publication_id)
        publication_organization = publication_organization.where(F.col("publication_id") == publication_id)
    heads = publication.select("publication_id", "publication_year")
    authors = (
        authorship.join(researcher.select("researcher_id", "full_name"), "researcher_id")
        .select("publication_id", F.lit("author").alias("line_type"),
                F.col("author_position").cast("bigint").alias("position"),
                F.col("researcher_id").cast("string").alias("entity_id"), F.col("full_name").alias("name"))
    )
    orgs = (
        publication_organization.join(organization.select("organization_id", "name"), "organization_id")
        .select("publication_id", F.lit("organization").alias("line_type"),
                F.lit(None).cast("bigint").alias("position"),
                F.col("organization_id").alias("entity_id"), "name")
    )
    return heads.join(authors.unionByName(orgs), "publication_id")


def attribution_legend(nodes: DataFrame) -> DataFrame:
    """Nodes per organization, else per university, else unattributed, largest first."""
    kind = (
        F.when(F.col("primary_organization_id").isNotNull(), "organization")
        .when(F.col("university_code").isNotNull(), "university")
        .otherwise("fallback")
    )
    label = F.coalesce("primary_organization_name", "university_name", F.lit("Not attributed"))
    return (
        nodes.groupBy(kind.alias("kind"), F.coalesce("primary_organization_id", "university_code").alias("key"))
        .agg(F.min(label).alias("label"), F.count("*").alias("node_count"))
        .orderBy(F.desc("node_count"), "label", "key")
    )


def has_unassigned(nodes: DataFrame) -> DataFrame:
    """One flag: is any node without organization and without university?"""
    return nodes.agg(
        F.bool_or(F.col("primary_organization_id").isNull() & F.col("university_code").isNull()).alias("has_unassigned")
    )


NEXT_METRIC = {"degree": "strength", "strength": "degree", "betweenness": "strength"}


def top_nodes(nodes: DataFrame, metric: str, n: int = 10) -> DataFrame:
    """The `n` best nodes by degree, strength or betweenness; ties by the next metric, label, id."""
    return nodes.orderBy(*[F.desc(c) for c in (metric, NEXT_METRIC[metric], "label", "id")]).limit(n)
