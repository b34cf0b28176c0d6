"""Constraint audits and anomaly findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.functions import fixed_values as fv
from paperweave.functions.payload import is_valid_doi, is_valid_orcid, is_valid_ror
from paperweave.functions.text import token_count

# Unique keys of the canonical tables; a key with a null part is exempt.
UNIQUE_KEYS = {
    "publication": {"publication_doi": ["doi"], "publication_source": ["openaire_id"]},
    "organization": {"organization_ror": ["ror_id"], "organization_source": ["openaire_id"]},
    "researcher": {"researcher_orcid": ["orcid"]},
    "publication_author": {
        "publication_researcher": ["publication_id", "researcher_id"],
        "publication_position": ["publication_id", "author_position"],
    },
    "publication_organization": {"publication_organization": ["publication_id", "organization_id", "relation_type"]},
    "publication_embedding": {
        "publication_embedding": ["publication_id", "embedding_provider", "embedding_model", "embedding_version"],
    },
    "external_identifier": {"external_identifier": ["entity_type", "identifier_type", "identifier_value"]},
    "source_record": {"source_record": ["ingestion_run_id", "entity_type", "source_identifier"]},
}
# Foreign keys of the canonical tables: (column, parent table, its key).
PARENTS = {
    "researcher": [("primary_organization_id", "organization", "organization_id")],
    "organization": [("parent_organization_id", "organization", "organization_id")],
    "publication_author": [("publication_id", "publication", "publication_id"), ("researcher_id", "researcher", "researcher_id")],
    "publication_organization": [
        ("publication_id", "publication", "publication_id"), ("organization_id", "organization", "organization_id")],
    "researcher_affiliation": [
        ("researcher_id", "researcher", "researcher_id"), ("organization_id", "organization", "organization_id")],
    "publication_embedding": [("publication_id", "publication", "publication_id")],
}


def unique_violations(df: DataFrame, keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """(constraint, key, row_count) of every key group with more than one row.

    A key with a null part is exempt. `keys` maps a constraint name to its columns.
    """
    out = []
    for name, cols in keys.items():
        present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
        value = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
        out.append(
            df.where(present)
            .groupBy(*cols)
            .agg(F.count("*").alias("row_count"))
            .where(F.col("row_count") > 1)
            .select(F.lit(name).alias("constraint_name"), value.alias("key_value"), "row_count")
        )
    return reduce(DataFrame.unionByName, out)


def audit_unique(tables: Mapping[str, DataFrame]) -> DataFrame:
    """`unique_violations` of every unique key whose table and columns are present."""
    return reduce(DataFrame.unionByName, [
        unique_violations(tables[name], keys)
        for name, every in UNIQUE_KEYS.items() if name in tables
        if (keys := {k: cols for k, cols in every.items() if set(cols) <= set(tables[name].columns)})
    ])


def audit_links(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, foreign_key, key_value, row_count): link rows without a parent, over all links present."""
    return reduce(DataFrame.unionByName, [
        orphans(tables[name], tables[parent], fk, pk)
        .groupBy(F.lit(name).alias("table_name"), F.lit(fk).alias("foreign_key"), F.col(fk).cast("string").alias("key_value"))
        .agg(F.count("*").alias("row_count"))
        for name, links in PARENTS.items() if name in tables
        for fk, parent, pk in links if parent in tables and fk in tables[name].columns
    ])


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose non-null foreign key has no parent."""
    keys = parent.select(F.col(pk).alias(fk))
    return child.where(F.col(fk).isNotNull()).join(keys, fk, "left_anti").select(*child.columns)


def range_violations(df: DataFrame, id_col: str, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, entity_id) for each row that breaks a rule; null passes like a SQL check."""
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), F.col(id_col).cast("string").alias("entity_id"))


def length_at_most(col: str, n: int) -> Column:
    return F.length(col) <= n


def year_in_range(col: str = "publication_year") -> Column:
    return F.col(col).between(1000, 3000)


def ends_after_start(start: str = "start_date", end: str = "end_date") -> Column:
    return F.col(end) >= F.col(start)


def assign_unique(df: DataFrame, value: str, owner: str, arrival: str, current: str) -> DataFrame:
    """Resolve a unique field: the first owner keeps a value, later ones keep their current one.

    An owner that already holds the value comes first. The winner per value is one
    aggregate row joined back, so a value claimed by very many rows stays spread.
    """
    held = df.where(F.col(current).isNotNull()).groupBy(F.col(current).alias(value)).agg(
        F.min(owner).alias("_holder")
    )
    first = df.where(F.col(value).isNotNull()).groupBy(value).agg(
        F.min_by(owner, F.struct(arrival, owner)).alias("_first")
    )
    winner = first.join(held, value, "left").select(value, F.coalesce("_holder", "_first").alias("_winner"))
    return (
        df.join(winner, value, "left")
        .withColumn("assigned", F.when(F.col("_winner") == F.col(owner), F.col(value)).otherwise(F.col(current)))
        .drop("_winner")
    )


def _finding(df: DataFrame, entity: str, id_col: str, kinds: list[tuple[Column, str, str, str]]) -> DataFrame:
    """Findings of one pass: every kind whose condition holds yields one row."""
    hits = F.array_compact(
        F.array(*[
            F.when(cond, F.struct(F.lit(kind).alias("finding_type"), F.lit(conf).alias("confidence"),
                                  F.lit(msg).alias("message")))
            for cond, kind, conf, msg in kinds
        ])
    )
    return df.select(F.col(id_col).cast("string").alias("entity_id"), F.explode(hits).alias("f")).select(
        F.lit(entity).alias("entity_type"), "entity_id", "f.finding_type", "f.confidence", "f.message"
    )


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def publication_anomalies(df: DataFrame, id_col: str = "publication_id") -> DataFrame:
    """Incomplete records (no DOI, no source id, no year) and malformed DOIs."""
    return _finding(df, "publication", id_col, [
        (_blank("doi") & _blank("openaire_id") & F.col("publication_year").isNull(),
         "incomplete_record", fv.MANUAL_REVIEW_NEEDED, fv.MESSAGES["publication_incomplete"]),
        (~_blank("doi") & ~is_valid_doi(F.col("doi")),
         "malformed_identifier", fv.MANUAL_REVIEW_NEEDED, fv.MESSAGES["publication_doi"]),
    ])


def researcher_anomalies(df: DataFrame, id_col: str = "researcher_id") -> DataFrame:
    """Malformed ORCIDs and names of fewer than two tokens."""
    return _finding(df, "researcher", id_col, [
        (~_blank("orcid") & ~is_valid_orcid(F.col("orcid")),
         "malformed_identifier", fv.MANUAL_REVIEW_NEEDED, fv.MESSAGES["researcher_orcid"]),
        (token_count(F.coalesce("normalized_name", F.lit(""))) < 2,
         "incomplete_record", fv.POSSIBLE_MATCH, fv.MESSAGES["researcher_name"]),
    ])


def organization_anomalies(df: DataFrame, id_col: str = "organization_id") -> DataFrame:
    """Malformed ROR ids and blank names."""
    return _finding(df, "organization", id_col, [
        (~_blank("ror_id") & ~is_valid_ror(F.col("ror_id")),
         "malformed_identifier", fv.MANUAL_REVIEW_NEEDED, fv.MESSAGES["organization_ror"]),
        (_blank("normalized_name"),
         "incomplete_record", fv.MANUAL_REVIEW_NEEDED, fv.MESSAGES["organization_name"]),
    ])


def list_findings(df: DataFrame, limit: int = 100, **filters) -> DataFrame:
    """Findings filtered by any column, newest first."""
    if limit < 1:
        raise ValueError("limit must be positive")
    for name, value in filters.items():
        df = df.where(F.col(name) == F.lit(value))
    return df.orderBy(F.desc("created_at"), "entity_id").limit(limit)


def run_summary(changed: Mapping[str, DataFrame], findings: DataFrame) -> DataFrame:
    """One row of run counters: changed rows per table, merges and findings per entity.

    Candidates found by an exact identifier are listed as findings but not counted
    in `findings_count`; `identifier_findings` counts them.
    """
    entities = ("publication", "researcher", "organization")
    totals = findings.agg(
        *[F.count_if(F.col("auto_applied") & (F.col("entity_type") == e)).alias(f"auto_merged_{e}s") for e in entities],
        F.count_if(~F.col("by_identifier")).alias("findings_count"),
        F.count_if(F.col("by_identifier")).alias("identifier_findings"),
    )
    return totals.withColumns({
        f"normalized_{e}s": changed[e].agg(F.count_if("changed")).scalar() if e in changed else F.lit(0).cast("bigint")
        for e in entities
    })
