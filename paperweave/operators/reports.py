"""Reports over a research-graph dump: relations, results, projects, organizations.

Inputs carry the dump's nested columns (`reltype.name`, `country.code`,
`bestaccessright.label`, `container.name`, `funding[].shortName`,
`subject.scheme/value`). Relations are the big table and one organization,
project or paper may own a third of them, so every report first collapses the
relations to one row per join key with a partial aggregate and only then joins
the entity that carries the label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.operators.grouping import pair_counts


def org_label() -> Column:
    """Short name of an organization, else its legal name."""
    return F.coalesce("legalshortname", "legalname")


def relations_named(relations: DataFrame, name: str) -> DataFrame:
    return relations.where(F.col("reltype.name") == name)


def _ends(relations: DataFrame, name: str, side: str) -> DataFrame:
    """(id, n): number of relations of a kind per entity on one side."""
    return relations_named(relations, name).groupBy(F.col(side).alias("id")).agg(F.count("*").alias("n"))


def relation_counts(relations: DataFrame) -> DataFrame:
    return (
        relations.groupBy(F.col("reltype.name").alias("name"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "name")
    )


def venues(publications: DataFrame) -> DataFrame:
    return publications.where(F.col("container").isNotNull()).select(
        "container.issnLinking", "container.issnOnline", "container.issnPrinted", "container.name"
    )


def citation_counts(publications: DataFrame, relations: DataFrame, direction: str = "in") -> DataFrame:
    """Citations per publication from `IsCitedBy` ("in") or its dual `Cites` ("dual")."""
    name, side = {"in": ("IsCitedBy", "source"), "dual": ("Cites", "target")}[direction]
    ids = publications.select("id", F.col("pid.value").alias("pid"))
    return ids.join(_ends(relations, name, side), "id").select("id", "pid", F.col("n").alias("count")).orderBy(
        F.desc("count"), "id"
    )


def subject_counts(subjects: DataFrame) -> DataFrame:
    return (
        subjects.groupBy(F.col("subject.value").alias("term"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "term")
    )


def journal_counts(publications: DataFrame) -> DataFrame:
    return (
        publications.where(F.col("container").isNotNull())
        .groupBy(F.col("container.name").alias("name"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "name")
    )


def _count_by_org(organizations: DataFrame, ends: DataFrame, label: str) -> DataFrame:
    return (
        organizations.select("id", org_label().alias(label))
        .join(ends, "id")
        .groupBy(label)
        .agg(F.sum("n").alias("count"))
        .orderBy(F.desc("count"), label)
    )


def projects_per_org(organizations: DataFrame, relations: DataFrame) -> DataFrame:
    return _count_by_org(organizations, _ends(relations, "isParticipant", "source"), "name")


def results_per_org(organizations: DataFrame, relations: DataFrame) -> DataFrame:
    return _count_by_org(organizations, _ends(relations, "isAuthorInstitutionOf", "source"), "organization")


def results_per_project(projects: DataFrame, relations: DataFrame, composed: bool = False) -> DataFrame:
    """Results per identified project, keyed by its fields or by one composed label."""
    known = projects.where(~F.col("title").ilike("%unidentified%"))
    counted = known.join(_ends(relations, "produces", "source"), "id")
    if composed:
        short = F.col("funding.shortName")
        label = F.concat_ws(
            " / ",
            F.when(F.size(short) > 0, F.array_join(short, ",", "-")).otherwise("?"),
            F.coalesce("code", F.lit("?")),
            F.substring("title", 1, 50),
        )
        grouped = counted.groupBy(label.alias("project"))
        keys = ["project"]
    else:
        grouped = counted.groupBy(F.col("funding.shortName").alias("shortName"), "code", "title")
        keys = ["code", "title"]
    return grouped.agg(F.sum("n").alias("count")).orderBy(F.desc("count"), *keys)


def subject_cooccurrence(subjects: DataFrame) -> DataFrame:
    """Pairs of controlled-vocabulary subjects on the same publication."""
    controlled = subjects.where(F.col("subject.scheme") != "keyword").select(
        "id", F.col("subject.value").alias("value")
    )
    return pair_counts(controlled, "id", "value").orderBy(F.desc("count"), "left", "right")


def orgs_missing_short_name(organizations: DataFrame) -> DataFrame:
    return organizations.where(F.col("legalshortname").isNull() & F.col("legalname").isNotNull()).select(
        "legalshortname", "legalname"
    )


def _per_source(relations: DataFrame, results: DataFrame, value: Column) -> DataFrame:
    """(id, value, n): results of each kind per authoring organization."""
    links = relations_named(relations, "isAuthorInstitutionOf").select("source", "target")
    kinds = results.select(F.col("id").alias("target"), value.alias("value"))
    return links.join(kinds, "target").groupBy(F.col("source").alias("id"), "value").agg(F.count("*").alias("n"))


def _spread(df: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """Total and one conditional count per listed value, largest total first."""
    return (
        df.groupBy(key)
        .agg(
            F.sum("n").alias("total"),
            *[
                F.coalesce(F.sum(F.when(F.col("value") == value, F.col("n"))), F.lit(0)).cast("bigint").alias(out)
                for out, value in names.items()
            ],
        )
        .orderBy(F.desc("total"), key)
    )


RESULT_TYPES = {"publication": "publication", "dataset": "dataset", "software": "software", "other": "other"}
ACCESS_RIGHTS = {"open": "OPEN", "embargo": "EMBARGO", "closed": "CLOSED"}


def results_by_type_per_org(organizations: DataFrame, relations: DataFrame, results: DataFrame) -> DataFrame:
    counted = _per_source(relations, results, F.col("type"))
    named = organizations.select("id", org_label().alias("organization")).join(counted, "id")
    return _spread(named, "organization", RESULT_TYPES)


def access_per(organizations: DataFrame, relations: DataFrame, results: DataFrame, by: str) -> DataFrame:
    """Access rights per "organization" or per "country" of the authoring organizations."""
    counted = _per_source(relations, results, F.col("bestaccessright.label"))
    if by == "country":
        keyed = organizations.where(F.col("country").isNotNull()).select("id", F.col("country.code").alias("country"))
    else:
        keyed = organizations.select("id", org_label().alias("organization"))
    return _spread(keyed.join(counted, "id"), by, ACCESS_RIGHTS)


def country_network(organizations: DataFrame, relations: DataFrame, strict: bool = False) -> DataFrame:
    """Country pairs of organizations taking part in the same project.

    `strict` keeps international pairs only; otherwise a country also pairs with itself.
    """
    located = organizations.where(F.col("country").isNotNull()).select(
        F.col("id").alias("source"), F.col("country.code").alias("country")
    )
    members = relations_named(relations, "isParticipant").select("source", "target").join(located, "source")
    return pair_counts(members, "target", "country", strict=strict).orderBy(F.desc("count"), "left", "right")


def org_pairs(organizations: DataFrame, relations: DataFrame, rel_name: str) -> DataFrame:
    """Organization name pairs linked to the same project or paper by `rel_name`."""
    named = organizations.select(F.col("id").alias("source"), org_label().alias("organization"))
    members = relations_named(relations, rel_name).select("source", "target").join(named, "source")
    return pair_counts(members, "target", "organization").orderBy(F.desc("count"), "left", "right")


def access_by_year(results: DataFrame) -> DataFrame:
    return (
        results.where(F.col("bestaccessright").isNotNull() & F.col("publicationdate").isNotNull())
        .groupBy(
            F.col("bestaccessright.label").alias("accessright"),
            F.substring("publicationdate", 1, 4).alias("year"),
        )
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "accessright", "year")
    )


def supplemented_count(relations: DataFrame, publications: DataFrame, datasets: DataFrame) -> DataFrame:
    """Number of publication-to-dataset supplement relations."""
    links = relations_named(relations, "IsSupplementedBy").select("source", "target")
    return (
        links.join(publications.select(F.col("id").alias("source")), "source")
        .join(datasets.select(F.col("id").alias("target")), "target")
        .agg(F.count("*").alias("count"))
    )
