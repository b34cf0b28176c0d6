"""Entity resolution: normalization, duplicate candidates, merging.

Candidates of a group are compared with its oldest member only, never with each
other, so a group of n copies yields n - 1 rows. The target of a group is one
partial aggregate joined back to the rows; the hot side of that join is the row
side, which adaptive execution splits. All candidates are tested in one pass,
against the target as the older copies would have grown it, and chains of merges
are resolved afterwards.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.functions import fixed_values as fv
from paperweave.functions.text import clean_text, normalize_text
from paperweave.operators.components import connected_components
from paperweave.operators.grouping import member_overlap, top_k_per_key
from paperweave.session import Rounds, partitions_for


@dataclass(frozen=True)
class NormalizeSpec:
    """Which columns a normalization pass cleans."""

    required: str
    normalized: str
    optional: tuple[str, ...] = ()


PUBLICATIONS = NormalizeSpec("title", "normalized_title", ("journal_name", "venue_name"))
RESEARCHERS = NormalizeSpec("full_name", "normalized_name", ("display_name",))
ORGANIZATIONS = NormalizeSpec("name", "normalized_name", ("city",))


def normalize_table(df: DataFrame, spec: NormalizeSpec) -> DataFrame:
    """Clean the text columns, recompute the match key, flag rows that changed.

    A required text that cleans to nothing keeps its old value.
    """
    present = [c for c in spec.optional if c in df.columns]
    df = df.withColumns({f"_c_{c}": clean_text(F.col(c)) for c in (spec.required, *present)})
    df = df.withColumn("_key", normalize_text(F.col(f"_c_{spec.required}")))
    old_key = F.col(spec.normalized) if spec.normalized in df.columns else F.lit(None).cast("string")
    same = [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in (spec.required, *present)]
    changed = ~reduce(lambda a, b: a & b, same + [old_key.eqNullSafe(F.col("_key"))])
    return df.withColumns({
        "changed": changed,
        spec.required: F.coalesce(f"_c_{spec.required}", spec.required),
        spec.normalized: F.col("_key"),
        **{c: F.col(f"_c_{c}") for c in present},
    }).drop("_key", *[f"_c_{c}" for c in (spec.required, *present)])


def star_candidates(df: DataFrame, keys: Sequence[str], id_col: str, created: str,
                    compare: Sequence[str] = ()) -> DataFrame:
    """(keys..., entity_id, candidate_entity_id, candidate_created, t_<c>, c_<c>...): each copy against its group's oldest row.

    Null-safe on every key but the first, which must be non-empty.
    """
    rows = df.where(F.coalesce(F.col(keys[0]).cast("string"), F.lit("")) != "")
    carried = [F.col(c).alias(f"t_{c}") for c in compare]
    first = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min_by(F.struct(F.col(id_col).alias("entity_id"), *carried), F.struct(created, id_col)).alias("t"),
    ).where(F.col("n") > 1)
    on = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys])
    return (
        rows.alias("r").join(first.alias("g"), on)
        .where(F.col(f"r.{id_col}") != F.col("g.t.entity_id"))
        .select(
            *[F.col(f"r.{k}").alias(k) for k in keys],
            F.col("g.t.entity_id").alias("entity_id"),
            F.col(f"r.{id_col}").alias("candidate_entity_id"),
            F.col(f"r.{created}").alias("candidate_created"),
            *[F.col(f"g.t.t_{c}").alias(f"t_{c}") for c in compare],
            *[F.col(f"r.{c}").alias(f"c_{c}") for c in compare],
        )
    )


PAIR = ["entity_id", "candidate_entity_id"]


def _clashes(candidates: DataFrame, links: DataFrame, entity: str, place: str, value: str) -> DataFrame:
    """Candidate pairs that would put a second value in one place of the grown target.

    The target claims its places first, then the copies by age. A copy that holds
    another value than the oldest claimant of a place, or several, must not be
    merged; so whatever is merged leaves one value per place.
    """
    links = links.select(F.col(entity).alias("claimant"), place, value)
    age = F.col("candidate_created") if "candidate_created" in candidates.columns else F.lit(0)
    copies = candidates.select("entity_id", F.col("candidate_entity_id").alias("claimant"),
                               F.struct(F.lit(1).alias("later"), age.alias("created"), F.col("candidate_entity_id").alias("id")).alias("age"))
    targets = candidates.select("entity_id").distinct().select(
        "entity_id", F.col("entity_id").alias("claimant"),
        F.struct(F.lit(0).alias("later"), F.lit(None).cast(copies.schema["age"].dataType["created"].dataType).alias("created"),
                 F.col("entity_id").alias("id")).alias("age"))
    claims = (
        copies.unionByName(targets).join(links, "claimant")
        .groupBy("entity_id", place, "claimant", "age").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    )
    oldest = claims.groupBy("entity_id", place).agg(F.min_by(F.struct("claimant", "lo", "hi"), "age").alias("o"))
    agree = (F.col("lo") == F.col("hi")) & (F.col("o.lo") == F.col("o.hi")) & (F.col("lo") == F.col("o.lo"))
    return (
        claims.where(F.col("age.later") == 1).join(oldest, ["entity_id", place])
        .where((F.col("claimant") != F.col("o.claimant")) & ~agree)
        .select("entity_id", F.col("claimant").alias("candidate_entity_id")).distinct()
    )


def unsafe_publications(candidates: DataFrame, authorship: DataFrame) -> DataFrame:
    """Candidate pairs in which an author position is held by another researcher than in the target or an older copy."""
    return _clashes(candidates, authorship, "publication_id", "author_position", "researcher_id")


def unsafe_researchers(candidates: DataFrame, authorship: DataFrame) -> DataFrame:
    """Candidate pairs that hold a publication at another position than the target or an older copy."""
    return _clashes(candidates, authorship, "researcher_id", "publication_id", "author_position")


def with_safety(candidates: DataFrame, unsafe: DataFrame | None) -> DataFrame:
    """Add `mergeable`."""
    if unsafe is None:
        return candidates.withColumn("mergeable", F.lit(True))
    return candidates.join(unsafe.withColumn("_unsafe", F.lit(True)), PAIR, "left").withColumn(
        "mergeable", F.col("_unsafe").isNull()
    ).drop("_unsafe")


def exact_duplicates(df: DataFrame, identifier: str, id_col: str, created: str = "created_at",
                     authorship: DataFrame | None = None, entity: str = "publication") -> DataFrame:
    """Candidates sharing an identifier; unsafe ones need manual review."""
    pairs = star_candidates(df, [identifier], id_col, created)
    finder = {"publication": unsafe_publications, "researcher": unsafe_researchers}.get(entity)
    unsafe = finder(pairs, authorship) if finder and authorship is not None else None
    return with_safety(pairs, unsafe).select(
        F.lit(entity).alias("entity_type"), *PAIR, F.col(identifier).alias("identifier_value"),
        F.when(F.col("mergeable"), fv.EXACT_MATCH).otherwise(fv.MANUAL_REVIEW_NEEDED).alias("confidence"),
        F.col("mergeable").alias("auto_applied"),
    )


IDENTIFIERS = {
    "publication": ("publication_id", ("doi", "openaire_id")),
    "researcher": ("researcher_id", ("orcid",)),
    "organization": ("organization_id", ("ror_id", "openaire_id")),
}


def identifier_duplicates(tables: Mapping[str, DataFrame], authorship: DataFrame, created: str = "created_at") -> DataFrame:
    """Exact candidates of every entity table present, by its identifiers in order.

    A pair that an earlier identifier has found is not listed again.
    """
    out = []
    for entity, df in tables.items():
        id_col, names = IDENTIFIERS[entity]
        found = [
            exact_duplicates(df, name, id_col, created, authorship, entity).withColumns(
                {"identifier": F.lit(name), "place": F.lit(place)}
            )
            for place, name in enumerate(names) if name in df.columns
        ]
        first = top_k_per_key(reduce(DataFrame.unionByName, found), PAIR, [F.col("place")], 1).drop("place")
        out.append(first.withColumns({c: F.col(c).cast("string") for c in PAIR}))
    return reduce(DataFrame.unionByName, out)


def publication_candidates(publication: DataFrame, authorship: DataFrame, author_names: DataFrame,
                           created: str = "created_at") -> DataFrame:
    """Publications with the same normalized title and year as an older one.

    Strong when the venue agrees (two blank venues do) or an author name is
    shared; strong and merge-safe pairs are marked for automatic merging.
    `author_names` is (publication_id, normalized_name).
    """
    venue = normalize_text(F.coalesce(F.nullif(F.col("journal_name"), F.lit("")), F.col("venue_name")))
    rows = publication.withColumn("_venue", venue)
    rounds = Rounds(publication.sparkSession, "candidates")
    pairs = rounds.cut(star_candidates(rows, ["normalized_title", "publication_year"], "publication_id", created, ["_venue"]))
    named = member_overlap(
        author_names, pairs.withColumnsRenamed({"entity_id": "left", "candidate_entity_id": "right"}),
        "publication_id", "normalized_name",
    ).withColumnsRenamed({"left": "entity_id", "right": "candidate_entity_id", "overlap": "author_overlap"})
    venue_match = F.col("t__venue") == F.col("c__venue")
    strong = venue_match | (F.col("author_overlap") > 0)
    return with_safety(named, unsafe_publications(pairs, authorship)).select(
        *PAIR, venue_match.alias("venue_match"), "author_overlap",
        F.when(strong, fv.STRONG_MATCH).otherwise(fv.POSSIBLE_MATCH).alias("confidence"),
        (strong & F.col("mergeable")).alias("auto_applied"),
    )


def researcher_candidates(researcher: DataFrame, authorship: DataFrame, created: str = "created_at") -> DataFrame:
    """Researchers with the normalized name of an older one.

    Strong when the primary organization agrees or a publication is shared;
    merged only when the organization agrees and the pair is merge-safe.
    """
    rounds = Rounds(researcher.sparkSession, "candidates")
    pairs = rounds.cut(
        star_candidates(researcher, ["normalized_name"], "researcher_id", created, ["primary_organization_id"])
    )
    links = authorship.select("researcher_id", "publication_id", "author_position")
    with partitions_for(rounds.spark, links.count()) as count:
        # rows are dealt before they are grouped: a partial aggregate over a scan would hold the keys of a whole input split
        links = links.repartition(count, "researcher_id", "publication_id")
        shared = member_overlap(
            links, pairs.withColumnsRenamed({"entity_id": "left", "candidate_entity_id": "right"}),
            "researcher_id", "publication_id",
        ).withColumnsRenamed({"left": "entity_id", "right": "candidate_entity_id", "overlap": "shared_publications"})
        same_org = F.coalesce(F.col("t_primary_organization_id") == F.col("c_primary_organization_id"), F.lit(False))
        strong = same_org | (F.col("shared_publications") > 0)
        found = with_safety(shared, unsafe_researchers(pairs, links)).select(
            *PAIR, same_org.alias("same_primary_organization"), "shared_publications",
            F.when(strong, fv.STRONG_MATCH).otherwise(fv.POSSIBLE_MATCH).alias("confidence"),
            (same_org & F.col("mergeable")).alias("auto_applied"),
        )
        return rounds.cut(found)


def organization_candidates(organization: DataFrame, created: str = "created_at") -> DataFrame:
    """Organizations with the normalized name of an older one.

    Strong, and merged, when the parent agrees (two missing parents do) or city
    and country agree.
    """
    rows = organization.withColumn("_city", normalize_text(F.col("city")))
    pairs = star_candidates(rows, ["normalized_name"], "organization_id", created,
                            ["parent_organization_id", "_city", "country_code"])
    same_parent = F.col("t_parent_organization_id").eqNullSafe(F.col("c_parent_organization_id"))
    same_place = (F.col("t__city") == F.col("c__city")) & F.col("t_country_code").eqNullSafe(F.col("c_country_code"))
    strong = same_parent | same_place
    return pairs.select(
        *PAIR, same_parent.alias("same_parent"), same_place.alias("same_location"),
        F.when(strong, fv.STRONG_MATCH).otherwise(fv.POSSIBLE_MATCH).alias("confidence"),
        strong.alias("auto_applied"),
    )


def duplicate_clusters(candidates: DataFrame, entities: DataFrame, id_col: str, created: str = "created_at") -> DataFrame:
    """(loser, survivor): merge chains resolved to the oldest row of their cluster.

    Pairs that are not `mergeable`, where the candidates say so, join nothing.
    """
    if "mergeable" in candidates.columns:
        candidates = candidates.where("mergeable")
    edges = candidates.select(
        F.least(*PAIR).alias("source"), F.greatest(*PAIR).alias("target")
    ).distinct()
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    parts = connected_components(nodes, edges).join(entities.select(F.col(id_col).alias("id"), F.col(created).alias("created")), "id")
    oldest = parts.groupBy("component_id").agg(F.min_by("id", F.struct("created", "id")).alias("survivor"))
    return parts.join(oldest, "component_id").where(F.col("id") != F.col("survivor")).select(
        F.col("id").alias("loser"), "survivor"
    )


@dataclass(frozen=True)
class Child:
    """A table whose `fk` points at the merged entity; rows equal in `unique` collapse."""

    fk: str
    unique: tuple[str, ...] = ()
    where: Column | None = field(default=None)


@dataclass(frozen=True)
class MergeSpec:
    table: str
    id_col: str
    fill: tuple[str, ...]
    children: Mapping[str, Child]
    order: str = "created_at"


PUBLICATION_MERGE = MergeSpec(
    "publication", "publication_id",
    ("canonical_source_record_id", "abstract", "publication_year", "publication_date", "journal_name",
     "venue_name", "publisher"),
    {
        "publication_author": Child("publication_id", ("publication_id", "researcher_id")),
        "publication_organization": Child("publication_id", ("publication_id", "organization_id", "relation_type")),
        "publication_embedding": Child(
            "publication_id", ("publication_id", "embedding_provider", "embedding_model", "embedding_version")),
        "external_identifier": Child("entity_id", ("entity_type", "entity_id", "identifier_type", "identifier_value")),
    },
)
RESEARCHER_MERGE = MergeSpec(
    "researcher", "researcher_id", ("display_name", "email", "profile_url", "primary_organization_id"),
    {
        "publication_author": Child("researcher_id", ("publication_id", "researcher_id")),
        "researcher_affiliation": Child("researcher_id"),
        "external_identifier": Child("entity_id", ("entity_type", "entity_id", "identifier_type", "identifier_value")),
    },
)
ORGANIZATION_MERGE = MergeSpec(
    "organization", "organization_id", ("website", "country_code", "city", "parent_organization_id"),
    {
        "researcher": Child("primary_organization_id"),
        "researcher_affiliation": Child("organization_id"),
        "publication_organization": Child("organization_id", ("publication_id", "organization_id", "relation_type")),
        "organization": Child("parent_organization_id"),
        "external_identifier": Child("entity_id", ("entity_type", "entity_id", "identifier_type", "identifier_value")),
    },
)


def merge_entities(tables: Mapping[str, DataFrame], mapping: DataFrame, spec: MergeSpec) -> dict[str, DataFrame]:
    """Apply a resolved (loser, survivor) mapping to an entity table and its children.

    A survivor's missing fields take the first value among its losers by age;
    child rows move to the survivor and those that would repeat a unique key are
    dropped, rows the survivor already had winning; losers disappear.
    """
    out = dict(tables)
    base = tables[spec.table]
    fill = [c for c in spec.fill if c in base.columns]
    order = F.struct(spec.order, spec.id_col)
    losers = base.join(mapping.withColumnRenamed("loser", spec.id_col), spec.id_col)
    if fill:
        donated = losers.groupBy("survivor").agg(
            *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(f"_d_{c}") for c in fill]
        ).withColumnRenamed("survivor", spec.id_col)
        kept = base.join(mapping.select(F.col("loser").alias(spec.id_col)), spec.id_col, "left_anti")
        merged = kept.join(donated, spec.id_col, "left")
        out[spec.table] = merged.select(
            *[F.coalesce(c, f"_d_{c}").alias(c) if c in fill else F.col(c) for c in base.columns]
        )
    else:
        out[spec.table] = base.join(mapping.select(F.col("loser").alias(spec.id_col)), spec.id_col, "left_anti")

    for name, child in spec.children.items():
        if name not in out or child.fk not in out[name].columns:
            continue
        rows = out[name]
        mine = F.lit(True)
        if "entity_type" in rows.columns:
            mine = F.col("entity_type") == spec.table
        moved = rows.join(mapping.withColumnRenamed("loser", child.fk), child.fk, "left").withColumn(
            "_moved", mine & F.col("survivor").isNotNull()
        ).withColumn(child.fk, F.when(F.col("_moved"), F.col("survivor")).otherwise(F.col(child.fk)))
        unique = [c for c in child.unique if c in rows.columns]
        if unique:
            rest = [c for c in rows.columns if c not in unique]
            moved = top_k_per_key(moved, unique, [F.col("_moved").asc(), *[F.col(c) for c in rest]], 1)
        out[name] = moved.select(*rows.columns)
    return out
