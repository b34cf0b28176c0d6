"""From raw records to canonical tables: mapping, matching, upserts, links."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.functions import payload as px
from paperweave.functions.text import clip_text, first_nonblank, nonblank, normalize_text, strip
from paperweave.operators.components import connected_components
from paperweave.operators.grouping import top_k_per_key
from paperweave.operators.provenance import SHARED_KEYS, provenance_records
from paperweave.operators.quality import assign_unique
from paperweave.session import Rounds

# mapping jobs ----------------------------------------------------------------------


def map_publications(raw: DataFrame) -> DataFrame:
    """Raw publication records as canonical columns; authors and ids stay as arrays."""
    get = lambda name: px.field(raw, name)
    titles = [get(n)[0] for n in ("maintitle", "mainTitle", "title") if n in raw.columns]
    title = F.coalesce(first_nonblank(*titles) if titles else F.lit(None), F.lit("Untitled"))
    published = px.parse_iso_date(nonblank(get("publicationdate")[0]))
    kept = [c for c in ("arrival", "source_record_id", "author", "pid", "originalId", "organizations") if c in raw.columns]
    return raw.select(
        px.payload_identifier(raw).alias("openaire_id"),
        title.alias("title"),
        normalize_text(title).alias("normalized_title"),
        px.first_of(*get("description")).alias("abstract"),
        F.year(published).alias("publication_year"),
        published.alias("publication_date"),
        (px.extract_pid(F.col("pid"), "doi") if "pid" in raw.columns else F.lit(None).cast("string")).alias("doi"),
        clip_text(px.extract_value(*get("type")), 64).alias("publication_type"),
        px.extract_language_code(*get("language")).alias("language_code"),
        clip_text(px.extract_container_name(*get("container")), 255).alias("journal_name"),
        clip_text(px.first_of(*get("source")), 255).alias("venue_name"),
        clip_text(nonblank(get("publisher")[0]), 255).alias("publisher"),
        px.extract_open_access(*get("bestaccessright")).alias("open_access"),
        px.first_from_instances(*get("instance"), "url").alias("source_url"),
        *kept,
    )


def map_organizations(raw: DataFrame) -> DataFrame:
    """Raw organization records as canonical columns.

    The shown name prefers the short name; matching uses the legal name first.
    """
    get = lambda name: px.field(raw, name)[0]
    ident = px.payload_identifier(raw)
    name = first_nonblank(get("legalshortname"), get("legalname"), get("officialname"), ident)
    match = first_nonblank(get("legalname"), get("legalshortname"), get("officialname"))
    kept = [c for c in ("arrival",) if c in raw.columns]
    return raw.select(
        ident.alias("openaire_id"),
        clip_text(name, 255).alias("name"),
        clip_text(normalize_text(clip_text(name, 255)), 255).alias("normalized_name"),
        normalize_text(match).alias("match_name"),
        clip_text(px.extract_value(*px.field(raw, "type")), 64).alias("organization_type"),
        px.extract_country_code(*px.field(raw, "country")).alias("country_code"),
        clip_text(nonblank(get("city")), 120).alias("city"),
        px.first_of(*px.field(raw, "websiteurl")).alias("website"),
        (px.extract_pid(F.col("pid"), "ror") if "pid" in raw.columns else F.lit(None).cast("string")).alias("ror_id"),
        *kept,
    )


def _relation_kind(raw: DataFrame) -> list[Column]:
    """Type, side types and the affiliation flag of raw relation records."""
    reltype = px.field(raw, "reltype")
    return [
        px.relation_type(*reltype).alias("relation_type"),
        px.side_type(*px.field(raw, "sourceType")).alias("source_type"),
        px.side_type(*px.field(raw, "targetType")).alias("target_type"),
        px.is_affiliation_relation(*reltype).alias("is_affiliation"),
    ]


def map_relations(raw: DataFrame) -> DataFrame:
    """Raw relation records: ends, type, side types and the affiliation flag."""
    kept = [c for c in ("arrival",) if c in raw.columns]
    return raw.select("source", "target", *_relation_kind(raw), *kept)


def explode_authors(publications: DataFrame, key: str = "openaire_id") -> DataFrame:
    """One row per named author of a mapped publication, in list order."""
    carried = [c for c in ("arrival",) if c in publications.columns]
    rows = publications.select(key, *carried, F.posexplode("author").alias("author_index", "a"))
    fields = rows.schema["a"].dataType.names

    def part(*names: str) -> Column:
        present = [F.col("a")[n] for n in names if n in fields]
        return first_nonblank(*present) if present else F.lit(None).cast("string")

    full = part("fullname", "fullName")
    orcid = px.extract_nested_pid(F.col("a.pid"), "orcid") if "pid" in fields else F.lit(None).cast("string")
    return rows.select(
        key, *carried, "author_index",
        clip_text(full, 255).alias("full_name"),
        clip_text(part("name"), 120).alias("given_name"),
        clip_text(part("surname"), 120).alias("family_name"),
        clip_text(normalize_text(full), 255).alias("normalized_name"),
        orcid.alias("orcid"),
        (px.parse_position(F.col("a.rank")) if "rank" in fields else F.lit(None).cast("int")).alias("rank"),
    ).where(F.col("full_name").isNotNull())


# matching and upserts ----------------------------------------------------------------


def cascade_match(batch: DataFrame, existing: DataFrame, keys: Sequence[Sequence[str] | str], id_col: str,
                  stored: Mapping[str, str] | None = None) -> DataFrame:
    """Batch rows with `matched_id` and `match_rank` from the first key that finds an existing entity.

    Each key (a column, or several) is one left join against the smallest id per
    key value. A key with a null or empty first column matches nothing. `stored`
    names the column of `existing` that a batch column is looked up in, where the
    names differ.
    """
    of = lambda c: (stored or {}).get(c, c)
    out, found = batch, []
    for rank, key in enumerate(keys, start=1):
        cols = [key] if isinstance(key, str) else list(key)
        hit = f"_m{rank}"
        owner = (
            existing.where(F.coalesce(F.col(of(cols[0])).cast("string"), F.lit("")) != "")
            .groupBy(*[F.col(of(c)).alias(f"_k{rank}_{c}") for c in cols]).agg(F.min(id_col).alias(hit))
        )
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{rank}_{c}")) for c in cols])
        out = out.join(owner, on, "left").drop(*[f"_k{rank}_{c}" for c in cols])
        found.append(hit)
    rank_of = F.coalesce(*[F.when(F.col(h).isNotNull(), i) for i, h in enumerate(found, start=1)])
    return out.withColumns({"matched_id": F.coalesce(*found), "match_rank": rank_of}).drop(*found)


def _star_edges(rows: DataFrame, keys: Sequence[Sequence[str]], stored: Mapping[str, str], existing: DataFrame) -> DataFrame:
    """(source, target) from the first arrival that stores a key value to the later rows that look it up.

    A row stands for all arrivals from `arrival` to `last` with its key values.
    Where a key is looked up in another column than its own, a row that finds an
    existing entity does not also tie that entity to the batch.
    """
    parts = []
    for cols in map(list, keys):
        kept = [stored.get(c, c) for c in cols]
        live = rows.where(_filled(cols[0])).select("arrival", "last", *cols)
        head = (
            rows.where(_filled(kept[0]))
            .groupBy(*[F.col(k).alias(c) for k, c in zip(kept, cols)])
            .agg(F.min("arrival").alias("head"), F.count("*").alias("n"))
        )
        if kept == cols:
            head = head.where(F.col("n") > 1)
        else:
            old = existing.select(*[F.col(k).alias(c) for k, c in zip(kept, cols)]).distinct()
            live = live.join(old, cols, "left_anti")
        on = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"h.{c}")) for c in cols])
        parts.append(
            live.alias("l").join(head.alias("h"), on).where(F.col("last") > F.col("head")).select(
                F.col("head").alias("source"), F.col("arrival").alias("target")
            )
        )
    return reduce(DataFrame.unionByName, parts).distinct()


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) != ""


def assign_entities(existing: DataFrame, batch: DataFrame, id_col: str, keys: Sequence[Sequence[str]],
                    namespace: str, stored: Mapping[str, str] | None = None, rounds: Rounds | None = None) -> DataFrame:
    """Every batch row with its entity id and is_new.

    A row belongs to the existing entity its first matching key finds; failing
    that, to the entity of the batch rows it shares a key with, directly or through
    others; failing that, it founds a new entity whose id is a stable hash of the
    founding row's first key value. `stored` is as in `cascade_match`.

    Rows with the same values in all key columns have one fate, so only the
    distinct values are matched and linked: a name on a third of all rows is one
    row there. Rows that could only be tied through a stored column are kept apart.
    The result reads tables in `rounds`.
    """
    stored = stored or {}
    cols = list(dict.fromkeys([*(c for key in keys for c in key), *stored.values()]))
    rounds = rounds or Rounds(batch.sparkSession, "entities")
    own = [_filled(key[0]) for key in keys if not any(c in stored for c in key)]
    tied = reduce(lambda a, b: a | b, own, F.lit(False))
    every = batch.withColumn("lone", F.when(~tied, F.col("arrival")))
    rows = rounds.cut(every.groupBy(*cols, "lone").agg(F.min("arrival").alias("arrival"), F.max("arrival").alias("last")))
    matched = cascade_match(rows, existing, keys, id_col, stored)
    groups = connected_components(rows.select(F.col("arrival").alias("id")), _star_edges(rows, keys, stored, existing)).select(
        F.col("id").alias("arrival"), F.col("component_id").alias("root")
    )
    tagged = rounds.cut(matched.join(groups, "arrival"))
    rounds.drop(rows)
    names = [F.concat_ws("|", *[F.col(c).cast("string") for c in key]) for key in keys]
    first_key = F.coalesce(*[F.nullif(n, F.lit("")) for n in names], F.col("arrival").cast("string"))
    per_root = tagged.groupBy("root").agg(
        F.min_by("matched_id", F.when(F.col("matched_id").isNotNull(), F.struct("match_rank", "arrival"))).alias("shared"),
        F.min_by(first_key, "arrival").alias("founder"),
    )
    new_id = px.uuid5_url(F.concat(F.lit(f"{namespace}:"), F.col("founder")))
    found = rounds.cut(tagged.join(per_root, "root").select(
        *cols, "lone",
        F.coalesce("matched_id", "shared", new_id).alias(id_col),
        F.coalesce("matched_id", "shared").isNull().alias("is_new"),
    ))
    rounds.drop(tagged)
    on = reduce(lambda a, b: a & b, [F.col(f"e.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*cols, "lone")])
    # rows take their entity along, so nobody looks it up by arrival
    return every.alias("e").join(found.alias("f"), on).select(*[f"e.{c}" for c in batch.columns], f"f.{id_col}", "f.is_new")


def upsert(existing: DataFrame, rows: DataFrame, id_col: str, *,
           overwrite: Sequence[str] = (), first_only: Sequence[str] = (), unique: Sequence[str] = (),
           shared: int = SHARED_KEYS) -> DataFrame:
    """Entity table after a batch whose rows carry the ids of their entities.

    `overwrite` columns take the last arrival's value even when it is null,
    `first_only` columns keep what they have, all others take the last non-null
    value. A `unique` value that another entity already owns is not taken over;
    entities the batch does not touch have no arrival and so come first. Only rows
    of entities with several are aggregated (all, where more than `shared` have).
    """
    cols = [c for c in existing.columns if c != id_col]
    given = [c for c in cols if c in rows.columns]

    def last(c: str) -> Column:
        return F.max_by(c, "arrival") if c in overwrite else F.max_by(c, F.when(F.col(c).isNotNull(), F.col("arrival")))

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("arrival")))

    def folded(some: DataFrame) -> DataFrame:
        return some.groupBy(id_col).agg(
            *[(first(c) if c in first_only else last(c)).alias(f"_n_{c}") for c in given],
            F.min("arrival").alias("_arrival"),
        )

    counted = rows.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("n")).where(F.col("n") > 1).select("_id")
    several, seen = Rounds(rows.sparkSession, "several").measure(counted, ids=F.count("*"))
    if seen["ids"] > shared:
        news = folded(rows)
    else:
        arrived = F.col("arrival").isNotNull()
        same = F.col(id_col).eqNullSafe(F.col("_id"))
        alone = rows.join(several, same, "left_anti") if seen["ids"] else rows
        news = alone.select(id_col, *[F.when(arrived, F.col(c)).alias(f"_n_{c}") for c in given], F.col("arrival").alias("_arrival"))
        if seen["ids"]:
            news = news.unionByName(folded(rows.join(several, same, "left_semi")))

    def merged(c: str) -> Column:
        if c not in given:
            return F.col(c)
        if c in overwrite:
            return F.when(F.col("_arrival").isNotNull(), F.col(f"_n_{c}")).otherwise(F.col(c))
        return F.coalesce(c, f"_n_{c}") if c in first_only else F.coalesce(f"_n_{c}", c)

    out = existing.join(news, id_col, "full").select(
        id_col, *[merged(c).alias(c) for c in cols], *[F.col(c).alias(f"_old_{c}") for c in unique],
        "_arrival",
    )
    for c in unique:
        out = assign_unique(out, c, id_col, "_arrival", f"_old_{c}").drop(c).withColumnRenamed("assigned", c)
    return out.select(*existing.columns)


PUBLICATION_KEYS = (("openaire_id",), ("doi",), ("normalized_title", "publication_year"))
ORGANIZATION_KEYS = (("openaire_id",), ("ror_id",), ("match_name",))
ORGANIZATION_STORED = {"match_name": "normalized_name"}
RESEARCHER_KEYS = (("orcid",), ("normalized_name",))
PUBLICATION_OVERWRITE = ("title", "normalized_title", "publication_date", "publication_year", "open_access",
                         "canonical_source_record_id")


def _assigned(existing: DataFrame, batch: DataFrame, *how) -> DataFrame:
    """Rows of `assign_entities` that have arrived, written once: the table and all that follows read them."""
    rounds = Rounds(batch.sparkSession, "entities")
    rows = assign_entities(existing, batch, *how, rounds=rounds).where(F.col("arrival").isNotNull())
    out = Rounds(batch.sparkSession, "assigned").cut(rows)
    rounds.clear()
    return out


def upsert_publications(existing: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(publication table, batch rows with their publication_id)."""
    assigned = _assigned(existing, batch, "publication_id", PUBLICATION_KEYS, "publication")
    table = upsert(existing, assigned, "publication_id", overwrite=PUBLICATION_OVERWRITE,
                   unique=("doi", "openaire_id"))
    return table, assigned


def upsert_organizations(existing: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(organization table, batch rows with their organization_id).

    A row's `match_name`, the legal name first, is looked up among the stored keys
    of the shown names; without one, its own key is.
    """
    if "match_name" not in batch.columns:
        batch = batch.withColumn("match_name", F.col("normalized_name"))
    assigned = _assigned(existing, batch, "organization_id", ORGANIZATION_KEYS, "organization", ORGANIZATION_STORED)
    return upsert(existing, assigned, "organization_id", unique=("ror_id", "openaire_id")), assigned


def upsert_researchers(existing: DataFrame, authors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(researcher table, authors with their researcher_id) from exploded authors; known names are kept."""
    batch = authors.withColumn("display_name", F.col("full_name"))
    assigned = _assigned(existing, batch, "researcher_id", RESEARCHER_KEYS, "researcher")
    keep = ("full_name", "given_name", "family_name", "normalized_name", "display_name")
    return upsert(existing, assigned, "researcher_id", first_only=keep, unique=("orcid",)), assigned


def patch_upsert(base: DataFrame, patch: DataFrame, key: str, normalized: Mapping[str, str] | None = None) -> DataFrame:
    """Base rows with the patch's non-null fields; match keys named in `normalized` are recomputed.

    `normalized` maps a match-key column to the text it is made from. Patch rows
    with a new key are added.
    """
    fields = [c for c in base.columns if c != key and c in patch.columns]
    renamed = patch.select(key, *[F.col(c).alias(f"_p_{c}") for c in fields])
    out = base.join(renamed, key, "full").select(
        key, *[F.coalesce(f"_p_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns if c != key]
    )
    for target, source in (normalized or {}).items():
        out = out.withColumn(target, normalize_text(F.col(source)))
    return out.select(*base.columns)


def add_links(base: DataFrame, new: DataFrame, unique: Sequence[str],
              parents: Mapping[str, tuple[DataFrame, str]]) -> tuple[DataFrame, DataFrame]:
    """(link table, rejected rows): new links whose parents exist and whose key is free.

    `parents` maps a foreign key column to (parent table, its key column).
    """
    checked = new.withColumn("reason", F.lit(None).cast("string"))
    for fk, (parent, pk) in parents.items():
        known = parent.select(F.col(pk).alias(fk)).distinct().withColumn("_known", F.lit(True))
        checked = checked.join(known, fk, "left").withColumn(
            "reason", F.when(F.col("_known").isNull(), F.coalesce("reason", F.lit(f"missing {fk}"))).otherwise(F.col("reason"))
        ).drop("_known")
    taken = base.select(*unique).distinct().withColumn("_taken", F.lit(True))
    checked = checked.join(taken, list(unique), "left").withColumn(
        "reason", F.coalesce("reason", F.when(F.col("_taken"), F.lit("duplicate key")))
    ).drop("_taken")
    rest = [F.col(c).asc() for c in new.columns if c not in unique]
    accepted = top_k_per_key(checked.where(F.col("reason").isNull()).drop("reason"), list(unique), rest or [F.lit(1)], 1)
    return base.unionByName(accepted, allowMissingColumns=True), checked.where(F.col("reason").isNotNull())


def create_links(base: DataFrame, new: DataFrame, unique: Sequence[str], parents: Mapping[str, tuple[DataFrame, str]],
                 entity_type: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(link table, rejected rows, provenance): `add_links`, with a source record of every link it made."""
    table, rejected = add_links(base, new, unique, parents)
    made = table.join(base.select(*unique), list(unique), "left_anti")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in unique])
    return table, rejected, provenance_records(made.withColumn("link_key", key), "create", entity_type, "link_key")


# links derived from relations --------------------------------------------------------------


def _ends() -> tuple[Column, Column]:
    """Does a mapped relation run from an organization to a publication, and does it run the other way round?"""
    source, target = F.col("source_type"), F.col("target_type")
    return (px.is_organization_type(source) & px.is_publication_type(target),
            px.is_publication_type(source) & px.is_organization_type(target))


def linking(relations: DataFrame) -> DataFrame:
    """The mapped relations between an organization and a publication."""
    org_source, pub_source = _ends()
    return relations.where(org_source | pub_source)


def map_links(raw: DataFrame) -> DataFrame:
    """`linking(map_relations(raw))`, for large tables: what types say is read once for each combination of them, not for each row."""
    types = [c for c in ("reltype", "sourceType", "targetType") if c in raw.columns]
    if not types:
        return linking(map_relations(raw))
    # written, as a filter over them would be pushed below the distinct and read every row's types again
    kinds = Rounds(raw.sparkSession, "kinds").cut(raw.select(*types).distinct())
    known = linking(kinds.select(*[F.col(c).alias(f"_{c}") for c in types], *_relation_kind(kinds)))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in types])
    return raw.join(known, same).select(*linking(map_relations(raw)).columns)


def resolve_relations(relations: DataFrame, organizations: DataFrame, publications: DataFrame) -> DataFrame:
    """(publication_id, organization_id, relation_type, is_affiliation): relations between known ends.

    Mapped relations may run organization -> publication or the other way round;
    both ends are looked up by `openaire_id`.
    """
    org_source = _ends()[0]
    ends = linking(relations).select(
        F.when(org_source, F.col("source")).otherwise(F.col("target")).alias("org_key"),
        F.when(org_source, F.col("target")).otherwise(F.col("source")).alias("pub_key"),
        "relation_type", "is_affiliation",
    )
    orgs = organizations.select("organization_id", F.col("openaire_id").alias("org_key"))
    pubs = publications.select("publication_id", F.col("openaire_id").alias("pub_key"))
    return ends.join(orgs, "org_key").join(pubs, "pub_key").select(
        "publication_id", "organization_id", "relation_type", "is_affiliation"
    )


def publication_org_links(resolved: DataFrame) -> DataFrame:
    """Unique (publication_id, organization_id, relation_type)."""
    return resolved.select("publication_id", "organization_id", "relation_type").distinct()


def affiliations_solo(resolved: DataFrame, authorship: DataFrame) -> DataFrame:
    """(researcher_id, organization_id): affiliation relations of publications with exactly one author."""
    solo = authorship.groupBy("publication_id").agg(
        F.count("*").alias("n"), F.min("researcher_id").alias("researcher_id")
    ).where(F.col("n") == 1)
    links = resolved.where("is_affiliation").select("publication_id", "organization_id").distinct()
    return links.join(solo, "publication_id").select("researcher_id", "organization_id").distinct()


def affiliations_single_org(publication_org: DataFrame, authorship: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(affiliations, ambiguous publications).

    All authors of a publication with exactly one organization belong to it; a
    publication with several is ambiguous.
    """
    per_pub = publication_org.groupBy("publication_id").agg(
        F.min("organization_id").alias("organization_id"), F.max("organization_id").alias("_max")
    )
    single = F.col("organization_id") == F.col("_max")
    linked = per_pub.where(single).join(authorship.select("publication_id", "researcher_id"), "publication_id")
    return (
        linked.select("researcher_id", "organization_id").distinct(),
        per_pub.where(~single).select("publication_id"),
    )


def primary_organization(researcher: DataFrame, affiliation: DataFrame) -> DataFrame:
    """Researchers with affiliations: their only organization becomes primary, several give null."""
    per = affiliation.groupBy("researcher_id").agg(
        F.min("organization_id").alias("lo"), F.max("organization_id").alias("hi")
    )
    return researcher.select("researcher_id").join(per, "researcher_id").select(
        "researcher_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("primary_organization_id")
    )


def refresh_primary(researcher: DataFrame, affiliation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(researcher, affiliation) with the primary organization and `is_primary` flags refreshed."""
    fresh = primary_organization(researcher, affiliation).withColumnsRenamed(
        {"primary_organization_id": "_fresh"}
    ).withColumn("_has", F.lit(True))
    people = researcher.join(fresh, "researcher_id", "left").withColumn(
        "primary_organization_id", F.when(F.col("_has"), F.col("_fresh")).otherwise(F.col("primary_organization_id"))
    ).select(*researcher.columns)
    links = affiliation.join(fresh.drop("_has"), "researcher_id", "left").withColumn(
        "is_primary", F.coalesce(F.col("organization_id") == F.col("_fresh"), F.lit(False))
    ).drop("_fresh")
    return people, links


def external_identifiers(publications: DataFrame) -> DataFrame:
    """(identifier_type, identifier_value, publication_id, is_primary) from pids and original ids.

    `publications`: publication_id, arrival, doi, pid, originalId. The first
    publication to state an identifier owns it.
    """
    pids = publications.select("publication_id", "arrival", "doi", F.explode("pid").alias("p")).select(
        "publication_id", "arrival", "doi",
        strip(F.lower("p.scheme")).alias("identifier_type"), strip(F.col("p.value")).alias("identifier_value"),
    )
    originals = publications.select("publication_id", "arrival", "doi", F.explode("originalId").alias("v")).select(
        "publication_id", "arrival", "doi", F.lit("original_id").alias("identifier_type"),
        strip(F.col("v")).alias("identifier_value"),
    )
    rows = pids.unionByName(originals).where((F.col("identifier_type") != "") & (F.col("identifier_value") != ""))
    owner = rows.groupBy("identifier_type", "identifier_value").agg(
        F.min_by(F.struct("publication_id", "doi"), F.struct("arrival", "publication_id")).alias("o")
    )
    primary = (F.col("identifier_type") == "doi") & F.coalesce(F.col("identifier_value") == F.col("o.doi"), F.lit(False))
    return owner.select("identifier_type", "identifier_value", F.col("o.publication_id").alias("publication_id"),
                        primary.alias("is_primary"))


def link_embedded_orgs(embedded: DataFrame, organization: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(organization table, publication links) from deduplicated embedded organizations.

    Matches or creates the organizations; one without a source id takes the
    embedded id, and links need both a match and an id.
    """
    batch = embedded.select(
        "publication_id",
        F.col("org_id").alias("openaire_id"),
        clip_text(F.coalesce("acronym", "legal_name", "org_id"), 255).alias("name"),
        clip_text(normalize_text(F.coalesce("acronym", "legal_name", "org_id")), 255).alias("normalized_name"),
        clip_text(normalize_text(F.coalesce("legal_name", "acronym", "org_id")), 255).alias("match_name"),
        px.extract_pid(F.col("pids"), "ror").alias("ror_id"),
        F.concat_ws("#", F.col("publication_id").cast("string"), F.col("dedupe_key")).alias("arrival"),
    )
    table, assigned = upsert_organizations(organization, batch)
    table = Rounds(embedded.sparkSession, "embedded").cut(table)
    links = assigned.select("publication_id", "organization_id").join(
        table.where(F.col("openaire_id").isNotNull()).select("organization_id"), "organization_id"
    )
    return table, links.select(
        "publication_id", "organization_id", F.lit("affiliation").alias("relation_type")
    ).distinct()
