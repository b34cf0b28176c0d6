"""The full load: raw records to canonical tables, set by set."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.functions import payload as px
from paperweave.functions.text import nonblank, normalize_text
from paperweave.operators import attribution, ingest
from paperweave.operators.catalog import table_counts
from paperweave.operators.positions import assign_author_positions
from paperweave.operators.provenance import dedupe_source_records
from paperweave.session import Rounds, drop_round, no_rows

TABLES = {
    "publication": "publication_id string, title string, normalized_title string, abstract string, "
                   "publication_year int, publication_date date, doi string, openaire_id string, "
                   "publication_type string, language_code string, journal_name string, venue_name string, "
                   "publisher string, open_access boolean, source_url string, canonical_source_record_id string",
    "organization": "organization_id string, name string, normalized_name string, organization_type string, "
                    "country_code string, city string, website string, ror_id string, openaire_id string",
    "researcher": "researcher_id string, full_name string, given_name string, family_name string, "
                  "normalized_name string, display_name string, orcid string, primary_organization_id string",
    "publication_author": "publication_id string, researcher_id string, author_position int",
    "publication_organization": "publication_id string, organization_id string, relation_type string",
    "researcher_affiliation": "researcher_id string, organization_id string, is_primary boolean",
    "external_identifier": "identifier_type string, identifier_value string, publication_id string, is_primary boolean",
    "source_record": "record_id string, ingestion_run_id string, entity_type string, source_identifier string, "
                     "raw_payload string, checksum string",
}
TABLE_KEYS = {
    "publication": ["publication_id"], "organization": ["organization_id"], "researcher": ["researcher_id"],
    "publication_author": ["publication_id", "researcher_id"],
    "publication_organization": ["publication_id", "organization_id", "relation_type"],
    "researcher_affiliation": ["researcher_id", "organization_id"],
    "external_identifier": ["identifier_type", "identifier_value"],
    "source_record": ["record_id"],
}
RECORD_KEY = ["ingestion_run_id", "entity_type", "source_identifier"]
KINDS = {"datasources": "datasource", "organizations": "organization", "publications": "publication",
         "projects": "project", "relations": "relation"}


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: no_rows(spark, schema) for name, schema in TABLES.items()}


def _new_links(old: DataFrame, new: DataFrame, unique: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*unique), unique, "left_anti"), allowMissingColumns=True)


def _record_id(run: str, kind: str, identifier: Column) -> Column:
    return px.uuid5_url(F.concat(F.lit(f"source_record:{run}:{kind}:"), identifier))


def source_records(raw: DataFrame, kind: str, run: str) -> DataFrame:
    """A source record per raw payload: who sent what, as sorted-key JSON."""
    ident = px.payload_identifier(raw)
    payload = px.canonical_json(raw, [c for c in raw.columns if c != "arrival"])
    return raw.select(
        _record_id(run, kind, ident).alias("record_id"), F.lit(run).alias("ingestion_run_id"),
        F.lit(kind).alias("entity_type"), ident.alias("source_identifier"), payload.alias("raw_payload"),
        (F.col("arrival") if "arrival" in raw.columns else F.lit(0)).cast("decimal(32,0)").alias("arrival"),
    )


def embedded_records(known: DataFrame, run: str) -> DataFrame:
    """Source records of the organizations inside publication records."""
    orgs = known.select("arrival", F.explode("organizations").alias("o"))
    shown = [F.col("o.legalName"), F.col("o.acronym")]
    ident = px.organization_identifier(F.col("o.id"), F.col("o.pids"), shown, normalize_text(F.coalesce(*map(nonblank, shown))))
    return orgs.select(
        _record_id(run, "organization", ident).alias("record_id"), F.lit(run).alias("ingestion_run_id"),
        F.lit("organization").alias("entity_type"), ident.alias("source_identifier"),
        F.to_json("o").alias("raw_payload"),
        F.col("arrival").cast("decimal(32,0)").alias("arrival"),
    ).where(F.col("source_identifier").isNotNull())


def stage_counts(inputs: Mapping[str, DataFrame], tables: Mapping[str, DataFrame]) -> DataFrame:
    """(stage, records): raw records per input, and publications whose several organizations leave affiliations open."""
    counted = [
        inputs[name].agg(F.lit(f"{kind}_records").alias("stage"), F.count("*").alias("records"))
        for name, kind in KINDS.items() if name in inputs
    ]
    open_ = ingest.affiliations_single_org(tables["publication_organization"], tables["publication_author"])[1]
    counted.append(open_.agg(F.lit("ambiguous_publications").alias("stage"), F.count("*").alias("records")))
    return reduce(DataFrame.unionByName, counted)


def run_load(spark: SparkSession, inputs: Mapping[str, DataFrame], tables: Mapping[str, DataFrame] | None = None,
             rule: str = "solo", run: str = "load", aliases: DataFrame | None = None, waiting: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(canonical tables, row-count change per table) after loading raw inputs.

    `inputs` holds raw `datasources`, `organizations`, `publications`, `projects`
    and `relations`, each with a unique long `arrival`; any may be missing. Every
    payload leaves a source record under the `run`; organizations inside a
    publication record are matched or created and linked to it, told apart with
    the alias dictionary. `rule` decides affiliations: "solo" (single-author
    publications with an affiliation relation) or "single_org" (publications with
    one organization). `waiting` are mapped relations of earlier loads that are
    tried again; they leave no source records. Every stage is written once, so later stages read tables
    instead of replaying earlier ones.
    """
    rounds = Rounds(spark, "load")
    before = dict(tables) if tables is not None else empty_tables(spark)
    out = dict(before)
    records = [source_records(inputs[name], kind, run) for name, kind in KINDS.items() if name in inputs]
    if "organizations" in inputs:
        batch = rounds.cut(ingest.map_organizations(inputs["organizations"]))
        out["organization"] = rounds.cut(ingest.upsert_organizations(out["organization"], batch)[0])

    if "publications" in inputs:
        raw = inputs["publications"]
        batch = rounds.cut(ingest.map_publications(raw).withColumn(
            "canonical_source_record_id", _record_id(run, "publication", F.col("openaire_id"))))
        table, known = ingest.upsert_publications(out["publication"], batch)
        rounds.drop(batch)
        out["publication"] = rounds.cut(table)

        authors = ingest.explode_authors(known, "publication_id").withColumnRenamed("arrival", "record_arrival")
        # unique and in reading order for any record number and any author list
        place = F.col("record_arrival").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(11,0)") + F.col("author_index")
        authors = rounds.cut(authors.withColumn("arrival", place.cast("decimal(32,0)")).drop("author_index"))
        people, who = ingest.upsert_researchers(out["researcher"], authors)
        rounds.drop(authors)
        out["researcher"] = rounds.cut(people)
        linked = who.select("publication_id", "researcher_id", "rank", "arrival")
        held = out["publication_author"].select(
            "publication_id", "researcher_id", F.col("author_position").alias("rank"),
            (F.col("author_position").cast("decimal(32,0)") - F.lit(2**40)).cast("decimal(32,0)").alias("arrival"),
        )
        places = rounds.cut(held.unionByName(linked))
        drop_round(who)
        out["publication_author"] = rounds.cut(assign_author_positions(places))
        rounds.drop(places)

        dois = out["publication"].select("publication_id", "doi")
        named = known.select("publication_id", "arrival", "pid", "originalId").join(dois, "publication_id")
        out["external_identifier"] = rounds.cut(
            _new_links(out["external_identifier"], ingest.external_identifiers(named),
                       ["identifier_type", "identifier_value"])
        )

        if "organizations" in batch.columns:
            embedded = attribution.dedupe_embedded_orgs(
                known.select("publication_id", "organizations"), aliases or attribution.alliance_aliases(spark))
            embedded = rounds.cut(embedded)
            table, links = ingest.link_embedded_orgs(embedded, out["organization"])
            out["organization"] = table
            out["publication_organization"] = rounds.cut(
                _new_links(out["publication_organization"], links, ["publication_id", "organization_id", "relation_type"]))
            rounds.drop(embedded)
            records.append(embedded_records(known, run))

    if waiting is not None or "relations" in inputs or "publications" in inputs:
        resolved = None
        # only what can be resolved
        mapped = [ingest.map_links(inputs["relations"]).drop("arrival")] if "relations" in inputs else []
        mapped += [waiting] if waiting is not None else []
        if mapped:
            resolved = rounds.cut(ingest.resolve_relations(
                reduce(DataFrame.unionByName, mapped), out["organization"], out["publication"]))
            links, held = ingest.publication_org_links(resolved), out["publication_organization"]
            out["publication_organization"] = rounds.cut(
                _new_links(held, links, ["publication_id", "organization_id", "relation_type"]))
            rounds.drop(held)
        if rule == "solo":
            resolved = resolved if resolved is not None else no_rows(
                spark, "publication_id string, organization_id string, relation_type string, is_affiliation boolean")
            found = ingest.affiliations_solo(resolved, out["publication_author"])
        else:
            found = ingest.affiliations_single_org(out["publication_organization"], out["publication_author"])[0]
        affiliation = _new_links(out["researcher_affiliation"], found, ["researcher_id", "organization_id"])
        affiliation = rounds.cut(affiliation)
        known_people = out["researcher"]
        people, flagged = ingest.refresh_primary(known_people, affiliation)
        out["researcher"] = rounds.cut(people)
        out["researcher_affiliation"] = rounds.cut(flagged)
        rounds.drop(known_people)
        rounds.drop(affiliation)
        if resolved is not None:
            rounds.drop(resolved)

    if records:
        # a record's id follows from its key, so it is made of the rows kept
        fresh = dedupe_source_records(reduce(DataFrame.unionByName, [r.drop("record_id") for r in records]), RECORD_KEY, "arrival")
        fresh = fresh.withColumn("record_id", px.uuid5_url(F.concat(
            F.lit("source_record:"), "ingestion_run_id", F.lit(":"), "entity_type", F.lit(":"), "source_identifier")))
        out["source_record"] = rounds.cut(_new_links(
            out["source_record"], fresh.select(*[c.split()[0] for c in TABLES["source_record"].split(", ")]), RECORD_KEY))

    old, new = table_counts(before), table_counts(out)
    delta = old.withColumnRenamed("row_count", "rows_before").join(
        new.withColumnRenamed("row_count", "rows_after"), "table_name"
    ).withColumn("delta", F.col("rows_after") - F.col("rows_before"))
    return out, delta
