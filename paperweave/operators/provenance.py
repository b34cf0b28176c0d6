"""Provenance records and the registry of builds and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.functions.payload import canonical_json
from paperweave.operators.grouping import latest_row
from paperweave.session import Rounds

COMPLETED = "completed"
SHARED_KEYS = 1_000_000


def provenance_records(rows: DataFrame, action: str, entity_type: str, id_col: str) -> DataFrame:
    """One source record per written row: action, entity and payload as sorted-key JSON with checksum."""
    body = rows.select(
        F.lit(action).alias("action"), F.lit(entity_type).alias("entity_type"),
        F.col(id_col).cast("string").alias("canonical_entity_id"),
        F.struct(*[F.col(c) for c in sorted(rows.columns)]).alias("payload"),
    )
    body = body.withColumn("raw_payload", canonical_json(body))
    return body.select(
        "entity_type", F.col("canonical_entity_id").alias("source_identifier"), "action", "raw_payload",
        F.sha2("raw_payload", 256).alias("checksum"),
    )


def filter_provenance(records: DataFrame, limit: int = 50, offset: int = 0, canonical_entity_id: str | None = None,
                      **equals) -> DataFrame:
    """Records by any column or by the entity id inside the payload, newest first."""
    if limit < 1:
        raise ValueError("limit must be positive")
    for name, value in equals.items():
        records = records.where(F.col(name) == F.lit(value))
    if canonical_entity_id is not None:
        records = records.where(
            F.get_json_object("raw_payload", "$.canonical_entity_id") == F.lit(canonical_entity_id)
        )
    page = records.orderBy(F.desc("ingested_at"), F.desc("record_id"))
    return (page.offset(offset) if offset else page).limit(limit)


def dedupe_source_records(records: DataFrame, key=("ingestion_run_id", "entity_type", "source_identifier"),
                          arrival: str = "record_id", shared_keys: int = SHARED_KEYS) -> DataFrame:
    """First record per key, with its number of arrivals and whether a later payload differed.

    Hashes of the keys are counted first, so only records whose hash is there more
    than once are sorted and moved; all others are first where they lie. With more
    such hashes than `shared_keys`, all records are aggregated. Rows are sorted for
    it by the hash, as keys begin alike and sorting by long equal beginnings is
    slow; checksums are taken of the rows kept.
    """
    rest = [c for c in records.columns if c not in key]
    digest = F.sha2("raw_payload", 256)

    def first_of_each(rows: DataFrame) -> DataFrame:
        return (
            rows.groupBy(F.xxhash64(*key).alias("_mixed"), *key)
            .agg(
                F.min_by(F.struct(*rest), F.col(arrival)).alias("first"),
                F.count("*").alias("arrivals"),
                (F.min(digest) != F.max(digest)).alias("payload_changed"),
            )
            .select(*key, "first.*", F.sha2("first.raw_payload", 256).alias("checksum"), "arrivals", "payload_changed")
        )

    counted = records.groupBy(F.xxhash64(*key).alias("_mixed")).agg(F.count("*").alias("n"))
    shared, seen = Rounds(records.sparkSession, "records").measure(
        counted.where(F.col("n") > 1).select("_mixed"), keys=F.count("*"))
    if seen["keys"] > shared_keys:
        return first_of_each(records)
    mixed = records.withColumn("_mixed", F.xxhash64(*key))
    kept = lambda c: F.when(F.col(arrival).isNotNull(), F.col(c))  # noqa: E731 - a record that never arrived is nobody's first
    single = mixed.join(shared, "_mixed", "left_anti") if seen["keys"] else records
    alone = single.select(
        *key, *[kept(c).alias(c) for c in rest], F.sha2(kept("raw_payload"), 256).alias("checksum"),
        F.lit(1).cast("bigint").alias("arrivals"), F.when(F.col("raw_payload").isNotNull(), F.lit(False)).alias("payload_changed"))
    if not seen["keys"]:
        return alone
    return alone.unionByName(first_of_each(mixed.join(shared, "_mixed", "left_semi").drop("_mixed")))


def activate_build(registry: DataFrame, build_id) -> DataFrame:
    """Registry in which the build is its type's only active one.

    Only a completed build can be activated: with a failed or unknown one, nothing changes.
    """
    chosen = registry.where((F.col("build_id") == F.lit(build_id)) & (F.col("status") == COMPLETED)).select(
        "graph_type", F.col("build_id").alias("_active")
    ).limit(1)
    return registry.join(F.broadcast(chosen), "graph_type", "left").withColumn(
        "is_active",
        F.when(F.col("_active").isNull(), F.col("is_active")).otherwise(F.col("build_id") == F.col("_active")),
    ).select(*registry.columns)


def active_build(registry: DataFrame) -> DataFrame:
    """Per graph type the newest completed build, active ones first."""
    done = registry.where(F.col("status") == COMPLETED)
    return latest_row(done, ["graph_type"], [F.desc("is_active"), F.desc("started_at"), F.desc("build_id")])


def ingestion_status(counts: DataFrame, runs: DataFrame, source: str | None = None) -> DataFrame:
    """Table counts beside the status and start of the latest run."""
    if source is not None:
        runs = runs.where(F.col("source") == source)
    last = runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)
    return counts.withColumns({
        "last_run_id": last.select("run_id").scalar(), "last_run_status": last.select("status").scalar(),
    })
