"""Graph builds at rest: nodes, edges and summary per build id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.operators.provenance import active_build

PARTS = ("nodes", "edges", "summary")


def write_build(nodes: DataFrame, edges: DataFrame, summary: DataFrame, path: str, build_id: str,
                as_json: bool = False) -> None:
    """Write one build as three partitioned tables (and, on request, as JSON lines).

    A build that is written again replaces its own partitions and no others, so a
    failed writing can be repeated; the summary comes last, and without it there
    is no build to load.
    """
    for name, df in zip(PARTS, (nodes, edges, summary), strict=True):
        tagged = df.withColumn("build_id", F.lit(build_id))
        for kind, folder in (("json", f"{path}/{name}_json"), ("parquet", f"{path}/{name}"))[0 if as_json else 1:]:
            tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("build_id").format(kind).save(folder)


def load_active_build(spark: SparkSession, registry: DataFrame, path: str, graph_type: str) -> tuple[DataFrame, ...]:
    """(nodes, edges, summary) of the type's active build; an error when there is none."""
    row = active_build(registry.where(F.col("graph_type") == graph_type)).select("build_id").first()
    if row is None:
        raise LookupError(f"no completed {graph_type} build")
    frames = []
    for name in PARTS:
        try:
            table = spark.read.parquet(f"{path}/{name}")
        except Exception as exc:
            raise LookupError(f"build {row.build_id} has no {name}") from exc
        part = table.where(F.col("build_id") == row.build_id)
        if name == "summary" and part.isEmpty():
            raise LookupError(f"build {row.build_id} has no artifacts")
        frames.append(part.drop("build_id"))
    return tuple(frames)
