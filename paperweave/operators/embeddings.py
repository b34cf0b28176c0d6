"""Embedding texts, incremental plans and vector tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.functions.payload import content_hash, point_id
from paperweave.functions.text import nonblank
from paperweave.operators.semantic import author_names
from paperweave.session import Rounds

TEXT_FIELDS = ("title", "abstract")
CONFIG_KEYS = ("embedding_provider", "embedding_model", "embedding_version")


def embedding_text(publication: DataFrame, authorship: DataFrame, researcher: DataFrame,
                   fields: Sequence[str] = ("title", "authors", "abstract")) -> DataFrame:
    """(publication_id, content_text, error): labelled blocks of the configured fields.

    Blank fields are left out; a publication with nothing left gets an error row.
    """
    unknown = [f for f in fields if f not in (*TEXT_FIELDS, "authors")]
    if unknown:
        raise ValueError(f"unsupported embedding fields {unknown}")
    base = publication
    if "authors" in fields:
        # names of these publications only: there may be many times more authors than texts
        theirs = authorship.join(publication.select("publication_id"), "publication_id", "left_semi")
        base = base.join(author_names(theirs, researcher), "publication_id", "left")
    blocks = []
    for name in fields:
        if name == "authors":
            blocks.append(F.when(F.size("authors") > 0, F.concat(F.lit("Authors: "), F.array_join("authors", ", "))))
        else:
            blocks.append(F.concat(F.lit(f"{name.title()}: "), nonblank(F.col(name))))
    text = F.nullif(F.concat_ws("\n\n", *blocks), F.lit(""))
    return base.select("publication_id", text.alias("content_text")).withColumn(
        "error", F.when(F.col("content_text").isNull(), "no embeddable content")
    )


def embedding_plan(texts: DataFrame, existing: DataFrame, config: dict[str, str], force: bool = False) -> DataFrame:
    """(publication_id, content_hash, status, reason): what a build would do with each publication.

    Skipped when a vector of the same provider, model, version and collection
    carries the same content hash; failed when there is no text; else generated.
    """
    same = existing
    for key in (*CONFIG_KEYS, "collection"):
        same = same.where(F.col(key) == config[key])
    known = same.select("publication_id", F.col("content_hash").alias("known_hash"))
    rows = texts.withColumn("content_hash", content_hash(F.col("content_text"))).join(known, "publication_id", "left")
    unchanged = (F.col("content_hash") == F.col("known_hash")) & F.lit(not force)
    status = (
        F.when(F.col("content_text").isNull(), "failed")
        .when(F.coalesce(unchanged, F.lit(False)), "skipped").otherwise("generated")
    )
    reason = F.when(F.col("content_text").isNull(), "no embeddable content").when(
        F.coalesce(unchanged, F.lit(False)), "content_unchanged"
    )
    return rows.select("publication_id", "content_hash", status.alias("status"), reason.alias("reason"))


def embedding_summary(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("status") == "generated").alias("generated"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def embedding_payload(texts: DataFrame, publication: DataFrame, authorship: DataFrame, researcher: DataFrame) -> DataFrame:
    """(publication_id, payload): JSON payload; optional keys only when they have a value."""
    optional = [c for c in ("abstract", "publication_year", "doi", "openaire_id", "journal_name", "venue_name",
                            "publisher") if c in publication.columns]
    rows = publication.join(texts.select("publication_id", "content_text"), "publication_id").join(
        author_names(authorship, researcher), "publication_id", "left"
    )
    body = F.struct(
        F.col("publication_id").cast("string").alias("publication_id"), "title", "content_text",
        F.coalesce("authors", F.array().cast("array<string>")).alias("authors"),
        *[(F.nullif(c, F.lit("")) if dict(publication.dtypes)[c] == "string" else F.col(c)).alias(c) for c in optional],
    )
    return rows.select("publication_id", F.to_json(body, {"ignoreNullFields": "true"}).alias("payload"))


Provider = Callable[[list[str]], list[list[float]]]


def embed(texts: DataFrame, provider: Provider, batch_size: int = 16, retries: int = 3, wait: float = 0.0) -> DataFrame:
    """(publication_id, status, reason, embedding) from a pluggable batch provider.

    Rows are embedded in batches where they lie. A batch that keeps failing marks
    its own rows as failed and nothing else.
    """
    kind = dict(texts.dtypes)["publication_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at:at + batch_size]
                vectors, reason = None, None
                for attempt in range(retries):
                    try:
                        vectors = provider(list(part["content_text"]))
                        if len(vectors) != len(part):
                            raise ValueError("provider returned a wrong number of vectors")
                        break
                    except Exception as exc:  # noqa: BLE001 - any provider error fails the batch
                        vectors, reason = None, str(exc)
                        time.sleep(wait * attempt)
                yield pd.DataFrame({
                    "publication_id": part["publication_id"],
                    "status": "generated" if vectors is not None else "failed",
                    "reason": None if vectors is not None else reason,
                    "embedding": vectors if vectors is not None else [None] * len(part),
                })

    return texts.where(F.col("content_text").isNotNull()).select("publication_id", "content_text").mapInPandas(
        run, f"publication_id {kind}, status string, reason string, embedding array<double>"
    )


def word_bucket(word: Column, dim: int) -> Column:
    """Bucket of a word from the first 32 bits of its md5."""
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % dim


def tfidf_weights(texts: DataFrame, dim: int = 64) -> DataFrame:
    """(publication_id, bucket, weight): unit-length hashed TF-IDF, a row per non-empty bucket.

    Words are lower-case runs of ASCII word characters. A word counts once per
    occurrence; a bucket's inverse document frequency is ln((n + 1) / (df + 1)).
    Counts per bucket are written once, so each text is split once.
    """
    rows = texts.where(F.col("content_text").isNotNull()).select("publication_id", "content_text")
    words = rows.select("publication_id", F.explode(F.split(F.lower("content_text"), "[^a-z0-9_]+")).alias("word"))
    tf = Rounds(texts.sparkSession, "tfidf").cut(
        words.where(F.col("word") != "").groupBy("publication_id", word_bucket(F.encode("word", "UTF-8"), dim).alias("bucket"))
        .agg(F.count("*").alias("tf"))
    )
    df = tf.groupBy("bucket").agg(F.count("*").alias("df"))
    weighted = tf.join(F.broadcast(df), "bucket").select(  # a row per bucket at most
        "publication_id", "bucket",
        (F.col("tf") * F.log((rows.agg(F.count("*")).scalar() + 1) / (F.col("df") + 1))).alias("w"),
    )
    norm = weighted.groupBy("publication_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, "publication_id").where(F.col("w") > 0).select(
        "publication_id", "bucket", (F.col("w") / F.col("norm")).alias("weight")
    )


def tfidf_vectors(texts: DataFrame, dim: int = 64, weights: DataFrame | None = None) -> DataFrame:
    """(publication_id, embedding): `tfidf_weights`, which may be given, as dense vectors, the offline default; zero without a weight."""
    weights = weights if weights is not None else tfidf_weights(texts, dim)
    per = weights.groupBy("publication_id").agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("weights")  # at most `dim` entries
    )
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.coalesce(
        F.try_element_at("weights", k.cast("bigint")), F.lit(0.0)).cast("float"))
    return texts.where(F.col("content_text").isNotNull()).select("publication_id").join(per, "publication_id", "left").select(
        "publication_id", dense.alias("embedding")
    )


def upsert_vectors(base: DataFrame, new: DataFrame) -> DataFrame:
    """Vector table with one row per publication and configuration, new rows winning."""
    key = ["publication_id", *CONFIG_KEYS]
    return base.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def drop_configuration(embedding: DataFrame, config: dict[str, str]) -> DataFrame:
    """The vector table without one configuration's rows."""
    gone = F.lit(True)
    for key in CONFIG_KEYS:
        gone &= F.col(key).eqNullSafe(config[key])
    return embedding.where(~gone)


def embedding_status(publication: DataFrame, embedding: DataFrame, config: dict[str, str]) -> DataFrame:
    """One row: publications, vectors of the active configuration, last update."""
    active = embedding
    for key in CONFIG_KEYS:
        active = active.where(F.col(key) == config[key])
    return active.agg(
        F.count("*").alias("embedding_count"),
        F.date_format(F.max("updated_at"), "yyyy-MM-dd HH:mm:ss").alias("last_updated_at"),
    ).withColumn("publication_count", publication.agg(F.count("*")).scalar())


def point_ids(publication: DataFrame, config: dict[str, str]) -> DataFrame:
    return publication.select(
        "publication_id", point_id(F.col("publication_id"), *[config[k] for k in CONFIG_KEYS]).alias("point_id")
    )
