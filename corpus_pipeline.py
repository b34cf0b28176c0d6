"""A corpus pipeline of the operators in paperweave.llm; each stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.llm import anchor_simhash, cross_parse, line_spread, string_tiling, swap_packing
from paperweave.llm.common import fold_of, table
from paperweave.session import Rounds

MIN_PHRASE = 1.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language.

    Rejects what has no letters (null and blank text included) and what no
    language parses in phrases of MIN_PHRASE symbols on average: text in other
    letters takes a phrase a letter. Learns from two thirds of the documents.
    """
    parser = cross_parse.fit(docs.where(F.coalesce(fold_of(F.col("doc_id"), 3) != 1, F.lit(False))))
    known = (F.col("lang_pred") != "und") & (F.col("phrase_length") >= MIN_PHRASE)
    return cross_parse.judged(docs, parser).where(known).select("row.*")


def spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines."""
    return line_spread.clean(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return anchor_simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = string_tiling.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return swap_packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", spread_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]
# Language identification, SimHash links and tokenizers are not SQL; tests/llm compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of `sf_dir`."""
    docs, rounds = table(spark, sf_dir, "documents"), Rounds(spark, "pipeline")
    for _, stage in STAGES:
        docs = rounds.cut(stage(spark, docs, sf_dir))
    return docs
