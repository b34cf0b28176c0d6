"""Operator 10: cross-site boilerplate lines by distinct-site sketches, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.llm.common import table
from paperweave.session import Rounds

MIN_SITES = 10
BAND = 0.2
LG_K = 12


def _key(line: Column) -> Column:
    """128 bits of a line without outer blanks."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(bare, F.lit(1)).alias("b"))


def _is_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r")) == ""


def widespread_lines(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """(key, first_doc): lines seen on at least `min_sites` distinct sites, from (doc_id, site, key).

    One sketch per line and task, merged by the aggregation, settles every line
    whose estimate lies outside `min_sites` x (1 +- band). The others, and
    only they, get their exact number of distinct sites. The standard error of
    a sketch of 2^12 registers is 1.6 %, a twelfth of the band.
    """
    spread = lines.groupBy("key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), F.min("doc_id").alias("first_doc"),
    ).where(F.col("sites") >= min_sites * (1 - band))
    rounds = Rounds(lines.sparkSession, "line-spread")
    spread = rounds.cut(spread)
    near = spread.where(F.col("sites") <= min_sites * (1 + band))
    exact = (
        lines.join(near.select("key"), "key", "left_semi")
        .groupBy("key").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= min_sites).select("key")
    )
    sure = spread.where(F.col("sites") > min_sites * (1 + band))
    return sure.unionByName(near.join(exact, "key", "left_semi")).select("key", "first_doc")


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines at the positions `gone`; one pass, whatever the numbers of lines and positions."""
    def rest(parts: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
        return F.array_join(F.transform(kept, lambda at: F.get(parts, at)), "\n")

    # The split text is a variable of the outer function, so it is split once and not once a line.
    return F.get(F.transform(F.array(F.split(text, "\n", -1)), rest), F.lit(0))


def _cleaned(docs: DataFrame, min_sites: int, site: str) -> DataFrame:
    """(row, text, n_lines, n_removed): each row as it came, and its text without widespread lines."""
    rounds = Rounds(docs.sparkSession, "lines")
    version = F.xxhash64("text")  # rows of one doc_id may hold different texts
    lines = rounds.cut(
        docs.select(
            "doc_id", version.alias("version"), F.coalesce(F.concat(F.lit("="), F.col(site)), F.lit("-")).alias("site"),
            F.posexplode(F.split("text", "\n", -1)).alias("at", "line"),
        ).where(~_is_blank(F.col("line"))).select("doc_id", "version", "site", "at", _key(F.col("line")).alias("key"))
    )
    wide = rounds.cut(widespread_lines(lines.select("doc_id", "site", "key"), min_sites))
    gone = (
        lines.select("doc_id", "version", "at", "key").join(wide, "key").where(F.col("doc_id") != F.col("first_doc"))
        .groupBy("doc_id", "version").agg(F.collect_set("at").alias("gone"))
    )
    line_feeds = F.length("text") - F.length(F.translate("text", "\n", ""))
    return (
        docs.select("doc_id", version.alias("version"), "text", F.struct("*").alias("row")).join(gone, ["doc_id", "version"], "left")
        .select(
            "row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("gone"))).alias("text"),
            F.coalesce(line_feeds + 1, F.lit(0)).cast("long").alias("n_lines"),
            F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        )
    )


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """Documents without the lines that stand on at least `min_sites` sites; adds n_lines, n_removed.

    A line is text between line feeds; lines are equal when equal without outer
    blanks. A widespread line stays in the document with the smallest doc_id
    that has it (each time it occurs there) and goes from all others, so no
    text leaves the collection altogether. Blank lines stay.

    The site of a null source is a site of its own. Null text stays null with 0
    lines. Rows without doc_id count as evidence and stay as they are. Repeated
    rows of one doc_id are treated alike. Extra columns pass through, but for
    any that are named n_lines or n_removed.
    """
    out = _cleaned(docs, min_sites, site)
    keep = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "text", "n_lines", "n_removed")


def clean(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """The documents, all columns as they were, without widespread lines; n_chars follows a changed text."""
    out = _cleaned(docs, min_sites, site)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row")["n_chars"]).cast(
            docs.schema["n_chars"].dataType
        )
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return remove_boilerplate(docs).select("doc_id", "text", "n_lines", "n_removed")


SQL = """
WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
w AS (SELECT bare, min(doc_id) AS first_doc FROM t WHERE bare <> '' GROUP BY bare
      HAVING count(DISTINCT coalesce('=' || source, '-')) >= 10),
k AS (SELECT t.*, coalesce(t.doc_id <> first_doc, false) AS gone FROM t LEFT JOIN w ON t.bare = w.bare),
g AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
             count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM k GROUP BY doc_id)
SELECT documents.doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE g.text END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents LEFT JOIN g ON documents.doc_id = g.doc_id
"""
