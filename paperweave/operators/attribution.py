"""Organization lineage and governed attribution of researchers to universities."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import count

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.functions import fixed_values as fv
from paperweave.functions.payload import extract_pid
from paperweave.functions.text import normalize_text
from paperweave.session import Rounds

GRAM = 3
DICTIONARY_CHARS = 1_000_000


def alliance_aliases(spark: SparkSession) -> DataFrame:
    """The built-in dictionary: code, name, country_code, alias, spec_order."""
    rows = [
        (code, name, country, alias, order)
        for order, (code, name, country, aliases) in enumerate(fv.ALLIANCE_UNIVERSITIES)
        for alias in aliases
    ]
    return spark.createDataFrame(rows, "code string, name string, country_code string, alias string, spec_order int")


def org_lineage(organization: DataFrame) -> DataFrame:
    """(organization_id, ancestor_id, depth): every organization with itself and its ancestors.

    One join per level, until a level is empty; a row carries its path, so a cycle
    ends where it closes.
    """
    rounds = Rounds(organization.sparkSession, "lineage")
    parents = organization.where(F.col("parent_organization_id").isNotNull()).select(
        F.col("organization_id").alias("ancestor_id"), F.col("parent_organization_id").alias("parent")
    )
    known = organization.select(F.col("organization_id").alias("parent"))
    level = organization.select(
        "organization_id", F.col("organization_id").alias("ancestor_id"), F.lit(0).alias("depth"),
        F.array("organization_id").alias("path"),
    )
    out = level.drop("path")
    for depth in count(1):
        level, seen = rounds.measure(
            level.join(parents, "ancestor_id").join(known, "parent", "left_semi")
            .where(~F.array_contains("path", F.col("parent")))
            .select("organization_id", F.col("parent").alias("ancestor_id"), F.lit(depth).alias("depth"),
                    F.concat("path", F.array("parent")).alias("path")),
            rows=F.count("*"),
        )
        if not seen["rows"]:
            return out
        out = out.unionByName(level.drop("path"))


def _dictionary(aliases: DataFrame, min_alias_len: int) -> DataFrame:
    """(code, country_code, alias): usable normalized aliases."""
    rows = aliases.select("code", "country_code", normalize_text(F.col("alias")).alias("alias")).distinct()
    return rows.where((F.col("alias") != "") & (F.length("alias") >= min_alias_len))


def _score(name: Column, alias: Column) -> Column:
    return (
        F.when(name == alias, fv.SCORE_EQUAL)
        .when(F.contains(name, alias), fv.SCORE_ALIAS_IN_NAME)
        .when(F.contains(alias, name) & (F.length(name) >= fv.MIN_NAME_IN_ALIAS), fv.SCORE_NAME_IN_ALIAS)
        .otherwise(0)
    )


def _grams(c: Column) -> Column:
    """Distinct substrings of one to GRAM characters."""
    return F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.length(c)), lambda i: F.array(*[F.substr(c, i, F.lit(n)) for n in range(1, GRAM + 1)])
    )))


def _rarest_gram(texts: DataFrame, column: str, others: DataFrame) -> DataFrame:
    """`texts` with the substring `gram` of `column` that fewest of `others` (gram, n) have.

    A text with a substring that none has lies in none of them and drops out.
    """
    size = F.least(F.length(column), F.lit(GRAM))
    own = F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(column) - size + 1), lambda i: F.substr(F.col(column), i, size)
    ))
    found = texts.withColumn("_grams", own).withColumn("gram", F.explode("_grams")).join(others, "gram")
    keys = texts.columns
    return (
        found.groupBy(*keys).agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count("*").alias("_have"),
                                 F.max(F.size("_grams")).alias("_all"))
        .where(F.col("_have") == F.col("_all")).drop("_have", "_all")
    )


def _containing(outer: DataFrame, column: str, inner: DataFrame, inner_column: str) -> DataFrame:
    """Pairs (outer row, inner row) that share the inner text's rarest substring."""
    grams = outer.withColumn("gram", F.explode(_grams(F.col(column))))
    counted = grams.groupBy("gram").agg(F.count("*").alias("n"))
    return grams.join(_rarest_gram(inner, inner_column, counted), "gram").drop("gram")


def _automaton(words: Sequence[str]) -> ahocorasick.Automaton | None:
    found = ahocorasick.Automaton()
    for word in words:
        found.add_word(word, word)
    found.make_automaton()
    return found if words else None


def _by_automaton(texts: DataFrame, entries: Sequence[str]) -> DataFrame:
    """Pairs (name, alias) of which one contains the other, for a dictionary of checked size.

    One automaton of the dictionary runs over the names, and one of each Arrow
    batch of names over the dictionary: every character is read a bounded number
    of times, and only true pairs become rows.
    """
    shared = texts.sparkSession.sparkContext.broadcast(list(entries))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _automaton(shared.value)
        for batch in batches:
            names = batch["name"].tolist()
            inside = _automaton([n for n in names if len(n) >= fv.MIN_NAME_IN_ALIAS])
            pairs = {(n, alias) for n in names for _, alias in words.iter(n)} if words else set()
            if inside:
                pairs |= {(n, alias) for alias in shared.value for _, n in inside.iter(alias)}
            yield pd.DataFrame(sorted(pairs), columns=["name", "alias"])

    return texts.mapInPandas(match, "name string, alias string")


def _by_grams(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """The same pairs for a dictionary of any size.

    If one text lies inside the other, every substring of the inner one is one of
    the outer; pairs meet by an equi-join on the substring of the inner text that
    fewest outer texts have, so common beginnings bring nothing together.
    """
    short = texts.where(F.length("name") >= fv.MIN_NAME_IN_ALIAS)
    return _containing(texts, "name", entries, "alias").unionByName(_containing(entries, "alias", short, "name")).distinct()


def alias_match(names: DataFrame, aliases: DataFrame, min_alias_len: int = 0, dictionary_chars: int = DICTIONARY_CHARS) -> DataFrame:
    """(name, country_code, code, score) for each normalized name and every dictionary code it matches.

    `names` has name (normalized) and country_code; equal rows are matched once.
    A dictionary of at most `dictionary_chars` characters goes to all tasks as an
    automaton, a larger one meets the names by joins; the rows are the same.
    """
    distinct = names.select("name", "country_code").where(F.coalesce("name", F.lit("")) != "").distinct()
    words = _dictionary(aliases, min_alias_len).withColumnRenamed("country_code", "code_country")
    texts = distinct.select("name").distinct()
    entries = words.select("alias").distinct()
    if (entries.agg(F.sum(F.length("alias"))).first()[0] or 0) <= dictionary_chars:
        pairs = _by_automaton(texts, [r[0] for r in entries.collect()])
    else:
        pairs = _by_grams(texts, entries)
    scored = pairs.withColumn("base", _score(F.col("name"), F.col("alias"))).where(F.col("base") > 0)
    out = distinct.join(scored, "name").join(words, "alias")
    adjust = (
        F.when(F.col("code_country") == F.col("country_code"), fv.SCORE_SAME_COUNTRY)
        .when((F.coalesce("code_country", F.lit("")) != "") & (F.coalesce("country_code", F.lit("")) != "")
              & (F.col("code_country") != F.col("country_code")), fv.SCORE_OTHER_COUNTRY)
        .otherwise(0)
    )
    return out.groupBy("name", "country_code", "code").agg(F.max(F.col("base") + adjust).cast("int").alias("score"))


def match_organizations(organization: DataFrame, aliases: DataFrame, min_alias_len: int = 0) -> DataFrame:
    """(organization_id, code, score): best dictionary code over the lineage; a tie for first gives none."""
    country = F.col("country_code") if "country_code" in organization.columns else F.lit(None).cast("string")
    named = organization.select(
        F.col("organization_id").alias("ancestor_id"), normalize_text(F.col("name")).alias("name"),
        country.alias("country_code"),
    )
    matches = alias_match(named, aliases, min_alias_len)
    on = (F.col("n.name") == F.col("m.name")) & F.col("n.country_code").eqNullSafe(F.col("m.country_code"))
    scored = named.alias("n").join(matches.alias("m"), on).select("n.ancestor_id", "m.code", "m.score")
    per_code = (
        org_lineage(organization).join(scored, "ancestor_id")
        .groupBy("organization_id", "code").agg(F.max("score").alias("score"))
    )
    best = per_code.groupBy("organization_id").agg(F.max("score").alias("score"))
    return (
        per_code.join(best, ["organization_id", "score"])
        .groupBy("organization_id", "score").agg(F.count("*").alias("ties"), F.min("code").alias("code"))
        .where(F.col("ties") == 1).select("organization_id", "code", "score")
    )


def _single(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) for keys with exactly one distinct value: min and max agree."""
    return (
        df.where(F.col(value).isNotNull()).groupBy(key)
        .agg(F.min(value).alias(value), F.max(value).alias("_max"))
        .where(F.col(value) == F.col("_max")).drop("_max")
    )


def display_organization(researcher: DataFrame, affiliation: DataFrame, organization: DataFrame) -> DataFrame:
    """(researcher_id, primary_organization_id, primary_organization_name).

    The primary organization, else the only affiliated one, else null.
    """
    orgs = organization.select("organization_id", F.col("name").alias("organization_name"))
    linked = affiliation.join(orgs.select("organization_id"), "organization_id", "left_semi")
    only = _single(linked, "researcher_id", "organization_id").withColumnRenamed("organization_id", "only_org")
    primary = orgs.select(F.col("organization_id").alias("primary_organization_id"),
                          F.col("organization_name").alias("primary_name"))
    return (
        researcher.select("researcher_id", "primary_organization_id")
        .join(primary, "primary_organization_id", "left")
        .withColumn("known", F.when(F.col("primary_name").isNotNull(), F.col("primary_organization_id")))
        .join(only, "researcher_id", "left")
        .withColumn("organization_id", F.coalesce("known", "only_org"))
        .join(orgs, "organization_id", "left")
        .select("researcher_id", F.col("organization_id").alias("primary_organization_id"),
                F.col("organization_name").alias("primary_organization_name"))
    )


def attribute_universities(researcher: DataFrame, affiliation: DataFrame, organization: DataFrame,
                           aliases: DataFrame, min_alias_len: int = 0) -> DataFrame:
    """(researcher_id, university_code, university_name) of attributed researchers.

    The code of the primary organization, else the only code over all affiliations.
    """
    rounds = Rounds(organization.sparkSession, "attribution")
    matched = rounds.cut(match_organizations(organization, aliases, min_alias_len).select("organization_id", "code"))
    by_primary = researcher.select("researcher_id", F.col("primary_organization_id").alias("organization_id")).join(
        matched, "organization_id"
    ).select("researcher_id", F.col("code").alias("primary_code"))
    by_link = _single(affiliation.join(matched, "organization_id"), "researcher_id", "code")
    names = aliases.groupBy("code").agg(F.min("name").alias("university_name"))
    return (
        by_primary.join(by_link, "researcher_id", "full")
        .select("researcher_id", F.coalesce("primary_code", "code").alias("code"))
        .join(names, "code")
        .select("researcher_id", F.col("code").alias("university_code"), "university_name")
    )


def alias_code(df: DataFrame, aliases: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, code): first dictionary entry one of whose aliases equals one of the names, normalized."""
    words = aliases.select(normalize_text(F.col("alias")).alias("word"), "code", "spec_order")
    tokens = df.select(key, F.explode(F.array(*[normalize_text(F.col(n)) for n in names])).alias("word"))
    return (
        tokens.where(F.col("word") != "").join(words, "word")
        .groupBy(key).agg(F.min_by("code", "spec_order").alias("code"))
    )


def dedupe_embedded_orgs(publications: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per distinct organization embedded in a publication record.

    `publications`: publication_id, organizations array<struct<id, legalName,
    acronym, pids array<struct<scheme,value>>>>. Records are equal by dictionary
    code, else ROR, else stable id, else normalized name; the best of them (stable
    id, then has pids, then longest legal name) is kept, the first on a tie.
    """
    rows = publications.select("publication_id", F.posexplode("organizations").alias("pos", "o")).select(
        "publication_id", "pos",
        F.nullif(F.trim("o.id"), F.lit("")).alias("org_id"),
        F.nullif(F.trim("o.legalName"), F.lit("")).alias("legal_name"),
        F.nullif(F.trim("o.acronym"), F.lit("")).alias("acronym"),
        F.col("o.pids").alias("pids"),
    ).withColumn("row_key", F.concat_ws("#", F.col("publication_id").cast("string"), F.col("pos").cast("string")))
    codes = alias_code(rows, aliases, "row_key", ["legal_name", "acronym"])
    stable = F.col("org_id").isNotNull() & ~F.col("org_id").startswith(fv.PENDING_ORG_PREFIX)
    ror = extract_pid(F.col("pids"), "ror")
    shown = F.coalesce("legal_name", "acronym")
    key = F.coalesce(
        F.concat(F.lit("code::"), F.col("code")),
        F.concat(F.lit("ror::"), ror),
        F.when(stable, F.concat(F.lit("id::"), F.col("org_id"))),
        F.when(shown.isNotNull(), F.concat(F.lit("name::"), normalize_text(shown))),
        F.concat(F.lit("anonymous::"), F.col("pos").cast("string")),
    )
    best = F.struct(
        F.coalesce(stable, F.lit(False)).cast("int").alias("a"),
        (F.coalesce(F.size("pids"), F.lit(0)) > 0).cast("int").alias("b"),
        F.coalesce(F.length("legal_name"), F.lit(0)).alias("c"),
        (-F.col("pos")).alias("d"),
    )
    kept = F.struct("org_id", "legal_name", "acronym", "pids")
    return (
        rows.join(codes, "row_key", "left").withColumn("dedupe_key", key)
        .groupBy("publication_id", "dedupe_key").agg(F.max_by(kept, best).alias("k"))
        .select("publication_id", "dedupe_key", "k.*")
    )
