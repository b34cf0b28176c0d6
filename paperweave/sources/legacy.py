"""Renaming of the paged service's records to the dump's field names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.functions.payload import sanitize_publication_date

PUBLICATION_FIELDS = {
    "maintitle": ("mainTitle", "maintitle"),
    "description": ("descriptions", "description"),
    "pid": ("pids", "pid"),
    "originalId": ("originalIds", "originalId"),
    "bestaccessright": ("bestAccessRight", "bestaccessright"),
    "source": ("sources", "source"),
    "instance": ("instances", "instance"),
}
ORGANIZATION_FIELDS = {
    "legalname": ("legalName", "legalname"),
    "legalshortname": ("legalShortName", "legalshortname", "acronym"),
    "websiteurl": ("websiteUrl", "websiteurl"),
    "pid": ("pids", "pid"),
}


def _filled(c: Column, kind: str) -> Column:
    """The value, null when it is an empty text or an empty array."""
    if kind.startswith("array"):
        return F.when(F.size(c) > 0, c)
    return F.nullif(c, F.lit("")) if kind == "string" else c


def _first(df: DataFrame, names: tuple[str, ...]) -> Column | None:
    kinds = _exact(df)
    present = [_filled(F.col(n), kinds[n]) for n in names if n in kinds]
    return F.coalesce(*present) if present else None


def _exact(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def to_legacy_publication(df: DataFrame) -> DataFrame:
    """Service publication records under the dump's names; dates out of 1000..3000 are dropped."""
    out = {}
    for name, sources in PUBLICATION_FIELDS.items():
        value = _first(df, sources)
        if value is not None:
            out[name] = value
    date = _first(df, ("publicationDate", "publicationdate"))
    if date is not None:
        out["publicationdate"] = sanitize_publication_date(date)
    authors = _first(df, ("authors", "author"))
    if authors is not None:
        name = "authors" if "authors" in _exact(df) else "author"
        fields = df.schema[name].dataType.elementType.names
        full = [n for n in ("fullName", "fullname") if n in fields]
        out["author"] = F.transform(authors, lambda a: F.struct(
            F.coalesce(*[a[n] for n in full]).alias("fullname"),
            *[a[n].alias(n) for n in ("name", "surname", "rank", "pid") if n in fields],
        ))
    same = [c for c in ("id", "container", "publisher", "language", "type", "organizations", "arrival") if c in df.columns]
    return df.select(*same, *[value.alias(name) for name, value in out.items()])


def to_legacy_organization(df: DataFrame) -> DataFrame:
    """Service organization records under the dump's names; the type defaults to 'organization'."""
    out = {}
    for name, sources in ORGANIZATION_FIELDS.items():
        value = _first(df, sources)
        if value is not None:
            out[name] = value
    kind = F.coalesce(F.nullif("type", F.lit("")), F.lit("organization")) if "type" in df.columns else F.lit("organization")
    same = [c for c in ("id", "country", "city", "arrival") if c in df.columns]
    return df.select(*same, *[value.alias(name) for name, value in out.items()], kind.alias("type"))
