"""Column expressions that read values out of raw metadata records.

Records arrive with an explicit schema. A field such as `type` or `language` may
be a struct (value/label/code/...) in one source and plain text in another, so
the readers below take the field's data type and build the matching expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweave.functions import fixed_values as fv
from paperweave.functions.text import first_in_array, nonblank, strip


def _null() -> Column:
    return F.lit(None).cast("string")


def field(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    """Column and type of a field; a typed null when the records lack it."""
    if name in df.columns:
        return F.col(name), df.schema[name].dataType
    return _null(), T.StringType()


def _texts(c: Column, dtype: T.DataType, keys: Sequence[str]) -> list[Column]:
    if isinstance(dtype, T.StructType):
        return [c[k] for k in keys if k in dtype.names and isinstance(dtype[k].dataType, T.StringType)]
    return []


def _coalesce(cols: list[Column]) -> Column:
    return F.coalesce(*cols) if cols else _null()


def extract_value(c: Column, dtype: T.DataType, keys: Sequence[str] = fv.VALUE_KEYS) -> Column:
    """First non-blank of the struct's `keys`, or the text itself."""
    if isinstance(dtype, T.StructType):
        return _coalesce([nonblank(x) for x in _texts(c, dtype, keys)])
    return nonblank(c) if isinstance(dtype, T.StringType) else _null()


def extract_pid(pids: Column, scheme: str) -> Column:
    """First non-blank value among array<struct<scheme,value>> with the scheme."""
    wanted = F.filter(
        pids,
        lambda p: (strip(F.lower(p["scheme"])) == scheme) & nonblank(p["value"]).isNotNull(),
    )
    return strip(F.try_element_at(wanted, F.lit(1))["value"])


def extract_nested_pid(pid: Column, scheme: str) -> Column:
    """Value of struct<id:struct<scheme,value>> when its scheme matches."""
    return F.when(strip(F.lower(pid["id"]["scheme"])) == scheme, nonblank(pid["id"]["value"]))


def parse_iso_date(c: Column) -> Column:
    """Date from the first ten characters (YYYY-MM-DD); anything else is null."""
    head = F.substring(c, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def sanitize_publication_date(c: Column) -> Column:
    """The stripped date text when it starts with a year in 1000..3000."""
    text = nonblank(c)
    return F.when(F.substring(text, 1, 4).try_cast("int").between(1000, 3000), text)


def publication_year(year: Column, date: Column) -> Column:
    return F.coalesce(year, F.year(date))


def extract_language_code(c: Column, dtype: T.DataType) -> Column:
    """A code cut to 16 characters, else a label or text of at most 16."""
    if isinstance(dtype, T.StructType):
        code = _coalesce([nonblank(x) for x in _texts(c, dtype, fv.LANGUAGE_CODE_KEYS)])
        label = _coalesce([nonblank(x) for x in _texts(c, dtype, fv.LANGUAGE_LABEL_KEYS)])
        return F.coalesce(F.substring(code, 1, 16), F.when(F.length(label) <= 16, label))
    text = nonblank(c)
    return F.when(F.length(text) <= 16, text)


def extract_country_code(c: Column, dtype: T.DataType) -> Column:
    """Two-letter code, upper case, from the code fields or the value itself."""
    codes = [F.when(F.length(strip(x)) == 2, F.upper(strip(x))) for x in _texts(c, dtype, fv.COUNTRY_KEYS)]
    value = extract_value(c, dtype)
    return F.coalesce(*codes, F.when(F.length(value) == 2, F.upper(value)))


def extract_open_access(c: Column, dtype: T.DataType) -> Column:
    """True or false from the access value; null when there is none."""
    return F.lower(extract_value(c, dtype)).isin(*fv.OPEN_ACCESS_VALUES)


def extract_container_name(c: Column, dtype: T.DataType) -> Column:
    return nonblank(c["name"]) if isinstance(dtype, T.StructType) and "name" in dtype.names else _null()


def first_of(c: Column, dtype: T.DataType) -> Column:
    """First non-blank text of an array, or of a plain text field."""
    return first_in_array(c) if isinstance(dtype, T.ArrayType) else nonblank(c)


def first_from_instances(instances: Column, dtype: T.DataType, name: str) -> Column:
    """First non-blank `name` over array<struct<..., name: text or array>>."""
    element = dtype.elementType if isinstance(dtype, T.ArrayType) else None
    if not isinstance(element, T.StructType) or name not in element.names:
        return _null()
    values = F.transform(instances, lambda i: i[name])
    if isinstance(element[name].dataType, T.ArrayType):
        values = F.flatten(F.filter(values, lambda v: v.isNotNull()))
    return first_in_array(values)


def relation_type(c: Column, dtype: T.DataType) -> Column:
    return F.coalesce(extract_value(c, dtype, fv.RELATION_KEYS), F.lit("unknown"))


def side_type(c: Column, dtype: T.DataType) -> Column:
    return F.lower(F.coalesce(extract_value(c, dtype, fv.RELATION_KEYS), F.lit("")))


def is_organization_type(side: Column) -> Column:
    return side.contains("organization") | (side == "org")


def is_publication_type(side: Column) -> Column:
    return side.contains("result") | side.contains("publication") | side.contains("researchproduct")


def is_affiliation_relation(c: Column, dtype: T.DataType) -> Column:
    by_name = F.lower(relation_type(c, dtype)).isin(*fv.AFFILIATION_RELATIONS)
    if isinstance(dtype, T.StructType) and "type" in dtype.names:
        return F.coalesce(F.lower(strip(c["type"])) == "affiliation", F.lit(False)) | by_name
    return by_name


def parse_position(c: Column) -> Column:
    """An integer of at least 1, else null."""
    position = strip(c.cast("string")).try_cast("int")
    return F.when(position >= 1, position)


def canonical_json(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    """The row (or the given columns) as JSON with keys in sorted order at every level."""
    names = sorted(cols or df.columns)
    return F.to_json(F.struct(*[_sorted(F.col(n), df.schema[n].dataType).alias(n) for n in names]))


def _sorted(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        inner = F.struct(*[_sorted(c[n], dtype[n].dataType).alias(n) for n in sorted(dtype.names)])
        return F.when(c.isNotNull(), inner)
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.StructType, T.ArrayType)):
        return F.transform(c, lambda x: _sorted(x, dtype.elementType))
    return c


def checksum(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(df, cols), 256)


def payload_identifier(df: DataFrame) -> Column:
    """id, else first original id, else relation ends and type, else a hash of the record."""
    ident, _ = field(df, "id")
    original, original_type = field(df, "originalId")
    candidates = [nonblank(ident), first_of(original, original_type)]
    if {"source", "target"} <= set(df.columns) and isinstance(df.schema["source"].dataType, T.StringType):
        kind = relation_type(*field(df, "reltype"))
        candidates.append(F.concat(F.lit("relation::"), F.col("source"), F.lit("::"), F.col("target"), F.lit("::"), kind))
    return F.coalesce(*candidates, F.concat(F.lit("generated::"), checksum(df)))


def organization_identifier(ident: Column, pids: Column, names: Sequence[Column], normal: Column) -> Column:
    """Identifier of an embedded organization: id, ROR, else its normalized name."""
    named = F.when(F.coalesce(*[nonblank(n) for n in names]).isNotNull(), F.concat(F.lit("name::"), normal))
    return F.coalesce(nonblank(ident), F.concat(F.lit("ror::"), extract_pid(pids, "ror")), named)


def input_country_code(c: Column) -> Column:
    """A typed-in country code: stripped, upper case, null when blank."""
    return F.upper(nonblank(c))


def input_identifier(c: Column) -> Column:
    """A typed-in identifier: stripped, null when blank."""
    return nonblank(c)


def is_valid_doi(c: Column) -> Column:
    return c.rlike(fv.DOI_PATTERN)


def is_valid_orcid(c: Column) -> Column:
    return c.rlike(fv.ORCID_PATTERN)


def is_valid_ror(c: Column) -> Column:
    return c.rlike(fv.ROR_PATTERN)


URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5_url(name: Column) -> Column:
    """RFC 4122 version-5 UUID of a name in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def point_id(publication_id: Column, provider: str, model: str, version: str) -> Column:
    """Stable id of one publication's vector under one embedding configuration."""
    return uuid5_url(
        F.concat(F.lit("publication:"), publication_id.cast("string"), F.lit(f":{provider}:{model}:{version}"))
    )


def content_hash(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)
