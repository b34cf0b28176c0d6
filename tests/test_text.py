import random
import re
import unicodedata
import uuid

from pyspark.sql import functions as F

from paperweave.functions import payload as px
from paperweave.functions import text as tx


def match_key(value):
    kept = (c for c in unicodedata.normalize("NFKD", value or "") if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", " ", "".join(kept).casefold()).strip()


def cleaned(value):
    return None if value is None else " ".join(unicodedata.normalize("NFKC", value).split()) or None


def strings():
    rng = random.Random(1)
    fixed = ["Università  di   Torino! ", "Smash: Flexible, Fast.", "  Ada   Lovelace  ", "Straße ﬁx ½ ™ ẞ İ ſ K ŉ", None,
             "", "   ", "Пример", "한국어", "éä", "a b\x1fc"]
    spans = [(32, 127), (0x80, 0x250), (0x250, 0xD7FF), (0xE000, 0x1FFFF), (0x20000, 0x10FFFF)]
    made = ["".join(chr(rng.randrange(*rng.choice(spans))) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    return fixed + made


def test_normalize_and_clean_are_exact(spark):
    df = spark.createDataFrame([(s,) for s in strings()], "s string")
    out = df.select("s", tx.normalize_text(F.col("s")).alias("n"), tx.clean_text(F.col("s")).alias("c"))
    for row in out.collect():
        assert row.n == match_key(row.s), repr(row.s)
        assert row.c == cleaned(row.s), repr(row.s)


def values(spark, schema, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_small_expressions(spark):
    s = F.col("s")
    rows = [("  ab  ",), ("",), (None,), ("x" * 130,), ("a " * 70,)]
    got = values(spark, "s string", rows, tx.nonblank(s), tx.publication_label(s), tx.clip_text(s, 4))
    assert got[0] == ("ab", "ab", "  ab")
    assert got[1][0] is None and got[2] == (None, None, None)
    assert got[3][1] == "x" * 117 + "..." and got[4][2] == "a a"
    label = values(spark, "d string, f string", [("", "Full"), ("Shown", "Full"), (None, "Full")],
                   tx.display_label(F.col("d"), F.col("f")))
    assert label == [("Full",), ("Shown",), ("Full",)]


def test_language_country_access(spark):
    schema = "c struct<code:string,iso:string,isoCode:string,value:string,label:string,name:string>"
    rows = [((" en ", None, None, None, "English", None),), ((None, None, None, None, "x" * 17, None),),
            ((None, None, None, None, "French", None),), (("x" * 20, None, None, None, None, None),)]
    df = spark.createDataFrame(rows, schema)
    dtype = df.schema["c"].dataType
    got = [r[0] for r in df.select(px.extract_language_code(F.col("c"), dtype)).collect()]
    assert got == ["en", None, "French", "x" * 16]
    access = spark.createDataFrame([("Open Access",), ("closed",), (" ",), (None,)], "a string")
    assert [r[0] for r in access.select(px.extract_open_access(F.col("a"), access.schema["a"].dataType)).collect()] == [
        True, False, None, None]
    country = spark.createDataFrame([(("it", None),), (("Italy", "FR"),), (("Italy", "France"),)], "c struct<code:string,label:string>")
    assert [r[0] for r in country.select(px.extract_country_code(F.col("c"), country.schema["c"].dataType)).collect()] == [
        "IT", "FR", None]


def test_identifiers_and_positions(spark):
    pids = [([(" DOI ", "  10.1/x "), ("ror", "r")],), ([("doi", " ")],), (None,)]
    got = values(spark, "p array<struct<scheme:string,value:string>>", pids, px.extract_pid(F.col("p"), "doi"))
    assert got == [("10.1/x",), (None,), (None,)]
    ranks = values(spark, "r string", [("3",), ("0",), ("x",), (None,), (" 7 ",)], px.parse_position(F.col("r")))
    assert ranks == [(3,), (None,), (None,), (None,), (7,)]
    dates = values(spark, "d string", [("2020-02-30",), ("2020-02-29T10:00",), ("2020",), ("0500-01-01",)],
                   px.parse_iso_date(F.col("d")).cast("string"), px.sanitize_publication_date(F.col("d")))
    assert dates == [(None, "2020-02-30"), ("2020-02-29", "2020-02-29T10:00"), (None, "2020"), ("0500-01-01", None)]
    got = values(spark, "i long", [(5,)], px.point_id(F.col("i"), "p", "m", "v"))
    assert got == [(str(uuid.uuid5(uuid.NAMESPACE_URL, "publication:5:p:m:v")),)]


def test_relation_expressions(spark):
    schema = "reltype struct<name:string,type:string>, sourceType string"
    df = spark.createDataFrame([((None, " Affiliation "), "Organization"), (("HasAuthorInstitution", None), "org"),
                                ((" ", None), "ResearchProduct")], schema)
    dtype = df.schema["reltype"].dataType
    side = px.side_type(F.col("sourceType"), df.schema["sourceType"].dataType)
    got = [tuple(r) for r in df.select(
        px.relation_type(F.col("reltype"), dtype), px.is_affiliation_relation(F.col("reltype"), dtype),
        px.is_organization_type(side), px.is_publication_type(side)).collect()]
    assert got == [("unknown", True, True, False), ("HasAuthorInstitution", True, True, False), ("unknown", False, False, True)]


def test_payload_identifier_forms(spark):
    df = spark.createDataFrame(
        [(None, None, "s", "t", ("Cites",)), (" a ", None, None, None, None), (" ", [" ", " o "], "s", None, None)],
        "id string, originalId array<string>, source string, target string, reltype struct<name:string>")
    assert [r[0] for r in df.select(px.payload_identifier(df)).collect()] == ["relation::s::t::Cites", "a", "o"]
