import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from paperweave.operators.catalog import table_counts
from paperweave.sources import builds, legacy, readers, schemas
from paperweave.streaming.ingest import RECORD, compact_records, read_records, stream_ingest


def write_gz(path, lines):
    with gzip.open(path, "wt") as out:
        out.write("\n".join(lines) + "\n")


def test_gz_parts_and_bad_lines(spark, tmp_path):
    write_gz(tmp_path / "part-1.txt.gz", [json.dumps({"id": "a", "legalname": "A"}), json.dumps({"id": "b"})])
    write_gz(tmp_path / "part-2.txt.gz", ['{"id": "c"', json.dumps({"id": "d"})])
    good, bad = readers.split_malformed(readers.read_entities(spark, str(tmp_path), schemas.ORGANIZATION, "QUARANTINE").cache())
    assert sorted(r.id for r in good.collect()) == ["a", "b", "d"]
    report = readers.malformed_report(bad).first()
    assert report.source_file.endswith("part-2.txt.gz") and report.bad_lines == 1
    with pytest.raises(Exception):
        readers.read_entities(spark, str(tmp_path), schemas.ORGANIZATION).collect()


def test_archives_are_read_by_member(spark, tmp_path):
    path = tmp_path / "dump.tar"
    with tarfile.open(path, "w") as tar:
        for name, ids in (("x/part-0.json.gz", ["a", "b"]), ("x/part-1.json.gz", ["c"]), ("x/part-2.json", ["d"])):
            body = "\n".join(json.dumps({"id": i, "legalname": f"Né {i}"}) for i in ids).encode()
            if name.endswith("gz"):  # two gzip streams end to end
                body = gzip.compress(body[:7]) + gzip.compress(body[7:])
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    got = readers.read_archives(spark, [str(path)], schemas.ORGANIZATION)
    assert sorted((r.member, r.line_number, r.id, r.legalname) for r in got.collect()) == [
        ("x/part-0.json.gz", 1, "a", "Né a"), ("x/part-0.json.gz", 2, "b", "Né b"), ("x/part-1.json.gz", 1, "c", "Né c"),
        ("x/part-2.json", 1, "d", "Né d")]


def test_pages_stop_after_the_first_short_one(spark):
    item = "struct<id:string>"
    pages = spark.createDataFrame(
        [(1, (2,), [("a",), ("b",)]), (2, (2,), [("c",), None]), (3, (2,), [("x",), ("y",)])],
        f"page_number long, header struct<pageSize:long>, results array<{item}>")
    got = [r.id for r in readers.explode_pages(pages).orderBy("page_number", "place").collect()]
    assert got == ["a", "b", "c"]
    assert [r.id for r in readers.explode_pages(pages, 2).collect()] == ["a", "b"]


def test_page_schema_parses(spark):
    schema = schemas.page_schema(schemas.SERVICE_PUBLICATION)
    df = spark.createDataFrame([('{"header":{"pageSize":5},"results":[{"id":"p","mainTitle":"T"}]}',)], "s string")
    row = df.select(F.from_json("s", f"struct<{schema.replace('header ', 'header:').replace('results ', 'results:')}>").alias("p")).first()
    assert row.p.results[0].mainTitle == "T"


def test_inputs_union_and_views(spark):
    frames = {"a": spark.range(5).toDF("x"), "b": spark.range(3).toDF("y")}
    cut = readers.limit_per_input(frames, 4)
    assert {k: v.count() for k, v in cut.items()} == {"a": 4, "b": 3}
    assert sorted(readers.union_results(*frames.values()).columns) == ["x", "y"]
    readers.register_views(frames)
    assert spark.sql("select count(*) from a").first()[0] == 5
    assert sorted(tuple(r) for r in table_counts(frames).collect()) == [("a", 5), ("b", 3)]


def test_legacy_names(spark):
    pubs = spark.createDataFrame(
        [("p", None, "M", "3999-01-01", [], [("A", "B", 2)]), ("q", "m", None, " 2020-01-01 ", [("doi", "d")], [])],
        "id string, maintitle string, mainTitle2 string, publicationDate string, pids array<struct<scheme:string,value:string>>, "
        "authors array<struct<fullName:string,surname:string,rank:int>>").withColumnRenamed("mainTitle2", "title2")
    out = {r.id: r for r in legacy.to_legacy_publication(pubs).collect()}
    assert out["p"].publicationdate is None and out["p"].pid is None and out["p"].author[0].fullname == "A"
    assert out["q"].publicationdate == "2020-01-01" and out["q"].maintitle == "m"
    orgs = spark.createDataFrame([("o", "Legal", "", "ACR")], "id string, legalName string, legalShortName string, acronym string")
    row = legacy.to_legacy_organization(orgs).first()
    assert (row.legalname, row.legalshortname, row.type) == ("Legal", "ACR", "organization")


def test_builds_at_rest(spark, tmp_path):
    nodes, edges, summary = spark.range(3).toDF("id"), spark.range(2).toDF("source"), spark.range(1).toDF("node_count")
    reg = spark.createDataFrame([("b1", "co", "completed", True, 1), ("b2", "co", "running", False, 2)],
                                "build_id string, graph_type string, status string, is_active boolean, started_at int")
    builds.write_build(nodes, edges, summary, str(tmp_path), "b1", as_json=True)
    got = builds.load_active_build(spark, reg, str(tmp_path), "co")
    assert [df.count() for df in got] == [3, 2, 1]
    with pytest.raises(LookupError):
        builds.load_active_build(spark, reg, str(tmp_path), "sem")
    with pytest.raises(LookupError):
        builds.load_active_build(spark, reg, str(tmp_path / "none"), "co")


def test_stream_ingest_resumes(spark, tmp_path):
    schema = RECORD

    def land(name, rows):
        spark.createDataFrame(rows, "record_id bigint, entity_type string, source_identifier string, raw_payload string") \
            .coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    args = (spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"))
    land("1", [(1, "p", "a", "x"), (2, "p", "a", "x"), (3, "p", "b", "x")])
    stream_ingest(*args, schema=schema).awaitTermination()
    land("2", [(4, "p", "a", "y"), (5, "p", "c", "x")])
    stream_ingest(*args, schema=schema).awaitTermination()
    want = [("a", 1, 3, True), ("b", 3, 1, False), ("c", 5, 1, False)]
    cols = ("source_identifier", "record_id", "arrivals", "payload_changed")
    assert sorted(tuple(r) for r in read_records(spark, str(tmp_path / "t")).select(*cols).collect()) == want
    compact_records(spark, str(tmp_path / "t"), str(tmp_path / "u"))
    assert sorted(tuple(r) for r in read_records(spark, str(tmp_path / "u")).select(*cols).collect()) == want
