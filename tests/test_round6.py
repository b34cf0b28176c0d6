"""A load writes little, keeps nothing it has done with, and does for single rows no work that only repeated ones need."""

from pyspark.sql import functions as F

from paperweave.operators import ingest, provenance
from paperweave.plans import load
from paperweave.session import Rounds, checkpoint_root, children, has_none
from paperweave.streaming import ingest as stream


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def order(df):
    return sorted(map(str, df.collect()))


def test_round_tables_are_packed(spark, tmp_path):
    """Hashes are most of a source record; packed, a hex digit takes about half a byte."""
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("h")).coalesce(1)
    rounds = Rounds(spark, "packed")
    out = rounds.cut(rows)
    names = [n for n in children(spark, out._round_path) if n.endswith(".parquet")]
    assert names and all(n.endswith(".zstd.parquet") for n in names)
    assert sorted(r.h for r in out.collect()) == sorted(r.h for r in rows.collect())
    rounds.clear()
    assert children(spark, rounds.base) == []


def test_types_of_relations_are_read_once_for_each_combination(spark):
    kinds = [("organization", "result"), (" Organization ", "Publication"), ("result", "org"), ("result", "result"), (None, "result"),
             ("organization", None), ("", ""), ("org", "researchproduct")]
    rels = [{"name": "isAuthorInstitutionOf", "type": "affiliation"}, {"name": " ", "type": "x"}, {"name": None, "type": None}, None]
    rows = [(f"s{i}", f"t{i}" if i % 5 else None, *kinds[i % 8], rels[i % 4 if i % 3 else 0], i) for i in range(200)] * 2
    raw = spark.createDataFrame(rows, "source string, target string, sourceType string, targetType string, "
                                      "reltype struct<name:string,type:string>, arrival long")
    for some in (raw, raw.drop("arrival"), raw.drop("sourceType"), raw.drop("reltype", "sourceType", "targetType"), raw.limit(0)):
        want, got = ingest.linking(ingest.map_relations(some)), ingest.map_links(some)
        assert got.columns == want.columns and order(got) == order(want)
    # below the join no text of a row is stripped, only those of the combinations
    side = plan(ingest.map_links(raw)).split("Join Inner")[1].split("LogicalRDD")[0]
    assert "trim(" not in side and "trim(" in plan(ingest.linking(ingest.map_relations(raw))).split("LogicalRDD")[0]


def test_entities_of_one_row_are_not_aggregated(spark):
    schema = "researcher_id string, full_name string, given_name string, orcid string, arrival long"
    rows = [(f"r{i}", f"N{i}", None if i % 2 else "g", f"o{i % 7}", i) for i in range(40)]
    several = [("r1", "M1", "h", None, 90), ("r1", None, None, "o1", 91), (None, "x", "y", None, 92), (None, None, "z", "o99", 93),
               ("late", "L", "l", None, None)]
    old = spark.createDataFrame([("r3", "old", None, "o5"), ("alone", "A", "a", "o6")], "researcher_id string, full_name string, given_name string, orcid string")
    how = {"overwrite": ("given_name",), "first_only": ("full_name",), "unique": ("orcid",)}
    single = spark.createDataFrame(rows, schema)
    assert "max_by" not in plan(ingest.upsert(old, single, "researcher_id", overwrite=("given_name",)))
    mixed = spark.createDataFrame(rows + several, schema)
    one, every = ingest.upsert(old, mixed, "researcher_id", **how), ingest.upsert(old, mixed, "researcher_id", **how, shared=0)
    assert order(one) == order(every) and one.count() == 43
    assert order(ingest.upsert(old, single, "researcher_id", **how)) == order(ingest.upsert(old, single, "researcher_id", **how, shared=-1))


def test_records_without_a_shared_key_are_not_joined(spark):
    recs = spark.createDataFrame([(i, "r", "p", f"k{i}", "{}") for i in range(20)],
                                 "record_id long, ingestion_run_id string, entity_type string, source_identifier string, raw_payload string")
    out = provenance.dedupe_source_records(recs)
    assert "Join" not in plan(out) and "Union" not in plan(out)
    assert order(out) == order(provenance.dedupe_source_records(recs, shared_keys=-1).select(*out.columns))


def test_a_load_deletes_its_steps(spark):
    """Entities found, authors, places and mapped batches are gone once the tables made of them are written."""
    before = set(children(spark, checkpoint_root(spark)))
    raw = spark.createDataFrame(
        [(i, f"O:{i}", f"Paper {i}", [(f"Ann {i % 3}", 1), ("Bob", 2)]) for i in range(1, 9)],
        "arrival long, id string, maintitle string, author array<struct<fullname:string,rank:bigint>>").withColumns({
            "pid": F.array().cast("array<struct<scheme:string,value:string>>"), "originalId": F.array(F.col("id"))})
    tables, _ = load.run_load(spark, {"publications": raw})
    assert tables["publication"].count() == 8 and tables["researcher"].count() == 4 and tables["publication_author"].count() == 16
    root = checkpoint_root(spark)
    new = [f"{root}/{n}" for n in children(spark, root) if n not in before]
    assert not any("/entities-" in n for n in new)
    kept = {t._round_path.rpartition("/")[2] for t in tables.values() if "/load-" in getattr(t, "_round_path", "")}
    assert {n for at in new if "/load-" in at for n in children(spark, at)} == kept


def test_a_first_batch_searches_nothing(spark, tmp_path):
    log = stream.table_log(spark, str(tmp_path / "t"))
    found = stream._touched(log, log.latest(), {}, spark.createDataFrame([], stream.WAITING_SCHEMA), Rounds(spark, "t"))
    assert set(found) == set(load.TABLES) and all(has_none(df) and df.count() == 0 for df in found.values())
    none = Rounds(spark, "t").kept(spark.range(5).where("id > 9"))
    assert has_none(none) and none.columns == ["id"] and none.count() == 0 and "Relation" in plan(none)
    assert not has_none(Rounds(spark, "t").kept(spark.range(5)))


def test_a_batch_of_one_file_is_dealt_to_all_tasks(spark, tmp_path, monkeypatch):
    read, run = {}, load.run_load

    def kept(session, inputs, *rest, **more):
        read.update({n: len([f for f in children(spark, df._round_path) if f.endswith(".parquet")]) for n, df in inputs.items()})
        return run(session, inputs, *rest, **more)

    monkeypatch.setattr(load, "run_load", kept)
    raw = spark.range(2_000).coalesce(1).select(
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), F.lit("t").alias("target"),
        F.lit("organization").alias("sourceType"), F.lit("result").alias("targetType"), F.lit("affiliation").alias("reltype"))
    log = stream.table_log(spark, str(tmp_path / "t"))
    at = stream.load_batch(log, {"relations": raw}, "solo", {"s": 0})
    assert read["relations"] >= spark.sparkContext.defaultParallelism > 1
    assert log.table("source_record", at).count() == log.table(stream.WAITING, at).count() == 2_000
