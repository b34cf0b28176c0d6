"""Numbered bad lines, archives with bad lines, repeated builds, betweenness in batches."""

import gzip
import heapq
import io
import json
import tarfile

import pytest

import oracle
from paperweave.operators import centrality
from paperweave.plans import load_all
from paperweave.plans.graph_queries import edges_of, people_of
from paperweave.plans.views import Views
from paperweave.sources import builds, readers, schemas

load_all()


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    """A plain file cut into many blocks, and a gzipped one that cannot be."""
    texts = {"plain.txt": [json.dumps({"id": f"x{i}", "legalname": "n" * (i % 50)}) for i in range(900)],
             "packed.txt.gz": [json.dumps({"id": "a"}), "", "{bad", json.dumps({"id": "b"}), "[]x"]}
    texts["plain.txt"][7] = texts["plain.txt"][500] = '{"id": "cut'
    texts["plain.txt"][100] = "  "
    (tmp_path / "plain.txt").write_text("\n".join(texts["plain.txt"]) + "\n")
    with gzip.open(tmp_path / "packed.txt.gz", "wt") as out:
        out.write("\n".join(texts["packed.txt.gz"]))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        every = readers.numbered_lines(spark, str(tmp_path))
        assert every.rdd.getNumPartitions() > 2
        got = {(r.source_file.rsplit("/", 1)[1], r.line_number): r.line for r in every.collect()}
        assert got == {(name, k): line for name, lines in texts.items() for k, line in enumerate(lines, 1)}
        bad = readers.malformed_lines(spark, str(tmp_path), schemas.ORGANIZATION)
        assert {(r.source_file.rsplit("/", 1)[1], r.line_number) for r in bad.collect()} == {
            ("plain.txt", 8), ("plain.txt", 501), ("packed.txt.gz", 3), ("packed.txt.gz", 5)}
        report = {r.source_file.rsplit("/", 1)[1]: r for r in readers.malformed_report(bad).collect()}
        assert report["plain.txt"][1:] == (2, 8, '{"id": "cut') and report["packed.txt.gz"].first_line == 3
    finally:
        spark.conf.set(key, before)


def test_archives_set_bad_lines_aside(spark, tmp_path):
    path = tmp_path / "dump.tar"
    with tarfile.open(path, "w") as tar:
        for name, body in (("x/part-0.json", b'{"id":"a"}\n\n{"id": \n{"id":"b"}'), ("x/part-1.json", b'{"id":"c\xff"}\nnothing')):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    good, bad = readers.split_members(readers.read_archives(spark, [str(path)], schemas.ORGANIZATION, "QUARANTINE"))
    assert sorted((r.member, r.line_number, r.id) for r in good.collect()) == [
        ("x/part-0.json", 1, "a"), ("x/part-0.json", 4, "b"), ("x/part-1.json", 1, "c�")]
    report = {r.source_file.split("!")[1]: tuple(r)[1:] for r in readers.malformed_report(bad).collect()}
    assert report == {"x/part-0.json": (1, 3, '{"id": '), "x/part-1.json": (1, 2, "nothing")}
    with pytest.raises(Exception):
        readers.read_archives(spark, [str(path)], schemas.ORGANIZATION).collect()


def test_a_build_written_again_replaces_itself(spark, tmp_path):
    nodes = spark.range(3)
    edges = spark.createDataFrame([(0, 1)], "source long, target long")
    summary = spark.createDataFrame([(3, 1)], "node_count long, edge_count long")
    for name in ("one", "two", "one"):
        builds.write_build(nodes, edges, summary, str(tmp_path), name, as_json=True)
    for part, n in (("nodes", 3), ("edges", 1), ("summary", 1)):
        stored = spark.read.parquet(f"{tmp_path}/{part}").groupBy("build_id").count()
        assert {tuple(r) for r in stored.collect()} == {("one", n), ("two", n)}
        assert spark.read.json(f"{tmp_path}/{part}_json").count() == 2 * n


def plain_betweenness(ids, edges):
    """Brandes (2001) with weights as lengths."""
    ways = {i: [] for i in ids}
    for a, b, w in edges:
        ways[a].append((b, w))
        ways[b].append((a, w))
    total = dict.fromkeys(ids, 0.0)
    for s in ids:
        dist, sigma, before, order, done = {s: 0}, dict.fromkeys(ids, 0.0), {i: [] for i in ids}, [], set()
        sigma[s], heap = 1.0, [(0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            order.append(u)
            for v, w in ways[u]:
                if v not in dist or d + w < dist[v]:
                    dist[v], sigma[v], before[v] = d + w, sigma[u], [u]
                    heapq.heappush(heap, (d + w, v))
                elif d + w == dist[v]:
                    sigma[v] += sigma[u]
                    before[v].append(u)
        delta = dict.fromkeys(ids, 0.0)
        for v in reversed(order):
            for u in before[v]:
                delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
            if v != s:
                total[v] += delta[v] / 2
    scale = (len(ids) - 1) * (len(ids) - 2) / 2
    return {i: x / scale for i, x in total.items()}


def test_betweenness_of_coauthors_in_batches_of_sources(spark):
    v = Views(spark, f"{oracle.ROOT}/sf0.001")
    people, edges = people_of(v).cache(), edges_of(v).cache()
    want = plain_betweenness([r.id for r in people.collect()], [(r.source, r.target, r.weight) for r in edges.collect()])
    got = {r.id: r.betweenness for r in centrality.betweenness(people, edges, state_rows=2_000_000).collect()}
    assert got == pytest.approx(want) and max(want.values()) > 0
