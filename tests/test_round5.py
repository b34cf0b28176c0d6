"""Betweenness by blocks of nodes and sources."""

import random
import re

import pytest

from paperweave.operators import centrality
from paperweave.session import Rounds
from tests.test_round3 import plain_betweenness


def test_betweenness_never_writes_pairs_of_a_source_and_an_edge(spark, monkeypatch):
    """Several blocks and batches, against a plain version; tables written hold a row per node and block, not per source and edge."""
    random.seed(9)
    ids = [f"n{i:03}" for i in range(90)]
    pairs = [(a, b, random.randint(1, 4)) for i, a in enumerate(ids) for b in ids[i + 1:] if random.random() < 0.3]
    edges = spark.createDataFrame(pairs, "source string, target string, weight long")
    nodes = spark.createDataFrame([(i,) for i in [*ids, "alone", None]], "id string")
    sizes, measure = [], Rounds.measure

    def counted(self, df, **metrics):
        out = measure(self, df, **metrics)
        sizes.append(out[0].count())
        return out

    monkeypatch.setattr(Rounds, "measure", counted)
    rows = centrality.betweenness(nodes, edges, normalized=False, width=32, state_rows=15_000).collect()
    scale = 91 * 90 / 2
    want = {i: x * (len(ids) - 1) * (len(ids) - 2) / 2 for i, x in plain_betweenness(ids, pairs).items()}
    assert {r.id: r.betweenness for r in rows} == pytest.approx({**want, "alone": 0.0, None: 0.0}) and max(want.values()) > scale / 100
    assert max(sizes) <= 4 * len(pairs)


def test_source_records_are_sorted_by_a_number(spark):
    """Keys begin alike; the aggregate's sort goes by their hash, and a checksum is the kept payload's."""
    import hashlib

    from paperweave.operators.provenance import dedupe_source_records

    recs = spark.createDataFrame(
        [(2, "r", "p", None, "b"), (1, "r", "p", None, "a"), (4, "r", "p", "x", "c"), (3, "r", "p", "x", "c"), (5, "r", "q", "x", None)],
        "record_id long, ingestion_run_id string, entity_type string, source_identifier string, raw_payload string")
    out = dedupe_source_records(recs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((r.record_id, r.checksum, r.arrivals, r.payload_changed) for r in out.collect()) == [
        (1, sha("a"), 2, True), (3, sha("c"), 2, False), (5, None, 1, None)]
    assert out.columns == ["ingestion_run_id", "entity_type", "source_identifier", "record_id", "raw_payload", "checksum",
                           "arrivals", "payload_changed"]
    sorts = [line for line in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "SortAggregate" in line]
    assert sorts and all(re.search(r"key=\[_\w+#\d+L, ", line) for line in sorts)


def test_packing_encodes_odd_words_in_bounded_calls(monkeypatch):
    """Words that are not letters and marks go to the tokenizer a bounded number at a time, with the ids of single calls."""
    import public_tokenizers

    from paperweave.llm import swap_packing

    encoder = swap_packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    odd = [f"{i}x{i * 7}" for i in range(50)] + ["a-b", "", "ein-zwei"]
    one_by_one = [encoder._bytes([w])[0] for w in odd]
    calls, plain = [], encoder._bytes
    monkeypatch.setattr(swap_packing, "WORDS_AT_ONCE", 8)
    monkeypatch.setattr(encoder, "_bytes", lambda texts: calls.append(len(texts)) or plain(texts))
    assert encoder.words(odd) == one_by_one
    assert max(calls) <= 8
