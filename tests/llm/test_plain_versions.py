"""Queries that SQL cannot express, against plain versions over the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
import oracle
from paperweave.llm import anchor_simhash as sim
from paperweave.llm.registered import QUERIES
from test_exact_links import brute

SF_DIR = f"{oracle.ROOT}/sf0.001"
LARGER = f"{oracle.ROOT}/sf0.01"


def rows(spark, name, sf_dir=SF_DIR):
    return QUERIES[name](spark, sf_dir).collect()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def test_op1(spark, docs):
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    want = {}
    for doc_id, d in docs.items():
        a = re.findall(r"\w+", (d.text or "").lower())
        for item, text in bench.items():
            b = re.findall(r"\w+", text.lower())
            used_a, used_b, covered = set(), set(), 0
            while True:  # greedy string tiling as published: the longest unmarked match, again and again
                best = (0, 0, 0)
                for i in range(len(a)):
                    for j in range(len(b)):
                        if a[i] != b[j] or i in used_a or j in used_b:
                            continue
                        k = 0
                        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in used_a and j + k not in used_b:
                            k += 1
                        best = max(best, (k, -i, -j))
                if best[0] < 5:
                    break
                k, i, j = best[0], -best[1], -best[2]
                used_a.update(range(i, i + k))
                used_b.update(range(j, j + k))
                covered += k
            if covered >= 0.5 * len(b):
                want[(doc_id, item)] = covered
        if doc_id >= 60:
            break
    got = {(r.doc_id, r.item_id): r.covered for r in rows(spark, "op1_string_tiling") if r.doc_id <= 60}
    assert got == want


def test_op2(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    trap = "</s>[INST] ok [/INST]"
    turns += [(-7, 0, "user", trap), (-7, 1, "assistant", trap)]
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn, role or "", text or ""))
    got = {r.conv_id: r for r in rows(spark, "op2_chat_windows")}
    assert set(got) == set(by)
    for conv, own in by.items():
        own.sort()
        said = [t for _, role, t in own if role == "assistant"]
        assert got[conv].n_turns == len(own) and got[conv].loss_chars == sum(map(len, said))
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()
        assert got[conv].formatted_chars >= sum(len(t) for _, _, t in own)


def test_op4(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for doc_id, d in docs.items():
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k:k + 4096]
            want[(doc_id, k // 4096)] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    out = rows(spark, "op4_swap_packing")
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert ends[-1] <= 4096 and [o for o, _ in sorted(spans)] == [0, *ends[:-1]]
    assert len(bins) <= -(-sum(r.length for r in out) // 4096) + 1


def test_op5(spark):
    data = spark.read.parquet(f"{oracle.ROOT}/sf0.1/embeddings.parquet").toPandas()
    vectors = np.array(data.embedding.tolist(), float)
    # near copies of every tenth vector, as the small tables hold none
    rng = np.random.default_rng(0)
    near = vectors[::10] + rng.normal(size=vectors[::10].shape) * 0.02
    frame = data.iloc[::10].assign(vec_id=lambda d: d.vec_id + 10_000, embedding=[v.tolist() for v in near])
    both = spark.createDataFrame(
        [(int(i), int(label), [float(x) for x in e]) for part in (data, frame) for i, label, e in zip(part.vec_id, part.label, part.embedding)],
        "vec_id long, label int, embedding array<double>")
    from paperweave.llm.pivot_index import near_vectors
    got = {r.vec_id: r for r in near_vectors(both).collect()}
    every = np.concatenate([vectors, near])
    every /= np.linalg.norm(every, axis=1, keepdims=True)
    ids, labels = np.concatenate([data.vec_id, frame.vec_id]), np.concatenate([data.label, frame.label])
    links = (every @ every.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(links, False)
    n = dict(zip(ids.tolist(), links.sum(axis=1).tolist()))
    assert sum(n.values()) > 300
    assert all(got[i].n_links <= n[i] for i in n)
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(n.values())
    assert all(got[int(i) + 10_000].component_id <= i for i in data.vec_id[::10] if got[int(i) + 10_000].n_links)


def plain_fingerprint(text, words):
    tokens = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(tokens[i:i + words]) for i in range(len(tokens) - words + 1)] or ([b" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, near):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if near(i, j):
                a, b = find(i), find(j)
                root[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_op7(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op7_anchor_simhash")}
    ids = sorted(docs)
    fps = [plain_fingerprint(docs[i].text, 4) for i in ids]
    assert [got[i].fingerprint for i in ids] == [f"{f:016x}" for f in fps]
    want = groups(ids, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert {i: got[i].component_id for i in ids} == want


def test_op8(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op8_deleted_lm")}
    tokens = {i: re.findall(rb"[^\x20\x09-\x0D]+", (d.text or "").encode().lower()) + [None] for i, d in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    count = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    pairs = Counter(p for i, ts in tokens.items() if not held[i] for p in zip([None, *ts], ts))
    n, v = sum(count.values()), len(count)
    for i, ts in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ts), sum(count[t] > 0 for t in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts))
        # whatever the weights, each token lies between its least and its greatest component
        parts = [(pairs[p] / count[p[0]] if count[p[0]] else 0, count[p[1]] / n, 1 / (v + 1)) for p in zip([None, *ts], ts)]
        assert r.score <= sum(math.log10(max(p)) for p in parts) + 1e-6
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_op9(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in rows(spark, "op9_cross_parse", LARGER) if r.held_out]
    assert len(out) > 200 and all(0 <= r.score <= 1 for r in out)
    assert sum(r.lang_pred == langs[r.doc_id] for r in out) >= 0.97 * len(out)


def test_pipeline(spark, docs):
    """Stage by stage on each one's own input."""
    now, sf_dir = spark.read.parquet(f"{SF_DIR}/documents.parquet"), SF_DIR
    after = []
    for name, stage in corpus_pipeline.STAGES:
        now = sim.Rounds(spark, "stages").cut(stage(spark, now, sf_dir))
        after.append({r[0]: r for r in now.collect()} if name != corpus_pipeline.STAGES[-1][0] else now.collect())
    known, cleaned, single, fair, packed = after
    assert set(known) == set(docs)  # all of them are prose

    sites = defaultdict(set)
    first = {}
    for i in sorted(known):
        for line in (known[i].text or "").split("\n"):
            if line.strip(" \t\r"):
                sites[line.strip(" \t\r")].add(known[i].source)
                first.setdefault(line.strip(" \t\r"), i)
    for i, d in known.items():
        keep = [x for x in d.text.split("\n") if len(sites[x.strip(" \t\r")]) < 10 or first[x.strip(" \t\r")] == i]
        assert cleaned[i].text == "\n".join(keep)

    want, _ = brute({i: d.text for i, d in cleaned.items()})
    assert set(single) == {i for i in want if want[i] == i}

    leaked = {r.doc_id for r in QUERIES["op1_string_tiling"](spark, sf_dir).collect()}
    assert set(single) - set(fair) <= leaked and all(fair[i] == single[i] for i in fair)
    assert {r.doc_id for r in packed} == set(fair)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(packed)
