"""Long documents and conversations, many blocks of counts, and uneven samples against plain versions."""

from __future__ import annotations

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from paperweave.llm import chat_windows, cross_parse, deleted_lm, line_spread, pivot_index

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_documents_of_many_shared_lines(spark):
    shared = [f"shared {k}" for k in range(16_000)]
    rows = [(i, "\n".join([f"own {i}", *shared, f"end {i}"]), None, f"s{i}", 0) for i in range(12)]
    start = time.perf_counter()
    out = {r.doc_id: r for r in line_spread.remove_boilerplate(spark.createDataFrame(rows, DOCS).repartition(4)).collect()}
    assert time.perf_counter() - start < 60
    assert out[0].text == rows[0][1] and out[0].n_removed == 0
    assert all(out[i].text == f"own {i}\nend {i}" and out[i].n_removed == 16_000 and out[i].n_lines == 16_002 for i in range(1, 12))


def test_lines_of_repeated_ids(spark):
    rows = [(i, "x\nwide\n \ny\n wide", None, f"s{i}", 0) for i in range(10)]
    rows += [(5, "wide\nother", None, "s5", 0), (5, "wide\nother", None, "s5", 0), (6, "wide", None, "s6", 0), (7, None, None, "s7", 0)]
    out = line_spread.remove_boilerplate(spark.createDataFrame(rows, DOCS).drop("lang")).collect()
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out)
    want = Counter((i, "x\nwide\n \ny\n wide", 5, 0) if i == 0 else (i, " ", 5, 4) for i in range(10))
    want += Counter([(5, "other", 2, 1)] * 2 + [(6, "", 1, 1), (7, None, 0, 0)])
    assert got == want


def plain_windows(turns, tokens, budget):
    """(block, window, repeated, turns held) of one conversation's (turn, role, text) in order."""
    blocks = [t[0] // chat_windows.BLOCK_TURNS for t in turns]
    system = next((i for i, t in enumerate(turns) if t[1] == "system"), len(turns))
    out, start = [], 0
    while start < len(turns):
        lead = start
        while lead > max(0, start - 2) and sum(tokens[lead - 1:start]) <= 512:
            lead -= 1

        def head(lead):
            return [system] if system < lead else []

        def cost(lead, end):
            return sum(tokens[i] for i in head(lead)) + sum(tokens[lead:end])

        while lead < start and cost(lead, start + 1) > budget:
            lead += 1
        end = start + 1
        while end < len(turns) and blocks[end] == blocks[start] and cost(lead, end + 1) <= budget:
            end += 1
        held = head(lead) + list(range(lead, end))
        number = sum(b == blocks[start] for b, *_ in out)
        out.append((blocks[start], number, len(held) - (end - start), [turns[i][1:] for i in held]))
        start = end
    return out


def test_windows_of_long_conversations(spark):
    rng = random.Random(4)
    convs = {}
    for conv in range(5):
        size = {0: 700, 1: 1, 2: 3}.get(conv, 600)
        own = []
        for i in range(size):
            role = "system" if i == {0: 300, 3: 0}.get(conv) else ("user", "assistant")[i % 2]
            words = rng.choice([0, 3, 40, 40, 200, 700]) if i % 97 else 3_000
            text = "漢字仮名" * words if conv == 4 else " ".join(rng.choice(["ok", "</s>", "tiles", "<|x|>", "é"]) for _ in range(words))
            own.append((i * 3 if conv == 3 else i, role, text))
        convs[conv] = own
    convs[9] = [(-1, "user", f"t {i} " * 50) for i in range(400)]  # one turn number for all
    rows = [(conv, *t) for conv, own in convs.items() for t in own]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in chat_windows.chat_windows(frame, budget=1_000).collect():
        got.setdefault(r.conv_id, []).append(((r.block, r.window), r.repeated, r.text))
    for conv, own in convs.items():
        own = sorted(own)
        tokens = [len(tokenizer.encode(chat_windows._window([t[1:]], 0)[0], add_special_tokens=False).ids) for t in own]
        want = [((b, k), repeated, chat_windows._window(held, repeated)[0])
                for b, k, repeated, held in plain_windows(own, tokens, 1_000)]
        assert sorted(got[conv]) == want
    cut = [w for w in got[0] if w[0][0] > 0 and w[0][1] == 0]
    assert cut and all(w[1] > 0 for w in cut)  # history crosses the cut


def plain_lm(texts):
    """Scores by a bigram model with deleted interpolation, exact logarithms throughout."""
    tokens = {i: re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) + [None] for i, t in texts.items()}
    fold = {i: zlib.crc32(str(i).encode()) % 7 for i in texts}

    def counts(keep):
        words = Counter(t for i, ts in tokens.items() if keep(fold[i]) for t in ts)
        return words, Counter(p for i, ts in tokens.items() if keep(fold[i]) for p in zip([None, *ts], ts))

    def parts(model, total, types, pair):
        words, pairs = model
        before = words[pair[0]]
        return np.array([pairs[pair] / before if before else 0, words[pair[1]] / total, 1 / (types + 1)])

    def bucket(n):
        return int(math.log2(n)) + 1 if n else 0

    part, whole = counts(lambda f: f not in (2, 3)), counts(lambda f: f != 2)
    types = len(whole[0])
    held = [p for i, ts in tokens.items() if fold[i] == 3 for p in zip([None, *ts], ts)]
    total = sum(part[0].values())
    shares = np.array([parts(part, total, types, p) for p in held])
    of = np.array([bucket(part[0][p[0]]) for p in held])

    def em(rows, bigram):
        w = np.array([0.4 if bigram else 0, 0.4, 0.2])
        w /= w.sum()
        for _ in range(100):
            each = rows * w
            w = (each / each.sum(axis=1, keepdims=True)).mean(axis=0)
        w = np.maximum(w, 1e-9)
        if not bigram:
            w[0] = 0
        return w / w.sum()

    every = em(shares, True)
    weights = {b: em(shares[of == b], b > 0) for b in set(of.tolist())}
    weights.setdefault(0, np.array([0, *every[1:]]) / every[1:].sum())
    n = sum(whole[0].values())
    return {i: sum(math.log10(parts(whole, n, types, p) @ weights.get(bucket(whole[0][p[0]]), every))
                   for p in zip([None, *ts], ts)) for i, ts in tokens.items()}


def test_scores_against_a_plain_model_at_every_number_of_levels(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(words[min(399, int(rng.expovariate(0.02)))] for _ in range(rng.randrange(0, 300))) for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want = plain_lm(texts)
    seen = []
    for sizes in ({}, {"block_tokens": 700, "range_tokens": 800, "fan": 2}, {"block_tokens": 500, "range_tokens": 100, "fan": 8}):
        out = {r.doc_id: r for r in deleted_lm.score_documents(docs, **sizes).collect()}
        assert set(out) == set(want)
        assert all(r.score == pytest.approx(want[i], rel=5e-3) for i, r in out.items())
        seen.append({i: (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for i, r in out.items()})
    assert seen[0] == seen[1] == seen[2]


def test_asked_rows_grow_with_the_blocks(spark):
    """A block asks at most `fan` ranges, whatever the number of blocks."""
    rows = [(i, " ".join(f"w{(i * 7919 + k * k) % 5000}" for k in range(200)), 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind int").repartition(4)
    blocks = deleted_lm.token_blocks(docs, 500).cache()
    assert blocks.count() > 100
    most = deleted_lm.ask(blocks, 3).groupBy("block", "n").count().agg({"count": "max"}).first()[0]
    assert most <= 8
    blocks.unpersist()


def test_longer_models_pay_for_their_length():
    rng = random.Random(3)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    few = pd.DataFrame({"rank": range(2), "text": [text("abcdefgh ", 160) for _ in range(2)], "lang": "few"})
    many = pd.DataFrame({"rank": range(96), "text": [text("abcdefgh ", 160) for _ in range(96)], "lang": "many"})
    parser = cross_parse.Parser(pd.concat([cross_parse._edges(few), cross_parse._edges(many)]))
    found, size, _ = parser.phrases([text("abcdefgh ", 4_000)])
    assert found[0, 0] > 1.4 * found[0, 1]  # a longer model holds longer matches of the same noise
    bits = found[0] * parser.cost
    assert bits[0] / bits[1] < 1.15  # normalised, neither is much nearer
    out = parser.judge([text("abcdefgh ", 400), "", "123"])
    assert out["lang_pred"].tolist()[1:] == ["und", "und"] and 0 <= out["score"][0] <= 0.25


def test_number_of_reference_points():
    assert [pivot_index.pivots_for(n) for n in (0, 50_000, 1_000_000, 10**9)] == [1024, 1024, 4000, 16_384]
