"""The pipeline's near copies against brute-force Jaccard similarity of whole shingle sets."""

import random

import numpy as np

from paperweave.llm import anchor_simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def brute(texts, similarity=0.8):
    """Smallest linked id per id, and similarities of all pairs from 0.6 on."""
    sets, root, seen = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}, []

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(texts):
        for j in sorted(texts):
            if j >= i:
                break
            common = len(sets[i] & sets[j])
            value = common / (len(sets[i]) + len(sets[j]) - common)
            if value >= 0.6:
                seen.append(value)
            if value >= similarity:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}, seen


def near_copies(pairs=120):
    """Texts of 150 words, each with a copy of which one to ten words are changed, far from each other."""
    rng = random.Random(3)
    texts = {}
    for k in range(pairs):
        words = [f"w{rng.randrange(50_000)}" for _ in range(150)]
        texts[2 * k] = " ".join(words)
        for at in rng.sample(range(0, 150, 5), 1 + k % 10):
            words[at] = f"x{rng.randrange(50_000)}"
        texts[2 * k + 1] = " ".join(words)
    return texts


def test_links_are_exact(spark):
    texts = near_copies()
    want, seen = brute(texts)
    assert sum(0.8 <= x < 0.87 for x in seen) >= 10 and sum(0.6 <= x < 0.8 for x in seen) >= 30
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in anchor_simhash.similar_groups(docs, 5, 0.8).collect()}
    assert got == want
    kept = {r.doc_id for r in anchor_simhash.keep_first(docs).collect()}
    assert kept == {i for i in want if want[i] == i}


def test_repeated_lines_do_not_hide_other_words(spark):
    """Equal fingerprints of texts that repeat one line are no proof: their sets differ."""
    line = "one line that comes again and again "
    texts = {1: line * 200 + "alpha beta gamma delta epsilon zeta eta theta", 2: line * 200 + "iota kappa lambda mu nu xi omicron pi"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in anchor_simhash.similar_groups(docs, 5, 0.8).collect()} == {1: 1, 2: 2}


def test_blocks_of_a_crowd(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(150), 1 + k % 4):
            words[at] = f"x{rng.randrange(1_000)}"
        texts[k] = " ".join(words)
    want, _ = brute(texts)
    assert 1 < len(set(want.values())) < 60
    monkeypatch.setattr(anchor_simhash, "BLOCK_SHINGLES", 1_500)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in anchor_simhash.similar_groups(docs, 5, 0.8).collect()} == want


def test_similarity_at_the_bound_links():
    sets = [np.arange(0, 9), np.arange(1, 10), np.arange(100, 104), np.arange(100, 105), np.arange(200, 203), np.arange(200, 204)]
    assert anchor_simhash.jaccard_roots(sets, 0.8).tolist() == [0, 0, 2, 2, 4, 5]
