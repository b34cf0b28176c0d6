"""Blocks of vectors meet in slabs, in tasks of their own."""

import tracemalloc

import numpy as np
import pyarrow as pa

from paperweave.operators import semantic


def test_blocks_meet_in_slabs_and_in_tasks_of_their_own(spark):
    rng = np.random.default_rng(5)
    a, b = (rng.normal(size=(semantic.BLOCK_ROWS, 8)) for _ in range(2))
    tracemalloc.start()
    found = semantic._best_among(np.arange(len(a)), a, np.arange(len(b)), b, 5, 0.0, pa.int64())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 5 * len(a) and peak < 100e6
    rows = rng.normal(size=(120, 4)).round(1)
    rows[7] = rows[80] = rows[3]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, embedding array<double>")
    hits = semantic._exact_hits(df, 6, 0.2, 20)
    assert hits.rdd.getNumPartitions() == 21
    got = {(r.source, r.rank): (r.target, r.score) for r in semantic.knn(df, 5, 0.2, block_rows=20).collect()}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    want = {}
    for i in range(len(rows)):
        near = sorted((-scores[i, j], j) for j in range(len(rows)) if scores[i, j] >= 0.2)[:20]
        for rank, (s, j) in enumerate([x for x in near if x[1] != i][:5], 1):
            want[i, rank] = (j, -s)
    assert got == want


def test_the_best_scores_are_those_of_all_rounded_scores():
    rng = np.random.default_rng(6)
    scores = np.concatenate([rng.normal(size=(40, 90)).round(1), rng.normal(size=(40, 90))], axis=0)
    scores[3, 5:20] += 1e-12
    ids = rng.permutation(90)
    for m, threshold in ((1, -9.0), (7, 0.0), (90, 0.5), (200, -9.0)):
        row, col = semantic._best(scores, ids, m, threshold)
        want = []
        for i in range(len(scores)):
            listed = sorted((-round(scores[i, j], 9), ids[j], j) for j in range(90) if scores[i, j] >= threshold)
            want += [(i, j) for _, _, j in listed[:m]]
        assert list(zip(row.tolist(), col.tolist())) == want
