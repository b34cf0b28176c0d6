"""Scores inside a window are taken a slab at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa

from paperweave.operators import semantic


def test_window_of_two_blocks_holds_one_slab():
    """8,192 rows: one slab of scores and its copies, not 8,192 x 8,192 of them; equal to all scores at once."""
    rows = np.random.default_rng(3).normal(size=(2 * semantic.BLOCK_ROWS, 16))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    ids = np.arange(len(rows))
    tracemalloc.start()
    got = semantic._best_inside(ids, rows, 6, 0.3, pa.int64())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    few = rows[:1500]
    scores = few @ few.T
    want = semantic._hits(ids[:1500], ids[:1500], scores, *semantic._best(scores, ids[:1500], 6, 0.3), pa.int64())
    assert semantic._best_inside(ids[:1500], few, 6, 0.3, pa.int64()).to_pylist() == want.to_pylist()
    assert got.num_rows > len(rows)
