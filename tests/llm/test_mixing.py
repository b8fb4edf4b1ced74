"""Pivotal rounding: every document keeps its expectation, at one level and across levels of the tree."""

import numpy as np
import pytest

from auditlake.llm import mixing


def tie_of(n):
    return mixing._mixed(np.arange(1, n + 1, dtype=np.uint64)).view(np.int64)


def included(size, part, seed, chunk):
    """The tree of mixture(), without Spark."""
    tie, out, rows, level = tie_of(len(size)), part.astype(float), np.arange(len(size)), 0
    while True:
        groups = [rows[k : k + chunk] for k in range(0, len(rows), chunk)]
        for g in groups:
            out[g] = mixing.round_pairs(size[g], out[g], tie[g], seed, level)
        rows = np.concatenate([g[(out[g] > 0) & (out[g] < 1)] for g in groups])
        if len(groups) == 1:
            break
        level += 1
    for r in rows:
        t = tie[[r]].view(np.uint64)
        out[r] = mixing._drawn(seed, level + 1, 0, t, t)[0] < out[r]
    return out


@pytest.mark.parametrize("chunk", [1 << 20, 8])
@pytest.mark.parametrize("sizes", ["equal", "mixed"])
@pytest.mark.parametrize("n,p", [(8, 0.3), (64, 0.1), (33, 0.77)])
def test_expectations_stay(n, p, sizes, chunk):
    size = np.full(n, 10) if sizes == "equal" else np.sort(np.random.default_rng(n).integers(1, 60, n))[::-1].copy()
    seeds = 2000
    runs = np.array([included(size, np.full(n, p), seed, chunk) for seed in range(seeds)])
    assert set(np.unique(runs)) <= {0.0, 1.0}
    error = np.sqrt(p * (1 - p) / seeds)
    assert np.abs(runs.mean(axis=0) - p).max() < 4.2 * error
    assert np.abs(runs @ size - p * size.sum()).max() <= size.max()
