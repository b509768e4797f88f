"""What a task holds of a column does not grow with its part of the table, and merging many chunks keeps ranks close."""

import numpy as np

from tablewright.functions import quantiles as Q


def test_chunks_are_small_whatever_the_part():
    largest = []
    chunks = Q._Chunks(lambda key, x, weights: largest.append(len(x)))
    for _ in range(40):
        chunks.add(0, np.zeros(10_000), None)
    chunks.finish()
    assert max(largest) * 8 < 1 << 21 and sum(largest) == 400_000


def test_error_of_many_chunks_is_added_once_per_level(monkeypatch):
    monkeypatch.setattr(Q, "SIZE", 64)
    x = np.random.default_rng(3).permutation(200 * 128).astype(float)
    levels = []
    for part in np.split(x, 200):
        Q.add_summary(levels, Q.Summary.of(part))
    assert all(len(own) < 16 for own in levels) and len(levels) == 2
    whole = Q.merged(s for own in levels for s in own)
    assert whole.n == len(x) and whole.error <= 4 * len(x) // 64
    for rank in (0, 5_000, 12_800, len(x) - 1):
        low, high = whole.bracket(rank)
        assert low <= rank <= high
