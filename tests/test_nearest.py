"""Pruned neighbour search within a block gives what all distances give, and measures fewer."""

import numpy as np
import pytest

from tabloom.operators import blocks


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_pruned_is_whole(monkeypatch, metric):
    rng = np.random.default_rng(0)
    for a, b in (
        (rng.normal(size=(700, 3)) * [5, 1, 0.01], rng.normal(size=(4000, 3)) * [5, 1, 0.01]),
        (rng.integers(0, 9, (600, 2)).astype(float), rng.integers(0, 9, (3000, 2)).astype(float)),
        (rng.normal(size=(80, 40)), rng.normal(size=(2500, 40))),
        (np.full((5, 2), 3.0), np.append(np.zeros((2999, 2)), [[3.0, 3.0]], 0)),
        (np.full((2, 1), 1e200), np.linspace(0, 1e200, 3000)[:, None]),
    ):
        for got, want in zip(blocks.nearest(a, b, 4, metric), blocks._all_nearest(a, b, 4, metric)):
            assert np.array_equal(got, want)


def test_fewer_pairs_are_measured(monkeypatch):
    rng, plain, cells = np.random.default_rng(1), blocks._all_nearest, []
    monkeypatch.setattr(blocks, "_all_nearest", lambda a, b, *more: cells.append(len(a) * len(b)) or plain(a, b, *more))
    a, b = rng.random((2000, 1)), rng.random((8000, 1))
    assert len(blocks.nearest(a, b, 3, "euclidean")[0]) == 6000
    assert sum(cells) < 0.1 * len(a) * len(b)
