"""Filing of vectors at sizes that no test table has: shapes, lists, recall."""

from math import comb

import numpy as np
import pytest

from ledgerproof.llm import embeddings


def test_lists_stay_short_at_any_size():
    """The mean length of a list doesn't grow with the table, nor do the rows that file a vector beyond those of triples."""
    means = []
    for n in (10_000, 50_000, 65_536, 65_537, 200_000, 1_000_000, 4_000_000, 5_000_000, 10**8, 10**9, 10**11):
        shape = embeddings.shape_for(n)
        means.append(n * comb(shape.top, shape.order) / comb(2 * shape.directions, shape.order))
        assert comb(shape.top, shape.order) <= 286 and (2 * shape.directions) ** shape.order < 2**62
    assert max(means) < 8


@pytest.mark.parametrize("vectors", [50_000, 200_000, 4_000_000, 10**8])
@pytest.mark.parametrize("dim", [64, 384])
def test_recall_of_threshold_pairs(vectors, dim):
    """Pairs of the least similarity, other than those of the calibration, reach the calibrated count."""
    shape, rng = embeddings.shape_for(vectors), np.random.default_rng(9)
    need, half = embeddings.enough(dim, 0.9, shape, 1000), embeddings.window(0.9)
    x, y = rng.normal(size=(2, 600, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    met = 0
    for k in range(0, 600, 100):
        (kx, px), (ky, py) = embeddings.lists_of(x[k: k + 100], shape), embeddings.lists_of(y[k: k + 100], shape)
        for a, p, b, q in zip(kx, px, ky, py, strict=True):
            _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            met += np.count_nonzero(np.abs(p[i] - q[j]) <= half) >= need
    assert met / 600 >= 0.94


def test_unrelated_vectors_hardly_meet():
    """Meetings of a vector in a whole table, estimated from a part: four times the table, far less than twice the meetings."""
    rng, met = np.random.default_rng(3), []
    for vectors in (50_000, 200_000):
        x = rng.normal(size=(4000, 384))
        keys, _ = embeddings.lists_of(x / np.linalg.norm(x, axis=1, keepdims=True), embeddings.shape_for(vectors))
        _, n = np.unique(keys, return_counts=True)
        met.append((n * (n - 1)).sum() / 4000 * vectors / 4000)
    assert met[1] < 1.4 * met[0] < 500
