"""Recall of the vector hashes at any number of hashes, and unit vectors."""

import math

import numpy as np
import pyarrow as pa
import pytest

from accesslens.llm import embeddings


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(16, 5))
    h = np.array([[1.0]])
    while len(h) < 16:
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(embeddings.hadamard(x), h @ x / 4)


@pytest.mark.parametrize("n", [300, 20_000, 3_000_000, 500_000_000, 10**11])
def test_plans_keep_recall(n):
    """Pairs at the bound, other ones than the plan was made from, meet at every number of hashes."""
    k, tables, probes = embeddings.plan(64, n)
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=(2, 400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    met = np.zeros(len(x), bool)
    for t in range(tables):
        a, b = embeddings.buckets(x, t, k, probes), embeddings.buckets(y, t, k, probes)
        met |= (a[:, :1] == b).any(1) | (b[:, :1] == a).any(1)
    assert k == math.ceil(math.log(n) / math.log(128)) and met.mean() >= 0.95


def test_units():
    rows = [None, [], [3.0, 4.0], [0.0, 0.0], [1.0, None], [float("inf"), 1.0], [1e300, 0.0, 1e300], [1e-300]]
    lists, size = embeddings.units(pa.array(rows, pa.list_(pa.float64())))
    assert lists.to_pylist()[:6] == [None, None, [0.6000000000000001, 0.8], None, None, None] or lists.to_pylist()[2] == pytest.approx([0.6, 0.8])
    assert [x is None for x in lists.to_pylist()] == [True, True, False, True, True, True, False, False]
    assert lists.to_pylist()[6] == pytest.approx([0.5**0.5, 0, 0.5**0.5]) and lists.to_pylist()[7] == [1.0] and size.tolist() == [0, 0, 2, 0, 0, 0, 3, 1]
