"""Mutual information by nearest neighbours against its closed form and against the definition."""

import math

import numpy as np
import pandas as pd
import pytest

from barwright.operators import learning


@pytest.mark.parametrize("r", [0.0, 0.3, 0.6, 0.9])
def test_correlated_normals(r):
    rng = np.random.default_rng(3)
    x = rng.standard_normal(20_000)
    y = r * x + math.sqrt(1 - r * r) * rng.standard_normal(20_000)
    assert abs(learning.nearest_information(x, 5 + 3 * y) - -0.5 * math.log(1 - r * r)) < 0.02


def brute(x, y, k):
    x, y = x / x.std(), y / y.std()
    psi = lambda m: sum(1 / j for j in range(1, m)) - 0.5772156649015329
    total = 0.0
    for i in range(len(x)):
        dx, dy = np.delete(abs(x - x[i]), i), np.delete(abs(y - y[i]), i)
        radius = np.sort(np.maximum(dx, dy))[k - 1]
        total += psi(1 + int((dx < radius).sum())) + psi(1 + int((dy < radius).sum()))
    return max(0.0, psi(k) + psi(len(x)) - total / len(x))


@pytest.mark.parametrize("k", [1, 3, 5])
def test_definition(k):
    rng = np.random.default_rng(k)
    for n in (10, 200):  # two rows are at distance 2 in both columns, which rounding decides
        x = rng.standard_normal(n)
        for y in (rng.standard_normal(n), np.sin(3 * x) + 0.1 * rng.standard_normal(n)):
            assert abs(learning.nearest_information(x, y, k) - brute(x, y, k)) < 1e-3


def test_ties_constants_and_few_rows():
    rng = np.random.default_rng(0)
    coin = rng.integers(0, 2, 4000).astype(float)
    assert learning.nearest_information(coin, rng.standard_normal(4000)) < 0.03
    assert abs(learning.nearest_information(coin, coin * 10 + rng.standard_normal(4000)) - math.log(2)) < 0.05
    assert learning.nearest_information(np.ones(50), np.arange(50.0)) == learning.nearest_information(np.arange(3.0), np.arange(3.0)) == 0


def test_features_of_a_wave(spark):
    n, rng = 900, np.random.default_rng(0)
    close = np.exp(0.02 * np.sin(2 * math.pi * np.arange(n) / 40) + rng.normal(0, 0.0005, n))
    first = np.concatenate([close[:1], close[:-1]])
    bars = pd.DataFrame({"symbol": "X", "t": np.arange(n), "open": first, "high": np.maximum(first, close), "low": np.minimum(first, close), "close": close, "volume": 1.0 + np.arange(n) % 5})
    from tests.test_learning import frame

    got = learning.knn_information(spark.createDataFrame(bars), top=20).toPandas()
    assert len(got) == 20 and list(np.sort(got.rk)) == list(range(1, 21))
    assert got.mutual_information.max() > 1 and got.sort_values("rk").mutual_information.is_monotonic_decreasing
