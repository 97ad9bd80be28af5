"""Corrections over many ranges, and exact chances of small samples against counting by hand."""

from itertools import combinations, product

import numpy as np
import pandas as pd
import pytest

from barwright.functions import dist
from barwright.operators.analytics import SQL
from barwright.operators.corrections import corrected
from barwright.plans.analytics import run


def by_hand(p):
    order, n = np.argsort(p, kind="stable"), len(p)
    holm, hochberg = np.empty(n), np.empty(n)
    holm[order] = np.minimum(np.maximum.accumulate(p[order] * (n - np.arange(n))), 1)
    hochberg[order] = np.minimum(np.minimum.accumulate((p[order] * n / (np.arange(n) + 1))[::-1])[::-1], 1)
    return np.minimum(p * n, 1), holm, hochberg


def test_corrections_over_ranges(spark):
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.random(3000) ** 3, np.repeat(0.01, 200), [0.0, 1.0]])
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(p)), "p": p}))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = corrected(df, ["k"]).toPandas().sort_values("k")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for name, want in zip(("bonferroni", "holm", "benjamini_hochberg"), by_hand(p), strict=True):
        assert np.allclose(got[name], want, atol=1e-12), name
    assert corrected(df.limit(0), ["k"]).collect() == []


@pytest.mark.parametrize(("n1", "n2"), [(1, 1), (3, 4), (5, 5), (2, 9)])
def test_exact_u_by_enumeration(n1, n2):
    sums = [sum(c) - n1 * (n1 + 1) // 2 for c in combinations(range(1, n1 + n2 + 1), n1)]
    for u in range(n1 * n2 + 1):
        low = min(u, n1 * n2 - u)
        assert dist.mann_whitney_exact(u, n1, n2) == pytest.approx(min(1, 2 * sum(s <= low for s in sums) / len(sums)))


@pytest.mark.parametrize("n", [1, 5, 9])
def test_exact_w_by_enumeration(n):
    sums = [sum(k + 1 for k, s in enumerate(signs) if s) for signs in product((0, 1), repeat=n)]
    for w in range(n * (n + 1) // 2 + 1):
        low = min(w, n * (n + 1) // 2 - w)
        assert dist.wilcoxon_exact(w, n) == pytest.approx(min(1, 2 * sum(s <= low for s in sums) / len(sums)))


#: Published two-sided 5 % critical values: the largest U and W that are significant.
@pytest.mark.parametrize(("n", "u"), [(5, 2), (10, 23), (15, 64), (20, 127), (25, 211)])
def test_critical_values_of_u(n, u):
    assert dist.mann_whitney_exact(u, n, n) <= 0.05 < dist.mann_whitney_exact(u + 1, n, n)


@pytest.mark.parametrize(("n", "w"), [(6, 0), (10, 8), (15, 25), (20, 52), (25, 89)])
def test_critical_values_of_w(n, w):
    assert dist.wilcoxon_exact(w, n) <= 0.05 < dist.wilcoxon_exact(w + 1, n)


def test_small_series_get_exact_chances(spark):
    y = np.array([0.011, -0.004, 0.021, 0.006, -0.013, 0.017, 0.002, 0.031, -0.008, 0.014, 0.019, 0.005])
    close = 100 * np.cumprod(np.concatenate([[1], 1 + y]))
    bars = spark.createDataFrame(pd.DataFrame({"symbol": "A", "t": np.arange(13), "open": close, "high": close, "low": close, "close": close, "volume": 1.0}))
    even, odd = y[1::2], y[0::2]
    u = sum(a > b for a in even for b in odd)
    assert run(spark, SQL["sta_04"], bars).first().p_value == pytest.approx(dist.mann_whitney_exact(u, 6, 6), abs=6e-6)
    ranks = pd.Series(abs(y)).rank()
    w = min(ranks[y > 0].sum(), ranks[y < 0].sum())
    assert run(spark, SQL["sta_05"], bars).first().p_value == pytest.approx(dist.wilcoxon_exact(w, 12), abs=6e-6)
