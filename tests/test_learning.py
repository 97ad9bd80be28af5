"""Models on series whose answers are known."""

import math

import numpy as np
import pandas as pd
import pytest

from barwright.operators import learning


def frame(close, wide=0.001):
    n, first = len(close), np.concatenate([close[:1], close[:-1]])
    return pd.DataFrame({"symbol": "X", "t": 460_000 + np.arange(n), "open": first, "high": np.maximum(first, close) * (1 + wide), "low": np.minimum(first, close) * (1 - wide), "close": close, "volume": 1.0 + np.arange(n) % 5})


@pytest.fixture(scope="module")
def wave(spark):
    """A wave of 40 bars: whether it rises over the next 10 is plain from its oscillators."""
    rng = np.random.default_rng(0)
    return spark.createDataFrame(frame(np.exp(0.02 * np.sin(2 * math.pi * np.arange(1500) / 40) + rng.normal(0, 0.0005, 1500)))).cache()


@pytest.mark.parametrize("model", ["forest", "boosting"])
def test_direction_of_a_wave_is_learnt(wave, model):
    row = learning.direction(wave, model).first()
    assert row.win_rate > 0.9 and row.p_value < 1e-9 and row.is_significant and row.sharpe_ratio > 1 and 350 < row.n < 500


def test_short_series_give_no_model(spark):
    assert learning.direction(spark.createDataFrame(frame(np.linspace(1, 2, 120)))).collect() == []


def test_regimes_follow_volatility(spark):
    rng = np.random.default_rng(1)
    calm = np.concatenate([rng.normal(0, 0.0005, 600), rng.normal(0, 0.02, 600), rng.normal(0.002, 0.0005, 600)])
    bars = spark.createDataFrame(frame(np.exp(np.cumsum(calm))))
    got = learning.regimes(bars).toPandas()
    part = lambda a, b: got[(got.t > 460_000 + a + 50) & (got.t < 460_000 + b)].regime.mode()[0]
    assert len({part(0, 600), part(600, 1200), part(1200, 1800)}) == 3
    edges = learning.regime_edges(bars).collect()
    assert len(edges) == 3 and sum(r.n for r in edges) == len(got)
    assert any(r.mean_return > 0.015 and r.p_value < 1e-6 for r in edges)


def test_spikes_are_anomalies(spark):
    rng = np.random.default_rng(2)
    step = rng.normal(0, 0.001, 2000)
    spikes = np.arange(100, 2000, 100)
    step[spikes] = 0.1
    bars = spark.createDataFrame(frame(np.exp(np.cumsum(step))))
    got = learning.anomalies(bars).toPandas().set_index("t")
    assert 0.03 < got.is_anomaly.mean() <= 0.051 and got.is_anomaly.loc[[460_000 + k for k in spikes if 460_000 + k in got.index]].mean() > 0.9
    assert learning.anomaly_edge(bars).first().n == got.is_anomaly.sum()


def test_trees_draw_from_the_whole_table(spark):
    """Every row has the same chance for each tree, wherever it stands, and every tree its own rows."""
    n, sample = 40_000, 64
    data = spark.range(n).selectExpr("CAST(id AS DOUBLE) AS x", "xxhash64(id) AS hash").repartition(9)
    drawn = data.mapInPandas(learning._samples(["x"], 30, sample), "tree int, h long, x double").toPandas()
    drawn["u"] = drawn.h.to_numpy(np.int64).view(np.uint64)
    kept = drawn.sort_values("u").groupby("tree").head(sample)
    assert (kept.groupby("tree").x.nunique() == sample).all() and kept.x.nunique() > 0.9 * 30 * sample
    assert abs(kept.x.mean() / n - 0.5) < 0.03 and (kept.x > 0.9 * n).mean() > 0.07
    forest, rows = learning.isolation_forest(data, ["x"], 30, sample)
    assert len(forest) == 30 and rows == sample
