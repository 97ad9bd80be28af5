"""Seeded random-walk bars whose edge statistics are published."""

import math

import numpy as np
import pandas as pd
import pytest

from barwright.functions import dist
from barwright.operators import edges
from barwright.operators.features import PLANS
from barwright.plans.edges import detect


@pytest.fixture(scope="module")
def golden(spark):
    rng = np.random.RandomState(42)
    time = pd.date_range("2022-01-01", periods=24 * 600, freq="h")
    time = time[time.weekday < 5][:9600]
    n, v = len(time), 0.10 / math.sqrt(252 * 24)
    r = rng.normal(0, v, n)
    hour = time.hour
    r = r * np.where((hour >= 7) & (hour < 16), 1.3, np.where((hour >= 12) & (hour < 21), 1.2, 1.0))
    close = np.exp(np.log(1.10) + np.cumsum(r))
    open_ = close * (1 + rng.normal(0, 0.3 * v, n))
    high = np.maximum(open_, close) * (1 + np.abs(rng.normal(0, 0.5 * v, n)))
    low = np.minimum(open_, close) * (1 - np.abs(rng.normal(0, 0.5 * v, n)))
    t = time.values.astype("datetime64[h]").astype("int64")
    pdf = pd.DataFrame({"symbol": "EURUSD", "t": t, "open": open_, "high": high, "low": low, "close": close, "volume": 1.0})
    return spark.createDataFrame(pdf).repartition(4).cache()


#: Sample size, win rate and Sharpe ratio as published.
PUBLISHED = {
    "str_e3": {"swing_10": (1231, 0.619821, 1.20341), "swing_5": (1998, 0.586086, 0.969547), "swing_3": (2861, 0.558546, 0.6605)},
    "mrv_01": {"zscore_10_20": (516, 0.573643, 0.734467), "zscore_20_20": (1004, 0.555777, 0.445338), "zscore_10_15": (2290, 0.527511, 0.294183), "zscore_20_15": (2768, 0.52276, 0.280536)},
    "mrv_05": {"bollinger_reversion": (1004, 0.555777, 0.445338)},
    "tre_04": {"donchian_10": (1825, 0.480548, -0.247843), "donchian_20": (1291, 0.471727, -0.358046)},
    "vle_05": {"atr_breakout_10": (1726, 0.484936, -0.254667)},
    "str_e4": {"breakout_retest": (1728, 0.479745, -0.325242)},
}


@pytest.mark.parametrize("name", PUBLISHED)
def test_published_edges(golden, name):
    rows = {r.edge_key: r for r in edges.signed_spark(*edges.SIGNED[name], golden).collect()}
    for key, (n, win, sharpe) in PUBLISHED[name].items():
        r = rows[key]
        assert r.n == n and abs(r.win_rate - win) < 2e-6 and abs(r.sharpe_ratio - sharpe) < 2e-5


def test_published_report(spark, golden):
    """How many tests of each kind the report of this series counts, and how many of all are significant (one more of each kind of pair is left out here)."""
    found = {r.edge_key: r for r in detect(golden).collect()}
    kinds = {"hour": 24, "day": 5, "session": 5, "month": 12, "ma_crossover": 3, "momentum": 3, "hurst": 1, "donchian": 3, "bollinger_breakout": 1, "adx": 2, "runs_test": 1, "zscore": 10, "vwap": 1, "rsi": 3, "stochastic": 1, "bollinger_reversion": 1, "consecutive": 3,
             "volatility_clustering": 1, "contraction": 3, "bollinger_squeeze": 1, "nr": 2, "atr_breakout": 3, "regime": 3, "round_number": 3, "prev": 3, "swing": 3, "breakout_retest": 1, "failed_breakout": 1, "hh_hl_trend": 1}
    got = {k: sum(key.startswith(k) for key in found) for k in kinds}
    assert got == kinds
    # 19 of them are significant in the report, where ADX is missing throughout.
    assert len([k for k, r in found.items() if r.is_significant and k != "adx_ranging"]) == 19
    hurst, level = found["hurst"], found["prev_close"]
    assert hurst.n == 9599 and abs(hurst.p_value - 0.258940) < 2e-5
    assert level.n == 1952 and abs(level.win_rate - 0.532787) < 2e-6 and abs(level.sharpe_ratio - 0.333529) < 2e-5 and abs(level.p_value - 0.0230495) < 2e-5
    assert abs(found["bollinger_reversion"].p_value - 0.00503541) < 2e-5 and abs(found["atr_breakout_10"].p_value - 0.0352077) < 2e-5 and abs(found["breakout_retest"].p_value - 0.00714424) < 2e-5


def test_hour_12(golden):
    hours = [edges.Signed("hour_12", "hour = 12", "false", 1, "r1", 24 * 252)]
    row = edges.signed_spark(edges.CALENDAR, hours, golden).first()
    assert row.n == 400 and abs(row.win_rate - 0.55) < 1e-9 and abs(row.sharpe_ratio - 8.24195) < 1e-4 and abs(row.p_value - 0.034657) < 2e-5


def test_no_nan_and_no_leak(spark, golden):
    other = golden.selectExpr("'FLAT' AS symbol", "t", "1e0 AS open", "1e0 AS high", "1e0 AS low", "1e0 AS close", "1e0 AS volume").limit(300)
    for name in ("mom_02", "mom_04", "trd_05", "vol_03", "pre_10", "cnd_14", "vlm_03"):
        plan = PLANS[name]
        alone = {r.t: r for r in plan.query(golden.limit(400)).collect()}
        both = [r for r in plan.query(golden.limit(400).unionByName(other)).collect()]
        assert {r.t: r for r in both if r.symbol == "EURUSD"} == alone
        assert not any(isinstance(v, float) and math.isnan(v) for r in both for v in r)


def test_tails():
    assert abs(dist.t_two_sided(2.0, 10) - 0.07338803477074037) < 1e-12
    assert abs(dist.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-10 and abs(dist.chi2_sf(18.307, 10) - 0.05) < 1e-5
    assert abs(dist.normal_two_sided(1.959963984540054) - 0.05) < 1e-12
    assert abs(dist.binomial_sf(8, 10, 0.5) - 56 / 1024) < 1e-12
    assert abs(dist.f_sf(4.964602743730711, 1, 10) - 0.05) < 1e-9
    assert abs(dist.t_quantile(0.975, 10) - 2.228138851964939) < 1e-8
