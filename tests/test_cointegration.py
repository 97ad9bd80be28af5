import math

import numpy as np
import pandas as pd
import pytest

from barwright.operators import cointegration


def brute(a, b):
    """The test by least squares on whole matrices."""
    x = np.column_stack([b, np.ones(len(b))])
    e = a - x @ np.linalg.lstsq(x, a, rcond=None)[0]
    d, n = np.diff(e), len(e)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 1)

    def fit(lags, start):
        y = d[start:]
        z = np.column_stack([e[start:-1], *[d[start - k : len(d) - k] for k in range(1, lags + 1)]])
        beta = np.linalg.lstsq(z, y, rcond=None)[0]
        return y, z, beta, ((y - z @ beta) ** 2).sum()

    scores = []
    for lags in range(most + 1):
        y, _, _, ssr = fit(lags, most)
        scores.append(len(y) * (math.log(2 * math.pi * ssr / len(y)) + 1) + 2 * (lags + 1))
    lags = int(np.argmin(scores))
    y, z, beta, ssr = fit(lags, lags)
    return beta[0] / math.sqrt(ssr / (len(y) - lags - 1) * np.linalg.inv(z.T @ z)[0, 0]), lags


def series():
    rng = np.random.default_rng(7)
    walk = 100 + np.cumsum(rng.normal(0, 1, 900))
    noise = np.zeros(900)
    for t in range(3, 900):
        noise[t] = 0.5 * noise[t - 1] - 0.3 * noise[t - 2] + 0.2 * noise[t - 3] + rng.normal()
    other = 50 + np.cumsum(rng.normal(0, 1, 900))
    slow = np.zeros(300)
    for t in range(1, 300):
        slow[t] = 0.93 * slow[t - 1] + rng.normal()
    return {"linked": (2 + 0.7 * walk + noise, walk), "apart": (other, walk), "slow": (walk[:300] + slow, walk[:300]), "few": (walk[:20], other[:20]), "equal": (walk, walk)}


def test_statistic_and_lags_by_least_squares(spark):
    made = series()
    rows = pd.concat([pd.DataFrame({"pair": k, "t": np.arange(len(a)), "ca": a, "cb": b}) for k, (a, b) in made.items()])
    got = {r.pair: r for r in cointegration.engle_granger(spark.createDataFrame(rows).repartition(7)).collect()}
    assert set(got) == {"linked", "apart", "slow"}
    for k, r in got.items():
        tau, lags = brute(*made[k])
        assert r.lags == lags and abs(r.adf_statistic - tau) < 1e-6 and r.n == len(made[k][0])
        assert r.p_value == pytest.approx(cointegration.p_value(tau), abs=1e-6) and r.cointegrated == (r.p_value < 0.05)
    assert got["linked"].lags >= 1 and got["linked"].cointegrated == 1 and got["apart"].cointegrated == 0


#: Published asymptotic critical values for two series and a constant.
@pytest.mark.parametrize(("tau", "p"), [(-3.89644, 0.01), (-3.33613, 0.05), (-3.04445, 0.10)])
def test_p_values_at_published_critical_values(tau, p):
    assert cointegration.p_value(tau) == pytest.approx(p, abs=1e-3)


def test_p_values_rise_and_meet():
    grid = np.linspace(-19.5, 1.5, 2000)
    p = [cointegration.p_value(x) for x in grid]
    assert all(b >= a - 1e-3 for a, b in zip(p, p[1:], strict=False)) and p[0] == 0 and p[-1] == 1


def test_no_pairs(spark):
    assert cointegration.engle_granger(spark.createDataFrame([], "pair string, t long, ca double, cb double")).collect() == []
