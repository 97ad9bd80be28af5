"""Pairs and currencies against pandas."""

import numpy as np
import pandas as pd
import pytest

from barwright.functions import dist
from barwright.operators.analytics import SQL, strength_sql, strongest_sql
from barwright.plans.analytics import run

N = 700


def frame(symbols, seed):
    rng = np.random.default_rng(seed)
    common = rng.normal(0, 0.01, N)
    out = []
    for k, s in enumerate(symbols):
        tie = np.where((np.arange(N) // 90) % 2 == 0, 0.9, -0.6) if k else 1.0
        close = (50 + 30 * k) * np.exp(np.cumsum(common * tie + rng.normal(0, 0.004, N)))
        out.append(pd.DataFrame({"symbol": s, "t": np.arange(N), "open": close, "high": close, "low": close, "close": close, "volume": 1.0}))
    return pd.concat(out)


def one_sample(v):
    t = v.mean() / (v.std() / len(v) ** 0.5)
    return {"n": len(v), "mean_return": v.mean(), "std_return": v.std(), "t_statistic": t, "p_value": dist.t_two_sided(t, len(v) - 1), "win_rate": (v > 0).mean(), "sharpe_ratio": v.mean() / v.std() * 25.2**0.5}


def same(row, want):
    for k, v in want.items():
        assert row[k] is None if v is None else row[k] == pytest.approx(v, rel=1e-3, abs=2e-4), k


def test_breakdowns_spreads_and_half_lives(spark):
    data = frame(["A", "B"], 3)
    bars = spark.createDataFrame(data).repartition(3)
    a, b = (data[data.symbol == s].close.reset_index(drop=True) for s in "AB")
    c = a.pct_change().rolling(20).corr(b.pct_change())
    broken = (c < c.rolling(100).mean() - 0.5) | (c < -0.5)
    part = ((a.shift(-10) / a - 1) - (b.shift(-10) / b - 1)).abs()
    # The statements see bars from the first return on.
    hit, other = part[broken].dropna(), part[1:][~broken[1:]].dropna()
    row = run(spark, SQL["par_02"], bars).first()
    pooled = ((len(hit) - 1) * hit.var() + (len(other) - 1) * other.var()) / (len(hit) + len(other) - 2)
    t = (hit.mean() - other.mean()) / (pooled * (1 / len(hit) + 1 / len(other))) ** 0.5
    assert len(hit) >= 30
    same(row, {"n": len(hit), "n_other": len(other), "mean_return": hit.mean() - other.mean(), "std_return": hit.std(), "t_statistic": t, "win_rate": (hit > other.mean()).mean()})
    s = (a - b)[1:]
    z = (s - s.rolling(20).mean()) / s.rolling(20).std()
    f = s.shift(-10) / s - 1
    v = pd.concat([f[z < -2], -f[z > 2]]).dropna()
    same(run(spark, SQL["par_08"], bars).first(), one_sample(v))
    x, y = b[1:].to_numpy(), a[1:].to_numpy()
    beta = np.polyfit(x, y, 1)[0]
    spread = pd.Series(y - beta * x)
    slope = np.polyfit(spread[:-1], spread.diff()[1:], 1)[0]
    change = spread.pct_change().dropna()
    row = run(spark, SQL["par_07"], bars).first()
    half = -np.log(2) / slope if slope < 0 else None
    same(row, {"hedge_ratio": beta, "half_life": half, "correlation": np.corrcoef(x, y)[0, 1], "spread_sharpe": change.mean() / change.std() * 252**0.5})
    assert row.is_tradeable == (half is not None and 5 < half < 100)


def test_currencies_of_named_pairs(spark):
    names = ["EURUSD", "GBPUSD", "USDJPY", "EURGBP"]
    data = frame(names, 5)
    bars = spark.createDataFrame(data).repartition(3)
    wide = data.pivot(index="t", columns="symbol", values="close")
    ret, fwd = wide.pct_change(20), wide.pct_change(10).shift(-10)
    legs = {"EUR": [("EURUSD", 1), ("EURGBP", 1)], "GBP": [("GBPUSD", 1), ("EURGBP", -1)], "USD": [("EURUSD", -1), ("GBPUSD", -1), ("USDJPY", 1)], "JPY": [("USDJPY", -1)]}
    strength = pd.DataFrame({c: sum(sign * ret[p] for p, sign in own) / len(own) for c, own in legs.items()}).dropna()
    table = "SELECT symbol, t, close FROM BARS"
    got = run(spark, strength_sql(table), bars).toPandas().pivot(index="t", columns="ccy", values="strength")
    assert len(got) == len(strength) and np.allclose(got[strength.columns], strength, atol=2e-6)
    values = []
    for t, row in strength.iterrows():
        strong, weak = row.idxmax(), row.idxmin()
        for pair, sign in ((strong + weak, 1), (weak + strong, -1)):
            if pair in names and fwd[pair].loc[t] == fwd[pair].loc[t]:
                values.append(sign * fwd[pair].loc[t])
    same(run(spark, strongest_sql(table), bars).first(), one_sample(pd.Series(values)))
