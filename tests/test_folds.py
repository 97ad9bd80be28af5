"""Folds and what lies in them, on series of more than 1,175 bars."""

import pandas as pd
import pytest

from barwright.operators.analytics import SQL
from barwright.plans.analytics import run

BARS = {"long": 1400, "short": 400, "none": 100}


def rows():
    return [(s, t, c := 100.0 + (t * t) % 7 / 100, c, c, 1.0) for s, n in BARS.items() for t in range(n)]


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(rows(), "symbol string, t long, close double, high double, low double, volume double")


def test_folds_run_to_the_end_of_the_series(spark, bars):
    got = sorted((r.symbol, r.fold, r.train_start, r.train_end, r.test_end) for r in run(spark, SQL["wfo_01"], bars).collect())
    assert got == sorted((s, k, k * 21, k * 21 + 252, k * 21 + 315) for s, n in BARS.items() for k in range(n) if k * 21 + 315 <= n)


def test_complete_folds_alone_have_rows(spark, bars):
    x = pd.DataFrame(rows(), columns=["symbol", "t", "close", "high", "low", "volume"])
    x["y"] = x.groupby("symbol").close.pct_change()
    want, sharpes = {}, {}
    for s, own in x.groupby("symbol"):
        y = own.y
        for k in range((len(y) - 315) // 21 + 1 if len(y) >= 315 else 0):
            for role, part in (("train", y[k * 21 : k * 21 + 252]), ("test", y[k * 21 + 252 : k * 21 + 315])):
                want[s, k, role] = (part.count(), part.mean())
                sharpes.setdefault((s, role), []).append(part.mean() / part.std() * 252**0.5)
    got = {(r.symbol, r.fold, r.role): (r.n, r.mean_return) for r in run(spark, SQL["wfo_02"], bars).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and {k[0] for k in got} == {"long", "short"}
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    for r in run(spark, SQL["wfo_03"], bars).collect():
        inside, outside = (pd.Series(sharpes[r.symbol, role]) for role in ("train", "test"))
        assert r.folds == len(inside) and abs(r.is_sharpe_mean - inside.mean()) < 1e-3 and abs(r.oos_sharpe_std - outside.std(ddof=0)) < 1e-3
        assert abs(r.efficiency - outside.mean() / inside.mean()) < 2e-3 and r.is_overfitted == (outside.mean() / inside.mean() < 0.5)
        assert ("inconsistent" in r.warnings) == ((outside > 0).mean() < 0.5)
