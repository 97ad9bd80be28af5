"""Statements of statistics, metrics and resampling against NumPy and pandas on a small series, worked out by other means than their SQL."""

import math

import numpy as np
import pandas as pd
import pytest

from barwright.functions import dist
from barwright.operators.analytics import FAMILY, PATHS, PERMUTATIONS, REPLICATES, SQL, STEPS
from barwright.operators.corrections import corrected
from barwright.plans.analytics import resampled, run, shuffled

N = 360


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(8)
    out = []
    for k, symbol in enumerate("AB"):
        # A step of more than 5 % now and then: nothing may be cut.
        y = rng.normal(0.0005, 0.01, N) + np.where(rng.random(N) < 0.03, rng.normal(0, 0.3, N).clip(-0.6, 0.6), 0)
        close = (100 + 50 * k) * np.cumprod(1 + y)
        out.append(pd.DataFrame({"symbol": symbol, "t": 460_000 + np.arange(N), "open": close, "high": close * 1.01, "low": close * 0.99, "close": close, "volume": rng.integers(1, 90, N).astype(float)}))
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="module")
def ask(spark, frame):
    bars = spark.createDataFrame(frame).repartition(3).cache()
    return lambda name, key="symbol": {r[key]: r for r in run(spark, SQL[name], bars).collect()}


@pytest.fixture(scope="module")
def returns(frame):
    return {s: g.close.pct_change().dropna().to_numpy() for s, g in frame.groupby("symbol")}


def near(a, b, scale=1e-5):
    assert abs(a - b) <= scale * max(1, abs(b)), (a, b)


def halves(y):
    """The statements number returns from one: even numbers are group one."""
    return y[1::2], y[0::2]


def ranks(x):
    return pd.Series(x).rank().to_numpy()


def test_nothing_is_cut(returns, ask):
    for s, r in ask("pre_13").items():
        assert abs(returns[s]).max() > 0.2
        near(r.std_return, returns[s].std(ddof=1))


def test_t_tests(returns, ask):
    for s, r in ask("sta_01").items():
        t = returns[s].mean() / (returns[s].std(ddof=1) / math.sqrt(N - 1))
        near(r.statistic, t)
        near(r.p_value, dist.t_two_sided(t, N - 2))
    for s, r in ask("sta_02").items():
        a, b = halves(returns[s])
        u, v = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
        t, df = (a.mean() - b.mean()) / math.sqrt(u + v), (u + v) ** 2 / (u**2 / (len(a) - 1) + v**2 / (len(b) - 1))
        near(r.statistic, t)
        near(r.df, df, 1e-3)
        near(r.p_value, dist.t_two_sided(t, df))
    for s, r in ask("sta_03").items():
        d = -np.diff(returns[s])
        near(r.statistic, d.mean() / (d.std(ddof=1) / math.sqrt(len(d))))


def test_rank_tests(returns, ask):
    for s, r in ask("sta_04").items():
        a, b = halves(returns[s])
        u = sum((x > b).sum() + 0.5 * (x == b).sum() for x in a)
        near(r.statistic, u)
        z = (abs(u - len(a) * len(b) / 2) - 0.5) / math.sqrt(len(a) * len(b) * (len(a) + len(b) + 1) / 12)
        near(r.p_value, dist.normal_two_sided(z))
        near(r.effect_size, 1 - 2 * u / (len(a) * len(b)))
    for s, r in ask("sta_05").items():
        y = returns[s]
        w = ranks(abs(y))
        least, n = min(w[y > 0].sum(), w[y < 0].sum()), len(y)
        near(r.statistic, least)
        near(r.p_value, dist.normal_two_sided((least - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)))
    for s, r in ask("sta_06").items():
        y, n = returns[s], N - 1
        w = ranks(y)
        groups = [w[(np.arange(n) + 1) % 3 == k] for k in range(3)]
        h = 12 / (n * (n + 1)) * sum(len(g) * (g.mean() - (n + 1) / 2) ** 2 for g in groups)
        near(r.statistic, h, 1e-4)
        near(r.p_value, math.exp(-h / 2))


def test_contingency_and_correlation(returns, ask):
    for s, r in ask("sta_08").items():
        a, b = halves(returns[s])
        table = np.array([[(a > 0).sum(), (b > 0).sum()], [(a <= 0).sum(), (b <= 0).sum()]], float)
        expected = table.sum(1, keepdims=True) @ table.sum(0, keepdims=True) / table.sum()
        chi = (np.maximum(abs(table - expected) - 0.5, 0) ** 2 / expected).sum()
        near(r.statistic, chi)
        near(r.p_value, dist.chi2_sf(chi, 1))
    r = ask("sta_09", "pair")["A/B"]
    rho = np.corrcoef(returns["A"], returns["B"])[0, 1]
    near(r.statistic, rho)
    near(r.p_value, dist.t_two_sided(rho * math.sqrt((N - 3) / (1 - rho**2)), N - 3))


def test_corrections(frame, spark):
    bars = spark.createDataFrame(frame)
    p = {}
    for s, g in frame.groupby("symbol"):
        g = g.assign(y=g.close.pct_change()).dropna()
        for h, x in g.groupby(g.t % 24):
            t = x.y.mean() / (x.y.std(ddof=1) / math.sqrt(len(x)))
            p[s, h] = dist.t_two_sided(t, len(x) - 1)
    order, m = sorted(p, key=p.get), len(p)
    holm, worst = {}, 0.0
    for i, k in enumerate(order):
        worst = max(worst, (m - i) * p[k])
        holm[k] = min(worst, 1)
    fdr, best = {}, 1.0
    for i in range(m - 1, -1, -1):
        best = min(best, p[order[i]] * m / (i + 1))
        fdr[order[i]] = best
    got = {(r.symbol, r.hour): r for r in corrected(run(spark, f"WITH {FAMILY} SELECT symbol, hour, p FROM p", bars), ["symbol", "hour"]).collect()}
    assert len(got) == m == 48
    for name, want in (("bonferroni", {k: min(v * m, 1) for k, v in p.items()}), ("holm", holm), ("benjamini_hochberg", fdr)):
        for k, r in got.items():
            near(r.p, p[k])
            near(r[name], want[k], 2e-5)


def test_metrics(returns, ask):
    one, two = ask("met_01"), ask("met_02")
    for s, y in returns.items():
        near(one[s].profit_factor, y[y > 0].sum() / -y[y < 0].sum())
        near(one[s].expectancy, (y > 0).mean() * y[y > 0].mean() - (y <= 0).mean() * -y[y < 0].mean())
        longest = max(len(x) for x in "".join("1" if v > 0 else "0" for v in y).split("0"))
        assert one[s].max_consecutive_wins == longest
        equity = np.cumprod(1 + y)
        peak = np.maximum.accumulate(equity)
        down = equity / peak - 1
        near(two[s].total_return, equity[-1] - 1, 1e-4)
        near(two[s].sharpe_ratio, y.mean() / y.std(ddof=1) * math.sqrt(252))
        near(two[s].sortino_ratio, y.mean() / y[y < 0].std(ddof=1) * math.sqrt(252))
        near(two[s].max_drawdown, -down.min())
        near(two[s].ulcer_index, math.sqrt((down**2).mean()))


def test_yearly_figures_and_stability(returns, ask, frame):
    two, steady = ask("met_02"), ask("met_03_stability")
    for s, y in returns.items():
        equity = np.cumprod(1 + y)
        yearly = equity[-1] ** (252 / len(y)) - 1
        near(two[s].annualized_return, yearly, 1e-4)
        near(two[s].calmar_ratio, yearly / -(equity / np.maximum.accumulate(equity) - 1).min(), 1e-3)
        windows = [y[k : k + 252] for k in range(len(y) - 251)]
        sharpe = [w.mean() / w.std(ddof=1) * math.sqrt(252) for w in windows]
        near(steady[s].rolling_sharpe_mean, np.mean(sharpe))
        near(steady[s].rolling_sharpe_std, np.std(sharpe, ddof=1), 1e-4)
        near(steady[s].rolling_sharpe_min, min(sharpe))
        near(steady[s].rolling_win_rate_mean, np.mean([(w > 0).mean() for w in windows]))
        times = pd.to_datetime(frame[frame.symbol == s].t.to_numpy()[1:] * 3600, unit="s")
        years = pd.Series(y).groupby(times.year).sum()
        assert steady[s].windows == len(windows) and steady[s].positive_years == (years > 0).sum() and steady[s].negative_years == (years < 0).sum()
        near(steady[s].best_year, years.max())
        near(steady[s].worst_year, years.min())


def test_interval_of_the_mean(returns, ask, spark):
    # Published quantiles of Student's t.
    for df, at in ((1, 12.7062), (2, 4.3027), (10, 2.2281), (30, 2.0423), (120, 1.9799)):
        near(dist.t_quantile(0.975, df), at, 2e-5)
    for s, r in ask("sta_01_interval").items():
        y = returns[s]
        reach = dist.t_quantile(0.975, N - 2) * y.std(ddof=1) / math.sqrt(N - 1)
        near(r.ci_lo, y.mean() - reach)
        near(r.ci_hi, y.mean() + reach)


def test_spearman_with_ties_and_effect_labels(spark, frame, ask):
    coarse = frame.copy()
    steps = np.random.default_rng(4).integers(-2, 3, len(coarse)) / 100
    coarse["close"] = 100 * np.exp(pd.Series(np.log1p(steps)).groupby(coarse.symbol).cumsum())
    wide = coarse.pivot(index="t", columns="symbol", values="close").pct_change().dropna().round(9)
    rho = wide.rank().corr().loc["A", "B"]
    r = run(spark, SQL["sta_09_spearman"], spark.createDataFrame(coarse).repartition(3)).first()
    assert wide["A"].nunique() < 10 and r.n == len(wide)
    near(r.statistic, rho)
    near(r.p_value, dist.t_two_sided(rho * math.sqrt((r.n - 2) / (1 - rho**2)), r.n - 2))
    # A series that rises and falls with another has a rank correlation of one, whatever the scale.
    twin = pd.concat([g.assign(symbol=s, close=100 * np.cumprod(np.r_[1, 1 + g.close.pct_change().dropna() ** k])) for (s, k), g in zip((("A", 1), ("B", 3)), [frame[frame.symbol == "A"]] * 2, strict=True)])
    r = run(spark, SQL["sta_09_spearman"], spark.createDataFrame(twin)).first()
    assert r.statistic > 0.99 and r.p_value == 0
    rows = run(spark, SQL["sta_13_effects"], spark.createDataFrame(frame)).collect()
    one = {r.symbol: r.effect_size for r in ask("sta_01").values()}
    label = lambda d: next(name for top, name in ((0.2, "negligible"), (0.5, "small"), (0.8, "medium"), (1e9, "large")) if abs(d) < top)
    assert len(rows) == 4 and all(r.effect == label(r.effect_size) for r in rows)
    assert all(r.effect_size == one[r.symbol] for r in rows if r.test == "one_sample")


def test_clustering(returns, ask):
    for s, r in ask("vle_01").items():
        a = abs(returns[s]) - abs(returns[s]).mean()
        n = len(a)
        rho = [(a[k:] * a[:-k]).sum() / (a * a).sum() for k in range(1, 11)]
        q = n * (n + 2) * sum(x * x / (n - k) for k, x in enumerate(rho, 1))
        near(r.ljung_box, q, 1e-4)
        near(r.p_value, dist.chi2_sf(q, 10))


def test_histogram_spans_all_returns(returns, frame, spark):
    rows = run(spark, SQL["rpt_04"], spark.createDataFrame(frame)).collect()
    for s, y in returns.items():
        want = np.histogram(y, bins=49)[0]
        got = np.zeros(49, int)
        for r in rows:
            if r.symbol == s:
                got[r.bin] = r.n
        assert got.sum() == len(y) and abs(got - want).max() <= 1


def test_resampling_draws_as_many_as_there_are(spark, frame, returns, ask):
    """Means and spreads of replicates are known in closed form."""
    bars = spark.createDataFrame(frame).repartition(3)
    mean, rate, over = ({r.symbol: r for r in resampled(bars, s).collect()} for s in ("mean", "win_rate_over_half", "mean_over_target"))
    paths, permuted = ask("boo_04"), {r.symbol: r for r in shuffled(bars).collect()}
    for s, y in returns.items():
        spread = y.std() / math.sqrt(len(y))
        assert mean[s].n_bootstrap == REPLICATES
        near(mean[s].observed_value, y.mean())
        assert abs(mean[s].bootstrap_mean - y.mean()) < 5 * spread / math.sqrt(REPLICATES)
        assert abs(mean[s].bootstrap_std / spread - 1) < 0.12
        assert abs((mean[s].ci_hi - mean[s].ci_lo) / (2 * 1.96 * spread) - 1) < 0.15
        p = (y > 0).mean()
        assert abs(rate[s].bootstrap_std / math.sqrt(p * (1 - p) / len(y)) - 1) < 0.12
        near(over[s].observed_value, y.mean() - 0.001)
        growth = np.log1p(y)
        assert paths[s].n_paths == PATHS and -1 <= paths[s].worst_case_dd <= paths[s].expected_max_dd < 0
        assert abs(math.log(paths[s].p50) - STEPS * growth.mean()) < 5 * 1.25 * growth.std() * math.sqrt(STEPS / PATHS)
        assert paths[s].p05 < paths[s].p25 < paths[s].p50 < paths[s].p75 < paths[s].p95
        a, b = halves(y)
        rng = np.random.default_rng(1)
        other = np.array([(z := rng.permutation(y))[: len(a)].mean() - z[len(a) :].mean() for _ in range(4000)])
        near(permuted[s].observed, a.mean() - b.mean())
        near(permuted[s].observed_median, np.median(a) - np.median(b))
        middle = np.array([np.median((z := rng.permutation(y))[: len(a)]) - np.median(z[len(a) :]) for _ in range(4000)])
        assert abs(permuted[s].median_p_value - (abs(middle) >= abs(np.median(a) - np.median(b))).mean()) < 5 * 0.5 / math.sqrt(4000)
        assert permuted[s].n_permutations == PERMUTATIONS and abs(permuted[s].permutation_std / other.std() - 1) < 0.12
        assert abs(permuted[s].p_value - (abs(other) >= abs(a.mean() - b.mean())).mean()) < 5 * 0.5 / math.sqrt(4000)


def test_volume_profile_and_regime_of_a_trend(spark):
    walk = np.random.default_rng(2).normal(0, 1, 4000)
    for series, low, high in ((np.exp(np.cumsum(np.cumsum(walk)) * 1e-6), 0.0, 2.0), (np.exp(0.01 * np.cumsum(walk)), -0.2, 0.2)):
        df = spark.createDataFrame(pd.DataFrame({"symbol": "X", "t": np.arange(4000), "open": series, "high": series, "low": series, "close": series, "volume": 1.0}))
        r = run(spark, SQL["tre_03"], df).first()
        assert r.n == 3999 and low <= r.hurst <= high
