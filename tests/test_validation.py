"""Bootstrap by weights and walk-forward validation against draws and folds made one by one."""

import numpy as np
import pandas as pd
import pytest

from barwright.config import Validation
from barwright.operators import bootstrap, validation


def one_by_one(y, b, part=0, replicates=50):
    """A replicate's draws as rows."""
    i, m = np.arange(len(y), dtype=object), bootstrap.MODULUS
    b = b + replicates * part
    h = [((b + 1) * 69621 + (int(k) + 1) * 104729 + 12345) * 48271 % m for k in i]
    g = [(x * x + int(k) * 7919 + b) % m for x, k in zip(h, i, strict=True)]
    return y[[(z * z + x) % m % len(y) for z, x in zip(g, h, strict=True)]]


def test_weights_are_the_counts_of_the_draws(spark):
    rng = np.random.default_rng(3)
    made = {k: rng.normal(0.1, 1, n) for k, n in (("a", 37), ("b", 301), ("c", 1))}
    rows = [(k, j + 1, float(v)) for k, y in made.items() for j, v in enumerate(y)]
    got = {(r.key, r.b): r for r in bootstrap.replicate_sums(spark.createDataFrame(rows, "key string, rn long, y double").repartition(5), 50).collect()}
    assert len(got) == 3 * 51
    for (k, b), r in got.items():
        y = made[k] if b < 0 else one_by_one(made[k], b)
        assert r.k == len(y) and r.up == (y > 0).sum()
        assert np.allclose([r.s1, r.s2], [y.sum(), (y * y).sum()])


def test_draws_of_long_series_are_dealt_over_parts(spark, monkeypatch):
    n, replicates = 2 * bootstrap.PART + 5000, 40
    values = spark.range(n).selectExpr("'x' AS key", "id + 1 AS rn", "CAST(id AS DOUBLE) AS y")
    sums = {r.b: r for r in bootstrap.replicate_sums(values, replicates).collect()}
    assert all(r.k == n for r in sums.values()) and len(sums) == replicates + 1
    means = np.array([sums[b].s1 / n for b in range(replicates)])
    spread = n / 12**0.5 / n**0.5
    assert abs(means.mean() - (n - 1) / 2) < 5 * spread / replicates**0.5 and 0.6 < means.std() / spread < 1.5


def test_intervals_cover_and_are_exact_on_the_sums(spark):
    y = np.random.default_rng(5).normal(0.3, 1, 400)
    values = spark.createDataFrame([("k", j + 1, float(v)) for j, v in enumerate(y)] + [("few", 1, 1.0)], "key string, rn long, y double")
    (r,) = bootstrap.intervals(bootstrap.replicate_sums(values, 500), "mean").collect()
    means = np.array([one_by_one(y, b, replicates=500).mean() for b in range(500)])
    assert np.allclose([r.observed_value, r.bootstrap_mean, r.bootstrap_std, r.ci_lo, r.ci_hi], [y.mean(), means.mean(), means.std(), *np.quantile(means, [0.025, 0.975])])
    assert r.n_bootstrap == 500 and r.p_value == pytest.approx(2 * min((means <= 0).mean(), 1 - (means <= 0).mean()))


SETTINGS = Validation(train_bars=40, test_bars=10, step_bars=7)


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(9)
    out = []
    for s, bars in (("A", 130), ("B", 52), ("short", 30)):
        for place in range(1, bars + 1):
            for edge in ("one", "two"):
                if rng.random() < (0.7 if edge == "one" else 0.05):
                    out.append((s, edge, 5.0, place, int(rng.integers(2)), float(rng.normal(0.1, 1))))
    return pd.DataFrame(out, columns=["symbol", "edge_key", "scale", "place", "side", "r"])


LENGTHS = [("A", 130), ("B", 52), ("short", 30)]


def metrics(x):
    sd = x.std() if len(x) > 1 else float("nan")
    return {"mean": x.mean() if len(x) else 0.0, "sharpe": x.mean() / sd * 5.0 if sd and sd == sd else 0.0, "win": (x > 0).mean() if len(x) else 0.0}


def brute(cells):
    out = {}
    for s, bars in LENGTHS:
        for edge in ("one", "two"):
            own = cells[(cells.symbol == s) & (cells.edge_key == edge)]
            start, k = 0, 0
            while start + 50 <= bars:
                train, test = (own[(own.place > a) & (own.place <= z)].r for a, z in ((start, start + 40), (start + 40, start + 50)))
                out[s, edge, k] = (train, test)
                start, k = start + 7, k + 1
    return out


def test_folds_and_their_summary(spark, cells):
    df, lengths = spark.createDataFrame(cells).repartition(4), spark.createDataFrame(LENGTHS, "symbol string, bars long")
    want = brute(cells)
    figures = validation.folds(df, lengths, SETTINGS)
    got = {(r.symbol, r.edge_key, r.fold): r for r in figures.collect()}
    assert set(got) == {k for k, (a, b) in want.items() if len(a) + len(b)}
    for k, r in got.items():
        for role, x in zip(("train", "test"), want[k], strict=True):
            assert r[f"{role}_n"] == len(x)
            assert np.allclose([r[f"{role}_{m}"] for m in validation.METRICS], list(metrics(x).values()))
    summary = {(r.symbol, r.edge_key): r for r in validation.walk_forward(figures, lengths, SETTINGS).collect()}
    for (s, edge), r in summary.items():
        pairs = [(metrics(a), metrics(b)) for (x, e, _), (a, b) in want.items() if (x, e) == (s, edge)]
        inside, outside = (np.array([p[j]["sharpe"] for p in pairs]) for j in (0, 1))
        assert r.n_folds == len(pairs) and r.positive_folds == (outside > 0).sum()
        assert np.allclose([r.is_sharpe_mean, r.oos_sharpe_mean, r.is_sharpe_std, r.oos_sharpe_std], [inside.mean(), outside.mean(), inside.std(), outside.std()])
        efficiency = outside.mean() / inside.mean() if inside.mean() else 0.0
        assert r.efficiency == pytest.approx(efficiency) and r.is_overfitted == (efficiency < 0.5)
        assert ("very low" in r.warnings) == (efficiency < 0.3) and ("inconsistent" in r.warnings) == ((outside > 0).mean() < 0.5)


def test_a_function_of_the_caller_by_fold(spark, cells):
    df, lengths = spark.createDataFrame(cells), spark.createDataFrame(LENGTHS, "symbol string, bars long")
    got = validation.per_fold(validation.in_folds(df, lengths, SETTINGS), lambda a, b: {"best": a.r.max(), "rows": len(b)}, ["best", "rows"]).collect()
    want = brute(cells)
    assert got and all(r.rows == len(want[r.symbol, r.edge_key, r.fold][1]) for r in got)
    assert all(np.isclose(np.nan if r.best is None else r.best, want[r.symbol, r.edge_key, r.fold][0].max(), equal_nan=True) for r in got)


def test_validated_edges_are_the_significant_ones(spark):
    from barwright.operators import edges
    from barwright.sources.bars import bars_h1

    bars = bars_h1(spark, "/root/testdata/sf0.001").cache()
    rows = validation.validate(bars, ("tim_08",), Validation(bootstrap=300)).collect()
    found = edges.signed_results(validation.returns(bars, ("tim_08",))).filter("is_significant").collect()
    assert {(r.symbol, r.edge_key) for r in rows} == {(r.symbol, r.edge_key) for r in found}
    for r in rows:
        assert r.n_bootstrap == 300 and r.ci_lo <= r.bootstrap_mean <= r.ci_hi and abs(r.bootstrap_mean - r.mean_return) < r.bootstrap_std
    bars.unpersist()
