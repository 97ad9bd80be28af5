"""Plans by chunks against the same plans by whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.functions import chunks
from barwright.functions.dsl import ORDER, Ewm, Plan, Quantile, Rank, Wilder, lag, lead, roll
from barwright.operators.features import PLANS

#: Plans with columns that depend on groups of rows of any length: runs, days, whole series.
WHOLE_SERIES = {"cnd_13", "trd_08", "trd_10"}


def made(n, symbols=("A", "B"), holes=True, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for k, s in enumerate(symbols):
        m = n - 57 * k
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, m)))
        open_ = close * (1 + rng.normal(0, 0.003, m))
        frame = pd.DataFrame({"symbol": s, "t": 460_000 + np.cumsum(rng.choice([1, 1, 1, 5, 49], m)), "open": open_, "close": close})
        frame["high"] = frame[["open", "close"]].max(axis=1) * (1 + abs(rng.normal(0, 0.002, m)))
        frame["low"] = frame[["open", "close"]].min(axis=1) * (1 - abs(rng.normal(0, 0.002, m)))
        frame["volume"] = rng.integers(1, 500, m).astype(float)
        out.append(frame)
    return pd.concat(out)


def compare(plan, bars, rows, columns):
    key = ["symbol", "t"]
    whole = plan.spark(bars).select(*key, *columns).toPandas().sort_values(key, ignore_index=True)
    parts = plan.long(bars, rows).select(*key, *columns).toPandas().sort_values(key, ignore_index=True)
    assert len(whole) == len(parts)
    for c in columns:
        if whole[c].dtype == object and not isinstance(next((x for x in whole[c] if x is not None), 0.0), int | float):
            assert whole[c].tolist() == parts[c].tolist(), c
        else:
            a, b = whole[c].astype(float), parts[c].astype(float)
            assert (a.isna() == b.isna()).all(), (c, a.isna().sum(), b.isna().sum())
            assert np.allclose(a.dropna(), b.dropna(), rtol=1e-9, atol=1e-9), (c, (a - b).abs().max())


@pytest.mark.parametrize("name", ["mom_01", "mom_03", "mom_09", "trd_06", "trd_07", "vlm_03", "vlm_08", "vol_12", "vol_13", "pre_10", "cnd_08", "trd_09"])
def test_feature_plans(spark, name):
    bars = spark.createDataFrame(made(900)).repartition(6)
    compare(PLANS[name], bars, 330, list(PLANS[name].out))


def test_windows_missing_values_and_halos_of_their_own_length(spark):
    frame = made(400)
    rng = np.random.default_rng(5)
    frame["gappy"] = frame.close.where(rng.random(len(frame)) > 0.3)
    frame.loc[frame.index[:20], "gappy"] = np.nan
    frame.loc[frame.index[95:130], "gappy"] = np.nan
    bars = spark.createDataFrame(frame).withColumn("gappy", F.nanvl("gappy", F.lit(None)))
    plan = Plan([
        {"top": f"max(high) OVER ({ORDER} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)", "e": Ewm("gappy", 7), "w": Wilder("gappy", 9), "filled": f"last(gappy, true) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"},
        {"best": f"max(gappy) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "least": f"min(gappy) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "seen": f"count(gappy) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"},
        {"e2": Ewm("e", 5), "r": Rank("close", 10), "q": Quantile("close", 0.3, 10)},
        {"mean": roll("avg", "e2", 10), "before": lag("w", 3), "after": lead("e2", 4), "total": f"sum(e2) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"},
    ])
    columns = ["top", "e", "w", "filled", "best", "least", "seen", "e2", "r", "q", "mean", "before", "after", "total"]
    for rows in (37, 64, 1000):
        compare(plan, bars, rows, columns)


def test_one_series_keeps_many_tasks(spark):
    n, rows = 400_000, 1 << 15
    bars = spark.range(n, numPartitions=8).selectExpr("'X' AS symbol", "id AS t", "100 + 10 * sin(id / 50D) + (xxhash64(id) % 1000) / 1000D AS close")
    plan = Plan([{"e12": Ewm("close", 12), "e26": Ewm("close", 26)}, {"macd": "e12 - e26"}, {"signal": Ewm("macd", 9), "high10": roll("max", "close", 10)}])
    long = plan.long(bars, rows)
    per_chunk = chunks.cut(chunks.numbered(bars), rows, 9, 0).groupBy("chunk").count().collect()
    assert len(per_chunk) == -(-n // rows) and max(r["count"] for r in per_chunk) <= rows + 9
    got = long.select("t", "signal", "high10").toPandas().sort_values("t", ignore_index=True)
    close = bars.orderBy("t").toPandas().close
    ewm = lambda x, s: x.ewm(span=s, adjust=True, min_periods=s).mean()
    want = ewm(ewm(close, 12) - ewm(close, 26), 9)
    assert (got.signal.isna() == want.isna()).all() and (got.signal - want).abs().max() < 1e-9
    assert got.high10.dropna().tolist() == close.rolling(10).max().dropna().tolist()


@pytest.mark.parametrize("name", sorted(WHOLE_SERIES))
def test_what_needs_a_whole_series_says_so(spark, name):
    with pytest.raises(ValueError, match="whole series"):
        PLANS[name].long(spark.createDataFrame(made(100)), 90)


def test_chunks_shorter_than_the_halo_raise_and_empty_tables_pass(spark):
    bars = spark.createDataFrame(made(100))
    with pytest.raises(ValueError, match="shorter"):
        PLANS["trd_01"].long(bars, 50)
    assert PLANS["mom_03"].long_query(bars.limit(0)).collect() == []
