"""Checks and cleaning of bars against pandas."""

import numpy as np
import pandas as pd
import pytest

from barwright.operators import preprocess

SCHEMA = "symbol string, t long, open double, high double, low double, close double, volume double"


def dirty():
    rng = np.random.default_rng(5)
    out = []
    for symbol in "AB":
        close = (100 * np.cumprod(1 + rng.normal(0, 0.01, 80))).tolist()
        for k, c in enumerate(close):
            o = close[k - 1] if k else c
            row = [symbol, 1000 + k, o, max(o, c) * 1.01, min(o, c) * 0.99, c, float(k + 1)]
            if k % 7 == 3:
                row[3] = min(o, c) * 0.995  # under the body
            if k % 11 == 5 or k == 0 and symbol == "B":
                row[5] = None
            out.append(tuple(row))
            if k % 13 == 4:
                out.append((symbol, 1000 + k, 999.0, 999.0, 999.0, 999.0, 0.0))
    return out


def test_issues(spark):
    df = pd.DataFrame(dirty(), columns=[c.split()[0] for c in SCHEMA.split(", ")])
    got = {(r.symbol, r.issue): r["rows"] for r in preprocess.issues(spark.createDataFrame(dirty(), SCHEMA)).collect()}
    want = {}
    for symbol, g in df.groupby("symbol"):
        body = g[["open", "close"]]
        for issue, rows in (("missing_close", g.close.isna()), ("high_too_low", g.high < body.max(axis=1)), ("low_too_high", g.low > body.min(axis=1)), ("duplicate_time", g.t.duplicated())):
            if rows.any():
                want[symbol, issue] = int(rows.sum())
    assert got == want and {i for _, i in got} >= {"missing_close", "high_too_low", "duplicate_time"}
    sound = [(s, t, 1.0, 2.0, 0.5, 1.5, 1.0) for s in "AB" for t in range(3)]
    assert preprocess.issues(spark.createDataFrame(sound, SCHEMA)).collect() == []
    assert preprocess.issues(spark.createDataFrame([("A", 1, -1.0, 2.0, -1.0, 1.0, 1.0)], SCHEMA)).first().issue == "not_positive"


def test_cleaned_as_pandas_does(spark):
    rows = dirty()
    places = [(*r, k) for k, r in enumerate(rows)]
    got = preprocess.clean(spark.createDataFrame(places, SCHEMA + ", place long").repartition(5), "place").toPandas().sort_values(["symbol", "t"], ignore_index=True)
    df = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).drop_duplicates(["symbol", "t"]).sort_values(["symbol", "t"])
    df["high"], df["low"] = df[["high", "open", "close"]].max(axis=1), df[["low", "open", "close"]].min(axis=1)
    prices = ["open", "high", "low", "close", "volume"]
    df[prices] = df.groupby("symbol")[prices].ffill()
    df = df.dropna().reset_index(drop=True)
    assert list(got.columns) == list(df.columns) and len(df) == 159
    assert (got.symbol == df.symbol).all() and np.allclose(got[["t", *prices]], df[["t", *prices]])


def test_nothing_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert preprocess.issues(empty).collect() == [] and preprocess.clean(empty).collect() == []
    twice = spark.createDataFrame([("A", 1, 1.0, 2.0, 0.5, 1.5, 1.0)] * 2 + [("A", 2, None, None, None, None, None)], SCHEMA)
    assert [(r.t, r.close) for r in preprocess.clean(twice).sort("t").collect()] == [(1, 1.5), (2, 1.5)]


def test_whole_pipeline(spark):
    bars = spark.createDataFrame([(*r, k) for k, r in enumerate(dirty())], SCHEMA + ", place long")
    full, part = preprocess.preprocess(bars, first="place"), preprocess.preprocess(bars, ("returns",), "place")
    assert {"session", "body_pct", "return_20", "atr_20", "garman_klass_vol"} <= set(full.columns) and "atr_20" not in part.columns
    clean = preprocess.clean(bars, "place").toPandas().sort_values(["symbol", "t"])
    want = clean.groupby("symbol").close.pct_change(5).to_numpy()
    for df in (full, part):
        got = df.select("symbol", "t", "return_5").toPandas().sort_values(["symbol", "t"]).return_5.to_numpy(float)
        assert np.allclose(got, want, equal_nan=True)
    with pytest.raises(KeyError):
        preprocess.plan("nothing")


def test_narrowed(spark):
    # 2022-01-03 is a Monday.
    monday = 18995 * 24
    rows = [(s, monday + h, 1.0, 1.0, 1.0, 1.0, float(h % 5) if h % 9 else None) for s in "AB" for h in range(8 * 24)]
    bars = spark.createDataFrame(rows, SCHEMA)
    got = lambda **how: sorted((r.symbol, r.t) for r in preprocess.narrowed(bars, **how).collect())
    assert got() == sorted((r[0], r[1]) for r in rows)
    assert got(symbols=["A"], start=monday + 5, end=monday + 7) == [("A", monday + h) for h in (5, 6, 7)] and got(symbols=[]) == []
    assert got(session="ny", weekdays=[0], symbols=["B"]) == [("B", monday + d * 24 + h) for d in (0, 7) for h in range(12, 21)]
    assert got(least_volume=3) == sorted((r[0], r[1]) for r in rows if r[6] is not None and r[6] >= 3)
    before = spark.createDataFrame([("A", -24 + 13, 1.0, 1.0, 1.0, 1.0, 1.0)], SCHEMA)  # 1969-12-31, a Wednesday
    assert preprocess.narrowed(before, session="ny", weekdays=[2]).count() == 1
