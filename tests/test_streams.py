"""Streams against the batch features on the same ticks, in any order of arrival."""

import numpy as np
import pandas as pd

from barwright.operators.features import PLANS
from barwright.streaming import ticks


def made(hours=120, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for symbol in ("a", "b"):
        for hour in range(hours):
            if symbol == "b" and hour % 7 == 3:
                continue
            for minute in rng.choice(60, 3, replace=False):
                rows.append((symbol, hour * 60 + int(minute), float(100 + rng.normal())))
    out = pd.DataFrame(rows, columns=["event_type", "minute", "value"])
    out["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(out.minute, unit="m")
    out["event_id"] = np.arange(len(out))
    return out


def written(spark, table, folder, shuffled):
    """Files of twelve hours each; within the delay ticks may stand in the next file, and in any order."""
    rng = np.random.default_rng(0)
    late = rng.integers(0, 60, len(table)) if shuffled else 0
    table = table.assign(file=(table.minute + late) // 720)
    for file, part in table.groupby("file"):
        part = part.sample(frac=1, random_state=1) if shuffled else part
        spark.createDataFrame(part[["event_type", "ts", "event_id", "value"]]).coalesce(1).write.mode("append").parquet(f"{folder}/f{file:03d}")
    return f"{folder}/f*"


def drained(spark, path, folder):
    with ticks.rocksdb(spark):
        return ticks.drain(ticks.momentum(ticks.ticks(spark, path, 2), delay="3 hours"), folder, "append").toPandas().sort_values(["symbol", "t"])


def test_momentum_of_late_ticks_is_that_of_the_batch(spark, tmp_path):
    table = made()
    got = drained(spark, written(spark, table, str(tmp_path / "late"), True), str(tmp_path / "out1"))
    last = table.sort_values(["ts", "event_id"]).assign(t=(table.ts - pd.Timestamp("1970-01-01")) // pd.Timedelta("1h"))
    bars = last.groupby(["event_type", "t"], as_index=False).value.last().rename(columns={"event_type": "symbol", "value": "close"})
    bars = bars.assign(open=bars.close, high=bars.close, low=bars.close, volume=1.0)
    want = {}
    for name, column in (("mom_01", "rsi_14"), ("mom_03", "macd")):
        df = PLANS[name].spark(spark.createDataFrame(bars)).toPandas()
        want |= {(column, r.symbol, r.t): getattr(r, column) for r in df.itertuples()}
    # Hours that the last watermark hasn't passed are still open.
    assert len(bars) - 12 <= len(got) < len(bars) and not got.duplicated(["symbol", "t"]).any()
    close = {(r.symbol, r.t): r.close for r in bars.itertuples()}
    for r in got.itertuples():
        assert r.close == close[r.symbol, r.t]
        for value, column in ((r.rsi, "rsi_14"), (r.macd, "macd")):
            expected = want[column, r.symbol, r.t]
            assert (pd.isna(value) and pd.isna(expected)) or abs(value - expected) < 1e-4
    assert got.rsi.notna().sum() > 150 and got.macd.notna().sum() > 120


def test_silences_by_brute_force(spark, tmp_path):
    table = made(60)
    table = table[(table.minute < 600) | (table.minute > 1000)]
    stream = ticks.ticks(spark, written(spark, table, str(tmp_path / "in"), False), 1)
    got = ticks.drain(ticks.gaps(stream, 3600.0), str(tmp_path / "out"), "append").toPandas()
    want = set()
    for symbol, part in table.sort_values("ts").groupby("event_type"):
        times = list(part.ts)
        want |= {(symbol, a, b) for a, b in zip(times, times[1:], strict=False) if (b - a).total_seconds() > 3600}
    assert want and {(r.symbol, r.start, r.end) for r in got.itertuples()} == want
