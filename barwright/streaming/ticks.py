"""Structured Streaming over ticks: bars, sliding and session windows, deduplication, gap detection, momentum of bars.

Ticks are (symbol, time timestamp, event_id, value). Every query has a watermark; in append mode a window is emitted once it is past.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DELAY = "1 hour"


def ticks(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the parquet files that match ``path``, oldest first. Timestamps without a zone are read in the session's."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("time"), "event_id", "value")


def tumbling_bars(stream: DataFrame, width: str = "1 hour", delay: str = DELAY) -> DataFrame:
    at = F.struct("time", "event_id")
    out = stream.withWatermark("time", delay).groupBy("symbol", F.window("time", width)).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume")
    )
    return out.select("symbol", F.col("window.start").alias("time"), "open", "high", "low", "close", "volume")


def sliding_stats(stream: DataFrame, width: str = "20 hours", step: str = "1 hour", delay: str = DELAY) -> DataFrame:
    out = stream.withWatermark("time", delay).groupBy("symbol", F.window("time", width, step)).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return out.select("symbol", F.col("window.start").alias("time"), "n", "mean_value")


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    out = stream.withWatermark("time", delay).groupBy("symbol", F.session_window("time", gap)).agg(F.count("*").alias("n"))
    return out.select("symbol", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    return stream.withWatermark("time", delay).dropDuplicatesWithinWatermark(["symbol", "event_id"])


def _gap_state(limit: float):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("time")
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        seen = rows["time"].cummax()
        before = seen.shift()
        if last is not None:
            seen = seen.clip(lower=last)
            before = seen.shift(fill_value=last)
        silence = (seen - before).dt.total_seconds()
        found = silence > limit
        state.update((int(seen.iloc[-1].value // 1000),))
        yield pd.DataFrame({"symbol": key[0], "start": before[found], "end": seen[found], "seconds": silence[found]})

    return run


def gaps(stream: DataFrame, seconds: float = 5400.0) -> DataFrame:
    """Silences of a symbol that last longer than ``seconds``; the last tick is kept as state."""
    return stream.select("symbol", "time").groupBy("symbol").applyInPandasWithState(
        _gap_state(seconds), "symbol string, start timestamp, end timestamp, seconds double", "last long", "append", GroupStateTimeout.NoTimeout
    )


HOUR = 3_600_000
_STATE = "n long, close double, gain double, loss double, e12 double, w12 double, e26 double, w26 double"
MOMENTUM = "symbol string, t long, close double, rsi double, macd double"


class _Momentum(StatefulProcessor):
    """Closes of the hours that late ticks may still change, in a map by hour; averages of the hours that are over, in one value.

    A timer stands at the end of every open hour. When the watermark passes it, all hours that are over are folded into the averages, oldest first,
    so the result doesn't depend on the order of timers, batches or ticks.
    """

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "t long", "at long, event_id long, value double")
        self.averages = handle.getValueState("averages", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            part = part.sort_values(["at", "event_id"])
            part["t"] = part["at"] // (HOUR * 1000)
            for hour in part.groupby("t")[["at", "event_id", "value"]].last().itertuples():
                tick = (int(hour.at), int(hour.event_id), float(hour.value))
                held = self.hours.getValue((hour.Index,)) if self.hours.containsKey((hour.Index,)) else None
                if held is None:
                    self.handle.registerTimer((hour.Index + 1) * HOUR)
                if held is None or tuple(held)[:2] < tick[:2]:
                    self.hours.updateValue((hour.Index,), tick)
        yield pd.DataFrame(columns=["symbol", "t", "close", "rsi", "macd"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        over = sorted((hour[0], tick[2]) for hour, tick in self.hours.iterator() if (hour[0] + 1) * HOUR <= now)
        if not over:
            return
        held = self.averages.get() if self.averages.exists() else (0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
        n, last, gain, loss, *sums = held
        out = []
        for hour, close in over:
            change = 0.0 if last is None else close - last
            up, down = max(change, 0.0), max(-change, 0.0)
            # Wilder's average: plain sums until there are n rows, their mean then, and a recursion from there on.
            if n < self.n:
                gain, loss = gain + up, loss + down
                if n + 1 == self.n:
                    gain, loss = gain / self.n, loss / self.n
            else:
                gain, loss = (gain * (self.n - 1) + up) / self.n, (loss * (self.n - 1) + down) / self.n
            n, last = n + 1, close
            for place, span in ((0, 12), (2, 26)):
                keep = 1 - 2 / (span + 1)
                sums[place], sums[place + 1] = sums[place] * keep + close, sums[place + 1] * keep + 1
            rsi = 100 - 100 / (1 + gain / loss) if n >= self.n and loss else None
            macd = sums[0] / sums[1] - sums[2] / sums[3] if n >= 26 else None
            out.append((key[0], hour, close, rsi, macd))
            self.hours.removeKey((hour,))
        self.averages.update((n, last, gain, loss, *sums))
        yield pd.DataFrame(out, columns=["symbol", "t", "close", "rsi", "macd"]).astype({"rsi": float, "macd": float})

    def close(self) -> None:
        pass


def momentum(stream: DataFrame, n: int = 14, delay: str = DELAY) -> DataFrame:
    """RSI and MACD of hourly closes, as the batch features have them, emitted once for each hour that the watermark has passed.

    State is one row of averages for each symbol, and one tick for each hour that late ticks can still change. Ticks later than ``delay`` are dropped.
    Ticks without a symbol are a symbol of their own, ticks without a value are left out. Needs a state store that keeps several states: see ``rocksdb``.
    """
    rows = stream.filter("value IS NOT NULL").withWatermark("time", delay).withColumn("at", F.unix_micros("time")).select("symbol", "time", "at", "event_id", "value")
    return rows.groupBy("symbol").transformWithStateInPandas(_Momentum(n), MOMENTUM, "Append", "EventTime")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start within use the RocksDB state store; the session's own setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, own)


def drain(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Run a bounded stream to its end and return the table that it wrote under ``path``, a folder that driver and executors share.

    Each batch is a folder of its own, overwritten if the batch is repeated after a failure. In complete mode the last batch is the result, in append mode all are.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batches/batch={number}")

    run = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    spark = stream.sparkSession
    done = run.lastProgress
    if done is None:
        return spark.createDataFrame([], stream.schema)
    out = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/batches")
    if mode == "complete":
        last = out.agg(F.max("batch")).first()[0]
        out = out.filter(F.col("batch") == F.lit(last))
    return out.drop("batch")
