"""Bars: the one long table of (symbol, timeframe, time) that all operators work on, and where it comes from."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Minutes of each timeframe, and the trading sessions' hours in UTC.
TIMEFRAMES = {"M1": 1, "M5": 5, "M15": 15, "M30": 30, "H1": 60, "H4": 240, "D1": 1440, "W1": 10080, "MN1": 43200}
SESSIONS = {"asian": (0, 8), "london": (7, 16), "ny": (12, 21), "london_ny_overlap": (12, 16), "asian_london_overlap": (7, 8)}
#: The simulated source's symbols.
SIMULATED_SYMBOLS = ["EURUSD", "GBPUSD", "USDJPY", "USDCHF", "AUDUSD", "USDCAD", "NZDUSD", "EURGBP", "EURJPY", "GBPJPY"]

SCHEMA = "time timestamp, open double, high double, low double, close double, tick_volume bigint, real_volume bigint, spread double"


def shared(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one in local mode if none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="barwright-")
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read from there: what is read several times is made once."""
    path = shared(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def hour_index(ts: str = "ts") -> str:
    """Hours since 1970 of a timestamp without a zone, whatever the session's zone is."""
    return f"CAST(datediff(to_date({ts}), DATE'1970-01-01') AS BIGINT) * 24 + hour({ts})"


def bars_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of ``events``: symbol, t (hours since 1970), open, high, low, close, volume."""
    ticks = events(spark, sf_dir).selectExpr("event_type AS symbol", f"{hour_index()} AS t", "struct(ts, event_id) AS at", "value")
    return ticks.groupBy("symbol", "t").agg(
        F.min_by("value", "at").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "at").alias("close"), F.count("*").cast("double").alias("volume")
    )


BARS_H1 = """SELECT event_type AS symbol, (epoch(date_trunc('hour', ts)) / 3600)::BIGINT AS t, arg_min(value, struct_pack(ts := ts, id := event_id)) AS open, max(value) AS high,
min(value) AS low, arg_max(value, struct_pack(ts := ts, id := event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY ALL"""


def bars_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of ``orders`` by priority; t counts hours too, so that calendars work alike."""
    ticks = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_orderpriority AS symbol", "CAST(datediff(to_date(o_orderdate), DATE'1970-01-01') AS BIGINT) * 24 AS t", "o_orderkey", "o_totalprice / 1000 AS value"
    )
    return ticks.groupBy("symbol", "t").agg(
        F.min_by("value", "o_orderkey").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "o_orderkey").alias("close"), F.count("*").cast("double").alias("volume")
    )


BARS_D1 = """SELECT o_orderpriority AS symbol, (epoch(date_trunc('day', o_orderdate)) / 3600)::BIGINT AS t, arg_min(o_totalprice / 1000, o_orderkey) AS open, max(o_totalprice / 1000) AS high,
min(o_totalprice / 1000) AS low, arg_max(o_totalprice / 1000, o_orderkey) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY ALL"""


def read_csv(spark: SparkSession, folder: str, symbols: list[str] | None = None, timeframe: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of ``<SYMBOL>_<TF>.csv`` files, from ``start`` to ``end`` inclusive; no rows if nothing matches."""
    df = spark.read.schema(SCHEMA).option("header", True).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).csv(folder)
    # The name is the file's, or that of the folder of files which :func:`write_csv` leaves.
    found = lambda k: F.regexp_extract(F.input_file_name(), r"(?:/|file=)([^/_=]+)_([^/_.=]+)(?:\.csv$|/part-[^/]*$)", k)
    df = df.withColumns({"symbol": found(1), "timeframe": found(2)}).drop("file")
    if symbols:
        df = df.filter(F.col("symbol").isin(symbols))
    if timeframe:
        df = df.filter(F.col("timeframe") == timeframe)
    if start:
        df = df.filter(F.col("time") >= F.lit(start).cast("timestamp"))
    if end:
        df = df.filter(F.col("time") <= F.lit(end).cast("timestamp"))
    return df


def to_series(bars: DataFrame) -> DataFrame:
    """Series for the operators from bars (symbol, timeframe, time, prices, tick_volume or real_volume, as :func:`read_csv`, :func:`simulate` and :class:`Resolver` give them).

    A series is one symbol at one timeframe, named ``SYMBOL|TF``, so that windows never mix timeframes. ``t`` is hours since 1970, with a fraction where bars are shorter. Ticks
    count as volume, real volume stands in where there is no tick volume, and 1 where there is neither.
    """
    there = [F.col(c).cast("double") for c in ("tick_volume", "real_volume") if c in bars.columns]
    hours = F.unix_micros("time") / 3_600_000_000
    name = F.concat_ws("|", "symbol", "timeframe") if "timeframe" in bars.columns else F.col("symbol")
    return bars.select(name.alias("symbol"), hours.alias("t"), *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")), F.coalesce(*there, F.lit(1.0)).alias("volume"))


def by_series(results: DataFrame) -> DataFrame:
    """Results of :func:`to_series` series with symbol and timeframe apart again."""
    parts = F.split("symbol", r"\|")
    return results.withColumns({"symbol": parts[0], "timeframe": F.get(parts, F.lit(1))})


def resample(bars: DataFrame, hours: int) -> DataFrame:
    """Bars of ``hours`` hours from series of shorter ones; days begin at midnight."""
    bucket = F.expr(f"CAST(floor(t / {hours}) AS BIGINT) * {hours}")
    return bars.groupBy("symbol", bucket.alias("t")).agg(F.min_by("open", "t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "t").alias("close"), F.sum("volume").alias("volume"))


#: Hours of the timeframes that an analysis of several is made of.
MULTI = {"H1": 1, "H4": 4, "D1": 24}


def multi_timeframe(bars: DataFrame, timeframes: dict[str, int] = MULTI) -> DataFrame:
    """Hourly series at several timeframes, each a series of its own."""
    out = None
    for name, hours in timeframes.items():
        one = (bars if hours == 1 else resample(bars, hours)).withColumn("symbol", F.concat("symbol", F.lit(f"|{name}")))
        out = one if out is None else out.unionByName(one)
    return out


def multi_timeframe_sql(base: str, timeframes: dict[str, int] = MULTI) -> str:
    each = "SELECT concat(symbol, '|{n}') AS symbol, (floor(t / {h}) * {h})::BIGINT AS t, arg_min(open, t) AS open, max(high) AS high, min(low) AS low, arg_max(close, t) AS close, sum(volume) AS volume FROM ({base}) GROUP BY symbol, (floor(t / {h}) * {h})::BIGINT"
    return " UNION ALL ".join(each.format(n=n, h=h, base=base) for n, h in timeframes.items())


def write_csv(bars: DataFrame, folder: str) -> None:
    """Bars as a folder of CSV files for each symbol and timeframe, named like :func:`read_csv` expects them."""
    columns = ["time", "open", "high", "low", "close", "tick_volume", "real_volume", "spread"]
    name = F.concat_ws("_", "symbol", "timeframe")
    stamped = bars.withColumn("time", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss"))
    stamped.select(name.alias("file"), *columns).write.partitionBy("file").option("header", True).csv(folder)


#: Opening prices, and correlation of each pair's steps with those of the first.
DEMO = {"EURUSD": (1.10, 1.0), "GBPUSD": (1.25, 0.7), "USDJPY": (130.0, -0.5)}


def demo(spark: SparkSession, days: int = 60, seed: int = 42) -> DataFrame:
    """Hourly weekday bars of three pairs whose steps are correlated as ``DEMO`` says, larger by 1.3 in the London session and by 1.2 in the rest of the New York one."""
    step = 0.10 / (252 * 24) ** 0.5
    hours = spark.range(days * 24).select((F.col("id") + 24 * F.lit(18995)).alias("t"))  # from 2022-01-03, a Monday
    hours = hours.filter(F.expr("(floor(t / 24) + 3) % 7") < 5)
    uniform = lambda *key: (F.pmod(F.xxhash64(*key), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = lambda *key: F.sqrt(-2 * F.ln(uniform(*key, F.lit(seed)))) * F.cos(2 * 3.141592653589793 * uniform(*key, F.lit(seed + 1)))
    hour = F.col("t") % 24
    lively = F.when((hour >= 7) & (hour < 16), 1.3).when((hour >= 12) & (hour < 21), 1.2).otherwise(1.0)
    pairs = spark.createDataFrame([(k, *v) for k, v in DEMO.items()], "symbol string, base double, rho double")
    df = hours.join(F.broadcast(pairs))
    shared_step = normal(F.lit("shared"), "t") * lively
    df = df.withColumn("step", step * (F.col("rho") * shared_step + F.sqrt(1 - F.col("rho") * F.col("rho")) * normal("symbol", "t")))
    df = df.withColumn("close", F.col("base") * F.exp(F.expr("sum(step) OVER (PARTITION BY symbol ORDER BY t)")))
    noise = lambda k, size: size * step * normal(F.lit(k), "symbol", "t")
    df = df.withColumn("open", F.col("close") * (1 + noise("open", 0.3)))
    df = df.withColumn("high", F.greatest("open", "close") * (1 + F.abs(noise("high", 0.5)))).withColumn("low", F.least("open", "close") * (1 - F.abs(noise("low", 0.5))))
    volume = F.floor(1000 * (1 + 2 * uniform(F.lit("volume"), "t"))).cast("long")
    return df.select("symbol", F.lit("H1").alias("timeframe"), F.timestamp_seconds(F.col("t") * 3600).alias("time"), "open", "high", "low", "close", volume.alias("tick_volume"))


class Source:
    """Where bars come from: ``load`` gives those of some symbols at a timeframe, ``symbols`` names what there is, ``available`` tells whether it can be asked."""

    def load(self, symbols: list[str], timeframe: str = "H1", start: str | None = None, end: str | None = None) -> DataFrame:
        raise NotImplementedError

    def symbols(self) -> DataFrame:
        raise NotImplementedError

    def available(self) -> bool:
        return True


class Table(Source):
    """A table with symbol, timeframe and time; filters reach its files."""

    def __init__(self, table: DataFrame):
        self.table = table

    def load(self, symbols: list[str], timeframe: str = "H1", start: str | None = None, end: str | None = None) -> DataFrame:
        out = self.table.filter(F.col("symbol").isin(symbols) & (F.col("timeframe") == timeframe))
        out = out.filter(F.col("time") >= F.lit(start).cast("timestamp")) if start else out
        return out.filter(F.col("time") <= F.lit(end).cast("timestamp")) if end else out

    def symbols(self) -> DataFrame:
        return self.table.select("symbol").distinct()


def csv_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return read_csv(spark, folder).select("symbol").distinct()


def simulate(spark: SparkSession, symbols: list[str], timeframe: str = "H1", start: str = "2022-01-03", end: str = "2022-06-30", seed: int = 42) -> DataFrame:
    """Geometric Brownian bars on weekdays; drift and volatility follow a stable hash of the symbol, so reruns agree."""
    minutes = TIMEFRAMES[timeframe]
    stamps = spark.sql(f"SELECT explode(sequence(timestamp'{start}', timestamp'{end}', interval {minutes} minutes)) AS time").filter("weekday(time) < 5")
    names = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    df = stamps.join(F.broadcast(names))
    h = F.pmod(F.crc32(F.encode("symbol", "utf-8")), F.lit(100))
    dt = minutes / (252 * 24 * 60)
    uniform = lambda k: (F.pmod(F.xxhash64("symbol", "time", F.lit(seed + k)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = lambda k: F.sqrt(-2 * F.ln(uniform(k))) * F.cos(2 * 3.141592653589793 * uniform(k + 1))
    vol = 0.08 + h / 1000
    df = df.withColumn("step", (0.01 + h / 10000) * dt + vol * (dt**0.5) * normal(0)).withColumn("noise", vol * (dt**0.5) * 0.5)
    df = df.withColumn("close", F.expr("exp(sum(step) OVER (PARTITION BY symbol ORDER BY time))"))
    df = df.withColumn("open", F.col("close") * (1 + F.col("noise") * normal(2)))
    df = df.withColumn("high", F.greatest("open", "close") * (1 + F.abs(F.col("noise") * normal(4)))).withColumn("low", F.least("open", "close") * (1 - F.abs(F.col("noise") * normal(6))))
    volume = (1000 * (1 + uniform(8) * 2) * (1 + (F.col("high") - F.col("low")) / F.col("close") * 100)).cast("long")
    return df.withColumn("tick_volume", volume).select("symbol", F.lit(timeframe).alias("timeframe"), "time", "open", "high", "low", "close", "tick_volume", (F.col("tick_volume") * 10).alias("real_volume"), (1 + 2 * uniform(9)).alias("spread"))


class Resolver(Source):
    """The first source that has the bars: a table, a folder of CSV files, simulation."""

    def __init__(self, spark: SparkSession, table: str | None = None, csv: str | None = None):
        self.spark, self.table, self.csv = spark, table, csv

    def load(self, symbols: list[str], timeframe: str = "H1", start: str = "2022-01-03", end: str = "2022-06-30") -> DataFrame:
        if self.table and self.spark.catalog.tableExists(self.table):
            return self.spark.table(self.table).filter(F.col("symbol").isin(symbols) & (F.col("timeframe") == timeframe) & F.col("time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
        if self.csv:
            return read_csv(self.spark, self.csv, symbols, timeframe, start, end)
        return simulate(self.spark, symbols, timeframe, start, end)

    def symbols(self) -> DataFrame:
        found = self.spark.createDataFrame([(s,) for s in SIMULATED_SYMBOLS], "symbol string")
        if self.table and self.spark.catalog.tableExists(self.table):
            found = found.union(self.spark.table(self.table).select("symbol"))
        if self.csv:
            found = found.union(csv_symbols(self.spark, self.csv))
        return found.distinct()
