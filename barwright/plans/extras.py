"""Queries of sources, streams, models and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.operators import edges, learning, preprocess, report, validation
from barwright.plans.registry import ORACLES, QUERIES, query
from barwright.sources import bars
from barwright.sources.bars import shared
from barwright.streaming import ticks

_SECONDS = "CAST(datediff(to_date(time), DATE'1970-01-01') AS BIGINT) * 24 + hour(time)"


def _drain(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    return ticks.drain(stream, shared(spark, "stream"), mode)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.ticks(spark, f"{sf_dir}/events.parquet*")


_R = lambda c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6


@query("str_01", "SELECT event_type AS symbol, (epoch(date_trunc('hour', ts)) / 3600)::BIGINT AS t, arg_min(value, struct_pack(a := ts, b := event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, struct_pack(a := ts, b := event_id)) AS close, count(*) AS volume FROM events GROUP BY ALL")
def str_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _drain(spark, ticks.tumbling_bars(_stream(spark, sf_dir)))
    return out.selectExpr("symbol", f"{_SECONDS} AS t", "open", "high", "low", "close", "volume")


@query("str_02", "WITH e AS (SELECT event_type AS symbol, value, unnest(range(0, 20)) AS k, (epoch(date_trunc('hour', ts)) / 3600)::BIGINT AS h FROM events) SELECT symbol, h - k AS t, count(*) AS n, floor(avg(value) * 1e6 + 0.5e0) / 1e6 AS mean_value FROM e GROUP BY ALL")
def str_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _drain(spark, ticks.sliding_stats(_stream(spark, sf_dir)))
    return out.selectExpr("symbol", f"{_SECONDS} AS t", "n", "mean_value").withColumn("mean_value", _R("mean_value"))


@query("str_03", "WITH l AS (SELECT event_type AS symbol, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), s AS (SELECT symbol, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM l), c AS (SELECT symbol, g, count(*) AS n FROM s GROUP BY ALL) SELECT symbol, count(*) AS sessions, sum(n)::BIGINT AS events, max(n) AS longest FROM c GROUP BY symbol")
def str_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _drain(spark, ticks.sessions(_stream(spark, sf_dir)))
    return out.groupBy("symbol").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest"))


@query("str_04", "WITH l AS (SELECT event_type AS symbol, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts))) / 1e6 AS s FROM events) SELECT symbol, count(*) AS gaps, floor(max(s) * 1e3 + 0.5e0) / 1e3 AS longest FROM l WHERE s > 5400 GROUP BY symbol")
def str_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _drain(spark, ticks.gaps(_stream(spark, sf_dir)), "append")
    return out.groupBy("symbol").agg(F.count("*").alias("gaps"), (F.floor(F.max("seconds") * 1e3 + 0.5) / 1e3).alias("longest"))


@query("str_04_momentum")
def str_04_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    with ticks.rocksdb(spark):
        return _drain(spark, ticks.momentum(_stream(spark, sf_dir)), "append")


@query("str_06", "SELECT event_type AS symbol, count(DISTINCT event_id) AS n FROM events GROUP BY ALL")
def str_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _stream(spark, sf_dir)
    return _drain(spark, ticks.deduplicated(stream.unionByName(stream)), "append").groupBy("symbol").agg(F.count("*").alias("n"))


@query("src_04")
def src_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.simulate(spark, bars.SIMULATED_SYMBOLS[:3], "H4", "2022-01-03", "2022-02-28")


@query("src_05", "SELECT unnest([" + ", ".join(f"'{x}'" for x in bars.SIMULATED_SYMBOLS) + "]) AS symbol")
def src_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.Resolver(spark).symbols()


_FEATURES = learning.long_sql(bars.BARS_H1)


@query("ml_01", f"{_FEATURES}, {learning.INFORMATION_SQL} SELECT * FROM inf")
def ml_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.mutual_information(bars.bars_h1(spark, sf_dir))


@query("ml_01_knn")
def ml_01_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.knn_information(bars.bars_h1(spark, sf_dir))


@query("ml_02", f"{_FEATURES}, {learning.IMPORTANCE_SQL} SELECT * FROM imp")
def ml_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.importance(bars.bars_h1(spark, sf_dir))


@query("ml_09", f"{_FEATURES}, {learning.IMPORTANCE_SQL}, {learning.INFORMATION_SQL} SELECT symbol, feature_name, floor((importance + mutual_information) * 1e4 + 0.5e0) / 1e4 AS score FROM imp JOIN inf USING (symbol, feature_name)")
def ml_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.ranking(bars.bars_h1(spark, sf_dir))


@query("ml_03")
def ml_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.direction(bars.bars_h1(spark, sf_dir), "forest")


@query("ml_04")
def ml_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.direction(bars.bars_h1(spark, sf_dir), "boosting")


@query("ml_05")
def ml_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.regimes(bars.bars_h1(spark, sf_dir))


@query("ml_07")
def ml_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.anomalies(bars.bars_h1(spark, sf_dir))


#: All families of the hourly bars: what the reports read.
_ALL = ORACLES["eng_03"]


@query("eng_01", f"SELECT * FROM ({_ALL}) WHERE n >= 100 AND p_value <= 0.05 AND win_rate >= 0.45")
def eng_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.significant(QUERIES["eng_03"](spark, sf_dir))


@query("eng_02", f"SELECT * FROM ({_ALL}) WHERE is_significant ORDER BY sharpe_ratio DESC, symbol, edge_key LIMIT 10")
def eng_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_edges(QUERIES["eng_03"](spark, sf_dir))


@query("rpt_08", f"SELECT {edges.type_sql()} AS edge_type, count(*) AS total, sum(is_significant::INT)::BIGINT AS significant FROM ({_ALL}) GROUP BY ALL")
def rpt_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(QUERIES["eng_03"](spark, sf_dir))


@query("rpt_05", f"SELECT * FROM ({_ALL}) WHERE is_significant ORDER BY sharpe_ratio DESC, symbol, edge_key LIMIT 15")
def rpt_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_edges(QUERIES["eng_03"](spark, sf_dir), 15)


@query("snk_01")
def snk_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_json(QUERIES["eng_03"](spark, sf_dir))


@query("snk_01_report", f"SELECT {edges.type_sql()} AS edge_type, count(*) AS total, sum(is_significant::INT)::BIGINT AS significant, (SELECT count(*) FROM ({_ALL})) AS total_edges, (SELECT sum(is_significant::INT)::BIGINT FROM ({_ALL})) AS significant_edges FROM ({_ALL}) GROUP BY ALL")
def snk_01_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested JSON report, written, read back and taken apart: totals beside each type's counts."""
    path = bars.shared(spark, "report")
    report.write_report(bars.kept(QUERIES["eng_03"](spark, sf_dir), "edges"), path)
    fields = "total_edges long, significant_edges long, types array<struct<edge_type: string, total: long, significant: long>>"
    return spark.read.schema(fields).json(f"{path}/report").selectExpr("total_edges", "significant_edges", "inline(types)")


@query("snk_03_data", f"SELECT symbol, count(*) AS bars, min(t) AS first_t, max(t) AS last_t, min(low) AS lowest, max(high) AS highest, avg(volume) AS mean_volume FROM ({bars.BARS_H1}) GROUP BY symbol")
def snk_03_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.data_summary(bars.bars_h1(spark, sf_dir))


#: The bars with faults: closes missing, highs too low, and a second row for some times.
_DIRTY = """SELECT symbol, t, 0 AS o, open, CASE WHEN t % 7 = 0 THEN least(open, close) ELSE high END AS high, low, CASE WHEN t % 5 = 0 THEN NULL ELSE close END AS close, volume FROM {0}
UNION ALL SELECT symbol, t, 1 AS o, open, high, low, 0e0 AS close, volume FROM {0} WHERE t % 3 = 0"""
_DIRTY_SQL = _DIRTY.format(f"({bars.BARS_H1})")
_CLEAN_SQL = f"""SELECT symbol, t, open, high, low, close, volume FROM (SELECT symbol, t, open, greatest(high, open, close) AS high, least(low, open, close) AS low, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close, volume
FROM (SELECT *, row_number() OVER (PARTITION BY symbol, t ORDER BY o) AS rn FROM ({_DIRTY_SQL})) WHERE rn = 1) WHERE close IS NOT NULL"""
_ISSUES = {"missing_close": "close IS NULL", "high_too_low": "high < greatest(open, close)", "low_too_high": "low > least(open, close)", "not_positive": "least(open, high, low, close) <= 0"}


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_DIRTY.format("{hourly}"), hourly=bars.bars_h1(spark, sf_dir))


@query("pre_01_issues", " UNION ALL ".join(f"SELECT symbol, '{k}' AS issue, count(*) AS rows FROM ({_DIRTY_SQL}) WHERE {c} GROUP BY symbol" for k, c in _ISSUES.items()) + f" UNION ALL SELECT symbol, 'duplicate_time' AS issue, count(*) - count(DISTINCT t) AS rows FROM ({_DIRTY_SQL}) GROUP BY symbol HAVING count(*) > count(DISTINCT t)")
def pre_01_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.issues(_dirty(spark, sf_dir))


_STEPS = preprocess.plan(*preprocess.STEPS)
# Filled closes repeat, so some windows are equally volatile but for the last digits of a sum, and their ranks would hang on those: they are compared in pre_10.
_STEPS.out = {c: digits for c, digits in _STEPS.out.items() if not c.startswith("vol_rank")}


@query("pre_13_pipeline", _STEPS.sql(_CLEAN_SQL))
def pre_13_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faulty bars cleaned, then all features of time, price, returns and volatility."""
    return _STEPS.query(preprocess.clean(_dirty(spark, sf_dir), "o"))


@query("pre_14_session", f"SELECT symbol, t, close, volume FROM ({bars.BARS_H1}) WHERE t % 24 >= 7 AND t % 24 < 16 AND (t // 24 + 3) % 7 < 5 AND volume >= 2")
def pre_14_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the London session on working days with two ticks or more, of every symbol."""
    return preprocess.narrowed(bars.bars_h1(spark, sf_dir), session="london", weekdays=[0, 1, 2, 3, 4], least_volume=2).select("symbol", "t", "close", "volume")


@query("eng_04")
def eng_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every significant signed edge with the bootstrap of its mean and its walk-forward folds."""
    return validation.validate(bars.bars_h1(spark, sf_dir))


@query("src_11", "SELECT o_orderkey AS ticket, (epoch(o_orderdate) / 3600)::BIGINT AS t, o_orderpriority AS symbol, o_orderstatus AS type, o_totalprice AS price FROM orders")
def src_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order log: a projection of the order table."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.selectExpr("o_orderkey AS ticket", f"{bars.hour_index('o_orderdate')} AS t", "o_orderpriority AS symbol", "o_orderstatus AS type", "o_totalprice AS price")


@query("src_12", "SELECT event_type AS symbol, count(*) AS ticks, count(DISTINCT user_id) AS users, min(value) AS least, max(value) AS most FROM events GROUP BY ALL")
def src_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each symbol: a small table."""
    return bars.events(spark, sf_dir).groupBy(F.col("event_type").alias("symbol")).agg(F.count("*").alias("ticks"), F.countDistinct("user_id").alias("users"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("src_14")
def src_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.Resolver(spark).load(["EURUSD", "GBPUSD"], "H1", "2022-01-03", "2022-01-31")


@query("src_17")
def src_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of three pairs, two of which move with and against the first, livelier in the London and New York sessions."""
    return bars.demo(spark)


@query("ml_06")
def ml_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.regime_edges(bars.bars_h1(spark, sf_dir))


@query("ml_08")
def ml_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.anomaly_edge(bars.bars_h1(spark, sf_dir))


@query("str_05", "WITH b AS (SELECT event_type AS symbol, (epoch(date_trunc('hour', ts)) / 3600)::BIGINT AS t, arg_min(value, struct_pack(a := ts, b := event_id)) AS open, arg_max(value, struct_pack(a := ts, b := event_id)) AS close, count(*) AS volume FROM events GROUP BY ALL) SELECT * FROM b WHERE (t + 1) * 3600 <= (SELECT epoch(max(ts)) - 3600 FROM events)")
def str_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars in append mode: a window comes out once the watermark has passed it. A last file brings ticks for hours long past, which are dropped."""
    path = shared(spark, "late-ticks")
    events = bars.events(spark, sf_dir)
    first, middle = events.agg(F.min("ts"), F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()
    half = F.unix_micros(F.col("ts").cast("timestamp")) <= F.lit(middle)
    # Spark holds late rows against the watermark of the batch before, so two batches come before the late one.
    events.filter(half).coalesce(1).write.parquet(path)
    events.filter(~half).coalesce(1).write.mode("append").parquet(path)
    late = events.filter(F.col("ts") < F.lit(first) + F.expr("INTERVAL 2 HOURS")).withColumns({"value": F.col("value") + 1e6, "event_id": -F.col("event_id")})
    late.coalesce(1).write.mode("append").parquet(path)
    bars_ = ticks.tumbling_bars(ticks.ticks(spark, path, 1))
    return _drain(spark, bars_, "append").selectExpr("symbol", f"{_SECONDS} AS t", "open", "close", "volume")
