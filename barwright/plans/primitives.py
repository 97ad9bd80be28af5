"""Queries of the joins, aggregations and windows that the operators are made of, each written twice: with the DataFrame API, and by hand in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.functions.dsl import ORDER, Ewm, Plan, fill, last_n, rounded
from barwright.operators import report
from barwright.operators.edges import type_sql
from barwright.plans.edges import detect, detect_sql
from barwright.plans.registry import ORACLES, query
from barwright.sources import bars as source
from barwright.sources.bars import BARS_H1, bars_h1, shared

#: Trading sessions by hour.
SESSIONS = [("asian", 0, 8), ("london", 7, 16), ("ny", 12, 21)]
_B = f"b AS ({BARS_H1})"


def _order():
    """Each symbol's bars in their order."""
    return Window.partitionBy("symbol").orderBy("t")


def _six(name: str):
    return (F.floor(F.col(name) * 1e6 + 0.5) / 1e6).alias(name)


def _sql6(x: str, name: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5e0) / 1e6 AS {name}"


# --- joins ---
@query("join_01", f"WITH {_B} SELECT x.t, x.symbol AS a, y.symbol AS b, {_sql6('x.close - y.close', 'spread')} FROM b x JOIN b y ON x.t = y.t WHERE x.symbol = 'click' AND y.symbol = 'view'")
def join_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two symbols aligned on the bars that both have."""
    bars = bars_h1(spark, sf_dir)
    side = lambda symbol, name: bars.filter(F.col("symbol") == symbol).select("t", F.col("symbol").alias(name), F.col("close").alias(f"close_{name}"))
    return side("click", "a").join(side("view", "b"), "t").withColumn("spread", F.col("close_a") - F.col("close_b")).select("t", "a", "b", _six("spread"))


@query("join_03", f"WITH {_B}, d AS (SELECT symbol, (t // 24)::BIGINT AS day, max(high) AS high, min(low) AS low FROM b GROUP BY ALL) SELECT b.symbol, b.t, {_sql6('d.high', 'prev_high')}, {_sql6('d.low', 'prev_low')} FROM b LEFT JOIN d ON d.symbol = b.symbol AND d.day = (SELECT max(day) FROM d z WHERE z.symbol = b.symbol AND z.day < (b.t // 24))")
def join_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the last day before that has bars, left-joined to every bar; one row a day and symbol, so Spark may broadcast it while it is small."""
    bars = bars_h1(spark, sf_dir).withColumn("day", F.expr("t div 24"))
    days = bars.groupBy("symbol", "day").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    week = Window.partitionBy("symbol").orderBy("day")
    days = days.select("symbol", "day", F.lag("high").over(week).alias("prev_high"), F.lag("low").over(week).alias("prev_low"))
    return bars.join(days, ["symbol", "day"], "left").select("symbol", "t", _six("prev_high"), _six("prev_low"))


@query("join_04", f"WITH {_B}, s(session, a, z) AS (VALUES {', '.join(repr(s) for s in SESSIONS)}) SELECT session, symbol, count(*) AS n, {_sql6('avg(high - low)', 'mean_range')} FROM b JOIN s ON t % 24 >= a AND t % 24 < z GROUP BY ALL")
def join_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars in each session that their hour lies in; the fixed table of sessions is broadcast."""
    sessions = spark.createDataFrame(SESSIONS, "session string, a int, z int")
    hour = F.col("t") % 24
    return bars_h1(spark, sf_dir).join(F.broadcast(sessions), (hour >= F.col("a")) & (hour < F.col("z"))).groupBy("session", "symbol").agg(F.count("*").alias("n"), F.avg(F.col("high") - F.col("low")).alias("mean_range")).select("session", "symbol", "n", _six("mean_range"))


@query("join_05", f"WITH {_B}, s AS (SELECT DISTINCT symbol FROM b) SELECT x.symbol AS a, y.symbol AS b, (SELECT count(*) FROM b p JOIN b q ON p.t = q.t WHERE p.symbol = x.symbol AND q.symbol = y.symbol) AS shared_bars FROM s x, s y WHERE x.symbol < y.symbol")
def join_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of symbols once, with the bars that both have."""
    bars = bars_h1(spark, sf_dir).select("symbol", "t")
    a, b = bars.withColumnRenamed("symbol", "a"), bars.withColumnRenamed("symbol", "b")
    return a.join(b, "t").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared_bars"))


@query("join_06", f"WITH {_B} SELECT symbol, t, {_sql6('close', 'close')} FROM b WHERE (t // 24) IN (SELECT t // 24 FROM b GROUP BY t // 24 HAVING count(*) >= 110)")
def join_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the days on which most symbols have most hours."""
    bars = bars_h1(spark, sf_dir).withColumn("day", F.expr("t div 24"))
    full = bars.groupBy("day").count().filter("count >= 110").select("day")
    return bars.join(full, "day", "left_semi").select("symbol", "t", _six("close"))


# --- aggregations ---
@query("agg_01", f"WITH {_B} SELECT symbol, (t % 24)::INT AS hour, count(*) AS n, sum(volume) AS volume, {_sql6('avg(close)', 'mean_close')} FROM b GROUP BY ALL")
def agg_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_h1(spark, sf_dir).groupBy("symbol", (F.col("t") % 24).cast("int").alias("hour")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.avg("close").alias("mean_close")).select("symbol", "hour", "n", "volume", _six("mean_close"))


@query("agg_02", f"WITH {_B}, d AS (SELECT symbol, t // 24 AS day, min(t) AS lo, max(t) AS hi FROM b GROUP BY ALL) SELECT b.symbol, b.t, b.t = lo AS first_of_day, b.t = hi AS last_of_day FROM b JOIN d ON d.symbol = b.symbol AND d.day = b.t // 24")
def agg_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group's extremes beside each of its rows: a window without an order, no join."""
    day = Window.partitionBy("symbol", "day")
    bars = bars_h1(spark, sf_dir).withColumn("day", F.expr("t div 24"))
    return bars.select("symbol", "t", (F.col("t") == F.min("t").over(day)).alias("first_of_day"), (F.col("t") == F.max("t").over(day)).alias("last_of_day"))


@query("agg_03", f"WITH {_B}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol, t // 24 ORDER BY t) AS i, row_number() OVER (PARTITION BY symbol, t // 24 ORDER BY t DESC) AS j FROM b) SELECT symbol, (t // 24)::BIGINT AS day, {_sql6('max(CASE WHEN i = 1 THEN open END)', 'open')}, {_sql6('max(high)', 'high')}, {_sql6('min(low)', 'low')}, {_sql6('max(CASE WHEN j = 1 THEN close END)', 'close')}, sum(volume) AS volume FROM r GROUP BY symbol, t // 24")
def agg_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last of a group by the bars' order, not by the rows'."""
    days = source.resample(bars_h1(spark, sf_dir), 24)
    return days.select("symbol", F.expr("t div 24").alias("day"), *(_six(c) for c in ("open", "high", "low", "close")), "volume")


@query("agg_04", f"WITH {_B} SELECT symbol, count(*) AS days FROM (SELECT symbol, t // 24 FROM b GROUP BY ALL) GROUP BY symbol")
def agg_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_h1(spark, sf_dir).select("symbol", F.expr("t div 24").alias("day")).distinct().groupBy("symbol").agg(F.count("*").alias("days"))


@query("agg_06", f"WITH {_B}, l AS (SELECT symbol, t % 24 < 12 AS morning, high - low AS rng FROM b) SELECT symbol, morning, count(*) AS n, {_sql6('avg(rng)', 'mean_range')}, 0 AS level FROM l GROUP BY symbol, morning UNION ALL SELECT symbol, NULL, count(*), {_sql6('avg(rng)', 'mean_range')}, 1 FROM l GROUP BY symbol UNION ALL SELECT NULL, NULL, count(*), {_sql6('avg(rng)', 'mean_range')}, 3 FROM l")
def agg_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_h1(spark, sf_dir).select("symbol", (F.col("t") % 24 < 12).alias("morning"), (F.col("high") - F.col("low")).alias("rng"))
    return bars.rollup("symbol", "morning").agg(F.count("*").alias("n"), F.avg("rng").alias("mean_range"), F.grouping_id().cast("int").alias("level")).select("symbol", "morning", "n", _six("mean_range"), "level")


# --- windows ---
def window(name: str, sql: str):
    """Register a column over each symbol's bars in order; ``sql`` is its form over ``b``."""

    def wrap(make):
        @query(name, f"WITH {_B} {sql}")
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(bars_h1(spark, sf_dir))

        return run

    return wrap


_RN = "n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS rn FROM b)"


@window("win_01", f", {_RN} SELECT n.symbol, n.t, {_sql6('p.close', 'before')}, {_sql6('q.close', 'after')} FROM n LEFT JOIN n p ON p.symbol = n.symbol AND p.rn = n.rn - 2 LEFT JOIN n q ON q.symbol = n.symbol AND q.rn = n.rn + 3")
def win_01(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "t", F.lag("close", 2).over(_order()).alias("before"), F.lead("close", 3).over(_order()).alias("after")).select("symbol", "t", _six("before"), _six("after"))


@window("win_02", f", {_RN} SELECT n.symbol, n.t, {_sql6('avg(p.close)', 'mean10')}, {_sql6('max(p.high)', 'high10')} FROM n JOIN n p ON p.symbol = n.symbol AND p.rn BETWEEN n.rn - 9 AND n.rn GROUP BY n.symbol, n.t, n.rn HAVING count(*) = 10")
def win_02(bars: DataFrame) -> DataFrame:
    last = _order().rowsBetween(-9, 0)
    out = bars.select("symbol", "t", F.avg("close").over(last).alias("mean10"), F.max("high").over(last).alias("high10"), F.count("*").over(last).alias("n"))
    return out.filter("n = 10").select("symbol", "t", _six("mean10"), _six("high10"))


@window("win_03", f"SELECT x.symbol, x.t, sum(y.volume) AS volume, {_sql6('max(y.high)', 'top')} FROM b x JOIN b y ON y.symbol = x.symbol AND y.t <= x.t GROUP BY x.symbol, x.t")
def win_03(bars: DataFrame) -> DataFrame:
    so_far = _order().rowsBetween(Window.unboundedPreceding, 0)
    return bars.select("symbol", "t", F.sum("volume").over(so_far).alias("volume"), F.max("high").over(so_far).alias("top")).select("symbol", "t", "volume", _six("top"))


@window("win_04", f", {_RN} SELECT n.symbol, n.t FROM n JOIN n p ON p.symbol = n.symbol AND abs(p.rn - n.rn) <= 5 GROUP BY n.symbol, n.t, n.high HAVING count(*) = 11 AND n.high = max(p.high)")
def win_04(bars: DataFrame) -> DataFrame:
    """Bars that are the highest of the five before and after."""
    around = _order().rowsBetween(-5, 5)
    return bars.select("symbol", "t", "high", F.max("high").over(around).alias("top"), F.count("*").over(around).alias("n")).filter("n = 11 AND high = top").select("symbol", "t")


@window("win_05", f", {_RN} SELECT n.symbol, n.t, {_sql6('quantile_cont(p.close, 0.25)', 'q25')} FROM n JOIN n p ON p.symbol = n.symbol AND p.rn BETWEEN n.rn - 19 AND n.rn GROUP BY n.symbol, n.t HAVING count(*) = 20")
def win_05(bars: DataFrame) -> DataFrame:
    last = _order().rowsBetween(-19, 0)
    return bars.select("symbol", "t", F.expr("percentile(close, 0.25)").over(last).alias("q25"), F.count("*").over(last).alias("n")).filter("n = 20").select("symbol", "t", _six("q25"))


@window("win_06", f", {_RN} SELECT n.symbol, n.t, {_sql6('(count(*) FILTER (WHERE p.close < n.close) + (count(*) FILTER (WHERE p.close = n.close) + 1) / 2e0) / 20', 'share')} FROM n JOIN n p ON p.symbol = n.symbol AND p.rn BETWEEN n.rn - 19 AND n.rn GROUP BY n.symbol, n.t HAVING count(*) = 20")
def win_06(bars: DataFrame) -> DataFrame:
    """Rank of the last of 20 closes among them, ties averaged."""
    kept = bars.select("symbol", "t", "close", F.collect_list("close").over(_order().rowsBetween(-19, 0)).alias("x")).filter(F.size("x") == 20)
    less, same = F.size(F.filter("x", lambda v: v < F.col("close"))), F.size(F.filter("x", lambda v: v == F.col("close")))
    return kept.withColumn("share", (less + (same + 1) / 2) / 20).select("symbol", "t", _six("share"))


@window("win_07", f", {_RN}, m AS (SELECT n.symbol, n.rn, n.t, avg(p.close) AS mean FROM n JOIN n p ON p.symbol = n.symbol AND p.rn BETWEEN n.rn - 19 AND n.rn GROUP BY n.symbol, n.rn, n.t HAVING count(*) = 20) SELECT m.symbol, m.t, {_sql6('avg(abs(p.close - m.mean))', 'deviation')} FROM m JOIN n p ON p.symbol = m.symbol AND p.rn BETWEEN m.rn - 19 AND m.rn GROUP BY m.symbol, m.t")
def win_07(bars: DataFrame) -> DataFrame:
    """Mean absolute deviation of the last 20 closes from their mean: higher-order functions instead of a user function."""
    last = _order().rowsBetween(-19, 0)
    kept = bars.select("symbol", "t", F.avg("close").over(last).alias("mean"), F.collect_list("close").over(last).alias("x")).filter(F.size("x") == 20)
    return kept.withColumn("deviation", F.aggregate(F.transform("x", lambda v: F.abs(v - F.col("mean"))), F.lit(0.0), lambda a, v: a + v) / 20).select("symbol", "t", _six("deviation"))


_ALPHA = 2 / 13


@window("win_08", f", {_RN}, w AS (SELECT n.symbol, n.t, sum(p.close * pow({1 - _ALPHA!r}::DOUBLE, n.rn - p.rn)) / sum(pow({1 - _ALPHA!r}::DOUBLE, n.rn - p.rn)) AS ewm, count(*) AS c FROM n JOIN n p ON p.symbol = n.symbol AND p.rn <= n.rn GROUP BY n.symbol, n.t) SELECT symbol, t, {_sql6('ewm', 'ewm')} FROM w WHERE c >= 12")
def win_08(bars: DataFrame) -> DataFrame:
    """Adjusted exponential average; the SQL form sums the weights themselves."""
    return Plan([{"ewm": Ewm("close", 12)}]).spark(bars).filter("ewm IS NOT NULL").select("symbol", "t", _six("ewm"))


@window("win_09", f", g AS (SELECT symbol, t, CASE WHEN t % 3 = 0 THEN close END AS x FROM b) SELECT symbol, t, {_sql6('(SELECT max_by(z.x, z.t) FROM g z WHERE z.symbol = g.symbol AND z.t <= g.t AND z.x IS NOT NULL)', 'filled')} FROM g")
def win_09(bars: DataFrame) -> DataFrame:
    holes = bars.withColumn("x", F.when(F.col("t") % 3 == 0, F.col("close")))
    return holes.select("symbol", "t", F.last("x", ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, 0)).alias("filled")).select("symbol", "t", _six("filled"))


#: The windows of win_02, win_04, win_08 and win_09 as plans, by chunks of rows with halos and carried states.
_LONG = {
    "win_02": (Plan([{"mean10": f"avg(close) {last_n(10)}", "high10": f"max(high) {last_n(10)}", "n": f"count(*) {last_n(10)}"}]), "n = 10", ["mean10", "high10"]),
    "win_04": (Plan([{"top": f"max(high) OVER ({ORDER} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)", "n": f"count(*) OVER ({ORDER} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"}]), "n = 11 AND high = top", []),
    "win_08": (Plan([{"ewm": Ewm("close", 12)}]), "ewm IS NOT NULL", ["ewm"]),
    "win_09": (Plan([{"x": "CASE WHEN t % 3 = 0 THEN close END"}, {"filled": fill("x")}]), "true", ["filled"]),
}
for _name, (_plan, _kept, _columns) in _LONG.items():
    query(f"{_name}_long", ORACLES[_name])(
        lambda spark, sf_dir, plan=_plan, kept=_kept, columns=_columns: plan.long(bars_h1(spark, sf_dir), 128).filter(kept).select("symbol", "t", *map(_six, columns))
    )


@window("win_10", "SELECT symbol, t, (SELECT count(*) FROM b z WHERE z.symbol = b.symbol AND (z.volume > b.volume OR (z.volume = b.volume AND z.t <= b.t)))::BIGINT AS place FROM b")
def win_10(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "t", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("volume"), "t")).cast("long").alias("place"))


@window("win_11", f"SELECT x.symbol, x.t, count(*) AS n, {_sql6('avg(y.close)', 'mean_day')} FROM b x JOIN b y ON y.symbol = x.symbol AND y.t > x.t - 24 AND y.t <= x.t GROUP BY x.symbol, x.t")
def win_11(bars: DataFrame) -> DataFrame:
    """The last 24 hours, however many bars they have: a range frame, where gaps leave row frames too long."""
    day = _order().rangeBetween(-23, 0)
    return bars.select("symbol", "t", F.count("*").over(day).alias("n"), F.avg("close").over(day).alias("mean_day")).select("symbol", "t", "n", _six("mean_day"))


@window("win_12", f", {_RN}, u AS (SELECT *, close > open AS up FROM n) SELECT symbol, t, (rn - coalesce((SELECT max(z.rn) FROM u z WHERE z.symbol = u.symbol AND z.rn < u.rn AND z.up <> u.up), 0))::BIGINT AS run FROM u")
def win_12(bars: DataFrame) -> DataFrame:
    """How many bars in a row, this one included, went the same way."""
    up = bars.withColumn("up", F.col("close") > F.col("open"))
    turn = up.withColumn("turn", F.coalesce(F.col("up") != F.lag("up").over(_order()), F.lit(True)).cast("int"))
    island = turn.withColumn("island", F.sum("turn").over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    return island.select("symbol", "t", F.row_number().over(Window.partitionBy("symbol", "island").orderBy("t")).cast("long").alias("run"))


# --- several timeframes, and what is written of them ---
_MULTI = source.multi_timeframe_sql(BARS_H1)
_FOUND = f"e AS (SELECT * REPLACE (split_part(symbol, '|', 1) AS symbol), split_part(symbol, '|', 2) AS timeframe FROM ({detect_sql(_MULTI)}))"
_BEST = "k AS (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY is_significant DESC, sharpe_ratio DESC, edge_key DESC) AS place, count(*) OVER g AS total_edges, sum(is_significant::INT) OVER g::BIGINT AS significant_edges FROM e WINDOW g AS (PARTITION BY symbol, timeframe))"
_MATRIX = f"WITH {_FOUND}, {_BEST} SELECT symbol, timeframe, total_edges, significant_edges, CASE WHEN significant_edges > 0 THEN edge_key ELSE 'None' END AS top_edge, CASE WHEN significant_edges > 0 THEN {type_sql()} ELSE '-' END AS top_edge_type, CASE WHEN significant_edges > 0 THEN sharpe_ratio ELSE 0 END AS sharpe_ratio, CASE WHEN significant_edges > 0 THEN win_rate ELSE 0 END AS win_rate, CASE WHEN significant_edges > 0 THEN p_value ELSE 1 END AS p_value, CASE WHEN significant_edges > 0 THEN n ELSE 0 END AS sample_size FROM k WHERE place = 1"


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.matrix(source.by_series(detect(source.multi_timeframe(bars_h1(spark, sf_dir)))))


query("eng_05", _MATRIX)(_matrix)


_VIEWS = {"timeframe": "timeframe", "symbol": "symbol", "edge_type": "top_edge_type"}


@query("eng_05_overview", " UNION ALL ".join(
    f"SELECT '{view}' AS view, {column} AS name, count(*) AS series, {rounded('avg(significant_edges)', 4)} AS avg_significant, {rounded('avg(sharpe_ratio)', 4)} AS avg_sharpe, {rounded('avg(win_rate)', 4)} AS avg_win_rate "
    f"FROM ({_MATRIX}) WHERE '{view}' <> 'edge_type' OR significant_edges > 0 GROUP BY {column}" for view, column in _VIEWS.items()
))
def eng_05_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.overview(_matrix(spark, sf_dir))


@query("eng_05_best", f"SELECT * FROM ({_MATRIX}) ORDER BY sharpe_ratio DESC, symbol, timeframe LIMIT 20")
def eng_05_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.best_series(_matrix(spark, sf_dir))


@query("agg_05", f"SELECT symbol, {', '.join(f'max(CASE WHEN timeframe = {tf!r} THEN significant_edges END) AS {tf}' for tf in source.MULTI)} FROM ({_MATRIX}) GROUP BY symbol")
def agg_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.pivot(_matrix(spark, sf_dir), list(source.MULTI))


@query("snk_02", _MATRIX)
def snk_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix through a CSV file with a header."""
    path, rows = shared(spark, "matrix"), _matrix(spark, sf_dir)
    report.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


def _as_files(spark: SparkSession, bars: DataFrame) -> str:
    """Hourly bars as CSV files; where they are."""
    path = shared(spark, "csv")
    rows = bars.select("symbol", F.timestamp_seconds(F.col("t") * 3600).alias("time"), "open", "high", "low", "close", F.col("volume").cast("long").alias("tick_volume"), F.lit(0).cast("long").alias("real_volume"), F.lit(0.0).alias("spread"))
    source.write_csv(rows.withColumn("timeframe", F.lit("H1")), path)
    return path


@query("src_03_files", f"WITH {_B} SELECT DISTINCT symbol FROM b")
def src_03_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols that a folder of bar files has, by the files' names."""
    return source.csv_symbols(spark, _as_files(spark, bars_h1(spark, sf_dir)))


@query("src_02", f"WITH {_B} SELECT symbol, t, {_sql6('close', 'close')}, volume FROM b WHERE t BETWEEN (SELECT min(t) + 24 FROM b) AND (SELECT min(t) + 96 FROM b)")
def src_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars through ``<SYMBOL>_<TF>.csv`` files: written, then read back by name and by an inclusive range of times."""
    bars = bars_h1(spark, sf_dir)
    path, least = _as_files(spark, bars), bars.agg(F.min("t")).first()[0]
    start, end = (spark.range(1).select(F.timestamp_seconds(F.lit((least + h) * 3600)).cast("string")).first()[0] for h in (24, 96))
    read = source.to_series(source.read_csv(spark, path, timeframe="H1", start=start, end=end).drop("timeframe"))
    return read.select("symbol", F.col("t").cast("long").alias("t"), _six("close"), "volume")


query("src_01", f"WITH {_B} SELECT symbol, t, {_sql6('close', 'close')} FROM b WHERE symbol IN ('click', 'view')")(
    lambda spark, sf_dir: source.Table(bars_h1(spark, sf_dir).withColumns({"timeframe": F.lit("H1"), "time": F.timestamp_seconds(F.col("t") * 3600)})).load(["click", "view"], "H1").select("symbol", "t", _six("close"))
)
