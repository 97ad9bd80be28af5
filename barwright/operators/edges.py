"""Edges: conditional forward-return tests, as data.

A signed edge takes forward returns where ``up`` holds and their negatives where ``down`` holds; a bar can be in both. A contrast compares a value where a
condition holds with all other bars, those without a verdict included, by the pooled t-test. All edges of one table are evaluated in one aggregation by edge.
Samples under 30 give no row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.functions.dist import t_p, t_p_sql
from barwright.functions.dsl import ORDER, Plan, Quantile, Rank, dialect, div, fill, lag, last_n, lead, quantile, roll, rounded
from barwright.operators.features import ADX, BB, DAY, RUNS, SQUEEZE, STOCH, TP, TR, VWAP, rsi

MIN_SAMPLE, ALPHA = 30, 0.05


@dataclass(frozen=True)
class Signed:
    key: str
    up: str
    down: str
    k: int = 10
    value: str | None = None
    periods: float | None = None
    #: What must hold besides the p-value: a condition that is the same for every row of a series.
    given: str = "true"

    def returns(self) -> str:
        return self.value or f"f{self.k}"

    def scale(self) -> float:
        return (self.periods or 252 / self.k) ** 0.5


@dataclass(frozen=True)
class Contrast:
    """``base``: what the values where the condition holds are measured by, one number for a series; the mean elsewhere if there is none. With ``larger``
    they must be larger than elsewhere to be significant.
    """

    key: str
    value: str
    condition: str
    base: str | None = None
    larger: bool = False

    def against(self) -> str:
        return self.base or f"avg(CASE WHEN NOT coalesce({self.condition}, false) THEN {self.value} END) OVER (PARTITION BY symbol)"


def forward(*ks: int) -> dict:
    return {f"f{k}": f"{div(lead('close', k), 'close')} - 1" for k in ks}


def _result_columns() -> list[str]:
    return [f"{rounded('mean_return')} AS mean_return", f"{rounded('std_return')} AS std_return", f"{rounded('t_statistic', 5)} AS t_statistic", f"{rounded('p_value', 5)} AS p_value", f"{rounded('win_rate')} AS win_rate", f"{rounded('sharpe_ratio', 5)} AS sharpe_ratio", f"coalesce(p_value < {ALPHA} AND ok, false) AS is_significant"]


def signed_cells(levels: list[dict], edges: list[Signed], bars: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The signed returns of every test: symbol, edge_key, scale, ok (its condition besides the p-value), r, and, if columns of the bars are kept, those and ``side`` (0 for up, 1 for down)."""
    df = Plan(levels).spark(bars)
    cells = [f"'{e.key}', CAST({e.scale()!r} AS DOUBLE), {side}, coalesce({e.given}, false), CAST(CASE WHEN {mask} THEN {sign}{e.returns()} END AS DOUBLE)" for e in edges for side, (mask, sign) in enumerate(((e.up, ""), (e.down, "-")))]
    rows = df.selectExpr("symbol", *(keep or []), dialect(f"stack({len(cells)}, {', '.join(cells)}) AS (edge_key, scale, side, ok, r)", True)).filter("r IS NOT NULL")
    return rows if keep else rows.drop("side")


def signed_results(rows: DataFrame) -> DataFrame:
    """One row for each series and test with enough returns."""
    out = rows.groupBy("symbol", "edge_key", "scale").agg(F.count("*").alias("n"), F.avg("r").alias("mean_return"), F.stddev_samp("r").alias("std_return"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), F.bool_and("ok").alias("ok")).filter(F.col("n") >= MIN_SAMPLE)
    out = out.withColumn("t_statistic", F.expr("mean_return / nullif(std_return / sqrt(n), 0)"))
    out = out.withColumns({"p_value": t_p(F.col("t_statistic"), F.col("n") - 1), "sharpe_ratio": F.expr("coalesce(mean_return / nullif(std_return, 0) * scale, 0D)")})
    return out.selectExpr("symbol", "edge_key", "n", *_result_columns())


def signed_spark(levels: list[dict], edges: list[Signed], bars: DataFrame) -> DataFrame:
    return signed_results(signed_cells(levels, edges, bars))


def signed_sql(levels: list[dict], edges: list[Signed], base: str) -> str:
    inner = Plan(levels, {}).sql(base)
    inner = inner[: inner.rindex(" SELECT symbol, t, ")] + " "
    last = inner.rsplit(" AS (SELECT *", 1)[0].rsplit(" ", 1)[-1]
    parts = [f"SELECT symbol, '{e.key}' AS edge_key, {e.scale()!r}::DOUBLE AS scale, coalesce({e.given}, false) AS ok, (CASE WHEN {mask} THEN {sign}{e.returns()} END)::DOUBLE AS r FROM {last}" for e in edges for mask, sign in ((e.up, ""), (e.down, "-"))]
    return dialect(
        f"""{inner}, cells AS ({' UNION ALL '.join(parts)}),
s AS (SELECT symbol, edge_key, scale, count(*) AS n, avg(r) AS mean_return, stddev_samp(r) AS std_return, avg((r > 0)::INT::DOUBLE) AS win_rate, bool_and(ok) AS ok FROM cells WHERE r IS NOT NULL GROUP BY ALL HAVING count(*) >= {MIN_SAMPLE}),
u AS (SELECT *, mean_return / nullif(std_return / sqrt(n), 0) AS t_statistic FROM s),
v AS (SELECT *, {t_p_sql('t_statistic', 'n - 1')} AS p_value, coalesce(mean_return / nullif(std_return, 0) * scale, 0) AS sharpe_ratio FROM u)
SELECT symbol, edge_key, n, {', '.join(_result_columns())} FROM v""",
        False,
    )


def _contrast_columns() -> list[str]:
    figures = [("mean_in", 6), ("mean_out", 6), ("std_in", 6), ("mean_return", 6), ("t_statistic", 5), ("p_value", 5), ("win_rate", 6)]
    return [f"{rounded(c, k)} AS {c}" for c, k in figures] + [f"coalesce(p_value < {ALPHA} AND (mean_in > mean_out OR NOT larger), false) AS is_significant"]


_POOLED = "(mean_in - mean_out) / nullif(sqrt(((n - 1) * var_in + (n_out - 1) * var_out) / (n + n_out - 2) * (1e0 / n + 1e0 / n_out)), 0)"
#: Values above the base, and the mean as a share above it where a base of its own is given.
_MEASURED = "sqrt(var_in) AS std_in, CASE WHEN ratio THEN mean_in / nullif(base, 0) - 1 ELSE mean_in END AS mean_return"


def contrast_spark(levels: list[dict], edges: list[Contrast], bars: DataFrame) -> DataFrame:
    df = Plan([*levels, {f"base_{k}": e.against() for k, e in enumerate(edges)}]).spark(bars)
    cells = ", ".join(f"'{e.key}', {str(e.larger).lower()}, {str(e.base is not None).lower()}, CAST(base_{k} AS DOUBLE), CAST({e.value} AS DOUBLE), coalesce({e.condition}, false)" for k, e in enumerate(edges))
    rows = df.selectExpr("symbol", dialect(f"stack({len(edges)}, {cells}) AS (edge_key, larger, ratio, base, x, hit)", True)).filter("x IS NOT NULL")
    inside, outside = F.when(F.col("hit"), F.col("x")), F.when(~F.col("hit"), F.col("x"))
    out = rows.groupBy("symbol", "edge_key", "larger", "ratio").agg(
        F.max("base").alias("base"), F.count(inside).alias("n"), F.avg(inside).alias("mean_in"), F.var_samp(inside).alias("var_in"), F.avg(F.when(F.col("hit"), (F.coalesce(F.col("x") > F.col("base"), F.lit(False))).cast("double"))).alias("win_rate"),
        F.count(outside).alias("n_out"), F.avg(outside).alias("mean_out"), F.var_samp(outside).alias("var_out"),
    ).filter(f"n >= {MIN_SAMPLE} AND n_out > 1")
    out = out.selectExpr("*", f"{_POOLED} AS t_statistic", _MEASURED.split(", CASE")[0], "CASE" + _MEASURED.split(", CASE")[1]).withColumn("p_value", t_p(F.col("t_statistic"), F.col("n") + F.col("n_out") - 2))
    return out.selectExpr("symbol", "edge_key", "n", "n_out", *_contrast_columns())


def contrast_sql(levels: list[dict], edges: list[Contrast], base: str) -> str:
    inner = Plan([*levels, {f"base_{k}": e.against() for k, e in enumerate(edges)}], {}).sql(base)
    inner = inner[: inner.rindex(" SELECT symbol, t, ")] + " "
    last = inner.rsplit(" AS (SELECT *", 1)[0].rsplit(" ", 1)[-1]
    parts = " UNION ALL ".join(f"SELECT symbol, '{e.key}' AS edge_key, {str(e.larger).lower()} AS larger, {str(e.base is not None).lower()} AS ratio, base_{k}::DOUBLE AS base, ({e.value})::DOUBLE AS x, coalesce({e.condition}, false) AS hit FROM {last}" for k, e in enumerate(edges))
    return dialect(
        f"""{inner}, cells AS ({parts}),
s AS (SELECT symbol, edge_key, larger, ratio, max(base) AS base, count(*) FILTER (WHERE hit) AS n, avg(x) FILTER (WHERE hit) AS mean_in, var_samp(x) FILTER (WHERE hit) AS var_in, avg(CASE WHEN x > base THEN 1e0 ELSE 0e0 END) FILTER (WHERE hit) AS win_rate, count(*) FILTER (WHERE NOT hit) AS n_out,
avg(x) FILTER (WHERE NOT hit) AS mean_out, var_samp(x) FILTER (WHERE NOT hit) AS var_out FROM cells WHERE x IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (WHERE hit) >= {MIN_SAMPLE} AND count(*) FILTER (WHERE NOT hit) > 1),
u AS (SELECT *, {_POOLED} AS t_statistic, {_MEASURED} FROM s), v AS (SELECT *, {t_p_sql('t_statistic', 'n + n_out - 2')} AS p_value FROM u)
SELECT symbol, edge_key, n, n_out, {', '.join(_contrast_columns())} FROM v""",
        False,
    )


# --- the catalogue ---
SIGNED: dict[str, tuple[list[dict], list[Signed]]] = {}
CONTRASTS: dict[str, tuple[list[dict], list[Contrast]]] = {}

_crosses = ((10, 20), (20, 50), (50, 200))
SIGNED["tre_01"] = (
    [{f"m{n}": roll("avg", "close", n) for n in (10, 20, 50, 200)} | forward(20), {f"s{a}_{b}": f"CASE WHEN m{a} > m{b} THEN 1 WHEN m{a} <= m{b} THEN 0 ELSE 0 END" for a, b in _crosses}, {f"p{a}_{b}": lag(f"s{a}_{b}") for a, b in _crosses}],
    [Signed(f"ma_crossover_{a}_{b}", f"s{a}_{b} = 1 AND p{a}_{b} = 0", f"s{a}_{b} = 0 AND p{a}_{b} = 1", 20) for a, b in _crosses],
)
_window = "OVER (PARTITION BY symbol)"
SIGNED["tre_02"] = (
    [{f"mom{n}": f"{div('close', lag('close', n))} - 1" for n in (5, 10, 20)} | forward(10), {f"both{n}": f"CASE WHEN f10 IS NOT NULL THEN mom{n} END" for n in (5, 10, 20)}, {f"q{n}": f"{{{{percentile(both{n}, 0.8)¦quantile_cont(both{n}, 0.8)}}}} {_window}" for n in (5, 10, 20)} | {f"rho{n}": f"corr(both{n}, f10) {_window}" for n in (5, 10, 20)}],
    [Signed(f"momentum_{n}", f"both{n} >= q{n}", "false", given=f"rho{n} > 0") for n in (5, 10, 20)],
)
SIGNED["tre_04"] = (
    [{f"h{n}": roll("max", "high", n) for n in (10, 20, 50)} | {f"l{n}": roll("min", "low", n) for n in (10, 20, 50)} | forward(10), {f"ph{n}": lag(f"h{n}") for n in (10, 20, 50)} | {f"pl{n}": lag(f"l{n}") for n in (10, 20, 50)}],
    [Signed(f"donchian_{n}", f"close > ph{n}", f"close < pl{n}") for n in (10, 20, 50)],
)
SIGNED["tre_05"] = ([*BB, forward(10)], [Signed("bollinger_breakout", "close > bb_upper", "close < bb_lower")])
SIGNED["tre_06"] = ([*ADX, forward(10)], [Signed("adx_trending", "adx > 25", "false"), Signed("adx_ranging", "adx < 20", "false")])
_z = [(n, z) for n in (10, 20, 50) for z in (1.5, 2.0, 2.5)]
SIGNED["mrv_01"] = (
    [{f"a{n}": roll("avg", "close", n) for n in (10, 20, 50)} | {f"d{n}": roll("stddev_samp", "close", n) for n in (10, 20, 50)} | forward(10), {f"z{n}": f"(close - a{n}) / (CASE WHEN d{n} > 1e-9 THEN d{n} END)" for n in (10, 20, 50)}],
    [Signed(f"zscore_{n}_{int(z * 10)}", f"z{n} < -{z}", f"z{n} > {z}") for n, z in _z],
)
SIGNED["mrv_02"] = (
    [{f"a{n}": roll("avg", "close", n) for n in (20, 50)} | {f"d{n}": roll("stddev_samp", "close", n) for n in (20, 50)} | forward(10), {f"z{n}": f"CASE WHEN f10 IS NOT NULL THEN (close - a{n}) / (CASE WHEN d{n} > 1e-9 THEN d{n} END) END" for n in (20, 50)}, {f"q{n}": f"{{{{percentile(z{n}, 0.2)¦quantile_cont(z{n}, 0.2)}}}} {_window}" for n in (20, 50)}, {f"low{n}": f"avg(CASE WHEN z{n} <= q{n} THEN f10 END) {_window}" for n in (20, 50)}],
    [Signed(f"zscore_quintile_{n}", f"z{n} <= q{n}", "false", given=f"low{n} > 0") for n in (20, 50)],
)
SIGNED["mrv_03"] = ([*rsi(14), forward(10)], [Signed(f"rsi_{a}_{b}", f"rsi_14 < {a}", f"rsi_14 > {b}") for a, b in ((30, 70), (25, 75), (20, 80), (45, 55))])
SIGNED["mrv_04"] = ([*STOCH, forward(10)], [Signed("stochastic_20_80", "stoch_k < 20", "stoch_k > 80")])
SIGNED["mrv_05"] = ([*BB, forward(10)], [Signed("bollinger_reversion", "close <= bb_lower", "close >= bb_upper")])
_runs = [{"bull": "CASE WHEN close > open THEN 1 ELSE 0 END"}, {"nb": "CASE WHEN bull = 0 THEN t END", "yb": "CASE WHEN bull = 1 THEN t END"}, {"gu": f"count(nb) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "gd": f"count(yb) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"},
         {"ru": "sum(bull) OVER (PARTITION BY symbol, gu ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "rd": "sum(1 - bull) OVER (PARTITION BY symbol, gd ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}]
SIGNED["mrv_06"] = ([*_runs, forward(5)], [Signed(f"consecutive_{n}", f"rd >= {n} AND rd <= {n + 4} AND bull = 0", f"ru >= {n} AND ru <= {n + 4} AND bull = 1", 5) for n in (3, 4, 5)])
SIGNED["mrv_07"] = ([*VWAP, forward(10)], [Signed("vwap_deviation", "(close - vwap) / nullif(vwap, 0) < -0.002", "(close - vwap) / nullif(vwap, 0) > 0.002")])
_levels = [{"prev": lag("close")}, {"tr": TR}, {"a14": roll("avg", "tr", 14)}, {"pa": lag("a14")}, forward(10)]
SIGNED["vle_05"] = (_levels, [Signed(f"atr_breakout_{int(m * 10)}", f"close > prev + {m} * pa", f"close < prev - {m} * pa") for m in (1.0, 1.5, 2.0)])
SIGNED["vle_06"] = (
    [{"lr": f"CASE WHEN close > 0 AND {lag('close')} > 0 THEN ln(close / {lag('close')}) END"}, {"hv": f"sqrt(252) * ({roll('stddev_samp', 'lr', 20)})"}, {"lo": Quantile("hv", 0.25, 100), "hi": Quantile("hv", 0.75, 100)} | forward(10)],
    [Signed("regime_low", "hv < lo", "false"), Signed("regime_normal", "NOT coalesce(hv < lo, false) AND NOT coalesce(hv > hi, false)", "false"), Signed("regime_high", "hv > hi", "false")],
)
#: Levels of 25, 50 and 100 pips: a pip is a ten-thousandth of the power of ten that the mean price begins with (0.0001 at 1.10, 0.01 at 130).
_pip = {"pip": "1e-4 * pow(1e1, floor(log10(nullif(greatest(avg(close) OVER (PARTITION BY symbol), 0), 0))))"}
_round = {f"n{d}": f"{{{{rint(close / ({d} * pip))¦round_even(close / ({d} * pip), 0)}}}} * ({d} * pip)" for d in (25, 50, 100)}
SIGNED["str_e1"] = ([_pip, _round | forward(10)], [Signed(f"round_number_{d}", f"close < n{d} - 1e-9", f"close > n{d} + 1e-9") for d in (25, 50, 100)])


def swings(p: int) -> list[dict]:
    around = f"OVER ({ORDER} ROWS BETWEEN {p} PRECEDING AND {p} FOLLOWING)"
    full = f"count(close) {around} = {2 * p + 1}"
    return [{f"sh{p}": f"CASE WHEN {full} AND high = max(high) {around} THEN high END", f"sl{p}": f"CASE WHEN {full} AND low = min(low) {around} THEN low END"}, {f"fh{p}": fill(f"sh{p}"), f"fl{p}": fill(f"sl{p}")}]


SIGNED["str_e3"] = (
    [*swings(3), *swings(5), *swings(10), forward(10)],
    [Signed(f"swing_{p}", f"abs(close - fl{p}) / nullif(close, 0) < 0.001", f"abs(close - fh{p}) / nullif(close, 0) < 0.001") for p in (3, 5, 10)],
)
SIGNED["str_e4"] = (
    [{"h": roll("max", "high", 20), "l": roll("min", "low", 20)}, {"h1": lag("h"), "l1": lag("l"), "h2": lag("h", 2), "l2": lag("l", 2)}, {"bh": "CASE WHEN close > h2 THEN h1 END", "bl": "CASE WHEN close < l2 THEN l1 END"}, {"fh": fill("bh"), "fl": fill("bl")} | forward(10)],
    [Signed("breakout_retest", "abs(close - fh) / nullif(close, 0) < 0.002 AND close > fh", "abs(close - fl) / nullif(close, 0) < 0.002 AND close < fl")],
)
SIGNED["str_e5"] = ([{"h": roll("max", "high", 20), "l": roll("min", "low", 20)}, {"h1": lag("h"), "l1": lag("l")} | forward(10)], [Signed("failed_breakout", "low < l1 AND close > l1", "high > h1 AND close < h1")])
SIGNED["str_e6"] = (
    [*swings(5), {"ph": lag("fh5"), "pl": lag("fl5")} | forward(10)],
    [Signed("hh_hl_trend", "(high > ph AND sh5 IS NOT NULL) OR (low > pl AND sl5 IS NOT NULL)", "(high < ph AND sh5 IS NOT NULL) OR (low < pl AND sl5 IS NOT NULL)")],
)


def ahead(k: int) -> dict:
    """Range of the rows from k - 2 before to one after, over the close: the convention kept for "forward" ranges."""
    frame = f"OVER ({ORDER} ROWS BETWEEN {k - 2} PRECEDING AND 1 FOLLOWING)"
    ready = f"row_number() OVER ({ORDER}) >= {k - 1} AND lead(close) OVER ({ORDER}) IS NOT NULL"
    return {f"range{k}": f"CASE WHEN {ready} THEN (max(high) {frame} - min(low) {frame}) / nullif(close, 0) END"}


CONTRASTS["vle_02"] = (
    [{"prev": lag("close")}, {"tr": TR}, {"atrp": f"({roll('avg', 'tr', 20)}) / nullif(close, 0)"}, {"share100": Rank("atrp", 100)}, {"rank100": "100 * share100"} | ahead(20), {"usual": roll("avg", "range20", 100)}, {"base": "avg(usual) OVER (PARTITION BY symbol)"}],
    [Contrast(f"contraction_{p}", "range20", f"rank100 < {p}", "base", larger=True) for p in (10, 20, 30)],
)
CONTRASTS["vle_03"] = ([*SQUEEZE, ahead(20)], [Contrast("bollinger_squeeze", "range20", "vol_squeeze = 1", larger=True)])
CONTRASTS["vle_04"] = ([{"rng": "high - low"}, {"m4": roll("min", "rng", 4), "m7": roll("min", "rng", 7)} | ahead(10), {"usual": roll("avg", "range10", 50)}, {"base": "avg(usual) OVER (PARTITION BY symbol)"}], [Contrast("nr4", "range10", "rng = m4", "base"), Contrast("nr7", "range10", "rng = m7", "base")])
#: Hour of the day, for series whose bars are not longer than an hour.
HOURS = [Signed(f"hour_{h:02d}", f"hour = {h}", "false", 1, "r1", 24 * 252) for h in range(24)]

# Calendar tests: returns of a bar by a label of its time.
CALENDAR = [{"d": DAY, "hour": "CAST(t % 24 AS INT)", "weekday": "CAST((floor(t / 24) + 3) % 7 AS INT)", "r1": f"{div('close', lag('close'))} - 1"}, {"month": "CAST(extract(month FROM d) AS INT)", "rn": "row_number() OVER (PARTITION BY symbol, d ORDER BY t)", "rl": "row_number() OVER (PARTITION BY symbol, d ORDER BY t DESC)"}]
SIGNED["tim_02"] = (CALENDAR, [Signed(f"day_{k}", f"weekday = {k}", "false", 1, "r1", 252) for k in range(5)])
SIGNED["tim_03"] = (CALENDAR, [Signed(f"session_{n}", f"hour >= {a} AND hour < {b}", "false", 1, "r1", 252) for n, (a, b) in {"asian": (0, 8), "london": (7, 16), "ny": (12, 21), "london_ny_overlap": (12, 16), "asian_london_overlap": (7, 8)}.items()])
SIGNED["tim_04"] = (CALENDAR, [Signed(f"month_{k}", f"month = {k}", "false", 1, "r1", 12) for k in range(1, 13)])
SIGNED["tim_07"] = (CALENDAR, [Signed("first_hour", "rn = 1 AND rl > 1", "false", 1, "r1", 252), Signed("last_hour", "rl = 1 AND rn > 1", "false", 1, "r1", 252)])
_or = [{"d": DAY}, {"i": "row_number() OVER (PARTITION BY symbol, d ORDER BY t)", "n": "count(*) OVER (PARTITION BY symbol, d)", "f4": "lead(close, 4) OVER (PARTITION BY symbol, d ORDER BY t) / nullif(close, 0) - 1"},
       {"oh": "max(CASE WHEN i = 1 THEN high END) OVER (PARTITION BY symbol, d)", "ol": "min(CASE WHEN i = 1 THEN low END) OVER (PARTITION BY symbol, d)"}]
SIGNED["tim_05"] = (_or, [Signed("opening_range_breakout", "n >= 5 AND i BETWEEN 2 AND 5 AND close > oh", "n >= 5 AND i BETWEEN 2 AND 5 AND close < ol", 4)])
#: The members of each family of tests. Those of ``EXTRA`` are statements of :mod:`barwright.operators.analytics` with columns of their own.
FAMILIES = {
    "tim_08": ("hours", "tim_02", "tim_03", "tim_04", "tim_05", "tim_06", "tim_07"),
    "tre_08": ("tre_01", "tre_02", "tre_03", "tre_04", "tre_05", "tre_06", "tre_07"),
    "mrv_08": ("mrv_01", "mrv_02", "mrv_03", "mrv_04", "mrv_05", "mrv_06", "mrv_07"),
    "vle_07": ("vle_01", "vle_02", "vle_03", "vle_04", "vle_05", "vle_06"),
    "str_e7": ("str_e1", "str_e2", "str_e3", "str_e4", "str_e5", "str_e6"),
}
#: The type of each member's tests.
TYPES = {"hours": "time_hour", "tim_02": "time_day", "tim_03": "time_session", "tim_04": "time_month", "tre_01": "trend_crossover", "tre_02": "momentum", "tre_03": "regime", "tre_04": "breakout", "tre_05": "breakout", "tre_06": "trend_filter", "tre_07": "randomness"} | {
    m: kind for family, kind in (("tim_08", "time_pattern"), ("mrv_08", "mean_reversion"), ("vle_07", "volatility"), ("str_e7", "structure")) for m in FAMILIES[family] if m not in ("hours", "tim_02", "tim_03", "tim_04")
}
#: Keys of the tests that have statements of their own.
_EXTRA_KEYS = {"tim_06": ("weekend_gap",), "tre_03": ("hurst",), "tre_07": ("runs_test",), "vle_01": ("volatility_clustering",), "str_e2": ("prev_high", "prev_low", "prev_close")}


def type_sql(key: str = "edge_key") -> str:
    """The type of a test by its key; ``other`` for keys that no family has."""
    cases = []
    for member, kind in TYPES.items():
        tests = HOURS if member == "hours" else SIGNED[member][1] if member in SIGNED else CONTRASTS[member][1] if member in CONTRASTS else ()
        keys = [e.key for e in tests] or _EXTRA_KEYS[member]
        cases.append(f"WHEN {key} IN ({', '.join(repr(k) for k in keys)}) THEN '{kind}'")
    return f"CASE {' '.join(cases)} ELSE 'other' END"


#: Tests that stand in the catalogue but not in a family.
ALONE = {"rsi_45_55"}
RESULT = ("symbol", "edge_key", "n", "mean_return", "std_return", "t_statistic", "p_value", "win_rate", "sharpe_ratio", "is_significant")
_NONE = "CAST(NULL AS DOUBLE)"
CONTRAST_RESULT = ["symbol", "edge_key", "n", "mean_return", "std_in AS std_return", "t_statistic", "p_value", "win_rate", "0e0 AS sharpe_ratio", "is_significant"]
EXTRA = {
    "tim_06": ["symbol", "'weekend_gap' AS edge_key", "n", "fill_rate AS mean_return", f"{_NONE} AS std_return", "chi_squared AS t_statistic", "p_value", "fill_rate AS win_rate", "0e0 AS sharpe_ratio", f"coalesce(p_value < {ALPHA} AND fill_rate > 0.55, false) AS is_significant"],
    "tre_03": ["symbol", "'hurst' AS edge_key", "n", f"{rounded('(hurst - 0.5e0)')} AS mean_return", "std_err AS std_return", f"{rounded('((hurst - 0.5e0) / nullif(std_err, 0))', 3)} AS t_statistic", "p_value", "0e0 AS win_rate", "0e0 AS sharpe_ratio", "abs(hurst - 0.5e0) > 0.05 AS is_significant"],
    "tre_07": ["symbol", "'runs_test' AS edge_key", "n", "0e0 AS mean_return", f"{_NONE} AS std_return", "z AS t_statistic", "p_value", "0e0 AS win_rate", "0e0 AS sharpe_ratio", "coalesce(abs(z) > 1.96, false) AS is_significant"],
    "vle_01": ["symbol", "'volatility_clustering' AS edge_key", "n", "avg_autocorrelation AS mean_return", "std_autocorrelation AS std_return", f"{rounded('(avg_autocorrelation / nullif(std_autocorrelation, 0))', 4)} AS t_statistic", "p_value", "0e0 AS win_rate", "0e0 AS sharpe_ratio", "is_significant"],
    "str_e2": list(RESULT),
}


def merged(parts: list[tuple[list[dict], list]]) -> tuple[list[dict], list]:
    """Several catalogue entries as one plan: equal expressions are computed once, and names that clash are told apart."""
    known: dict[str, tuple[str, int]] = {}
    levels: list[dict] = []
    depth: dict[str, int] = {}
    edges = []
    for k, (own, tests) in enumerate(parts):
        names: dict[str, str] = {}
        put = lambda text, names=names: re.sub(r"\b[a-z_]\w*\b", lambda m: names.get(m[0], m[0]), text)
        for level in own:
            fresh = {}
            for name, spec in level.items():
                spec = put(spec) if isinstance(spec, str) else replace(spec, source=names.get(spec.source, spec.source))
                if repr(spec) not in known:
                    used = re.findall(r"\b[a-z_]\w*\b", spec) if isinstance(spec, str) else [spec.source]
                    at = 1 + max((depth[u] for u in used if u in depth), default=-1)
                    while len(levels) <= at:
                        levels.append({})
                    known[repr(spec)] = (f"{name}__{k}", at)
                    levels[at][f"{name}__{k}"] = spec
                    depth[f"{name}__{k}"] = at
                fresh[name] = known[repr(spec)][0]
            names.update(fresh)
        for test in tests:
            if isinstance(test, Signed):
                edges.append(replace(test, up=put(test.up), down=put(test.down), value=put(test.returns()), given=put(test.given)))
            else:
                edges.append(replace(test, value=put(test.value), condition=put(test.condition), base=test.base and put(test.base)))
    return levels, edges


def catalogue(family: str) -> tuple[list, list, list[str]]:
    """Signed entries, contrasts, and statements of a family."""
    members = FAMILIES[family]
    signed = [(CALENDAR, HOURS) if m == "hours" else (SIGNED[m][0], [e for e in SIGNED[m][1] if e.key not in ALONE]) for m in members if m == "hours" or m in SIGNED]
    return signed, [CONTRASTS[m] for m in members if m in CONTRASTS], [m for m in members if m in EXTRA]


__all__ = ["CONTRASTS", "SIGNED", "RUNS", "TP", "last_n"]
