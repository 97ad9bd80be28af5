"""Feature plans of single series: price, return, momentum, trend, volatility, volume and candle families.

Formulas are the textbook ones. Comparisons with a missing value are false; ratios with a zero divisor are null.
"""

from __future__ import annotations

from barwright.functions.dsl import RUNNING, WHOLE, Ewm, Plan, Quantile, Rank, Wilder, deviation, div, fill, flag, items, lag, last_n, lead, ln, roll, root, running

TP = "((high + low + close) / 3)"
BODY, RANGE = "abs(close - open)", "(high - low)"
DAY = "{{date_add(DATE'1970-01-01', CAST(floor(t / 24) AS INT))¦(DATE '1970-01-01' + floor(t / 24)::INTEGER)}}"
TR = "greatest(high - low, abs(high - prev), abs(low - prev))"
R1 = {"prev": lag("close")}
RETURNS = {"r1": div("close - prev", "prev"), "lr1": ln("close / nullif(prev, 0)"), "tr": TR}

PLANS: dict[str, Plan] = {}


def add(name: str, levels: list[dict], digits: dict[str, int | None] | list[str], places: int = 6) -> None:
    out = digits if isinstance(digits, dict) else dict.fromkeys(digits, places)
    PLANS[name] = Plan(levels, out)


# --- calendar, price, returns ---
CALENDAR = {"d": DAY, "hour": "CAST(t % 24 AS INT)", "weekday": "CAST((floor(t / 24) + 3) % 7 AS INT)"}
add("pre_03", [CALENDAR, {"day_of_month": "CAST(extract(day FROM d) AS INT)", "month": "CAST(extract(month FROM d) AS INT)", "quarter": "CAST(extract(quarter FROM d) AS INT)", "week_of_year": "CAST(extract(week FROM d) AS INT)", "year": "CAST(extract(year FROM d) AS INT)"}],
    dict.fromkeys(["hour", "weekday", "day_of_month", "month", "quarter", "week_of_year", "year"]))
FLAGS = {"is_asian_session": flag("hour < 8"), "is_london_session": flag("hour >= 7 AND hour < 16"), "is_ny_session": flag("hour >= 12 AND hour < 21"), "is_london_ny_overlap": flag("hour >= 12 AND hour < 16"), "is_asian_london_overlap": flag("hour = 7")}
add("pre_04", [CALENDAR, FLAGS], dict.fromkeys(FLAGS))
add("pre_05", [CALENDAR, {"session": "CASE WHEN hour < 8 THEN 'asian' WHEN hour < 16 THEN 'london' WHEN hour < 21 THEN 'ny' ELSE 'other' END"}], {"session": None})
NAMES = " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate("Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()))
add("pre_06", [CALENDAR, {"dom": "extract(day FROM d)", "mon": "extract(month FROM d)"}, {"day_name": f"CASE weekday {NAMES} END", "is_weekend": flag("weekday >= 5"), "is_month_end": flag("dom >= 28"), "is_quarter_end": flag("mon IN (3, 6, 9, 12) AND dom >= 28")}],
    dict.fromkeys(["day_name", "is_weekend", "is_month_end", "is_quarter_end"]))
add("pre_07", [CALENDAR, {"is_first_hour": flag("hour = min(hour) OVER (PARTITION BY symbol, d)"), "is_last_hour": flag("hour = max(hour) OVER (PARTITION BY symbol, d)")}], dict.fromkeys(["is_first_hour", "is_last_hour"]))
PRICE = {
    "mid_price": "(high + low) / 2", "typical_price": TP, "weighted_price": "(high + low + close * 2) / 4", "body": BODY, "body_pct": f"{div(BODY, 'close')} * 100", "rng": RANGE, "range_pct": f"{div(RANGE, 'close')} * 100",
    "body_range_ratio": div(BODY, RANGE), "upper_wick": "high - greatest(open, close)", "lower_wick": "least(open, close) - low", "upper_wick_pct": div("high - greatest(open, close)", RANGE),
    "lower_wick_pct": div("least(open, close) - low", RANGE), "is_bullish": flag("close > open"), "is_bearish": flag("close < open"), "is_doji": flag(f"{div(BODY, RANGE)} < 0.1"), "gap": "open - prev", "gap_pct": f"{div('open - prev', 'prev')} * 100",
}
add("pre_08", [R1, PRICE, {f"rel_range_{n}": div("rng", roll("avg", "rng", n)) for n in (5, 10, 20)}], [*PRICE, "rel_range_5", "rel_range_10", "rel_range_20"])
RET = {f"return_{k}": div(f"close - {lag('close', k)}", lag("close", k)) for k in (1, 5, 10, 20)} | {f"log_return_{k}": ln(f"close / nullif({lag('close', k)}, 0)") for k in (1, 5, 10, 20)} | {f"fwd_return_{k}": f"{div(lead('close', k), 'close')} - 1" for k in (1, 5, 10, 20)} | {f"fwd_log_return_{k}": ln(f"{lead('close', k)} / nullif(close, 0)") for k in (1, 5, 10, 20)}
add("pre_09", [RET, {"cum_log": f"CASE WHEN return_1 IS NOT NULL THEN sum({ln('1 + return_1')}) {RUNNING} END"}, {"cum_return": "exp(cum_log) - 1"} | {f"rolling_return_{n}": roll("sum", "return_1", n) for n in (5, 10, 20)}], [*RET, "rolling_return_5", "rolling_return_10", "rolling_return_20"], 4)
PARK = ln("high / nullif(low, 0)")
add("pre_10", [R1, RETURNS | {"hl2": f"pow({PARK}, 2)", "co2": f"pow({ln('close / nullif(open, 0)')}, 2)"},
    {f"vol_std_{n}": roll("stddev_samp", "r1", n) for n in (5, 10, 20, 50)} | {f"vol_log_{n}": roll("stddev_samp", "lr1", n) for n in (5, 10, 20, 50)} | {f"parkinson_vol_{n}": f"sqrt({roll('sum', 'hl2', n)} / (4 * {n} * ln(2)))" for n in (5, 10, 20, 50)}
    | {f"atr_{n}": roll("avg", "tr", n) for n in (5, 10, 20, 50)} | {"gk": root("0.5 * hl2 - (2 * ln(2) - 1) * co2")},
    {f"atr_pct_{n}": div(f"atr_{n}", "close") for n in (5, 10, 20, 50)} | {"garman_klass_vol": roll("avg", "gk", 20), "vol_ratio": div("vol_std_5", "vol_std_20"), "vol_rank_20": Rank("vol_std_20", 20), "vol_rank_50": Rank("vol_std_20", 50)}],
    [f"{a}_{n}" for a in ("vol_log", "parkinson_vol", "atr") for n in (5, 10, 20, 50)] + ["garman_klass_vol", "vol_rank_20", "vol_rank_50"], 4)

# --- momentum ---
GAIN = {"delta": f"coalesce(close - {lag('close')}, 0)"}
GAINS = {"gain": "greatest(delta, 0)", "loss": "greatest(-delta, 0)"}


def rsi(*periods: int) -> list[dict]:
    return [GAIN, GAINS, {f"g{p}": Wilder("gain", p) for p in periods} | {f"l{p}": Wilder("loss", p) for p in periods}, {f"rsi_{p}": f"100 - 100 / (1 + {div(f'g{p}', f'l{p}')})" for p in periods}]


add("mom_01", rsi(14), ["rsi_14"])
add("mom_02", rsi(7, 14, 21), ["rsi_7", "rsi_14", "rsi_21"])
MACD = [{"e12": Ewm("close", 12), "e26": Ewm("close", 26)}, {"macd": "e12 - e26"}, {"macd_signal": Ewm("macd", 9)}, {"macd_hist": "macd - macd_signal"}]
add("mom_03", MACD, ["macd", "macd_signal", "macd_hist"])
STOCH = [{"ll": roll("min", "low", 14), "hh": roll("max", "high", 14)}, {"stoch_k": f"100 * {div('close - ll', 'hh - ll')}"}, {"stoch_d": roll("avg", "stoch_k", 3)}]
add("mom_04", STOCH, ["stoch_k", "stoch_d"])
add("mom_05", [STOCH[0], {"williams_r": f"-100 * {div('hh - close', 'hh - ll')}"}], ["williams_r"])
CCI = [{"tp": TP}, {"m20": roll("avg", "tp", 20), "w20": items("tp", 20)}, {"cci": f"{div('tp - m20', '0.015 * (' + deviation('w20', 'm20') + ')')}"}]
add("mom_06", CCI, ["cci"], 4)
add("mom_07", [{f"roc_{n}": f"100 * {div(f'close - ' + lag('close', n), lag('close', n))}" for n in (5, 10, 20)}], ["roc_5", "roc_10", "roc_20"], 4)
MFI = [{"tp": TP}, {"dtp": f"tp - {lag('tp')}"}, {"up": "CASE WHEN dtp > 0 THEN tp * volume ELSE 0 END", "down": "CASE WHEN dtp < 0 THEN tp * volume ELSE 0 END"}, {"mfi": f"100 - 100 / (1 + {div(roll('sum', 'up', 14), roll('sum', 'down', 14))})"}]
add("mom_08", MFI, ["mfi"])
TSI = [{"m": f"close - {lag('close')}"}, {"am": "abs(m)"}, {"a25": Ewm("m", 25), "b25": Ewm("am", 25)}, {"a13": Ewm("a25", 13), "b13": Ewm("b25", 13)}, {"tsi": f"100 * {div('a13', 'b13')}"}]
add("mom_09", TSI, ["tsi"])
MOM_FLAGS = {
    "rsi_14_overbought": flag("rsi_14 > 70"), "rsi_14_oversold": flag("rsi_14 < 30"), "rsi_14_extreme": flag("rsi_14 > 70 OR rsi_14 < 30"), "macd_cross_up": flag(f"macd > macd_signal AND {lag('macd')} <= {lag('macd_signal')}"),
    "macd_cross_down": flag(f"macd < macd_signal AND {lag('macd')} >= {lag('macd_signal')}"), "stoch_overbought": flag("stoch_k > 80"), "stoch_oversold": flag("stoch_k < 20"), "cci_extreme": flag("abs(cci) > 200"),
}
add("mom_10", [*rsi(14), *MACD, *STOCH, *CCI, MOM_FLAGS], dict.fromkeys(MOM_FLAGS))

# --- trend ---
add("trd_01", [{f"sma_{n}": roll("avg", "close", n) for n in (20, 50, 100, 200)}], [f"sma_{n}" for n in (20, 50, 100, 200)])
add("trd_02", [{f"ema_{n}": Ewm("close", n) for n in (12, 26, 50, 200)}], [f"ema_{n}" for n in (12, 26, 50, 200)])
add("trd_03", [{"s20": roll("avg", "close", 20)}, {"gap20": "close - s20"}, {"price_z_sma20": div("gap20", roll("stddev_samp", "gap20", 20))}], ["price_z_sma20"])
add("trd_04", [{"s50": roll("avg", "close", 50), "s200": roll("avg", "close", 200)}, {"above": flag("s50 > s200")}, {"golden_cross": flag(f"above = 1 AND {lag('above')} = 0"), "death_cross": flag(f"above = 0 AND {lag('above')} = 1")}], dict.fromkeys(["above", "golden_cross", "death_cross"]))
ADX = [R1, {"tr": TR, "um": f"high - {lag('high')}", "dm": f"{lag('low')} - low"}, {"pdm": "CASE WHEN um > dm AND um > 0 THEN um ELSE 0 END", "mdm": "CASE WHEN dm > um AND dm > 0 THEN dm ELSE 0 END"},
       {"atr14": roll("avg", "tr", 14), "p14": roll("avg", "pdm", 14), "m14": roll("avg", "mdm", 14)}, {"plus_di": f"100 * {div('p14', 'atr14')}", "minus_di": f"100 * {div('m14', 'atr14')}"}, {"dx": f"100 * {div('abs(plus_di - minus_di)', 'plus_di + minus_di')}"}, {"adx": roll("avg", "dx", 14)}]
add("trd_05", ADX, ["adx", "plus_di", "minus_di"])
mid = lambda n: f"(({roll('max', 'high', n)}) + ({roll('min', 'low', n)})) / 2"
add("trd_06", [{"tenkan": mid(9), "kijun": mid(26), "mid52": mid(52)}, {"senkou_a": f"({lag('tenkan', 26)} + {lag('kijun', 26)}) / 2", "senkou_b": lag("mid52", 26), "chikou": lead("close", 26)},
               {"cloud": "CASE WHEN senkou_a > senkou_b THEN 1 ELSE -1 END", "price_above_cloud": flag("close > greatest(senkou_a, senkou_b) AND senkou_a IS NOT NULL AND senkou_b IS NOT NULL"), "price_below_cloud": flag("close < least(senkou_a, senkou_b) AND senkou_a IS NOT NULL AND senkou_b IS NOT NULL"),
                "tk_cross_up": flag(f"tenkan > kijun AND {lag('tenkan')} <= {lag('kijun')}"), "tk_cross_down": flag(f"tenkan < kijun AND {lag('tenkan')} >= {lag('kijun')}")}],
    ["tenkan", "kijun", "senkou_a", "senkou_b", "chikou", "cloud", "price_above_cloud", "price_below_cloud", "tk_cross_up", "tk_cross_down"])
SUPER = [R1, {"tr": TR}, {"atr10": roll("avg", "tr", 10)}, {"ub": "(high + low) / 2 + 3 * atr10", "lb": "(high + low) / 2 - 3 * atr10"}, {"event": f"CASE WHEN close > {lag('ub')} THEN 1 WHEN close < {lag('lb')} THEN -1 END"},
         {"supertrend_direction": f"coalesce({fill('event')}, -1)"}, {"supertrend": "CASE WHEN supertrend_direction = 1 THEN lb ELSE ub END"}]
add("trd_07", SUPER, ["supertrend", "supertrend_direction"])
VWAP = [{"d": DAY, "tp": TP}, {"vwap": div("sum(tp * volume) OVER (PARTITION BY symbol, d ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "sum(volume) OVER (PARTITION BY symbol, d ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")}]
add("trd_08", VWAP, ["vwap"])
add("trd_09", [{"i": f"CAST(row_number() OVER (PARTITION BY symbol ORDER BY t) AS DOUBLE)"}, {f"lr_slope_{n}": f"CASE WHEN count(close) {last_n(n)} = {n} THEN regr_slope(close, i) {last_n(n)} END" for n in (20, 50)}], ["lr_slope_20", "lr_slope_50"])
add("trd_10", [*ADX, *VWAP, {"s20": roll("avg", "close", 20), "s50": roll("avg", "close", 50)}, {"price_above_sma20": flag("close > s20"), "price_above_sma50": flag("close > s50"), "is_trending": flag("adx > 25"), "is_ranging": flag("adx < 20"), "price_above_vwap": flag("close > vwap")}],
    dict.fromkeys(["price_above_sma20", "price_above_sma50", "is_trending", "is_ranging", "price_above_vwap"]))

# --- volatility ---
add("vol_01", [R1, {"true_range": TR}], ["true_range"])
add("vol_02", [R1, {"tr": TR}, {f"atr_{n}": roll("avg", "tr", n) for n in (7, 14, 21)}], ["atr_7", "atr_14", "atr_21"])
BB = [{"bb_middle": roll("avg", "close", 20), "sd20": roll("stddev_samp", "close", 20)}, {"bb_upper": "bb_middle + 2 * sd20", "bb_lower": "bb_middle - 2 * sd20"}, {"bb_bandwidth": div("bb_upper - bb_lower", "bb_middle"), "bb_percent_b": div("close - bb_lower", "bb_upper - bb_lower")}]
add("vol_03", BB, ["bb_upper", "bb_lower", "bb_middle", "bb_bandwidth", "bb_percent_b"])
KC = [R1, {"tr": TR, "tp": TP}, {"kc_middle": Ewm("tp", 20), "atr20": roll("avg", "tr", 20)}, {"kc_upper": "kc_middle + 2 * atr20", "kc_lower": "kc_middle - 2 * atr20"}]
add("vol_04", KC, ["kc_upper", "kc_lower", "kc_middle"])
add("vol_05", [{"donchian_upper": roll("max", "high", 20), "donchian_lower": roll("min", "low", 20)}, {"donchian_middle": "(donchian_upper + donchian_lower) / 2", "donchian_width": "donchian_upper - donchian_lower"}], ["donchian_upper", "donchian_lower", "donchian_middle", "donchian_width"])
HV = [R1, RETURNS, {"hist_vol_20": f"sqrt(252) * ({roll('stddev_samp', 'lr1', 20)})"}]
add("vol_06", HV, ["hist_vol_20"])
add("vol_07", [{"hl2": f"pow({PARK}, 2)"}, {"parkinson": f"sqrt(({roll('sum', 'hl2', 20)}) / (80 * ln(2)))"}], ["parkinson"])
add("vol_08", [{"v": f"0.5 * pow({PARK}, 2) - (2 * ln(2) - 1) * pow({ln('close / nullif(open, 0)')}, 2)"}, {"m": roll("avg", "v", 20)}, {"garman_klass": root("m")}], ["garman_klass"])
add("vol_09", [R1, {"o": ln("open / nullif(prev, 0)"), "c": ln("close / nullif(open, 0)"), "rs": f"pow({PARK}, 2) - 2 * pow({ln('close / nullif(open, 0)')}, 2)"}, {"v": f"({roll('var_samp', 'o', 20)}) + {0.34 / (1.34 + 21 / 19)!r}D * ({roll('var_samp', 'c', 20)}) + {1 - 0.34 / (1.34 + 21 / 19)!r}D * ({roll('avg', 'rs', 20)})".replace("D *", "e0 *")}, {"yang_zhang": root("v")}], ["yang_zhang"])
add("vol_10", [R1, RETURNS, {"s5": roll("stddev_samp", "lr1", 5), "s20": roll("stddev_samp", "lr1", 20)}, {"vol_ratio": div("s5", "s20")}], ["vol_ratio"], 4)
PCTL = [*HV, {"rank252": Rank("hist_vol_20", 252)}, {"vol_percentile": "100 * rank252"}]
add("vol_11", PCTL, ["vol_percentile"], 4)
SQUEEZE = [*BB, *KC, {"vol_squeeze": flag("bb_upper < kc_upper AND bb_lower > kc_lower")}]
add("vol_12", SQUEEZE, {"vol_squeeze": None})
add("vol_13", [*BB, *PCTL, {"q": Quantile("bb_bandwidth", 0.2, 20)}, {"bb_squeeze": flag("bb_bandwidth < q - 1e-12"), "bb_upper_touch": flag("close >= bb_upper * 0.99"), "bb_lower_touch": flag("close <= bb_lower * 1.01"),
               "vol_regime": "CASE WHEN vol_percentile > 0 AND vol_percentile <= 25 THEN 'low' WHEN vol_percentile <= 75 THEN 'normal' WHEN vol_percentile <= 100 THEN 'high' ELSE 'nan' END"}], dict.fromkeys(["bb_squeeze", "bb_upper_touch", "bb_lower_touch", "vol_regime"]))

# --- volume ---
add("vlm_02", [{f"volume_sma_{n}": roll("avg", "volume", n) for n in (10, 20, 50)}, {f"volume_ratio_{n}": div("volume", f"volume_sma_{n}") for n in (10, 20, 50)}], [f"{a}_{n}" for a in ("volume_sma", "volume_ratio") for n in (10, 20, 50)])
OBV = [R1, {"step": "CASE WHEN close > prev THEN volume WHEN close < prev THEN -volume WHEN close = prev THEN 0 END"}, {"obv": f"CASE WHEN step IS NOT NULL THEN {running('sum', 'step')} END"}, {"obv_sma_20": roll("avg", "obv", 20)}, {"obv_trend": flag("obv > obv_sma_20")}]
add("vlm_03", OBV, ["obv", "obv_sma_20", "obv_trend"])
add("vlm_04", [{"tpv": f"{TP} * volume"}, {"vwap_20": div(roll("sum", "tpv", 20), roll("sum", "volume", 20))}], ["vwap_20"])
add("vlm_06", [{"m": roll("avg", "volume", 20), "s": roll("stddev_samp", "volume", 20)}, {"volume_zscore": "CASE WHEN s > 1e-9 THEN (volume - m) / s END"}, {"high_volume": flag("volume_zscore > 2"), "low_volume": flag("volume_zscore < -2")}], ["volume_zscore", "high_volume", "low_volume"])
AD = [{"clv": div("(close - low) - (high - close)", RANGE)}, {"ad_line": f"CASE WHEN clv IS NOT NULL THEN sum(clv * volume) {RUNNING} END"}]
add("vlm_07", AD, ["ad_line"], 4)
add("vlm_08", [*AD, {"ad_filled": f"coalesce(ad_line, {fill('ad_line')})"}, {"a3": Ewm("ad_filled", 3), "a10": Ewm("ad_filled", 10)}, {"chaikin_osc": "a3 - a10"}], ["chaikin_osc"], 4)
add("vlm_09", [{"move": f"(high + low) / 2 - ({lag('high')} + {lag('low')}) / 2"}, {"one": div("move", f"(volume / 1e8) / nullif({RANGE}, 0)")}, {"ease_of_movement": f"({roll('avg', 'one', 14)}) / 1e8"}], ["ease_of_movement"], 4)
add("vlm_10", [R1, RETURNS, {"vpt": f"CASE WHEN r1 IS NOT NULL THEN sum(volume * r1) {RUNNING} END"}], ["vpt"], 2)
add("vlm_11", [R1, {"pv": lag("volume")}, {"g": f"CASE WHEN volume < pv THEN {ln('close / nullif(prev, 0)')} ELSE 0 END"}, {"nvi": f"ln(1000) + sum(coalesce(g, 0)) {RUNNING}"}], ["nvi"])

add("vlm_12", [{"m": roll("avg", "volume", 20), "s": roll("stddev_samp", "volume", 20), "tpv": f"{TP} * volume"}, *MFI, *OBV, *AD, {"z": "CASE WHEN s > 1e-9 THEN (volume - m) / s END", "vw": div(roll("sum", "tpv", 20), roll("sum", "volume", 20))},
               {"mfi_overbought": flag("mfi > 80"), "mfi_oversold": flag("mfi < 20"), "is_high_volume": flag("z > 2"), "is_low_volume": flag("z < -2"), "price_above_vwap": flag("close > vw + 1e-9")}],
    dict.fromkeys(["mfi_overbought", "mfi_oversold", "is_high_volume", "is_low_volume", "price_above_vwap", "obv_trend"]))

# --- candles ---
BODY_RATIO, UW, LW = div(BODY, RANGE), "(high - greatest(open, close))", "(least(open, close) - low)"
PREV = {"o1": lag("open"), "c1": lag("close"), "h1": lag("high"), "l1": lag("low"), "o2": lag("open", 2), "c2": lag("close", 2)}
CANDLES = {
    "cnd_02": {"doji": f"{BODY_RATIO} < 0.1"},
    "cnd_03": {"hammer": f"{BODY_RATIO} < 0.3 AND {LW} > {BODY} * 2 AND {div(UW, RANGE)} < 0.1"},
    "cnd_04": {"inverted_hammer": f"{BODY_RATIO} < 0.3 AND {UW} > {BODY} * 2 AND {div(LW, RANGE)} < 0.1"},
    "cnd_05": {"marubozu": f"{div(UW, RANGE)} < 0.05 AND {div(LW, RANGE)} < 0.05 AND {BODY_RATIO} > 0.9"},
    "cnd_06": {"spinning_top": f"{BODY_RATIO} < 0.3 AND {div(UW, RANGE)} > 0.3 AND {div(LW, RANGE)} > 0.3"},
    "cnd_07": {"bullish_engulfing": "close > open AND o1 > c1 AND open < c1 AND close > o1", "bearish_engulfing": "open > close AND c1 > o1 AND close < o1 AND open > c1"},
    "cnd_08": {"morning_star": "o2 > c2 AND abs(c1 - o1) < (o2 - c2) * 0.5 AND c1 < c2 AND close > open AND open > c1 AND close - open > (o2 - c2) * 0.5", "evening_star": "c2 > o2 AND abs(c1 - o1) < (c2 - o2) * 0.5 AND c1 > c2 AND open > close AND open < c1 AND open - close > (c2 - o2) * 0.5"},
    "cnd_09": {"three_white_soldiers": "close > open AND c1 > o1 AND c2 > o2 AND open > o1 AND open < c1 AND o1 > o2 AND o1 < c2 AND close > c1 AND c1 > c2", "three_black_crows": "open > close AND o1 > c1 AND o2 > c2 AND open < o1 AND open > c1 AND o1 < o2 AND o1 > c2 AND close < c1 AND c1 < c2"},
    # The body must lie in the previous bar's body, where a series-wide comparison would look ahead.
    "cnd_10": {"bullish_harami": "abs(open - close) < abs(o1 - c1) * 0.5 AND o1 > c1 AND close > open AND open > c1 AND close < o1", "bearish_harami": "abs(open - close) < abs(o1 - c1) * 0.5 AND c1 > o1 AND open > close AND close > o1 AND open < c1"},
    "cnd_11": {"tweezer_top": f"{div('abs(high - h1)', 'high')} < 0.001 AND c1 > o1 AND open > close", "tweezer_bottom": f"{div('abs(low - l1)', 'low')} < 0.001 AND o1 > c1 AND close > open"},
    "cnd_12": {"piercing_line": "o1 > c1 AND open < l1 AND close > (o1 + c1) / 2 AND close > open", "dark_cloud_cover": "c1 > o1 AND open > h1 AND close < (o1 + c1) / 2 AND open > close"},
}
for _name, _columns in CANDLES.items():
    add(_name, [PREV, {k: flag(v) for k, v in _columns.items()}], dict.fromkeys(_columns))
add("cnd_01", [{"signed_body": "close - open", "body_abs": BODY, "rng": RANGE, "upper": UW, "lower": LW, "body_ratio": BODY_RATIO, "upper_ratio": div(UW, RANGE), "lower_ratio": div(LW, RANGE)}], ["signed_body", "body_abs", "rng", "upper", "lower", "body_ratio", "upper_ratio", "lower_ratio"])
RUNS = [{"bull": flag("close > open"), "bear": flag("open > close")}, {"new_bull": f"CASE WHEN bull = 0 THEN t END", "new_bear": "CASE WHEN bear = 0 THEN t END"}, {"bull_group": f"count(new_bull) {RUNNING}", "bear_group": f"count(new_bear) {RUNNING}"},
        {"consecutive_bullish": "CAST(sum(bull) OVER (PARTITION BY symbol, bull_group ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT)", "consecutive_bearish": "CAST(sum(bear) OVER (PARTITION BY symbol, bear_group ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT)"}]
add("cnd_13", RUNS, dict.fromkeys(["consecutive_bullish", "consecutive_bearish"]))
_every = {k: flag(v) for c in CANDLES.values() for k, v in c.items()}
add("cnd_14", [PREV, _every, {"bullish_reversal_pattern": flag("hammer + bullish_engulfing + morning_star + bullish_harami + tweezer_bottom + piercing_line > 0"), "bearish_reversal_pattern": flag("inverted_hammer + bearish_engulfing + evening_star + bearish_harami + tweezer_top + dark_cloud_cover > 0")}],
    dict.fromkeys(["bullish_reversal_pattern", "bearish_reversal_pattern"]))
# --- regimes: price with trend strength and volatility band ---
add("rpt_07", [*ADX, {"lr1": RETURNS["lr1"]}, {"hist_vol_20": HV[2]["hist_vol_20"]}, *PCTL[3:], {"band": "CASE WHEN vol_percentile < 25 THEN 'low' WHEN vol_percentile > 75 THEN 'high' WHEN vol_percentile IS NOT NULL THEN 'normal' END", "trend": "CASE WHEN adx > 25 THEN 'trending' WHEN adx IS NOT NULL THEN 'ranging' END"}],
    {"close": 6, "adx": 4, "vol_percentile": 4, "band": None, "trend": None})
# --- cleaning ---
add("pre_11", [{"gap_hours": f"t - {lag('t')}"}, {"is_gap": flag("gap_hours > 1.5"), "gap_length": "coalesce(gap_hours, 0)"}], dict.fromkeys(["is_gap", "gap_length"]))
__all__ = ["PLANS", "WHOLE"]
