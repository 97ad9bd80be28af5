"""Statistics, metrics, pairs, folds, resampling and report datasets as SQL over bars.

``BARS`` stands for a bar table. Every statement is one Spark plan; the dialect marks of :mod:`barwright.functions.dsl` give its DuckDB form.
Series are partitioned by symbol throughout, so no symbol sees another's rows.
"""

from __future__ import annotations

from barwright.config import Validation
from barwright.functions.dist import chi2_p_sql, normal_p_sql, t_interval_sql, t_p_sql
from barwright.functions.dsl import rounded as _r


def t_p(t: str, df: str) -> str:
    return f"{{{{t_p({t}, CAST({df} AS DOUBLE))¦{t_p_sql(t, df)}}}}}"


def t_interval(df: str) -> str:
    return f"{{{{t_interval(CAST({df} AS DOUBLE))¦{t_interval_sql(df)}}}}}"


def normal_p(z: str) -> str:
    return f"{{{{normal_p({z})¦{normal_p_sql(z)}}}}}"


def chi2_p(x: str, df: int) -> str:
    return f"{{{{chi2_p({x}, {df}D)¦{chi2_p_sql(x, df)}}}}}"


def r(x: str, name: str, digits: int = 6) -> str:
    return f"{_r(f'({x})', digits)} AS {name}"


W = "OVER (PARTITION BY symbol ORDER BY t)"
RUN = "OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
DAY = "{{date_add(DATE'1970-01-01', CAST(floor(t / 24) AS INT))¦(DATE '1970-01-01' + floor(t / 24)::INTEGER)}}"
#: Returns of each symbol, as they are: their growth factors are summed as logarithms wherever they are multiplied.
RETURNS = f"x0 AS (SELECT symbol, t, close, high, low, volume, close / nullif(lag(close) {W}, 0) - 1 AS y FROM BARS), x AS (SELECT *, {DAY} AS d FROM x0 WHERE y IS NOT NULL)"
GROWTH = "ln(CASE WHEN 1 + y > 0 THEN 1 + y END)"
EQUITY = f"{RETURNS}, e AS (SELECT *, exp(sum({GROWTH}) {RUN}) AS equity FROM x), p AS (SELECT *, max(equity) {RUN} AS peak FROM e), q AS (SELECT *, (equity - peak) / peak AS drawdown FROM p)"
ISLANDS = f"i AS (SELECT *, sum(CASE WHEN y > 0 THEN 0 ELSE 1 END) {RUN} AS gw, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) {RUN} AS gl FROM x), j AS (SELECT *, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, gw) AS ws, sum(CASE WHEN y > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, gl) AS ls FROM i)"
PAIRS = f"{RETURNS}, ab AS (SELECT concat(a.symbol, '/', b.symbol) AS pair, a.symbol AS sa, b.symbol AS sb, a.t, a.close AS ca, b.close AS cb, a.y AS ya, b.y AS yb FROM x a JOIN x b ON a.t = b.t AND a.symbol < b.symbol)"
HALVES = f"{RETURNS}, h AS (SELECT symbol, t, y, row_number() {W} AS rn FROM x)"
RANKED = "k AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY v) + (count(*) OVER (PARTITION BY symbol, v) - 1) / 2e0 AS rk, count(*) OVER (PARTITION BY symbol, v) AS ties FROM g)"
FOLDS = "n AS (SELECT symbol, count(*) AS rows_all FROM BARS GROUP BY symbol)"
#: Every bar once for each fold that it lies in, of the folds that end within its series.
IN_FOLDS = (
    f"{RETURNS.split(', x AS')[0]}, h AS (SELECT symbol, y, row_number() {W} AS rn, count(*) OVER (PARTITION BY symbol) AS rows_all FROM x0), "
    "f0 AS (SELECT *, greatest((rn - 295) {{DIV¦//}} 21, 0) AS a, least((rn - 1) {{DIV¦//}} 21, (rows_all - 315) {{DIV¦//}} 21) AS z FROM h WHERE rows_all >= 315), "
    "f AS (SELECT symbol, y, rn, {{explode(sequence(a, z))¦unnest(generate_series(a, z))}} AS k FROM f0 WHERE a <= z)"
)
#: Replicates of a resampled statistic, steps of a simulated path, permutations.
REPLICATES, PATHS, STEPS, PERMUTATIONS = Validation().bootstrap, 1000, 252, Validation().bootstrap
QUANTILES, LAST = (5, 25, 50, 75, 95), "last"


def draws(table: str, keep: str, name: str = "w") -> str:
    """``table`` (b, i and ``keep``) with ``u``, a number under 2**31 that depends on replicate and draw alone: two squarings of a congruence, so that draws are not a lattice."""
    return (
        f"{name}0 AS (SELECT {keep}, b, i, ((b + 1) * 69621 + (i + 1) * 104729 + 12345) * 48271 % 2147483647 AS h FROM {table}), "
        f"{name}1 AS (SELECT {keep}, b, i, h, (h * h + i * 7919 + b) % 2147483647 AS g FROM {name}0), {name} AS (SELECT {keep}, b, i, (g * g + h) % 2147483647 AS u FROM {name}1)"
    )


def sig(x: str, name: str, digits: int = 6) -> str:
    """``x`` to so many digits after the first, for values of any size."""
    return f"CAST({{{{format_string('%.{digits}e', CAST({x} AS DOUBLE))¦printf('%.{digits}e', CAST({x} AS DOUBLE))}}}} AS DOUBLE) AS {name}"


def series(n: int | str) -> str:
    """0 to n - 1 as rows."""
    return f"{{{{explode(sequence(0L, CAST({n} AS BIGINT) - 1))¦unnest(range(0, {n}))}}}}"


def corr_over(a: str, b: str, frame: str) -> str:
    """Correlation in a frame, null where either side hardly varies."""
    return f"CASE WHEN stddev_pop({a}) {frame} > 1e-9 AND stddev_pop({b}) {frame} > 1e-9 THEN covar_pop({a}, {b}) {frame} / nullif(stddev_pop({a}) {frame} * stddev_pop({b}) {frame}, 0) END"


_F19 = "OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 18 PRECEDING AND CURRENT ROW)"
_P20 = "OVER (PARTITION BY pair ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


def quantile_of(x: str, q: float) -> str:
    return f"{{{{percentile({x}, {q})¦quantile_cont({x}, {q})}}}}"


def boot_sql(stat: str, name: str, least: int = 10) -> str:
    """DuckDB form of :mod:`barwright.operators.bootstrap` for series of one part: a row for each draw, as many as the series has returns, for each replicate."""
    return (
        f"WITH {HALVES}, c AS (SELECT symbol, count(*) AS n, {stat} AS observed FROM h GROUP BY symbol HAVING count(*) >= {least}), "
        f"bs AS (SELECT symbol, n, {series(REPLICATES)} AS b FROM c), g AS (SELECT symbol, n, b, {series('n')} AS i FROM bs), {draws('g', 'symbol, n')}, "
        f"v AS (SELECT w.symbol, w.b, h.y FROM w JOIN h ON h.symbol = w.symbol AND h.rn = w.u % w.n + 1), s AS (SELECT symbol, b, {stat} AS s FROM v GROUP BY symbol, b), "
        f"a AS (SELECT symbol, count(*) AS n_bootstrap, avg(s) AS m, stddev_pop(s) AS sd, {quantile_of('s', 0.025)} AS lo, {quantile_of('s', 0.975)} AS hi, avg(CASE WHEN s <= 0 THEN 1e0 ELSE 0e0 END) AS down, avg(CASE WHEN s >= 0 THEN 1e0 ELSE 0e0 END) AS up FROM s GROUP BY symbol), "
        f"o AS (SELECT a.*, c.observed, CASE WHEN c.observed > 0 THEN down ELSE up END AS p FROM a JOIN c ON a.symbol = c.symbol) "
        f"SELECT symbol, '{name}' AS statistic_name, n_bootstrap, {r('observed', 'observed_value')}, {r('m', 'bootstrap_mean')}, {r('sd', 'bootstrap_std')}, {r('lo', 'ci_lo')}, {r('hi', 'ci_hi')}, {r('2 * least(p, 1 - p)', 'p_value')} FROM o"
    )


#: One t-test for each symbol and hour: a family of p-values to correct.
FAMILY = f"{RETURNS}, hs AS (SELECT symbol, CAST(t % 24 AS INT) AS hour, count(*) AS n, avg(y) AS m, stddev_samp(y) AS sd FROM x GROUP BY ALL HAVING count(*) > 2), ht AS (SELECT symbol, hour, n, m / nullif(sd / sqrt(n), 0) AS t0 FROM hs), p AS (SELECT symbol, hour, {t_p('t0', 'n - 1')} AS p FROM ht WHERE t0 IS NOT NULL)"


SQL: dict[str, str] = {
    # cleaning and joins
    "pre_01": "SELECT symbol, count(*) AS n, count(CASE WHEN high < greatest(open, close) THEN 1 END) AS bad_high, count(CASE WHEN low > least(open, close) THEN 1 END) AS bad_low, count(CASE WHEN least(open, high, low, close) <= 0 THEN 1 END) AS not_positive, count(CASE WHEN close IS NULL THEN 1 END) AS missing FROM BARS GROUP BY symbol",
    "pre_02": f"WITH dirty AS (SELECT symbol, t, 0 AS o, open, CASE WHEN t % 7 = 0 THEN least(open, close) ELSE high END AS high, low, CASE WHEN t % 5 = 0 THEN NULL ELSE close END AS close FROM BARS UNION ALL SELECT symbol, t, 1 AS o, open, high, low, 0e0 AS close FROM BARS WHERE t % 3 = 0), one AS (SELECT *, row_number() OVER (PARTITION BY symbol, t ORDER BY o) AS rn FROM dirty), fixed AS (SELECT symbol, t, open, greatest(high, open, close) AS high, least(low, open, close) AS low, close FROM one WHERE rn = 1), filled AS (SELECT symbol, t, open, high, low, {{{{last(close, true)¦last_value(close IGNORE NULLS)}}}} {RUN} AS close FROM fixed) SELECT symbol, t, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')} FROM filled WHERE close IS NOT NULL",
    "pre_13": f"WITH {RETURNS} SELECT symbol, count(*) AS n, {r('avg(y)', 'mean_return')}, {r('stddev_samp(y)', 'std_return')}, {r('avg(high - low)', 'mean_range', 4)} FROM x GROUP BY symbol",
    "pre_14": "SELECT symbol, t, volume FROM BARS WHERE volume >= 2 AND close IS NOT NULL AND symbol IN (SELECT min(symbol) FROM BARS) AND t % 24 BETWEEN 7 AND 15",
    "src_07": f"WITH n AS (SELECT symbol, t, close, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS rn FROM BARS) SELECT symbol, t, {r('close', 'close')} FROM n WHERE rn > 5 AND rn <= 25",
    "src_08": f"WITH n AS (SELECT symbol, t, close, row_number() OVER (PARTITION BY symbol ORDER BY t) AS rn FROM BARS WHERE t >= (SELECT min(t) + 48 FROM BARS)) SELECT symbol, t, {r('close', 'close')} FROM n WHERE rn <= 20",
    "src_09": f"SELECT symbol, t, {r('close', 'close')} FROM BARS WHERE t BETWEEN (SELECT min(t) + 24 FROM BARS) AND (SELECT min(t) + 96 FROM BARS)",
    "src_16": "SELECT DISTINCT symbol FROM BARS UNION SELECT 'EURUSD' AS symbol",
    "join_02": f"""WITH f AS (SELECT symbol, t, close FROM BARS), s AS (SELECT symbol, t, close AS other FROM BARS WHERE t % 6 = 0), u AS (SELECT symbol, t, close, NULL AS other, NULL AS ts0, 1 AS fast FROM f UNION ALL SELECT symbol, t, NULL AS close, other, t AS ts0, 0 AS fast FROM s),
w AS (SELECT symbol, t, close, fast, {{{{last(ts0, true)¦last_value(ts0 IGNORE NULLS)}}}} OVER (PARTITION BY symbol ORDER BY t, fast ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ta, {{{{last(other, true)¦last_value(other IGNORE NULLS)}}}} OVER (PARTITION BY symbol ORDER BY t, fast ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS va,
{{{{first(ts0, true)¦first_value(ts0 IGNORE NULLS)}}}} OVER (PARTITION BY symbol ORDER BY t, fast DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tb, {{{{first(other, true)¦first_value(other IGNORE NULLS)}}}} OVER (PARTITION BY symbol ORDER BY t, fast DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vb FROM u)
SELECT symbol, t, {r('CASE WHEN tb IS NULL OR (ta IS NOT NULL AND t - ta <= tb - t) THEN va ELSE vb END', 'nearest')} FROM w WHERE fast = 1""",
    "vlm_05": f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS rn FROM BARS), b AS (SELECT symbol, min(low) AS lo, max(high) AS hi FROM l WHERE rn <= 100 GROUP BY symbol), k AS (SELECT {{{{explode(sequence(0, 19))¦unnest(range(0, 20))}}}} AS k),
e AS (SELECT symbol, CAST(k AS BIGINT) AS bin, lo + (hi - lo) / 20 * k AS a, lo + (hi - lo) / 20 * (k + 1) AS z FROM b CROSS JOIN k) SELECT e.symbol, e.bin, {r('sum(l.volume)', 'volume')} FROM e JOIN l ON l.symbol = e.symbol AND l.rn <= 100 AND l.low <= e.z - 1e-9 AND l.high >= e.a + 1e-9 GROUP BY e.symbol, e.bin""",
    # edges with statistics of their own
    "tim_06": f"""WITH d AS (SELECT symbol, t, open, high, low, close, {DAY} AS d, CAST((floor(t / 24) + 3) % 7 AS INT) AS wd FROM BARS), g AS (SELECT symbol, CAST(extract(year FROM d) AS INT) AS yr, CAST(extract(week FROM d) AS INT) AS wk, {{{{max_by¦arg_max}}}}(CASE WHEN wd = 4 THEN close END, CASE WHEN wd = 4 THEN t END) AS fri, {{{{min_by¦arg_min}}}}(CASE WHEN wd = 0 THEN open END, CASE WHEN wd = 0 THEN t END) AS mon,
max(CASE WHEN wd = 0 THEN high END) AS mh, min(CASE WHEN wd = 0 THEN low END) AS ml FROM d GROUP BY ALL), f AS (SELECT symbol, CASE WHEN ml <= fri AND mh >= fri THEN 1e0 ELSE 0e0 END AS filled FROM g WHERE fri IS NOT NULL AND mon IS NOT NULL AND mon <> fri), s AS (SELECT symbol, count(*) AS n, avg(filled) AS fill FROM f GROUP BY symbol HAVING count(*) >= 30),
u AS (SELECT *, 4 * n * pow(fill - 0.5, 2) AS chi FROM s) SELECT symbol, n, {r('fill', 'fill_rate')}, {r('chi', 'chi_squared', 4)}, {r(chi2_p('chi', 1), 'p_value', 5)} FROM u""",
    "tre_03": f"""WITH l AS (SELECT symbol, t, CASE WHEN close > 0 AND lag(close) {W} > 0 THEN ln(close / lag(close) {W}) END AS lr FROM BARS), v AS (SELECT * FROM l WHERE lr IS NOT NULL), k AS (SELECT {{{{explode(sequence(2, 20))¦unnest(range(2, 21))}}}} AS k), n AS (SELECT symbol, lr, row_number() {W} AS rn FROM v),
d AS (SELECT a.symbol, k.k, stddev_pop(a.lr - b.lr) AS tau FROM k JOIN n a ON true JOIN n b ON b.symbol = a.symbol AND b.rn = a.rn - k.k GROUP BY a.symbol, k.k), f AS (SELECT d.symbol, regr_slope(ln(tau), ln(k)) AS h, corr(ln(tau), ln(k)) AS rho, regr_syy(ln(tau), ln(k)) AS syy, regr_sxx(ln(tau), ln(k)) AS sxx, count(*) AS lags FROM d GROUP BY d.symbol), z AS (SELECT symbol, count(*) AS n FROM v GROUP BY symbol),
u AS (SELECT f.symbol, z.n, lags, h, sqrt((1 - rho * rho) * syy / sxx / (lags - 2)) AS se, rho * sqrt((lags - 2) / (1 - rho * rho)) AS t0 FROM f JOIN z ON f.symbol = z.symbol)
SELECT symbol, n, lags, {r('h', 'hurst')}, {r('se', 'std_err')}, {r(t_p('t0', 'lags - 2'), 'p_value', 5)}, CASE WHEN h > 0.55 THEN 'trending' WHEN h < 0.45 THEN 'mean_reverting' ELSE 'random' END AS regime FROM u""",
    "tre_07": f"""WITH {RETURNS}, s AS (SELECT symbol, t, CASE WHEN y > 0 THEN 1 ELSE -1 END AS sg FROM x WHERE y <> 0), c AS (SELECT *, CASE WHEN sg <> lag(sg) {W} THEN 1 ELSE 0 END AS ch FROM s), g AS (SELECT symbol, count(*) AS n, sum(ch) + 1 AS runs, CAST(count(CASE WHEN sg > 0 THEN 1 END) AS DOUBLE) AS a, CAST(count(CASE WHEN sg < 0 THEN 1 END) AS DOUBLE) AS b FROM c GROUP BY symbol),
z AS (SELECT symbol, n, CAST(runs AS BIGINT) AS runs, (runs - (2 * a * b / (a + b) + 1)) / sqrt(2 * a * b * (2 * a * b - a - b) / (pow(a + b, 2) * (a + b - 1))) AS z FROM g) SELECT symbol, n, runs, {r('z', 'z')}, {r(normal_p('z'), 'p_value', 5)} FROM z""",
    "vle_01": f"""WITH {RETURNS}, a AS (SELECT symbol, t, abs(y) AS v, lag(abs(y)) {W} AS pv, avg(abs(y)) OVER (PARTITION BY symbol) AS m FROM x), w AS (SELECT symbol, t, CASE WHEN count(pv) {_F19} = 19 THEN {corr_over("v", "pv", _F19)} END AS c FROM a),
k AS (SELECT symbol, v - m AS v, {", ".join(f"lag(v - m, {k}) {W} AS v{k}" for k in range(1, 11))} FROM a), l AS (SELECT symbol, count(*) AS n, CAST(count(*) AS DOUBLE) * (count(*) + 2) * ({" + ".join(f"pow(sum(v * v{k}) / nullif(sum(v * v), 0), 2) / nullif(count(*) - {k}, 0)" for k in range(1, 11))}) AS q FROM k GROUP BY symbol),
g AS (SELECT symbol, count(c) AS windows, avg(c) AS m, stddev_samp(c) AS sd FROM w GROUP BY symbol), u AS (SELECT g.symbol, l.n, g.windows, g.m, g.sd, l.q, {chi2_p("l.q", 10)} AS p FROM g JOIN l ON g.symbol = l.symbol)
SELECT symbol, n, windows, {r('m', 'avg_autocorrelation')}, {r('sd', 'std_autocorrelation')}, {r('q', 'ljung_box', 4)}, {r('p', 'p_value', 5)}, coalesce(m > 0.2 AND p < 0.05, false) AS is_significant FROM u""",
    "str_e2": f"""WITH d AS (SELECT *, {DAY} AS d, lead(close, 10) {W} / nullif(close, 0) - 1 AS f10 FROM BARS), y AS (SELECT symbol, d, max(high) AS h, min(low) AS l, {{{{max_by¦arg_max}}}}(close, t) AS c FROM d GROUP BY symbol, d), p AS (SELECT symbol, d, lag(h) OVER (PARTITION BY symbol ORDER BY d) AS ph, lag(l) OVER (PARTITION BY symbol ORDER BY d) AS pl, lag(c) OVER (PARTITION BY symbol ORDER BY d) AS pc FROM y),
j AS (SELECT d.symbol, d.close, d.f10, avg(abs(d.f10)) OVER (PARTITION BY d.symbol) AS usual, p.ph, p.pl, p.pc FROM d LEFT JOIN p ON d.symbol = p.symbol AND d.d = p.d), k AS (SELECT symbol, 'prev_high' AS edge_key, f10, usual FROM j WHERE abs(close - ph) / nullif(close, 0) < 0.001 UNION ALL SELECT symbol, 'prev_low' AS edge_key, f10, usual FROM j WHERE abs(close - pl) / nullif(close, 0) < 0.001 UNION ALL SELECT symbol, 'prev_close' AS edge_key, f10, usual FROM j WHERE abs(close - pc) / nullif(close, 0) < 0.001),
s AS (SELECT symbol, edge_key, count(f10) AS n, avg(f10) AS m, stddev_samp(f10) AS sd, avg(CASE WHEN f10 > 0 THEN 1e0 ELSE 0e0 END) AS win, (avg(abs(f10)) - max(usual)) / nullif(stddev_samp(abs(f10)) / sqrt(count(f10)), 0) AS t0 FROM k WHERE f10 IS NOT NULL GROUP BY symbol, edge_key HAVING count(f10) >= 30), u AS (SELECT *, {t_p("t0", "n - 1")} AS p FROM s)
SELECT symbol, edge_key, n, {r("m", "mean_return")}, {r("sd", "std_return")}, {r("t0", "t_statistic", 5)}, {r("p", "p_value", 5)}, {r("win", "win_rate")}, {r("coalesce(m / nullif(sd, 0) * sqrt(25.2e0), 0)", "sharpe_ratio", 5)}, coalesce(p < 0.05, false) AS is_significant FROM u""",
    # tests
    "sta_01": f"WITH {RETURNS}, s AS (SELECT symbol, count(y) AS n, avg(y) AS m, stddev_samp(y) AS sd FROM x GROUP BY symbol), u AS (SELECT *, m / nullif(sd / sqrt(n), 0) AS t0 FROM s) SELECT symbol, n, {r('t0', 'statistic', 5)}, {r(t_p('t0', 'n - 1'), 'p_value', 5)}, {r('m / nullif(sd, 0)', 'effect_size')} FROM u",
    "sta_02": f"WITH {HALVES}, s AS (SELECT symbol, CAST(count(CASE WHEN rn % 2 = 0 THEN y END) AS DOUBLE) AS n1, avg(CASE WHEN rn % 2 = 0 THEN y END) AS m1, var_samp(CASE WHEN rn % 2 = 0 THEN y END) AS v1, CAST(count(CASE WHEN rn % 2 = 1 THEN y END) AS DOUBLE) AS n2, avg(CASE WHEN rn % 2 = 1 THEN y END) AS m2, var_samp(CASE WHEN rn % 2 = 1 THEN y END) AS v2 FROM h GROUP BY symbol), u AS (SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t0, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df FROM s) SELECT symbol, {r('t0', 'statistic', 5)}, {r('df', 'df', 3)}, {r(t_p('t0', 'df'), 'p_value', 5)}, {r('(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))', 'effect_size')} FROM u",
    "sta_03": f"WITH {HALVES}, d AS (SELECT a.symbol, a.y - b.y AS v FROM h a JOIN h b ON a.symbol = b.symbol AND b.rn = a.rn + 1), s AS (SELECT symbol, count(*) AS n, avg(v) AS m, stddev_samp(v) AS sd FROM d GROUP BY symbol), u AS (SELECT *, m / nullif(sd / sqrt(n), 0) AS t0 FROM s) SELECT symbol, n, {r('t0', 'statistic', 5)}, {r(t_p('t0', 'n - 1'), 'p_value', 5)}, {r('-m / nullif(sd, 0)', 'effect_size')} FROM u",
    "sta_04": f"WITH {HALVES}, g AS (SELECT symbol, rn % 2 AS grp, {_r('y', 9)} AS v FROM h), {RANKED}, s AS (SELECT symbol, sum(CASE WHEN grp = 0 THEN rk END) AS r1, CAST(count(CASE WHEN grp = 0 THEN 1 END) AS DOUBLE) AS n1, CAST(count(CASE WHEN grp = 1 THEN 1 END) AS DOUBLE) AS n2, sum(pow(ties, 2) - 1) AS tie FROM k GROUP BY symbol), u AS (SELECT symbol, n1, n2, r1 - n1 * (n1 + 1) / 2 AS u1, tie, sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - tie / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM s), z AS (SELECT *, (abs(u1 - n1 * n2 / 2) - 0.5) / sd AS z FROM u) SELECT symbol, {r('u1', 'statistic', 2)}, {r('{{u_p(u1, n1, n2, CAST(tie AS DOUBLE), z)¦' + normal_p_sql('z') + '}}', 'p_value', 5)}, {r('1 - 2 * u1 / (n1 * n2)', 'effect_size')} FROM z",
    "sta_05": f"WITH {HALVES}, g AS (SELECT symbol, {_r('abs(y)', 9)} AS v, CASE WHEN y > 0 THEN 1 ELSE 0 END AS up FROM h WHERE y <> 0), {RANKED}, s AS (SELECT symbol, CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN up = 1 THEN rk ELSE 0 END) AS wp, sum(CASE WHEN up = 0 THEN rk ELSE 0 END) AS wm, sum(pow(ties, 2) - 1) AS tie FROM k GROUP BY symbol), z AS (SELECT *, (least(wp, wm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48) AS z FROM s) SELECT symbol, {r('least(wp, wm)', 'statistic', 2)}, {r('{{w_p(least(wp, wm), n, CAST(tie AS DOUBLE), z)¦' + normal_p_sql('z') + '}}', 'p_value', 5)}, {r('least(wp, wm) / (n * (n + 1) / 4)', 'effect_size')} FROM z",
    "sta_06": f"WITH {HALVES}, g AS (SELECT symbol, rn % 3 AS grp, {_r('y', 9)} AS v FROM h), {RANKED}, c AS (SELECT symbol, grp, CAST(count(*) AS DOUBLE) AS n, sum(rk) AS s, sum(pow(ties, 2) - 1) AS tie FROM k GROUP BY symbol, grp), a AS (SELECT symbol, sum(n) AS n, sum(s * s / n) AS q, sum(tie) AS tie FROM c GROUP BY symbol), z AS (SELECT *, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - tie / (pow(n, 3) - n)) AS h0 FROM a) SELECT symbol, {r('h0', 'statistic', 4)}, {r(chi2_p('h0', 2), 'p_value', 5)}, {r('(h0 - 2) / (n - 3)', 'effect_size', 5)} FROM z",
    "sta_07": f"WITH d AS (SELECT symbol, CAST(t % 24 / 6 AS INT) AS q FROM BARS), c AS (SELECT symbol, q, CAST(count(*) AS DOUBLE) AS o FROM (SELECT symbol, CAST(floor(t % 24 / 8) AS INT) AS q FROM BARS) z GROUP BY symbol, q), e AS (SELECT *, sum(o) OVER (PARTITION BY symbol) AS n FROM c), s AS (SELECT symbol, max(n) AS n, sum(pow(o - n / 3, 2) / (n / 3)) AS chi FROM e GROUP BY symbol) SELECT symbol, {r('chi', 'statistic', 4)}, {r(chi2_p('chi', 2), 'p_value', 5)}, {r('sqrt(chi / n)', 'effect_size', 5)} FROM s",
    "sta_08": f"WITH {HALVES}, c AS (SELECT symbol, CAST(count(CASE WHEN y > 0 AND rn % 2 = 0 THEN 1 END) AS DOUBLE) AS a, CAST(count(CASE WHEN y > 0 AND rn % 2 = 1 THEN 1 END) AS DOUBLE) AS b, CAST(count(CASE WHEN y <= 0 AND rn % 2 = 0 THEN 1 END) AS DOUBLE) AS c, CAST(count(CASE WHEN y <= 0 AND rn % 2 = 1 THEN 1 END) AS DOUBLE) AS d FROM h GROUP BY symbol), s AS (SELECT symbol, a + b + c + d AS n, (a + b + c + d) * pow(greatest(abs(a * d - b * c) - (a + b + c + d) / 2, 0), 2) / ((a + b) * (c + d) * (a + c) * (b + d)) AS chi FROM c) SELECT symbol, {r('chi', 'statistic', 5)}, {r(chi2_p('chi', 1), 'p_value', 5)}, {r('sqrt(chi / n)', 'cramers_v', 5)} FROM s",
    "sta_09": f"WITH {PAIRS}, q AS (SELECT pair, count(*) AS n, corr(ya, yb) AS rho FROM ab GROUP BY pair HAVING count(*) > 2), u AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t0 FROM q) SELECT pair, n, {r('rho', 'statistic')}, {r(t_p('t0', 'n - 2'), 'p_value', 5)} FROM u",
    "sta_13": f"WITH {PAIRS}, q AS (SELECT pair, abs(corr(ya, yb)) AS rho FROM ab GROUP BY pair) SELECT pair, CASE WHEN rho < 0.1 THEN 'negligible' WHEN rho < 0.3 THEN 'weak' WHEN rho < 0.5 THEN 'moderate' WHEN rho < 0.7 THEN 'strong' ELSE 'very strong' END AS strength FROM q",
    # metrics and reports
    "met_01": f"WITH {RETURNS}, {ISLANDS}, m AS (SELECT symbol, count(*) AS n, count(CASE WHEN y > 0 THEN 1 END) AS wins, count(CASE WHEN y < 0 THEN 1 END) AS losses, coalesce(avg(CASE WHEN y > 0 THEN y END), 0) AS aw, coalesce(-avg(CASE WHEN y < 0 THEN y END), 0) AS al, coalesce(sum(CASE WHEN y > 0 THEN y END), 0) AS gp, coalesce(-sum(CASE WHEN y < 0 THEN y END), 0) AS gl, CAST(max(ws) AS BIGINT) AS mw, CAST(max(ls) AS BIGINT) AS ml FROM j GROUP BY symbol) SELECT symbol, n AS total_trades, wins AS winning_trades, losses AS losing_trades, {r('CAST(wins AS DOUBLE) / n', 'win_rate')}, {r('aw', 'avg_win')}, {r('al', 'avg_loss')}, {r('coalesce(aw / nullif(al, 0), 0)', 'win_loss_ratio')}, {r('CAST(wins AS DOUBLE) / n * aw - (1 - CAST(wins AS DOUBLE) / n) * al', 'expectancy')}, {r('coalesce(gp / nullif(gl, 0), 0)', 'profit_factor')}, mw AS max_consecutive_wins, ml AS max_consecutive_losses FROM m",
    "met_02": f"WITH {EQUITY}, g AS (SELECT *, count(CASE WHEN drawdown >= 0 THEN 1 END) {RUN} AS island FROM q), c AS (SELECT symbol, island, count(CASE WHEN drawdown < 0 THEN 1 END) AS len FROM g GROUP BY symbol, island), l AS (SELECT symbol, max(len) AS dur FROM c GROUP BY symbol), m AS (SELECT symbol, count(*) AS n, avg(y) AS mean_y, stddev_samp(y) AS sd, stddev_samp(CASE WHEN y < 0 THEN y END) AS dn, exp(sum({GROWTH})) - 1 AS total, exp(sum({GROWTH}) * 252e0 / count(*)) - 1 AS yearly, -min(drawdown) AS mdd, sqrt(avg(drawdown * drawdown)) AS ulcer FROM q GROUP BY symbol) SELECT m.symbol, {r('total', 'total_return', 4)}, {r('yearly', 'annualized_return', 4)}, {r('coalesce(yearly / nullif(mdd, 0), 0)', 'calmar_ratio', 4)}, {r('mean_y * sqrt(252) / nullif(sd, 0)', 'sharpe_ratio', 5)}, {r('mean_y * sqrt(252) / nullif(dn, 0)', 'sortino_ratio', 5)}, {r('mdd', 'max_drawdown')}, l.dur AS max_drawdown_duration, {r('total / nullif(mdd, 0)', 'recovery_factor', 4)}, {r('ulcer', 'ulcer_index')} FROM m JOIN l ON m.symbol = l.symbol",
    "met_03": f"WITH {RETURNS}, y AS (SELECT symbol, CAST(extract(year FROM d) AS INT) AS yr, sum(y) AS s, count(*) AS n FROM x GROUP BY ALL) SELECT symbol, yr, n, {r('s', 'yearly_return')} FROM y",
    "met_04": f"WITH {RETURNS}, m AS (SELECT symbol, CAST(count(CASE WHEN y > 0 THEN 1 END) AS DOUBLE) / count(*) AS w, avg(CASE WHEN y > 0 THEN y END) AS aw, -avg(CASE WHEN y < 0 THEN y END) AS al, avg(y) AS mean_y FROM x GROUP BY symbol) SELECT symbol, {r('mean_y - 0.0002', 'net_mean')}, {r('al / (aw + al)', 'breakeven_win_rate')}, {r('greatest(w - (1 - w) / (aw / al), 0)', 'kelly')} FROM m",
    "met_05": f"WITH {RETURNS}, m AS (SELECT symbol, avg(y) * 252 AS a, stddev_samp(y) * sqrt(252) AS s FROM x GROUP BY symbol) SELECT symbol, {r('a - 0.02', 'excess_return')}, {r('(a - 0.02) / nullif(s, 0)', 'sharpe_ratio', 5)}, {r('(a - 0.02) / nullif(s, 0) * 0.15 + 0.02', 'm2_measure', 5)}, {r('s', 'volatility')} FROM m",
    "rpt_01": f"WITH {EQUITY} SELECT symbol, t, {r('equity', 'equity')}, {r('drawdown', 'drawdown')} FROM q",
    "rpt_02": f"WITH {RETURNS} SELECT symbol, CAST(extract(year FROM d) AS INT) AS yr, CAST(extract(month FROM d) AS INT) AS mon, {r(f'exp(sum({GROWTH})) - 1', 'monthly_return')} FROM x GROUP BY ALL",
    "rpt_03": f"WITH {RETURNS}, w AS (SELECT symbol, t, count(y) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS n, avg(y) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS m, stddev_samp(y) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS s FROM x) SELECT symbol, t, {r('m / nullif(s, 0) * sqrt(252)', 'rolling_sharpe', 4)} FROM w WHERE n = 252",
    "rpt_04": f"WITH {RETURNS}, m AS (SELECT symbol, min(y) AS lo, max(y) AS hi FROM x GROUP BY symbol), b AS (SELECT x.symbol, least(CAST(floor((y - lo) / nullif(hi - lo, 0) * 49 + 1e-9) AS BIGINT), 48) AS bin, lo, hi FROM x JOIN m ON x.symbol = m.symbol) SELECT symbol, coalesce(bin, 0) AS bin, count(*) AS n, {r('max(lo + (hi - lo) / 49 * coalesce(bin, 0))', 'left_edge')} FROM b GROUP BY symbol, coalesce(bin, 0)",
    "rpt_06": f"WITH {RETURNS} SELECT symbol, CAST(t % 24 AS INT) AS hour, count(*) AS n, {r('avg(y)', 'mean_return')} FROM x GROUP BY ALL",
    # pairs
    "par_01": f"WITH {PAIRS}, w AS (SELECT pair, t, count(ya) OVER (PARTITION BY pair ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n, {corr_over('ya', 'yb', _P20)} AS c FROM ab) SELECT pair, t, {r('c', 'rolling_correlation')} FROM w WHERE n = 20",
    "par_03": f"WITH {PAIRS}, k AS (SELECT {{{{explode(sequence(1, 10))¦unnest(range(1, 11))}}}} AS k), n AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY t) AS rn FROM ab), c AS (SELECT a.pair, CAST(k.k AS BIGINT) AS lag_bars, count(*) AS n, corr(a.ya, b.yb) AS rho FROM k JOIN n a ON true JOIN n b ON a.pair = b.pair AND b.rn = a.rn + k.k GROUP BY a.pair, k.k) SELECT pair, lag_bars, n, {r('rho', 'correlation')}, {r(t_p('rho * sqrt(n - lag_bars)', 'n - 2'), 'p_value', 5)} FROM c",
    "par_05": f"WITH {PAIRS}, o AS (SELECT pair, regr_slope(ca, cb) AS b, regr_intercept(ca, cb) AS a FROM ab GROUP BY pair), e AS (SELECT ab.pair, t, ca - a - b * cb AS e FROM ab JOIN o ON ab.pair = o.pair), d AS (SELECT pair, e - lag(e) OVER (PARTITION BY pair ORDER BY t) AS de, lag(e) OVER (PARTITION BY pair ORDER BY t) AS pe FROM e), c AS (SELECT pair, count(*) AS n, corr(de, pe) AS rho FROM d WHERE de IS NOT NULL GROUP BY pair), u AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t0 FROM c) SELECT pair, n, {r('rho', 'statistic')}, {r(t_p('t0', 'n - 2'), 'p_value', 5)} FROM u",
    "par_06": f"WITH {PAIRS}, s AS (SELECT pair, ca - cb AS s, ca - cb - lag(ca - cb) OVER (PARTITION BY pair ORDER BY t) AS ds, lag(ca - cb) OVER (PARTITION BY pair ORDER BY t) AS ps FROM ab), l AS (SELECT pair, regr_slope(ds, ps) AS lambda_ FROM s GROUP BY pair) SELECT pair, {r('CASE WHEN lambda_ < 0 THEN -ln(2) / lambda_ END', 'half_life')} FROM l",
    # folds
    "wfo_01": f"WITH {FOLDS}, k AS (SELECT {{{{symbol AS of, explode(sequence(0, greatest(rows_all - 315, 0) DIV 21))¦unnest(range(0, 41))}}}} AS k{{{{ FROM n¦}}}}) SELECT symbol, CAST(k AS BIGINT) AS fold, CAST(k * 21 AS BIGINT) AS train_start, CAST(k * 21 + 252 AS BIGINT) AS train_end, CAST(k * 21 + 315 AS BIGINT) AS test_end FROM n {{{{JOIN k ON symbol = of¦CROSS JOIN k}}}} WHERE k * 21 + 315 <= rows_all",
    "wfo_02": f"WITH {IN_FOLDS} SELECT symbol, CAST(k AS BIGINT) AS fold, CASE WHEN rn <= k * 21 + 252 THEN 'train' ELSE 'test' END AS role, count(y) AS n, {r('avg(y)', 'mean_return')}, {r('avg(y) / nullif(stddev_samp(y), 0) * sqrt(252)', 'sharpe', 4)}, {r('avg(CASE WHEN y > 0 THEN 1e0 WHEN y <= 0 THEN 0e0 END)', 'win_rate')} FROM f GROUP BY ALL",
    "wfo_03": f"WITH {IN_FOLDS}, g AS (SELECT symbol, k, CASE WHEN rn <= k * 21 + 252 THEN 0 ELSE 1 END AS oos, avg(y) AS m, coalesce(avg(y) / nullif(stddev_samp(y), 0) * sqrt(252), 0) AS s FROM f GROUP BY ALL), "
    f"m AS (SELECT symbol, count(CASE WHEN oos = 1 THEN 1 END) AS folds, avg(CASE WHEN oos = 0 THEN m END) AS tr, avg(CASE WHEN oos = 1 THEN m END) AS te, avg(CASE WHEN oos = 0 THEN s END) AS tr_s, avg(CASE WHEN oos = 1 THEN s END) AS te_s, stddev_pop(CASE WHEN oos = 1 THEN s END) AS sd_s, avg(CASE WHEN oos = 1 AND s > 0 THEN 1e0 WHEN oos = 1 THEN 0e0 END) AS steady FROM g GROUP BY symbol), "
    f"u AS (SELECT *, coalesce(te_s / nullif(tr_s, 0), 0) AS eff, coalesce((tr_s - te_s) / nullif(tr_s, 0), 0) AS lost FROM m) SELECT symbol, folds, {r('tr', 'train_mean')}, {r('te', 'test_mean')}, {r('tr_s', 'is_sharpe_mean', 4)}, {r('te_s', 'oos_sharpe_mean', 4)}, {r('sd_s', 'oos_sharpe_std', 4)}, {r('eff', 'efficiency', 3)}, {r('tr_s - te_s', 'degradation', 4)}, {r('lost', 'degradation_pct', 3)}, {r('steady', 'fold_consistency')}, eff < 0.5 AS is_overfitted, "
    f"concat_ws('; ', CASE WHEN eff < 0.3 THEN 'very low efficiency' WHEN eff < 0.5 THEN 'low efficiency' END, CASE WHEN lost > 0.7 THEN 'large degradation out of sample' END, CASE WHEN steady < 0.5 THEN 'inconsistent across folds' END) AS warnings FROM u",
    "wfo_04": f"WITH {FOLDS}, k AS (SELECT {{{{explode(sequence(1, 5))¦unnest(range(1, 6))}}}} AS k) SELECT symbol, CAST(k AS BIGINT) AS fold, CAST(floor(rows_all / 6e0) * k AS BIGINT) AS train_end, CAST(CASE WHEN k = 5 THEN rows_all ELSE floor(rows_all / 6e0) * (k + 1) END AS BIGINT) AS test_end FROM n CROSS JOIN k",
    "wfo_05": f"WITH {FOLDS}, k AS (SELECT {{{{explode(sequence(0, 4))¦unnest(range(0, 5))}}}} AS k), s AS (SELECT symbol, k, rows_all, CAST(floor(rows_all / 5e0) AS BIGINT) AS size FROM n CROSS JOIN k), b AS (SELECT symbol, k, rows_all, size * k AS a, CASE WHEN k = 4 THEN rows_all ELSE size * (k + 1) END AS z FROM s) SELECT symbol, CAST(k AS BIGINT) AS fold, a AS test_start, z AS test_end, greatest(a - 10, 0) + greatest(rows_all - z - 5, 0) AS train_rows FROM b",
    # resampling
    "boo_04": f"WITH {HALVES}, c AS (SELECT symbol, count(*) AS n FROM h GROUP BY symbol HAVING count(*) >= 30), bs AS (SELECT symbol, n, {series(PATHS)} AS b FROM c), g AS (SELECT symbol, n, b, {series(STEPS)} AS i FROM bs), {draws('g', 'symbol, n')}, v AS (SELECT w.symbol, w.b, w.i, h.y FROM w JOIN h ON h.symbol = w.symbol AND h.rn = w.u % w.n + 1), "
    f"e AS (SELECT symbol, b, i, sum({GROWTH}) OVER (PARTITION BY symbol, b ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grown FROM v), k AS (SELECT symbol, b, i, grown, greatest(max(grown) OVER (PARTITION BY symbol, b ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS peak FROM e), "
    f"f AS (SELECT symbol, b, exp(max(CASE WHEN i = {STEPS - 1} THEN grown END)) AS last, exp(least(min(grown - peak), 0)) - 1 AS dd FROM k GROUP BY symbol, b), "
    f"z AS (SELECT symbol, count(*) AS n_paths, {', '.join(f'{quantile_of(LAST, q / 100)} AS q{q:02d}' for q in QUANTILES)}, avg(last) AS m, stddev_pop(last) AS sd, avg(CASE WHEN last > 1 THEN 1e0 ELSE 0e0 END) AS up, avg(dd) AS dd, {quantile_of('dd', 0.05)} AS worst FROM f GROUP BY symbol) "
    f"SELECT symbol, n_paths, {', '.join(sig(f'q{q:02d}', f'p{q:02d}') for q in QUANTILES)}, {sig('m', 'mean_final')}, {sig('sd', 'std_final')}, {r('up', 'prob_profit')}, {r('dd', 'expected_max_dd')}, {r('worst', 'worst_case_dd')} FROM z",
}

SQL["pre_12"] = SQL["join_02"]
#: DuckDB form of the permutations: the first n1 rows of a random order are group one, so a permutation keeps the sizes of both groups.
PERMUTED_SQL = (
    f"WITH {HALVES}, c AS (SELECT symbol, count(*) AS n, count(CASE WHEN rn % 2 = 0 THEN 1 END) AS n1, avg(CASE WHEN rn % 2 = 0 THEN y END) - avg(CASE WHEN rn % 2 = 1 THEN y END) AS obs, "
    f"quantile_cont(CASE WHEN rn % 2 = 0 THEN y END, 0.5) - quantile_cont(CASE WHEN rn % 2 = 1 THEN y END, 0.5) AS obs_median FROM h GROUP BY symbol HAVING count(*) >= 30), "
    f"bs AS (SELECT symbol, n1, {series(PERMUTATIONS)} AS b FROM c), g AS (SELECT h.symbol, bs.n1, bs.b, h.rn AS i, h.y FROM h JOIN bs ON h.symbol = bs.symbol), {draws('g', 'symbol, n1, y')}, "
    f"o AS (SELECT symbol, b, y, CASE WHEN row_number() OVER (PARTITION BY symbol, b ORDER BY u, i) <= n1 THEN 1 ELSE 0 END AS one FROM w), "
    f"s AS (SELECT symbol, b, avg(CASE WHEN one = 1 THEN y END) - avg(CASE WHEN one = 0 THEN y END) AS s, quantile_cont(CASE WHEN one = 1 THEN y END, 0.5) - quantile_cont(CASE WHEN one = 0 THEN y END, 0.5) AS sm FROM o GROUP BY symbol, b) "
    f"SELECT s.symbol, count(*) AS n_permutations, {r('max(c.obs)', 'observed')}, {r('avg(s)', 'permutation_mean')}, {r('stddev_pop(s)', 'permutation_std')}, {r(quantile_of('s', 0.025), 'ci_lo')}, {r(quantile_of('s', 0.975), 'ci_hi')}, {r('avg(CASE WHEN abs(s) >= abs(c.obs) THEN 1e0 ELSE 0e0 END)', 'p_value')}, "
    f"{r('max(c.obs_median)', 'observed_median')}, {r('avg(CASE WHEN abs(sm) >= abs(c.obs_median) THEN 1e0 ELSE 0e0 END)', 'median_p_value')} FROM s JOIN c ON s.symbol = c.symbol GROUP BY s.symbol"
)
SQL["vlm_01"] = "SELECT symbol, t, coalesce(volume, 1) AS volume FROM BARS"
SQL["src_10"] = "SELECT symbol, t, close FROM BARS WHERE t % 24 < 6 AND volume > 1"
SQL["src_03"] = "SELECT DISTINCT split_part(concat(symbol, '_H1'), '_', 1) AS symbol FROM BARS"
SQL["src_15"] = "SELECT symbol, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM BARS GROUP BY symbol"
SQL["par_11"] = f"SELECT pair, lag_bars, n, correlation FROM ({SQL['par_03']}) z WHERE p_value < 0.05 AND abs(correlation) > 0.1"
#: DuckDB forms of :mod:`barwright.operators.corrections`.
CORRECTED_SQL = {
    "sta_10": f"WITH {FAMILY} SELECT symbol, hour, {r('p', 'p_value', 5)}, {r('least(p * count(*) OVER (PARTITION BY 1), 1)', 'adjusted', 5)} FROM p",
    "sta_11": f"WITH {FAMILY}, o AS (SELECT *, row_number() OVER (PARTITION BY 1 ORDER BY p, symbol, hour) AS i, count(*) OVER (PARTITION BY 1) AS n FROM p) SELECT symbol, hour, {r('p', 'p_value', 5)}, {r('least(max(p * (n - i + 1)) OVER (PARTITION BY 1 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1)', 'adjusted', 5)} FROM o",
    "sta_12": f"WITH {FAMILY}, o AS (SELECT *, row_number() OVER (PARTITION BY 1 ORDER BY p, symbol, hour) AS i, count(*) OVER (PARTITION BY 1) AS n FROM p) SELECT symbol, hour, {r('p', 'p_value', 5)}, {r('least(min(p * n / i) OVER (PARTITION BY 1 ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1)', 'adjusted', 5)} FROM o",
}


_TEN = "OVER (PARTITION BY pair ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_HUNDRED = "OVER (PARTITION BY pair ORDER BY t ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"
#: One-sample test of v by ``key``: figures of the samples with 30 values or more.
ONE_SAMPLE = "count(v) AS n, avg(v) AS m, stddev_samp(v) AS sd, avg(CASE WHEN v > 0 THEN 1e0 ELSE 0e0 END) AS win, avg(v) / nullif(stddev_samp(v) / sqrt(count(v)), 0) AS t0"
ONE_RESULT = f"n, {r('m', 'mean_return', 5)}, {r('sd', 'std_return', 5)}, {r('t0', 't_statistic', 4)}, {r('p', 'p_value', 5)}, {r('win', 'win_rate')}, {r('coalesce(m / nullif(sd, 0) * sqrt(25.2e0), 0)', 'sharpe_ratio', 4)}, coalesce(p < 0.05, false) AS is_significant"
# Breakdowns of correlation: the short one falls by a half under its long mean, or under -0.5. What follows is how far the two series part in ten bars; pairs with fewer than 30 breakdowns have no test.
SQL["par_02"] = (
    f"WITH {PAIRS}, w AS (SELECT pair, t, CASE WHEN count(ya) {_TEN} = 20 THEN {corr_over('ya', 'yb', _P20)} END AS c, abs((lead(ca, 10) OVER (PARTITION BY pair ORDER BY t) / nullif(ca, 0)) - (lead(cb, 10) OVER (PARTITION BY pair ORDER BY t) / nullif(cb, 0))) AS dv FROM ab), "
    f"l AS (SELECT *, CASE WHEN count(c) {_HUNDRED} = 100 THEN avg(c) {_HUNDRED} END AS usual FROM w), b AS (SELECT pair, dv, coalesce(c < usual - 0.5, false) OR coalesce(c < -0.5, false) AS broken FROM l WHERE dv IS NOT NULL), k AS (SELECT *, avg(CASE WHEN NOT broken THEN dv END) OVER (PARTITION BY pair) AS other FROM b), "
    "s AS (SELECT pair, count(CASE WHEN broken THEN 1 END) AS n, count(CASE WHEN NOT broken THEN 1 END) AS n_other, avg(CASE WHEN broken THEN dv END) AS m1, avg(CASE WHEN NOT broken THEN dv END) AS m0, var_samp(CASE WHEN broken THEN dv END) AS v1, var_samp(CASE WHEN NOT broken THEN dv END) AS v0, avg(CASE WHEN broken AND dv > other THEN 1e0 WHEN broken THEN 0e0 END) AS win FROM k GROUP BY pair), "
    f"u AS (SELECT *, CASE WHEN n >= 30 AND n_other > 1 THEN (m1 - m0) / nullif(sqrt(((n - 1) * v1 + (n_other - 1) * v0) / (n + n_other - 2) * (1e0 / n + 1e0 / n_other)), 0) END AS t0 FROM s), q AS (SELECT *, CASE WHEN t0 IS NOT NULL THEN {t_p('t0', 'n + n_other - 2')} END AS p FROM u) "
    f"SELECT pair, n, n_other, {r('m1 - m0', 'mean_return', 5)}, {r('sqrt(v1)', 'std_return', 5)}, {r('t0', 't_statistic', 4)}, {r('p', 'p_value', 5)}, {r('win', 'win_rate')}, coalesce(p < 0.05, false) AS is_significant FROM q"
)
SQL["par_07"] = (
    f"WITH {PAIRS}, o AS (SELECT pair, count(*) AS n, corr(ca, cb) AS rho, regr_slope(ca, cb) AS b FROM ab GROUP BY pair HAVING count(*) >= 100), s AS (SELECT ab.pair, t, ca - o.b * cb AS s, o.b, o.n, o.rho FROM ab JOIN o ON ab.pair = o.pair), d AS (SELECT pair, b, n, rho, s - lag(s) OVER (PARTITION BY pair ORDER BY t) AS ds, lag(s) OVER (PARTITION BY pair ORDER BY t) AS ps FROM s), "
    "l AS (SELECT pair, max(b) AS b, max(n) AS n, max(rho) AS rho, regr_slope(ds, ps) AS lam, avg(ds / nullif(ps, 0)) AS m, stddev_samp(ds / nullif(ps, 0)) AS sd FROM d GROUP BY pair), h AS (SELECT *, CASE WHEN lam < 0 THEN -ln(2) / lam END AS half FROM l) "
    f"SELECT pair, n, {r('rho', 'correlation')}, {r('b', 'hedge_ratio')}, {r('half', 'half_life')}, {r('coalesce(m / nullif(sd, 0) * sqrt(252), 0)', 'spread_sharpe', 4)}, coalesce(half > 5 AND half < 100, false) AS is_tradeable FROM h"
)
SQL["par_08"] = (
    f"WITH {PAIRS}, s AS (SELECT pair, t, ca - cb AS s FROM ab), z AS (SELECT pair, t, s, (s - avg(s) {_TEN}) / nullif(stddev_samp(s) {_TEN}, 0) AS z, count(s) {_TEN} AS c, lead(s, 10) OVER (PARTITION BY pair ORDER BY t) / nullif(s, 0) - 1 AS f FROM s), "
    f"g AS (SELECT pair, CASE WHEN z > 2 THEN -f WHEN z < -2 THEN f END AS v FROM z WHERE c = 20), a AS (SELECT pair, {ONE_SAMPLE} FROM g WHERE v IS NOT NULL GROUP BY pair HAVING count(v) >= 30), q AS (SELECT *, {t_p('t0', 'n - 1')} AS p FROM a) SELECT pair, {ONE_RESULT} FROM q"
)
#: Cross rates of the series, named by the first three letters of either side as currency pairs are.
CROSSES = "SELECT upper(concat(substr(a.symbol, 1, 3), substr(b.symbol, 1, 3))) AS symbol, a.t, a.close / nullif(b.close, 0) AS close FROM BARS a JOIN BARS b ON a.t = b.t AND a.symbol < b.symbol"


def _strength(source: str) -> str:
    """Strength of each currency at each time: the mean 20-bar return of its pairs, as base, or less that, as quote; null unless all its pairs have one."""
    return (
        f"x AS (SELECT symbol, t, close, close / nullif(lag(close, 20) {W}, 0) - 1 AS y, lead(close, 10) {W} / nullif(close, 0) - 1 AS f FROM ({source}) pairs_ WHERE length(symbol) >= 6), "
        "l AS (SELECT symbol, t, substr(symbol, 1, 3) AS ccy, y AS v FROM x UNION ALL SELECT symbol, t, substr(symbol, 4, 3) AS ccy, -y AS v FROM x), c AS (SELECT ccy, count(DISTINCT symbol) AS pairs FROM l GROUP BY ccy), "
        f"m AS (SELECT l.t, l.ccy, CASE WHEN count(v) = max(c.pairs) THEN {_r('avg(v)', 9)} END AS s FROM l JOIN c ON l.ccy = c.ccy GROUP BY l.t, l.ccy)"
    )


def strength_sql(source: str = CROSSES) -> str:
    return f"WITH {_strength(source)} SELECT t, ccy, {r('s', 'strength')} FROM m WHERE s IS NOT NULL"


def strongest_sql(source: str = CROSSES) -> str:
    """The strongest currency bought against the weakest, by the pair of the two, for ten bars: one test."""
    return (
        f"WITH {_strength(source)}, k AS (SELECT t, ccy, row_number() OVER (PARTITION BY t ORDER BY s DESC, ccy) AS hi, row_number() OVER (PARTITION BY t ORDER BY s, ccy) AS lo FROM m WHERE s IS NOT NULL), b AS (SELECT t, max(CASE WHEN hi = 1 THEN ccy END) AS strong, max(CASE WHEN lo = 1 THEN ccy END) AS weak FROM k GROUP BY t), "
        "g AS (SELECT b.t, CASE WHEN x.symbol = concat(strong, weak) THEN f ELSE -f END AS v FROM b JOIN x ON x.t = b.t AND (x.symbol = concat(strong, weak) OR x.symbol = concat(weak, strong))), "
        f"a AS (SELECT {ONE_SAMPLE} FROM g WHERE v IS NOT NULL HAVING count(v) >= 30), q AS (SELECT *, {t_p('t0', 'n - 1')} AS p FROM a) SELECT 'strongest_weakest' AS edge_key, {ONE_RESULT} FROM q"
    )


SQL["par_09"], SQL["par_10"] = strength_sql(), strongest_sql()

#: The last 252 returns.
_YEAR = "OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
# How steady a series is: Sharpe ratio and win rate of every full window of 252 returns, and its calendar years. Series with fewer returns have no row.
SQL["met_03_stability"] = (
    f"WITH {RETURNS}, w AS (SELECT symbol, row_number() {W} AS rn, coalesce(avg(y) {_YEAR} / nullif(stddev_samp(y) {_YEAR}, 0) * sqrt(252), 0) AS s, avg(CASE WHEN y > 0 THEN 1e0 ELSE 0e0 END) {_YEAR} AS wins FROM x), "
    "a AS (SELECT symbol, count(*) AS windows, avg(s) AS s_mean, stddev_samp(s) AS s_std, min(s) AS s_min, avg(wins) AS w_mean FROM w WHERE rn >= 252 GROUP BY symbol), "
    "y AS (SELECT symbol, extract(year FROM d) AS yr, sum(y) AS v FROM x GROUP BY symbol, extract(year FROM d)), b AS (SELECT symbol, stddev_samp(v) AS v_std, count(CASE WHEN v > 0 THEN 1 END) AS up, count(CASE WHEN v < 0 THEN 1 END) AS down, max(v) AS best, min(v) AS worst FROM y GROUP BY symbol) "
    f"SELECT a.symbol, windows, {r('s_mean', 'rolling_sharpe_mean', 5)}, {r('s_std', 'rolling_sharpe_std', 5)}, {r('s_min', 'rolling_sharpe_min', 5)}, {r('w_mean', 'rolling_win_rate_mean')}, {r('v_std', 'yearly_return_std', 5)}, up AS positive_years, down AS negative_years, {r('best', 'best_year', 5)}, {r('worst', 'worst_year', 5)} FROM a JOIN b ON a.symbol = b.symbol"
)
# The 95 % interval of the mean return, of series with three returns or more.
SQL["sta_01_interval"] = (
    f"WITH {RETURNS}, s AS (SELECT symbol, count(y) AS n, avg(y) AS m, stddev_samp(y) / sqrt(count(y)) AS se FROM x GROUP BY symbol HAVING count(y) >= 3), u AS (SELECT *, se * {t_interval('n - 1')} AS reach FROM s) "
    f"SELECT symbol, n, {r('m', 'sample_mean')}, {r('m - reach', 'ci_lo')}, {r('m + reach', 'ci_hi')} FROM u"
)
# Spearman's correlation: a rank with ties averaged is the mean of the rank from below and that from above, so all windows are by pair.
_RANK = "(rank() OVER (PARTITION BY pair ORDER BY {0}) + count(*) OVER (PARTITION BY pair) + 1 - rank() OVER (PARTITION BY pair ORDER BY {0} DESC)) / 2e0"
SQL["sta_09_spearman"] = (
    f"WITH {PAIRS}, v AS (SELECT pair, {_r('ya', 9)} AS va, {_r('yb', 9)} AS vb FROM ab), k AS (SELECT pair, {_RANK.format('va')} AS ra, {_RANK.format('vb')} AS rb FROM v), q AS (SELECT pair, count(*) AS n, corr(ra, rb) AS rho FROM k GROUP BY pair HAVING count(*) > 2), "
    f"u AS (SELECT *, rho * sqrt((n - 2) / nullif(1 - rho * rho, 0)) AS t0 FROM q) SELECT pair, n, {r('rho', 'statistic')}, {r('CASE WHEN abs(rho) >= 1 THEN 0e0 ELSE ' + t_p('t0', 'n - 2') + ' END', 'p_value', 5)} FROM u"
)
# Size of an effect in words, of the mean against its spread and of the difference of two groups.
_SIZE = "CASE WHEN abs(effect_size) < 0.2 THEN 'negligible' WHEN abs(effect_size) < 0.5 THEN 'small' WHEN abs(effect_size) < 0.8 THEN 'medium' WHEN abs(effect_size) >= 0.8 THEN 'large' END AS effect"
SQL["sta_13_effects"] = " UNION ALL ".join(f"SELECT symbol, '{test}' AS test, effect_size, {_SIZE} FROM ({SQL[name]}) {name}_" for name, test in (("sta_01", "one_sample"), ("sta_02", "two_sample")))
SQL["rpt_06_session"] = (
    f"WITH {RETURNS} SELECT symbol, CASE WHEN t % 24 < 8 THEN 'asian' WHEN t % 24 < 16 THEN 'london' WHEN t % 24 < 21 THEN 'ny' ELSE 'other' END AS session, count(*) AS n, {r('avg(y)', 'mean_return')} FROM x "
    "GROUP BY symbol, CASE WHEN t % 24 < 8 THEN 'asian' WHEN t % 24 < 16 THEN 'london' WHEN t % 24 < 21 THEN 'ny' ELSE 'other' END"
)
