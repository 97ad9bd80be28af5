"""Tail probabilities without SciPy: Student t, chi-squared, normal, binomial, F."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 1000):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + up * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + up / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * value


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return math.nan
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if not math.isinf(t) else 0.0


def chi2_sf(x: float, df: float) -> float:
    return math.nan if x is None or math.isnan(x) else gamma_q(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def binomial_sf(k: int, n: int, p: float) -> float:
    """Chance of ``k`` or more successes."""
    return 1.0 if k <= 0 else beta_inc(k, n - k + 1, p)


def f_sf(x: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t, by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) / 2 > 1 - p else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def _t(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) for a, b in zip(t.astype(float), df.astype(float), strict=True)])


@F.pandas_udf(DoubleType())
def _t_interval(df: pd.Series) -> pd.Series:
    """How many standard errors a 95 % interval of a mean reaches to either side."""
    at = lru_cache(maxsize=4096)(lambda n: t_quantile(0.975, n) if n > 0 else math.nan)
    return pd.Series([at(n) for n in df.astype(float)])


@F.pandas_udf(DoubleType())
def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(a, b) for a, b in zip(x.astype(float), df.astype(float), strict=True)])


@F.pandas_udf(DoubleType())
def _normal(z: pd.Series) -> pd.Series:
    return pd.Series([normal_two_sided(a) for a in z.astype(float)])


def _sum_counts(terms: list[int], divisors: list[int]) -> list[int]:
    """Coefficients of the product of (1 - x**a) over that of (1 - x**b): how many arrangements have each sum."""
    size = sum(terms) - sum(divisors) + 1
    out = [1] + [0] * (size - 1)
    for a in terms:
        for k in range(size - 1, a - 1, -1):
            out[k] -= out[k - a]
    for b in divisors:
        for k in range(b, size):
            out[k] += out[k - b]
    return out


@lru_cache(maxsize=256)
def _u_counts(n1: int, n2: int) -> tuple[int, ...]:
    return tuple(_sum_counts([n2 + i for i in range(1, n1 + 1)], list(range(1, n1 + 1))))


@lru_cache(maxsize=256)
def _w_counts(n: int) -> tuple[int, ...]:
    out = [1] + [0] * (n * (n + 1) // 2)
    for i in range(1, n + 1):
        for k in range(len(out) - 1, i - 1, -1):
            out[k] += out[k - i]
    return tuple(out)


def _two_sided(counts: tuple[int, ...], at: float) -> float:
    low = math.floor(min(at, len(counts) - 1 - at) + 1e-9)
    return min(1.0, 2 * sum(counts[: low + 1]) / sum(counts))


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided chance of a U as far from its mean, of samples without ties."""
    return _two_sided(_u_counts(int(n1), int(n2)), u)


def wilcoxon_exact(w: float, n: int) -> float:
    """Two-sided chance of a signed-rank sum as far from its mean, of differences without ties or zeros."""
    return _two_sided(_w_counts(int(n)), w)


#: Samples up to these sizes, without ties, have exact chances; larger ones the normal tail.
EXACT_U, EXACT_W = 25, 50


@F.pandas_udf(DoubleType())
def _u_p(u: pd.Series, n1: pd.Series, n2: pd.Series, tie: pd.Series, z: pd.Series) -> pd.Series:
    return pd.Series([mann_whitney_exact(a, b, c) if t == 0 and 0 < b <= EXACT_U and 0 < c <= EXACT_U else normal_two_sided(d) for a, b, c, t, d in zip(*(x.astype(float) for x in (u, n1, n2, tie, z)), strict=True)])


@F.pandas_udf(DoubleType())
def _w_p(w: pd.Series, n: pd.Series, tie: pd.Series, z: pd.Series) -> pd.Series:
    return pd.Series([wilcoxon_exact(a, b) if t == 0 and 0 < b <= EXACT_W else normal_two_sided(d) for a, b, t, d in zip(*(x.astype(float) for x in (w, n, tie, z)), strict=True)])


def t_p(t: Column, df: Column) -> Column:
    return F.nanvl(_t(t, df.cast("double")), F.lit(None).cast("double"))


def chi2_p(x: Column, df: Column) -> Column:
    return F.nanvl(_chi2(x, df.cast("double")), F.lit(None).cast("double"))


def normal_p(z: Column) -> Column:
    return F.nanvl(_normal(z), F.lit(None).cast("double"))


def t_p_sql(t: str, df: str) -> str:
    """Two-sided Student t probability as DuckDB SQL: Simpson's rule over the density."""
    area = f"list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(abs({t}) * i / 4000, 2) / ({df}), -(({df}) + 1) / 2e0)))"
    return f"greatest(1 - 2 * ({area}) * abs({t}) / 12000 * exp(lgamma((({df}) + 1) / 2e0) - lgamma(({df}) / 2e0)) / sqrt(({df}) * pi()), 0)"


def normal_p_sql(z: str) -> str:
    area = f"list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(abs({z}) * i / 4000, 2) / 2)))"
    return f"greatest(1 - 2 * ({area}) * abs({z}) / 12000 / sqrt(2 * pi()), 0)"


def chi2_p_sql(x: str, df: int) -> str:
    """For one or an even number of degrees of freedom."""
    if df == 1:
        return normal_p_sql(f"sqrt({x})")
    return f"exp(-({x}) / 2) * ({' + '.join(f'pow(({x}) / 2, {k}) / {math.factorial(k)}' for k in range(df // 2))})"


def t_interval_sql(df: str) -> str:
    """DuckDB form of :func:`_t_interval`: the expansion of Student's quantile about the normal one, to the fourth order, for more than some thirty degrees of freedom."""
    z = 1.959963984540054
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    return f"({z!r}::DOUBLE" + "".join(f" + {c!r}::DOUBLE / pow({df}, {k})" for k, c in enumerate(terms, 1)) + ")"
