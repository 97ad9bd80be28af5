"""Engle-Granger cointegration of pairs of series, with an augmented Dickey-Fuller test of the residuals.

The residuals of the levels' regression are differenced; for each pair one Gram matrix of the difference, the level before it and the lagged
differences is summed from the matrices of Arrow batches. Regressions with 0, 1, 2 ... lagged differences are leading blocks of that matrix, so the
number of lags is chosen by AIC, over one sample, without reading a row again; the rows that only shorter lags can use come from the head of the series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The published response surface of the distribution of the statistic for two series and a constant: bounds, the point where the
#: two polynomials meet, and their coefficients, of the powers 0, 1, 2 (and 3).
TAU_MIN, TAU_STAR, TAU_MAX = -18.86, -2.62, 0.92
SMALL, LARGE = (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)
LEAST = 30


def p_value(tau: float) -> float:
    """Chance of a smaller statistic if the two series aren't cointegrated."""
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    z = sum(c * tau**k for k, c in enumerate(SMALL if tau <= TAU_STAR else LARGE))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _max_lags() -> str:
    """Lags that are tried on ``n`` residuals."""
    return "CAST(least(ceil(12 * pow(n / 100, 0.25)), n div 2 - 1) AS INT)"


def _gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each pair in a batch the Gram matrix of (difference, level before, lagged differences)."""
    for batch in batches:
        out = []
        for pair, own in batch.groupby("pair", sort=False):
            lags = int(own["most"].iloc[0])
            d = np.stack([np.asarray(x)[-(lags + 1) :] for x in own["d"]])[:, ::-1]
            z = np.column_stack([d[:, 0], own["before"].to_numpy(float), d[:, 1:]])
            out.append((pair, (z.T @ z).ravel().tolist(), len(z)))
        yield pd.DataFrame(out, columns=["pair", "gram", "rows"])


def _solve(gram: np.ndarray, lags: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Residual sum of squares, coefficients and inverse of the regression on the level and ``lags`` differences."""
    inverse = np.linalg.pinv(gram[1 : lags + 2, 1 : lags + 2], hermitian=True)
    b = inverse @ gram[1 : lags + 2, 0]
    return max(float(gram[0, 0] - b @ gram[1 : lags + 2, 0]), 0.0), b, inverse


def _test(parts: pd.DataFrame) -> pd.DataFrame:
    """Statistic, p-value and lags of a pair from its matrices and the head of its residuals."""
    first = parts.iloc[0]
    most, rows = int(first["most"]), int(parts["rows"].sum())
    gram = np.sum([np.asarray(g) for g in parts["gram"]], axis=0).reshape(most + 2, most + 2)
    aic = []
    for k in range(most + 1):
        ssr = _solve(gram, k)[0]
        aic.append(rows * (math.log(2 * math.pi) + math.log(max(ssr, 1e-300) / rows) + 1) + 2 * (k + 1))
    lags = int(np.argmin(aic))
    full = gram[: lags + 2, : lags + 2].copy()
    head = np.asarray(first["head"], float)
    d = np.diff(head)
    for t in range(lags, most):
        row = np.array([d[t], head[t], *d[t - lags : t][::-1]])
        full += np.outer(row, row)
    rows += most - lags
    ssr, b, inverse = _solve(full, lags)
    error = math.sqrt(ssr / (rows - lags - 1) * inverse[0, 0])
    tau = b[0] / error if error > 0 else float("nan")
    return pd.DataFrame([(first["pair"], int(first["n"]), tau, p_value(tau) if tau == tau else None, lags)], columns=["pair", "n", "adf_statistic", "p_value", "lags"])


def engle_granger(pairs: DataFrame) -> DataFrame:
    """``pairs``: pair, t, ca, cb, one row for each time that both series have. One row for each pair with 30 rows or more: ``n``, ``adf_statistic``,
    ``p_value``, ``lags`` and ``cointegrated`` (p under 0.05). A pair whose residuals vanish has no statistic and no row.
    """
    by_pair = Window.partitionBy("pair").orderBy("t")
    fit = pairs.groupBy("pair").agg(F.count("*").alias("n"), F.expr("regr_slope(ca, cb)").alias("b"), F.expr("regr_intercept(ca, cb)").alias("a"), F.expr("regr_r2(ca, cb)").alias("r2"))
    fit = fit.filter((F.col("n") >= LEAST) & (F.coalesce("r2", F.lit(0.0)) < 1 - 1.5e-6)).withColumn("most", F.expr(_max_lags()))
    bound = fit.agg(F.max("most")).first()[0] or 0
    rest = pairs.join(fit, "pair").select("pair", "t", "n", "most", (F.col("ca") - F.col("a") - F.col("b") * F.col("cb")).alias("e"))
    rest = rest.withColumns({"before": F.lag("e").over(by_pair), "i": F.row_number().over(by_pair)}).withColumn("d0", F.col("e") - F.col("before"))
    rest = rest.withColumn("d", F.collect_list("d0").over(by_pair.rowsBetween(-bound, 0)))
    grams = rest.filter("size(d) > most").select("pair", "most", "before", "d").mapInPandas(_gram, "pair string, gram array<double>, rows long")
    heads = rest.filter("i <= most + 1").groupBy("pair", "n", "most").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "e"))), lambda x: x["e"]).alias("head"))
    out = grams.join(heads, "pair").groupBy("pair").applyInPandas(_test, "pair string, n long, adf_statistic double, p_value double, lags int")
    return out.filter("adf_statistic IS NOT NULL").withColumn("cointegrated", (F.col("p_value") < 0.05).cast("int"))


def cointegrated(pairs: DataFrame, figures: DataFrame, threshold: float = 0.05) -> DataFrame:
    """``figures`` (pair and what is known of it) of the pairs whose p-value is under ``threshold``, the most certain first, with statistic, p-value and lags."""
    found = engle_granger(pairs).filter(F.col("p_value") < threshold).drop("n", "cointegrated")
    return figures.join(found, "pair").orderBy("p_value", "adf_statistic", "pair")


__all__ = ["cointegrated", "engle_granger", "p_value"]
