"""Queries of the analytics statements over hourly bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions import dist
from barwright.functions.dsl import dialect, rounded
from barwright.operators import bootstrap
from barwright.operators.analytics import CORRECTED_SQL, FAMILY, HALVES, PAIRS, PERMUTED_SQL, SQL, boot_sql
from barwright.operators.cointegration import cointegrated, engle_granger
from barwright.operators.corrections import corrected
from barwright.plans.registry import query
from barwright.sources.bars import BARS_H1, bars_h1


def run(spark: SparkSession, text: str, bars: DataFrame) -> DataFrame:
    """Run a statement over ``bars``; tail probabilities are vectorised functions over its few result rows."""
    for name, fn in (("t_p", dist._t), ("t_interval", dist._t_interval), ("chi2_p", dist._chi2), ("normal_p", dist._normal), ("u_p", dist._u_p), ("w_p", dist._w_p)):
        spark.udf.register(name, fn)
    return spark.sql(dialect(text, True).replace("BARS", "{bars}"), bars=bars)


for _name, _text in SQL.items():
    query(_name, dialect(_text, False).replace("BARS", f"({BARS_H1})"))(lambda spark, sf_dir, text=_text: run(spark, text, bars_h1(spark, sf_dir)))


def _pairs(spark: SparkSession, bars: DataFrame) -> DataFrame:
    return run(spark, f"WITH {PAIRS} SELECT pair, t, ca, cb FROM ab", bars)


@query("par_04")
def par_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engle-Granger test of every pair of symbols; SQL has no regression on many lags."""
    return engle_granger(_pairs(spark, bars_h1(spark, sf_dir)))


@query("par_07_cointegrated")
def par_07_cointegrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cointegrated pairs with hedge ratio, half-life, the spread's Sharpe ratio, and whether it can be traded."""
    bars = bars_h1(spark, sf_dir)
    return cointegrated(_pairs(spark, bars), run(spark, SQL["par_07"], bars))


def _returns(spark: SparkSession, bars: DataFrame) -> DataFrame:
    """The returns of each symbol, numbered, as values to resample."""
    return run(spark, f"WITH {HALVES} SELECT symbol AS key, rn, y FROM h", bars)


def resampled(bars: DataFrame, statistic: str, least: int = 10) -> DataFrame:
    """A statistic of each symbol's returns with the interval of its replicates."""
    out = bootstrap.intervals(bootstrap.replicate_sums(_returns(bars.sparkSession, bars)), statistic, least)
    figures = ("observed_value", "bootstrap_mean", "bootstrap_std", "ci_lo", "ci_hi", "p_value")
    return out.selectExpr("key AS symbol", f"'{statistic}' AS statistic_name", "n_bootstrap", *[f"{rounded(c)} AS {c}" for c in figures])


def shuffled(bars: DataFrame) -> DataFrame:
    """Returns of every second bar against the others: differences of means and medians beside those of random halves."""
    made = bootstrap.permuted(_returns(bars.sparkSession, bars))
    seen = made.filter("b = -1").select("key", F.col("mean").alias("observed"), F.col("median").alias("observed_median"))
    at_least = lambda c, o: F.avg((F.abs(c) >= F.abs(o)).cast("double"))
    out = made.filter("b >= 0").join(seen, "key").groupBy("key").agg(
        F.count("*").alias("n_permutations"), F.max("observed").alias("observed"), F.avg("mean").alias("permutation_mean"), F.stddev_pop("mean").alias("permutation_std"), F.expr("percentile(mean, 0.025)").alias("ci_lo"),
        F.expr("percentile(mean, 0.975)").alias("ci_hi"), at_least("mean", "observed").alias("p_value"), F.max("observed_median").alias("observed_median"), at_least("median", "observed_median").alias("median_p_value"),
    )
    return out.selectExpr("key AS symbol", "n_permutations", *[f"{rounded(c)} AS {c}" for c in out.columns if c not in ("key", "n_permutations")])


#: Statistic, its DuckDB form, and the fewest returns.
_BOOTSTRAPS = {
    "boo_01": ("mean", "avg(y)", 10), "boo_02": ("sharpe", "avg(y) / nullif(stddev_pop(y), 0) * sqrt(252)", 30), "boo_03": ("win_rate_over_half", "avg(CASE WHEN y > 0 THEN 1e0 ELSE 0e0 END) - 0.5", 10), "boo_06": ("mean_over_target", "avg(y) - 0.001", 10),
}
for _name, (_statistic, _form, _least) in _BOOTSTRAPS.items():
    query(_name, dialect(boot_sql(_form, _statistic, _least), False).replace("BARS", f"({BARS_H1})"))(lambda spark, sf_dir, statistic=_statistic, least=_least: resampled(bars_h1(spark, sf_dir), statistic, least))
query("boo_05", dialect(PERMUTED_SQL, False).replace("BARS", f"({BARS_H1})"))(lambda spark, sf_dir: shuffled(bars_h1(spark, sf_dir)))


#: The t-tests of each symbol and hour as one family.
for _name, _method in (("sta_10", "bonferroni"), ("sta_11", "holm"), ("sta_12", "benjamini_hochberg")):
    query(_name, dialect(CORRECTED_SQL[_name], False).replace("BARS", f"({BARS_H1})"))(
        lambda spark, sf_dir, method=_method: corrected(run(spark, f"WITH {FAMILY} SELECT symbol, hour, p FROM p", bars_h1(spark, sf_dir)), ["symbol", "hour"]).selectExpr("symbol", "hour", f"{rounded('p', 5)} AS p_value", f"{rounded(method, 5)} AS adjusted")
    )
