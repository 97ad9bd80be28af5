"""Validation of edges on their own signed returns: bootstrap intervals and walk-forward folds, both keyed by series and edge."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.config import Validation
from barwright.operators import bootstrap, edges
from barwright.sources.bars import shared

KEY = ["symbol", "edge_key"]
METRICS = ("mean", "sharpe", "win")


def returns(bars: DataFrame, families: tuple[str, ...] = tuple(edges.FAMILIES)) -> DataFrame:
    """Every signed return of every signed test of the families: symbol, edge_key, scale, place (the bar's number in its series, from 1), side, r."""
    placed = bars.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy("t")))
    signed = sum((edges.catalogue(f)[0] for f in families), [])
    return edges.signed_cells(*edges.merged(signed), placed, ["place"])


def _metric(role: str, name: str) -> Column:
    """A figure of the rows of one side of a fold; 0 where it has none."""
    r = F.when(F.col("role") == role, F.col("r"))
    value = {"mean": F.avg(r), "sharpe": F.try_divide(F.avg(r), F.stddev_samp(r)) * F.max("scale"), "win": F.avg(F.when(F.col("role") == role, (F.col("r") > 0).cast("double")))}[name]
    return F.coalesce(value, F.lit(0.0)).alias(f"{role}_{name}")


def in_folds(cells: DataFrame, lengths: DataFrame, settings: Validation = Validation()) -> DataFrame:
    """Every return once for each fold that its bar lies in, with ``fold`` and ``role`` (train or test): only folds that end within the series. ``lengths``: symbol, bars."""
    train, test, step = settings.train_bars, settings.test_bars, settings.step_bars
    first, last = f"greatest(ceil((place - {train + test}) / {step}), 0)", f"least((place - 1) div {step}, (bars - {train + test}) div {step})"
    placed = cells.join(lengths.filter(F.col("bars") >= train + test), "symbol").withColumns({"first": F.expr(first).cast("long"), "last": F.expr(last).cast("long")})
    placed = placed.filter("first <= last").withColumn("fold", F.explode(F.sequence("first", "last"))).drop("first", "last", "bars")
    return placed.withColumn("role", F.when(F.col("place") <= F.col("fold") * step + train, "train").otherwise("test"))


def per_fold(folded: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], dict[str, float]], names: list[str]) -> DataFrame:
    """A function of the caller on each fold's train and test rows (``place``, ``r``), as grouped Arrow batches: one row of ``names`` for each series, edge and fold."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "side"])
        found = fn(rows[rows.role == "train"], rows[rows.role == "test"])
        return pd.DataFrame([(*key, *(float(found[c]) for c in names))], columns=[*KEY, "fold", *names])

    return folded.select(*KEY, "fold", "place", "side", "role", "r").groupBy(*KEY, "fold").applyInPandas(run, "symbol string, edge_key string, fold long, " + ", ".join(f"{c} double" for c in names))


def folds(cells: DataFrame, lengths: DataFrame, settings: Validation = Validation()) -> DataFrame:
    """Train and test figures of each series, edge and fold: rows, mean, Sharpe ratio, win rate."""
    sizes = [F.count(F.when(F.col("role") == role, 1)).alias(f"{role}_n") for role in ("train", "test")]
    return in_folds(cells, lengths, settings).groupBy(*KEY, "fold").agg(*sizes, *[_metric(role, m) for role in ("train", "test") for m in METRICS])


def walk_forward(figures: DataFrame, lengths: DataFrame, settings: Validation = Validation(), threshold: float = 0.5) -> DataFrame:
    """Summary over all complete folds of a series (those without a return of the edge count as 0), with warnings of overfitting."""
    span, step = settings.train_bars + settings.test_bars, settings.step_bars
    count = lengths.filter(F.col("bars") >= span).select("symbol", F.expr(f"(bars - {span}) div {step} + 1").alias("n_folds"))
    sums = [F.sum(f"{role}_{m}").alias(f"{role}_{m}") for role in ("train", "test") for m in METRICS]
    squares = [F.sum(F.pow(f"{role}_sharpe", F.lit(2))).alias(f"{role}_square") for role in ("train", "test")]
    out = figures.groupBy(*KEY).agg(*sums, *squares, F.count_if(F.col("test_sharpe") > 0).alias("positive_folds")).join(count, "symbol")
    mean = {f"{new}_{m}_mean": F.col(f"{role}_{old}") / F.col("n_folds") for new, role in (("is", "train"), ("oos", "test")) for m, old in (("sharpe", "sharpe"), ("return", "mean"), ("win_rate", "win"))}
    spread = {f"{new}_sharpe_std": F.sqrt(F.greatest(F.col(f"{role}_square") / F.col("n_folds") - F.pow(F.col(f"{role}_sharpe") / F.col("n_folds"), F.lit(2)), F.lit(0.0))) for new, role in (("is", "train"), ("oos", "test"))}
    out = out.withColumns(mean | spread)
    gone = F.col("is_sharpe_mean") - F.col("oos_sharpe_mean")
    out = out.withColumns(
        {
            "efficiency": F.coalesce(F.try_divide("oos_sharpe_mean", "is_sharpe_mean"), F.lit(0.0)), "degradation": gone, "degradation_pct": F.coalesce(F.try_divide(gone, "is_sharpe_mean"), F.lit(0.0)), "fold_consistency": F.col("positive_folds") / F.col("n_folds"),
        }
    )
    warnings = F.concat_ws(
        "; ",
        F.when(F.col("efficiency") < 0.3, "very low efficiency").when(F.col("efficiency") < 0.5, "low efficiency"),
        F.when(F.col("degradation_pct") > 0.7, "large degradation out of sample"),
        F.when(F.col("fold_consistency") < 0.5, "inconsistent across folds"),
    )
    names = [*mean, *spread, "efficiency", "degradation", "degradation_pct", "positive_folds", "fold_consistency"]
    return out.select(*KEY, "n_folds", *names, (F.col("efficiency") < threshold).alias("is_overfitted"), warnings.alias("warnings"))


def validate(bars: DataFrame, families: tuple[str, ...] = tuple(edges.FAMILIES), settings: Validation = Validation()) -> DataFrame:
    """Every significant signed edge with the bootstrap of its mean return and its walk-forward summary (null for a series shorter than a fold)."""
    path = shared(bars.sparkSession, "edge-returns")
    returns(bars, families).write.parquet(path)
    cells = bars.sparkSession.read.parquet(path)
    found = edges.signed_results(cells).filter("is_significant")
    kept = cells.join(found.select(*KEY), KEY, "left_semi")
    values = kept.select(F.concat_ws("|", *KEY).alias("key"), F.col("r").alias("y"), F.row_number().over(Window.partitionBy(*KEY).orderBy("place", "side")).alias("rn"))
    spread = bootstrap.intervals(bootstrap.replicate_sums(values, settings.bootstrap), "mean").drop("observed_value")
    lengths = bars.groupBy("symbol").agg(F.count("*").alias("bars"))
    summary = walk_forward(folds(kept, lengths, settings), lengths, settings)
    out = found.withColumn("key", F.concat_ws("|", *KEY)).join(spread.withColumnRenamed("p_value", "bootstrap_p"), "key").drop("key")
    return out.join(summary, KEY, "left")


__all__ = ["folds", "in_folds", "per_fold", "returns", "validate", "walk_forward"]
