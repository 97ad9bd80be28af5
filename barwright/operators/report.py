"""Sinks: reports of aggregated rows as JSON, CSV and HTML."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.operators.edges import type_sql


def summary(edges: DataFrame) -> DataFrame:
    """Tests and significant tests by type of edge."""
    return edges.groupBy(F.expr(type_sql()).alias("edge_type")).agg(F.count("*").alias("total"), F.sum(F.col("is_significant").cast("long")).alias("significant"))


def significant(edges: DataFrame, least: int = 100, alpha: float = 0.05, win_rate: float = 0.45) -> DataFrame:
    return edges.filter((F.col("n") >= least) & (F.col("p_value") <= alpha) & (F.col("win_rate") >= win_rate))


def top_edges(edges: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` significant tests of the highest Sharpe ratios."""
    return edges.filter("is_significant").orderBy(F.desc("sharpe_ratio"), "symbol", "edge_key").limit(k)


def matrix(edges: DataFrame) -> DataFrame:
    """One row for each symbol and timeframe: tests, significant ones, and the best significant test by Sharpe ratio. ``edges``: results with symbol and timeframe."""
    best = F.max_by(F.struct("edge_key", "sharpe_ratio", "win_rate", "p_value", "n"), F.when(F.col("is_significant"), F.struct("sharpe_ratio", "edge_key")))
    out = edges.groupBy("symbol", "timeframe").agg(F.count("*").alias("total_edges"), F.sum(F.col("is_significant").cast("long")).alias("significant_edges"), best.alias("best"))
    found = F.col("significant_edges") > 0
    return out.select(
        "symbol", "timeframe", "total_edges", "significant_edges", F.when(found, F.col("best.edge_key")).otherwise("None").alias("top_edge"), F.when(found, F.expr(type_sql("best.edge_key"))).otherwise("-").alias("top_edge_type"),
        *(F.when(found, F.col(f"best.{c}")).otherwise(F.lit(d)).alias(c) for c, d in (("sharpe_ratio", 0.0), ("win_rate", 0.0), ("p_value", 1.0))), F.when(found, F.col("best.n")).otherwise(0).cast("long").alias("sample_size"),
    )


def pivot(rows: DataFrame, timeframes: list[str]) -> DataFrame:
    """Significant tests by symbol and timeframe, a column for each timeframe."""
    return rows.groupBy("symbol").pivot("timeframe", timeframes).agg(F.first("significant_edges"))


def overview(rows: DataFrame) -> DataFrame:
    """What a :func:`matrix` comes to, one row for each timeframe, each symbol, and each type that is the best of some series: view, name, series, mean of significant tests, Sharpe ratio and win rate.

    Types count only series with a significant test. One aggregation makes all three views.
    """
    views = F.array(*(F.struct(F.lit(view).alias("view"), F.col(column).alias("name")) for view, column in (("timeframe", "timeframe"), ("symbol", "symbol"), ("edge_type", "top_edge_type"))))
    named = rows.withColumn("_view", F.explode(views)).filter("_view.view <> 'edge_type' OR significant_edges > 0")
    mean = lambda c: F.expr(f"floor(avg({c}) * 1e4 + 0.5e0) / 1e4")
    return named.groupBy("_view.view", "_view.name").agg(
        F.count("*").alias("series"), mean("significant_edges").alias("avg_significant"), mean("sharpe_ratio").alias("avg_sharpe"), mean("win_rate").alias("avg_win_rate")
    )


def best_series(rows: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` rows of a :func:`matrix` with the highest Sharpe ratios."""
    return rows.orderBy(F.desc("sharpe_ratio"), "symbol", "timeframe").limit(k)


def data_summary(bars: DataFrame) -> DataFrame:
    """Of each symbol: bars, first and last time, lowest and highest price, mean volume."""
    return bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.min("low").alias("lowest"), F.max("high").alias("highest"), F.avg("volume").alias("mean_volume"))


def as_json(edges: DataFrame) -> DataFrame:
    return edges.select("symbol", "edge_key", F.to_json(F.struct(*[c for c in edges.columns if c not in ("symbol", "edge_key")])).alias("payload"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def nested(edges: DataFrame, k: int = 10) -> DataFrame:
    """The whole report as one row: counts, counts by type, the top ``k``. Results stay a table of their own, which grows with the series (:func:`write_report`)."""
    totals = edges.agg(F.count("*").alias("total_edges"), F.sum(F.col("is_significant").cast("long")).alias("significant_edges"))
    families = summary(edges).agg(F.sort_array(F.collect_list(F.struct("edge_type", "total", "significant"))).alias("types"))
    fields = [c for c in ("sharpe_ratio", "symbol", "edge_key", "n", "win_rate", "p_value", "is_significant") if c in edges.columns]
    best = top_edges(edges, k).agg(F.sort_array(F.collect_list(F.struct(*fields)), asc=False).alias("top"))
    return totals.join(families).join(best)


def write_report(edges: DataFrame, path: str, k: int = 10) -> None:
    """The nested report under ``path/report``, one line of JSON, and every result under ``path/results``, written by the executors."""
    nested(edges, k).coalesce(1).write.mode("overwrite").json(f"{path}/report")
    edges.write.mode("overwrite").json(f"{path}/results")


def to_html(edges: DataFrame, title: str = "Edge report", k: int = 20, bars: DataFrame | None = None) -> str:
    """Header, summary of the ``bars`` if given (a row for each symbol), types, and the table of the top ``k``."""

    def table(heading: str, df: DataFrame) -> str:
        cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values) + "</tr>"
        return f"<h2>{heading}</h2><table>{cells('th', df.columns)}{''.join(cells('td', row) for row in df.collect())}</table>"

    parts = [table("Data", data_summary(bars).orderBy("symbol"))] if bars is not None else []
    parts += [table("Types", summary(edges).orderBy("edge_type")), table("Top edges", top_edges(edges, k))]
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{''.join(parts)}</body></html>"
