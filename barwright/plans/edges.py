"""Queries of the edge catalogue, for each symbol of the hourly bars; the hour-of-day edge pools the symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions.dsl import dialect
from barwright.operators import edges
from barwright.operators.analytics import SQL
from barwright.plans.analytics import run
from barwright.plans.registry import query
from barwright.sources.bars import BARS_D1, BARS_H1, bars_d1, bars_h1, kept

DAILY = {"tim_02", "tim_04"}

for _name, (_levels, _edges) in edges.SIGNED.items():
    _bars, _sql = (bars_d1, BARS_D1) if _name in DAILY else (bars_h1, BARS_H1)
    query(_name, edges.signed_sql(_levels, _edges, _sql))(lambda spark, sf_dir, a=_levels, b=_edges, bars=_bars: edges.signed_spark(a, b, bars(spark, sf_dir)))
for _name, (_levels, _edges) in edges.CONTRASTS.items():
    query(_name, edges.contrast_sql(_levels, _edges, BARS_H1))(lambda spark, sf_dir, a=_levels, b=_edges: edges.contrast_spark(a, b, bars_h1(spark, sf_dir)))



def _pooled(df: DataFrame) -> DataFrame:
    """Returns by symbol, then all symbols as one."""
    return edges.Plan(edges.CALENDAR).spark(df).select(F.lit("ALL").alias("symbol"), "t", "hour", "r1")


_inner = edges.Plan(edges.CALENDAR, {"hour": None, "r1": None}).sql(BARS_H1)


@query("tim_01", edges.signed_sql([{"one": "1"}], edges.HOURS, f"SELECT 'ALL' AS symbol, t, hour, r1 FROM ({_inner})"))
def tim_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.signed_spark([], edges.HOURS, _pooled(bars_h1(spark, sf_dir)))


def detect(bars: DataFrame, families: tuple[str, ...] = tuple(edges.FAMILIES)) -> DataFrame:
    """Every test of the families over series of bars (symbol, t, open, high, low, close, volume), one row for each series and test with 30 values or more.

    All signed tests are cells of one plan over one exchange of the bars, all contrasts of another.
    """
    signed, contrasts, extra = [sum(x, []) for x in zip(*(edges.catalogue(f) for f in families), strict=True)]
    if bool(signed) + bool(contrasts) + len(extra) > 1:
        bars = kept(bars, "series")
    parts = [edges.signed_spark(*edges.merged(signed), bars)] if signed else []
    if contrasts:
        parts.append(edges.contrast_spark(*edges.merged(contrasts), bars).selectExpr(*edges.CONTRAST_RESULT))
    parts += [run(bars.sparkSession, SQL[name], bars).selectExpr(*edges.EXTRA[name]) for name in extra]
    return reduce(DataFrame.unionByName, (p.select(*edges.RESULT) for p in parts))


def detect_sql(base: str, families: tuple[str, ...] = tuple(edges.FAMILIES)) -> str:
    """The same in DuckDB, test by test."""
    parts = []
    for family in families:
        signed, contrasts, extra = edges.catalogue(family)
        parts += [f"SELECT {', '.join(edges.RESULT)} FROM ({edges.signed_sql(a, b, 'SELECT * FROM bars_')})" for a, b in signed]
        parts += [f"SELECT {', '.join(edges.CONTRAST_RESULT)} FROM ({edges.contrast_sql(a, b, 'SELECT * FROM bars_')})" for a, b in contrasts]
        parts += [f"SELECT {', '.join(edges.EXTRA[name])} FROM ({dialect(SQL[name], False).replace('BARS', 'bars_')})" for name in extra]
    return f"WITH bars_ AS MATERIALIZED ({base}) " + " UNION ALL ".join(parts)


for _name in edges.FAMILIES:
    query(_name, detect_sql(BARS_H1, (_name,)))(lambda spark, sf_dir, name=_name: detect(bars_h1(spark, sf_dir), (name,)))
query("eng_03", detect_sql(BARS_H1))(lambda spark, sf_dir: detect(bars_h1(spark, sf_dir)))
