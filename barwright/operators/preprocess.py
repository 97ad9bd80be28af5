"""Checking, cleaning and enriching of bars: the steps before any analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions.dsl import Plan
from barwright.operators.features import PLANS
from barwright.sources.bars import SESSIONS

PRICES = ("open", "high", "low", "close")
#: Feature plans of each step.
STEPS = {"time": ("pre_03", "pre_04", "pre_05", "pre_06", "pre_07"), "price": ("pre_08",), "returns": ("pre_09",), "volatility": ("pre_10",)}


def issues(bars: DataFrame) -> DataFrame:
    """What is wrong with each symbol's bars, one row for each kind that is found: symbol, issue, rows.

    Kinds: ``missing_<price>``, ``high_too_low``, ``low_too_high``, ``not_positive``, ``duplicate_time``. Nothing comes back for clean bars.
    """
    tops, bottoms = F.greatest("open", "close"), F.least("open", "close")
    found: dict[str, Column] = {f"missing_{c}": F.col(c).isNull() for c in PRICES}
    found |= {"high_too_low": F.col("high") < tops, "low_too_high": F.col("low") > bottoms, "not_positive": F.least(*PRICES) <= 0}
    # One row for each time first, so that a time's repetitions are counted without a window.
    times = bars.groupBy("symbol", "t").agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in found.items()))
    sums = times.groupBy("symbol").agg((F.sum("n") - F.count("*")).alias("duplicate_time"), *(F.sum(k).alias(k) for k in found))
    return sums.unpivot("symbol", [*found, "duplicate_time"], "issue", "rows").filter("rows > 0")


def clean(bars: DataFrame, first: str | None = None) -> DataFrame:
    """Bars in order: one for each time, high and low around open and close, gaps filled with the last value, rows that still lack one left out.

    Of several rows with one time the one with the least ``first`` stays, without it the least row, and the column ``first`` ends here. Any other column stays and is filled as well.
    """
    names = [c for c in bars.columns if c not in ("symbol", "t", first)]
    row = F.struct(*names)
    kept = bars.groupBy("symbol", "t").agg((F.min_by(row, F.struct(first, *names)) if first else F.min(row)).alias("row")).select("symbol", "t", "row.*")
    kept = kept.withColumns({"high": F.greatest(*(F.col(c) for c in ("high", "open", "close"))), "low": F.least(*(F.col(c) for c in ("low", "open", "close")))})
    filled = kept.select("symbol", "t", *(F.expr(f"last(`{c}`, true) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS `{c}`") for c in names))
    return filled.dropna()


def narrowed(bars: DataFrame, symbols: list[str] | None = None, start: float | None = None, end: float | None = None, session: str | None = None, weekdays: list[int] | None = None, least_volume: float | None = None) -> DataFrame:
    """Bars of some symbols, from ``start`` to ``end`` inclusive (hours since 1970), within a trading session, on some weekdays (0 is Monday), of at least some volume.

    What isn't given doesn't narrow. Every condition is a comparison of columns, so those on symbol, t and volume reach the files of a stored table. A null volume fails any least one.
    """
    t = F.col("t")
    if symbols is not None:
        bars = bars.filter(F.col("symbol").isin(symbols))
    if start is not None:
        bars = bars.filter(t >= start)
    if end is not None:
        bars = bars.filter(t <= end)
    if least_volume is not None:
        bars = bars.filter(F.col("volume") >= least_volume)
    if session is not None:
        opens, closes = SESSIONS[session]
        bars = bars.filter((F.pmod(t, F.lit(24)) >= opens) & (F.pmod(t, F.lit(24)) < closes))
    if weekdays is not None:
        bars = bars.filter(F.pmod(F.floor(t / 24) + 3, F.lit(7)).isin(weekdays))
    return bars


def plan(*steps: str) -> Plan:
    """The feature plans of some steps as one: what several define alike is computed once."""
    levels, out, known = [], {}, {}
    for name in (p for s in steps for p in STEPS[s]):
        for level in PLANS[name].levels:
            for column, spec in level.items():
                if repr(known.get(column, spec)) != repr(spec):
                    raise ValueError(f"{name} defines {column} otherwise than a step before")
            fresh = {c: spec for c, spec in level.items() if c not in known}
            known |= fresh
            if fresh:
                levels.append(fresh)
        out |= PLANS[name].out
    return Plan(levels, out)


def preprocess(bars: DataFrame, steps: tuple[str, ...] = tuple(STEPS), first: str | None = None) -> DataFrame:
    """Cleaned bars with the features of ``steps`` as one plan: one exchange by symbol and time, which leaves one bar for each time, and one by symbol."""
    return plan(*steps).spark(clean(bars, first))
