"""Feature plans: levels of SQL expressions over ordered bars, run by Spark and printable as DuckDB SQL.

A level is a dict of column -> expression over columns of earlier levels, so each level is one projection and windows of one specification share an
exchange and a sort. ``{{spark¦duckdb}}`` marks the few places where the dialects differ. Recursions (exponential averages, Wilder's average) run in
one Arrow kernel per level; their SQL form is a pair of scaled running sums. Rolling ranks and quantiles are kernels too, with one sorted window.
:meth:`Plan.long` runs a plan by chunks of rows instead of by whole series.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from barwright.functions import chunks

ORDER = "PARTITION BY symbol ORDER BY t"
RUNNING = f"OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
WHOLE = "OVER (PARTITION BY symbol)"


def last_n(n: int) -> str:
    return f"OVER ({ORDER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(fn: str, x: str, n: int) -> str:
    """``fn`` over the last ``n`` rows, null until there are ``n`` values."""
    return f"CASE WHEN count({x}) {last_n(n)} = {n} THEN {fn}({x}) {last_n(n)} END"


def quantile(x: str, q: float, n: int) -> str:
    return f"CASE WHEN count({x}) {last_n(n)} = {n} THEN {{{{percentile({x}, {q})¦quantile_cont({x}, {q})}}}} {last_n(n)} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({ORDER})"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) OVER ({ORDER})"


def running(fn: str, x: str) -> str:
    return f"{fn}({x}) {RUNNING}"


def fill(x: str) -> str:
    """The last value that isn't null."""
    return f"{{{{last({x}, true)¦last_value({x} IGNORE NULLS)}}}} {RUNNING}"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def flag(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 1 ELSE 0 END)"


def ln(x: str) -> str:
    return f"(CASE WHEN ({x}) > 0 THEN ln({x}) END)"


def root(x: str) -> str:
    return f"(CASE WHEN ({x}) >= 0 THEN sqrt({x}) END)"


def items(x: str, n: int) -> str:
    """The last ``n`` values as an array."""
    return f"{{{{collect_list({x})¦list({x}) FILTER (WHERE {x} IS NOT NULL)}}}} {last_n(n)}"


def rank_of(array: str, x: str, n: int) -> str:
    """Rank of ``x`` among the ``n`` values of ``array``, ties averaged, as a share."""
    less = f"{{{{size(filter({array}, v -> v < {x}))¦len(list_filter({array}, lambda v: v < {x}))}}}}"
    same = f"{{{{size(filter({array}, v -> v = {x}))¦len(list_filter({array}, lambda v: v = {x}))}}}}"
    return f"CASE WHEN {x} IS NOT NULL AND {{{{size({array})¦len({array})}}}} = {n} THEN ({less} + ({same} + 1) / 2e0) / {n} END"


def deviation(array: str, mean: str) -> str:
    """Mean absolute deviation of an array about ``mean``."""
    return f"{{{{aggregate(transform({array}, v -> abs(v - {mean})), 0D, (a, v) -> a + v) / size({array})¦list_sum(list_transform({array}, lambda v: abs(v - {mean}))) / len({array})}}}}"


@dataclass(frozen=True)
class Ewm:
    """Exponential average of ``source``, adjusted, with as many values as the span needed."""

    source: str
    span: int


@dataclass(frozen=True)
class Wilder:
    """Wilder's average of ``source``, seeded with the mean of the first ``n`` rows."""

    source: str
    n: int


@dataclass(frozen=True)
class Rank:
    """Rank of ``source`` among its last ``n`` values, ties averaged, as a share; null until there are ``n``."""

    source: str
    n: int

    @property
    def bounded(self) -> int:
        return self.n - 1


@dataclass(frozen=True)
class Quantile:
    """Quantile ``q`` of the last ``n`` values of ``source``, between neighbours in proportion; null until there are ``n``."""

    source: str
    q: float
    n: int

    @property
    def bounded(self) -> int:
        return self.n - 1


def dialect(text: str, spark: bool) -> str:
    return re.sub(r"\{\{(.*?)¦(.*?)\}\}", lambda m: m[1 if spark else 2], text, flags=re.S)


def _column(x: pd.Series, spec: Ewm | Wilder | Rank | Quantile) -> pd.Series:
    """One kernel over a series in order. Ranks and quantiles keep one sorted window, whatever the number of rows."""
    if isinstance(spec, Ewm):
        return x.ewm(span=spec.span, adjust=True, min_periods=spec.span).mean()
    if isinstance(spec, Rank):
        return x.rolling(spec.n, min_periods=spec.n).rank(method="average", pct=True)
    if isinstance(spec, Quantile):
        return x.rolling(spec.n, min_periods=spec.n).quantile(spec.q, interpolation="linear")
    return pd.Series(chunks._seeded(x.to_numpy(float), spec.n)).ewm(alpha=1 / spec.n, adjust=False).mean()


def _recurse(specs: dict[str, Ewm | Wilder | Rank | Quantile]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        for name, spec in specs.items():
            pdf[name] = _column(pdf[spec.source].astype(float), spec)
        return pdf

    return run


def _kernel(df: DataFrame, keys: list[str], specs: dict) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{k}` double" for k in specs)
    return df.groupBy(*keys).applyInPandas(_recurse(specs), schema)


def _nulls(df: DataFrame, names: dict) -> DataFrame:
    """NaN of these columns as null."""
    return df.selectExpr("*", *[f"nanvl(`{k}`, NULL) AS `{k}__`" for k in names]).drop(*names).withColumnsRenamed({f"{k}__": k for k in names})


@dataclass
class Plan:
    levels: list[dict] = field(default_factory=list)
    out: dict[str, int | None] = field(default_factory=dict)

    def spark(self, bars: DataFrame) -> DataFrame:
        df = bars
        for level in self.levels:
            recursive = {k: v for k, v in level.items() if not isinstance(v, str)}
            plain = [f"{dialect(v, True)} AS `{k}`" for k, v in level.items() if isinstance(v, str)]
            if plain:
                df = df.selectExpr("*", *plain)
            if recursive:
                df = _nulls(_kernel(df, ["symbol"], recursive), recursive)
        return df

    def long(self, bars: DataFrame, rows: int = chunks.CHUNK) -> DataFrame:
        """The same columns for series of any length, in chunks of ``rows`` bars: as many tasks as there are chunks. Needs a time of its own for each bar of a series.

        Columns that depend on a whole series (its maximum, or groups of any length) raise; a chunk must be as long as the plan looks back and ahead.
        """
        reach = [chunks.reach([dialect(v, True) if isinstance(v, str) else v for v in level.values()]) for level in self.levels]
        seeds = max([v.n for level in self.levels for v in level.values() if isinstance(v, Wilder)], default=0)
        back, ahead = (sum(r[k] for r in reach) for k in (0, 1))
        if rows < seeds:
            raise ValueError(f"chunks of {rows} rows are shorter than the {seeds} that an average begins with")
        df = chunks.cut(chunks.numbered(bars), rows, back, ahead)
        for k, level in enumerate(self.levels):
            later = sum(r[0] for r in reach[k + 1 :])
            text = {c: dialect(v, True) for c, v in level.items() if isinstance(v, str)}
            carried = {c: v for c, v in level.items() if isinstance(v, Ewm | Wilder)}
            bounded = {c: v for c, v in level.items() if isinstance(v, Rank | Quantile)}
            if text:
                df = chunks.plain(df, text, rows, later)
            if carried:
                df = chunks.recursions(df, carried, lambda s: chunks.Average(s) if isinstance(s, Ewm) else chunks.Smoothed(s), rows, later)
            if bounded:
                df = _kernel(df, ["symbol", "chunk"], bounded)
            if carried or bounded:
                df = _nulls(df, carried | bounded)
        return df.filter("own").drop("own", "chunk", "rn")

    def long_query(self, bars: DataFrame, rows: int = chunks.CHUNK) -> DataFrame:
        return self.long(bars, rows).selectExpr("symbol", "t", *self._columns(True))

    def query(self, bars: DataFrame) -> DataFrame:
        return self.spark(bars).selectExpr("symbol", "t", *self._columns(True))

    def _columns(self, spark: bool) -> list[str]:
        out = []
        for k, digits in self.out.items():
            out.append(f"`{k}`" if spark and digits is None else f'"{k}"' if digits is None else f"{rounded(k, digits)} AS {k}")
        return out

    def sql(self, base: str) -> str:
        parts, at = [f"l0 AS ({base})"], 0

        def add(columns: list[str]) -> None:
            nonlocal at
            parts.append(f"l{at + 1} AS (SELECT *, {', '.join(columns)} FROM l{at})")
            at += 1

        for level in self.levels:
            plain = [f"{dialect(v, False)} AS {k}" for k, v in level.items() if isinstance(v, str)]
            if plain:
                add(plain)
            specs = {k: v for k, v in level.items() if not isinstance(v, str)}
            if specs:
                ordered = {k: v for k, v in specs.items() if isinstance(v, Rank | Quantile)}
                specs = {k: v for k, v in specs.items() if k not in ordered}
                if ordered:
                    ranks = {k: v for k, v in ordered.items() if isinstance(v, Rank)}
                    if ranks:
                        add([f"{dialect(items(v.source, v.n), False)} AS w_{k}" for k, v in ranks.items()])
                    add([f"{dialect(rank_of(f'w_{k}', v.source, v.n) if k in ranks else quantile(v.source, v.q, v.n), False)} AS {k}" for k, v in ordered.items()])
            if specs:
                add([f"row_number() OVER ({ORDER}) - 1 AS i_{k}, count({v.source}) {RUNNING} AS n_{k}" for k, v in specs.items()])
                mid, last = [], []
                for k, v in specs.items():
                    if isinstance(v, Ewm):
                        keep = 1 - 2 / (v.span + 1)
                        weight = f"CASE WHEN {v.source} IS NOT NULL THEN pow({keep!r}::DOUBLE, -n_{k}) END"
                        mid.append(f"sum({v.source} * {weight}) {RUNNING} AS a_{k}, sum({weight}) {RUNNING} AS b_{k}")
                        last.append(f"CASE WHEN n_{k} >= {v.span} THEN a_{k} / b_{k} END AS {k}")
                    else:
                        keep = 1 - 1 / v.n
                        mid.append(f"avg(CASE WHEN i_{k} < {v.n} THEN {v.source} END) {WHOLE} AS a_{k}, sum(CASE WHEN i_{k} >= {v.n} THEN {v.source} * pow({keep!r}::DOUBLE, -i_{k}) END) {RUNNING} AS b_{k}")
                        last.append(f"CASE WHEN i_{k} >= {v.n - 1} THEN pow({keep!r}::DOUBLE, i_{k}) * (a_{k} * pow({keep!r}::DOUBLE, {1 - v.n}) + coalesce(b_{k}, 0) / {v.n}) END AS {k}")
                add(mid)
                add(last)
        return f"WITH {', '.join(parts)} SELECT symbol, t, {', '.join(self._columns(False))} FROM l{at}"


def rounded(x: str, digits: int = 6) -> str:
    """Round half up, the same in both dialects."""
    return f"floor({x} * 1e{digits} + 0.5e0) / 1e{digits}"
