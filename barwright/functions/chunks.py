"""Feature plans on long series: a series is cut into chunks of rows, so one instrument keeps many tasks busy.

Rows are numbered within their series by a sort in ranges, whose counts give the offsets. A chunk holds its own rows and copies of the rows before and
after it that its windows look at (the halo). What looks back without bound crosses chunks as a small state:

* running sums, counts, extremes and last values: totals of the chunks before, from one row a chunk;
* exponential and Wilder's averages: each chunk is an affine map of the state before it; the maps of a series are composed in one small pass, and
  every chunk runs on from its own state.

The rows of each level are shuffled by chunk once; both passes read that exchange.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.sources.bars import shared

if TYPE_CHECKING:
    from barwright.functions.dsl import Ewm, Wilder

#: Bars of a chunk in production.
CHUNK = 1 << 17
PLACE_BITS = 33
_CALL = r"(?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*"
_SHIFT = re.compile(rf"\b(lag|lead)\({_CALL}, (\d+)\) OVER")
_RUNNING = re.compile(rf"\b(sum|count|max|min|last)\(({_CALL})\) OVER \(PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW\)")
_NUMBER = "row_number() OVER (PARTITION BY symbol ORDER BY t)"


def numbered(bars: DataFrame) -> DataFrame:
    """``bars`` with ``rn``, 0, 1, 2 ... in each series, in the shared folder. A range holds rows of few series, so offsets are one row a range and series."""
    path = shared(bars.sparkSession, "numbered")
    run = bars.repartitionByRange("symbol", "t").sortWithinPartitions("symbol", "t").withColumn("at_", F.monotonically_increasing_id())
    run.write.parquet(path)
    run = bars.sparkSession.read.schema(run.schema).parquet(path).withColumn("part_", F.shiftright("at_", PLACE_BITS))
    parts = run.groupBy("part_", "symbol").agg(F.min("at_").alias("first_"), F.count("*").alias("rows_"))
    parts = parts.selectExpr("part_", "symbol", "first_", "sum(rows_) OVER (PARTITION BY symbol ORDER BY part_) - rows_ AS before_")
    return run.join(parts, ["part_", "symbol"]).withColumn("rn", F.col("at_") - F.col("first_") + F.col("before_")).drop("part_", "at_", "first_", "before_")


def reach(specs: list) -> tuple[int, int]:
    """Rows that a level looks back and ahead."""
    back, ahead = 0, 0
    for spec in specs:
        if not isinstance(spec, str):
            back = max(back, getattr(spec, "bounded", 0))
            continue
        for kind, k in _SHIFT.findall(spec):
            back, ahead = (max(back, int(k)), ahead) if kind == "lag" else (back, max(ahead, int(k)))
        back = max([back, *map(int, re.findall(r"ROWS BETWEEN (\d+) PRECEDING", spec))])
        ahead = max([ahead, *map(int, re.findall(r"AND (\d+) FOLLOWING", spec))])
    return back, ahead


def cut(rows: DataFrame, size: int, back: int, ahead: int) -> DataFrame:
    """Every row in its ``chunk`` (``own``), and as a copy in those whose halo it lies in."""
    if size < max(back + ahead, 1):
        raise ValueError(f"chunks of {size} rows are shorter than the {back} rows back and {ahead} ahead that the plan looks at")
    own = F.floor(F.col("rn") / F.lit(size)).cast("long")
    chunks = F.array_compact(F.array(own, F.when(F.col("rn") % size >= size - back, own + 1), F.when((F.col("rn") % size < ahead) & (own > 0), own - 1)))
    return rows.withColumn("chunk", F.explode(chunks)).withColumn("own", own == F.col("chunk"))


def _carried(df: DataFrame, calls: dict[str, tuple[str, str]], size: int, later: int) -> DataFrame:
    """Add, for each running call, its value over the rows before those that the chunk sees: ``later`` rows before its own."""
    early = f"own AND rn % {size} < {size - later}"
    fold = lambda fn, x: f"last({x}, true)" if fn == "last" else f"{'sum' if fn in ('sum', 'count') else fn}({x})"
    of = lambda fn, arg, where: f"last(CASE WHEN {where} THEN {arg.rsplit(', true', 1)[0]} END, true)" if fn == "last" else f"{fn}(CASE WHEN {where} THEN {arg} END)"
    each = []
    for name, (fn, arg) in calls.items():
        if fn == "last":
            # The value of the last row that has one, told by the row's number.
            x = arg.rsplit(", true", 1)[0]
            each += [f"max_by(CASE WHEN {w} THEN {x} END, CASE WHEN ({w}) AND ({x}) IS NOT NULL THEN rn END) AS {name}_{p}" for p, w in (("a", early), ("b", f"own AND NOT ({early})"))]
        else:
            each += [f"{of(fn, arg, early)} AS {name}_a", f"{of(fn, arg, f'own AND NOT ({early})')} AS {name}_b"]
    parts = df.groupBy("symbol", "chunk").agg(*[F.expr(e) for e in each])
    series = "OVER (PARTITION BY symbol ORDER BY chunk"
    out = []
    for name, (fn, _) in calls.items():
        both = {"last": f"coalesce({name}_b, {name}_a)", "max": f"greatest({name}_a, {name}_b)", "min": f"least({name}_a, {name}_b)"}.get(fn, f"coalesce({name}_a + {name}_b, {name}_a, {name}_b)")
        before, near = f"{fold(fn, both)} {series} ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)", f"lag({name}_a) {series})"
        joined = {"last": f"coalesce({near}, {before})", "max": f"greatest({before}, {near})", "min": f"least({before}, {near})"}.get(fn, f"coalesce({before} + {near}, {before}, {near})")
        out.append(f"{joined} AS {name}")
    return df.join(parts.selectExpr("symbol", "chunk", *out), ["symbol", "chunk"])


def plain(df: DataFrame, level: dict[str, str], size: int, later: int) -> DataFrame:
    """One level of SQL expressions by chunk. ``later``: rows before its own that later levels look at."""
    calls: dict[str, tuple[str, str]] = {}
    see = f"(own OR rn >= chunk * {size} - {later})"

    def local(m: re.Match) -> str:
        fn, arg = m[1], m[2]
        name = f"carry_{len(calls)}"
        calls[name] = (fn, arg)
        frame = "OVER (PARTITION BY symbol, chunk ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        if fn == "last":
            return f"coalesce(last(CASE WHEN {see} THEN {arg.rsplit(', true', 1)[0]} END, true) {frame}, {name})"
        here = f"{fn}(CASE WHEN {see} THEN {arg} END) {frame}"
        return f"{'greatest' if fn == 'max' else 'least'}({here}, {name})" if fn in ("max", "min") else f"coalesce({here} + {name}, {here}, {name})"

    out = []
    for name, text in level.items():
        text = _RUNNING.sub(local, text.replace(_NUMBER, "(rn + 1)"))
        if "UNBOUNDED" in text.replace("PARTITION BY symbol, chunk ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "") or "PARTITION BY symbol)" in text or re.search(r"PARTITION BY symbol, (?!chunk)", text):
            raise ValueError(f"column {name} depends on a whole series, which chunks can't carry: {text}")
        out.append(re.sub(r"PARTITION BY symbol\b(?!,)", "PARTITION BY symbol, chunk", text) + f" AS `{name}`")
    if calls:
        df = _carried(df, calls, size, later)
    return df.selectExpr("*", *out).drop(*calls)


# --- recursions: state in, values and state out ---
def _run(x: np.ndarray, alpha: float, before: float, gap: int) -> np.ndarray:
    """The recursion y = (1 - alpha) y + alpha x from the value ``before``, seen ``gap`` missing rows ago; missing rows keep the value and lose its weight."""
    head = np.concatenate([[before], np.full(gap, np.nan)]) if before == before else np.zeros(0)
    return pd.Series(np.concatenate([head, x])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[len(head) :]


def _sums(x: np.ndarray, keep: float, num: float, den: float) -> tuple[np.ndarray, np.ndarray]:
    """Decayed sums of the values and of their number, from those before."""
    sum_of = lambda v, start: pd.Series(np.concatenate([[start * (1 - keep)], v])).ewm(alpha=1 - keep, adjust=False).mean().to_numpy()[1:] / (1 - keep)
    return sum_of(np.nan_to_num(x), num), sum_of((x == x).astype(float), den)


def _seeded(x: np.ndarray, n: int) -> np.ndarray:
    """A series whose first ``n`` rows give way to their mean, at the last of them."""
    x = x.copy()
    mean = pd.Series(x[:n]).mean() if len(x) >= n else np.nan
    x[: n - 1] = np.nan
    if len(x) >= n:
        x[n - 1] = mean
    return x


class Average:
    """An adjusted exponential average. State: decayed sum, decayed number, values so far."""

    width, parts = 3, 4

    def __init__(self, spec: Ewm):
        self.source, self.span, self.keep = spec.source, spec.span, 1 - 2 / (spec.span + 1)
        self.start = [0.0, 0.0, 0.0]

    def prepare(self, x: np.ndarray, first: bool) -> np.ndarray:
        return x

    def summary(self, x: np.ndarray) -> list[float]:
        if not len(x):
            return [1.0, 0.0, 0.0, 0.0]
        num, den = _sums(x, self.keep, 0.0, 0.0)
        return [self.keep ** len(x), num[-1], den[-1], float((x == x).sum())]

    def after(self, state: list[float], part: list[float]) -> list[float]:
        return [part[0] * state[0] + part[1], part[0] * state[1] + part[2], state[2] + part[3]]

    def values(self, x: np.ndarray, state: list[float]) -> np.ndarray:
        num, den = _sums(x, self.keep, state[0], state[1])
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(state[2] + np.cumsum(x == x) >= self.span, num / den, np.nan)


class Smoothed:
    """Wilder's average. State: the value, and the missing rows since."""

    width, parts = 2, 6

    def __init__(self, spec: Wilder):
        self.source, self.n, self.alpha = spec.source, spec.n, 1 / spec.n
        self.start = [float("nan"), 0.0]

    def prepare(self, x: np.ndarray, first: bool) -> np.ndarray:
        return _seeded(x, self.n) if first else x

    def summary(self, x: np.ndarray) -> list[float]:
        """Rows, missing rows before the first value, that value, the rest as a map a y + b, and missing rows at the end."""
        seen = np.flatnonzero(x == x)
        if not len(seen):
            return [float(len(x)), float(len(x)), float("nan"), 1.0, 0.0, 0.0]
        low, high = (_run(np.concatenate([[v], x[seen[0] + 1 :]]), self.alpha, float("nan"), 0)[-1] for v in (0.0, 1.0))
        return [float(len(x)), float(seen[0]), x[seen[0]], high - low, low, float(len(x) - 1 - seen[-1])]

    def after(self, state: list[float], part: list[float]) -> list[float]:
        rows, lead, first, a, b, trail = part
        if first != first:
            return [state[0], state[1] + rows]
        y = first
        if state[0] == state[0]:
            weight = (1 - self.alpha) ** (state[1] + lead + 1)
            y = (weight * state[0] + self.alpha * first) / (weight + self.alpha)
        return [a * y + b, trail]

    def values(self, x: np.ndarray, state: list[float]) -> np.ndarray:
        return _run(x, self.alpha, state[0], int(state[1]))


def recursions(df: DataFrame, specs: dict[str, Ewm | Wilder], kernels: Callable, size: int, later: int) -> DataFrame:
    """Add the recursive columns by chunk, for its own rows and the ``later`` rows before them."""
    made = {name: kernels(spec) for name, spec in specs.items()}

    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["own"]].sort_values("rn")
        at = max(len(pdf) - later, 0) if len(pdf) < size else size - later
        out = []
        for kernel in made.values():
            x = kernel.prepare(pdf[kernel.source].to_numpy(float, na_value=np.nan), key[1] == 0)
            out += kernel.summary(x[:at]) + kernel.summary(x[at:])
        return pd.DataFrame({"symbol": [key[0]], "chunk": [key[1]], "maps": [out]})

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk", ignore_index=True)
        states = {name: kernel.start for name, kernel in made.items()}
        seen = dict(states)
        rows = []
        for maps in pdf["maps"]:
            rows.append([x for state in seen.values() for x in state])
            i = 0
            for name, kernel in made.items():
                early, late = maps[i : i + kernel.parts], maps[i + kernel.parts : i + 2 * kernel.parts]
                # The next chunk begins ``later`` rows before its own: between the two parts of this one.
                seen[name] = kernel.after(states[name], early)
                states[name] = kernel.after(seen[name], late)
                i += 2 * kernel.parts
        return pd.DataFrame({"symbol": pdf["symbol"], "chunk": pdf["chunk"], "state": rows})

    def apply(key: tuple, pdf: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        run = (pdf["rn"] >= key[1] * size - later).to_numpy()
        state, i = list(carried["state"].iloc[0]), 0
        for name, kernel in made.items():
            x = kernel.prepare(pdf[kernel.source].to_numpy(float, na_value=np.nan)[run], key[1] == 0)
            out = np.full(len(pdf), np.nan)
            out[run] = kernel.values(x, state[i : i + kernel.width])
            pdf[name] = out
            i += kernel.width
        return pdf

    sources = sorted({k.source for k in made.values()})
    maps = df.select("symbol", "chunk", "rn", "own", *sources).groupBy("symbol", "chunk").applyInPandas(summarise, "symbol string, chunk long, maps array<double>")
    carried = maps.groupBy("symbol").applyInPandas(compose, "symbol string, chunk long, state array<double>")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{k}` double" for k in specs)
    return df.groupBy("symbol", "chunk").cogroup(carried.groupBy("symbol", "chunk")).applyInPandas(apply, schema)


__all__ = ["CHUNK", "cut", "numbered", "plain", "reach", "recursions"]
