"""Resampling of series by weights: a replicate is a number of draws for each row, never a row for each draw.

A series lies in parts of ``PART`` rows. The n draws of a replicate are first dealt over the parts, then over the rows of each part, where they are
counted and the counts multiply the rows in place. A part gives its sums for each replicate, so the shuffle is replicates x parts, and no part needs
another's rows. Draws depend on replicate, part and draw alone: reruns and retried tasks agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.config import Validation

PART = 1 << 16
MODULUS = 2147483647
#: Draws that a task holds at once, and replicates of a block where draws are dealt over parts.
CELLS, BLOCK = 1 << 21, 100
REPLICATES = Validation().bootstrap
#: Each statistic from a replicate's sums: k draws, their sum s1, their sum of squares s2, and how many are above 0 (up).
STATISTICS = {
    "mean": "s1 / k",
    "sharpe": "s1 / k / nullif(sqrt(greatest(s2 / k - pow(s1 / k, 2), 0)), 0) * sqrt(252)",
    "win_rate_over_half": "up / k - 0.5D",
    "mean_over_target": "s1 / k - 0.001D",
}


def draws(replicates: np.ndarray, n: int) -> np.ndarray:
    """Numbers under 2**31 for draws 0 to n - 1 of each replicate: two squarings of a congruence, so that draws are not a lattice."""
    b, i = replicates.astype(np.int64)[:, None], np.arange(n, dtype=np.int64)[None, :]
    h = ((b + 1) * 69621 + (i + 1) * 104729 + 12345) % MODULUS * 48271 % MODULUS
    g = (h * h + i * 7919 + b) % MODULUS
    return (g * g + h) % MODULUS


def counts(replicates: np.ndarray, sizes: np.ndarray, rows: int) -> np.ndarray:
    """How often each of ``rows`` rows is drawn, in replicates of so many draws each."""
    out = np.zeros((len(replicates), rows), np.int32)
    step = max(1, CELLS // max(int(sizes.max(initial=1)), 1))
    for a in range(0, len(replicates), step):
        own, most = slice(a, a + step), int(sizes[a : a + step].max(initial=0))
        at = draws(replicates[own], most) % rows + np.arange(len(replicates[own]))[:, None] * rows
        kept = np.arange(most)[None, :] < sizes[own, None]
        out[own] = np.bincount(at[kept], minlength=len(replicates[own]) * rows).reshape(-1, rows)
    return out


def _deal(replicates: int):
    """Draws of each replicate over the parts of long series."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                b = np.arange(r.block * BLOCK, min((r.block + 1) * BLOCK, replicates))
                parts = -(-r.n // PART)
                sizes = np.zeros((len(b), parts), np.int64)
                for k, one in enumerate(b):
                    # Another stream than the draws within parts.
                    for a in range(0, r.n, CELLS):
                        m = min(CELLS, r.n - a)
                        u = draws(np.array([one + (1 << 24) + (a // CELLS << 8)]), m)[0]
                        sizes[k] += np.bincount(u % r.n // PART, minlength=parts)
                for p in range(parts):
                    yield pd.DataFrame({"key": r.key, "part": p, "block": r.block, "sizes": [sizes[:, p].tolist()]})

    return run


def _sums(replicates: int):
    def run(key: tuple, rows: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values("rn")["y"].to_numpy(float)
        table = np.column_stack([np.ones(len(y)), y, y * y, (y > 0).astype(float)])
        b = np.arange(replicates)
        sizes = np.full(replicates, len(y)) if dealt.empty else np.concatenate(dealt.sort_values("block")["sizes"].to_list()).astype(np.int64)
        out = [table.sum(0)[None, :]]
        step = max(1, CELLS // max(len(y), 1))
        for a in range(0, replicates, step):
            out.append(counts(b[a : a + step] + replicates * int(key[1]), sizes[a : a + step], len(y)) @ table)
        out = np.concatenate(out)
        return pd.DataFrame({"key": key[0], "b": np.concatenate([[-1], b]), **{c: out[:, j] for j, c in enumerate(("k", "s1", "s2", "up"))}})

    return run


def replicate_sums(values: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """``values``: key, rn (1, 2, 3 ... for each key) and y, without nulls. For each key and replicate ``b`` the sums k, s1, s2 and up; b = -1 is the series itself."""
    # Few rows, much work: the number of partitions is given, so that they aren't joined into one.
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = values.withColumn("part", F.floor((F.col("rn") - 1) / F.lit(PART)).cast("long")).repartition(tasks, "key", "part")
    long = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > PART)
    blocks = long.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // BLOCK)))).repartition(tasks, "key", "block")
    dealt = blocks.mapInPandas(_deal(replicates), "key string, part long, block int, sizes array<long>")
    sums = rows.groupBy("key", "part").cogroup(dealt.groupBy("key", "part")).applyInPandas(_sums(replicates), "key string, b long, k double, s1 double, s2 double, up double")
    return sums.groupBy("key", "b").agg(*[F.sum(c).alias(c) for c in ("k", "s1", "s2", "up")])


def intervals(sums: DataFrame, statistic: str, least: int = 10) -> DataFrame:
    """Observed value, mean, deviation, 95 % interval and two-sided p-value of a statistic over the replicates, for each key with ``least`` rows or more."""
    each = sums.selectExpr("key", "b", "k", f"{STATISTICS[statistic]} AS s")
    seen = each.filter(f"b = -1 AND k >= {least}").select("key", F.col("s").alias("observed_value"))
    spread = each.filter("b >= 0").groupBy("key").agg(
        F.count("*").alias("n_bootstrap"), F.avg("s").alias("bootstrap_mean"), F.stddev_pop("s").alias("bootstrap_std"), F.expr("percentile(s, 0.025)").alias("ci_lo"), F.expr("percentile(s, 0.975)").alias("ci_hi"),
        F.avg((F.col("s") <= 0).cast("double")).alias("down"), F.avg((F.col("s") >= 0).cast("double")).alias("up"),
    )
    out = spread.join(seen, "key").withColumn("p", F.when(F.col("observed_value") > 0, F.col("down")).otherwise(F.col("up")))
    return out.withColumn("p_value", 2 * F.least("p", 1 - F.col("p"))).drop("down", "up", "p")


def permuted(values: DataFrame, permutations: int = REPLICATES, least: int = 30) -> DataFrame:
    """Two groups of each key (rows of even and of odd ``rn``) against random halves of the same sizes: differences of means and of medians.

    A row for each key and permutation ``b``, with ``mean`` and ``median``; b = -1 is the series itself. A block of permutations gets a whole series as one
    array of numbers.
    """
    arrays = values.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rn", "y"))).alias("rows")).filter(F.size("rows") >= least)
    blocks = arrays.select("key", F.transform("rows", lambda x: x["rn"]).alias("rn"), F.transform("rows", lambda x: x["y"]).alias("y"), F.explode(F.sequence(F.lit(0), F.lit((permutations - 1) // BLOCK))).alias("block"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                rn, y = np.asarray(r.rn, np.int64), np.asarray(r.y, float)
                n1 = int((rn % 2 == 0).sum())
                b = np.arange(r.block * BLOCK, min((r.block + 1) * BLOCK, permutations))
                step = max(1, CELLS // len(y))
                for a in range(0, len(b), step):
                    own = b[a : a + step]
                    order = np.argsort(draws(own, int(rn[-1]) + 1)[:, rn], axis=1, kind="stable")
                    if r.block == a == 0:
                        own, order = np.append(own, -1), np.vstack([order, np.argsort(rn % 2, kind="stable")])
                    one, two = y[order[:, :n1]], y[order[:, n1:]]
                    yield pd.DataFrame({"key": r.key, "b": own, "mean": one.mean(1) - two.mean(1), "median": np.median(one, 1) - np.median(two, 1)})

    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(tasks, "key", "block").mapInPandas(run, "key string, b long, mean double, median double")


__all__ = ["REPLICATES", "STATISTICS", "intervals", "permuted", "replicate_sums"]
