"""Models over bar features on ``pyspark.ml``: direction classifiers, regimes, anomalies."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.dist import binomial_sf, t_p
from barwright.functions.dsl import Plan, div, lag, lead, roll
from barwright.operators.edges import Contrast, merged
from barwright.operators.features import PLANS
from barwright.sources.bars import kept

#: Plans whose columns are a model's features: they look back only.
PLANS_OF_FRAME = ("mom_02", "mom_03", "mom_04", "mom_05", "mom_06", "mom_07", "mom_08", "mom_09", "trd_03", "trd_05", "trd_08", "vol_02", "vol_03", "vol_06", "vol_07", "vol_08", "vol_10", "vlm_02", "vlm_06", "cnd_01")
#: What regimes and anomalies are told by.
REGIME, ANOMALY = ("vol_std_20", "adx", "return_20"), ("return_1", "vol_std_20", "rng", "volume")
_OWN = [{"return_1": f"{div('close', lag('close'))} - 1", "return_20": f"{div('close', lag('close', 20))} - 1", "rng": "high - low"}, {"vol_std_20": roll("stddev_samp", "return_1", 20)}]
LEAST = 200


def _plan(ahead: int, columns: tuple[str, ...] | None = None) -> tuple[list[dict], dict[str, str]]:
    """One plan of all features, the forward return ``f`` and the bar's ``place``, and what each is called in it."""
    plans = [(PLANS[name].levels, [Contrast(c, c, "true") for c, digits in PLANS[name].out.items() if digits is not None]) for name in PLANS_OF_FRAME if columns is None or set(columns) & set(PLANS[name].out)]
    own = [Contrast(c, c, "true") for c in ("return_1", "return_20", "rng", "vol_std_20")]
    extra = [{"f": f"{div(lead('close', ahead), 'close')} - 1", "place": "percent_rank() OVER (PARTITION BY symbol ORDER BY t)"}]
    levels, wanted = merged([*plans, (_OWN, own), (extra, [Contrast("f", "f", "true"), Contrast("place", "place", "true")])])
    return levels, {test.key: test.value for test in wanted} | {"volume": "volume"}


def frame(bars: DataFrame, ahead: int = 10, columns: tuple[str, ...] | None = None) -> tuple[DataFrame, list[str]]:
    """Features of every bar in one plan, the forward return ``f``, and the bar's ``place`` in its series from 0 to 1; and the names of the features. Rows without all of them are left out."""
    levels, names = _plan(ahead, columns)
    features = [c for c in (columns or names) if c not in ("f", "place")]
    df = Plan(levels).spark(bars).selectExpr("symbol", "t", *(f"CAST(`{names[c]}` AS DOUBLE) AS `{c}`" for c in [*features, "f", "place"]))
    return df.dropna(subset=[*features, "f"]), features


def _long(bars: DataFrame) -> DataFrame:
    df, names = frame(bars)
    return df.select("symbol", "t", "f", *names).unpivot(["symbol", "t", "f"], names, "feature_name", "x")


def importance(bars: DataFrame) -> DataFrame:
    """Size of each feature's correlation with the forward return, 0 for one that does not vary, and its place in its series."""
    spread = lambda c: F.when(F.stddev_pop(c) > 1e-9, F.stddev_pop(c))
    out = _long(bars).groupBy("symbol", "feature_name").agg(F.coalesce(F.abs(F.covar_pop("x", "f")) / (spread("x") * spread("f")), F.lit(0.0)).alias("importance"))
    out = out.withColumn("importance", F.floor(F.col("importance") * 1e6 + 0.5) / 1e6)
    return out.withColumn("rk", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("importance"), "feature_name")).cast("long"))


SHARES = (0.2, 0.4, 0.6, 0.8)


def mutual_information(bars: DataFrame) -> DataFrame:
    """Mutual information of each feature with the forward return, both in five bins of equal shares of their series."""
    long, shares = _long(bars), F.array(*map(F.lit, SHARES))
    cuts = long.groupBy("symbol", "feature_name").agg(F.percentile("x", shares).alias("cx"), F.percentile("f", shares).alias("cf"))
    above = lambda value, edges: F.size(F.filter(edges, lambda e: F.col(value) > e))
    cells = long.join(cuts, ["symbol", "feature_name"]).groupBy("symbol", "feature_name", above("x", "cx").alias("a"), above("f", "cf").alias("b")).agg(F.count("*").cast("double").alias("n"))
    own = ["symbol", "feature_name"]
    side = lambda *keys: F.sum("n").over(Window.partitionBy(*own, *keys))
    cells = cells.withColumns({"s": side(), "na": side("a"), "nb": side("b")})
    out = cells.groupBy(*own).agg(F.sum(F.expr("n / s * ln(n * s / (na * nb))")).alias("mutual_information"))
    return out.withColumn("mutual_information", F.floor(F.col("mutual_information") * 1e5 + 0.5) / 1e5)


def nearest_information(x: np.ndarray, y: np.ndarray, k: int = 3, seed: int = 0) -> float:
    """Mutual information of two columns in nats, by distances to the ``k``-th nearest neighbours (Kraskov, Stögbauer and Grassberger 2004, first estimator), not under 0.

    Both are scaled to a deviation of 1, and ties are parted by seeded noise of 1e-10. Neighbours are looked for outwards in the order of x, until x alone is
    farther than the k-th nearest, for all rows at once: memory is ``k`` values a row, steps grow with the square root of the rows. 0 for k rows or fewer, or a constant.
    """
    n = len(x)
    if n <= k or np.ptp(x) == 0 or np.ptp(y) == 0:
        return 0.0
    noise = np.random.default_rng(seed)
    x, y = (v - v.mean() for v in (x, y))
    x, y = (v / v.std() + 1e-10 * max(1.0, np.abs(v / v.std()).mean()) * noise.standard_normal(n) for v in (x, y))
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    near = np.full((n, k), np.inf)
    for side in (-1, 1):
        active, step = np.arange(n), 1
        while len(active):
            active = active[(active + side * step >= 0) & (active + side * step < n)]
            other = active + side * step
            wide = np.abs(x[other] - x[active])
            active, other, wide = (v[wide < near[active, -1]] for v in (active, other, wide))
            far = np.maximum(wide, np.abs(y[other] - y[active]))
            closer = far < near[active, -1]
            rows = active[closer]
            near[rows, -1] = far[closer]
            near[rows] = np.sort(near[rows], axis=1)
            step += 1
    # Strictly within: the neighbour at the radius itself isn't counted, whatever its sum rounds to.
    radius, own = near[:, -1], np.sort(y)
    radius = np.maximum(radius - np.maximum(1e-10 * radius, 4 * np.spacing(max(np.abs(x).max(), np.abs(y).max()))), 0)
    harmonic = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, n + 1))])
    digamma = lambda m: harmonic[m - 1] - np.euler_gamma
    within = [np.searchsorted(s, v + radius, "right") - np.searchsorted(s, v - radius, "left") for s, v in ((x, x), (own, y))]
    return max(0.0, float(digamma(k) + digamma(n) - np.mean(digamma(np.maximum(within[0], 1)) + digamma(np.maximum(within[1], 1)))))


def knn_information(bars: DataFrame, k: int = 3, top: int | None = None) -> DataFrame:
    """Mutual information of each feature with the forward return by nearest neighbours, and its place among the features of its series; with ``top`` only the first of them.

    A task holds one feature of one series: two columns of doubles.
    """

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        return pd.DataFrame([(*key, nearest_information(part["x"].to_numpy(float), part["f"].to_numpy(float), k))])

    out = _long(bars).groupBy("symbol", "feature_name").applyInPandas(run, "symbol string, feature_name string, mutual_information double")
    out = out.withColumn("rk", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("mutual_information"), "feature_name")).cast("long"))
    return out.filter(F.col("rk") <= top) if top else out


def ranking(bars: DataFrame) -> DataFrame:
    """Features by correlation and information together."""
    both = importance(bars).join(mutual_information(bars), ["symbol", "feature_name"])
    return both.select("symbol", "feature_name", (F.floor((F.col("importance") + F.col("mutual_information")) * 1e4 + 0.5) / 1e4).alias("score"))


def long_sql(base: str, ahead: int = 10) -> str:
    """DuckDB form of the features in rows: ``u`` (symbol, t, f, feature_name, x), to be followed by a query of it."""
    levels, names = _plan(ahead)
    inner = Plan(levels, {}).sql(base)
    inner = inner[: inner.rindex(" SELECT symbol, t, ")]
    last = inner.rsplit(" AS (SELECT *", 1)[0].rsplit(" ", 1)[-1]
    features = [c for c in names if c not in ("f", "place")]
    columns = ", ".join(f"{names[c]}::DOUBLE AS {c}" for c in features)
    every = " AND ".join(f"{c} IS NOT NULL" for c in [*features, "f"])
    return f"{inner}, w AS (SELECT symbol, t, {names['f']}::DOUBLE AS f, {columns} FROM {last}), fr AS MATERIALIZED (SELECT * FROM w WHERE {every}), u AS (UNPIVOT fr ON {', '.join(features)} INTO NAME feature_name VALUE x)"


IMPORTANCE_SQL = "i0 AS (SELECT symbol, feature_name, floor(coalesce(CASE WHEN stddev_pop(x) > 1e-9 AND stddev_pop(f) > 1e-9 THEN abs(corr(x, f)) END, 0) * 1e6 + 0.5e0) / 1e6 AS importance FROM u GROUP BY ALL), imp AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY importance DESC, feature_name) AS rk FROM i0)"
_CUTS = ", ".join(f"quantile_cont({c}, {q}) AS {c}{k}" for c in ("x", "f") for k, q in enumerate(SHARES))
_ABOVE = ", ".join(f"{' + '.join(f'(u.{c} > k.{c}{k})::INT' for k in range(len(SHARES)))} AS {name}" for c, name in (("x", "a"), ("f", "b")))
INFORMATION_SQL = f"k AS (SELECT symbol, feature_name, {_CUTS} FROM u GROUP BY ALL), c0 AS (SELECT u.symbol, u.feature_name, {_ABOVE} FROM u JOIN k ON k.symbol = u.symbol AND k.feature_name = u.feature_name), c1 AS (SELECT symbol, feature_name, a, b, count(*)::DOUBLE AS n FROM c0 GROUP BY ALL), c2 AS (SELECT *, sum(n) OVER (PARTITION BY symbol, feature_name) AS s, sum(n) OVER (PARTITION BY symbol, feature_name, a) AS na, sum(n) OVER (PARTITION BY symbol, feature_name, b) AS nb FROM c1), inf AS (SELECT symbol, feature_name, floor(sum(n / s * ln(n * s / (na * nb))) * 1e5 + 0.5e0) / 1e5 AS mutual_information FROM c2 GROUP BY ALL)"


def _row(spark, name: str, values: dict) -> DataFrame:
    return spark.createDataFrame([(name, *values.values())], "edge_key string, n long, mean_return double, std_return double, t_statistic double, p_value double, win_rate double, sharpe_ratio double, is_significant boolean")


def direction(bars: DataFrame, model: str = "forest", test_share: float = 0.3, ahead: int = 10) -> DataFrame:
    """Accuracy on the last ``test_share`` of each series, its chance under guessing, and the returns of following the prediction; no row under 200 bars."""
    spark = bars.sparkSession
    data, features = frame(bars, ahead)
    data = VectorAssembler(inputCols=features, outputCol="features").transform(data.withColumn("label", (F.col("f") > 0).cast("double"))).select("features", "label", "f", "place").cache()
    if data.count() < LEAST:
        return _row(spark, "", dict.fromkeys("abcdefgh")).limit(0)
    learner = RandomForestClassifier(numTrees=100, maxDepth=5, seed=42) if model == "forest" else GBTClassifier(maxIter=50, maxDepth=3, stepSize=0.1, seed=42)
    fitted = learner.fit(data.filter(F.col("place") < 1 - test_share))
    tested = fitted.transform(data.filter(F.col("place") >= 1 - test_share))
    follow = F.when(F.col("prediction") > 0, F.col("f")).otherwise(-F.col("f"))
    row = tested.agg(F.count("*").alias("n"), F.sum((F.col("prediction") == F.col("label")).cast("int")).alias("hits"), F.avg(follow).alias("m"), F.stddev_samp(follow).alias("s")).first()
    data.unpersist()
    share, p = row["hits"] / row["n"], binomial_sf(int(row["hits"]), int(row["n"]), 0.5)
    sharpe = row["m"] / row["s"] * (252 / ahead) ** 0.5 if row["s"] else 0.0
    return _row(spark, model, {"n": row["n"], "m": row["m"], "s": row["s"], "t": (share - 0.5) / (0.25 / row["n"]) ** 0.5, "p": p, "w": share, "sharpe": sharpe, "sig": bool(p < 0.05 and share > 0.52)})


def regimes(bars: DataFrame, k: int = 3, starts: int = 5) -> DataFrame:
    """Every bar with its ``regime``: clusters of standardised volatility, trend strength and 20-bar return, those of least cost out of several starts."""
    data, names = frame(bars, columns=REGIME)
    data = VectorAssembler(inputCols=names, outputCol="raw").transform(data)
    data = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(data).transform(data).cache()
    best = min((KMeans(k=k, seed=seed, maxIter=50).fit(data) for seed in range(1, starts + 1)), key=lambda m: m.summary.trainingCost)
    return best.transform(data).select("symbol", "t", *names, "f", F.col("prediction").alias("regime"))


def regime_edges(bars: DataFrame, k: int = 3, ahead: int = 10) -> DataFrame:
    """One t-test of the forward returns for each regime with 30 bars or more."""
    out = regimes(bars, k).groupBy("regime").agg(F.count("*").alias("n"), F.avg("f").alias("mean_return"), F.stddev_samp("f").alias("std_return"), F.avg((F.col("f") > 0).cast("double")).alias("win_rate")).filter("n >= 30")
    out = out.withColumn("t_statistic", F.expr("mean_return / nullif(std_return / sqrt(n), 0)"))
    out = out.withColumn("p_value", t_p(F.col("t_statistic"), F.col("n") - 1)).withColumn("sharpe_ratio", F.expr(f"coalesce(mean_return / nullif(std_return, 0) * sqrt(252 / {ahead}), 0D)"))
    return out.select(F.concat(F.lit("regime_"), "regime").alias("edge_key"), "n", "mean_return", "std_return", "t_statistic", "p_value", "win_rate", "sharpe_ratio", (F.col("p_value") < 0.05).alias("is_significant"))


def _tree(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    if depth == 0 or len(x) <= 1:
        return (len(x),)
    k = int(rng.integers(x.shape[1]))
    lo, hi = x[:, k].min(), x[:, k].max()
    if lo == hi:
        return (len(x),)
    cut = rng.uniform(lo, hi)
    left = x[:, k] < cut
    return k, cut, _tree(x[left], rng, depth - 1), _tree(x[~left], rng, depth - 1)


def _expected(n: int) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def _depth(x: np.ndarray, tree: tuple, at: int = 0) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), at + _expected(tree[0]))
    k, cut, a, b = tree
    left = x[:, k] < cut
    out = np.empty(len(x))
    out[left], out[~left] = _depth(x[left], a, at + 1), _depth(x[~left], b, at + 1)
    return out


def _samples(names: list[str], trees: int, sample: int):
    """Of the rows of a task, those with the least hashes for each tree: no tree can need others."""
    tree_keys = (np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, x = np.zeros((0, trees), np.uint64), np.zeros((0, trees, len(names)))
        for pdf in batches:
            own = pdf["hash"].to_numpy(np.int64).view(np.uint64)[:, None] ^ tree_keys
            own = (own ^ (own >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            own = (own ^ (own >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = np.concatenate([h, own ^ (own >> np.uint64(31))])
            rows = np.broadcast_to(pdf[names].to_numpy(float)[:, None, :], (len(pdf), trees, len(names)))
            least = np.argsort(h, axis=0, kind="stable")[:sample]
            x = np.take_along_axis(np.concatenate([x, rows]), least[:, :, None], axis=0)
            h = np.take_along_axis(h, least, axis=0)
        for k in range(trees):
            yield pd.DataFrame({"tree": k, "h": h[:, k].view(np.int64), **{c: x[:, k, j] for j, c in enumerate(names)}})

    return run


def isolation_forest(data: DataFrame, names: list[str], trees: int = 100, sample: int = 256) -> tuple[list[tuple], int]:
    """Trees over ``sample`` rows each, drawn from the whole of ``data`` (with a ``hash`` of each row), and how many rows a tree has. Trees are grown in tasks of their own."""
    drawn = data.mapInPandas(_samples(names, trees, sample), "tree int, h long, " + ", ".join(f"`{c}` double" for c in names))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        least = pdf.assign(u=pdf["h"].to_numpy(np.int64).view(np.uint64)).nsmallest(sample, "u").sort_values("u")
        tree = _tree(least[names].to_numpy(float), np.random.default_rng([42, int(key[0])]), 8)
        return pd.DataFrame({"tree": [key[0]], "rows": [len(least)], "grown": [pickle.dumps(tree)]})

    grown = drawn.groupBy("tree").applyInPandas(grow, "tree int, rows int, grown binary").orderBy("tree").collect()
    return [pickle.loads(bytes(r.grown)) for r in grown], max((r.rows for r in grown), default=0)


def anomalies(bars: DataFrame, trees: int = 100, sample: int = 256, share: float = 0.05) -> DataFrame:
    """Isolation forest: trees on ``sample`` rows each, drawn from all rows; all rows scored in Arrow batches, the highest ``share`` flagged."""
    data, names = frame(bars, columns=ANOMALY)
    data = kept(data.withColumn("hash", F.xxhash64("symbol", "t")), "anomaly-rows")
    forest, rows = isolation_forest(data, names, trees, sample)
    norm = _expected(rows) or 1.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[names].to_numpy()
            yield pdf[["symbol", "t", "f"]].assign(score=2 ** (-np.mean([_depth(x, t) for t in forest], axis=0) / norm))

    scored = kept(data.mapInPandas(score, "symbol string, t double, f double, score double"), "anomaly-scores")
    cut = scored.agg(F.percentile("score", F.lit(1 - share)).alias("cut"))
    return scored.join(F.broadcast(cut)).select("symbol", F.col("t").cast("long").alias("t"), "f", "score", (F.col("score") > F.col("cut")).alias("is_anomaly"))


def anomaly_edge(bars: DataFrame, ahead: int = 10) -> DataFrame:
    """Sizes of forward returns after anomalies against those after other bars (pooled t-test), and the returns after anomalies; no row under 30 of them."""
    x = anomalies(bars)
    out = x.groupBy().agg(
        F.count(F.when(F.col("is_anomaly"), 1)).alias("n"), F.avg(F.when(F.col("is_anomaly"), F.col("f"))).alias("mean_return"), F.stddev_samp(F.when(F.col("is_anomaly"), F.col("f"))).alias("std_return"),
        F.avg(F.when(F.col("is_anomaly"), (F.col("f") > 0).cast("double"))).alias("win_rate"), *(f(F.when(F.col("is_anomaly") == hit, F.abs("f"))).alias(f"{name}_{int(hit)}") for hit in (True, False) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))),
    ).filter("n >= 30")
    out = out.withColumn("t_statistic", F.expr("(m_1 - m_0) / nullif(sqrt(((n_1 - 1) * v_1 + (n_0 - 1) * v_0) / (n_1 + n_0 - 2) * (1D / n_1 + 1D / n_0)), 0)"))
    out = out.withColumn("p_value", t_p(F.col("t_statistic"), F.col("n_1") + F.col("n_0") - 2)).withColumn("sharpe_ratio", F.expr(f"coalesce(mean_return / nullif(std_return, 0) * sqrt(252 / {ahead}), 0D)"))
    return out.select(F.lit("anomaly").alias("edge_key"), "n", "mean_return", "std_return", "t_statistic", "p_value", "win_rate", "sharpe_ratio", (F.col("p_value") < 0.05).alias("is_significant"))
