"""Mixing sources to target weights by Pareto order sampling.

Every document gets an expected number of copies, proportional within its source to a measure of its length. Its whole
part is certain; for the rest documents are ranked by random odds over inclusion odds, and the first ones of a source
are taken until its words reach the target. The cut is one value for each source, found on histograms of the ranking
key, so no source is ever gathered or sorted in one task, and texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.llm.common import stash, unused, word_count

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: The ranking key has 52 bits; its histograms have 13 bits each, and the last 26 are ranked row by row.
KEY_BITS, LEVEL_BITS, LEVELS = 52, 13, 2


def water_fill(rows: DataFrame, keys: list[str], weight: Column, cap: Column, total: Column, out: str, count: Column | None = None) -> DataFrame:
    """Add ``out``: ``total`` shared by ``weight`` among the rows of each key, at most ``cap`` each, the excess reshared.

    A row stands for ``count`` equal ones (1), whose ``cap`` and ``weight`` are given for one. Rows at their cap are those with the
    smallest cap over weight, so one ordered pass finds the level at which the others stand.
    """
    n = F.lit(1.0) if count is None else count
    rows = rows.withColumns({"_w": weight.cast("double"), "_c": cap.cast("double"), "_t": total.cast("double"), "_n": n.cast("double")})
    ratio = F.when(F.col("_w") > 0, F.col("_c") / F.col("_w")).otherwise(F.lit(0.0))
    rows = rows.withColumn("_r", ratio)
    order = Window.partitionBy(*keys).orderBy("_r", "_c", "_w")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    capped = F.coalesce(F.sum(F.col("_c") * F.col("_n")).over(before), F.lit(0.0))
    level = (F.col("_t") - capped) / F.nullif(F.sum(F.col("_w") * F.col("_n")).over(onward), F.lit(0.0))
    # The level with all rows before this one at their caps; the true one is the first that stays under this row's ratio.
    rows = rows.withColumn("_level", level)
    rows = rows.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_r"), F.struct("_r", "_level"))).over(Window.partitionBy(*keys))["_level"])
    filled = F.least(F.col("_c"), F.coalesce(F.col("_w") * F.col("_level"), F.col("_c")))
    return rows.withColumn(out, F.greatest(filled, F.lit(0.0))).drop("_w", "_c", "_t", "_n", "_r", "_level")


def source_targets(stats: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``target`` of each source from its ``source_size``: sources by code point, null last, take the weights in turn and share
    the sum of all sizes; none gets more than ``cap`` times its size."""
    stats = stats.withColumn("_one", F.lit(1))
    place = F.row_number().over(Window.partitionBy("_one").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))).cast("int"))
    stats = stats.withColumns({"weight": weight, "_all": F.sum("source_size").over(Window.partitionBy("_one"))})
    return water_fill(stats, ["_one"], F.col("weight"), F.col("source_size") * cap, F.col("_all"), "target").drop("_one", "_all")


def length_class(size: Column) -> Column:
    """The measure of inclusion: the bits of the document's size, so that longer documents are likelier, by the log of their length."""
    return F.when(size > 0, F.floor(F.log2(size.cast("double"))) + 1).otherwise(0).cast("int")


def ranking_key(uniform: Column, part: Column) -> Column:
    """Pareto order key as an integer of ``KEY_BITS`` bits: random odds over inclusion odds q, mapped to q / (1 + q)."""
    q = (uniform / (1 - uniform)) / (part / (1 - part))
    return F.floor(q / (1 + q) * (1 << KEY_BITS)).cast("long")


def with_draws(docs: DataFrame, seed: int) -> DataFrame:
    """Add ``size``, its class and a uniform draw that depends on the row's contents alone, so that reruns agree."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "source", "text"), 12)
    docs = docs.withColumn("size", word_count(F.col("text")))
    return docs.withColumns({"class": length_class(F.col("size")), "tie": F.xxhash64(F.lit(seed + 1), "doc_id", "source", "text"), "uniform": (draw + 0.5) / float(1 << 52)})


def plan(draws: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """For each source and class: ``whole`` copies, the fractional ``part``, and the ``cut`` up to which ranked documents get one more.

    ``draws``: source, class, size, uniform, tie. The sources' own table is the only one that meets in one task.
    """
    groups = draws.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    groups = groups.withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    stats = source_targets(groups.groupBy("_s", "source").agg(F.sum("words").alias("source_size")), weights, cap)
    groups = groups.join(stats.drop("source"), "_s")
    # Expected copies are c * class, at most ``cap``, where c spends the target: a share of words for each class.
    words = F.col("words").cast("double")
    groups = water_fill(groups, ["_s"], F.col("class") * words, words * cap, F.col("target"), "share")
    copies = F.coalesce(F.col("share") / F.nullif(words, F.lit(0.0)), F.lit(0.0))
    groups = groups.withColumn("copies", F.round(copies, 9)).withColumn("whole", F.floor("copies").cast("long"))
    groups = groups.withColumn("part", F.col("copies") - F.col("whole"))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("_s"))
    return groups.withColumn("rest", rest)


def cuts(draws: DataFrame, groups: DataFrame) -> DataFrame:
    """The last ``(key, tie)`` taken of each source that has one: documents in the order of their keys until the source's words reach its target."""
    tries = groups.filter("part > 0").select(F.col("_s"), F.col("class"), "part", "rest")
    rows = draws.withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).join(tries, ["_s", "class"])
    rows = rows.select("_s", "size", "tie", "rest", ranking_key(F.col("uniform"), F.col("part")).alias("key"))
    shift = KEY_BITS
    done = None  # the bucket that holds the cut, and the words before it
    for _ in range(LEVELS):
        shift -= LEVEL_BITS
        at = rows if done is None else rows.join(done, ["_s"]).filter(F.shiftright("key", shift + LEVEL_BITS) == F.col("bucket")).drop("bucket")
        before = F.lit(0) if done is None else F.col("before")
        hist = at.groupBy("_s", "rest", before.cast("long").alias("start"), F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("_s").orderBy("bucket")) + F.col("start")
        hist = hist.withColumn("run", run).withColumn("before", F.col("run") - F.col("words"))
        first = F.row_number().over(Window.partitionBy("_s").orderBy("bucket"))
        done = hist.filter(F.col("run") >= F.col("rest")).withColumn("_first", first).filter("_first = 1").select("_s", "bucket", "before")
    near = rows.join(done, ["_s"]).filter(F.shiftright("key", shift) == F.col("bucket"))
    order = Window.partitionBy("_s").orderBy("key", "tie")
    near = near.withColumn("run", F.sum("size").over(order) + F.col("before"))
    # The document that passes the target is taken if that comes nearer to it.
    near = near.filter(F.col("run") - F.col("size") / 2.0 <= F.col("rest"))
    cut = near.groupBy("_s").agg(F.max(F.struct("key", "tie")).alias("last"))
    floor = F.struct((F.shiftleft("bucket", shift) - 1).alias("key"), F.lit((1 << 63) - 1).alias("tie"))
    whole = done.select("_s", floor.alias("floor")).join(cut, "_s", "left").select("_s", F.coalesce("last", "floor").alias("cut"))
    return whole


ADDED = ("size", "source_size", "target", "copies")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 20) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies``: how many times the mix takes each row.

    ``docs`` needs doc_id, source and text; further columns stay whatever their names, but those of the names above are replaced. A null source is a
    source of its own; null and empty texts have size 0 and are never taken. A source whose words can't reach its target
    (it is at ``cap``) is taken whole ``cap`` times. Rows that are equal in doc_id, source and text tie, and are taken alike; among ties
    at the cut all are taken. An empty table gives an empty table. Long texts count whole.
    """
    kept = docs.drop(*ADDED)
    # Columns are numbered while the plan adds its own, so that no name can clash.
    numbered = [f"_{k}" for k in range(len(kept.columns))]
    place = {name: number for name, number in zip(kept.columns, numbered, strict=True)}
    own = kept.toDF(*numbered).withColumns({"doc_id": F.col(place["doc_id"]), "source": F.col(place["source"]).cast("string"), "text": F.col(place["text"])})
    draws = stash(with_draws(own.select("doc_id", "source", "text"), seed).select("source", "class", "size", "uniform", "tie"), "mix-draws")
    groups = stash(plan(draws, weights, cap), "mix-plan")
    params = groups.join(cuts(draws, groups), "_s", "left").select("_s", "class", "source_size", "target", "whole", "part", "cut")
    params = stash(params, "mix-cuts")
    rows = with_draws(own, seed).withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    rows = rows.join(params, ["_s", "class"])
    taken = F.struct(ranking_key(F.col("uniform"), F.nullif(F.col("part"), F.lit(0.0))).alias("key"), F.col("tie")) <= F.col("cut")
    extra = F.coalesce((F.col("part") > 0) & taken, F.lit(False)).cast("long")
    return rows.withColumn("copies", F.col("whole") + extra).select(*(F.col(k).alias(name) for name, k in place.items()), *ADDED)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it, with the columns that ``docs`` has but for those that :func:`mix` replaces.

    Those keep the values of ``docs`` too: they are set aside while the mix is planned.
    """
    spare = dict(zip(ADDED, unused(docs.columns, *(f"{c}_before" for c in ADDED)), strict=True))
    present = {c: spare[c] for c in ADDED if c in docs.columns}
    taken = mix(docs.withColumnsRenamed(present), **options)
    (copy,) = unused(taken.columns, "copy")
    rows = taken.filter("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*(F.col(present.get(c, c)).alias(c) for c in docs.columns))


def mix_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )
