"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.common import stash

#: A node is heavy that has more than one in so many of all edges, so there are fewer than twice as many heavy nodes; and more than the second number.
SHARE, LEAST = 1000, 500


def _with_least(rows: DataFrame, edges: int) -> DataFrame:
    """``rows`` (u, v) with ``m``, the least of u and its v. Heavy nodes, whose number ``SHARE`` bounds, are looked up by broadcast, so no join meets all rows of one."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).withColumn("m", F.least("m", "u"))
    heavy = F.broadcast(least.filter(F.col("d") > max(LEAST, edges // SHARE)).select("u", "m"))
    light = rows.join(heavy, "u", "left_anti").join(least.select("u", "m"), "u")
    return rows.join(heavy, "u").unionByName(light)


def _thinned(edges: DataFrame) -> DataFrame:
    """The same components with fewer edges: a node keeps the one to its least neighbour, and its other neighbours, which many nodes share, are tied to that."""
    least = edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return least.select("u", F.col("m").alias("v")).unionByName(least.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()


def _both(a: str, b: str) -> list[Column]:
    return [F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v"))]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, label`` for every node of ``edges`` (u, v of one ordered type), the label being the least node of its component.

    Nulls and loops are left out. What a step leaves is written to the shared folder.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = stash(_thinned(stash(edges, "edges")), "edges")
    state, size = None, edges.count()
    if not size:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    for _ in range(rounds):
        # Large star: a node's larger neighbours go to its least one. A hub is the least of very many.
        both = edges.select(F.explode(F.array(*_both("u", "v"))).alias("e")).select("e.*")
        large = _with_least(both, size).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the least of them, and large stars leave a node few smaller neighbours.
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        edges = stash(small.select(F.explode(pairs).alias("e")).select("e.*").filter("u <> v").distinct(), "edges")
        # The sum wraps around on purpose: it is a fingerprint of the edge set.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            return edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("label")), F.struct(F.col("v").alias("node"), F.col("v").alias("label")))).alias("e")).select("e.*").distinct()
        state, size = now, now[0]
    raise RuntimeError("components did not settle")
