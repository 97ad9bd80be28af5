"""Corrections of p-values over families of any size: a sort in ranges, ranks by offsets, and running extremes that are carried from range to range.

No window spans the family: each range has its own, and one row a range tells the others what they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.functions.chunks import PLACE_BITS
from barwright.sources.bars import kept


def corrected(tests: DataFrame, keys: list[str]) -> DataFrame:
    """``tests`` (``keys``, which tell them apart, and ``p``, without nulls) with the p-values adjusted by Bonferroni, Holm, and Benjamini and Hochberg.

    Equal p-values get equal adjustments. An empty family gives an empty table.
    """
    order = ["p", *keys]
    run = kept(tests.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "family")
    run = run.withColumns({"part": F.shiftright("at", PLACE_BITS), "place": F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))})
    # As many rows as the sort has ranges.
    parts = run.groupBy("part").agg(F.count("*").alias("rows")).selectExpr("part", "coalesce(sum(rows) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before", "sum(rows) OVER () AS n")
    ranked = run.join(F.broadcast(parts), "part").withColumn("i", F.col("before") + F.col("place") + 1)
    ranked = ranked.withColumns({"down": F.col("p") * (F.col("n") - F.col("i") + 1), "up": F.col("p") * F.col("n") / F.col("i")})
    ends = ranked.groupBy("part").agg(F.max("down").alias("most"), F.min("up").alias("least"))
    ends = ends.selectExpr("part", "max(most) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above", "min(least) OVER (ORDER BY part ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS below")
    here = ranked.join(F.broadcast(ends), "part").selectExpr(
        *keys, "p", "n",
        "greatest(max(down) OVER (PARTITION BY part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), above) AS holm",
        "least(min(up) OVER (PARTITION BY part ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), below) AS hochberg",
    )
    return here.select(*keys, "p", F.least(F.col("p") * F.col("n"), F.lit(1.0)).alias("bonferroni"), F.least("holm", F.lit(1.0)).alias("holm"), F.least("hochberg", F.lit(1.0)).alias("benjamini_hochberg"))


__all__ = ["corrected"]
