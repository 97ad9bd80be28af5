"""Importance resampling towards a target corpus, in Spark SQL functions alone.

Hashed n-grams of the raw and of the target texts are counted in buckets; a bucket's gain is the logarithm of how much commoner it is in the
target. A document weighs the sum of the gains of its features, and Gumbel noise, seeded by its id, turns a cut by score into a draw without
replacement in proportion to the weights. No user function takes part.

Documents are told apart by id and digest of the text, so the row that a feature belongs to doesn't depend on the order in which rows arrive,
and rows that repeat are counted once and dealt out again before the sort.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import stash, unused

#: What stands between words: ASCII other than digits and lower-case letters.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: ``monotonically_increasing_id`` is the number of the partition and, in its low 33 bits, the place there.
PLACE_BITS = 33


def grams(df: DataFrame, text: str, n: int = 1, name: str = "grams") -> DataFrame:
    """Add all runs of 1 to ``n`` words, joined by a space, beside empty strings; never an empty array.

    It is exploded by the outer forms: before the others Spark puts a test of the array's size, for which it would be built twice.
    """
    words = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), ascii_uppercase, ascii_lowercase), SEPARATOR)
    if n == 1:
        return df.withColumn(name, words)
    # Words are a column of their own: inside a function of higher order they would be split anew for each run.
    (whole,) = unused([*df.columns, name], "words")
    df = df.withColumn(whole, F.filter(words, lambda w: w != ""))

    def runs(k: int) -> Column:
        starts = F.when(F.size(whole) >= k, F.sequence(F.lit(1), F.size(whole) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(whole, i, F.lit(k)), " "))

    return df.withColumn(name, F.concat(F.array(F.lit("")), *[runs(k) for k in range(1, n + 1)])).drop(whole)


def bucket(gram: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a feature; null for the empty string, which isn't one."""
    return F.when(gram != "", F.crc32(gram.cast("binary")) % buckets)


def bucket_counts(raw: DataFrame, target: DataFrame, text: str = "text", n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Features of both corpora in each bucket that has any: ``bucket``, ``s`` (raw), ``t`` (target)."""
    side = lambda df, s: grams(df.select(text), text, n).select(F.explode_outer("grams").alias("gram"), F.lit(s).alias("s"), F.lit(1 - s).alias("t"))
    both = side(raw, 1).unionByName(side(target, 0)).select(bucket(F.col("gram"), buckets).alias("bucket"), "s", "t")
    return both.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))


def gain_table(counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``gain`` of every bucket, whole thousandths of a natural logarithm with one added to each count: a table of ``buckets`` rows."""
    of = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    total = lambda c: counts.select(F.coalesce(F.sum(c), F.lit(0)).cast("double")).scalar()
    odds = (of("t") + 1) * (total("s") + buckets) / ((of("s") + 1) * (total("t") + buckets))
    every = counts.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    return every.join(counts, "bucket", "left").select("bucket", F.floor(1000 * F.ln(odds)).alias("gain"))


def noise(key: Column, seed: str) -> Column:
    """Gumbel noise in whole thousandths, from the first 32 bits of a hash of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, gains: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``id``, ``digest`` of the text, ``copies`` (rows with both), ``n_words``, ``n_features`` and ``weight``.

    ``gains`` is broadcast: it has ``buckets`` rows. The sum by document is made where its features are exploded, so one row a document is shuffled.
    """
    each = docs.select(F.col(doc_id).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"), F.col(text).alias("text"))
    each = grams(each, "text", n).select("id", "digest", F.posexplode_outer("grams").alias("pos", "gram"))
    each = each.select("id", "digest", "pos", bucket(F.col("gram"), buckets).alias("bucket"), (F.instr("gram", " ") == 0).alias("word"))
    sums = each.join(F.broadcast(gains), "bucket", "left").groupBy("id", "digest").agg(
        F.count_if(F.col("pos") == 0).alias("copies"), F.count_if(F.col("bucket").isNotNull() & F.col("word")).alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"),
    )
    return sums.select("id", "digest", "copies", *[F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n_features", "weight")])


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``place``, 1, 2, 3 ... over all rows in an order that is total: a sort by ranges, then each partition's places begin where the last one's end.

    The offsets are broadcast: they are as many rows as the sort has partitions.
    """
    run = stash(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("at", PLACE_BITS)
    offsets = run.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).selectExpr("part", "sum(rows) OVER (ORDER BY part) - rows AS before")
    placed = run.withColumn("part", part).join(F.broadcast(offsets), "part")
    return placed.withColumn("place", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1).drop("part", "before", "at")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 1, buckets: int = BUCKETS, seed: str = "2024", min_words: int = 20, percent: int = 10) -> DataFrame:
    """Score every row of ``docs`` and draw ``percent`` per cent of those with ``min_words`` words or more.

    Returns a row for each row of ``docs``: ``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` (1 for the highest score, null where not
    drawn), all long but the id, which keeps its type. A null or empty text has no features and weight 0; a null id has the noise of an empty one.
    Equal scores are ordered by id, nulls last, then by the text's digest; rows that repeat get ranks of their own. Empty tables give an empty
    result or, for the target, counts of 0. Other columns are ignored, whatever their names.
    """
    counts = stash(bucket_counts(docs, target, text, n, buckets), "buckets")
    groups = weigh(docs, gain_table(counts, buckets), doc_id, text, n, buckets).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    rows = groups.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("short", F.col("n_words") < min_words)
    placed = stash(ranked(rows, [F.col("short").asc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("digest").asc(), F.col("copy").asc()]), "placed")
    drawn = placed.select(F.expr(f"({percent} * count_if(NOT short)) div 100")).scalar()
    rank = F.when(~F.col("short") & (F.col("place") <= drawn), F.col("place"))
    return placed.select(F.col("id").alias(doc_id), "n_features", "weight", "score", rank.alias("rank"))


__all__ = ["bucket_counts", "gain_table", "grams", "noise", "ranked", "resample", "weigh"]
