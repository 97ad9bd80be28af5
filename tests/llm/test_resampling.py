import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from barwright.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, n=1):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, n=1, buckets=10_000, seed="2024", min_words=20, percent=10):
    of = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(of(g) for _, t in rows for g in features(t, n)[1])
    t = Counter(of(g) for x in target for g in features(x, n)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        words, grams = features(text, n)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[of(g)] for g in grams)
        out.append([i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= min_words])
    ranks = {}
    drawn = sorted((k for k, r in enumerate(out) if r[4]), key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    for place, k in enumerate(drawn[: percent * len(drawn) // 100]):
        ranks[k] = place + 1
    return [(*r[:4], ranks.get(k)) for k, r in enumerate(out)]


def some_rows():
    texts = [None, "", " -- ", "One two", "İß été ÉTÉ 日本語 x1y2", "a b " * 30, "The quick brown fox " * 8, "long " * 20_000]
    rows = [(k, texts[k % len(texts)] if k % 5 else " ".join(f"w{(k * j) % 37}" for j in range(k % 60))) for k in range(120)]
    return rows + [(7, "again and again " * 9)] * 40 + [(None, "no id but words " * 7), (8, "other text of the same id " * 5)]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_scores_and_ranks_by_brute_force(spark):
    rows, target = some_rows(), ["the quick fox", "again one two three", None, "w1 w2 w3 w3"]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gain", F.lit("old")).withColumn("bucket", F.lit(1)).repartition(6)
    other = spark.createDataFrame([(t,) for t in target], "text string")
    for options in ({}, {"n": 3, "buckets": 50, "percent": 40, "min_words": 3, "seed": "x"}):
        got = [tuple(r) for r in resampling.resample(df, other, **options).collect()]
        assert ordered(got) == ordered(brute(rows, target, **options))
        ranks = sorted(r[4] for r in got if r[4])
        assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_ranks_over_many_partitions(spark):
    df = spark.range(5000).withColumn("k", F.col("id") % 7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = [r.id for r in resampling.ranked(df, [F.col("k").desc(), F.col("id").asc()]).orderBy("place").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == sorted(range(5000), key=lambda x: (-(x % 7), x))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    full = spark.createDataFrame([(1, "word " * 25), (2, None)], "doc_id long, text string")
    assert resampling.resample(empty, full).collect() == []
    rows = [(1, "word " * 25), (2, None)]
    assert ordered(map(tuple, resampling.resample(full, empty, percent=100).collect())) == ordered(brute(rows, [], percent=100))


def test_no_python_in_the_plan(spark):
    df = spark.range(3).selectExpr("id AS doc_id", "'a b' AS text")
    plan = resampling.weigh(df, resampling.gain_table(resampling.bucket_counts(df, df)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
