from collections import defaultdict

from pyspark.sql import Row

from barwright.llm import mixing
from barwright.llm.common import words

SCHEMA = "doc_id long, text string, source string, size string"


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Shares by weight, resharing the excess until nothing is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    out, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def rows():
    texts = []
    for k in range(600):
        source = ["b", "a", "ß", None, "z\U0001f600", "", "tiny"][k % 7] if k % 3 else "a"
        n = 3000 if k == 77 else (k * 37) % 90
        texts.append((k, " ".join(f"w{k}" for _ in range(n)) if k % 41 else None, source, "clash"))
    texts += [(5, "same row twice", "a", "clash")] * 2 + [(None, "no id here", "b", "clash"), (900, "x", "one", None)]
    return texts


def test_targets_and_copies(spark):
    got = mixing.mix(spark.createDataFrame(rows(), SCHEMA)).collect()
    assert len(got) == len(rows())
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r.size == len(words(r.text)) and 0 <= r.copies <= 3
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert all(r.source_size == sizes[r.source] for r in got)
    want = targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= largest[s] + 1
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-3


def test_longer_documents_are_likelier_and_reruns_agree(spark):
    texts = [(k, "w " * (4 if k % 2 else 400), ["a", "b", "c"][k % 3], None) for k in range(3000)]
    df = spark.createDataFrame(texts, SCHEMA)
    a = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    b = {r.doc_id: r.copies for r in mixing.mix(df.repartition(5)).collect()}
    assert a == b
    mean = lambda odd: sum(a[k] for k in a if k % 3 == 1 and k % 2 == odd) / 500
    assert 0 < mean(1) < mean(0)


def test_mixed_repeats_rows_and_keeps_columns(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert out.count() == sum(r.copies for r in mixing.mix(df).collect())


def test_empty_table_and_all_empty_texts(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, None, "a", None), (2, "", None, None)], SCHEMA)).collect()
    assert [(r.size, r.source_size, r.target, r.copies) for r in got] == [(0, 0, 0.0, 0)] * 2


def test_columns_with_the_names_of_the_plan_stay(spark):
    names = ["part", "cut", "whole", "class", "tie", "uniform", "_s", "share", "rest", "weight", "copy", "_0"]
    rows = [(k, f"a{k} b c d", "ab"[k % 2], *names, 7, "t") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names) + ", copies int, target string")
    got = mixing.mix(df)
    assert got.columns == [*df.columns[:-2], *mixing.ADDED]
    assert all([r[c] for c in names] == names for r in got.collect()) and got.count() == 40
    out = mixing.mixed(df)
    assert out.columns == df.columns and all(r.copies == 7 and r.target == "t" and r.part == "part" for r in out.collect())


def test_pareto_order_by_brute_force(spark):
    import math

    rows = [(k, " ".join(["w"] * (1 + k * 7 % 50)), ["a", "b"][k % 2]) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    draws = {r.doc_id: r for r in mixing.with_draws(df, 20).collect()}
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    for s in "ab":
        own = [k for k, _, source in rows if source == s]
        target = got[own[0]].target
        size = {k: draws[k].size for k in own}
        bits = {k: size[k].bit_length() for k in own}
        # Expected copies are c * bits, at most 3, with the words of all copies at the target.
        lo, hi = 0.0, 3.0
        for _ in range(200):
            c = (lo + hi) / 2
            lo, hi = (c, hi) if sum(min(c * bits[k], 3) * size[k] for k in own) < target else (lo, c)
        copies = {k: round(min(c * bits[k], 3), 9) for k in own}
        whole = {k: math.floor(copies[k]) for k in own}
        part = {k: copies[k] - whole[k] for k in own}
        odds = {k: draws[k].uniform / (1 - draws[k].uniform) / (part[k] / (1 - part[k])) for k in own if part[k] > 0}
        words, want = sum(whole[k] * size[k] for k in own), dict(whole)
        for k in sorted(odds, key=odds.get):
            if words + size[k] / 2 > target:
                break
            words += size[k]
            want[k] += 1
        assert {k: got[k].copies for k in own} == want
