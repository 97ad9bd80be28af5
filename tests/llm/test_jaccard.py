import random

import numpy as np
import pytest

from barwright.llm import jaccard
from barwright.llm.common import words

SCHEMA = "doc_id long, text string, label string, key string"


def grams(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows):
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        r = find(k)
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    return sorted(((doc, least[find(k)], links[k]) for k, (doc, _) in enumerate(rows)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    rows = []
    for _ in range(40):
        base = text(rng.randint(30, 200))
        for _ in range(rng.choice([1, 1, 2, 12])):
            near = list(base)
            for _ in range(rng.randint(0, 5)):
                near[rng.randrange(len(near))] = f"x{rng.randint(0, 10**6)}"
            rows.append((rng.randint(0, 10**6), " ".join(near)))
    rows += [(k, rows[0][1].replace(" ", "\n")) for k in (1, 2, 3)]
    rows += [(11, None), (12, ""), (13, " \t "), (14, "short one"), (15, "short  one"), (16, "other"), (None, rows[5][1]), (17, "rep " * 3000), (18, "rep " * 9), (19, "same row"), (19, "same row")]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, monkeypatch, seed):
    # With one class beside another already hot, everything is compared in blocks; with seed 2 only large groups are.
    monkeypatch.setattr(jaccard, "BLOCK", 5 if seed == 1 else 1000)
    monkeypatch.setattr(jaccard, "HOT", {1: 1, 2: 4, 3: 32}[seed])
    rows = corpus(seed)
    out = jaccard.join(spark.createDataFrame([(*r, None, "x") for r in rows], SCHEMA).repartition(4)).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in out), key=str) == brute(rows)


def test_keep_one(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    out = jaccard.keep_one(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id is not None)
    want = sorted({(d, c) for d, c, _ in brute(rows) if d == c and d is not None})
    assert [d for d, _ in got] == sorted(d for d, _ in want)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert jaccard.join(df).collect() == [] and jaccard.keep_one(df).collect() == []


def test_bands_reach_the_recall():
    bands, rows = jaccard.band_shape()
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    rng = np.random.default_rng(0)
    minhash, met = jaccard.MinHash(bands, rows), 0
    for _ in range(200):
        every = np.unique(rng.integers(0, 2**63, 100).astype(np.uint64))
        met += bool((minhash(every[:90]) == minhash(every[10:])).any())
    assert met >= 198


def test_columns_with_the_names_of_the_plan_stay(spark):
    names = ["_hash", "_id", "_text", "id", "hash", "own", "group", "key", "class_id", "text_hash", "n_links"]
    rows = [(1, "a b c d e f", *names), (2, "a b c d e f", *names), (3, None, *names), (4, "", *names), (4, "", *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    out = jaccard.keep_one(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=str) == sorted([rows[0], *rows[2:]], key=str)


def test_very_long_text_and_chain_of_near_copies(spark):
    long = [f"v{k % 7001}x{k % 97}" for k in range(300_000)]
    chain = [f"c{k}" for k in range(400)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:250_000]))] + [(10 + k, " ".join(chain[8 * k : 200 + 8 * k])) for k in range(20)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted((d, *x) for d, x in got.items()) == sorted(brute(rows))
    assert got[29] == (10, 2)
