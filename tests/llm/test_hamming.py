import random

import numpy as np
import pytest

from barwright.llm import hamming

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


@pytest.mark.parametrize(("n", "bits", "flip"), [(3000, 64, 0.05), (3000, 64, 0.5), (40, 128, 0.2), (1, 64, 0.1), (5000, 64, 0.2)])
def test_index_against_brute_force(n, bits, flip):
    rng = np.random.default_rng(n)
    centres = rng.random((max(1, n // 50), bits)) < 0.5
    points = centres[rng.integers(0, len(centres), n)] ^ (rng.random((n, bits)) < flip)
    codes = np.unique(np.packbits(points, axis=1, bitorder="little").view("<u8"), axis=0)
    weights = rng.integers(1, 4, len(codes))
    asked = codes[rng.integers(0, len(codes), 30)] ^ rng.integers(0, 4, (30, 1)).astype(np.uint64)
    for q, (found, distances) in zip(asked, hamming.Index(codes).search(asked, weights, 7), strict=True):
        d = np.bitwise_count(codes ^ q).sum(1)
        limit = np.sort(np.repeat(d, weights))[min(7, weights.sum()) - 1]
        assert sorted(found.tolist()) == np.flatnonzero(d <= limit).tolist()
        assert (d[found] == distances).all()


def test_wide_uniform_codes_are_searched_by_their_segments():
    """128 random bits: the tenth nearest of 30,000 codes is some 44 bits off, a radius of 5 in each of 9 segments."""
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 1 << 63, (30_000, 2), dtype=np.uint64) << np.uint64(1) | rng.integers(0, 2, (30_000, 2), dtype=np.uint64)
    asked = rng.integers(0, 1 << 63, (12, 2), dtype=np.uint64)
    index = hamming.Index(codes)
    reached = []
    masks = index.masks
    index.masks = lambda w, r: reached.append(r) or masks(w, r)
    for q, (found, distances) in zip(asked, index.search(asked, np.ones(len(codes), np.int64), 10), strict=True):
        d = np.bitwise_count(codes ^ q).sum(1)
        assert sorted(found.tolist()) == np.flatnonzero(d <= np.sort(d)[9]).tolist()
        assert (d[found] == distances).all()
    assert index.scans == 0 and max(reached) >= 5


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(hamming, "BLOCK", block)
    monkeypatch.setattr(hamming, "QUERIES", 7)
    monkeypatch.setattr(hamming, "LEAST_QUERIES", 4)
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1) for _ in range(20)]) for k in range(300)] + [(k, [1.0, -1.0] * 10) for k in range(300, 400)]
    rows += [(400, None), (None, [1.0] * 20), (401, []), (402, [float("nan"), None] * 10), (420, [1.0]), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = {}
    for r in hamming.top_k(df, df.filter("vec_id % 20 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.vec_id))
    bits = lambda v: [(v[i] if i < len(v) and v[i] is not None else 0) > 0 for i in range(20)]
    valid = [(i, bits(v)) for i, v in rows if i is not None and v is not None]
    for q, b in valid:
        if q % 20 == 0:
            want = sorted((sum(x != y for x, y in zip(b, c, strict=True)), i) for i, c in valid)[:5]
            assert [x[1:] for x in sorted(got.pop(q))] == want
    assert not got


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hamming.top_k(df, df).collect() == []
