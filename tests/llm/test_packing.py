import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from test_huffman import ODD, library

from barwright.llm import packing

SCHEMA = "doc_id long, text string, length string"


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40)))
def test_patterns_hold_every_piece_once(hist):
    patterns = packing.pattern_counts(hist, 32)
    total = Counter()
    for count, pattern in patterns:
        assert count > 0 and sum(pattern) <= 32
        for length in pattern:
            total[length] += count
    assert total == hist
    ends = defaultdict(int)
    for length, lo, hi, _, _ in packing.slots(patterns):
        assert lo == ends[length]
        ends[length] = hi
    assert ends == hist


def test_little_padding():
    rng = random.Random(1)
    hist = Counter(rng.randint(1, 1024) for _ in range(50_000))
    packs = sum(c for c, _ in packing.pattern_counts(hist, 1024))
    assert packs * 1024 < 1.01 * sum(k * n for k, n in hist.items())


def test_pieces_against_the_library(spark):
    rng = random.Random(2)
    rows = [(k, ODD[k % len(ODD)], None) for k in range(60)] + [(k, "word " * rng.randint(1, 3000), "x") for k in range(60, 160)]
    rows += [(None, "no id", None), (7, "twice", None), (7, "twice", None)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(5), keep_ids=True).collect()
    ids = library()
    want = Counter()
    for doc, text, _ in rows:
        x = [*ids(text), 0]
        for a in range(0, len(x), 1024):
            own = x[a : a + 1024]
            want[doc, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), len(x), tuple(own)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, tuple(r.ids)) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(by) == list(range(len(by)))


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []
