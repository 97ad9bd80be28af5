import hashlib
import random

import numpy as np
import pytest

from barwright.llm import substrings
from barwright.llm.common import words

SCHEMA = "doc_id long, text string, n_words string"


def brute(rows, n):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        w = words(text)
        gone = set()
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if key in seen:
                gone.update(range(i, i + n))
            seen.add(key)
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 300)) for _ in range(n))
    passages = [text(30) for _ in range(3)]
    rows = []
    for k in range(200):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), text(rng.randint(0, 40))]
        rows.append((rng.randint(0, 10**6), "\n ".join(parts)))
    rows += [(k, rows[3][1]) for k in (5, 500_001, 999_999, 1_000_001)]
    return rows + [(7, None), (8, ""), (9, "  \x0b "), (10, "ab " * 500), (None, passages[0]), (11, "é ü " * 25), (12, text(19)), (12, text(20))]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(substrings, "CELL_BYTES", 3000)
    monkeypatch.setattr(substrings, "RANGE_WINDOWS", 500)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)
    assert sorted(map(tuple, substrings.dedup_digest(df).collect()), key=str) == brute(rows, 20)


def test_texts_and_spans(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    df = spark.createDataFrame([(1, f"start  {passage} end", None), (2, f"other {passage}\tmore\n", "c"), (3, "left  alone\n", None)], SCHEMA)
    out = {r.doc_id: r for r in substrings.dedup(df).collect()}
    assert out[1].text == f"start  {passage} end" and out[3].text == "left  alone\n"
    assert out[2].text == "other more" and out[2].removed_spans == [1, 26] and out[2].n_removed == 25


def test_equal_rows_and_empty_table(spark):
    text = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(1, text, None)] * 3, SCHEMA)
    assert sorted(r.n_removed for r in substrings.dedup(df).collect()) == [0, 40, 40]
    assert substrings.dedup(df.limit(0)).collect() == []


def test_packing():
    rng = np.random.default_rng(0)
    for n in (1, 2, 1000):
        x = np.unique(rng.integers(0, 2**64, n, np.uint64))
        assert (substrings.unpack_sorted(substrings.pack_sorted(x)) == x).all()
    assert substrings.unpack_sorted(substrings.pack_sorted(np.array([5, 5 + 2**20], np.uint64))).tolist() == [5, 5 + 2**20]
