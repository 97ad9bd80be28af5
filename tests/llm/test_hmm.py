import itertools
import math
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from barwright.llm import hmm
from barwright.llm.common import words

SCHEMA = "doc_id long, text string, held string"


def small(states=3, seed=1):
    rng = np.random.default_rng(seed)
    stats = np.concatenate([[50.0, 1000.0, 20.0, 10.0], rng.integers(0, 9, hmm.CLASSES + 1), np.ones(hmm.CLASSES + 1)])
    model = hmm.initial(stats, states, seed)
    model.start = rng.dirichlet(np.ones(states))
    model.move = rng.dirichlet(np.ones(states), states)
    return model


def every_path(model, symbols):
    emit = np.vstack([model.emit.T, np.full((1, len(model.start)), model.unseen)])
    total = 0.0
    for path in itertools.product(range(len(model.start)), repeat=len(symbols)):
        p = model.start[path[0]] * emit[symbols[0], path[0]]
        for a, b, s in zip(path, path[1:], symbols[1:], strict=False):
            p *= model.move[a, b] * emit[s, b]
        total += p
    return math.log(total)


def test_forward_sums_all_paths():
    model = small()
    seqs = [[5, 9, 9, 2], [hmm.CLASSES], [hmm.CLASSES + 1, 7, hmm.CLASSES], [1, 2, 3, 4, 5, 6]]
    got = model.forward(np.concatenate(seqs), np.array([len(s) for s in seqs]))
    assert np.allclose(got, [every_path(model, s) for s in seqs], rtol=1e-12)


def test_expected_counts_sum_up_and_likelihood_rises(monkeypatch):
    monkeypatch.setattr(hmm, "PRIOR_EMIT", 1e-3)
    monkeypatch.setattr(hmm, "PRIOR_MOVE", 1e-3)
    model = small(2)
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 60, 80)
    symbols = np.concatenate([rng.integers(0, 40, n) + 40 * (k % 2) for k, n in enumerate(sizes)])
    last = -np.inf
    for _ in range(8):
        total = model.expected(symbols, sizes)
        assert np.isclose(total[:2].sum(), len(sizes)) and np.isclose(total[2:6].sum(), (sizes - 1).sum()) and np.isclose(total[6:].sum(), sizes.sum())
        now = model.forward(symbols, sizes).sum()
        assert now > last - 1.0
        last, model = now, model.improved(total)


def corpus():
    rng = random.Random(4)
    rows = []
    for k in range(300):
        names = [f"{'ab'[k % 2]}{j}" for j in range(60)]
        rows.append((k, " ".join(rng.choice(names).upper() if rng.random() < 0.2 else rng.choice(names) for _ in range(rng.randint(0, 300)))))
    return rows + [(900, None), (901, ""), (None, "a1 new words É é"), (902, "long " * 30000), (7, "twice"), (7, "twice")]


@pytest.mark.parametrize("block", [2000, 1 << 23])
def test_base_and_held_out(spark, monkeypatch, block):
    monkeypatch.setattr(hmm, "BLOCK_BYTES", block)
    rows = corpus()
    got = hmm.score(spark.createDataFrame([(*r, None) for r in rows], SCHEMA).repartition(3), states=3, rounds=6).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    tokens = lambda t: [w.lower() for w in words(t)] + [None]
    count = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = []
    for d, t in rows:
        x = tokens(t)
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)
        want.append((d, held(d), len(x), sum(count[w] > 0 for w in x), n, round(base, 6)))
    assert sorted((tuple(r)[:5] + (round(r.base_score, 6),) for r in got), key=str) == sorted(want, key=str)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_empty_table(spark):
    assert hmm.score(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("batch", [1 << 20, 40])
def test_spans_change_nothing(monkeypatch, batch):
    model = small(4, 7)
    rng = np.random.default_rng(3)
    sizes = np.array([1, 5, 6, 7, 12, 13, 100, 3, 18, 250])
    symbols = rng.integers(0, 50, sizes.sum())
    whole = model.expected(symbols, sizes)
    monkeypatch.setattr(hmm, "SPAN", 6)
    monkeypatch.setattr(hmm, "BATCH", batch)
    assert np.allclose(model.expected(symbols, sizes), whole, rtol=1e-9, atol=1e-12)


def test_expected_counts_by_brute_force():
    model, seqs = small(3, 2), [[5, 9, 9, 2, 7], [hmm.CLASSES], [1, 2, 3]]
    k, want = 3, np.zeros(3 * (1 + 3 + hmm.CLASSES + 1))
    starts, moves, emits = want[:k], want[k : k + k * k].reshape(k, k), want[k + k * k :].reshape(k, -1)
    for s in seqs:
        weights = {}
        for path in itertools.product(range(k), repeat=len(s)):
            p = model.start[path[0]] * model.emit[path[0], s[0]]
            for a, b, x in zip(path, path[1:], s[1:], strict=False):
                p *= model.move[a, b] * model.emit[b, x]
            weights[path] = p
        total = sum(weights.values())
        for path, p in weights.items():
            starts[path[0]] += p / total
            for a, b in zip(path, path[1:], strict=False):
                moves[a, b] += p / total
            for z, x in zip(path, s, strict=True):
                emits[z, x] += p / total
    got = model.expected(np.concatenate(seqs), np.array([len(s) for s in seqs]))
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12)


def test_words_are_numbered_as_they_stand():
    texts = [" A b\x0b\x0cÉ\r\n", "", None, "b", " \t ", "x\x1cy\x85 z\xa0B b", "a "]
    codes, sizes, hashes = hmm._number(pa.array(texts, pa.string()))
    tokens = [[w.lower() for w in words(t)] + [b""] for t in texts]
    kinds = list(dict.fromkeys(w for t in tokens for w in t if w))
    by_word = dict(zip(kinds, hmm.hash_words(kinds), strict=True)) | {b"": hmm.END_HASH}
    assert sizes.tolist() == [len(t) for t in tokens]
    assert hashes[codes].tolist() == [by_word[w] for t in tokens for w in t]
    assert len(hashes) == len(by_word) and np.array_equal(codes == 0, hashes[codes] == hmm.END_HASH)


@pytest.mark.parametrize("size", [2000, 1 << 23])
def test_blocks_hold_classes_of_training_texts(monkeypatch, size):
    monkeypatch.setattr(hmm, "BLOCK_BYTES", size)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 3))
    texts = ["word " * (50 * (k % 3)) + f"own{k}" for k in range(40)] + [None, "long " * 3000, "", "é"]
    rows = [(k or None, k % 4 == 0, t) for k, t in enumerate(texts)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.int64(), pa.bool_(), pa.string()), strict=True)], ["doc_id", "held", "text"]) for part in (rows[:9], rows[9:])]
    blocks = [b.to_pylist()[0] for b in hmm._read(iter(batches))]
    got = lambda b, *names: [np.frombuffer(b[n], t) for n, t in names]
    assert [b["block"] for b in blocks] == [(3 << 32) + k + 1 for k in range(len(blocks))] and (len(blocks) > 1) == (size == 2000)
    seen = []
    for b in blocks:
        docs, nulls, held, sizes, codes, hashes, lengths, symbols = got(b, ("docs", np.int64), ("nulls", bool), ("held", bool), ("sizes", np.int32), ("codes", np.int32), ("hashes", np.uint64), ("lengths", np.int32), ("symbols", np.uint16))
        kept = codes[np.repeat(~held, sizes)]
        assert np.array_equal(lengths, sizes[~held]) and np.array_equal(symbols, hmm.classes_of(hashes)[kept])
        assert np.array_equal(got(b, ("train", np.uint32))[0], np.bincount(kept, minlength=len(hashes)))
        seen += zip([None if n else int(d) for d, n in zip(docs, nulls, strict=True)], held.tolist(), sizes.tolist(), strict=True)
        # A block is full with the row that brings it over its size.
        assert sum(len((texts[d or 0] or "").encode()) for d in docs[:-1]) <= size
    assert seen == [(d, h, len(words(t)) + 1) for d, h, t in rows]


def test_vectors_are_summed_by_rows_of_several_values(spark):
    rows = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0), (0, 10.0, 20.0)], "place long, x0 double, x1 double")
    assert hmm.vector_sum(rows, 6).tolist() == [11.0, 22.0, 3.0, 4.0, 0.0, 0.0]
