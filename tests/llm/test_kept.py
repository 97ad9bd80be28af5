import gc
import weakref

import pyarrow as pa
import pytest

from barwright.llm import jaccard, substrings, tokens, toxicity
from barwright.llm.common import KEPT, tidied, tidied_batches

TEXTS = [f"w{k} and w{k + 1} stand in text {k}" for k in range(30)]
DOCS = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(30), pa.int64()), "text": TEXTS})
SIGNED = DOCS.append_column("text_hash", pa.array([0] * 30, pa.int64()))
SETS = DOCS.append_column("key", pa.array([b""] * 30))
LABELLED = pa.RecordBatch.from_pydict({"text": TEXTS, "toxic": pa.array([0, 1] * 15, pa.int64())})
CELL = pa.table({"docs": [substrings.pack_table(pa.Table.from_batches([DOCS]))]})
PACKED = pa.table({"cell": [1], "hashes": [b"\x01\x00\x07"]})
BITS = pa.table({"range": pa.array([], pa.int64()), "bits": pa.array([], pa.binary())})
CLASSES = pa.table({"key": pa.array([], pa.binary()), "grams": pa.array([], pa.binary()), "copies": pa.array([], pa.int64())})
PAIRS = pa.table({c: pa.array([], pa.binary()) for c in ("anchor", "a", "b")})
BLOCKS = CLASSES.append_column("label", pa.array([], pa.binary())).append_column("i", pa.array([], pa.int32())).append_column("j", pa.array([], pa.int32())).append_column("block", pa.array([], pa.int32()))

#: The tasks that stages of the pipeline run in Python, but for those of packing.
TASKS = {
    "toxicity, counts": lambda: list(tidied_batches(toxicity._counts)(iter([LABELLED]))),
    "jaccard, signatures": lambda: list(jaccard._sign(5, 2, 2)(iter([SIGNED]))),
    "jaccard, sets": lambda: list(jaccard._sets(5)(iter([SETS]))),
    "jaccard, pairs": lambda: jaccard._compare_pairs(0.8)(CLASSES, PAIRS),
    "jaccard, blocks": lambda: jaccard._compare_blocks(0.8)((0,), BLOCKS),
    "substrings, cells": lambda: list(substrings.deal([10])(iter([DOCS]))),
    "substrings, hashes": lambda: substrings._send(5, 1)((pa.scalar(0),), CELL),
    "substrings, ranges": lambda: tidied(substrings._compare)((pa.scalar(0),), PACKED),
    "substrings, removal": lambda: substrings._finish(5, 1, False, ["doc_id", "text"])(CELL, BITS),
}


@pytest.mark.parametrize("task", TASKS)
def test_other_tasks_of_a_worker_drop_the_encoder(task):
    path = tokens.default_path()
    before = tokens.encoder(path)
    ids = [x.tolist() for x in before(TEXTS)]
    assert tokens.encoder(path) is before and before.known.numbers
    gone = weakref.ref(before)
    del before
    TASKS[task]()
    gc.collect()
    assert gone() is None and not KEPT
    assert [x.tolist() for x in tokens.encoder(path)(TEXTS)] == ids


def test_scoring_and_calibration_drop_the_encoder(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t, k % 2) for k, t in enumerate(TEXTS)], "doc_id long, text string, toxic long")
    model = toxicity.fit(docs)
    runs, own = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(run) or own(self, run, schema))
    toxicity.score(docs.select("doc_id", "text"), model)
    toxicity.calibrate(model, docs.select("text", "toxic"))
    for run, batch in zip(runs, (DOCS, LABELLED), strict=True):
        tokens.encoder(tokens.default_path())
        assert sum(x.num_rows for x in run(iter([batch]))) == len(TEXTS) and not KEPT


def test_windows_are_the_same_in_parts(monkeypatch):
    texts = [None, "a b", *(" ".join(f"w{(k * j) % 11}" for j in range(k)) for k in range(60)), ""]
    whole = substrings.window_hashes(texts, 5)
    assert len(whole[0]) == sum(max(0, k - 4) for k in range(60))
    for words in (1, 7, 100):
        monkeypatch.setattr(substrings, "PART_WORDS", words)
        for a, b in zip(whole, substrings.window_hashes(texts, 5), strict=True):
            assert list(a) == list(b)
