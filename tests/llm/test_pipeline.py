import random
from collections import Counter, defaultdict

import pytest
from test_jaccard import grams
from test_mixing import targets
from test_substrings import brute as brute_repeats

import corpus_pipeline
from barwright.llm import toxicity
from barwright.llm.common import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(5)
    text = lambda n, bad: " ".join(rng.choice(["idiot", "scum"]) if bad and rng.random() < 0.08 else f"w{int(rng.paretovariate(0.5)) % 4000}" for _ in range(n))
    passage = text(40, False)
    rows, labels = [], []
    for k in range(240):
        bad = k % 6 == 0
        t = text(rng.randint(20, 200), bad) + (f" {passage} tail{k}" if k % 9 == 1 else "")
        rows.append((k, t, "en", f"src{k % 3}", len(t)))
        labels.append((k, 1, int(bad)))
    rows += [(1000 + k, rows[k][1] + " changed", "en", "src1", 1) for k in range(1, 60, 7)]
    rows += [(2000, None, None, None, None), (2001, "", None, "src0", 0), (2002, rows[7][1], "en", "src2", 3)]
    d = str(tmp_path_factory.mktemp("pipe"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_against_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        rows = out.collect()
        if name != "packing":
            assert out.schema == docs.schema or out.dtypes == docs.dtypes
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
            assert Counter(rows) == Counter(r for r in before if model.scores([r.text])[0] < 0.5)
            assert sum(r.doc_id % 6 == 0 for r in rows if r.doc_id < 240) <= 6 and sum(r.doc_id % 6 > 0 for r in rows if r.doc_id < 240) >= 197
        if name == "ngram_jaccard_join":
            sets = {r.doc_id: grams(r.text) for r in before}
            left = {r.doc_id for r in rows}
            near = lambda a, b: sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
            assert not any(near(a, b) for a in left for b in left if a < b)
            assert all(any(near(a, b) for b in left) for a in sets if sets[a] and a not in left)
            assert {2000, 2001} <= left and len(rows) == len(left)
        if name == "substring_dedup":
            want = {d: (n, gone) for d, n, gone, _ in brute_repeats([(r.doc_id, r.text) for r in before], 20)}
            old = {r.doc_id: r for r in before}
            for r in rows:
                n, gone = want[r.doc_id]
                assert len(words(r.text)) == n - gone and (gone or r == old[r.doc_id])
            assert any(gone for _, gone in want.values())
        if name == "mixing":
            sizes, taken = defaultdict(int), defaultdict(int)
            for r in before:
                sizes[r.source] += len(words(r.text))
            for r in rows:
                taken[r.source] += len(words(r.text))
            for s, t in targets(sizes).items():
                assert abs(taken[s] - t) <= 300
            assert set(rows) <= set(before) and max(Counter(rows).values()) <= 3
        if name == "packing":
            pieces = Counter((r.doc_id, r.start) for r in rows)
            copies = Counter(r.doc_id for r in before)
            assert all(pieces[d, 0] == n for d, n in copies.items())
        docs, before = out, rows


def test_run(spark, corpus):
    assert corpus_pipeline.run(spark, corpus).count() > 0


MADE = {"score": 7.5, "n_words": 1, "n_removed": "old", "removed_spans": 2, "score_": 3, "taken": 4, "target": 5, "class_id": 6, "N_WORDS_": 8}


def test_columns_of_the_input_stay_whatever_their_names(spark, corpus):
    plain = spark.read.parquet(f"{corpus}/documents.parquet")
    docs = plain.selectExpr("*", *[f"{v!r} AS `{k}`" for k, v in MADE.items()])
    for (name, stage), at in zip(corpus_pipeline.STAGES[:-1], range(4), strict=False):
        out = stage(spark, docs, corpus)
        assert [c for c, _ in out.dtypes] == docs.columns, name
        rows = out.collect()
        assert all(str(r[k]) == str(v) for r in rows for k, v in MADE.items()), name
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in stage(spark, plain, corpus).collect()), at


def test_empty_tables(spark, corpus):
    empty = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, corpus).collect() == []
