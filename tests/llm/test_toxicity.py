import random

import numpy as np

from barwright.llm import toxicity

SCHEMA = "doc_id long, text string, toxic int, score string"


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        toxic = int(rng.random() < 0.2)
        text = [f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(rng.randint(40, 400))]
        for at in rng.sample(range(len(text)), len(text) // 25):
            text[at] = rng.choice(["Idiot,", "SCUM", "moron."]) if toxic else rng.choice(["friend", "thanks,", "please"])
        rows.append((k, " ".join(text), toxic, "clash"))
    return rows


def test_held_out_accuracy_and_inputs(spark):
    rows = corpus(600)
    df = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.train(df, df.select("doc_id", "toxic"))
    extra = [(1000, None, None, None), (1001, "", None, None), (1002, " \n", None, None), (None, "idiot " * 50000, None, None), (1003, "you moron, scum. idiot", None, None)]
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    got = {r.doc_id: r for r in toxicity.classify(docs, model).collect()}
    assert len(got) == len(rows) + len(extra)
    own = [(got[k], t) for k, _, t, _ in rows if got[k].held_out]
    assert 60 < len(own) < 200
    assert np.mean([r.predicted == t for r, t in own]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[1000].score == got[1001].score == got[1002].score < 0.5
    assert got[None].predicted == got[1003].predicted == 1 and got[None].held_out is False
    flipped = df.withColumn("toxic", df.toxic * 0 + (df.doc_id % 2).cast("int"))
    changed = toxicity.train(df, df.select("doc_id", "toxic").filter(toxicity.held_out(5)).unionByName(df.select("doc_id", "toxic").filter(~toxicity.held_out(5))))
    assert np.allclose([changed.slope, changed.offset], [model.slope, model.offset])
    assert toxicity.train(df, flipped.select("doc_id", "toxic")).slope != model.slope


def test_one_class_and_no_labels(spark):
    df = spark.createDataFrame([(k, f"a b {k}", 0, None) for k in range(20)], SCHEMA)
    model = toxicity.fit(df)
    assert all(r.score < 0.5 for r in toxicity.score(df, model).collect())
    none = toxicity.fit(df.limit(0))
    assert {r.score for r in toxicity.score(df, none).collect()} == {0.5}
    assert toxicity.score(df.limit(0), none).collect() == []


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "a", 0, "clash"), (1, "a", 0, "clash")], SCHEMA)
    out = toxicity.score(df, toxicity.fit(df))
    assert out.columns == ["doc_id", "text", "toxic", "score"] and out.count() == 2


def brute_margins(rows, asked, own=None):
    """Per-token difference of the two log-likelihoods, from dictionaries. ``own``: the class of asked texts that were trained on."""
    strip = ".,;:!?\"'()[]*&%$#"
    split = lambda text: [w.strip(strip) for w in text.lower().split()]
    words, pairs = {}, {}
    for text, toxic in dict(rows).items():
        tokens = split(text)
        for x in set(tokens):
            words.setdefault(x, [0, 0])[toxic] += 1
        for x in set(zip(["<s>", *tokens], tokens, strict=False)):
            pairs.setdefault(x, [0, 0])[toxic] += 1
    total = [sum(n[k] for n in words.values()) for k in (0, 1)]
    share = [t / sum(total) for t in total]
    keep = lambda n, k, sd: max(n[k] - sum(n) * share[k] - sd * (sum(n) * share[k]) ** 0.5, 0)
    follows = {}
    for _, w in pairs:
        follows[w] = follows.get(w, 0) + 1
    shared = lambda w: (follows.get(w, 0) + 0.5) / (len(pairs) + 0.5 * (len(words) + 1))
    freed = [1 - sum(keep(n, k, toxicity.WORD_SD) for n in words.values()) / total[k] for k in (0, 1)]
    context = [{}, {}]
    kept = [{}, {}]
    for (v, _), n in pairs.items():
        for k in (0, 1):
            context[k][v] = context[k].get(v, 0) + n[k]
            kept[k][v] = kept[k].get(v, 0) + keep(n, k, toxicity.PAIR_SD)
    out = []
    for at, text in enumerate(asked):
        tokens, sums = split(text), [0.0, 0.0]
        for v, w in zip(["<s>", *tokens], tokens, strict=False):
            for k in (0, 1):
                less = lambda n: n if own is None else [max(n[j] - (own[at] == j), 0) for j in (0, 1)]
                p = keep(less(words.get(w, [0, 0])), k, toxicity.WORD_SD) / total[k] + freed[k] * shared(w)
                c = context[k].get(v, 0)
                if c:
                    p = keep(less(pairs.get((v, w), [0, 0])), k, toxicity.PAIR_SD) / c + (1 - kept[k][v] / c) * p
                sums[k] += np.log(p)
        out.append((sums[1] - sums[0]) / max(len(tokens), 1))
    return np.array(out)


def test_counts_and_likelihoods_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, text + (" utter garbage you moron" if toxic else " you friend"), toxic, None) for k, text, toxic, _ in corpus(1500, 2)]
    rows += [(5000 + k, rows[k][1], rows[k][2], None) for k in range(40)]  # equal texts count once
    rng.shuffle(rows)
    model = toxicity.fit(spark.createDataFrame(rows, SCHEMA))
    assert len(model.pairs) and len(model.contexts) and {"moron", "scum", "idiot"} <= {w for w in ("moron", "scum", "idiot") if toxicity.hash_words([w.encode()]).view(np.int64)[0] in model.words}
    train = [(r[1], r[2]) for r in rows]
    asked = [r[1] for r in rows[:60]] + ["utter garbage", "garbage utter scum", "never seen words", "utter nonsense, you moron you"]
    assert np.allclose(model.margins(asked), brute_margins(train, asked), atol=1e-9)
    own = np.array([r[2] for r in rows[:60]])
    assert np.allclose(model.margins(asked[:60], own), brute_margins(train, asked[:60], own), atol=1e-9)


def test_input_labels_language_and_source_do_not_matter(spark):
    rows = corpus(300)
    model = toxicity.fit(spark.createDataFrame(rows, SCHEMA))
    plain = spark.createDataFrame([(k, t, None, None) for k, t, _, _ in rows], SCHEMA)
    a = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert a == {r.doc_id: r.score for r in toxicity.score(plain, model).collect()}
