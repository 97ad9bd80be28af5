"""Toxicity: class-conditional Kneser-Ney models of toxic and of ordinary texts, compared by length-normalised log-likelihood.

Each class has a bigram model that backs off to its words and from there to one shared distribution: how many different words each word has followed, in
either class. Counts are of texts (an expression repeated within a text counts once there, equal texts count once), since a passage that one text repeats says nothing of its class. The
discount of a count is what the shared counts of both classes lead one to expect, and some standard deviations more, so that rare expressions keep no mass
of their own: they are smoothed through the shared backoff, which cancels in the comparison. What is left are the expressions that mark a class, a small table.

Counts are taken in Spark, over the labelled training texts, at most ``SAMPLE`` of each class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import MULTIPLIER, arrow_rows, hash_words, intern_words, mix, stash, tidied_batches

#: Labelled texts of each class that the models are fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 8000
#: Standard deviations that the discounts of words and of pairs go beyond the expected count. Pairs come in passages, which many texts share.
WORD_SD, PAIR_SD = 5.0, 10.0
#: Characters that are not part of a word for these models.
_STRIP = b".,;:!?\"'()[]*&%$#"
#: Context of a text's first word.
START = np.int64(0)


def _coded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every token of some texts and of the word before it, and each text's tokens."""
    table, codes, sizes = intern_words(texts, lower=True)
    words = hash_words([w.strip(_STRIP) for w in table]).view(np.int64)[codes]
    before = np.empty_like(words)
    before[1:] = words[:-1]
    ends = np.cumsum(sizes)
    before[(ends - sizes)[sizes > 0]] = START
    return words, before, sizes


def pair_key(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before.view(np.uint64) * MULTIPLIER + words.view(np.uint64)).view(np.int64)


def excess(own: np.ndarray, both: np.ndarray, share: float, sd: float) -> np.ndarray:
    """What a class's counts keep after the discount: the shared expectation and ``sd`` standard deviations."""
    expected = both * share
    return np.maximum(own - expected - sd * np.sqrt(expected), 0)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in ascending ``keys``, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    """Counts of the expressions with mass of their own. Class 0 is ordinary, class 1 toxic.

    ``words``: ascending hashes, with ``word_counts`` of each class and ``backoff``, their shared probabilities. ``pairs``: ascending keys with their counts.
    ``contexts``: ascending hashes of the words before such pairs, with the class's count of each and what its pairs keep of it. ``totals``: words of each class.
    ``freed``: share of each class's words that its discounts free. ``slope`` and ``offset`` turn a margin into the log odds of label 1; ``prior`` is the score of
    a text without words.
    """

    words: np.ndarray
    word_counts: np.ndarray
    backoff: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray
    contexts: np.ndarray
    context_counts: np.ndarray
    context_kept: np.ndarray
    totals: np.ndarray
    freed: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    prior: float = 0.5

    def likelihoods(self, words: np.ndarray, before: np.ndarray, label: np.ndarray | None = None) -> list[np.ndarray]:
        """Log-likelihood of every token under each class; a word without mass of its own has the shared factor left out in both.

        With ``label``, that of each token's text, the text's own counts are taken out: it counted every expression once.
        """
        share = self.totals / max(self.totals.sum(), 1)
        at, known = _find(self.words, words)
        context, marked = _find(self.contexts, before)
        near = np.flatnonzero(marked)
        pair, listed = _find(self.pairs, pair_key(before[near], words[near]))
        out = []
        for k in (0, 1):
            p = np.full(len(words), self.freed[k])
            rows = at[known]
            own = 0 if label is None else (label[known] == k).astype(float)
            less = 0 if label is None else 1.0
            both = np.maximum(self.word_counts[rows].sum(1) - less, 0)
            kept = excess(self.word_counts[rows, k] - own, both, share[k], WORD_SD)
            p[known] = kept / max(self.totals[k], 1) / self.backoff[rows] + self.freed[k]
            c = context[near]
            n = np.maximum(self.context_counts[c, k], 1)
            seen = np.where(listed, 1.0, 0.0)[:, None] * (self.pair_counts[pair] if len(self.pairs) else np.zeros((len(near), 2)))
            own = 0 if label is None else (label[near] == k) * listed.astype(float)
            kept = excess(seen[:, k] - own, np.maximum(seen.sum(1) - (0 if label is None else listed), 0), share[k], PAIR_SD)
            # The words of listed pairs are all in the word table, so their shared factor is known.
            factor = np.where(known[near], self.backoff[at[near]] if len(self.words) else 1.0, 1.0)
            p[near] = np.where(self.context_counts[c, k] > 0, kept / n / factor + (1 - self.context_kept[c, k] / n) * p[near], p[near])
            out.append(np.log(p))
        return out

    def margins(self, texts: list[str | None], labels: np.ndarray | None = None) -> np.ndarray:
        """Toxic less ordinary log-likelihood per token, NaN for texts without words. With ``labels`` the texts are of the training sample."""
        words, before, sizes = _coded(texts)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        ordinary, toxic = self.likelihoods(words, before, None if labels is None else labels[owner])
        return np.where(sizes > 0, np.bincount(owner, toxic - ordinary, len(sizes)) / np.maximum(sizes, 1), np.nan)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        odds = 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -30, 30)))
        return np.where(np.isnan(odds), self.prior, odds)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class that hold an expression: a pair (before, word), or a word, where before is null."""
    for batch in batches:
        labels = np.asarray(batch.column(1))
        words, before, sizes = _coded(batch.column(0).to_pylist())
        owner = np.repeat(np.arange(len(sizes)), sizes)
        for pairs in (True, False):
            first = before if pairs else np.zeros_like(words)
            order = np.lexsort((owner, words, first))
            f, w, o = first[order], words[order], owner[order]
            new = np.ones(len(o), bool)
            new[1:] = (f[1:] != f[:-1]) | (w[1:] != w[:-1])
            once = new.copy()
            once[1:] |= o[1:] != o[:-1]
            group, toxic = np.cumsum(new)[once] - 1, labels[o[once]]
            n = [np.bincount(group, toxic == k, int(new.sum())).astype(np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_pydict({
                "before": pa.array(f[new]) if pairs else pa.nulls(int(new.sum()), pa.int64()), "word": pa.array(w[new]), "n0": pa.array(n[0]), "n1": pa.array(n[1]),
            })


def _table(rows: DataFrame, keys: list[str], values: list[str]) -> list[np.ndarray]:
    got = rows.select(*keys, *values).toArrow()
    return [got[c].to_numpy() for c in (*keys, *values)]


def _kept(k: int, share: tuple[float, float], sd: float) -> Column:
    expected = (F.col("n0") + F.col("n1")) * share[k]
    return F.greatest(F.col(f"n{k}") - expected - sd * F.sqrt(expected), F.lit(0.0))


def fit(texts: DataFrame, sample: int = SAMPLE, seed: int = 9, labels: DataFrame | None = None) -> Model:
    """Fit on ``texts`` (doc_id, text, and toxic unless ``labels`` has doc_id and toxic): at most ``sample`` texts of each class, whole. Rows whose label is neither 0 nor 1 are left out.

    Equal texts count once, as toxic if one of them is. Without texts of a class every score is the smoothed rate of the class that is there, 0.5 if there is none.
    """
    labels = (texts if labels is None else labels).filter("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("long").alias("toxic"))
    # Ids are chosen before texts are touched; the chosen ones are at most 2 * sample rows, however large the table is.
    ids = labels.distinct().withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    chosen = [ids.filter(F.col("toxic") == k).orderBy("_h", "doc_id").limit(sample) for k in (0, 1)]
    chosen = stash(chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")), "toxicity-ids")
    own = texts.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = own.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("_id")))
    rows = stash(rows.groupBy("text").agg(F.max("_toxic").alias("toxic")).repartition(16), "toxicity-sample")
    counted = rows.mapInArrow(tidied_batches(_counts), "before long, word long, n0 long, n1 long").groupBy("before", "word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counted = stash(counted, "toxicity-counts")
    pairs, words = counted.filter("before IS NOT NULL"), counted.filter("before IS NULL").drop("before")
    size = words.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count("*").alias("kinds")).first()
    totals = np.array([size["n0"] or 0, size["n1"] or 0], float)
    share = tuple(totals / max(totals.sum(), 1))

    # Only expressions that keep mass in some class go to the driver, and the words of such pairs: what they can be is bounded by the sample.
    marked = pairs.filter((_kept(0, share, PAIR_SD) > 0) | (_kept(1, share, PAIR_SD) > 0))
    contexts = marked.groupBy("before").agg(*(F.sum(_kept(k, share, PAIR_SD)).alias(f"f{k}") for k in (0, 1)))
    contexts = contexts.join(pairs.groupBy("before").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "before")
    needed = marked.select("word").distinct().withColumn("in_pair", F.lit(True))
    follows = pairs.groupBy("word").agg(F.count("*").alias("follows"))
    listed = words.join(needed, "word", "left").filter(F.col("in_pair") | (_kept(0, share, WORD_SD) > 0) | (_kept(1, share, WORD_SD) > 0)).join(follows, "word")
    word, w0, w1, k0, k1, after = _table(listed.withColumns({"k0": _kept(0, share, WORD_SD), "k1": _kept(1, share, WORD_SD)}), ["word"], ["n0", "n1", "k0", "k1", "follows"])
    before, second, p0, p1 = _table(marked, ["before", "word"], ["n0", "n1"])
    context, c0, c1, f0, f1 = _table(contexts, ["before"], ["n0", "n1", "f0", "f1"])
    distinct_pairs = pairs.count()
    freed = np.array([1 - x.sum() / n if n else 1.0 for x, n in ((k0, totals[0]), (k1, totals[1]))])
    backoff = (after + 0.5) / (distinct_pairs + 0.5 * (size["kinds"] + 1))
    a, c = np.argsort(word), np.argsort(context)
    key = pair_key(before, second) if len(before) else np.zeros(0, np.int64)
    b = np.argsort(key)
    model = Model(
        word[a], np.stack([w0, w1], 1)[a].astype(float), backoff[a], key[b], np.stack([p0, p1], 1)[b].astype(float), context[c], np.stack([c0, c1], 1)[c].astype(float), np.stack([f0, f1], 1)[c], totals, freed
    )
    return calibrate(model, rows)


def calibrate(model: Model, rows: DataFrame) -> Model:
    """Fit slope and offset by logistic regression on the sample's margins; one number for each of its texts goes to the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.asarray(batch.column(1))
            yield pa.RecordBatch.from_pydict({"margin": shared.value.margins(batch.column(0).to_pylist(), labels), "toxic": labels})

    found = rows.mapInArrow(tidied_batches(run), "margin double, toxic long").toPandas()
    y = found["toxic"].to_numpy(float)
    model.prior = float((y.sum() + 1) / (len(y) + 2))
    worded = found["margin"].notna().to_numpy()
    x, y = found["margin"].to_numpy()[worded], y[worded]
    if len(x) == 0 or y.min() == y.max():
        model.slope, model.offset = 0.0, float(np.log(model.prior / (1 - model.prior)))
        return model
    scale = x.std() or 1.0
    features = np.stack([x / scale, np.ones_like(x)], 1)
    theta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(features @ theta, -30, 30)))
        slope = features.T @ (p - y) + 1e-2 * theta
        bend = (features * (p * (1 - p))[:, None]).T @ features + 1e-2 * np.eye(2)
        step = np.clip(np.linalg.solve(bend, slope), -2, 2)
        theta -= step
        if abs(step).max() < 1e-9:
            break
    model.slope, model.offset = float(theta[0] / scale), float(theta[1])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, from 0 to 1; texts without words, null ones too, get the smoothed rate of label 1 among the texts fitted on. All of a text counts, and nothing but the text.

    A column ``score`` of the input is replaced, all others stay. Repeated rows are scored alike; an empty table gives an empty table.
    """
    arrow_rows(docs.sparkSession)
    docs = docs.drop("score").withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.scores(part.column(place).to_pylist()))], names=[*part.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double"
    return docs.mapInArrow(tidied_batches(run), schema)


def held_out(folds: int) -> Column:
    """Whether a row is held out from training, by its doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Model:
    """Fit on the labelled documents that aren't held out."""
    labels = labels.filter(~held_out(folds) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    ids = docs.select("doc_id").join(labels, "doc_id")
    return fit(docs.select("doc_id", "text"), labels=ids)


def classify(docs: DataFrame, model: Model, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score is 0.5 or more) of every document."""
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
