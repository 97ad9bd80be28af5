"""Hidden Markov language model: Baum-Welch over all partitions, exact sequence likelihoods by scaled forward recursion.

A state emits a word's class (a hash of the word, so that their number is fixed) and the class the word, by its share of the class's discounted count;
words that training has not seen are one symbol, with the mass that discounting frees. Documents are read once into blocks of word numbers.
Counts of words are rows of (block, hash), summed by hash in Spark and sent back to their blocks, so no vocabulary is broadcast or held
in one place. Expected counts of an iteration are vectors of fixed size, summed in Spark by position. Texts are trained on whole: long ones are worked off in
spans side by side, after the messages that pass from span to span have been computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.common import arrow_rows, hash_words, stash

STATES, CLASSES, ROUNDS = 6, 4096, 8
#: Tokens of a span, and of the spans that are worked off at once.
SPAN, BATCH = 1024, 1 << 20
#: Steps between rescalings: so many emissions in a row stay far from the smallest doubles.
RESCALE = 8
BLOCK_BYTES = 8 << 20
#: What the end of a text is called, and its class after the hashed ones.
END_HASH = np.uint64(0xE7037ED1A0B428DB)
#: Smoothing counts of transitions, and of emissions in proportion to the classes' shares.
PRIOR_MOVE, PRIOR_EMIT = 10.0, 2000.0


def classes_of(hashes: np.ndarray) -> np.ndarray:
    out = (hashes & np.uint64(CLASSES - 1)).astype(np.int64)
    out[hashes == END_HASH] = CLASSES
    return out


_BLOCK = [("block", pa.int64()), *((k, pa.binary()) for k in ("docs", "nulls", "held", "sizes", "codes", "hashes", "train", "lengths", "symbols"))]
_BLOCK_SQL = ", ".join(f"{name} {'long' if name == 'block' else 'binary'}" for name, _ in _BLOCK)


def _number(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of some texts, each followed by the end, number 0; each text's tokens; the hash of each word. Arrow's white space is the six characters of ``SPACE``."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded = lists.flatten().dictionary_encode()
    vocabulary, numbers, sizes = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    numbers = numbers + np.int32(1)
    if b"" in vocabulary:  # before white space that begins a text, behind such that ends one, and for a text without words
        none = vocabulary.index(b"")
        real = numbers != none + 1
        before = np.concatenate([[0], np.cumsum(real)])
        ends = np.cumsum(sizes)
        sizes, numbers = before[ends] - before[ends - sizes], numbers[real]
        numbers -= numbers > none + 1
        del vocabulary[none]
    sizes = sizes.astype(np.int32) + np.int32(1)
    codes, words = np.zeros(int(sizes.sum()), np.int32), np.ones(int(sizes.sum()), bool)
    words[np.cumsum(sizes) - 1] = False
    codes[words] = numbers
    return codes, sizes, np.concatenate([[END_HASH], hash_words(vocabulary)])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents as word numbers, with the hash of each word and its count in training documents, and the classes of the training texts alone."""
    from pyspark import TaskContext

    base, place = TaskContext.get().partitionId() << 32, 0

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        nonlocal place
        ids, held, texts = (c.combine_chunks() for c in pa.Table.from_batches(parts).columns)
        codes, sizes, hashes = _number(texts)
        held = held.to_numpy(zero_copy_only=False)
        kept = codes[np.repeat(~held, sizes)]
        train = np.bincount(kept, minlength=len(hashes)).astype(np.uint32)
        symbols = classes_of(hashes).astype(np.uint16).take(kept)
        nulls = ids.is_null().to_numpy(zero_copy_only=False)
        values = (ids.fill_null(0).to_numpy(zero_copy_only=False), nulls, held, sizes, codes, hashes, train, sizes[~held], symbols)
        place += 1
        return pa.RecordBatch.from_pylist([{"block": base + place} | {k: v.tobytes() for (k, _), v in zip(_BLOCK[1:], values, strict=True)}], pa.schema(_BLOCK))

    parts, size = [], 0
    for batch in batches:
        # A block is full with the row that brings it over its size.
        ends, at = np.cumsum(pc.binary_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < len(ends):
            done = ends[at - 1] if at else 0
            to = min(int(np.searchsorted(ends, BLOCK_BYTES - size + done, side="right")) + 1, len(ends))
            parts.append(batch.slice(at, to - at))
            at, size = to, size + int(ends[to - 1] - done)
            if size > BLOCK_BYTES:
                yield block(parts)
                parts, size = [], 0
    if parts:
        yield block(parts)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word of a block: its hash, and its count in the block's training texts."""
    for batch in batches:
        for k in range(batch.num_rows):
            hashes, train = np.frombuffer(batch.column("hashes")[k].as_py(), np.int64), np.frombuffer(batch.column("train")[k].as_py(), np.uint32)
            for at in range(0, len(hashes), 1 << 18):
                part = slice(at, at + (1 << 18))
                yield pa.RecordBatch.from_pydict({"block": np.full(len(hashes[part]), batch.column("block")[k].as_py(), np.int64), "hash": hashes[part], "train": train[part].astype(np.int64)})


def _statistics(counted: DataFrame) -> np.ndarray:
    """Distinct words, tokens, words met once and twice in training, then tokens and words of each class; a row for each class goes to the driver."""
    kind = F.when(F.col("hash") == int(END_HASH.astype(np.int64)), CLASSES).otherwise(F.col("hash").bitwiseAND(CLASSES - 1))
    rows = counted.filter("leads AND n > 0").groupBy(kind.alias("kind")).agg(
        F.count("*").alias("kinds"), F.sum("n").alias("tokens"), F.sum((F.col("n") == 1).cast("long")).alias("once"), F.sum((F.col("n") == 2).cast("long")).alias("twice")
    ).collect()
    tokens, kinds = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in rows:
        tokens[r.kind], kinds[r.kind] = r.tokens, r.kinds
    return np.concatenate([[kinds.sum(), tokens.sum(), sum(r.once for r in rows), sum(r.twice for r in rows)], tokens, kinds])


def vector_sum(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of vectors of ``size`` given as rows of a place and the values from there on, as many in each row."""
    values = rows.columns[1:]
    got = rows.groupBy("place").agg(*(F.sum(c).alias(c) for c in values)).toArrow()
    out = np.zeros((size // len(values), len(values)))
    out[got["place"].to_numpy()] = np.stack([got[c].to_numpy() for c in values], 1)
    return out.ravel()


def _by_step(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Sequences, longest first; how many there are at each step; and the place of every token, step by step."""
    order = np.argsort(-sizes, kind="stable")
    at, length = starts[order], sizes[order]
    alive = (len(order) - np.searchsorted(length[::-1], np.arange(length[0] if len(length) else 0), side="right")).tolist()
    return order, alive, np.concatenate([at[:n] + t for t, n in enumerate(alive)]) if alive else np.zeros(0, np.int64)


@dataclass
class Model:
    """Start, moves and class emissions of the states (log is not taken); discount and class totals of the words; mass of unseen words."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    discount: float
    class_total: np.ndarray
    unseen: float
    tokens: int
    kinds: int

    def forward(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Natural log-likelihood of each sequence of classes, ``CLASSES + 1`` being the unseen symbol: scaled forward recursion, all sequences together."""
        order, alive, where = _by_step(np.cumsum(sizes) - sizes, sizes)
        begin = np.cumsum([0, *alive])
        out, result = np.zeros(len(sizes)), np.empty(len(sizes))
        emit = np.vstack([self.emit.T, np.full((1, len(self.start)), self.unseen)])
        for t, n in enumerate(alive):
            if t % SPAN == 0:
                chance, base = emit[symbols[where[begin[t] : begin[min(t + SPAN, len(alive))]]]], begin[t]
            own = chance[begin[t] - base : begin[t + 1] - base]
            alpha = self.start[None, :] * own if t == 0 else alpha[:n] @ self.move * own  # noqa: F821
            left = alive[t + 1] if t + 1 < len(alive) else 0
            if t % RESCALE == 0 or left < n:
                rows = slice(0 if t % RESCALE == 0 else left, n)
                scale = alpha[rows].sum(1)
                alpha[rows] /= scale[:, None]
                out[rows] += np.log(scale)
        result[order] = out
        return result

    def _messages(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each span gets from the one before it (state shares at that one's end) and, up to a factor, from those after it.

        A span's tokens are one matrix: it takes shares at the end of the span before to shares at its own end, and the other way round for what follows.
        """
        k, n = len(self.start), len(sizes)
        state = np.zeros((n, k))
        # A text of several spans fills its first one.
        heads, later = np.flatnonzero(first), np.flatnonzero(~first)
        a = self.start * emit[symbols[starts[heads]]]
        for t in range(1, SPAN):
            a = a @ self.move * emit[symbols[starts[heads] + t]]
            if t % RESCALE == 0:
                a /= a.sum(1, keepdims=True)
        state[heads] = a / a.sum(1, keepdims=True)
        through = np.zeros((n, k, k))
        order, alive, where = _by_step(starts[later], sizes[later])
        steps, at = np.broadcast_to(np.eye(k), (len(later), k, k)).copy(), 0
        for t, m in enumerate(alive):
            step = (steps[:m].reshape(-1, k) @ self.move).reshape(-1, k, k) * emit[symbols[where[at : at + m]]][:, None, :]
            at += m
            if t % RESCALE == 0 or t == len(alive) - 1 or alive[t + 1] < m:
                step /= step.sum((1, 2), keepdims=True)
            steps[:m] = step
        through[later[order]] = steps
        incoming, outgoing = np.zeros((n, k)), np.ones((n, k))
        place = np.arange(n) - heads[np.cumsum(first) - 1]
        for j in range(1, int(place.max()) + 1):
            at = np.flatnonzero(place == j)
            incoming[at] = state[at - 1]
            ahead = np.einsum("ik,ikl->il", state[at - 1], through[at])
            state[at] = ahead / ahead.sum(1, keepdims=True)
        for j in range(int(place.max()), 0, -1):
            at = np.flatnonzero(place == j)
            back = np.einsum("ikl,il->ik", through[at], outgoing[at])
            outgoing[at - 1] = back / back.sum(1, keepdims=True)
        return incoming, outgoing

    def expected(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Expected starts, moves and emissions over sequences of seen classes, as one vector. Exact, whatever the length of a sequence."""
        emit = np.ascontiguousarray(self.emit.T)
        spans = -(-sizes // SPAN)
        text = np.repeat(np.arange(len(sizes)), spans)
        place = np.arange(len(text)) - np.repeat(np.cumsum(spans) - spans, spans)
        starts = (np.cumsum(sizes) - sizes)[text] + place * SPAN
        length = np.minimum(SPAN, sizes[text] - place * SPAN)
        first = place == 0
        incoming, outgoing = np.zeros((len(text), len(self.start))), np.ones((len(text), len(self.start)))
        long = np.flatnonzero(spans[text] > 1)
        if len(long):
            incoming[long], outgoing[long] = self._messages(symbols, starts[long], length[long], first[long], emit)
        total = np.zeros(len(self.start) * (1 + len(self.start) + CLASSES + 1))
        # Spans of like length meet, so that few are worked off at the later steps.
        order = np.argsort(-length, kind="stable")
        starts, length, first, incoming, outgoing = (x[order] for x in (starts, length, first, incoming, outgoing))
        rows, done = np.ascontiguousarray(self.emit), np.cumsum(length)
        cuts = np.searchsorted(done, np.arange(BATCH, done[-1] + BATCH, BATCH), side="left") + 1
        for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
            if a < min(b, len(text)):
                part = slice(a, b)
                total += self._spans(symbols, starts[part], length[part], first[part], incoming[part], outgoing[part], rows)
        return total

    def _spans(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, incoming: np.ndarray, outgoing: np.ndarray, emit: np.ndarray) -> np.ndarray:
        """Expected counts of spans, given what reaches them from both sides. Shares are rescaled every few steps, which cancels in the counts."""
        k, move = len(self.start), self.move
        order, alive, where = _by_step(starts, sizes)
        opens, before, after = first[order], incoming[order], np.ascontiguousarray(outgoing[order].T)
        symbols = symbols.take(where)
        # A row for each state, so that every operation runs along the tokens; steps are written in place.
        chance, begin = emit.take(symbols, 1), np.cumsum([0, *alive]).tolist()
        alphas, scales = np.empty_like(chance), {}
        np.multiply(np.where(opens, self.start[:, None], move.T @ before.T), chance[:, : alive[0]], out=alphas[:, : alive[0]])
        forth = np.ascontiguousarray(move.T)
        for t, n in enumerate(alive):
            a = alphas[:, begin[t] : begin[t + 1]]
            if t:
                np.matmul(forth, alphas[:, begin[t - 1] : begin[t - 1] + n], out=a)
                a *= chance[:, begin[t] : begin[t + 1]]
            if t % RESCALE == 0:
                scales[t] = a.sum(0)
                a /= scales[t]
        moves, betas, aheads = np.zeros((k, k)), np.empty((k, alive[0])), np.empty((k, alive[0]))
        m = 0
        for t in range(len(alive) - 1, -1, -1):
            n = alive[t]
            a, beta = alphas[:, begin[t] : begin[t + 1]], betas[:, :n]
            if m:
                np.matmul(move, aheads[:, :m], out=beta[:, :m])
            if n > m:
                # Spans that end here take what comes after them, scaled so that their shares sum to one.
                beta[:, m:] = after[:, m:n]
                beta[:, m:] /= (a[:, m:] * beta[:, m:]).sum(0)
            ahead, m = aheads[:, :n], n
            np.multiply(chance[:, begin[t] : begin[t + 1]], beta, out=ahead)
            if t in scales:
                ahead /= scales[t]
            if t:
                moves += alphas[:, begin[t - 1] : begin[t - 1] + n] @ ahead.T
            a *= beta  # now the shares given the whole text
        moves += before[~opens].T @ ahead.T[~opens]
        counts = np.stack([np.bincount(symbols, x, CLASSES + 1) for x in alphas])
        return np.concatenate([alphas[:, : alive[0]][:, opens].sum(1), (moves * move).ravel(), counts.ravel()])

    def improved(self, total: np.ndarray) -> Model:
        """The model of expected counts, smoothed towards even moves and the classes' shares."""
        k = len(self.start)
        start, moves, counts = total[:k] + 1, total[k : k + k * k].reshape(k, k) + PRIOR_MOVE / k, total[k + k * k :].reshape(k, -1)
        counts = counts + PRIOR_EMIT * self.class_total / self.class_total.sum()
        emit = counts / counts.sum(1, keepdims=True) * (1 - self.unseen)
        return Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emit, self.discount, self.class_total, self.unseen, self.tokens, self.kinds)


def initial(stats: np.ndarray, states: int, seed: int = 5) -> Model:
    """States that stay, and emit the classes by their shares, each with its own random leaning."""
    kinds, tokens, once, twice = (float(x) for x in stats[:4])
    totals, types = stats[4 : 5 + CLASSES], stats[5 + CLASSES :]
    discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
    unseen = (discount * kinds + 0.5) / (tokens + 1)
    mass = np.maximum(totals - discount * types, 0)
    rng = np.random.default_rng(seed)
    share = (mass + 1e-3) / (mass + 1e-3).sum()
    lean = share * np.exp(rng.normal(0, 1, (states, CLASSES + 1)))
    move = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1))
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), lean / lean.sum(1, keepdims=True) * (1 - min(unseen, 0.5)), discount, mass, min(unseen, 0.5), int(tokens), int(kinds))


def _arrays(batch: pa.RecordBatch, k: int, names: dict[str, type]) -> list[np.ndarray]:
    return [np.frombuffer(batch.column(name)[k].as_py(), kind) for name, kind in names.items()]


def train(blocks: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """Baum-Welch: each round takes the expected counts of all training texts."""
    if not model.tokens:
        return model
    size = len(model.start) * (1 + len(model.start) + CLASSES + 1)
    rows, columns = blocks.select("lengths", "symbols"), [f"x{z}" for z in range(len(model.start))]
    for _ in range(rounds):
        shared = blocks.sparkSession.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, total = shared.value, None
            for batch in batches:
                for k in range(batch.num_rows):
                    lengths, symbols = _arrays(batch, k, {"lengths": np.int32, "symbols": np.uint16})
                    if len(symbols):
                        got = own.expected(symbols, lengths.astype(np.int64))
                        total = got if total is None else total + got
            if total is not None:
                values = np.ascontiguousarray(total.reshape(-1, len(columns)).T)
                yield pa.RecordBatch.from_pydict({"place": np.arange(len(total) // len(columns)), **dict(zip(columns, values, strict=True))})

        model = model.improved(vector_sum(rows.mapInArrow(expect, ", ".join(["place long", *(f"{c} double" for c in columns)])), size))
    return model


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(shared):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model: Model = shared.value
        found, n = right["hash"].to_numpy(), right["n"].to_numpy()
        order = np.argsort(found)
        found, n = found[order], n[order]
        out = []
        for batch in left.to_batches():
            for k in range(batch.num_rows):
                docs, nulls, held, sizes, codes, hashes = _arrays(batch, k, {"docs": np.int64, "nulls": np.bool_, "held": np.bool_, "sizes": np.int32, "codes": np.int32, "hashes": np.uint64})
                counts = n[np.searchsorted(found, hashes.view(np.int64))]
                classes = classes_of(hashes)
                symbols = np.where(counts > 0, classes, CLASSES + 1)
                inner = np.where(counts > 0, (counts - model.discount) / np.maximum(model.class_total[classes], 1e-300), 1.0)
                base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.kinds + 1)))
                owner = np.repeat(np.arange(len(sizes)), sizes)
                sums = [np.bincount(owner, x[codes], len(sizes)) for x in (base, np.log10(np.maximum(inner, 1e-300)), (counts > 0).astype(float))]
                score = model.forward(symbols[codes], sizes.astype(np.int64)) / np.log(10) + sums[1]
                out.append(pa.table({
                    "doc_id": pa.array(docs, mask=nulls), "held_out": pa.array(held), "n_tokens": pa.array(sizes.astype(np.int64)), "n_known": pa.array(sums[2].astype(np.int64)),
                    "train_tokens": pa.array(np.full(len(docs), model.tokens)), "base_score": pa.array(sums[0]), "score": pa.array(score),
                }))
        return pa.concat_tables(out)

    return run


def held_out(folds: int = 10) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Train on the texts of ``docs`` (doc_id, text; others are ignored) that aren't held out, and score every text, whole.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, logs being to base 10. Null texts are empty: their one token is the end. Rows without
    a doc_id are trained on; repeated rows count as often as they are there. An empty table gives an empty table.
    """
    arrow_rows(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held"), F.col("text").cast("string").alias("text"))
    blocks = stash(docs.mapInArrow(_read, _BLOCK_SQL), "hmm-blocks")
    words = blocks.select("block", "hashes", "train").mapInArrow(_words, "block long, hash long, train long")
    # A word has at most one row for a block, so that the commonest ones make no large group.
    same = Window.partitionBy("hash")
    counted = words.select("block", "hash", F.sum("train").over(same).alias("n"), (F.min("block").over(same) == F.col("block")).alias("leads"))
    counted = stash(counted, "hmm-counts")
    model = train(blocks, initial(_statistics(counted), states), rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = blocks.select("block", "docs", "nulls", "held", "sizes", "codes", "hashes")
    back = counted.select("block", "hash", "n")
    return texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_score(shared), _SCORED)
