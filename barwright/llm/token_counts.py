"""Token counts of whole texts: a broadcast table of frequent pre-token lengths, then a cache in each worker, then the tokenizer.

A byte-level BPE encodes each pre-token by itself, so a text has as many tokens as its pre-tokens have. One pass finds the pre-tokens that are
frequent in the whole corpus: each task keeps a Misra-Gries summary of fixed size, and summaries (never pre-tokens) are merged in small groups.
The merged summary, with lengths, is a table of at most ``ENTRIES`` pre-tokens, small enough to broadcast. The second pass looks pre-tokens up
there, then in the worker's cache of rarer ones; what neither has is encoded. Results don't depend on what is in either.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.common import arrow_rows
from barwright.llm.tokens import _PUNCTUATION, _UNSAFE, default_path

#: Pre-tokens in a summary and in the broadcast table, at most. A pre-token that is more than one in ENTRIES of all is always in the table.
ENTRIES = 1 << 14
#: Pre-tokens that a worker remembers, about, beside the table.
CACHE = 1 << 18
#: Summaries are merged in groups by task number modulo these: 128 in a group while there are at most two million tasks.
MERGES = (1 << 14, 1 << 7, 1)
#: Texts are split in groups of so many characters, and texts with unusual white space in stretches of so many.
GROUP_CHARS, STRETCH_CHARS = 4 << 20, 1 << 16
_SUMMARY = "place long, keys binary, counts binary"
#: A space between two characters that aren't white: a pre-token always begins there.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


class Splitter:
    """Pre-tokens of texts and their lengths in tokens, for one tokenizer file."""

    def __init__(self, path: str, specials_as_text: bool):
        self.path = path
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.by_pre_token, self.count_whole = False, lambda text: len(model.encode(text))
            return
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        t.encode_special_tokens = specials_as_text
        self.added = [x.content for x in t.get_added_tokens_decoder().values() if not (x.special and specials_as_text)]
        self.by_pre_token = t.normalizer is None and str(t.pre_tokenizer) == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
        self.count_whole = lambda text: len(t.encode(text, add_special_tokens=False).ids)
        self.recent: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def cut(self, text: str) -> list[str]:
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def stretches(self, text: str) -> Iterator[str]:
        """The text in stretches that end where a pre-token ends."""
        start = 0
        while start < len(text):
            found = _BETWEEN.search(text, start + STRETCH_CHARS)
            end = found.start() if found else len(text)
            yield text[start:end]
            start = end

    def length(self, pre_token: str) -> int:
        """Tokens of a pre-token, from the worker's cache or from the model."""
        n = self.recent.get(pre_token)
        if n is None:
            n = self.older.get(pre_token)
            if n is None:
                n = len(self.tokenizer.model.tokenize(pre_token))
            if len(self.recent) >= CACHE // 2:
                self.older, self.recent = self.recent, {}
            self.recent[pre_token] = n
        return n


def _plain(splitter: Splitter, texts: pa.Array) -> tuple[list[int], list[int], list[int]]:
    """Places of the texts to split at spaces, of those with unusual white space, and of those that only the whole tokenizer may count."""
    filled = texts.fill_null("")
    odd = pc.match_substring_regex(filled, _UNSAFE)
    whole = pa.array(np.zeros(len(filled), bool))
    for token in splitter.added:
        whole = pc.or_(whole, pc.match_substring(filled, token))
    odd, whole = np.asarray(odd), np.asarray(whole)
    return np.flatnonzero(~odd & ~whole).tolist(), np.flatnonzero(odd & ~whole).tolist(), np.flatnonzero(whole).tolist()


def _units(splitter: Splitter, texts: pa.Array) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """Pre-tokens of the texts, in groups: (pre-tokens, the unit that each belongs to, the unit of each occurrence, the text of each occurrence).

    A unit is a distinct word with the space before it, or the first word of a text, or a stretch of a text with unusual white space.
    """
    simple, odd, _ = _plain(splitter, texts)
    sizes = pc.utf8_length(texts).fill_null(0).to_pylist()
    group, size = [], 0
    for at, k in enumerate(simple):
        group.append(k)
        size += sizes[k]
        if size >= GROUP_CHARS or at + 1 == len(simple):
            places = np.array(group)
            pieces = pc.split_pattern(texts.take(pa.array(group)).cast(pa.large_string()).fill_null(""), " ")
            coded = pieces.values.dictionary_encode()
            words = coded.dictionary.to_pylist()
            codes, offsets = np.array(coded.indices, np.int64), np.asarray(pieces.offsets)
            first = np.zeros(len(codes), bool)
            first[offsets[:-1]] = True
            after, opening = np.unique(codes[~first]).tolist(), np.unique(codes[first]).tolist()
            # Words after a space neither begin nor end with white space: each begins where a pre-token begins with the sign of the space. Letters are
            # one pre-token, and a mark after them another; the tokenizer cuts the rest.
            pre, owners, named = [], [], []
            for k in after:
                w = words[k]
                if w.isascii() and w.isalpha():
                    pre.append("Ġ" + w)
                    owners.append(k)
                elif w.isascii() and w[:-1].isalpha() and w[-1] in _PUNCTUATION:
                    pre += ["Ġ" + w[:-1], w[-1]]
                    owners += [k, k]
                elif w:
                    named.append(k)
                else:
                    # A space that ends a text.
                    pre.append("Ġ")
                    owners.append(k)
            owners = [owners]
            if named:
                own = splitter.cut("".join(f" {words[k]}" for k in named))
                pre += own
                owners.append(np.array(named)[np.cumsum(np.fromiter((p[0] == "Ġ" for p in own), bool, len(own))) - 1])
            # First words have no space before them: units of their own, after the others.
            for k in opening:
                own = splitter.cut(words[k]) if words[k] else []
                pre += own
                owners.append(np.full(len(own), len(words) + k))
            codes[first] += len(words)
            owner = np.concatenate(owners)
            yield pre, owner.astype(np.int64), codes, np.repeat(places, np.diff(offsets))
            group, size = [], 0
    for k in odd:
        for stretch in splitter.stretches(texts[k].as_py()):
            pre = splitter.cut(stretch)
            yield pre, np.zeros(len(pre), np.int64), np.zeros(1, np.int64), np.array([k])


_SPLITTERS: dict[tuple[str, bool], Splitter] = {}
_TABLE: dict[tuple[bytes, bytes], dict[str, int]] = {}


def splitter(path: str, specials_as_text: bool) -> Splitter:
    """The splitter of this process for a tokenizer file."""
    key = path, specials_as_text
    if key not in _SPLITTERS:
        _SPLITTERS[key] = Splitter(*key)
    return _SPLITTERS[key]


def _known(table: tuple[bytes, bytes]) -> dict[str, int]:
    """The broadcast table as this process's dictionary; the last one stays."""
    if table not in _TABLE:
        keys, lengths = table
        _TABLE.clear()
        _TABLE[table] = dict(zip(keys.decode().split("\n") if lengths else [], np.frombuffer(lengths, "<u2").tolist(), strict=True))
    return _TABLE[table]


def prune(counts: dict[str, int], entries: int) -> dict[str, int]:
    """Misra-Gries: take the count of the first that is too many from all, and drop what has none left."""
    if len(counts) <= entries:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    least = int(np.partition(values, len(values) - entries - 1)[len(values) - entries - 1])
    return {k: n - least for k, n in counts.items() if n > least}


def _packed(place: int, counts: dict[str, int]) -> pa.RecordBatch:
    keys, values = "\n".join(counts).encode(), np.fromiter(counts.values(), "<i8", len(counts)).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([keys], pa.binary()), pa.array([values], pa.binary())], ["place", "keys", "counts"])


def _unpacked(keys: bytes, counts: bytes) -> Iterator[tuple[str, int]]:
    return zip(keys.decode().split("\n") if counts else [], np.frombuffer(counts, "<i8").tolist(), strict=True)


def _summarise(path: str, specials_as_text: bool, entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = splitter(path, specials_as_text), {}
        for batch in batches:
            for pre, owner, codes, _ in _units(split, batch.column(0)):
                times = np.bincount(codes, minlength=int(owner.max(initial=-1)) + 1)[owner].tolist()
                for p, n in zip(pre, times, strict=True):
                    counts[p] = counts.get(p, 0) + n
                if len(counts) > 4 * entries:
                    counts = prune(counts, entries)
        yield _packed(TaskContext.get().partitionId(), prune(counts, entries))

    return run


def _merge(entries: int):
    def run(batches: pa.Table) -> pa.Table:
        counts: dict[str, int] = {}
        for keys, values in zip(batches.column("keys").to_pylist(), batches.column("counts").to_pylist(), strict=True):
            for k, n in _unpacked(keys, values):
                counts[k] = counts.get(k, 0) + n
            counts = prune(counts, entries)
        return pa.Table.from_batches([_packed(batches.column("place")[0].as_py(), counts)])

    return run


def frequent(texts: DataFrame, path: str, specials_as_text: bool = True, entries: int = ENTRIES) -> dict[str, int]:
    """Frequent pre-tokens of the one column of ``texts`` and a lower bound of their counts, at most ``entries``.

    Every pre-token that is more than one in ``entries`` of all is among them. Only summaries are shuffled, one a task.
    """
    arrow_rows(texts.sparkSession)
    summaries = texts.mapInArrow(_summarise(path, specials_as_text, entries), _SUMMARY)
    for groups in MERGES:
        summaries = summaries.withColumn("group", F.col("place") % groups).groupBy("group").applyInArrow(_merge(entries), _SUMMARY)
    row = summaries.select("keys", "counts").first()
    return dict(_unpacked(bytes(row["keys"]), bytes(row["counts"]))) if row else {}


def length_table(counts: dict[str, int], path: str, specials_as_text: bool = True) -> tuple[bytes, bytes]:
    """The broadcast table: pre-tokens, one a line, and their lengths in 16 bits; longer ones are left to the workers."""
    split = splitter(path, specials_as_text)
    lengths = {k: split.length(k) for k in counts}
    kept = {k: n for k, n in lengths.items() if n < 1 << 16}
    return "\n".join(kept).encode(), np.fromiter(kept.values(), "<u2", len(kept)).tobytes()


def _counter(path: str, specials_as_text: bool, table):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        split = splitter(path, specials_as_text)
        known = _known(table.value) if table else {}
        for texts in batches:
            if not split.by_pre_token:
                yield pa.array([split.count_whole(t) if t else 0 for t in texts.to_pylist()], pa.int64())
                continue
            out = np.zeros(len(texts), np.int64)
            for k in _plain(split, texts)[2]:
                out[k] = split.count_whole(texts[k].as_py())
            for pre, owner, codes, places in _units(split, texts):
                lengths = np.fromiter((known.get(p) or split.length(p) for p in pre), np.int64, len(pre))
                unit = np.bincount(owner, lengths, minlength=int(codes.max(initial=-1)) + 1).astype(np.int64)
                out += np.bincount(places, unit[codes], minlength=len(out)).astype(np.int64)
            yield pa.array(out)

    return run


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None, limit: int = 512, specials_as_text: bool = True, entries: int = ENTRIES) -> DataFrame:
    """``df`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of each text, without begin and end.

    Null and empty texts have 0 of both. Texts are counted whole; a worker holds a batch of them and what a stretch splits into. Repeated rows are
    counted alike, an empty table stays empty, and columns of ``df`` with the names of the three are replaced. ``path`` is a tokenizers (.json) or a
    sentencepiece (.model) file; tokenizers other than byte-level BPE count whole texts, as do texts that spell an added token, which is one id
    unless ``specials_as_text``.
    """
    path = path or default_path()
    spark: SparkSession = df.sparkSession
    arrow_rows(spark)
    table = None
    if path.endswith(".json") and splitter(path, specials_as_text).by_pre_token:
        counts = frequent(df.select(F.col(text)), path, specials_as_text, entries)
        table = spark.sparkContext.broadcast(length_table(counts, path, specials_as_text))

    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _counter(path, specials_as_text, table)(batches)

    count = F.arrow_udf(tokens, "long")
    out = df.drop(*[c for c in ("n_bytes", "n_tokens", "over_limit") if c != text])
    source = F.coalesce(F.col(text), F.lit(""))
    n_bytes, n_tokens = F.octet_length(source).cast("long"), count(source)
    return out.withColumns({"n_bytes": n_bytes, "n_tokens": n_tokens}).withColumn("over_limit", F.col("n_tokens") > limit)


__all__ = ["count_tokens", "frequent", "length_table", "prune"]
