"""Token ids of whole texts: a cache of pieces around the tokenizers library."""

from __future__ import annotations

import os
from array import array
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from barwright.llm.common import KEPT

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A space beside other white space, in the regular expressions of Arrow: such texts are encoded in one piece.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE = f" {_WHITE}|{_WHITE} "
_PUNCTUATION = ",.;:!?"
#: Pieces that a worker remembers, about: those met since the cache was last half full, and those met in the half before.
CACHE_WORDS = 600_000
#: New pieces that the library gets in one text.
JOINED_WORDS = 128
#: Characters of texts that are cut at once, about.
GROUP_CHARS = 8 << 20
#: Kinds of bytes: letters, digits, marks, the apostrophe, the space, white space, bytes that aren't looked at, and a newline between two of the first four.
_LETTER, _DIGIT, _MARK, _QUOTE, _SPACE, _WHITES, _OTHER, _NEWLINE = range(8)


def _kind(byte: int) -> int:
    c = chr(byte)
    if byte > 0x7F or 0x1C <= byte < 0x20:
        return _OTHER
    return _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _QUOTE if c == "'" else _SPACE if c == " " else _WHITES if c.isspace() else _MARK


_KINDS = bytes(map(_kind, range(256)))
#: Where a pre-token always begins, by the kinds of the bytes before and after (8 x before + after). Nothing is cut behind white space or beside unknown bytes but before a space, nor behind
#: an apostrophe, which may begin a contraction, but before white space.
_CUTS = bytearray(256)
for _before, _after in {
    _LETTER: (_DIGIT, _MARK, _QUOTE, _SPACE, _WHITES, _NEWLINE),
    _DIGIT: (_LETTER, _MARK, _QUOTE, _SPACE, _WHITES, _NEWLINE),
    _MARK: (_LETTER, _DIGIT, _SPACE, _WHITES, _NEWLINE),
    _QUOTE: (_SPACE, _WHITES, _NEWLINE),
    _OTHER: (_SPACE,),
    _NEWLINE: (_LETTER, _DIGIT, _MARK, _QUOTE),
}.items():
    for _k in _after:
        _CUTS[8 * _before + _k] = 1
_CUTS = bytes(_CUTS)


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8. Letters of two bytes are U+00C0 to U+027F but two signs, and U+0400 to U+047F."""
    raw = data.tobytes()
    kinds = np.frombuffer(bytearray(raw.translate(_KINDS)), np.uint8)
    if not raw.isascii():
        lead = np.flatnonzero(((data >= 0xC3) & (data <= 0xC9)) | (data & 0xFE == 0xD0))
        lead = lead[lead < len(data) - 1]
        second = data[lead + 1]
        lead = lead[(data[lead] != 0xC3) | ((second != 0x97) & (second != 0xB7))]
        kinds[lead] = kinds[lead + 1] = _LETTER
    newline = np.flatnonzero(data == 10)
    lone = (kinds[newline - 1] <= _QUOTE) & (kinds[np.minimum(newline + 1, len(data) - 1)] <= _QUOTE)
    kinds[newline[lone]] = _NEWLINE
    return kinds


def _alphabet() -> list[str]:
    """The character by which a byte-level tokenizer writes each byte."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256))
    return [chr(b) if b in seen else chr(256 + next(rest)) for b in range(256)]


_ALPHABET = str.maketrans(dict(enumerate(_alphabet())))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Generation:
    """Pieces met since the cache was last half full: the number of each, the ids of all in a row, and the bytes before each one's end."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.ids, self.ends = bytearray(), array("q", [0])

    def add(self, pieces: list[str], sizes: np.ndarray, ids: bytes) -> range:
        """Take in new pieces with the bytes of their ids; their numbers."""
        numbers = range(len(self.numbers), len(self.numbers) + len(pieces))
        self.numbers.update(zip(pieces, numbers, strict=True))
        self.ends.frombytes((np.cumsum(sizes, dtype=np.int64) + len(self.ids)).tobytes())
        self.ids += ids
        return numbers

    def take(self, numbers: list[int]) -> pa.LargeBinaryArray:
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.numbers), [None, pa.py_buffer(self.ends.tobytes()), pa.py_buffer(bytes(self.ids))])
        return packed.take(pa.array(numbers, pa.int64()))


class Encoder:
    """Encodes texts with a byte-level BPE that splits at white space, giving exactly what the library gives for the whole text.

    Texts are cut into pieces where a pre-token always begins, whatever stands around: before a single space between two characters
    that aren't white space, around a single newline, and where letters, digits and marks meet. So a text is the sum of its pieces,
    and each distinct one is encoded once. Pieces of one kind are one pre-token and go to the tokenizer's model; of the others the library gets many
    in one text, and a piece's ids begin at the one whose token begins with the sign of the space. Tokenizers with a
    normalizer or another pre-tokenizer get whole texts, and so is every text encoded that contains an added token.

    ``specials_as_text``: spelled special tokens are ordinary text. Otherwise they are ids of their own, the library's default.
    """

    def __init__(self, path: str, specials_as_text: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (t.special and specials_as_text)]
        self.by_word = self.tokenizer.normalizer is None and str(self.tokenizer.pre_tokenizer) == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        vocabulary = self.tokenizer.get_vocab()
        #: Whether words can be joined by spaces; of each id, whether its token begins with a space.
        self.joins = not any(" " in t for t in self.added)
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.kind = "H" if self.width == "<u2" else "I"
        self.known, self.older = _Generation(), _Generation()

    def _encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed."""
        fast = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [array(self.kind, x.ids).tobytes() for x in fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces of several pre-tokens, packed."""
        out: list = [None] * len(pieces)
        joined = [k for k, w in enumerate(pieces) if self.joins and len(w) > 1 and w[0] == " " and not w[1].isspace() and not w[-1].isspace()]
        alone = sorted({*range(len(pieces))} - {*joined})
        for a in range(0, len(joined), JOINED_WORDS):
            some = joined[a : a + JOINED_WORDS]
            raw = self._encode(["".join([pieces[k] for k in some])])[0]
            starts = np.flatnonzero(self.opens[np.frombuffer(raw, self.width)])
            if len(starts) == len(some):
                bounds = [*(starts * np.dtype(self.width).itemsize).tolist(), len(raw)]
                for k, (i, j) in zip(some, pairwise(bounds), strict=True):
                    out[k] = raw[i:j]
            else:
                alone += some
        for k, ids in zip(alone, self._encode([pieces[k] for k in alone]), strict=True):
            out[k] = ids
        return out

    def _one_pre_token(self, vocabulary: pa.LargeStringArray) -> np.ndarray:
        """Of each piece, whether it is one pre-token: it has one kind of bytes but for a space at its beginning."""
        data, offsets = np.frombuffer(vocabulary.buffers()[2], np.uint8), np.frombuffer(vocabulary.buffers()[1], np.int64)[: len(vocabulary) + 1]
        several = np.isin(_kinds(data[: offsets[-1]]), (_QUOTE, _WHITES, _OTHER))
        # A newline that stands alone in a text has other neighbours here.
        return ~np.maximum.reduceat(several, offsets[:-1]) | ((np.diff(offsets) == 1) & (data[offsets[:-1]] == 10))

    def _ids(self, vocabulary: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of each distinct piece, packed."""
        if len(self.known.numbers) > CACHE_WORDS // 2:
            self.older, self.known = self.known, _Generation()
        pieces = vocabulary.to_numpy(zero_copy_only=False).tolist()
        out = list(map(self.known.numbers.get, pieces))

        def add(places: list[int], names: list[str], sizes, ids: bytes) -> None:
            for k, number in zip(places, self.known.add(names, sizes, ids), strict=True):
                out[k] = number

        fresh = [k for k, number in enumerate(out) if number is None]
        numbers = list(map(self.older.numbers.get, [pieces[k] for k in fresh]))
        met = [k for k, number in zip(fresh, numbers, strict=True) if number is not None]
        if met:
            ids = self.older.take([number for number in numbers if number is not None])
            add(met, [pieces[k] for k in met], np.diff(np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1]), ids.buffers()[2].to_pybytes() if ids.buffers()[2] else b"")
        fresh = [k for k, number in zip(fresh, numbers, strict=True) if number is None]
        if not fresh:
            return self.known.take(out)
        one, tokenize = self._one_pre_token(vocabulary).tolist(), self.tokenizer.model.tokenize
        single = [k for k in fresh if one[k]]
        names = [pieces[k] for k in single]
        signs = [("Ġ" + w[1:] if w[0] == " " else w) if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(_ALPHABET) for w in names]
        got = [[x.id for x in tokenize(w)] for w in signs]
        ids = array(self.kind, chain.from_iterable(got))
        add(single, names, np.fromiter(map(len, got), np.int64, len(got)) * ids.itemsize, ids.tobytes())
        several = [k for k in fresh if not one[k]]
        names = [pieces[k] for k in several]
        packed = self._encode_pieces(names)
        add(several, names, np.fromiter(map(len, packed), np.int64, len(packed)), b"".join(packed))
        return self.known.take(out)

    def __call__(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """The ids of each text, null counting as empty."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        texts = texts.cast(pa.large_string()).fill_null("")
        out: list = [np.zeros(0, self.width)] * len(texts)
        whole = pc.match_substring_regex(texts, _UNSAFE)
        for t in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, t))
        sizes = np.asarray(pc.utf8_length(texts))
        whole = np.asarray(whole) | (not self.by_word)
        rest = np.flatnonzero(whole & (sizes > 0))
        for k, ids in zip(rest, self._encode(texts.take(pa.array(rest)).to_pylist()), strict=True):
            out[k] = np.frombuffer(ids, self.width)
        simple = np.flatnonzero(~whole & (sizes > 0))
        group = np.cumsum(sizes[simple]) // GROUP_CHARS
        for own in np.split(simple, np.flatnonzero(np.diff(group)) + 1):
            if len(own):
                self._by_pieces(texts.take(pa.array(own)), own, out)
        return out

    def _by_pieces(self, texts: pa.LargeStringArray, places: np.ndarray, out: list) -> None:
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        kinds = _kinds(data)
        begins = np.ones(len(data) + 1, bool)
        begins[1:-1] = np.frombuffer((kinds[:-1] << 3 | kinds[1:]).tobytes().translate(_CUTS), bool)
        begins[ends] = True
        bounds = np.flatnonzero(begins)
        pieces = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        ids = self._ids(pieces.dictionary).take(pieces.indices)
        done = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1] // np.dtype(self.width).itemsize
        flat = np.frombuffer(ids.buffers()[2], self.width)
        done = done[np.searchsorted(bounds, ends)].tolist()
        for k, (a, b) in zip(places.tolist(), pairwise(done), strict=True):
            out[k] = flat[a:b]
        pa.default_memory_pool().release_unused()


def encoder(path: str, specials_as_text: bool = True) -> Encoder:
    """The encoder of this process for a tokenizer file, until a task of another kind drops it."""
    key = "encoder", path, specials_as_text
    if key not in KEPT:
        KEPT[key] = Encoder(path, specials_as_text)
    return KEPT[key]
