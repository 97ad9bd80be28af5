import heapq
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from barwright.llm import huffman, tokens
from barwright.llm.tokens import Encoder, default_path

SCHEMA = "doc_id long, text string, ids string"
ODD = ["", None, " ", "a", "  a b", "a  b ", " a\nb c\n d e\n", "don't stop's  ok, x.", "<|endoftext|> hi", "é , . 12 3,", "x\ty z", "\x1c a \x1cb", "naïve, Straße. 日本 語"]


def library():
    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    ids = library()
    got = Encoder(default_path())(ODD * 2)
    assert [x.tolist() for x in got] == [ids(t) for t in ODD * 2]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_encoder_equals_the_library_on_words_of_all_kinds(seed, monkeypatch):
    """Known and new words, marks, newlines, white space of other kinds, digits, letters of more bytes, in texts that share them."""
    monkeypatch.setattr(tokens, "CACHE_WORDS", 60)
    monkeypatch.setattr(tokens, "JOINED_WORDS", 5)
    rng = np.random.default_rng(seed)
    pieces = ["a", "tion", "THE", "é", "ß", "日", "'s", "'", "1", "42", ",", ".", "!!", "?", "-", "Ġ", "Ċ", "\n", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u3000", "\u180e", "\u200b", "\U0001f600", "<|", "|>"]
    word = lambda: "".join(rng.choice(pieces, rng.integers(1, 6)))
    texts = ["".join(word() + rng.choice(["", " ", " ", " ", "  "], p=[0.05, 0.3, 0.3, 0.3, 0.05]) for _ in range(rng.integers(0, 8))) for _ in range(1500)]
    plain = [w for w in pieces if not any(c.isspace() for c in w)]
    texts += [" ".join("".join(rng.choice(plain, 4)) + rng.choice(["", ".", ".\nNew", "\nold,", "\na\nb"]) for _ in range(9)) for _ in range(300)]
    ids, encode = library(), Encoder(default_path())
    for a in range(0, len(texts), 100):
        assert [x.tolist() for x in encode(texts[a : a + 100])] == [ids(t) for t in texts[a : a + 100]]


def test_new_words_are_not_texts_of_their_own_for_the_library(monkeypatch):
    encode, given = Encoder(default_path()), []
    one_by_one = encode._encode
    monkeypatch.setattr(encode, "_encode", lambda texts: given.extend(texts) or one_by_one(texts))
    text = "start " + " ".join(f"wörd{k}x é{k}." if k % 2 else f"end{k}.\nNext" for k in range(4000))
    assert encode([text])[0].tolist() == library()(text)
    assert len(given) < 400


def test_pieces_of_one_kind_are_encoded_once_whatever_stands_beside_them(monkeypatch):
    encode, given = Encoder(default_path()), []
    one_by_one = encode._encode
    monkeypatch.setattr(encode, "_encode", lambda texts: given.extend(texts) or one_by_one(texts))
    words = [f"{a}{b}ß{c}" for a in "abcdefgh" for b in "éüñж" for c in ("tion", "nach", "EN")]
    endings = ["", ",", ".", "$$$", ".***", ".\nNächste", "\nder", "!\n\nlos", "7", "(x)"]
    texts = [" ".join(w + e for w in words) for e in endings]
    ids = library()
    assert [x.tolist() for x in encode(texts)] == [ids(t) for t in texts]
    # Only the empty line isn't one pre-token; of each word there is one entry, and one more if it begins a text.
    assert sum("ß" in t for t in given) == 0
    assert len(encode.known.numbers) <= len(words) + 1 + 12


def test_encoder_equals_the_library_on_characters_of_all_kinds():
    chars = [chr(c) for c in (*range(0x800), *range(0x2000, 0x2070), *range(0x3000, 0x3010), 0x4E00, 0xFEFF, 0x1F600)]
    ids, encode = library(), Encoder(default_path())
    for around in ("{}", "a{}b", "1{}2", ".{}.", "a {}b", "a{}\nb", "\n{}\n", "a{}'s", "'{}"):
        texts = [around.format(c) for c in chars]
        assert [x.tolist() for x in encode(texts)] == [ids(t) for t in texts]


def plain_huffman_cost(counts):
    heap, cost = sorted(int(c) for c in counts if c), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    return cost


@pytest.mark.parametrize("limit", [4, 7, 20])
def test_code_lengths(limit):
    rng = np.random.default_rng(limit)
    counts = (rng.pareto(0.7, 16) * 10).astype(np.int64)
    lengths = huffman.code_lengths(counts, limit)
    assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= limit
    used = lengths[lengths > 0].astype(int)
    assert sum(2.0**-x for x in used) <= 1
    if limit == 20:
        assert (lengths.astype(int) * counts).sum() == plain_huffman_cost(counts)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_codes_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.pareto(0.5, n), 999).astype(np.uint16)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=1000), 12)
    codes = huffman.canonical_codes(lengths)
    body = huffman.block_body(7, np.array([3]), np.array([0]), np.array([n]), ids, codes, lengths)
    start, docs, nulls, sizes, got = huffman.read_block(body, huffman.Decoder(lengths))
    assert (start, docs.tolist(), nulls.tolist(), sizes.tolist()) == (7, [3], [0], [n])
    assert got.tolist() == ids.tolist()


@pytest.mark.parametrize("n", [32767, 32768, 32769, 70001])
def test_codes_over_several_stretches(n):
    ids = np.minimum(np.random.default_rng(n).pareto(0.5, n), 999).astype(np.uint16)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=1000), 12)
    payload, checkpoints, bits = huffman.encode(ids, huffman.canonical_codes(lengths), lengths)
    assert len(payload) == (bits + 7) // 8 == (int(lengths[ids].sum()) + 7) // 8
    assert huffman.Decoder(lengths)(payload, checkpoints, n).tolist() == ids.tolist()


def test_archive_round_trip(spark):
    rows = [(k * 7 % 101, ODD[k % len(ODD)], None) for k in range(101)] + [(500, "long text, " * 30000, "x"), (None, "no id", None), (3, "twice", None), (3, "twice", None)]
    got = huffman.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3), keep_ids=True).collect()
    ids = library()
    want, start = [], 0
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1] or "")):
        x = ids(text) + [0]
        want.append((doc, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), x))
        start += len(x)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_empty_table(spark):
    assert huffman.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
