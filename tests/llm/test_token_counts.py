from collections import Counter

import pytest
from tokenizers import Tokenizer

from barwright.llm import token_counts
from barwright.llm.tokens import default_path

TEXTS = [
    None, "", " ", "  ", "\n", "a", " a", "a ", " a ", "a  b", "\n\nfoo bar", "foo\n", "\nfoo", "foo \nbar", "foo\n bar", "tabs\tand\x0bothers\x0c here", "can't won't I'll they're 'twas", "Ünïcödé straße été niño",
    "日本語 の テキスト", "x <|endoftext|> y", "<|endoftext|>", "12345 3.14159 1,000,000", "a b  c", "e\x1cf \x1f g", "emoji \U0001f600\U0001f468‍\U0001f469 end", "Ġ Ċ literal", "#" * 300, "word " * 700, "-- ... !!! ?!", "İstanbul ǅ ʰ ⅷ ² ½",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_path())


def brute(tokenizer, text):
    text = text or ""
    n = len(tokenizer.encode(text, add_special_tokens=False).ids)
    return len(text.encode()), n, n > 512


@pytest.mark.parametrize("specials_as_text", [False, True])
@pytest.mark.parametrize("entries", [4, 1 << 14])
def test_counts_equal_the_librarys_for_any_table(spark, tokenizer, specials_as_text, entries):
    long = " ".join(f"word{k % 977}," if k % 3 else "of\nthe  " for k in range(60_000))
    rows = [(k, t) for k, t in enumerate([*TEXTS, *TEXTS, long, "x" * 50_000])] + [(None, "one"), (3, "one"), (3, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tokenizer.encode_special_tokens = specials_as_text
    got = token_counts.count_tokens(df, specials_as_text=specials_as_text, entries=entries).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == brute(tokenizer, r.text), r.text and r.text[:60]
    assert any(r.over_limit for r in got)
    if specials_as_text is False:
        assert next(r.n_tokens for r in got if r.text == "<|endoftext|>") == 1
    tokenizer.encode_special_tokens = False


def test_documents_of_the_test_tables(spark, tokenizer):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r in token_counts.count_tokens(df, specials_as_text=False).collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == brute(tokenizer, r.text)


def test_summary_holds_every_frequent_pre_token(spark, tokenizer):
    texts = [" ".join(f"w{k}" for k in range(j % 150)) for j in range(900)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    true = Counter(p for t in texts for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(t or ""))
    for entries in (3, 40, 1000):
        got = token_counts.frequent(df, default_path(), entries=entries)
        assert len(got) <= entries
        total = sum(true.values())
        assert {p for p, n in true.items() if n > total / (entries + 1)} <= set(got)
        assert all(true[p] - total / (entries + 1) <= n <= true[p] for p, n in got.items())
    assert token_counts.frequent(df, default_path(), entries=1000) == dict(true)


def test_empty_table_other_columns_and_no_shuffle_of_pre_tokens(spark):
    empty = token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    df = spark.createDataFrame([(1, "a b", 7, "old", None)], "doc_id long, text string, n_tokens int, place string, over_limit string")
    out = token_counts.count_tokens(df)
    r = out.first()
    assert (r.n_tokens, r.place, r.n_bytes, r.over_limit) == (2, "old", 3, False)
    assert "Exchange" not in out._jdf.queryExecution().toString()


def test_sentencepiece_and_other_tokenizers_count_whole_texts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame([(t,) for t in TEXTS if t != " "], "text string")
    for r in token_counts.count_tokens(df, path=path).collect():
        assert r.n_tokens == len(model.encode(r.text or ""))
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    for r in token_counts.count_tokens(df, path=path, specials_as_text=False).collect():
        assert r.n_tokens == len(other.encode(r.text or "", add_special_tokens=False).ids)
