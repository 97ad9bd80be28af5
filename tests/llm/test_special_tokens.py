"""Texts that spell an added token, against the library with nothing set."""

import zlib

import numpy as np
from test_huffman import ODD
from tokenizers import Tokenizer

import corpus_pipeline
from barwright.llm import queries
from barwright.llm.tokens import Encoder, default_path

TEXTS = [*ODD, "x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>b c", "<|endoftext| > no", "plain words only"]


def library():
    t = Tokenizer.from_file(default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder():
    got = Encoder(default_path(), specials_as_text=False)(TEXTS)
    assert [x.tolist() for x in got] == [library()(t) for t in TEXTS]
    assert 50256 in got[TEXTS.index("x <|endoftext|> y")]


def test_queries_and_pipeline_stage(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {k: (len(x := [*library()(t), 0]), zlib.crc32(np.array(x, "<u4").tobytes())) for k, t in enumerate(TEXTS)}
    got = queries.op6_huffman(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got} == want
    for out in (queries.op7_packing(spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))):
        assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in out.collect()} == want
