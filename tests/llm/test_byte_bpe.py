import hashlib

import numpy as np
import public_tokenizers as pt
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import byte_bpe

PATH = pt.path("byte_bpe_50k.tiktoken")
RANKS = byte_bpe.read_ranks(PATH)
BRUTE = tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = byte_bpe.Codec(byte_bpe.serialise_model(RANKS), pt.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_matches_and_round_trips(text):
    ids = CODEC.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == BRUTE.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_special_strings_white_space_and_long_words():
    for text in ("<|endoftext|> <unk> </s>", " \t\n  x  \n\n", "a\x1cb\x85  c", "ab" * 20_000, "'s I'll DON'T", "é \U0001f600‍", "\x00\x01"):
        ids = CODEC.encode([text])[0]
        assert np.frombuffer(ids, "<u4").tolist() == BRUTE.encode_ordinary(text)
        assert CODEC.decode(ids) == text.encode()


def test_rows_nulls_repeats_clashes_and_empty_table(spark):
    rows = [(1, "Hello there, world", "x"), (1, "Hello there, world", "x"), (2, None, None), (None, "", "y"), (3, "wo rd " * 30_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, byte_bpe.encode_digests(df, PATH, pt.PATTERN).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = BRUTE.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert byte_bpe.encode(df.limit(0), PATH, pt.PATTERN).collect() == []


def test_query_over_the_whole_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.op5_byte_bpe(spark, sf_small).collect()}
    assert len(got) == len(docs)
    for r in docs:
        ids = BRUTE.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
