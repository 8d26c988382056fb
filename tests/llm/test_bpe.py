import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hindcast.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(bpe.BYTE_BPE_50K.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


TEXTS = ["", " ", "Hello world", "it's  we'll\n\n x", "<|endoftext|> a", "naïve café — ２０２４ ½ ²³ ٣", "🙌🏽 𝐀𝐁", "a b c\u0085d \x1c\x1d", "日本語のテキスト。", "a" * 3000, " " * 5000, "\t\r\n" * 9, "x" * 700 + "é" * 300]


def test_whole_texts(public):
    enc = bpe.encoder(bpe.BYTE_BPE_50K)
    for text in TEXTS:
        assert enc.encode(text) == public.encode(text, add_special_tokens=False).ids
        assert enc.size(text) == len(enc.encode(text))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(public, text):
    assert bpe.encoder(bpe.BYTE_BPE_50K).encode(text) == public.encode(text, add_special_tokens=False).ids


def test_both_merges_agree():
    ranks = bpe.encoder(bpe.BYTE_BPE_50K).words.ranks
    rng = random.Random(5)
    for _ in range(300):
        word = bytes(rng.choices(b"abcde  tionxyz", k=rng.randint(1, 80)))
        assert bpe.merge_short(word, ranks) == bpe.merge_long(word, ranks)


def test_rows(spark, public):
    df = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "one two"), (4, "one two")], "doc_id long, text string").selectExpr("*", "7 as ids", "'x' as n_tokens")
    rows = sorted((r.doc_id, tuple(r.ids)) for r in bpe.encode_texts(df).collect())
    ids = tuple(public.encode("one two").ids)
    assert rows == [(1, ids), (2, ()), (3, ()), (4, ids), (4, ids)]
    assert sorted(map(tuple, bpe.text_sizes(df).collect())) == [(1, 2), (2, 0), (3, 0), (4, 2), (4, 2)]
    assert bpe.encode_texts(df.limit(0)).count() == 0
