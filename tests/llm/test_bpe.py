import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from barline.llm.bpe import decode, digests, encode, tokenizer_path, vocabulary

LIBRARY = Tokenizer.from_file(tokenizer_path())
OWN = vocabulary(tokenizer_path())


def plain(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def own(text):
    return np.frombuffer(OWN.encode([text])[0], "<u4").tolist()


@settings(max_examples=800, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert own(text) == plain(text)


@settings(max_examples=800, deadline=None)
@given(st.text(alphabet="abcdefghilmnoprstuaeiou'éßΣ <|>1", max_size=60))
def test_word_like_text(text):
    assert own(text) == plain(text)


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|>a<|startoftext|>", "<|endoftext", "ΑΣ ΑΣ.", "İx", "a\x1cb\x85c", "x" * 5000, "lo" * 3000, "it's we'll 'something", "é", "日本 한국", "👍🏽 ok", "𞤀𞤁"])
def test_special_cases(text):
    assert own(text) == plain(text)


def test_words_of_the_tables(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert [np.frombuffer(i, "<u4").tolist() for i in OWN.encode(texts)] == [plain(t) for t in texts]


def test_rows(rows):
    df = rows([(1, None), (2, ""), (3, "Hello world " * 20000), (3, "Hello"), (None, "Ünïcode<|endoftext|>")], "doc_id bigint, text string")
    got = sorted(((r.doc_id or 0), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests(df).collect())
    want = []
    for r in df.collect():
        ids = plain(r.text or "")
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    assert digests(df.limit(0)).count() == 0
    assert decode(encode(df)).where("n_tokens = 0").count() == 2
