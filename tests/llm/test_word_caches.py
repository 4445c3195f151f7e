"""Word caches hold short words only, and results don't depend on what they hold."""

import pytest
import sentencepiece

from quern.llm import piece_codec, token_counts, toxicity
from quern.llm.common import CACHE_LENGTH, tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
LONG = "abcXYZ019/+" * 400
TEXTS = [f"{LONG} the end {LONG}", "語" * 900 + "\n" + "語" * 900, "x" * (CACHE_LENGTH - 1) + " " + "x" * CACHE_LENGTH + " " + "x" * (CACHE_LENGTH + 1)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("again", [1, 2])
def test_long_words_encode_like_the_library(library, again):
    encoder = piece_codec.Encoder(PATH)
    for text in TEXTS * again:
        assert list(memoryview(encoder.encode(text)).cast("I")) == library.encode(text)
    assert encoder and max(map(len, encoder)) == CACHE_LENGTH


def test_long_words_count_like_the_library(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS * 2)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PATH).collect()}
    assert got == {i: len(library.encode(t)) for i, t in enumerate(TEXTS * 2)}


def test_counts_and_words_keep_short_ones_only():
    counts, words = token_counts.Counts(PATH, frozenset()), toxicity.Words({"abc": 1.0})
    for text in TEXTS:
        for word in text.split():
            assert counts[word] == counts[word] and words[word] == words[word]
    assert counts and max(map(len, counts)) <= CACHE_LENGTH
    assert words and max(map(len, words)) <= CACHE_LENGTH
