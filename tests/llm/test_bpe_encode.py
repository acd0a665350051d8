import os
import random

import pytest

from helixmill.llm.bpe_encode import PATTERN, TOKENIZER_DIR, Encoder, byte_characters, encode_corpus, load_ranks, serialise_model

RANKS = os.path.join(TOKENIZER_DIR, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no public tokenizers here")
TEXTS = ["", "Hello world", "don't  stop\n\n  x", "Größe – Ωμέγα 中文 한국어 العربية 🦠✅", "<|endoftext|> <unk> ▁ text", "\x00\x01\x7f​﻿", "a" * 20_000, " " * 300 + "x", "1234567890" * 50]


@pytest.fixture(scope="module")
def tokens():
    return load_ranks(RANKS)


def test_equals_public_encoder(tokens):
    import tiktoken

    public = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(1)
    alphabet = [chr(c) for c in (*range(32, 127), *range(0xA0, 0x250), *range(0x400, 0x460), 0x4E2D, 0x1F9A0, 10, 9)]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(300)]
    encoder = Encoder(serialise_model(tokens))
    got = encoder.encode_batch(texts)
    assert got == [public.encode_ordinary(t) for t in texts]
    assert [encoder.decode(i) for i in got] == texts


def test_byte_characters_are_distinct():
    assert len(set(byte_characters())) == 256


def test_operator(spark):
    rows = spark.createDataFrame([(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "Hello world", "x")], "doc_id long, text string, ids_old string")
    got = {r.doc_id: list(r.ids) for r in encode_corpus(rows, text="text", key="doc_id").collect()}
    assert got[2] == got[3] == [] and got[1] == got[4] and len(got[1]) == 2
    assert encode_corpus(rows.limit(0), text="text", key="doc_id").count() == 0


def test_another_vocabulary_needs_its_pattern(spark):
    rows = spark.createDataFrame([(1, "Hello, world")], "doc_id long, text string")
    with pytest.raises(ValueError, match="pattern"):
        encode_corpus(rows, text="text", key="doc_id", vocabulary=RANKS)
    own = encode_corpus(rows, text="text", key="doc_id", vocabulary=RANKS, pattern=r"(?s).").first().ids
    assert list(own) != list(encode_corpus(rows, text="text", key="doc_id").first().ids)
