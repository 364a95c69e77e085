import os
import random

import pytest

from weftline.llm.encoding import DEFAULT_VOCABULARY, TrieEncoder, Vocabulary, count_tokens, encode_texts

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def encoder():
    return TrieEncoder(Vocabulary.read(DEFAULT_VOCABULARY))


def texts(n=1500, seed=2):
    random.seed(seed)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "\r\n", "é", "中", "\U0001f600", "0", "12", "'s", "!", "...", "\x85", "\x1c", "​", "ß", "е", "՘", "\U000323b0", "=", "----", "\t", "　", "ÃÂ", "<|endoftext|>"]
    return ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(n)]


def test_trie_gives_what_merging_gives(encoder):
    for t in texts(400):
        assert encoder.encode(t) == [i for w in encoder.words(t) for i in encoder.v.plain(w.encode())]


def test_same_as_the_published_tokenizer(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(DEFAULT_VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    sample = texts(seed=5)
    assert [encoder.encode(x) for x in sample] == [x.ids for x in t.encode_batch(sample, add_special_tokens=False)]


def test_round_trip_and_one_long_word(encoder):
    for t in [*texts(200, 7), "a" * 50_000, "中" * 3000]:
        assert b"".join(encoder.v.tokens[i] for i in encoder.encode(t)).decode() == t


def test_column(spark):
    df = spark.createDataFrame([(1, "the cat", "x"), (2, "", "y"), (3, None, "z"), (1, "the cat", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in encode_texts(df).collect())
    assert got[0] == got[1] and len(got[0][1]) == 2 and got[2:] == [(2, []), (3, [])]
    assert sorted(r.n_tokens for r in count_tokens(df).collect()) == [0, 0, 2, 2]
    assert encode_texts(df.limit(0)).count() == 0
