import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabulens.llm import bpe
from tabulens.llm.tokens import public_path
from tests.llm.conftest import prose

PATH = public_path("byte_bpe_50k.json")
TEXT = st.lists(
    st.sampled_from([" ", "  ", "\n", "\t", "the", "ing", "don't", "'LL", "é", "日本", "😀", "\x00", "\x1c", "\x85", "　", "!!", "<|endoftext|>", "1", "x", "͸", "Ⅷ", "՘"]),
    max_size=25,
).map("".join)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encoded(texts, vocabulary=None, **more):
    ids, sizes = (vocabulary or bpe.vocabulary_of(PATH)).encode(texts, **more)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4), st.sampled_from([1, 3, 40, bpe.TOGETHER]))
def test_tokens_as_the_library_however_cut(library, texts, size):
    expected = library.encode_batch(texts, add_special_tokens=False)
    assert encoded(texts, size=size) == [e.ids for e in expected]
    vocabulary = bpe.vocabulary_of(PATH)
    assert [vocabulary.decode(e.ids) for e in expected] == [library.decode(e.ids, skip_special_tokens=False) for e in expected]


def test_every_character_between_letters_digits_and_signs(library):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c}.{c}  x" for c in every[i : i + 500]) for i in range(0, len(every), 500)]
    assert encoded(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_words(library):
    rng = random.Random(1)
    texts = ["a" * 5000, "=" * 3001, " " * 4000 + "x", "ab" * 3000, "日本語" * 2000, "".join(rng.choice("abcdefgh") for _ in range(20_000))]
    texts += ["".join(rng.choice("abcde") for _ in range(n)) for n in range(bpe.SHORT - 5, bpe.SHORT + 6)]
    assert encoded(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_broken_tokens_and_strangers(library):
    rng = random.Random(2)
    vocabulary = bpe.vocabulary_of(PATH)
    for _ in range(300):
        ids = [rng.randrange(300) if rng.random() < 0.7 else rng.randrange(50_257) for _ in range(20)]
        assert vocabulary.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert vocabulary.decode([None, 10**6, -5, 464]) == "The"


def test_forgetting_and_plain_special_strings(library):
    texts = ["one two three", "a<|endoftext|>b", prose(random.Random(3), 500)]
    vocabulary = bpe.ByteBPE(PATH, plain=True)
    vocabulary.encode(texts)
    vocabulary.forget()
    library.encode_special_tokens = True
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    library.encode_special_tokens = False
    assert encoded(texts, vocabulary) == expected and expected != encoded(texts)


def test_table(spark, library, documents):
    rows = [(1, None, "s"), (2, "", "s"), (None, "é a", "s"), (3, "the cat " * 30_000, "s"), (3, "the cat " * 30_000, "s")]
    done = bpe.encode(documents(rows), PATH, decoded="back")
    got = done.collect()
    assert done.columns == [*documents([]).columns, "token_ids", "back"]
    for r in got:
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids and r.back == (r.text or "")
    assert sorted(r.size for r in got) == [f"x{n}" for n in range(5)]
    back = bpe.decode(done, PATH, out="text").collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, _ in rows)
    assert bpe.encode(documents([]), PATH).collect() == []
    clashing = spark.createDataFrame([("a b", [5], "x")], "text string, token_ids array<int>, ids string")
    (row,) = bpe.encode(clashing, PATH).collect()
    assert row.ids == "x" and row.token_ids == library.encode("a b").ids
    none = spark.createDataFrame([(None,), ([],), ([464, None],)], "token_ids array<int>")
    assert [r.decoded for r in bpe.decode(none, PATH).collect()] == ["", "", "The"]


def test_query_digests(spark, library, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = []
    for r, e in zip(rows, library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)):
        expected.append((r.doc_id, len(e.ids), sha(",".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.op11_bpe_roundtrip(spark, sf_dir).collect())) == sorted(expected)


def test_other_kinds_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe.ByteBPE(public_path("word_bpe_49k.json"))
