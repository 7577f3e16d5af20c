import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulens.llm import pieces, tokens

PATH = tokens.public_path()
TEXT = st.lists(
    st.sampled_from([" ", "  ", "\n", "\t", "▁", "the", "ing", "é", "日本", "執", "😀", "\x00", "A", "!!", "<s>", "</s>", "<0x41>", "　", "1", "x"]), max_size=25
).map("".join)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def counted(text, chunk=65_536):
    machine = tokens.machine_of(PATH)
    return tokens.tokens_of(machine, (text[i : i + chunk] for i in range(0, len(text), chunk)))


@settings(max_examples=400, deadline=None)
@given(TEXT, st.sampled_from([1, 2, 3, 7, 50]))
def test_counts_as_the_library_whatever_the_chunks(library, text, chunk):
    assert counted(text, chunk) == len(library.encode(text))


def test_long_texts_and_forgetting(library):
    rng = random.Random(1)
    machine = tokens.machine_of(PATH)
    for text in ("a" * 20_000, "▁" * 3000, "日本語" * 4000, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(5000)), " " * 5001):
        assert counted(text, 512) == len(library.encode(text))
        machine.bound(0)


def test_maps_compose_in_any_grouping():
    machine = tokens.machine_of(PATH)
    text = "▁the▁▁cat\nsat▁on▁" + "x" * 30 + "▁mat"
    parts = [tokens.chunk_map(machine, text[i : i + 5]) for i in range(0, len(text), 5)]
    first = tokens.ChunkMap("", "", 0, machine.start)
    left = first
    for p in parts:
        left = tokens.composed(machine, left, p)
    right = parts[-1]
    for p in reversed(parts[:-1]):
        right = tokens.composed(machine, p, right)
    assert left.count == tokens.composed(machine, first, right).count == tokens.scanned(machine, [first, *parts]).count


def test_table(spark, library, documents):
    rows = [(1, None, "s"), (2, "", "s"), (None, "é a", "s"), (3, "the cat " * 3000, "s"), (3, "the cat " * 3000, "s")]
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(documents(rows), PATH).collect()))
    n = len(library.encode(rows[3][1]))
    assert got == [(0, 4, len(library.encode("é a")), False), (1, 0, 0, False), (2, 0, 0, False)] + [(3, 24_000, n, n > 4096)] * 2
    assert tokens.count_tokens(documents([]), PATH).collect() == []


def test_query_against_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = tokens.op3_token_counts(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.n_bytes) == (len(library.encode(texts[r.doc_id])), len(texts[r.doc_id].encode()))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_sampled_pieces_give_the_text_back(text):
    lattice = pieces.lattice_of(PATH)
    (ids,) = lattice.sample([text], [7])
    assert (lattice.decode(ids.tolist()) if len(ids) else "") == text


def test_samples_hang_on_the_key_alone(spark, documents):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["there", "the", "nothing", "執x"]) for _ in range(30)), "s") for i in range(40)] + [(50, None, "s"), (None, "the", "s")]
    plain = lambda df: sorted((r.doc_id or -1, r.token_ids, r.size) for r in pieces.encode_sampled(df, PATH).collect())
    one = plain(documents(rows))
    assert one == plain(documents(rows).repartition(5)) and [x for x in one if x[0] == 50][0][1] == []
    other = sorted((r.doc_id or -1, r.token_ids) for r in pieces.encode_sampled(documents(rows), PATH, seed=1).collect())
    assert [x[:2] for x in one] != other
    assert pieces.decode_pieces(pieces.encode_sampled(documents([]), PATH), PATH).collect() == []


def test_sampling_follows_the_weights():
    lattice = pieces.lattice_of(PATH)
    n, word = 30_000, " there"
    weights = {}

    def walk(at, ids, weight):
        if at == len(word):
            weights[ids] = weight
        for end in range(at + 1, len(word) + 1):
            token, share = lattice.table.get(word[at:end], (-1, 0.0))
            if token >= 0:
                walk(end, (*ids, token), weight * share)

    walk(0, (), 1.0)
    drawn = {}
    for ids in lattice.sample([word[1:]] * n, range(n)):
        drawn[tuple(ids.tolist())] = drawn.get(tuple(ids.tolist()), 0) + 1
    total = sum(weights.values())
    assert set(drawn) <= set(weights)
    assert all(abs(drawn.get(k, 0) / n - w / total) < 0.015 for k, w in weights.items())


def test_long_words_are_sampled_and_read_back():
    lattice = pieces.lattice_of(PATH)
    text = "a" * 3000 + "😀" * 200 + "theandthe" * 300 + "不" * 500
    (ids,) = lattice.sample([text], [1])
    assert lattice.decode(ids.tolist()) == text


def test_sampling_query(spark, sf_dir):
    got = pieces.op8_sampled_pieces(spark, sf_dir).collect()
    assert got and all(r.lossless for r in got)
