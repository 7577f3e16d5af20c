import hashlib
import json
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tabulens.llm import align
from tabulens.llm.tokens import public_path
from tests.llm.conftest import prose

A, B = public_path("byte_bpe_50k.json"), public_path()


@pytest.fixture(scope="module")
def encoders():
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_table():
    """The character of each byte, as the decoder of the library has it, found by its own pre-tokenizer."""
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    table = {}
    for c in [chr(i) for i in range(0x800)] + ["￿", "\U0010ffff", *(chr(i << 12) for i in range(1, 16) if i != 13), *(chr(i << 16) for i in range(1, 17))]:
        (token, _), *_ = cut.pre_tokenize_str(c)
        table |= dict(zip(token, c.encode()))
    return table


def brute(encoders, texts):
    """Per text: (ids of a, ids of b, groups as text, links as places), by comparing every two tokens of a text."""
    tokenizer, model = encoders
    of_character = byte_table()
    names = {i: t for t, i in json.load(open(A))["model"]["vocab"].items()}
    out = []
    for text in texts:
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        pieces = [model.id_to_piece(i) for i in b]
        raw_a = [bytes(of_character[c] for c in names[i]) for i in a]
        raw_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            out.append(([], [], "", []))
            continue
        spans = []
        for raw in (raw_a, raw_b):
            ends = [sum(map(len, raw[: i + 1])) for i in range(len(raw))]
            spans.append([(e - len(r), e) for r, e in zip(raw, ends)])
        links = [(i, j) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s in zip(ids, side) if low < s[1] <= end) for ids, side in zip((a, b), spans)))
            low = end
        out.append((a, b, ";".join(groups), links))
    return out


def expected(encoders, rows):
    found = brute(encoders, [t or "" for _, t, _ in rows])
    counts = Counter((a[i], b[j]) for a, b, _, links in found for i, j in links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for (key, _, _), (a, b, groups, links) in zip(rows, found):
        pairs = [(a[i], b[j]) for i, j in links]
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        n_best = sum(counts[p] == best[p[1]] for p in pairs)
        out.append((key, len(a), len(b), groups.count(";") + bool(groups), len(links), n_best, sum(counts[p] for p in pairs), digest))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r))


ODD = ["", " ", "  two", "▁ sign", "<|endoftext|> <s> <0x41>", "日本語 é 😀", "\n\n\tx", "don't stop", "a\u0000b", "aaaaaaaaaaaaaaaa", "Ⅷ ͸՘"]


@pytest.mark.parametrize("share", [3, 60, align.SHARE])
def test_against_brute_force(documents, encoders, share):
    """Whether most pairs are broadcast, some are, or all are joined, rows are those of all pairs compared."""
    rng = random.Random(2)
    words = ["the", "tokenization", "straße", "naïve", "10,000", "日本", "foo_bar", "ing"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))), "s") for i in range(40)]
    rows += [(None, t, "s") for t in ODD] + [(7, None, None), (7, "the the", "s"), (7, "the the", "s")]
    got = align.align_and_count(documents(rows), A, B, share=share).collect()
    assert ordered(got) == ordered(expected(encoders, rows))


def test_lists_and_groups(documents, encoders):
    rows = [(i, t, "s") for i, t in enumerate([*ODD, "plain words, tokenization."])] + [(99, None, "s")]
    got = {r.doc_id: r.aligned for r in align.align(documents(rows), A, B).collect()}
    for (key, _, _), (a, b, groups, _) in zip(rows, brute(encoders, [t or "" for _, t, _ in rows])):
        assert (got[key].a_ids, got[key].b_ids) == (a, b)
        at_a = at_b = 0
        texts = []
        for g in got[key].groups:
            texts.append(",".join(map(str, a[at_a : at_a + g.n_a])) + "|" + ",".join(map(str, b[at_b : at_b + g.n_b])))
            at_a, at_b = at_a + g.n_a, at_b + g.n_b
        assert ";".join(texts) == groups and (at_a, at_b) == (len(a), len(b))


def test_long_text_empty_table_and_clashing_names(spark, documents, encoders):
    rng = random.Random(3)
    rows = [(1, prose(rng, 400_000, 50), "s"), (2, "short", "s")]
    got = {r.doc_id: r for r in align.align_and_count(documents(rows), A, B).collect()}
    # Groups of links: tokens of both sides less one each.
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups for r in got.values()) and got[1].n_a > 400_000
    assert align.align_and_count(documents([]), A, B).collect() == []
    clashing = spark.createDataFrame([("k", "a b", "x", "y", 1)], "key string, text string, row string, links string, pair int")
    (row,) = align.align_and_count(clashing, A, B, key="key").collect()
    assert row.key == "k" and row.n_links == 2
    (row,) = align.align(clashing, A, B, out="links").collect()
    assert row.row == "x" and row.links.groups
