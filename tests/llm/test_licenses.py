import random

from tabulens.llm import licenses
from tests.llm.conftest import prose


def brute(text, templates=licenses.TEMPLATES, least=licenses.CONTAINMENT):
    """Every window of every template's width, without filters; of overlapping ones the fullest, then the first."""
    words, out = licenses.words_of(text), []
    for label, t in templates:
        w = licenses.words_of(t)
        pairs = set(zip(w, w[1:]))
        windows = []
        for s in range(max(1, len(words) - len(w) + 1)):
            block = words[s : s + len(w)]
            held = len(pairs & set(zip(block, block[1:])))
            if held >= least * len(pairs) - 1e-9:
                windows.append((-held, s))
        taken = []
        for held, s in sorted(windows):
            if all(abs(s - other) >= len(w) for other, _ in taken):
                taken.append((s, -held / len(pairs)))
        out += [(label, c, s) for s, c in taken]
    return sorted(out)


def damaged(rng, text):
    w = text.split()
    for _ in range(rng.randrange(0, 1 + len(w) // 6)):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], ["x"], [w[i], "y"], [w[i].upper()]])
    return rng.choice([" ", "  ", "\n", ", "]).join(w)


def test_against_all_windows(documents):
    rng = random.Random(1)
    rows = []
    for i in range(150):
        parts = [prose(rng, rng.randrange(0, 40)), damaged(rng, rng.choice(licenses.TEMPLATES)[1]), prose(rng, rng.randrange(0, 20))]
        if i % 5 == 0:
            parts.append(damaged(rng, rng.choice(licenses.TEMPLATES)[1]))
        rows.append((i, " ".join(parts), "s"))
    got = {r.doc_id: sorted((m.label, m.containment, m.first_word) for m in r.matches) for r in licenses.scan_licenses(documents(rows)).collect()}
    assert got == {i: brute(t) for i, t, _ in rows} and sum(map(len, got.values())) > 100


def test_every_block_of_a_text(documents):
    """The same notice several times, next to each other and apart, whole and damaged."""
    rng = random.Random(4)
    rows = []
    for i, (label, t) in enumerate(licenses.TEMPLATES):
        twice = f"{prose(rng, 5)} {t} {t} {prose(rng, 30)} {t.upper()} {damaged(rng, t)}"
        rows.append((i, twice, "s"))
    got = {r.doc_id: sorted((m.label, m.containment, m.first_word) for m in r.matches) for r in licenses.scan_licenses(documents(rows)).collect()}
    assert got == {i: brute(t) for i, t, _ in rows}
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        assert sum(m == label and c == 1 for m, c, _ in got[i]) >= 3


def test_phrases_nulls_repeats_and_empty(documents):
    rows = [(1, "The MIT-License; mit license and CC BY", "s"), (2, None, "s"), (None, "", "s"), (3, "cc", "s"), (3, "cc", "s")]
    got = {(r.doc_id, i): r for i, r in enumerate(licenses.scan_licenses(documents(rows)).orderBy("doc_id").collect())}
    one = next(r for r in got.values() if r.doc_id == 1)
    assert one.n_words == 8 and [(p.first_word, p.label) for p in one.phrases] == [(1, "mit"), (3, "mit"), (6, "cc-by")]
    assert len(got) == 5 and licenses.scan_licenses(documents([])).collect() == []


def test_long_text(documents):
    rng = random.Random(2)
    text = prose(rng, 100_000) + " Released under the MIT License. " + prose(rng, 10)
    (row,) = licenses.scan_licenses(documents([(1, text, "s")])).collect()
    assert [(m.label, m.containment, m.first_word) for m in row.matches] == [("mit", 1.0, 100_000)]


def test_order_of_pairs_changes_no_match():
    rng = random.Random(3)
    texts = [damaged(rng, t) for _, t in licenses.TEMPLATES for _ in range(4)]
    pairs = {p for _, t in licenses.TEMPLATES for w in [t.split()] for p in zip(w, w[1:])}
    found = []
    for seed in range(2):
        rng = random.Random(seed)
        s = licenses.Scanner(licenses.ordered(iter(licenses.TEMPLATES), {p: rng.randrange(100) for p in pairs}, 0.8))
        found.append([{n: x for n, x in s.scan(licenses.words_of(t)).items()} for t in texts])
    assert found[0] == found[1]
