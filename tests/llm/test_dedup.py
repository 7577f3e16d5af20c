import random
from itertools import combinations

import numpy as np
import pytest

from tabulens.llm import dedup
from tabulens.llm.components import components
from tests.llm.conftest import prose


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width, percent=80):
    """Least key per row by links between all pairs of rows with shingles."""
    sets = [shingles(t, width) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(groups[find(i)])) for i in range(len(rows)))


def found(df, **more):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in dedup.near_duplicates(df, **more).collect())


def edited(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("width", [2, 5])
def test_against_all_pairs(documents, width):
    rng = random.Random(width)
    rows = []
    for g in range(12):
        base = prose(rng, rng.choice([8, 40, 150, 400]), 5000)
        rows += [(len(rows) + k, edited(rng, base, rng.randrange(0, 1 + len(base.split()) // 25)), "s") for k in range(6)]
    rows += [(1000 + i, t, "s") for i, t in enumerate(["", None, " \n", "one", "ONE", "one two", "One  two", "two one"])]
    assert found(documents(rows), width=width) == brute(rows, width)


def test_chain_beyond_the_centre(documents):
    """Each text is near the next one only: one component, though no star holds them all."""
    rng = random.Random(1)
    words = prose(rng, 200, 10**6).split()
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words), "s"))
        words = words[4:] + prose(rng, 4, 10**6).split()
    got = found(documents(rows), width=2)
    assert {c for _, _, c in got} == {0} and got == brute(rows, 2)


def test_crowded_buckets_lose_no_link(documents):
    """Few bands of one row: buckets are crowded with unlike texts, and every link in them is found all the same."""
    rng = random.Random(2)
    rows = [(i, prose(rng, 30, 12), "s") for i in range(60)] + [(100 + i, prose(rng, 3, 4), "s") for i in range(60)]
    got = found(documents(rows), width=1, percent=60, bands=40, rows=1)
    assert got == brute(rows, 1, 60)


def test_keys_that_repeat_or_lack(documents):
    rng = random.Random(3)
    a, b = prose(rng, 50, 10**6), prose(rng, 50, 10**6)
    rows = [(None, a, "s"), (7, a, "s"), (7, b, "s"), (None, b, "s"), (7, a, "s"), (9, None, "s"), (9, None, "s"), (None, None, "s")]
    got = dedup.near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows) and all(r.component_id == 7 for r in got if r.n_shingles)
    kept = dedup.keep_one_of_each(documents(rows)).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:4]) for r in kept) == sorted([(7, a[:4]), (7, b[:4]), (9, ""), (9, ""), (0, "")])
    assert set(kept[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "size"}


def test_one_of_each_stays(documents):
    rng = random.Random(4)
    copy, near = prose(rng, 60, 10**6), prose(rng, 200, 10**6)
    rows = [(i, copy, "s") for i in range(50)] + [(100 + i, edited(rng, near, 1), "s") for i in range(50)] + [(200 + i, prose(rng, 60, 10**6), "s") for i in range(20)]
    assert sorted(r.doc_id for r in dedup.keep_one_of_each(documents(rows)).collect()) == [0, 100, *range(200, 220)]


def test_empty_table_and_long_text(documents):
    assert found(documents([])) == [] and dedup.keep_one_of_each(documents([])).collect() == []
    rng = random.Random(5)
    text = prose(rng, 40_000, 10**5)
    assert {c for _, _, c in found(documents([(5, text, "s"), (3, edited(rng, text, 100), "s")]))} == {3}


def test_sketch_agrees_as_often_as_sets_do():
    rng = np.random.default_rng(6)
    s = dedup.Sketcher(40, 6)
    for n in (3, 20, 200, 2000):
        shared, own = rng.integers(0, 2**63, 8 * n, dtype=np.uint64), rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = np.concatenate([shared, own[:n]]), np.concatenate([shared, own[n:]])
        assert abs((s.sketch(a) == s.sketch(b)).mean() - 0.8) < 0.13


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)] + [(500, 500)]
    root = {x: x for e in edges[:-1] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges[:-1]:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in root if x not in loops}
