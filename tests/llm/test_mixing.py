import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from tabulens.llm import mixing
from tests.llm.conftest import prose


def mixed(df):
    return mixing.mix(df, mixing.text_words(F.col("text"))).collect()


def brute_targets(sizes, weights=(3, 1, 2), volume=1.5, most=2):
    """The rule as it is said: full sources stop, and what is over goes to the others by weight until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, rest = {s: 0.0 for s in order}, volume * sum(sizes.values())
    while rest > 1e-9:
        room = [s for s in order if target[s] < most * sizes[s] - 1e-9]
        total = sum(weight[s] for s in room)
        if not room:
            break
        given, rest = rest, 0.0
        for s in room:
            target[s] += given * weight[s] / total
            if target[s] > most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_sums(documents, seed):
    rng = random.Random(seed)
    hosts = ["a", "B", "é", None, "z", "empty"]
    rows = [(i, prose(rng, rng.choice([1, 3, 17, 60, 200])), rng.choice(hosts[:5] + ["a"] * 4)) for i in range(300)] + [(900, None, "empty"), (901, "", "empty")]
    got = mixed(documents(rows))
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = brute_targets(sizes)
    taken = {s: 0 for s in sizes}
    for r in got:
        assert r.mix.source_size == sizes[r.source] and r.mix.target == pytest.approx(target[r.source], abs=1e-6)
        assert r.mix.size == len((r.text or "").split()) and 0 <= r.mix.times <= 2
        taken[r.source] += r.mix.times * r.mix.size
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1 or s == "empty"


def test_reruns_and_partitions_agree(documents):
    rng = random.Random(9)
    df = documents([(i, prose(rng, rng.randrange(1, 30)), "ab"[i % 2]) for i in range(200)])
    plain = lambda x: sorted((r.doc_id, r.mix.times) for r in mixed(x))
    assert plain(df) == plain(df.repartition(7)) == plain(df.orderBy(F.desc("doc_id")))


def test_hot_length_repeats_and_nulls(documents):
    rows = [(i, "x y z", "hot") for i in range(500)] + [(None, "one two", None)] * 5 + [(1000 + i, "w " * 100, "b") for i in range(40)]
    got = mixed(documents(rows))
    by = {}
    for r in got:
        by[r.source] = by.get(r.source, 0) + r.mix.times * r.mix.size
    target = brute_targets({"hot": 1500, None: 10, "b": 4000})
    assert abs(by["hot"] - target["hot"]) < 3 and abs(by["b"] - target["b"]) < 100
    assert len({r.mix.times for r in got if r.source is None}) == 1 and all(r.size.startswith("x") for r in got)


def test_empty_table_and_no_words(documents):
    assert mixed(documents([])) == []
    assert [r.mix.target for r in mixed(documents([(1, None, "a"), (2, " ", None)]))] == [0.0, 0.0]


def test_fit_against_all_choices():
    rng = random.Random(1)
    for _ in range(60):
        lengths = rng.sample(range(1, 30), 4)
        counts = [rng.randrange(1, 4) for _ in lengths]
        total = sum(n * c for n, c in zip(lengths, counts))
        budget = rng.randrange(total + 1)
        reached = {sum(n * k for n, k in zip(lengths, ks)) for ks in product(*[range(c + 1) for c in counts])}
        share = [min(c, int(budget / total * c)) for c in counts]
        above = {sum(n * k for n, k in zip(lengths, ks)) for ks in product(*[range(s, c + 1) for s, c in zip(share, counts)])}
        got = mixing.fit_counts(lengths, counts, budget)
        assert all(0 <= k <= c for k, c in zip(got, counts))
        made = sum(n * k for n, k in zip(lengths, got))
        assert made in reached and made == max(x for x in above if x <= budget)


def test_wide_budgets_are_met_to_the_word():
    rng = random.Random(2)
    lengths = sorted(rng.sample(range(1, 20_000), 900))
    counts = [rng.randrange(1, 500) for _ in lengths]
    total = sum(n * c for n, c in zip(lengths, counts))
    for budget in (0, 1, 10**6, total // 3, total * 9 // 10, total, total + 5):
        got = mixing.fit_counts(lengths, counts, budget)
        assert all(0 <= k <= c for k, c in zip(got, counts))
        assert min(budget, total) - sum(n * k for n, k in zip(lengths, got)) in ((0,) if budget != 1 or 1 in lengths else (0, 1))
