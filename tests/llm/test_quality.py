import random
from collections import Counter, defaultdict

from tabulens.llm import common, quality
from tests.llm.conftest import prose


def judged(df, **more):
    return [r for r in quality.apply_quality(df, **more).collect()]


def test_counts(documents):
    rows = [(1, "a b c a b c # |\n\nx  y\nx  y\n \t\nx  y", "s"), (2, None, None), (3, "", "s"), (3, "one", "s"), (None, "é b", "s")]
    got = {(r.doc_id, r.text): r.quality for r in judged(documents(rows))}
    q = got[1, rows[0][1]]
    assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines) == (14, 14, 2, 2)
    # a b c twice, and x y x y x y: windows x y x and y x y twice each
    assert q.n_repeat_words == 12
    assert got[2, None].n_words == 0 and got[2, None].base_failed and not got[2, None].kept and got[2, None].clean_text is None
    assert got[3, ""].n_dup_lines == 0 and got[3, "one"].n_words == 1 and got[None, "é b"].n_words == 1


def brute_repeat(text):
    w = text.split()
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)})


def test_repeated_words_against_brute_force(documents):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(0, 200), rng.choice([2, 5, 30])), "s") for i in range(60)]
    for r in judged(documents(rows)):
        assert r.quality.n_repeat_words == brute_repeat(r.text)


def boilerplate(rng, n, host="h"):
    return [(i, f"{prose(rng, 60)}\nShare  THIS page\n{prose(rng, 5)}", host) for i in range(n)]


def test_frequent_lines_go(documents):
    rng = random.Random(4)
    rows = boilerplate(rng, 40) + [(100, "share this PAGE " * 1 + "\n" + prose(rng, 60), "other")]
    thin = "\n".join(["Share this page"] * 20 + [prose(rng, 10)])
    rows.append((101, thin, "h"))
    got = {r.doc_id: r for r in judged(documents(rows))}
    assert got[0].quality.n_removed_words == 3 and "THIS" not in got[0].quality.clean_text and got[0].quality.kept
    assert got[0].quality.clean_text.count("\n") == 1
    assert got[100].quality.n_removed_words == 0 and got[100].quality.clean_text == rows[40][1]
    assert got[101].quality.n_removed_words == 60 and not got[101].quality.kept


def test_copies_are_one_document(documents):
    """Two thirds of a host are one text, in other cases and spacing: its lines are no boilerplate, whatever the host."""
    rng = random.Random(5)
    lines = [prose(rng, 12) for _ in range(10)]
    rows = [(i, prose(rng, 70), "h") for i in range(60)] + [(100 + i, "\n".join(lines), "h") for i in range(60)]
    rows += [(200 + i, "\n\n".join(f" {x.upper()}  " for x in lines), "h") for i in range(60)]
    assert all(r.quality.kept and r.quality.n_removed_words == 0 for r in judged(documents(rows)))


def test_documents_of_mostly_shared_lines(documents):
    """All of a hundred lines that different documents share are found, however many they are in each."""
    rng = random.Random(8)
    shared = [f"shared line {i}" for i in range(100)]
    rows = [(i, "\n".join([*shared, *(prose(rng, 20) for _ in range(3))]), "h") for i in range(60)]
    got = judged(documents(rows))
    assert all(r.quality.n_removed_words == 300 and not r.quality.kept and r.quality.clean_text.count("\n") == 2 for r in got)


def test_limit_does_not_grow_with_the_host(documents):
    """A footer in a twelfth of a host's documents goes, and so it does where the host is larger; one in fewer stays."""
    rng = random.Random(9)
    for n in (300, 900):
        rows = [(i, prose(rng, 60) + ("\nthe footer" if i < 25 else "\nanother" if i < 44 else ""), "h") for i in range(n)]
        got = {r.doc_id: r.quality for r in judged(documents(rows))}
        assert [got[i].n_removed_words for i in range(n)] == [2] * 25 + [0] * (n - 25)
        assert "footer" not in got[3].clean_text and got[30].clean_text.endswith("another")


def brute_rule(rows, least):
    norm = lambda x: " ".join(x.translate(str.maketrans(common.UPPER, common.LOWER)).split())
    lines = {n: [norm(x) for x in (t or "").split("\n") if x.split()] for n, (_, t, _) in enumerate(rows)}
    holders = defaultdict(set)
    for n, (_, _, host) in enumerate(rows):
        for x in lines[n]:
            holders[host, x].add(tuple(lines[n]))
    return [sum(len(x.split()) for x in lines[n] if len(holders[rows[n][2], x]) >= least) for n in range(len(rows))]


def test_frequent_lines_against_brute_force(documents):
    rng = random.Random(10)
    pool = [prose(rng, rng.randrange(1, 6), 30) for _ in range(40)]
    change = lambda x: x.upper() if rng.random() < 0.3 else x.replace(" ", "  ")
    rows = [(i, "\n".join(change(rng.choice(pool)) for _ in range(rng.randrange(0, 9))), rng.choice(["a", "b", None])) for i in range(150)]
    rows += [(i, rows[i][1], rows[i][2]) for i in range(0, 150, 7)]
    for least in (2, 10, 20):
        got = {r.size: r.quality.n_removed_words for r in judged(documents(rows), least=least)}
        assert [got[f"x{n}"] for n in range(len(rows))] == brute_rule(rows, least)


def test_own_names_as_extra_columns_and_one_evaluation(spark, documents):
    rng = random.Random(11)
    rows = [(i, f"{prose(rng, 60)}\nshare this", "h", "x", 1, "y", "z", "l") for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, c0 string, digest int, lines string, host string, removed string")
    out = quality.apply_quality(docs)
    assert out.columns == [*docs.columns, "quality"]
    assert all((r.c0, r.digest, r.lines, r.host, r.removed) == ("x", 1, "y", "z", "l") and r.quality.n_removed_words == 2 for r in out.collect())
    kept = out.where("quality.kept").select("doc_id", "quality.clean_text", "quality.n_words")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") == 2  # those of the features, once


def test_null_host_extra_columns_and_empty_table(documents):
    rng = random.Random(6)
    got = judged(documents(boilerplate(rng, 40, None)))
    assert len(got) == 40 and all(r.quality.n_removed_words == 3 and r.size.startswith("x") for r in got)
    assert judged(documents([])) == []


def test_long_text(documents):
    rng = random.Random(7)
    text = prose(rng, 60_000, 3000)
    (row,) = judged(documents([(1, text, "s")]))
    assert row.quality.n_words == 60_000 and row.quality.n_repeat_words == brute_repeat(text)
    assert Counter(text.split()).total() == 60_000
