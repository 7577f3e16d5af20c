import hashlib
import random

from pyspark.sql import functions as F

from tabulens.llm import syncmers
from tests.llm.conftest import prose


def anchors(spark, texts, **more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [[tuple(a) for a in r.a] for r in df.select("i", syncmers.anchors(F.col("t"), **more).alias("a")).orderBy("i").collect()]


def test_anchors_hang_on_their_words_alone(spark):
    rng = random.Random(1)
    passage = prose(rng, 60)
    alone, inside = anchors(spark, [passage, f"{prose(rng, 17)} {passage} {prose(rng, 9)}"])
    assert {(p + 17, h) for p, h in alone} <= set(inside)
    places = [p for p, _ in alone]
    assert places[0] <= syncmers.K - syncmers.S and all(b - a <= syncmers.K - syncmers.S for a, b in zip(places, places[1:]))


def test_short_empty_and_cased_texts(spark):
    got = anchors(spark, [None, "", " \n", "one", "ONE", "a b c", "A  b\tC"])
    assert got[:3] == [[], [], []] and len(got[3]) == 1 and got[3] == got[4] and got[5] == got[6] and len(got[5]) == 1


def plain_pairs(rows):
    """Rows sorted by key, null last; each with the first quarter of the next in place of its last."""
    rows = sorted(((k, t or "") for k, t, *_ in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for i, (k, t) in enumerate(rows):
        following, n = rows[(i + 1) % len(rows)][1], len(t) // 4
        yield k, t, t[: len(t) - n] + following[:n], following


def test_edits_whatever_the_blocks(documents):
    rng = random.Random(2)
    rows = [(rng.randrange(-10**6, 10**12), prose(rng, rng.randrange(0, 40)) + rng.choice(["", "é😀"]), "s") for _ in range(80)]
    rows += [(None, "no key", "s"), (5, None, "s"), (7, "", "s"), (rows[0][0], rows[0][1], "s")]
    want = sorted((k or 0, t, e) for k, t, e, _ in plain_pairs(rows))
    for blocks in (1, 3, 16, 200):
        got = sorted((r.key or 0, r.text, r.edited) for r in syncmers.edited_pairs(documents(rows), blocks=blocks).collect())
        assert got == want


def test_one_row_and_none(documents):
    (row,) = syncmers.edited_pairs(documents([(1, "abcdefgh", "s")])).collect()
    assert row.edited == "abcdefab" and row.next_hashes == row.hashes
    assert syncmers.edited_pairs(documents([])).collect() == []
    assert [r.edited for r in syncmers.edited_pairs(documents([(None, "abcd", "s")])).collect()] == ["abca"]


def test_query_against_plain_edits(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r for r in syncmers.op2_fingerprints(spark, sf_dir).collect()}
    same, last = {}, None
    assert len(got) == len(rows)
    for k, t, e, _ in plain_pairs(rows):
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.near_edited == 1 or t != e)
        assert same.setdefault(t, r.fingerprint) == r.fingerprint
        a, b = ({x[i : i + 8] for i in range(0, len(x), 8)} for x in (r.fingerprint, r.edited_fingerprint))
        assert r.near_edited == (2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0)
        assert last is None or last[0] == r.fingerprint or last[1] < 1
        last = (r.fingerprint, r.near_next)
    long = [r for r in got.values() if r.n_chars > 500]
    assert sum(r.near_edited for r in long) / len(long) > 0.6 and sum(r.near_next for r in long) / len(long) < 0.1


def test_native_and_long(spark, documents, sf_dir):
    plan = syncmers.op2_fingerprints(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    rng = random.Random(4)
    text = prose(rng, 50_000, 5000)
    (row,) = syncmers.edited_pairs(documents([(1, text, "s")])).collect()
    assert len(row.hashes) > 15_000


def test_matched_positions(spark):
    df = spark.createDataFrame([("a b c d e f g h i j", "x y z a b c d e f g h i j")], "a string, b string")
    (row,) = df.select(syncmers.matched_positions(syncmers.anchors(F.col("a")), syncmers.anchors(F.col("b"))).alias("m"), syncmers.anchors(F.col("a"))["position"].alias("p")).collect()
    assert row.m == row.p
