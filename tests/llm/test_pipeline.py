import random

import corpus_pipeline
from tabulens.llm import mixing
from tests.llm.conftest import prose


def staged(spark, docs):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        out.append(spark.createDataFrame(docs.collect(), docs.schema))
        docs = out[-1]
    return [x.collect() for x in out]


def test_decisions_take_effect(spark, documents):
    rng = random.Random(1)
    clean = [(i, prose(rng, rng.randrange(60, 120), 10**6), "ab"[i % 2]) for i in range(60)]
    copies = [(100 + i, clean[0][1], "a") for i in range(30)]
    near = [(200 + i, clean[1][1] + f" tail{i}", "b") for i in range(30)]
    bad = [(300, "too short", "a"), (301, "x y z " * 40, "b"), (302, None, "a")]
    docs = documents(clean + copies + near + bad)
    quality, dedup, mixed, pieces = staged(spark, docs)
    assert sorted(r.doc_id for r in quality) == sorted(k for k, _, _ in clean + copies + near)
    assert sorted(r.doc_id for r in dedup) == sorted(k for k, _, _ in clean)
    size = {k: len(t.split()) for k, t, _ in clean}
    total = sum(size.values())
    # Each source comes as near as a document that is still missing is long.
    assert abs(sum(size[r.doc_id] for r in mixed) - 1.5 * total) < 2 * min(size.values())
    assert {r.asDict().keys() == set(docs.columns) for r in quality + dedup + mixed} == {True}
    assert sorted(r.doc_id for r in pieces) == sorted(r.doc_id for r in mixed) and all(r.lossless and len(r.token_ids) == r.n_tokens for r in pieces)


def test_nulls_repeats_and_no_rows(spark, documents):
    rng = random.Random(2)
    text = prose(rng, 80, 10**6)
    rows = [(None, text, None), (None, text, None), (5, prose(rng, 80, 10**6), None), (5, text, "s"), (None, None, "s")]
    quality, dedup, mixed, pieces = staged(spark, documents(rows))
    assert len(quality) == 4 and sorted((r.doc_id, r.text == text) for r in dedup) == [(5, False), (5, True)]
    assert mixed and len(pieces) == len(mixed)
    assert staged(spark, documents([])) == [[], [], [], []]


def test_run_on_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = corpus_pipeline.run(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got and all(r.lossless and r.doc_id in texts for r in got)
    assert mixing.VOLUME == 1.5 and len(got) > len({r.doc_id for r in got})
