import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulens.functions.predicates import to_number
from tabulens.functions.scoring import finite
from tabulens.operators import anomaly, iforest, quantiles
from tabulens.sources import rows

# Scores of the seven sample rows without a forest.
WITHOUT_FOREST = (0.458745, 0.305830, 0.700000, 0.0, 0.152915, 0.409059, 0.458745)
# Published scores with a forest; solving the ensemble for its share gives the forest's part.
PUBLISHED = (0.355927, 0.194380, 0.700000, 0.085393, 0.076458, 0.340888, 0.313706)


def in_order(df, *columns):
    return [tuple(r) for r in df.orderBy("_row_idx").select(*columns).collect()]


def test_sample_scores(sample):
    scored = anomaly.score_rows(sample).persist()
    got = in_order(scored, "_anomaly_score", "_missing_ratio", "_z")
    assert [g[0] for g in got] == pytest.approx(WITHOUT_FOREST, abs=1e-6)
    assert [g[1] for g in got] == pytest.approx([0, 0, 0, 0, 0, 0.8, 0])
    assert [g[2]["id"] for g in got] == pytest.approx([1.5, 1.0, 0.5, 0, 0.5, 1.0, 1.5])
    assert [g[2]["amount"] for g in got] == pytest.approx([0.447214] * 2 + [2.236068] + [0.447214] * 2 + [0] + [0.447214], abs=1e-5)
    assert set(got[0][2]) == {"id", "amount"}
    scored.unpersist()


def test_ensemble_with_published_forest_part(spark, sample):
    z = [1.5 + 0.447214, 1.0 + 0.447214, 0.5 + 2.236068, 0.447214, 0.5 + 0.447214, 1.0, 1.5 + 0.447214]
    z = [v / 2 for v in z]
    z_norm = [(v - min(z)) / (max(z) - min(z) + 1e-9) for v in z]
    missing = [0, 0, 0, 0, 0, 0.8, 0]
    iso = [(s - 0.35 * a - 0.3 * m) / 0.35 for s, a, m in zip(PUBLISHED, z_norm, missing)]
    given_iso = spark.createDataFrame([(i, v) for i, v in enumerate(iso)], "_row_idx long, _iso double")
    scored = anomaly.score_rows(sample.join(given_iso, "_row_idx"), iforest_score="_iso")
    assert [s for (s,) in in_order(scored, "_anomaly_score")] == pytest.approx(PUBLISHED, abs=2e-5)


def test_chunk_scope_of_one_chunk_is_global(sample):
    chunked = rows.with_chunks(sample)
    by_chunk = in_order(anomaly.score_rows(chunked, anomaly.CHUNK), "_anomaly_score")
    assert np.ravel(by_chunk) == pytest.approx(np.ravel(in_order(anomaly.score_rows(sample), "_anomaly_score")))


def test_length_fallback(spark):
    df = spark.createDataFrame(
        [(i, "x" * n, v) for i, (n, v) in enumerate([(1, "a"), (2, "b"), (3, "c"), (30, None)])], "_row_idx long, p string, q string"
    )
    got = in_order(anomaly.score_rows(df), "_mean_z", "_missing_ratio", "_anomaly_score")
    lengths = np.array([2, 3, 4, 33.0])
    z = np.abs(lengths - lengths.mean()) / lengths.std()
    expected = 0.6 * (z - z.min()) / (z.max() - z.min() + 1e-9) + 0.4 * np.array([0, 0, 0, 0.5])
    assert [g[0] for g in got] == pytest.approx(z)
    assert [g[2] for g in got] == pytest.approx(expected)


def test_marking_keeps_rows_and_columns(sample):
    marked = anomaly.mark_anomalies(sample)
    assert marked.columns == [*sample.columns, "_anomaly_score"]
    assert marked.count() == 7
    assert all(0 <= s <= 1 for (s,) in in_order(marked, "_anomaly_score"))


def test_coercion(sample):
    types = dict(anomaly.coerce_numeric(sample).dtypes)
    assert (types["id"], types["amount"], types["timestamp"]) == ("double", "double", "string")


@pytest.mark.parametrize("few, buckets", [(1, 9), (20, 64), (10_000, 4096)])
def test_exact_medians(spark, few, buckets):
    """Heavy ties, one distinct value, no value, NaN, infinities, tiny and huge numbers of both signs, even and odd counts."""
    rng = np.random.default_rng(3)
    n = 2001 if buckets > 4 else 301
    tied = np.where(rng.random(n) < 0.6, 0.25, rng.normal(size=n))
    wide = np.sign(rng.normal(size=n)) * 10.0 ** rng.uniform(-300, 300, n)
    small = np.concatenate([10.0 ** rng.uniform(-300, -290, n - 1), [0.0]])
    ends = np.concatenate([np.full(n // 2 + 1, -np.inf), np.full(n // 2, np.inf)])
    two = np.concatenate([np.full(n // 2, -1.5), np.full(n // 2, 2.5), [np.nan]])
    data = {"tied": tied, "wide": wide, "small": small, "ends": ends, "two": two, "same": np.full(n, -7.0), "count": np.arange(n) - 5.0, "negative": -(10.0 ** rng.uniform(0, 9, n))}
    frame = spark.createDataFrame([tuple(map(float, row)) for row in zip(*data.values())], ", ".join(f"{c} double" for c in data))
    got = quantiles.exact_medians(frame, {**{c: F.col(c) for c in data}, "none": F.lit(None)}, few=few, buckets=buckets)
    assert got.pop("none") is None
    assert got == {c: pytest.approx(float(np.nanmedian(x)), rel=1e-15, abs=0) for c, x in data.items()}


@pytest.mark.parametrize("trees, share", [(5, 0.3), (100, 0.001), (100, 0.9), (3, 1.0), (1, 0.5)])
def test_rows_join_trees_as_independent_draws_would(trees, share):
    chances = iforest._joins(trees, share)
    exact = [sum(math.comb(trees, j) * share**j * (1 - share) ** (trees - j) for j in range(k + 1)) for k in range(trees)]
    assert chances == pytest.approx(exact, abs=1e-12)


def test_samples_are_even(spark):
    """Each tree takes as many rows as it needs, rows are taken alike often, and partitions do not matter."""
    df = spark.range(6000).select(F.col("id").alias("x"), F.col("id").alias("order"))
    drawn = iforest._sample(df, F.col("order"), 6000, 40, 64, 42)
    assert {r["count"] for r in drawn.groupBy("tree").count().collect()} == {64} and drawn.select("tree").distinct().count() == 40
    halves = drawn.groupBy((F.col("x") < 3000).alias("half")).count().collect()
    assert all(abs(r["count"] - 1280) < 130 for r in halves)
    assert iforest._sample(df.repartition(9), F.col("order"), 6000, 40, 64, 42).exceptAll(drawn).count() == 0


def features(df):
    return {c: finite(to_number(F.col(c))) for c in ("id", "amount")}


def test_forest_ranks_the_planted_outlier_among_the_first(spark):
    rng = np.random.default_rng(1)
    table = [(i, float(rng.normal()), float(rng.normal()), None if i % 50 == 7 else float(rng.normal())) for i in range(3000)]
    table[1234] = (1234, 25.0, -25.0, 25.0)
    df = spark.createDataFrame(table, "_row_idx long, a double, b double, c double")
    cols = {c: F.col(c) for c in "abc"}
    # Few small trees hardly ever hold the outlier itself, so it is only among the first hundredth then.
    for limits, first in (({}, 1), ({"trees": 20, "subsample": 32}, 30)):
        scored = iforest.isolation_scores(df, cols, F.col("_row_idx"), **limits)
        best = {r._row_idx: r._iforest_score for r in scored.orderBy(F.desc("_iforest_score")).limit(first).collect()}
        assert 0.6 < best[1234] < 1
        again = iforest.isolation_scores(df.repartition(7), cols, F.col("_row_idx"), **limits)
        assert again.exceptAll(scored).count() == 0


def test_chunk_forest_leaves_other_columns_alone(spark):
    table = [(i, None if i % 3 else 2**53 + 2 * i + 1, float(i % 7) if i != 77 else 1e6, f"t{i}") for i in range(100)]
    df = rows.with_chunks(spark.createDataFrame(table, "_row_idx long, big long, a double, t string"), chunk_rows=50)
    done = iforest.chunk_isolation_scores(df, {"a": F.col("a")})
    assert done.columns == [*df.columns, "_iforest_score"] and done.select(*df.columns).exceptAll(df).count() == 0
    assert done.orderBy(F.desc("_iforest_score")).first()._row_idx == 77
    again = iforest.chunk_isolation_scores(df.repartition(5), {"a": F.col("a")})
    assert again.exceptAll(done).count() == 0


def test_forest_needs_rows(sample, spark):
    few = sample.where("_row_idx < 4")
    assert few.transform(lambda d: iforest.isolation_scores(d, features(d), F.col("_row_idx"))).first()._iforest_score is None
    enough = iforest.isolation_scores(sample, features(sample), F.col("_row_idx"))
    assert enough.orderBy(F.desc("_iforest_score")).first()._row_idx == 2


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 300), st.integers(1, 4), st.integers(0, 2**31))
def test_tree_partitions_all_rows(n, d, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 1)
    nodes = iforest.grow_tree(x, rng)
    leaves = [node for node in nodes if node[1] == -1]
    assert len(nodes) == 2 * len(leaves) - 1
    assert max(node[5] for node in leaves) <= np.ceil(np.log2(max(n, 2))) + iforest.mean_path(n) + 1e-9


def test_forests_of_many_chunks_grow_as_tree_by_tree(spark):
    """Chunks that share a task get the very trees, and scores, that each gets alone, tree after tree."""
    rng = np.random.default_rng(3)
    tables = [rng.normal(size=(300, 3)), rng.integers(0, 4, (90, 3)).astype(float), np.ones((7, 3)), rng.normal(size=(5, 3))]
    for x, forest in zip(tables, iforest.Forest.grown(tables, 9, 64, 5)):
        psi, nodes = min(64, len(x)), []
        for tree in range(9):
            draw = np.random.default_rng([5, tree])
            grown = iforest.grow_tree(x[draw.choice(len(x), psi, replace=False)], draw)
            part = pd.DataFrame(grown, columns=["node", "feature", "threshold", "left", "right", "length"])
            nodes.append(part.assign(tree=tree))
        alone = iforest.Forest(pd.concat(nodes), psi)
        for part in ("feature", "threshold", "length"):
            assert (getattr(forest, part) == getattr(alone, part)).all()
    # Chunks of unequal size, the first without a column, the last too small, each cut by the bounds of batches.
    a = F.when(F.col("_row_idx") >= 40, F.col("_row_idx") * 7 % 31).cast("double")
    df = spark.range(163).withColumnRenamed("id", "_row_idx").withColumns({"_chunk_id": F.floor(F.col("_row_idx") / 40), "a": a, "b": F.col("_row_idx") * 5 % 17})
    features, key = {"a": F.col("a"), "b": F.col("b")}, "spark.sql.execution.arrow.maxRecordsPerBatch"
    score = lambda: {r._row_idx: r._iforest_score for r in iforest.chunk_isolation_scores(df, features, trees=5, subsample=16).collect()}
    whole, before = score(), spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        assert score() == whole
    finally:
        spark.conf.set(key, before)
    assert [i for i, s in whole.items() if s is None] == [160, 161, 162] and len(whole) == 163
    third = df.where("_chunk_id = 2").orderBy("_row_idx").toPandas()[["a", "b"]].to_numpy(float)
    assert [whole[i] for i in range(80, 120)] == iforest.Forest.grown([third], 5, 16, iforest.SEED)[0].score(third).tolist()
