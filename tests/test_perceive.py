import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulens.operators import anomaly, comoments, dependencies, fusion, graph, semantic, spectrum, statistical, tablefacts
from tabulens.plans import perceive


@pytest.fixture(scope="module")
def typed_sample(spark, sample):
    typed = anomaly.coerce_numeric(sample)
    return spark.createDataFrame(typed.collect(), typed.schema)


@pytest.fixture(scope="module")
def seen(typed_sample):
    return perceive.perceive(typed_sample, "sample_mixed")


def test_sample_labels(seen):
    labels = [(r.attribute, r.confidence) for r in seen.labels.collect()]
    assert labels[:5] == [
        ("temporal_pattern", 0.8348), ("high_cardinality", 0.6318), ("numeric_density", 0.5150),
        ("financial_indicators", 0.4655), ("sparsity", 0.3485),
    ]
    assert len(labels) == 15 and all(c == 0.2891 for _, c in labels[5:])
    assert [a for a, _ in labels[5:]] == sorted(a for a, _ in labels[5:])


def test_label_queries(seen):
    assert [r.attribute for r in fusion.top_attributes(seen.fused, 2).orderBy("rank").collect()] == [
        "temporal_pattern", "high_cardinality",
    ]
    assert fusion.above_threshold(seen.fused).count() == 3
    assert fusion.attribute_of(seen.fused, "sparsity").count() == 1


def test_sample_graph(seen):
    nodes = {r.id: r for r in seen.nodes.collect()}
    assert set(nodes) == {"table:sample_mixed"} | {f"column:{c}" for c in ("id", "timestamp", "amount", "category", "description")}
    kinds = {n.name: n.properties["semantic_type"] for n in nodes.values() if n.entity_type == "column"}
    assert kinds == {"id": "id", "timestamp": "datetime", "amount": "amount", "category": "text", "description": "text"}
    assert nodes["column:id"].properties["is_primary_key"] == "true"
    edges = [(r.src, r.dst, r.relation_type, r.weight) for r in seen.edges.collect()]
    assert len(edges) == 6
    assert ("column:timestamp", "column:amount", "temporal_context", 0.7) in edges
    summary = graph.graph_summary(seen.nodes, seen.edges).first()
    assert (summary.entity_count, summary.relationship_count) == (6, 6)
    assert summary.entity_types == ["column", "table"] and summary.relation_types == ["has_column", "temporal_context"]


@pytest.fixture(scope="module")
def orders(spark):
    days = [dt.datetime(2025, 1, d) for d in range(1, 9)]
    rows = [
        (i, 1000 + i, c, p, a, q, d, s, k)
        for i, (c, p, a, q, d, s, k) in enumerate(
            zip(
                ["C1", "C2", "C1", "C3", "C2", "C4", "C5", "C1"],
                ["Laptop", "Mouse", "Desk", "Chair", "Phone", "Lamp", "Cable", "Screen"],
                [10.0, 500.0, 35.5, 900.0, 120.0, 61.0, 7.5, 333.0],
                [1, 2, 3, 1, 2, 3, 1, 2],
                days,
                ["done", "open", "done", "done", "lost", "done", "open", "done"],
                ["A", "B", "C", "A", "B", "C", "A", "B"],
            )
        )
    ]
    schema = (
        "_row_idx long, order_id long, customer_id string, product_name string, amount double, quantity long, "
        "order_date timestamp, status string, category string"
    )
    return spark.createDataFrame(rows, schema)


def test_orders_graph(orders):
    facts = tablefacts.table_facts(orders, "orders", "_row_idx")
    nodes, edges = graph.build_graph({"orders": (orders, "_row_idx")}, facts)
    nodes, edges = nodes.collect(), [(r.src, r.dst, r.relation_type, r.weight) for r in edges.collect()]
    assert len(nodes) == 11 and {n.id for n in nodes} >= {"entity:Order", "entity:Customer", "table:orders"}
    assert ("column:order_id", "entity:Order", "references", 0.9) in edges
    assert ("column:customer_id", "entity:Customer", "references", 0.9) in edges
    assert ("column:order_date", "column:quantity", "temporal_context", 0.7) in edges
    assert ("column:order_date", "column:amount", "temporal_context", 0.7) in edges
    kinds = {n.name: n.properties for n in nodes if n.entity_type == "column"}
    assert kinds["product_name"]["semantic_type"] == "name" and kinds["quantity"]["semantic_type"] == "numeric"
    assert kinds["customer_id"]["unique_ratio"] == "0.6250" and kinds["order_date"]["data_type"] == "datetime64[ns]"
    scores = {r.attribute: r.score for r in statistical.statistical_scores(orders, facts, "orders", "_row_idx").collect()}
    assert scores["numeric_density"] == 0.375 and scores["high_cardinality"] == 0.5
    meaning = {r.attribute: r.score for r in perceive.semantic_channel(orders, "orders", "_row_idx").collect()}
    assert meaning["relational_structure"] == 0.25 and meaning["temporal_pattern"] == pytest.approx(0.3333, abs=1e-4)
    assert meaning["financial_indicators"] == pytest.approx(0.3175, abs=1e-4)


def test_entity_references(spark):
    names = {
        "customer_id": "Customer", "order_item_id": "OrderItem", "userId": "user", "productID": "product", "用户ID": "用户",
        "订单编号": "订单", "paid": "paid", "ORDER_ID": "Order", "user2_id": "User2", "a1b_id": "A1B",
    }
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.e for r in df.select("n", graph.entity_reference(F.col("n")).alias("e")).collect()}
    assert got == names
    for name, entity in names.items():
        if name.lower().endswith("_id"):
            assert name[:-3].title().replace("_", "") == entity


@pytest.mark.parametrize("n, limit", [(60, 100), (60, 12), (97, 20), (64, 8), (211, 32), (30, 29)])
def test_spectrum_equals_fft(spark, n, limit):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(2, n)) + 3 * np.sin(np.arange(n))
    points = [(c, i, float(v), 0.0) for c in (0, 1) for i, v in enumerate(x[c])]
    series = spark.createDataFrame(points, "c int, pos long, re double, im double").repartition(3)
    got = {(r.c, r.pos): complex(r.re, r.im) for r in spectrum.transform_series(series, n, limit).collect()}
    assert len(got) == 2 * n
    for c in (0, 1):
        assert np.allclose([got[c, k] for k in range(n)], np.fft.fft(x[c]))


def test_periodicity(spark):
    n = 200
    rows = [(3 * i + (i % 2), float(np.sin(2 * np.pi * i / 20)), 5.0, None if i % 10 else float(i), float(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "_row_idx long, wave double, flat double, few double, ramp double")
    got = {r.column: r for r in spectrum.column_periodicity(df, ["wave", "flat", "few", "ramp"], "_row_idx").collect()}
    assert got["wave"].periodicity == pytest.approx(1.0)
    assert got["flat"].periodicity is None
    assert got["few"].points == 20

    def expected(x):
        s = np.abs(np.fft.fft(x - np.mean(x)))[1 : len(x) // 2]
        return min(1.0, s.max() / (5 * s.mean()))

    assert got["ramp"].periodicity == pytest.approx(expected(np.arange(n)))
    assert got["few"].periodicity == pytest.approx(expected(np.arange(0, n, 10)))


def test_hierarchy_pairs(spark):
    rows = [("r1", "n1", "x"), ("r1", "n2", "y"), ("r2", "n3", "x"), ("r2", "n3", None), (None, "n4", "z"), ("r1", None, "y")]
    df = spark.createDataFrame(rows, "region string, nation string, code string")
    got = {(r.parent, r.child): r.holds for r in dependencies.hierarchy_pairs(df, ["region", "nation", "code"]).collect()}
    assert got == {("region", "nation"): True, ("region", "code"): False, ("nation", "code"): False}


@pytest.mark.parametrize("parts", [1, 7])
def test_dependencies_of_a_hundred_columns(spark, parts):
    """Against all pairs: dependencies that hold, that one row breaks, that only rows of different tasks break, and nulls."""
    rng = np.random.default_rng(8)
    columns = [f"c{i}" for i in range(100)]
    base = rng.integers(0, 40, 600)
    data = []
    for i in range(100):
        values = base // (1 + i % 5) if i % 3 else rng.integers(0, 6, 600)
        values = values + (np.arange(600) == i) * (i % 7 == 0)
        data.append([None if i % 11 == 0 and rng.random() < 0.1 else f"v{v}" for v in values])
    rows = list(zip(*data))
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)).repartition(parts)
    got = {(r.parent, r.child): r.holds for r in dependencies.hierarchy_pairs(df, columns).collect()}

    def holds(a, b):
        seen = {}
        for x, y in zip(data[a], data[b]):
            if x is not None and y is not None:
                seen.setdefault(y, set()).add(x)
        return bool(seen) and max(map(len, seen.values())) == 1

    want = {(columns[a], columns[b]): holds(a, b) for a in range(100) for b in range(a + 1, 100)}
    assert got == want and 100 < sum(want.values()) < 3000


def test_pairs_that_no_task_breaks_alone(spark):
    """Every task sees one parent for each child; only together they do not agree."""
    df = spark.createDataFrame([(f"p{i}", "x", f"u{i}") for i in range(8)], "a string, b string, c string").repartition(8, "c")
    got = {(r.parent, r.child): r.holds for r in dependencies.hierarchy_pairs(df, ["a", "b", "c"]).collect()}
    assert got == {("a", "b"): False, ("a", "c"): True, ("b", "c"): True}


def test_head_values_of_sparse_columns(spark):
    rows = [(i, "x", "late" if i >= 9000 else None) for i in range(10_000)]
    df = spark.createDataFrame(rows, "_row_idx long, a string, b string")
    got = {r.column: r.n for r in tablefacts.head_values(df, "_row_idx", 20).groupBy("column").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 20, "b": 20}


def test_embedding_consistency(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 8))
    df = spark.createDataFrame([(i % 3, [float(v) for v in row]) for i, row in enumerate(x)], "g int, e array<float>")
    for r in semantic.embedding_consistency(df, "g", "e").collect():
        u = x[r.g::3] / np.linalg.norm(x[r.g::3], axis=1, keepdims=True)
        sims = (u @ u.T)[np.triu_indices(len(u), 1)]
        assert r.semantic_consistency == pytest.approx(sims.mean(), abs=1e-6)


def test_correlations(spark):
    rows = [(float(i), 2.0 * i + 1, float(-i), 7.0, None if i % 3 else float(i * i)) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double, d double")
    got = {(r.left, r.right): r.r for r in graph.correlations(df, list("abckd")).collect()}
    assert got["a", "b"] == pytest.approx(1) and got["a", "c"] == pytest.approx(-1)
    assert got.get(("a", "k")) is None
    assert ("a", "k") in got and len(got) == 10
    i = np.arange(0, 30, 3)
    assert got["a", "d"] == pytest.approx(np.corrcoef(i, i * i)[0, 1])
    edges = graph.correlation_edges(df, "t", list("abckd")).collect()
    assert {(e.src, e.dst, e.relation_type) for e in edges} >= {
        ("column:a", "column:b", "correlates_with"), ("column:a", "column:c", "inversely_correlates"),
    }


@pytest.mark.parametrize("width", [4, 60])
def test_correlations_follow_one_rule_at_any_width(spark, width):
    """Missing values, a constant column, a far mean: as pairwise deletion gives it, in one read of the table."""
    rng = np.random.default_rng(3)
    columns = [f"c{i}" for i in range(width)]
    x = rng.normal(size=(300, width)) @ rng.normal(size=(width, width)) * 10 + 1e6
    x[:, 1] = 0.1 + 0.2
    x[rng.random((300, width)) < 0.1 * (np.arange(width) % 3 == 0)] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"{c} double" for c in columns)).repartition(5)
    got = {(r.left, r.right): r.r for r in graph.correlations(df, columns).collect()}
    assert len(got) == width * (width - 1) // 2
    for (a, b), r in got.items():
        i, j = columns.index(a), columns.index(b)
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert (r is None) == (1 in (i, j)) and (r is None or r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9))


def test_moments_merge_in_any_parts(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([np.sort(rng.normal(5, 1, 400)), rng.normal(1e6, 1e-2, 400), rng.normal(size=400)])
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], "a double, b double, c double")
    for parts in (df.coalesce(1), df.repartition(13), df.repartitionByRange(6, "a")):
        got = {(r.i, r.j): r for r in comoments.co_moments(parts, [F.col(c) for c in "abc"]).collect()}
        assert len(got) == 6
        for (i, j), r in got.items():
            dx, dy = x[:, i] - x[:, i].mean(), x[:, j] - x[:, j].mean()
            assert r.n == 400 and r.x == pytest.approx(x[:, i].mean()) and r.xx == pytest.approx((dx * dx).sum(), rel=1e-6) and r.xy == pytest.approx((dx * dy).sum(), rel=1e-5, abs=1e-7)


def test_rows_without_an_order_come_last(spark):
    for n in (10, 3000):
        df = spark.createDataFrame([(None, "late")] + [(i, f"v{i}") for i in range(n)], "k long, v string")
        got = {r["rank"]: r.value for r in tablefacts.head_values(df, "k", 3, exclude=("k",)).collect()}
        assert got == {1: "v0", 2: "v1", 3: "v2"}


@pytest.mark.parametrize(
    "schema, rows",
    [("_row_idx long, v long", []), ("_row_idx long, v long", [(0, 1)]), ("_row_idx long, `用户名` string, `年龄` long", [(0, "张三", 25)])],
)
def test_small_tables_do_not_fail(spark, schema, rows):
    seen = perceive.perceive(spark.createDataFrame(rows, schema), "tiny")
    scores = {r.attribute: r.score for r in seen.statistical.collect()}
    assert len(scores) == 15
    if not rows:
        assert set(scores.values()) == {0.0}
    assert seen.labels.count() == 15


def test_approximate_counts(orders):
    exact = {r["column"]: r.distinct for r in tablefacts.distinct_stats(orders).collect()}
    near = {r["column"]: r.distinct for r in tablefacts.approximate_distinct_stats(orders, 0.01).collect()}
    assert near == exact
