import random

import pytest
from pyspark.sql import functions as F

from tabulens.operators import histogram, profile, states
from tabulens.sources import rows


@pytest.fixture(scope="module")
def golden(sample):
    return {r["column"]: r for r in profile.column_profile(histogram.value_histogram(sample)).collect()}


COLUMNS = ("id", "timestamp", "amount", "category", "description")


@pytest.mark.parametrize(
    "field, expected",
    [
        ("null_rate", (0.0, 0.142857, 0.142857, 0.142857, 0.142857)),
        ("unique_count", (7, 6, 6, 3, 3)),
        ("entropy", (1.94591, 1.791759, 1.791759, 0.867563, 0.867563)),
        ("is_id_like", (True, False, False, False, False)),
        ("avg_length", (1.0, 17.5, 6.333, 1.0, 12.833)),
        ("column_type", ("numeric", "text", "numeric", "text", "text")),
    ],
)
def test_golden_profile(golden, field, expected):
    assert tuple(golden[c][field] for c in COLUMNS) == expected


def test_golden_types_and_samples(golden):
    assert golden["id"].type_scores.numeric == 1 and golden["amount"].type_scores.numeric == 1
    assert golden["timestamp"].type_scores.datetime == pytest.approx(5 / 6)
    assert golden["timestamp"].type_scores.text == pytest.approx(1 / 6)
    assert golden["category"].type_scores.text == 1
    assert golden["amount"].top_samples == ["123.45", "130.00", "99999999", "200.00", "150.00", "160.00"]
    assert golden["category"].top_samples == ["A", "B", "C"]


def test_trimmed_values_decide_the_categorical_score(spark):
    padded = [(i, " " * (i % 25) + "x") for i in range(100)]
    df = spark.createDataFrame(padded, "_row_idx long, v string")
    (row,) = profile.column_type_scores(histogram.value_histogram(df)).collect()
    assert row.type_scores.categorical == 1.0  # 25 values, one text
    (row,) = profile.distinct_counts(histogram.value_histogram(df)).collect()
    assert row.unique_count == 25


def test_profile_does_not_depend_on_row_order(sample):
    shuffled = sample.orderBy(F.rand(7))
    first = profile.column_profile(histogram.value_histogram(sample)).orderBy("column").collect()
    second = profile.column_profile(histogram.value_histogram(shuffled)).orderBy("column").collect()
    assert first == second


def test_empty_column(spark):
    df = spark.createDataFrame([(0, None), (1, None)], "_row_idx long, v string")
    (row,) = profile.column_profile(histogram.value_histogram(df)).collect()
    assert (row.null_rate, row.unique_count, row.entropy, row.avg_length) == (1.0, 0, 0.0, 0.0)
    assert row.column_type == "empty" and row.top_samples == [] and not row.is_id_like


def test_chunk_scope_equals_global_scope_of_one_chunk(sample):
    chunked = rows.with_chunks(sample)
    by_chunk = profile.column_profile(histogram.value_histogram(chunked, scope=("_chunk_id",)), ("_chunk_id",))
    assert sorted(by_chunk.drop("_chunk_id").collect()) == sorted(
        profile.column_profile(histogram.value_histogram(sample)).collect()
    )


def test_number_rows(spark):
    values = [5, 9, 11, 12, 40, 41, 42, 1000, 1001, 5000]
    df = spark.createDataFrame([(v,) for v in values], "k long").repartition(4)
    for buckets in (1, 3, 100):
        numbered = rows.number_rows(df, "k", buckets=buckets).orderBy("k").collect()
        assert [r._row_idx for r in numbered] == list(range(len(values)))
    dense = spark.range(10, 20).withColumnRenamed("id", "k")
    assert sorted(r._row_idx for r in rows.number_rows(dense, "k").collect()) == list(range(10))
    ties = spark.createDataFrame([(0,), (0,), (2,)], "k long")
    assert sorted(tuple(r) for r in rows.number_rows(ties, "k").collect()) == [(0, 0), (0, 1), (2, 2)]
    with pytest.raises(ValueError):
        rows.number_rows(spark.createDataFrame([(0,), (None,)], "k long"), "k")


def test_long_values_travel_as_digests(spark):
    long = ("a long text " * 40).strip()
    values = [long, long, long + " ", "short", "7" * 300, "z" * 300, None, "short", "short", " " * 300]
    df = spark.createDataFrame(list(enumerate(values)), "_row_idx long, v string")
    hist = histogram.value_histogram(df)
    assert max(len(r.value) for r in hist.where("value is not null").collect()) < 200
    (row,) = profile.column_profile(hist, source=df).collect()
    assert row.top_samples == ["short", long, long + " ", "7" * 300, "z" * 300, " " * 300]
    assert row.unique_count == 6 and row.null_rate == 0.1
    assert row.avg_length == pytest.approx(sum(len(v) for v in values if v) / 9, abs=1e-3)
    assert row.type_scores.numeric == pytest.approx((1 / 8) / (1 / 8 + 7 / 8))
    (row,) = profile.facts(hist).collect()
    assert (row.filled, row.filled_distinct, row.unpadded_distinct) == (8, 5, 4)
    assert (row.digit_values, row.alnum_values, row.castable_values) == (1, 5, 1)


def test_states_merge_as_the_whole_is_profiled(spark):
    """Chunks into files into a table, in two orders: sums exact, counters exact where few, within their limits elsewhere."""
    rng = random.Random(7)
    rows = []
    for i in range(6000):
        common = rng.choice("aaaaabbbc") if rng.random() < 0.3 else f"v{rng.randrange(3000)}"
        rows.append((i, i // 250 % 3, i // 250, rng.choice(["x", "y", None, " "]), common, str(i), None if i % 4 else f"2024-01-{i % 28 + 1:02d}"))
    df = spark.createDataFrame(rows, "_row_idx long, _file int, _chunk_id int, few string, many string, key string, day string")
    columns = ["few", "many", "key", "day"]
    whole = {r.column: r for r in profile.column_profile(histogram.value_histogram(df, columns)).collect()}
    hist = histogram.value_histogram(df, columns, ("_file", "_chunk_id"))
    counts = {c: {r.value: r.cnt for r in histogram.value_histogram(df, [c]).collect()} for c in columns}
    chunks = states.stored_state(states.profile_state(hist, ("_file", "_chunk_id"), counters=40))
    files = states.merged(chunks, ("_file",), counters=60)
    for state in (states.merged(chunks, counters=60), states.merged(files, counters=60)):
        got = {r.column: r for r in states.state_profile(state).collect()}
        assert got.keys() == whole.keys()
        for c, r in got.items():
            w = whole[c]
            assert (r.rows, r.null_rate, r.avg_length, r.column_type, r.is_id_like) == (w.rows, w.null_rate, w.avg_length, w.column_type, w.is_id_like)
            assert abs(r.unique_count - w.unique_count) <= 0.025 * w.unique_count
        for c in ("few", "day"):
            assert got[c].count_error == 0 and (got[c].top_samples, got[c].entropy, got[c].unique_count) == (whole[c].top_samples, whole[c].entropy, whole[c].unique_count)
        assert got["many"].count_error > 0 and got["many"].top_samples[:3] == whole["many"].top_samples[:3] == ["a", "b", "c"]
        assert abs(got["many"].entropy - whole["many"].entropy) < 0.3
        limits = {r.column: r.missed for r in state.counters.where("missed is not null").groupBy("column").agg(F.sum("missed").alias("missed")).collect()}
        for r in state.counters.where("value is not null").collect():
            assert r.cnt <= counts[r.column][r.value] <= r.cnt + limits.get(r.column, 0)
        listed = {(r.column, r.value) for r in state.counters.collect()}
        assert all(n <= limits.get(c, 0) for c in columns for v, n in counts[c].items() if v is not None and (c, v) not in listed)


def test_states_of_nothing(spark):
    df = spark.createDataFrame([], "_row_idx long, _chunk_id int, a string")
    state = states.profile_state(histogram.value_histogram(df, ["a"], ("_chunk_id",)), ("_chunk_id",))
    assert states.state_profile(states.merged(state)).collect() == []
    df = spark.createDataFrame([(0, 0, None), (1, 1, None)], "_row_idx long, _chunk_id int, a string")
    state = states.profile_state(histogram.value_histogram(df, ["a"], ("_chunk_id",)), ("_chunk_id",))
    (row,) = states.state_profile(states.merged(state)).collect()
    assert (row.rows, row.null_rate, row.unique_count, row.entropy, row.top_samples, row.column_type, row.count_error) == (2, 1.0, 0, 0.0, [], "empty", 0)
