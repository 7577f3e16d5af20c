import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tabulens.operators import anomaly, headers, review
from tabulens.plans import ingest, perceive
from tabulens.operators import graph
from tabulens.sinks import documents
from tabulens.sources import delimited, formats, rows, typed, workdir
from tabulens.streaming import microbatch, windows
from tests.conftest import SAMPLE, lines_of


def test_ingest_by_chunk_and_as_a_whole(sample):
    whole = ingest.ingest(sample, scope="global")
    chunk = ingest.ingest(sample, chunk_rows=4)
    assert whole.profiles.count() == 5 and chunk.profiles.count() == 10
    assert chunk.rows.select("_chunk_id").distinct().count() == 2
    assert whole.methods == ("z_score",)
    forest = ingest.ingest(sample, scope="global", forest=True)
    assert forest.methods == ("z_score", "isolation_forest")
    assert forest.rows.orderBy(F.desc("_anomaly_score")).first()._row_idx == 2
    one_chunk = ingest.ingest(sample, forest=True)
    assert one_chunk.rows.orderBy(F.desc("_anomaly_score")).first()._row_idx == 2
    small_chunks = ingest.ingest(sample, chunk_rows=4, forest=True)  # too few rows for a forest
    assert small_chunks.rows.where("_anomaly_score is null").count() == 0


def test_chunk_sinks(spark, sample, tmp_path):
    done = ingest.ingest(sample, chunk_rows=4)
    for folders in (True, False):
        path = str(tmp_path / f"chunks_{folders}")
        documents.write_chunks(done.rows, path, folders)
        back = spark.read.csv(path, header=True)
        assert back.count() == 7 and {"_chunk_id", "_anomaly_score"} <= set(back.columns)
    metadata = documents.chunk_metadata(done.profiles, done.rows, {"source_file": F.lit("s.csv")}, done.methods)
    documents.write_metadata(metadata, str(tmp_path / "meta"))
    first, second = spark.read.json(str(tmp_path / "meta")).orderBy("_chunk_id").collect()
    assert (first.row_offset, first.chunk_rows, first.shape) == (0, 4, [4, 6])
    assert (second.row_offset, second.chunk_rows, second.source_file) == (4, 3, "s.csv")
    assert len(first.anomaly.row_score) == 4 and first.anomaly.methods == ["z_score"]
    assert set(first.anomaly.per_column.asDict()) >= {"id", "amount"} and all(len(z) == 4 for z in first.anomaly.per_column if z is not None)
    assert first.column_profiles.amount.unique_count == 4 and first.column_types.amount == "numeric"


def test_result_document(spark, sample, sample_lines):
    seen = perceive.perceive(anomaly.coerce_numeric(sample), "s")
    decision = delimited.decide(formats.head_lines(sample_lines))
    document = documents.result_document(decision, seen.labels, graph.graph_summary(seen.nodes, seen.edges), "s").first()
    result = json.loads(document.document)
    assert result["l1_metadata"]["confidence"] == "HIGH" and result["l1_metadata"]["delimiter"] == ","
    assert result["l2_result"]["top_attributes"][0] == "temporal_pattern"
    assert result["l2_result"]["knowledge_graph_summary"] == {"entity_count": 6, "relationship_count": 6}
    assert len(result["l2_result"]["attribute_labels"]) == 15


def test_result_documents_of_several_tables(spark):
    """One document per file, each with the labels and the graph of its own table."""
    decisions = spark.createDataFrame([("f1", ",", "a"), ("f2", ";", "a"), ("f3", "|", "b"), ("f4", ",", "c")], "file_id string, delimiter string, of string")
    scores = "confidence double, semantic_score double, statistical_score double, raw_fused double, source string"
    labels = spark.createDataFrame([(t, f"{t}{i}", i / 10, 0.0, 0.0, 0.0, "x") for t in "ab" for i in range(15)], f"table string, attribute string, {scores}")
    summary = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "graph string, entity_count long, relationship_count long")
    found = [(r.table, json.loads(r.document)) for r in documents.result_document(decisions, labels, summary, F.col("of")).collect()]
    got = sorted((t, d["l1_metadata"]["file_id"], d["l2_result"]["top_attributes"][0], d["l2_result"]["knowledge_graph_summary"]["entity_count"]) for t, d in found if t != "c")
    assert [set(d) for t, d in found if t == "c"] == [{"l1_metadata"}]
    assert got == [("a", "f1", "a14", 1), ("a", "f2", "a14", 1), ("b", "f3", "b14", 3)]


def test_typed_scan(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c\n1,x,NA\n"2,500",y,3\n,z,\n')
    df = typed.read_typed(spark, str(tmp_path))
    assert [t for _, t in df.dtypes] == ["double", "string", "double"]
    assert sorted(tuple(r) for r in df.collect() if r.b != "z") == [(1.0, "x", None), (2500.0, "y", 3.0)]


@pytest.fixture(scope="module")
def decisions(spark):
    texts = {"good": SAMPLE, "years": "2023,2024,2025\n100,120,150\n80,90,100\n"}
    lines = lines_of(spark, texts)
    head = formats.head_lines(lines)
    found = headers.detect_headers(head)
    return lines, spark.createDataFrame(found.collect(), found.schema)


def test_review_gate_and_prompts(decisions):
    lines, found = decisions
    closed = {r.file_id: r for r in review.review_gate(found).collect()}
    assert (closed["good"].review_source, closed["years"].review_source) == ("skipped", "fallback")
    assert closed["years"].reasoning == "LLM not available"
    opened = {r.file_id: r for r in review.review_gate(found, available=True).collect()}
    assert opened["years"].review_source == "llm"
    (prompt,) = review.review_prompts(formats.raw_preview(lines), review.review_queue(found)).collect()
    assert prompt.file_id == "years"
    assert prompt.prompt.startswith("Analyze this CSV:\n\nRow 0: 2023,2024,2025\nRow 1: 100,120,150\n")
    assert "\n\nL1 candidates:\n  Row " in prompt.prompt


@pytest.mark.parametrize(
    "reply, row, source, sure",
    [
        ('Here: {"header_row": 1, "confidence": "LOW", "reasoning": "x"} done', 1, "llm", "LOW"),
        ('{"header_row": 0}', 0, "llm", "MEDIUM"),
        ('{"header_row": "2"}', 2, "llm", "MEDIUM"),
        ("no idea", 0, "fallback", "N/A"),
        ('{"header_row": "first"}', 0, "fallback", "N/A"),
    ],
)
def test_review_answers(spark, decisions, reply, row, source, sure):
    _, found = decisions
    replies = spark.createDataFrame([("years", reply), ("good", '{"header_row": 5}')], "file_id string, response string")
    got = {r.file_id: r for r in review.apply_reviews(found, replies).collect()}
    years, good = got["years"], got["good"]
    assert (years.reviewed_header_row, years.review_source, years.review_confidence) == (row, source, sure)
    assert years.changed == (row != years.original_header_row)
    assert (good.reviewed_header_row, good.review_source, good.changed) == (0, "skipped", False)


def test_stream_of_two_batches(spark, tmp_path):
    schema = "_row_idx long, a string, b string"
    for i in range(2):
        part = spark.createDataFrame([(10 * i + j, str(j), "x" if j % 2 else None) for j in range(10)], schema)
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    )
    out = str(tmp_path / "out")
    microbatch.profile_stream(stream, out, str(tmp_path / "progress")).awaitTermination()
    profiles = spark.read.parquet(f"{out}/profiles")
    assert {(r.batch_id, r["column"]): (r.unique_count, r.null_rate) for r in profiles.collect()} == {
        (i, c): v for i in range(2) for c, v in (("a", (10, 0.0)), ("b", (1, 0.5)))
    }
    batches = spark.read.json(f"{out}/batches/*").orderBy("batch").collect()
    assert [(r.batch, r.row_offset, r.chunk_rows) for r in batches] == [(0, 0, 10), (1, 10, 10)]
    assert spark.read.parquet(f"{out}/rows").where("_anomaly_score is not null").count() == 20


def test_stream_equals_batch_by_window(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    profile = windows.window_profile(stream, "ts", "value")
    windows.closed_windows(profile, str(tmp_path / "w"), str(tmp_path / "p")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "w")).drop("batch_id")
    last = batch.agg(F.max("ts")).first()[0]
    want = windows.window_profile(batch, "ts", "value").where(F.col("window_start") + F.expr("INTERVAL 2 DAYS") <= F.lit(last))
    columns = ["window_start", "rows", "null_rate", F.round("mean", 8).alias("mean"), "distinct_approx"]
    assert got.count() == want.count() > 5
    assert got.select(*columns).exceptAll(want.select(*columns)).count() == 0


def test_updates_hold_every_window(spark, tmp_path):
    """Several batches touch a window: its last row counts all of them, and the windows still open are there."""
    days = [["2025-01-01 10:00:00"], ["2025-01-01 11:00:00", "2025-01-02 10:00:00"], ["2025-01-02 12:00:00"], ["2025-01-20 00:00:00"], ["2025-01-20 00:30:00"], ["2025-01-01 12:00:00", "2025-01-20 01:00:00"]]
    for i, times in enumerate(days):
        df = spark.createDataFrame([(t, 1.0) for t in times], "ts string, value double").select(F.col("ts").cast("timestamp"), "value")
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema("ts timestamp, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    windows.updated_windows(windows.window_profile(stream, "ts", "value"), str(tmp_path / "w"), str(tmp_path / "p")).awaitTermination()
    got = windows.latest_windows(spark.read.parquet(str(tmp_path / "w")))
    assert sorted((str(r.window_start)[:10], r.rows) for r in got.collect()) == [("2025-01-01", 2), ("2025-01-02", 2), ("2025-01-20", 3)]


def test_late_rows_are_dropped(spark, tmp_path):
    """One file a batch: the second moves the watermark past the first day, whose row in the last is too late."""
    days = [["2025-01-01 10:00:00", "2025-01-01 11:00:00"], ["2025-01-09 10:00:00"], ["2025-01-10 10:00:00"], ["2025-01-01 12:00:00", "2025-01-20 00:00:00"]]
    for i, times in enumerate(days):
        df = spark.createDataFrame([(t, 1.0) for t in times], "ts string, value double").select(F.col("ts").cast("timestamp"), "value")
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema("ts timestamp, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    windows.closed_windows(windows.window_profile(stream, "ts", "value"), str(tmp_path / "w"), str(tmp_path / "p")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "w"))
    assert {(str(r.window_start)[:10], r.rows) for r in got.collect()} == {("2025-01-01", 2), ("2025-01-09", 1), ("2025-01-10", 1)}


def test_shared_folder_is_read_from_the_session(spark):
    assert workdir.fresh_folder(spark, "x").startswith(workdir.shared_root(spark))
    assert spark.conf.get("spark.checkpoint.dir") == workdir.shared_root(spark)


def test_chunk_offsets(spark):
    df = rows.with_chunks(spark.range(25).withColumnRenamed("id", "_row_idx"), chunk_rows=10)
    got = rows.chunk_offsets(df).orderBy("_chunk_id").collect()
    assert [tuple(r) for r in got] == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]


def test_entry_and_registry(spark):
    queries, oracle = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracle) <= set(queries)
    own = {q for q in set(queries) - set(oracle) if not q.startswith("op") and q != "pipeline"}
    assert own == {
        "F5_chunk_forest", "F5_isolation_forest", "F6_forest_ensemble",
    }
    assert entry_points.entry(spark).count() == 15


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, with_pipeline):
    """A copy without the package, with and without the pipeline's file, has all other queries and their SQL."""
    root = Path(entry_points.__file__).parent
    for name in ("tabulens", "workload"):
        shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "tabulens" / "llm" / "__pycache__").mkdir(parents=True)  # what a deleted package may leave
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if with_pipeline and (root / "corpus_pipeline.py").exists() else [])):
        shutil.copy(root / name, tmp_path / name)
    asked = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", asked], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert set(done.stdout.split()) == {q for q in entry_points.queries() if not q.startswith("op") and q != "pipeline"}


def test_lines_are_split_once_and_files_decided_once(spark, sample_lines):
    """No function over cells splits a line anew, no query that asks for decisions several times makes them several times."""
    rows = [("a", 0, "x,y,z"), ("a", 1, "1,NA,3"), ("a", 2, "4"), ("a", 3, "5,,6,7"), ("b", 0, "x|y"), ("b", 1, "i|1|2|3"), ("b", 2, "j")]
    lines = spark.createDataFrame(rows, "file_id string, line_no long, line string")
    wanted = [("a", ",", 0, 0, ["x", "y", "z"], 0), ("b", "|", 0, 0, ["x", "y"], 1)]
    decisions = spark.createDataFrame(wanted, "file_id string, delimiter string, header_row int, header_line_no long, names array<string>, index_width int")
    scanned = delimited.scan_rows(lines, decisions)
    got = {(r.file_id, r.line_no): (r.cells, r._index, r._extra) for r in scanned.collect()}
    assert got == {
        ("a", 1): (["1", None, "3"], [], []), ("a", 2): (["4", None, None], [], []), ("a", 3): (["5", None, "6"], [], ["7"]),
        ("b", 1): (["1", "2"], ["i"], ["3"]), ("b", 2): ([None, None], ["j"], []),
    }
    plan = scanned.select("cells")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("split(" in part.split("lambda x")[0] for part in plan.split("lambdafunction(")[1:])
    counted = entry_points.queries()["A4_line_count"](spark, "/root/testdata/sf0.001")
    assert "first_is_comment" not in counted._jdf.queryExecution().optimizedPlan().toString()
