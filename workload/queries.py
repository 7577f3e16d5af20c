"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.functions import predicates
from tabulens.functions.scoring import finite
from tabulens.operators import (
    anomaly,
    fusion,
    graph,
    headers,
    histogram,
    iforest,
    profile,
    review,
    semantic,
    spectrum,
    states,
    statistical,
    tablefacts,
)
from tabulens.plans import ingest, perceive
from tabulens.sinks import documents
from tabulens.sources import delimited, formats, heads, rows, typed
from tabulens.sources.workdir import fresh_folder, stored
from tabulens.streaming import microbatch, windows
from workload import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIRTY = ["order_id", "customer_id", "status", "amount", "order_date", "priority", "note"]


def _wide_integers(df: DataFrame) -> DataFrame:
    narrow = [c for c, t in df.dtypes if t in ("int", "smallint", "tinyint")]
    return df.withColumns({c: F.col(f"`{c}`").cast("long") for c in narrow}) if narrow else df


def query(name: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: _wide_integers(f(spark, sf_dir))
        return f

    return register


def r6(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return typed.clean_nulls(fx.dirty_orders(spark, sf))


def hist(spark: SparkSession, sf: str) -> DataFrame:
    return histogram.value_histogram(clean(spark, sf))


def head(spark: SparkSession, sf: str) -> DataFrame:
    return formats.head_lines(fx.rendered_lines(spark, sf))


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    return headers.rank_candidates(headers.score_candidates(head(spark, sf)))


def selected(spark: SparkSession, sf: str) -> DataFrame:
    return headers.select_header(ranked(spark, sf))


def detected(spark: SparkSession, sf: str) -> DataFrame:
    return headers.detection_result(selected(spark, sf))


# ---- sources -------------------------------------------------------------------------------------------


@query("A1_head_lines")
def a1(spark, sf):
    found = heads.read_heads(spark, fx.written_files(spark, sf))
    return found.groupBy(fx.file_group()).agg(
        F.max("encoding").alias("encoding"), F.count(F.lit(1)).alias("head_lines"), F.sum(F.length("line")).alias("head_chars")
    )


@query("A2_encoding")
def a2(spark, sf):
    text, key = F.col("text"), F.col("doc_id")
    utf8 = F.encode(text, "UTF-8")
    content = (
        F.when(key % 4 == 1, F.concat(utf8, F.lit(bytearray(b"\xff"))))
        .when(key % 4 == 2, F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), utf8))
        .otherwise(utf8)
    )
    return fx.table(spark, sf, "documents").select("doc_id", heads.detect_encoding(content).alias("encoding"))


@query("A3_sniff_delimiter")
def a3(spark, sf):
    return formats.sniff_delimiter(head(spark, sf)).select("file_id", "delimiter")


@query("A4_adaptive_scan")
def a4(spark, sf):
    lines = fx.rendered_lines(spark, sf)
    scanned = delimited.scan_rows(lines, delimited.decide(formats.head_lines(lines)))
    return scanned.select("file_id", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(fx.HEADER)])


@query("A4_scan_files")
def a4_files(spark, sf):
    scanned = delimited.scan_files(spark, fx.written_files(spark, sf)).rows
    return delimited.as_table(scanned, list(fx.HEADER)).select(fx.file_group(), "_row_idx", *fx.HEADER)


@query("A4_multiline")
def a4_multiline(spark, sf):
    """Quoted fields with line breaks, blank lines and quotes inside: one row per order, and the lines it took."""
    scanned = delimited.scan_files(spark, fx.multiline_files(spark, sf)).rows
    names = ["order_id", "note", "status"]
    cells = [F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(names)]
    return scanned.where(F.col("names") == F.array(*map(F.lit, names))).select(fx.file_group(), "_row_idx", *cells, F.col("_lines").alias("lines"))


@query("A4_line_count")
def a4_lines(spark, sf):
    """Per file: lines, and where they went."""
    lines = fx.rendered_lines(spark, sf)
    decisions = stored(delimited.decide(formats.head_lines(lines)), "decisions")
    counts = [
        lines.select("file_id", F.lit("line").alias("kind")),
        decisions.select("file_id", F.lit("header").alias("kind")),
        delimited.scan_rows(lines, decisions).select("file_id", F.lit("row").alias("kind")),
        delimited.skipped_lines(lines, decisions).select("file_id", F.lit("skipped").alias("kind")),
    ]
    each = reduce(DataFrame.unionByName, counts).groupBy("file_id")
    names = {"line": "lines", "header": "headers", "row": "rows", "skipped": "skipped"}
    return each.agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(name) for k, name in names.items()])


@query("A5_null_tokens")
def a5(spark, sf):
    return clean(spark, sf)


@query("A6_unique_names")
def a6(spark, sf):
    o = fx.table(spark, sf, "orders")
    raw = F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.col("o_orderpriority"))
    names = o.select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("ordinal"), raw.alias("raw_name"))
    return delimited.unique_names(names)


@query("A7_chunks")
def a7(spark, sf):
    e = fx.table(spark, sf, "events").select((F.col("event_id") * 3 + F.col("user_id") % 3).alias("k"))
    return rows.chunk_offsets(rows.with_chunks(rows.number_rows(e, "k"), chunk_rows=fx.CHUNK)).withColumnRenamed(
        "_chunk_id", "chunk_id"
    )


@query("A8_raw_preview")
def a8(spark, sf):
    return formats.raw_preview(fx.rendered_lines(spark, sf)).select("file_id", "row", "line")


@query("A9_typed_scan")
def a9(spark, sf):
    path = fresh_folder(spark, "typed")
    fx.dirty_orders(spark, sf).withColumnRenamed("_row_idx", "k").write.csv(
        path, header=True, quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    table = typed.read_typed(spark, path)
    return table.select(*[r6(c) if t == "double" else c for c, t in table.dtypes])


# ---- sinks ---------------------------------------------------------------------------------------------


def chunked(spark, sf):
    return rows.with_chunks(clean(spark, sf), chunk_rows=fx.CHUNK)


@query("B1_chunk_sink")
def b1(spark, sf):
    path = fresh_folder(spark, "chunks")
    marked = anomaly.mark_anomalies(chunked(spark, sf), anomaly.CHUNK, columns=DIRTY)
    documents.write_chunks(marked, path)
    back = spark.read.option("basePath", path).csv(f"{path}/*", header=True)
    return back.select(
        F.col("_chunk_id").cast("long").alias("chunk_id"), "order_id", F.round(F.col("_anomaly_score").cast("double"), 6).alias("score")
    )


@query("B2_chunk_metadata")
def b2(spark, sf):
    path = fresh_folder(spark, "metadata")
    done = ingest.ingest(clean(spark, sf), chunk_rows=fx.CHUNK)
    documents.write_metadata(documents.chunk_metadata(done.profiles, done.rows, {"source_file": F.lit("orders")}, done.methods), path)
    back = spark.read.json(path)
    amount = F.col("column_profiles.amount")
    return back.select(
        F.col("_chunk_id").alias("chunk_id"),
        "source_file",
        "row_offset",
        "chunk_rows",
        F.element_at("shape", 2).alias("n_columns"),
        F.col("column_types.amount").alias("amount_type"),
        amount.getField("null_rate").alias("amount_null_rate"),
        amount.getField("unique_count").alias("amount_unique"),
        amount.getField("entropy").alias("amount_entropy"),
        F.round(F.aggregate("anomaly.row_score", F.lit(0.0), lambda a, x: a + x), 4).alias("score_sum"),
        F.round(F.aggregate(F.filter("anomaly.per_column.amount", lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x), 4).alias("amount_z_sum"),
    )


@query("B3_result_document")
def b3(spark, sf):
    """One document per file: how it was read, and what the table that its customer stands in was found to be."""
    seen = perceive.perceive(fx.geo_customers(spark, sf), "customers")
    summary = graph.graph_summary(seen.nodes, seen.edges)
    found = detected(spark, sf).withColumnRenamed("fields", "names")
    made = documents.result_document(found, seen.labels, summary, F.lit("customers"))
    schema = (
        "l1_metadata struct<file_id: string, header_row: int, confidence: string, needs_review: boolean>, "
        "l2_result struct<attribute_labels: array<struct<attribute: string, confidence: double>>, top_attributes: array<string>>"
    )
    read = F.from_json("document", schema)
    first = F.get(read["l2_result"]["attribute_labels"], F.lit(0))
    return made.select(
        "table", *[read["l1_metadata"][c].alias(c) for c in ("file_id", "header_row", "confidence", "needs_review")],
        F.size(read["l2_result"]["attribute_labels"]).alias("labels"), F.concat_ws(",", read["l2_result"]["top_attributes"]).alias("top_attributes"),
        F.round(first["confidence"], 3).alias("best"),
    )


@query("B4_graph_summary")
def b4(spark, sf):
    nodes, edges = commerce_graph(spark, sf)
    found = graph.graph_summary(nodes, edges)
    return found.select(
        "graph", "entity_count", "relationship_count", F.concat_ws(",", "entity_types").alias("entity_types"),
        F.concat_ws(",", "relation_types").alias("relation_types"),
    )


# ---- headers -------------------------------------------------------------------------------------------


@query("C1_token_score")
def c1(spark, sf):
    return hist(spark, sf).where(F.col("value").isNotNull()).select(
        "column", "value", F.round(predicates.header_likeness(F.col("value")) + 1e-9, 6).alias("likeness")
    )


PARTS = ("consistency_score", "token_score", "uniqueness_score", "stability", "data_row_penalty", "score")


@query("C2_header_candidates")
def c2(spark, sf):
    found = headers.score_candidates(head(spark, sf))
    return found.select("file_id", "row", "token_count", *[r6(p) for p in PARTS], "reason")


@query("C3_rank_candidates")
def c3(spark, sf):
    return ranked(spark, sf).select("file_id", "row", "rank", r6("score"))


@query("C4_comment_lines")
def c4(spark, sf):
    return fx.rendered_lines(spark, sf).select("file_id", "line_no", predicates.is_comment_line(F.col("line")).alias("is_comment"))


@query("C5_select_header")
def c5(spark, sf):
    return selected(spark, sf).select("file_id", "header_row", "header_line_no", r6("score"), r6("first_row_score"), "selection_reason")


@query("C6_confidence")
def c6(spark, sf):
    return detected(spark, sf).groupBy("confidence").agg(F.count(F.lit(1)).alias("files"))


@query("C7_review_flag")
def c7(spark, sf):
    return detected(spark, sf).select("file_id", "confidence", "needs_review", "review_reason")


@query("C8_detection_result")
def c8(spark, sf):
    best = F.col("candidate_summary")
    return detected(spark, sf).select(
        "file_id",
        "header_row",
        "confidence",
        "confidence_score",
        "needs_review",
        "selection_reason",
        F.concat_ws(",", F.transform(best, lambda c: c.getField("row").cast("string"))).alias("top_rows"),
        F.concat_ws("~", F.transform(best, lambda c: c.getField("preview"))).alias("previews"),
    )


@query("C9_header_by_consistency")
def c9(spark, sf):
    return headers.header_by_consistency(head(spark, sf)).select("file_id", "header_row", r6("score"))


@query("C10_review_gate")
def c10(spark, sf):
    return review.review_gate(detected(spark, sf), available=True)


@query("C11_review_prompts")
def c11(spark, sf):
    queue = review.review_queue(detected(spark, sf))
    preview = formats.raw_preview(fx.rendered_lines(spark, sf))
    return review.review_prompts(preview, queue).drop("instruction")


@query("C12_apply_reviews")
def c12(spark, sf):
    o = fx.table(spark, sf, "orders")
    cust = F.col("o_custkey")
    text = (
        F.when(cust % 4 == 0, F.concat(F.lit('Sure: {"header_row": '), (cust % 3).cast("string"), F.lit(', "confidence": "HIGH", "reasoning": "labels"} ok')))
        .when(cust % 4 == 1, F.lit('{"header_row": 1}'))
        .when(cust % 4 == 2, F.lit("I do not know"))
    )
    replies = o.select(cust).distinct().select(F.concat(F.lit("file_"), cust.cast("string")).alias("file_id"), text.alias("response"))
    return review.apply_reviews(detected(spark, sf), replies.where(F.col("response").isNotNull()))


# ---- predicates ----------------------------------------------------------------------------------------


@query("D1_is_numeric")
def d1(spark, sf):
    return hist(spark, sf).where(F.col("value").isNotNull()).select("column", "value", predicates.is_numeric(F.col("value")).alias("is_numeric"))


@query("D2_is_datetime")
def d2(spark, sf):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    patterns = ["yyyy-MM-dd", "yyyy/MM/dd HH:mm", "MM/dd/yyyy", "dd-MMM-yyyy", "MMM d yyyy", "yyyyMMdd", "yyyy", "HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'"]
    shown = F.when(key % 12 == 9, F.concat(F.date_format(day, "yyyy"), F.lit("-02-30"))).when(key % 12 == 10, F.lit("not a date"))
    for i, pattern in enumerate(patterns):
        shown = shown.when(key % 12 == i, F.date_format(day, pattern))
    shown = shown.otherwise(key.cast("string"))
    return fx.table(spark, sf, "orders").select("o_orderkey", predicates.is_datetime(shown).alias("is_datetime"))


@query("D4_coerce_numeric")
def d4(spark, sf):
    table = anomaly.coerce_numeric(clean(spark, sf))
    return table.select("_row_idx", r6("order_id"), r6("amount"), "customer_id", "status")


@query("D5_type_scores")
def d5(spark, sf):
    found = profile.column_type_scores(hist(spark, sf))
    return found.select("column", *[F.round(f"type_scores.{t}", 6).alias(t) for t in ("numeric", "datetime", "categorical", "text")])


# ---- profiles ------------------------------------------------------------------------------------------


@query("E1_null_rate")
def e1(spark, sf):
    return profile.null_rates(hist(spark, sf))


@query("E2_distinct")
def e2(spark, sf):
    return profile.distinct_counts(hist(spark, sf))


@query("E4_entropy")
def e4(spark, sf):
    return profile.entropies(hist(spark, sf)).select("column", "entropy")


@query("E5_top_values")
def e5(spark, sf):
    t = clean(spark, sf)
    return profile.restore_values(profile.ranked_values(hist(spark, sf)), t, histogram.data_columns(t, exclude=("_row_idx",))).drop("first_idx")


@query("E6_id_like")
def e6(spark, sf):
    return profile.id_likeness(hist(spark, sf))


@query("E7_avg_length")
def e7(spark, sf):
    return profile.mean_lengths(hist(spark, sf))


@query("E8_column_profile")
def e8(spark, sf):
    chunks = histogram.value_histogram(chunked(spark, sf), DIRTY, ("_chunk_id",))
    found = profile.column_profile(chunks, ("_chunk_id",), source=chunked(spark, sf), columns=DIRTY)
    return found.select(
        F.col("_chunk_id").alias("chunk_id"),
        "column",
        "null_rate",
        "unique_count",
        "unique_ratio",
        *[F.round(f"type_scores.{t}", 6).alias(t) for t in ("numeric", "datetime", "categorical", "text")],
        "entropy",
        F.concat_ws("~", "top_samples").alias("top_samples"),
        "is_id_like",
        "avg_length",
        "column_type",
    )


@query("E8_wide_profile")
def e8_wide(spark, sf):
    """The whole of ``lineitem`` as strings, all columns."""
    t = fx.table(spark, sf, "lineitem")
    money = [c for c, kind in t.dtypes if kind == "double"]
    strings = t.select(
        *[F.col(c).cast("decimal(18,2)").cast("string").alias(c) if c in money else
          F.date_format(c, "yyyy-MM-dd").alias(c) if c == "l_shipdate" else F.col(c).cast("string").alias(c) for c in t.columns]
    )
    f = profile.facts(histogram.value_histogram(strings, order=None))
    return f.select(
        "column", F.col("distinct").alias("unique_count"), profile._entropy().alias("entropy"),
        F.round(profile._mean_length(), 3).alias("avg_length"), profile._id_like().alias("is_id_like"),
        profile._column_type().alias("column_type"),
    )


@query("E8_text_profile")
def e8_text(spark, sf):
    """Documents with their whole texts; long values are grouped by digest and the ones shown are fetched back."""
    t = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("_row_idx"), "text", "lang", "source")
    found = profile.column_profile(histogram.value_histogram(t), source=t)
    return found.select(
        "column", "unique_count", "entropy", F.md5(F.concat_ws("~", "top_samples")).alias("top_samples"), "avg_length", "is_id_like", "column_type",
        *[F.round(f"type_scores.{k}", 6).alias(k) for k in ("numeric", "datetime", "categorical", "text")],
    )


@query("E8_merged_profile")
def e8_merged(spark, sf):
    """The whole table's profile from the states of its chunks; top values and entropy where they are exact, distinct counts where few."""
    chunks = histogram.value_histogram(chunked(spark, sf), DIRTY, ("_chunk_id",))
    state = states.stored_state(states.profile_state(chunks, ("_chunk_id",)))
    found = states.state_profile(states.merged(state))
    exact = F.col("count_error") == 0
    return found.select(
        "column", "rows", "null_rate", "avg_length", "column_type", *[F.round(f"type_scores.{t}", 6).alias(t) for t in ("numeric", "datetime")],
        exact.alias("exact"), F.when(exact, F.col("unique_count")).alias("unique_count"), F.when(exact, F.col("entropy")).alias("entropy"),
        F.when(exact, F.concat_ws("~", "top_samples")).alias("top_samples"),
    )


@query("E9_column_types")
def e9(spark, sf):
    return profile.column_types(hist(spark, sf))


# ---- anomalies -----------------------------------------------------------------------------------------


@query("F1_missing_ratio")
def f1(spark, sf):
    t = clean(spark, sf)
    return t.select("_row_idx", F.round(anomaly.missing_ratio(t), 6).alias("missing_ratio"))


def scored(spark, sf):
    return anomaly.score_rows(clean(spark, sf), columns=DIRTY)


@query("F2_abs_zscore")
def f2(spark, sf):
    return scored(spark, sf).select("_row_idx", *[F.round(F.col("_z")[c], 6).alias(f"z_{c}") for c in ("order_id", "amount")])


@query("F3_mean_z")
def f3(spark, sf):
    done = anomaly.score_rows(chunked(spark, sf), anomaly.CHUNK, columns=DIRTY)
    return done.select("_row_idx", F.round("_mean_z", 6).alias("mean_z"), F.round("_missing_ratio", 6).alias("missing_ratio"))


@query("F4_length_z")
def f4(spark, sf):
    t = clean(spark, sf).select("_row_idx", "customer_id", "status", "order_date", "priority", "note")
    done = anomaly.score_rows(t)
    return done.select("_row_idx", F.round("_mean_z", 6).alias("length_z"), F.round("_anomaly_score", 6).alias("score"))


@query("F5_isolation_forest")
def f5(spark, sf):
    t = fx.table(spark, sf, "lineitem")
    features = {c: finite(F.col(c)) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    done = iforest.isolation_scores(t, features, key)
    return done.select("l_orderkey", "l_linenumber", F.round("_iforest_score", 6).alias("score"))


@query("F5_planted_outliers")
def f5_planted(spark, sf):
    """Customers, some of them far from all others: as many as were planted rank first."""
    key = F.col("c_custkey")
    planted = key % 500 == 7
    t = fx.table(spark, sf, "customer").select(
        key, planted.alias("planted"), F.when(planted, F.lit(1e6) * (1 + key % 3)).otherwise(F.col("c_acctbal")).alias("balance"),
        F.when(planted, -1000).otherwise(F.col("c_nationkey")).cast("double").alias("nation"),
    )
    done = iforest.isolation_scores(t, {c: F.col(c) for c in ("balance", "nation")}, key)
    return done.orderBy(F.desc("_iforest_score"), "c_custkey").limit(t.where("planted").count()).select("c_custkey")


@query("F5_chunk_forest")
def f5_chunk(spark, sf):
    t = rows.with_chunks(fx.table(spark, sf, "events").withColumnRenamed("event_id", "_row_idx"), chunk_rows=fx.CHUNK)
    done = iforest.chunk_isolation_scores(t, {c: finite(F.col(c)) for c in ("user_id", "value")})
    return done.select("_row_idx", F.round("_iforest_score", 6).alias("score"))


@query("F6_anomaly_ensemble")
def f6(spark, sf):
    return scored(spark, sf).select("_row_idx", F.round("_anomaly_score", 6).alias("score"))


@query("F6_forest_ensemble")
def f6_forest(spark, sf):
    done = ingest.ingest(clean(spark, sf), scope="global", forest=True)
    return done.rows.select("_row_idx", F.round("_anomaly_score", 6).alias("score"))


@query("F7_mark_anomalies")
def f7(spark, sf):
    t = fx.table(spark, sf, "lineitem")
    marked = anomaly.mark_anomalies(t)
    return marked.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("marked_rows"), F.round(F.avg("_anomaly_score"), 5).alias("mean_score"),
        F.round(F.max("_anomaly_score"), 5).alias("max_score"),
    )


# ---- semantic channel ----------------------------------------------------------------------------------


def keyed(spark, sf):
    return {name: (fx.table(spark, sf, name), order) for name, order in fx.KEYED.items()}


def united(frames):
    frames = list(frames)
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    return whole


def catalogues(spark, sf):
    return united(tablefacts.catalogue(t, name) for name, (t, _) in keyed(spark, sf).items())


def samples(spark, sf):
    return united(perceive.table_samples(t, name, order) for name, (t, order) in keyed(spark, sf).items())


@query("G1_keyword_scores")
def g1(spark, sf):
    found = semantic.keyword_scores(semantic.text_pieces(catalogues(spark, sf), samples(spark, sf)))
    return found.select("table", *[r6(a) for a in semantic.KEYWORDS])


@query("G2_value_sample")
def g2(spark, sf):
    return semantic.value_sample_text(tablefacts.head_values(clean(spark, sf), "_row_idx", 20))


@query("G3_column_patterns")
def g3(spark, sf):
    tables = {**keyed(spark, sf), "commerce": (fx.commerce(spark, sf), "_row_idx"), "customers": (fx.geo_customers(spark, sf), "_row_idx")}
    names = united(tablefacts.catalogue(t, name) for name, (t, _) in tables.items())
    counts = united(t.agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(name)) for name, (t, _) in tables.items())
    return semantic.key_column_share(names).join(counts, "table").select("table", "rows", r6("relational_structure"))


@query("G4_embedding_consistency")
def g4(spark, sf):
    found = semantic.embedding_consistency(fx.table(spark, sf, "embeddings"), "label", "embedding")
    return found.select("label", "n", r6("semantic_consistency", 5))


@query("G5_semantic_scores")
def g5(spark, sf):
    return semantic.semantic_scores(catalogues(spark, sf), samples(spark, sf)).select("table", "attribute", r6("score"))


# ---- statistical channel -------------------------------------------------------------------------------


def facts(spark, sf, outliers=False):
    return united(
        tablefacts.table_facts(t, name, order, outliers=outliers) for name, (t, order) in keyed(spark, sf).items()
    )


def _wide_stats(spark, sf, moments=False):
    return united(
        tablefacts.catalogue(t, name).join(tablefacts.cell_stats(t, moments=moments), "column")
        for name, (t, _) in keyed(spark, sf).items()
    )


@query("H1_numeric_density")
def h1(spark, sf):
    found = _wide_stats(spark, sf).groupBy("table").agg(F.max("rows").alias("rows"), statistical.numeric_density().alias("numeric_density"))
    return found.select("table", "rows", r6("numeric_density"))


@query("H2_sparsity")
def h2(spark, sf):
    t = anomaly.coerce_numeric(clean(spark, sf))
    stats = tablefacts.catalogue(t, "orders").join(tablefacts.cell_stats(t, moments=False), "column")
    return stats.groupBy("table").agg(F.round(statistical.sparsity(), 6).alias("sparsity"))


@query("H3_temporal")
def h3(spark, sf):
    tables = {**keyed(spark, sf), "dirty": (clean(spark, sf), "_row_idx"), "commerce": (fx.commerce(spark, sf), "_row_idx")}
    frames = []
    for name, (t, order) in tables.items():
        heads_of = tablefacts.head_stats(tablefacts.head_values(t, order, 50))
        frames.append(tablefacts.catalogue(t, name).join(heads_of, "column", "left"))
    return united(frames).groupBy("table").agg(F.round(statistical.temporal_pattern(), 6).alias("temporal_pattern"))


def _distinct_facts(spark, sf):
    return united(
        tablefacts.catalogue(t, name)
        .join(tablefacts.cell_stats(t, moments=False), "column")
        .join(tablefacts.distinct_stats(t), "column")
        for name, (t, _) in keyed(spark, sf).items()
    )


@query("H4_categorical")
def h4(spark, sf):
    return _distinct_facts(spark, sf).groupBy("table").agg(F.round(statistical.categorical_presence(), 6).alias("categorical_presence"))


@query("H5_text_richness")
def h5(spark, sf):
    frames = []
    for name, order in {"documents": "doc_id", "benchmark": "item_id", "pages": "page_id"}.items():
        t = fx.table(spark, sf, name)
        heads_of = tablefacts.head_stats(tablefacts.head_values(t, order, 50))
        frames.append(tablefacts.catalogue(t, name).join(heads_of, "column", "left"))
    return united(frames).groupBy("table").agg(F.round(statistical.text_richness(), 6).alias("text_richness"))


@query("H6_high_cardinality")
def h6(spark, sf):
    return _distinct_facts(spark, sf).groupBy("table").agg(F.round(statistical.high_cardinality(), 6).alias("high_cardinality"))


@query("H7_skew")
def h7(spark, sf):
    return _wide_stats(spark, sf, True).groupBy("table").agg(F.round(statistical.distribution_skewed(), 6).alias("distribution_skewed"))


@query("H8_kurtosis")
def h8(spark, sf):
    return _wide_stats(spark, sf, True).groupBy("table").agg(F.round(statistical.distribution_heavy_tail(), 6).alias("distribution_heavy_tail"))


@query("H9_periodicity")
def h9(spark, sf):
    t = fx.table(spark, sf, "events")
    return spectrum.column_periodicity(t, ["user_id", "value"], "event_id").select("column", "points", r6("periodicity"))


@query("H10_anomaly_share")
def h10(spark, sf):
    return statistical.anomaly_share(scored(spark, sf), threshold=0.4).select(r6("anomaly_presence"))


@query("H11_outlier_share")
def h11(spark, sf):
    frames = []
    for name, (t, _) in keyed(spark, sf).items():
        stats = tablefacts.cell_stats(t)
        found = tablefacts.outlier_counts(t, stats.collect())
        frames.append(tablefacts.catalogue(t, name).join(stats, "column").join(found, "column", "left"))
    return united(frames).groupBy("table").agg(F.round(statistical.outlier_share(), 6).alias("anomaly_presence"))


@query("H12_hierarchy_score")
def h12(spark, sf):
    return statistical.hierarchy_score(fx.commerce(spark, sf), ["region", "nation", "segment", "status", "priority"]).select(r6("hierarchical_structure"))


def customer_scores(spark, sf):
    t = fx.geo_customers(spark, sf)
    found = tablefacts.table_facts(t, "customers", "_row_idx")
    return t, found, statistical.statistical_scores(t, found, "customers", "_row_idx")


@query("H13_statistical_scores")
def h13(spark, sf):
    return customer_scores(spark, sf)[2].select("table", "attribute", r6("score", 5))


# ---- fusion --------------------------------------------------------------------------------------------


def fused(spark, sf):
    t, _, shape = customer_scores(spark, sf)
    return fusion.fuse(perceive.semantic_channel(t, "customers", "_row_idx"), shape)


@query("I1_fuse")
def i1(spark, sf):
    return fused(spark, sf).select(
        "table", "attribute", *[F.round(c, 5).alias(c) for c in ("semantic_score", "statistical_score", "raw_fused", "confidence")], "source"
    )


@query("I3_top_attributes")
def i3(spark, sf):
    return fusion.top_attributes(fused(spark, sf)).select("table", "rank", "attribute")


@query("I4_above_threshold")
def i4(spark, sf):
    return fusion.above_threshold(fused(spark, sf)).select("table", "attribute", r6("confidence", 5))


@query("I6_perceive_table")
def i6(spark, sf):
    seen = perceive.perceive(fx.geo_customers(spark, sf), "customers")
    return seen.labels.select("table", "attribute", r6("confidence", 3), "source")


# ---- graph ---------------------------------------------------------------------------------------------


def commerce_types(spark, sf):
    t = fx.commerce(spark, sf)
    return t, graph.semantic_types(tablefacts.table_facts(t, "commerce", "_row_idx", outliers=False))


def commerce_graph(spark, sf):
    t = fx.commerce(spark, sf)
    found = tablefacts.table_facts(t, "commerce", "_row_idx", outliers=False)
    return graph.build_graph({"commerce": (t, "_row_idx")}, found)


@query("J1_semantic_types")
def j1(spark, sf):
    t = fx.commerce(spark, sf)
    both = facts(spark, sf).unionByName(tablefacts.table_facts(t, "commerce", "_row_idx", outliers=False))
    found = graph.semantic_types(both)
    return found.select("table", "column", "semantic_type", r6("type_confidence"), "is_primary_key", "is_foreign_key")


@query("J2_entity_reference")
def j2(spark, sf):
    name = F.concat(F.regexp_replace(F.lower("p_type"), " ", "_"), F.when(F.col("p_partkey") % 2 == 0, "_id").otherwise("Id"))
    return fx.table(spark, sf, "part").select("p_partkey", name.alias("column")).select("p_partkey", graph.entity_reference(F.col("column")).alias("entity"))


@query("J4_graph_nodes")
def j4(spark, sf):
    nodes, _ = commerce_graph(spark, sf)
    p = F.col("properties")
    return nodes.select(
        "id", "name", "entity_type", *[p[k].alias(k) for k in ("semantic_type", "null_rate", "unique_ratio", "data_type", "inferred_from")]
    )


@query("J7_value_nodes")
def j7(spark, sf):
    t, kinds = commerce_types(spark, sf)
    values = graph.first_values(t, list(graph._categorical(kinds, "commerce")), "_row_idx")
    return graph.value_nodes(values, "commerce").select("id", "name")


@query("J8_containment_edges")
def j8(spark, sf):
    t, kinds = commerce_types(spark, sf)
    values = graph.first_values(t, list(graph._categorical(kinds, "commerce")), "_row_idx")
    both = graph.containment_edges(kinds).unionByName(graph.value_edges(values, "commerce"))
    return both.select("src", "dst", "relation_type", "weight")


@query("J9_foreign_key_edges")
def j9(spark, sf):
    return graph.reference_edges(commerce_types(spark, sf)[1]).select("src", "dst", "weight", F.col("properties")["foreign_key"].alias("foreign_key"))


@query("J10_correlation_edges")
def j10(spark, sf):
    t, kinds = commerce_types(spark, sf)
    found = graph.correlation_edges(t, "commerce", graph._numeric(kinds, "commerce"))
    return found.select("src", "dst", "relation_type", r6("weight", 5), F.col("properties")["direction"].alias("direction"))


@query("J10_correlations")
def j10_all(spark, sf):
    t = fx.table(spark, sf, "lineitem")
    found = graph.correlations(t, [c for c, kind in t.dtypes if kind in ("bigint", "int", "double")])
    return found.select("left", "right", r6("r", 5))


@query("J10_wide_correlations")
def j10_wide(spark, sf):
    """Sixty numeric columns, some with missing values."""
    t = fx.wide_numbers(spark, sf)
    return graph.correlations(t, [c for c in t.columns if c != "l_orderkey"]).select("left", "right", r6("r", 5))


@query("J11_hierarchy_edges")
def j11(spark, sf):
    t, kinds = commerce_types(spark, sf)
    return graph.hierarchy_edges(t, "commerce", graph._categorical(kinds, "commerce")).select("src", "dst", "relation_type", "weight")


@query("J12_temporal_edges")
def j12(spark, sf):
    return graph.temporal_edges(commerce_types(spark, sf)[1]).select("src", "dst", "weight")


@query("J15_graph_edges")
def j15(spark, sf):
    tables = {"commerce": (fx.commerce(spark, sf), "_row_idx"), "customers": (fx.geo_customers(spark, sf), "_row_idx")}
    found = united(tablefacts.table_facts(t, name, order, outliers=False) for name, (t, order) in tables.items())
    _, edges = graph.build_graph(tables, found)
    return edges.groupBy("graph", "relation_type").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 4).alias("weight"))


# ---- streams -------------------------------------------------------------------------------------------


@query("K1_stream_profile")
def k1(spark, sf):
    schema = fx.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    text = stream.select(
        F.col("event_id").alias("_row_idx"), F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("user_id"),
        "event_type", F.col("value").cast("decimal(18,2)").cast("string").alias("value"), "props",
    )
    out = fresh_folder(spark, "stream")
    run = microbatch.profile_stream(text, out, fresh_folder(spark, "progress"))
    run.awaitTermination()
    return spark.read.parquet(f"{out}/profiles").select(
        "batch_id", "column", "null_rate", "unique_count", "entropy", "avg_length", "is_id_like", "column_type"
    ).withColumn("batch_id", F.col("batch_id").cast("long"))


@query("K2_window_profile")
def k2(spark, sf):
    schema = fx.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = fresh_folder(spark, "windows")
    run = windows.updated_windows(windows.window_profile(stream, "ts", "value"), out, fresh_folder(spark, "progress"))
    run.awaitTermination()
    return windows.latest_windows(spark.read.parquet(out)).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "rows", r6("null_rate"), r6("mean", 5), r6("std", 5), r6("skew", 4))
