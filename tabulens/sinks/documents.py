"""Sinks: chunk data, chunk metadata and result documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.operators.anomaly import CHUNK_KEY

# Values are written as they are: spaces kept, quotes doubled.
CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_chunks(scored: DataFrame, path: str, folders: bool = False) -> None:
    """Write rows with their ``_chunk_id`` and ``_anomaly_score`` as delimited files with a header.

    The chunk number is a column and files hold consecutive chunks. With ``folders`` every chunk becomes a folder
    holding one file, which is for few chunks.
    """
    flat = scored.drop(*[c for c, t in scored.dtypes if t.startswith(("map", "array", "struct"))])
    if folders:
        flat.repartition(CHUNK_KEY).write.mode("overwrite").partitionBy(CHUNK_KEY).csv(path, **CSV_OPTIONS)
    else:
        flat.repartitionByRange(CHUNK_KEY).write.mode("overwrite").csv(path, **CSV_OPTIONS)


def chunk_metadata(
    profiles: DataFrame, scored: DataFrame, source: dict[str, Column] | None = None, methods: tuple[str, ...] = ("z_score",)
) -> DataFrame:
    """One row per chunk: where it starts, its shape, the profile and type of every column, its row scores.

    ``profiles`` is the profile by chunk and ``scored`` the scored rows with ``_row_idx``. Both lists that are
    gathered are bounded, by the number of columns and by the rows of a chunk. ``methods`` says what ran. Where rows have
    their ``_z``, ``per_column`` holds the z-scores of every numeric column in row order, null where a value is missing.
    """
    z = ["_z"] if "_z" in scored.columns else []
    numeric = F.array_distinct(F.flatten(F.transform("marks", lambda m: F.map_keys(m["_z"])))) if z else None
    facts = [c for c in profiles.columns if c not in (CHUNK_KEY, "column", "column_type", "rows")]
    columns = profiles.groupBy(CHUNK_KEY).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("column", F.struct(*facts))))).alias("column_profiles"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("column", "column_type")))).alias("column_types"),
        F.count(F.lit(1)).alias("n_columns"),
    )
    rows = scored.groupBy(CHUNK_KEY).agg(
        F.min("_row_idx").alias("row_offset"),
        F.count(F.lit(1)).alias("chunk_rows"),
        F.array_sort(
            F.collect_list(F.struct("_row_idx", "_anomaly_score", "_missing_ratio", *z)), lambda a, b: F.when(a["_row_idx"] < b["_row_idx"], -1).when(a["_row_idx"] > b["_row_idx"], 1).otherwise(0)
        ).alias("marks"),
    )
    return rows.join(columns, CHUNK_KEY).select(
        CHUNK_KEY,
        *[value.alias(name) for name, value in (source or {}).items()],
        "row_offset",
        "chunk_rows",
        F.array(F.col("chunk_rows"), F.col("n_columns") + 1).alias("shape"),
        "column_profiles",
        "column_types",
        F.struct(
            F.array(*[F.lit(m) for m in methods]).alias("methods"),
            F.transform("marks", lambda m: m.getField("_anomaly_score")).alias("row_score"),
            F.transform("marks", lambda m: m.getField("_missing_ratio")).alias("missing_ratio"),
            *([_per_column(numeric)] if z else []),
        ).alias("anomaly"),
    )


def _per_column(columns: Column) -> Column:
    each = F.transform(columns, lambda c: F.struct(c.alias("key"), F.transform("marks", lambda m: F.try_element_at(m["_z"], c)).alias("value")))
    return F.map_from_entries(F.array_sort(each, lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))).alias("per_column")


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata.write.mode("overwrite").json(path)


def result_document(decision: DataFrame, labels: DataFrame, summary: DataFrame, table: str | Column) -> DataFrame:
    """``table, document``: how a file was read, its table's labels and the size of its graph as one JSON text.

    One row per row of ``decision``. ``table`` is the name of the only table, or a column of ``decision`` that names each
    file's. Per table, ``summary`` has one row and ``labels`` fifteen; a file whose table has none gets how it was read alone.
    """
    key = F.lit(table) if isinstance(table, str) else table
    facts = [F.col(c) for c in decision.columns if c not in ("candidate_summary", "names")]
    read = decision.select(key.alias("table"), F.struct(*facts).alias("l1_metadata"))
    ranked = labels.groupBy("table").agg(
        F.sort_array(
            F.collect_list(
                F.struct((-F.col("confidence")).alias("order"), "attribute", "confidence", "semantic_score", "statistical_score", "raw_fused", "source")
            )
        ).alias("labels")
    )
    perceived = ranked.join(summary.withColumnRenamed("graph", "table"), "table").select(
        "table",
        F.struct(
            F.transform("labels", lambda x: x.dropFields("order")).alias("attribute_labels"),
            F.transform(F.slice("labels", 1, 5), lambda x: x.getField("attribute")).alias("top_attributes"),
            F.struct("entity_count", "relationship_count").alias("knowledge_graph_summary"),
        ).alias("l2_result"),
    )
    return read.join(perceived, "table", "left").select("table", F.to_json(F.struct("l1_metadata", "l2_result")).alias("document"))


def graph_document(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write a graph as two folders of JSON lines."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
