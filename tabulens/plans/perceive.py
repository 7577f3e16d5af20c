"""Perception of a table from start to end: labels, scores and schema graph."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.operators import fusion, graph, semantic, statistical, tablefacts


@dataclass(frozen=True)
class Perception:
    """Everything perceived about one table; all parts are DataFrames."""

    facts: DataFrame
    semantic: DataFrame
    statistical: DataFrame
    fused: DataFrame
    nodes: DataFrame
    edges: DataFrame

    @property
    def labels(self) -> DataFrame:
        return fusion.as_labels(self.fused)


def table_samples(df: DataFrame, table: str, order: str, exclude: Iterable[str] = (), heads: DataFrame | None = None) -> DataFrame:
    """``table, column, value``: the value sample that the semantic channel reads."""
    heads = tablefacts.head_values(df, order, tablefacts.VALUE_SAMPLE, exclude) if heads is None else heads.where(F.col("rank") <= tablefacts.VALUE_SAMPLE)
    return heads.select(F.lit(table).alias("table"), "column", "value")


def semantic_channel(df: DataFrame, table: str, order: str, exclude: Iterable[str] = (), heads: DataFrame | None = None) -> DataFrame:
    names = tablefacts.catalogue(df, table, exclude)
    return semantic.semantic_scores(names, table_samples(df, table, order, exclude, heads))


def perceive(
    df: DataFrame,
    table: str,
    order: str = "_row_idx",
    scored: DataFrame | None = None,
    exclude: Iterable[str] = (),
    semantic_weight: float = fusion.CHANNEL_WEIGHT,
    statistical_weight: float = fusion.CHANNEL_WEIGHT,
    threshold: float = fusion.THRESHOLD,
) -> Perception:
    """Labels and graph of a typed table whose rows are ordered by the integer column ``order``.

    ``scored`` is the same table with ``_anomaly_score``, if rows were scored before.
    """
    first = tablefacts.head_values(df, order, tablefacts.TEXT_SAMPLE, exclude)
    first = df.sparkSession.createDataFrame(first.collect(), first.schema)  # a few dozen values for each column
    facts = tablefacts.table_facts(df, table, order, exclude, heads=first)
    meaning = semantic_channel(df, table, order, exclude, first)
    shape = statistical.statistical_scores(df, facts, table, order, scored)
    fused = fusion.fuse(meaning, shape, semantic_weight, statistical_weight, threshold)
    nodes, edges = graph.build_graph({table: (df, order)}, facts)
    return Perception(facts, meaning, shape, fused, nodes, edges)
