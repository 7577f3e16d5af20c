"""Schema graph of tables: nodes and edges as two DataFrames.

Node and edge sets are built from the column facts, which have one row per column; only value samples,
correlations and hierarchies read the table.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.functions.scoring import ratio
from tabulens.operators.comoments import co_moments, correlation
from tabulens.operators.dependencies import hierarchy_pairs
from tabulens.operators.statistical import is_low_cardinality
from tabulens.operators.tablefacts import quoted

# Name patterns per semantic type (case-insensitive, in order of precedence) and names of
# primary keys.
ID_NAME = r"(?i)^(.*id|.*编号|.*号)$"
AMOUNT_NAME = r"(?i)(amount|price|cost|total|金额|价格|费用|合计)"
TIME_NAME = r"(?i)(date|time|日期|时间|_at$|_on$|^year$|^month$|^day$)"
NAME_NAME = r"(?i)(name|title|label|名称|姓名|标题)"
PRIMARY_KEY_NAMES = ("id", "pk", "primary_key", "编号", "序号")
# Confidence per rule, edge weights, thresholds.
CONFIDENCE = {"id": 0.9, "amount": 0.85, "datetime": 0.85, "dates": 0.7, "name": 0.8, "numeric": 0.6, "other": 0.5}
REFERENCE_WEIGHT = 0.9
HIERARCHY_WEIGHT = 0.9
TEMPORAL_WEIGHT = 0.7
CORRELATION_THRESHOLD = 0.7
SAMPLE_VALUES = 5
DATE_SHARE = 0.8
PAIR_SCHEMA = "left string, right string, r double"

NODE_COLUMNS = ("graph", "id", "name", "entity_type", "properties")
EDGE_COLUMNS = ("graph", "src", "dst", "relation_type", "weight", "properties")


def entity_reference(column: Column) -> Column:
    """The entity a key column refers to: ``customer_id`` -> ``Customer``, ``userId`` -> ``user``, ``订单编号`` -> ``订单``."""
    stem = F.substring(column, F.lit(1), F.length(column) - 3)
    # Title case starts a new word after anything that is not a letter.
    spaced = F.regexp_replace(stem, r"([^\p{L}]+)", " $1 ")
    title = F.replace(F.replace(F.initcap(spaced), F.lit(" "), F.lit("")), F.lit("_"), F.lit(""))
    return (
        F.when(F.lower(column).endswith("_id"), title)
        .when(column.rlike("(Id|ID)$"), F.substring(column, F.lit(1), F.length(column) - 2))
        .when(column.rlike("(编号|号)$"), F.regexp_replace(column, "编号|号", ""))
        .otherwise(column)
    )


def semantic_types(facts: DataFrame) -> DataFrame:
    """Facts with ``semantic_type, type_confidence, is_primary_key, is_foreign_key, entity_reference``."""
    name = F.col("column")
    dates = F.when(F.col("is_time"), F.col("type_n")).otherwise(F.col("type_dates"))
    parses = ~F.col("is_numberlike") & (F.col("type_n") > 0) & (dates >= DATE_SHARE * F.col("type_n"))
    rules = [
        (name.rlike(ID_NAME), "id", "id"),
        (name.rlike(AMOUNT_NAME), "amount", "amount"),
        (name.rlike(TIME_NAME), "datetime", "datetime"),
        (parses, "datetime", "dates"),
        (name.rlike(NAME_NAME), "name", "name"),
        (F.col("is_numberlike"), "numeric", "numeric"),
        (is_low_cardinality() & (F.col("rows") > 0), "categorical", "other"),
        (F.lit(True), "text", "other"),
    ]
    kind = reduce(lambda when, r: when.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1]))
    sure = reduce(
        lambda when, r: when.when(r[0], CONFIDENCE[r[2]]), rules[1:], F.when(rules[0][0], CONFIDENCE[rules[0][2]])
    )
    primary = (F.col("semantic_type") == "id") & F.lower(name).isin(*PRIMARY_KEY_NAMES)
    foreign = (F.col("semantic_type") == "id") & ~F.lower(name).isin(*PRIMARY_KEY_NAMES)
    return (
        facts.withColumn("semantic_type", kind)
        .withColumn("type_confidence", sure)
        .withColumn("is_primary_key", primary)
        .withColumn("is_foreign_key", foreign)
        .withColumn("entity_reference", F.when(foreign, entity_reference(name)))
    )


def _text(value: Column) -> Column:
    return value.cast("string")


def _properties(**items: Column) -> Column:
    return F.create_map(*[x for k, v in items.items() for x in (F.lit(k), _text(v))])


def column_id(qualified: bool) -> Column:
    if qualified:
        return F.concat(F.lit("column:"), F.col("table"), F.lit("."), F.col("column"))
    return F.concat(F.lit("column:"), F.col("column"))


def table_nodes(typed: DataFrame) -> DataFrame:
    return typed.groupBy("table").agg(F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns")).select(
        F.col("table").alias("graph"),
        F.concat(F.lit("table:"), F.col("table")).alias("id"),
        F.col("table").alias("name"),
        F.lit("table").alias("entity_type"),
        _properties(rows=F.col("rows"), columns=F.col("columns")).alias("properties"),
    )


def column_nodes(typed: DataFrame, qualified: bool = False) -> DataFrame:
    null_rate = 1.0 - ratio(F.col("non_null"), F.col("rows"))
    return typed.select(
        F.col("table").alias("graph"),
        column_id(qualified).alias("id"),
        F.col("column").alias("name"),
        F.lit("column").alias("entity_type"),
        _properties(
            semantic_type=F.col("semantic_type"),
            is_primary_key=F.col("is_primary_key"),
            is_foreign_key=F.col("is_foreign_key"),
            null_rate=F.round(null_rate, 4).cast("decimal(6,4)"),
            unique_ratio=F.round(ratio(F.col("distinct"), F.col("rows")), 4).cast("decimal(6,4)"),
            data_type=F.col("data_type"),
        ).alias("properties"),
    )


def entity_nodes(typed: DataFrame) -> DataFrame:
    """Referenced entities, each once per graph, inferred from the first column that refers to it."""
    return (
        typed.where(F.col("is_foreign_key") & (F.col("entity_reference") != ""))
        .groupBy("table", "entity_reference")
        .agg(F.min_by("column", "ordinal").alias("source"))
        .select(
            F.col("table").alias("graph"),
            F.concat(F.lit("entity:"), F.col("entity_reference")).alias("id"),
            F.col("entity_reference").alias("name"),
            F.lit("referenced_entity").alias("entity_type"),
            _properties(inferred_from=F.col("source")).alias("properties"),
        )
    )


def first_values(df: DataFrame, columns: list[str], order: str, limit: int = SAMPLE_VALUES) -> DataFrame:
    """``column, rank, value``: the first distinct values of categorical columns, in order of appearance."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, rank int, value string")
    names = ["`" + c.replace("`", "``") + "`" for c in columns]
    seen = (
        df.select(quoted(order).alias("_order"), *[quoted(c).cast("string").alias(c) for c in columns])
        .unpivot(["_order"], names, "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.min("_order").alias("first_seen"))
    )
    first = Window.partitionBy("column").orderBy("first_seen")
    return seen.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= limit).select("column", "rank", "value")


def value_nodes(values: DataFrame, table: str, qualified: bool = False) -> DataFrame:
    owner = F.concat(F.lit(f"{table}."), F.col("column")) if qualified else F.col("column")
    return values.select(
        F.lit(table).alias("graph"),
        F.concat(F.lit("value:"), owner, F.lit(":"), F.col("value")).alias("id"),
        F.col("value").alias("name"),
        F.lit("value").alias("entity_type"),
        _properties(column=F.col("column")).alias("properties"),
    )


def _edges(df: DataFrame, src: Column, dst: Column, relation: Column | str, weight: Column | float, properties: Column | None = None) -> DataFrame:
    def as_column(x):
        return x if isinstance(x, Column) else F.lit(x)

    return df.select(
        F.col("table").alias("graph"),
        src.alias("src"),
        dst.alias("dst"),
        as_column(relation).alias("relation_type"),
        as_column(weight).cast("double").alias("weight"),
        (F.create_map().cast("map<string,string>") if properties is None else properties).alias("properties"),
    )


def containment_edges(typed: DataFrame, qualified: bool = False) -> DataFrame:
    return _edges(typed, F.concat(F.lit("table:"), F.col("table")), column_id(qualified), "has_column", 1.0)


def value_edges(values: DataFrame, table: str, qualified: bool = False) -> DataFrame:
    owner = F.concat(F.lit(f"{table}."), F.col("column")) if qualified else F.col("column")
    rows = values.withColumn("table", F.lit(table))
    node = F.concat(F.lit("value:"), owner, F.lit(":"), F.col("value"))
    return _edges(rows, F.concat(F.lit("column:"), owner), node, "has_value", 1.0)


def reference_edges(typed: DataFrame, qualified: bool = False) -> DataFrame:
    keys = typed.where(F.col("is_foreign_key") & (F.col("entity_reference") != ""))
    entity = F.concat(F.lit("entity:"), F.col("entity_reference"))
    return _edges(
        keys, column_id(qualified), entity, "references", F.col("type_confidence"), _properties(foreign_key=F.col("column"))
    )


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``left, right, r``: Pearson correlation of all column pairs over rows that have both values.

    One read of the table at any width; each task sends a few numbers per pair. A constant column has no correlation:
    its pairs are null.
    """
    pairs = list(combinations(range(len(columns)), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    moments = co_moments(df, [quoted(c) for c in columns])
    named = df.sparkSession.createDataFrame([(i, j, columns[i], columns[j]) for i, j in pairs], "i int, j int, left string, right string")
    return named.join(moments.select("i", "j", correlation(moments).alias("r")), ["i", "j"], "left").select("left", "right", "r")


def _named(table: str, column: str, qualified: bool) -> Column:
    return F.concat(F.lit(f"column:{table}." if qualified else "column:"), F.col(column))


def correlation_edges(
    df: DataFrame, table: str, columns: list[str], threshold: float = CORRELATION_THRESHOLD, qualified: bool = False
) -> DataFrame:
    r = F.col("r")
    strong = correlations(df, columns).where(F.abs(r) >= threshold).withColumn("table", F.lit(table))
    return _edges(
        strong,
        _named(table, "left", qualified),
        _named(table, "right", qualified),
        F.when(r > 0, "correlates_with").otherwise("inversely_correlates"),
        F.abs(r),
        _properties(
            correlation=F.round(r, 4).cast("decimal(6,4)"), direction=F.when(r > 0, "positive").otherwise("negative")
        ),
    )


def hierarchy_edges(
    df: DataFrame, table: str, columns: dict[str, int], qualified: bool = False
) -> DataFrame:
    held = hierarchy_pairs(df, list(columns)).where("holds").withColumn("table", F.lit(table))
    return _edges(
        held,
        _named(table, "parent", qualified),
        _named(table, "child", qualified),
        "has_subcategory",
        HIERARCHY_WEIGHT,
        _properties(hierarchy=F.lit("parent_child")),
    )


def temporal_edges(typed: DataFrame, qualified: bool = False) -> DataFrame:
    """Every time column with every numeric or amount column of its table."""
    kind, target = F.col("semantic_type"), column_id(qualified)
    times = typed.where(kind == "datetime").select("table", F.col("column").alias("time"), target.alias("src"))
    values = typed.where(kind.isin("numeric", "amount")).select("table", F.col("column").alias("value"), target.alias("dst"))
    return _edges(
        times.join(values, "table"),
        F.col("src"),
        F.col("dst"),
        "temporal_context",
        TEMPORAL_WEIGHT,
        _properties(time_column=F.col("time"), value_column=F.col("value")),
    )


def _categorical(typed: DataFrame, table: str) -> dict[str, int]:
    rows = typed.where((F.col("table") == table) & (F.col("semantic_type") == "categorical")).orderBy("ordinal")
    return {r["column"]: r["distinct"] for r in rows.select("column", "distinct").collect()}


def _numeric(typed: DataFrame, table: str) -> list[str]:
    rows = typed.where((F.col("table") == table) & F.col("is_numeric")).orderBy("ordinal")
    return [r["column"] for r in rows.select("column").collect()]


def build_graph(
    tables: dict[str, tuple[DataFrame, str]],
    facts: DataFrame,
    threshold: float = CORRELATION_THRESHOLD,
    sample_values: int = SAMPLE_VALUES,
    qualified: bool | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of one or several tables, given as ``{name: (table, order column)}``.

    With several tables column ids carry the table's name; referenced entities are shared by name.
    """
    qualified = len(tables) > 1 if qualified is None else qualified
    typed = semantic_types(facts)
    nodes = [table_nodes(typed), column_nodes(typed, qualified), entity_nodes(typed)]
    edges = [containment_edges(typed, qualified), reference_edges(typed, qualified), temporal_edges(typed, qualified)]
    for name, (df, order) in tables.items():
        categorical = _categorical(typed, name)
        if sample_values:
            values = first_values(df, list(categorical), order, sample_values)
            nodes.append(value_nodes(values, name, qualified))
            edges.append(value_edges(values, name, qualified))
        edges.append(correlation_edges(df, name, _numeric(typed, name), threshold, qualified))
        edges.append(hierarchy_edges(df, name, categorical, qualified))
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per graph: counts and the sorted kinds of nodes and edges."""
    left = nodes.groupBy("graph").agg(
        F.count(F.lit(1)).alias("entity_count"), F.sort_array(F.collect_set("entity_type")).alias("entity_types")
    )
    right = edges.groupBy("graph").agg(
        F.count(F.lit(1)).alias("relationship_count"), F.sort_array(F.collect_set("relation_type")).alias("relation_types")
    )
    return left.join(right, "graph", "left").select(
        "graph",
        "entity_count",
        F.coalesce("relationship_count", F.lit(0)).cast("long").alias("relationship_count"),
        "entity_types",
        F.coalesce("relation_types", F.array().cast("array<string>")).alias("relation_types"),
    )


def node_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)
