"""Semantic channel: evidence from column names and a sample of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fifteen attributes a table can have.
ATTRIBUTES = (
    "temporal_pattern", "numeric_density", "sparsity", "categorical_presence", "relational_structure",
    "text_richness", "high_cardinality", "distribution_skewed", "distribution_heavy_tail", "periodicity",
    "anomaly_presence", "financial_indicators", "geographical_indicators", "pii_indicators",
    "hierarchical_structure",
)

# Words that speak for an attribute, in names or values.
KEYWORDS = {
    "financial_indicators": (
        "price", "amount", "balance", "transaction", "payment", "revenue", "profit", "cost", "fee", "tax",
        "currency", "rate", "interest", "价格", "金额", "余额", "交易", "支付", "收入", "利润", "费用",
    ),
    "geographical_indicators": (
        "city", "country", "state", "province", "address", "location", "latitude", "longitude", "zip", "postal",
        "region", "area", "城市", "国家", "省份", "地址", "位置", "区域",
    ),
    "pii_indicators": (
        "name", "email", "phone", "ssn", "passport", "id_card", "birth", "age", "gender", "address", "identity",
        "姓名", "邮箱", "电话", "身份证", "护照", "出生", "年龄", "性别",
    ),
    "temporal_pattern": (
        "date", "time", "timestamp", "datetime", "year", "month", "day", "hour", "minute", "created", "updated",
        "expired", "日期", "时间", "年", "月", "日", "时", "分", "秒",
    ),
}
# Share of a word list that saturates its score, and fragments of key-like names.
KEYWORD_SHARE = 0.15
KEY_FRAGMENTS = ("_id", "id_", "_key", "key_", "_pk", "_fk")


def attribute_frame(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(a,) for a in ATTRIBUTES], "attribute string")


def attribute_rows(wide: DataFrame, scores: dict[str, Column], keys: tuple[str, ...] = ("table",)) -> DataFrame:
    """One row per key and attribute; attributes without evidence score 0."""
    items = [
        F.struct(F.lit(a).alias("attribute"), F.coalesce(scores.get(a, F.lit(0.0)), F.lit(0.0)).cast("double").alias("score"))
        for a in ATTRIBUTES
    ]
    return wide.select(*keys, F.inline(F.array(*items)))


def _hits(text: Column, words: tuple[str, ...]) -> list[Column]:
    return [F.max(F.contains(text, F.lit(word.lower())).cast("int")) for word in words]


def keyword_scores(pieces: DataFrame) -> DataFrame:
    """``table`` and one score per keyword list, from ``table, text`` pieces.

    Keywords hold no spaces, so a word occurs in the joined text exactly if it occurs in one of its pieces:
    flags are combined by max and no text is ever put together.
    """
    text = F.lower("text")
    flags = {f"{a}_{i}": hit for a, words in KEYWORDS.items() for i, hit in enumerate(_hits(text, words))}
    found = pieces.groupBy("table").agg(*[hit.alias(name) for name, hit in flags.items()])
    scores = []
    for a, words in KEYWORDS.items():
        hits = sum((F.col(f"{a}_{i}") for i in range(len(words))), F.lit(0))
        scores.append(F.least(F.lit(1.0), hits / F.lit(len(words) * KEYWORD_SHARE)).alias(a))
    return found.select("table", *scores)


def text_pieces(catalogue: DataFrame, samples: DataFrame) -> DataFrame:
    """Column names and sampled values (``table, column, value``) as ``table, text``."""
    names = catalogue.select("table", F.col("column").alias("text"))
    return names.unionByName(samples.select("table", F.col("value").alias("text")))


def value_sample_text(heads: DataFrame) -> DataFrame:
    """The sampled values of every column in row order, lower-cased and joined (at most 20 per column)."""
    return heads.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("v")).select(
        "column", F.lower(F.concat_ws(" ", F.transform("v", lambda x: x.getField("value")))).alias("sample_text")
    )


def key_column_share(catalogue: DataFrame) -> DataFrame:
    """``table, relational_structure``: share of columns whose name looks like a key."""
    name = F.lower("column")
    is_key = F.lit(False)
    for fragment in KEY_FRAGMENTS:
        is_key = is_key | F.contains(name, F.lit(fragment))
    return catalogue.groupBy("table").agg(F.avg(is_key.cast("double")).alias("relational_structure"))


def semantic_scores(catalogue: DataFrame, samples: DataFrame) -> DataFrame:
    """``table, attribute, score`` for all fifteen attributes."""
    wide = keyword_scores(text_pieces(catalogue, samples)).join(key_column_share(catalogue), "table", "left")
    evidence = (*KEYWORDS, "relational_structure")
    return attribute_rows(wide, {a: F.col(a) for a in evidence})


def embedding_consistency(df: DataFrame, group: str, vector: str) -> DataFrame:
    """``group, n, semantic_consistency``: mean cosine similarity of all pairs, without forming a pair.

    For unit vectors the pairwise sum is ``|sum|^2 - n``. Sums are taken per dimension, so a group of any size
    shrinks to one row per dimension and task before it is shuffled. Null for groups of fewer than two.
    """
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    units = df.select(
        F.col(group), norm.alias("_norm"), F.posexplode(F.transform(vector, lambda x: x.cast("double"))).alias("dim", "x")
    )
    length = F.col("_norm")
    sums = units.groupBy(group, "dim").agg(
        F.sum(F.when(length > 0, F.col("x") / length).otherwise(0.0)).alias("s"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(length > 0, 1)).alias("unit"),
    )
    n = F.col("n").cast("double")
    return (
        sums.groupBy(group)
        .agg(F.max("n").alias("n"), F.max("unit").alias("unit"), F.sum(F.col("s") * F.col("s")).alias("square"))
        .select(group, "n", F.try_divide(F.col("square") - F.col("unit"), n * (n - 1)).alias("semantic_consistency"))
    )
