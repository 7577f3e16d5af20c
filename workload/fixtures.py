"""Inputs of the registered queries, derived by Spark from the given tables.

``orders`` is rendered as delimited files, one per customer, and as a dirty table of strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.sources.workdir import fresh_folder

CHUNK = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw strings with missing, padded and malformed values planted by key; ``_row_idx`` is the key."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")

    def every(n: int, rest: int) -> Column:
        return key % n == rest

    return o.select(
        key.alias("_row_idx"),
        key.cast("string").alias("order_id"),
        F.when(every(17, 3), "NA").otherwise(F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("customer_id"),
        F.when(every(19, 5), "")
        .when(every(23, 7), F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit(" ")))
        .otherwise(F.col("o_orderstatus"))
        .alias("status"),
        F.when(every(29, 1), "n/a")
        .when(every(31, 2), "1,234.50")
        .when(every(37, 4), "1d")
        .when(every(41, 6), "not a number")
        .otherwise(_money("o_totalprice"))
        .alias("amount"),
        F.when(every(43, 8), "not a date")
        .when(every(47, 9), "null")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .alias("order_date"),
        F.when(every(13, 0), F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.concat(F.lit("order "), key.cast("string"), F.lit(" by customer "), F.col("o_custkey").cast("string")).alias("note"),
    )


HEADER = ("order_id", "order_date", "amount", "status", "priority")
YEARS = ("1995", "1996", "1997", "1998", "1999")


def rendered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delimited file per customer: ``file_id, line_no, line``.

    The delimiter depends on ``o_custkey % 4``; every fifth file begins with a comment, every third has a
    blank line after it, every seventh quotes a field that holds the delimiter, every eleventh has years for
    column names and every thirteenth has no header at all. ``line_no`` is an ordering key with gaps.
    """
    o = table(spark, sf_dir, "orders")
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    sep = F.element_at(F.array(F.lit(","), F.lit("\t"), F.lit("|"), F.lit(";")), (cust % 4 + 1).cast("int"))
    name = F.concat(F.lit("file_"), cust.cast("string"))
    label = F.when(
        cust % 7 == 0, F.concat(F.lit('"'), F.col("o_orderpriority"), sep, F.lit(' ""x"""'))
    ).otherwise(F.col("o_orderpriority"))
    data = o.select(
        name.alias("file_id"),
        (key + 10).alias("line_no"),
        F.call_function(
            "concat_ws", sep, key.cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), _money("o_totalprice"),
            F.col("o_orderstatus"), label,
        ).alias("line"),
    )
    header = F.when(cust % 13 == 0, F.lit(None).cast("string")).when(
        cust % 11 == 0, F.call_function("concat_ws", sep, *[F.lit(c) for c in YEARS])
    ).otherwise(F.call_function("concat_ws", sep, *[F.lit(c) for c in HEADER]))
    comment = F.when(cust % 5 == 0, F.concat(F.lit("# exported for customer "), cust.cast("string")))
    blank = F.when(cust % 3 == 0, F.lit("   "))
    preamble = (
        o.select(cust)
        .distinct()
        .select(name.alias("file_id"), F.posexplode(F.array(comment, blank, header)).alias("line_no", "line"))
        .where(F.col("line").isNotNull())
        .withColumn("line_no", F.col("line_no").cast("long"))
    )
    return data.unionByName(preamble)


def written_files(spark: SparkSession, sf_dir: str, files: int = 64) -> str:
    """Orders as comma-separated text files, one folder ``g=i`` per ``o_custkey % files``; returns the folder."""
    o = table(spark, sf_dir, "orders")
    line = F.concat_ws(
        ",", F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), _money("o_totalprice"),
        "o_orderstatus", "o_orderpriority",
    )
    group = (F.col("o_custkey") % files).alias("g")
    rows = o.select(group, (F.col("o_orderkey") + 1).alias("line_no"), line.alias("line"))
    headers = o.select(group).distinct().select("g", F.lit(0).cast("long").alias("line_no"), F.lit(",".join(HEADER)).alias("line"))
    path = fresh_folder(spark, "files")
    (
        rows.unionByName(headers)
        .repartition("g")
        .sortWithinPartitions("g", "line_no")
        .select("g", "line")
        .write.partitionBy("g")
        .text(path)
    )
    return path


def multiline_files(spark: SparkSession, sf_dir: str, files: int = 16) -> str:
    """Orders as comma-separated text files whose notes run over several lines, one folder ``g=i`` per ``o_custkey % files``."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    note = (
        F.when(key % 3 == 0, F.concat(F.lit('"order '), key, F.lit('\n\nsays ""now"", twice\n"')))
        .when(key % 3 == 1, F.concat(F.lit('"by, '), F.col("o_custkey"), F.lit('"')))
        .otherwise("plain")
    )
    group = (F.col("o_custkey") % files).alias("g")
    rows = o.select(group, (key + 1).alias("line_no"), F.concat_ws(",", key.cast("string"), note, "o_orderstatus").alias("line"))
    headers = o.select(group).distinct().select("g", F.lit(0).cast("long").alias("line_no"), F.lit("order_id,note,status").alias("line"))
    path = fresh_folder(spark, "files")
    every = rows.unionByName(headers).repartition("g").sortWithinPartitions("g", "line_no").select("g", "line")
    every.write.partitionBy("g").text(path)
    return path


WIDE = 60


def wide_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with sixty numbers each: five measures in twelve mixtures, every seventh column with missing values."""
    measures = [F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey")]

    def number(i: int) -> Column:
        x = measures[i % 5] * (1 + i // 5) + measures[(i // 5) % 5] * (i % 3) + F.col("l_partkey") % (i + 2)
        return F.when(F.col("l_orderkey") % 11 != i // 7, x) if i % 7 == 0 else x

    return table(spark, sf_dir, "lineitem").select("l_orderkey", *[number(i).alias(f"c{i}") for i in range(WIDE)])


def file_group() -> Column:
    return F.regexp_extract("file_id", "g=([0-9]+)/", 1).cast("long").alias("g")


def geo_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with nation and region; ``_row_idx`` is the customer key."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("_row_idx"),
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
    )


def commerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders joined to their customer's nation and region, with two derived amounts."""
    o = table(spark, sf_dir, "orders")
    g = geo_customers(spark, sf_dir).drop("_row_idx", "balance")
    return o.join(g, F.col("o_custkey") == F.col("customer_id")).select(
        F.col("o_orderkey").alias("_row_idx"),
        F.col("o_orderkey").alias("order_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("customer_id"),
        "customer_name",
        F.col("o_totalprice").alias("amount"),
        (F.col("o_totalprice") * 0.1 + 5).alias("tax"),
        (F.col("o_totalprice") * -0.2).alias("rebate"),
        (F.col("o_orderkey") % 7).cast("int").alias("quantity"),
        F.col("o_orderdate").alias("order_date"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("shipped"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        "region",
        "nation",
        F.when(F.col("o_orderkey") % 10 != 0, F.col("segment")).alias("segment"),
    )


# Tables that the multi-table queries read, with the integer column that orders their rows.
KEYED = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "events": "event_id", "documents": "doc_id"}
