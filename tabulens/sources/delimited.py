"""Adaptive scan of delimited files: one job for any number of files, formats and sizes.

Lines are read as text and split as data, so files of different delimiters and headers share a scan, and a
large file is read by many tasks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulens.functions.fields import split_by
from tabulens.functions.predicates import null_tokens_to_null
from tabulens.operators import headers
from tabulens.sources import formats, heads, records
from tabulens.sources.rows import number_lines, number_records
from tabulens.sources.workdir import stored

BYTE_ORDER_MARK = "\ufeff"


def read_lines(
    spark: SparkSession, *paths: str, encodings: DataFrame | None = None, keep_blank: bool = False
) -> DataFrame:
    """Every line of every file as ``file_id, line_no, line``; blank lines are left out by default.

    ``line_no`` is ``(block, position)``: the byte offset of the file split and a position that grows inside
    it. It orders the lines of a file without counting them. ``encodings`` (``file_id, encoding``) decodes
    files that are not UTF-8.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(list(paths)).select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    if not keep_blank:
        raw = raw.where(F.col("value").rlike(r"\S"))
    # The position is taken after the filter, so that it counts the lines that remain.
    lines = raw.select(
        "file_id",
        F.struct("block", F.monotonically_increasing_id().alias("position")).alias("line_no"),
        F.col("value").alias("line"),
    )
    if encodings is None:
        return lines
    return lines.join(encodings.select("file_id", "encoding"), "file_id").select(
        "file_id", "line_no", heads.decode_line(F.col("line").cast("binary"), F.col("encoding")).alias("line")
    )


def column_catalogue(decisions: DataFrame) -> DataFrame:
    """Raw column names per file: ``file_id, ordinal, raw_name`` from the ``fields`` of the header."""
    return decisions.select("file_id", F.posexplode("fields").alias("ordinal", "raw_name"))


def unique_names(catalogue: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Add ``name``: blanks become ``Unnamed: i``, the n-th repeat of a name gets ``__dupn``."""
    name = F.when(F.trim("raw_name") == "", F.concat(F.lit("Unnamed: "), F.col("ordinal").cast("string"))).otherwise(
        F.col("raw_name")
    )
    seen = Window.partitionBy(*keys, "_base").orderBy("ordinal")
    return (
        catalogue.withColumn("_base", name)
        .withColumn("_seen", F.row_number().over(seen) - 1)
        .withColumn(
            "name",
            F.when(F.col("_seen") > 0, F.concat("_base", F.lit("__dup"), F.col("_seen").cast("string"))).otherwise(
                F.col("_base")
            ),
        )
        .drop("_base", "_seen")
    )


def unique_name_array(fields: Column) -> Column:
    """The same rule as ``unique_names`` on one array of raw names."""
    based = F.transform(
        fields,
        lambda f, i: F.when(F.trim(f) == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(f),
    )

    def named(name: Column, i: Column) -> Column:
        seen = F.size(F.filter(F.slice(based, F.lit(1), i), lambda other: other == name))
        return F.when(seen > 0, F.concat(name, F.lit("__dup"), seen.cast("string"))).otherwise(name)

    return F.transform(based, named)


def names_of(fields: Column) -> Column:
    return unique_name_array(F.transform(fields, lambda f: F.regexp_replace(f, f"^{BYTE_ORDER_MARK}", "")))


def decide(head: DataFrame, mode: str = "robust", **scan: int) -> DataFrame:
    """One row per file: delimiter, header row, confidence, column names and ``index_width``.

    The first data row decides, once for the file, how many leading fields are an index without a name.
    """
    return headers.detect_headers(head, mode, **scan).withColumn("names", names_of(F.col("fields"))).drop("fields")


def with_index_width(decisions: DataFrame, numbered: DataFrame) -> DataFrame:
    """Decisions with ``index_width``, from the line after the header among lines with their ``row``."""
    after = numbered.join(decisions.select("file_id", "delimiter", "header_row", F.size("names").alias("_width")), "file_id")
    first = after.where(F.col("row") == F.col("header_row") + 1).select(
        "file_id", F.greatest(F.size(split_by(F.col("line"), F.col("delimiter"))) - F.col("_width"), F.lit(0)).alias("index_width")
    )
    return decisions.drop("index_width").join(first, "file_id", "left").withColumn("index_width", F.coalesce("index_width", F.lit(0)))


def with_full_names(decisions: DataFrame, lines: DataFrame, cut: DataFrame) -> DataFrame:
    """Decisions whose names come from whole header lines, also of files whose head ended within the header.

    ``cut`` holds the ``file_id`` of such files, ``lines`` all numbered lines; only the two lines of those files that
    name and shift columns are kept of them.
    """
    asked = decisions.join(cut.select("file_id"), "file_id", "left_semi").select("file_id", "delimiter", "header_row")
    near = lines.join(asked, "file_id").where(F.col("row").between(F.col("header_row"), F.col("header_row") + 1))
    whole = near.where(F.col("row") == F.col("header_row")).select(
        "file_id", names_of(split_by(F.col("line"), F.col("delimiter"))).alias("_names")
    )
    named = decisions.join(whole, "file_id", "left")
    renamed = named.withColumn("names", F.coalesce("_names", "names"))
    shifted = with_index_width(renamed.where(F.col("_names").isNotNull()).drop("_names"), near.select("file_id", "row", "line"))
    return renamed.where(F.col("_names").isNull()).drop("_names").unionByName(shifted)


def data_lines(lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """Lines below the header of their file, blank ones left out.

    Numbered lines (a ``row`` counting non-blank lines, as heads have) are compared by number and get the
    number of the data row, ``_row_idx``; others are compared by their ordering key, which must then be the
    one the heads were taken with.
    """
    wanted = decisions.select("file_id", "delimiter", "header_row", "header_line_no", "names", "index_width")
    joined = lines.where(F.col("line").rlike(r"\S")).join(wanted, "file_id")
    if "row" in lines.columns:
        return joined.where(F.col("row") > F.col("header_row")).withColumn(
            "_row_idx", F.col("row") - F.col("header_row") - 1
        )
    return joined.where(F.col("line_no") > F.col("header_line_no"))


def scan_rows(lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """Data rows of all files: ``file_id, line_no, names, cells, _index, _extra`` (and ``_row_idx`` of numbered lines).

    Missing cells are null; a shorter row is filled up with nulls. Leading fields that the file has no names for
    are in ``_index``, and what a row holds beyond its last column is in ``_extra``, as it stands.
    """
    width, shift = F.size("names"), F.col("index_width")
    fields = split_by(F.col("line"), F.col("delimiter"))
    below = data_lines(lines, decisions)
    return below.withColumn("fields", fields).select(
        "file_id",
        *[c for c in ("line_no", "_row_idx", "_lines") if c in below.columns],
        "names",
        # As many cells as names: what a row holds of them, then nulls.
        F.concat(F.transform(F.slice("fields", shift + 1, width), null_tokens_to_null), F.array_repeat(F.lit(None).cast("string"), width + shift - F.greatest(F.size("fields"), shift))).alias("cells"),
        F.slice("fields", F.lit(1), shift).alias("_index"),
        F.slice("fields", shift + width + 1, F.greatest(F.size("fields"), F.lit(1))).alias("_extra"),
    )


def skipped_lines(lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """``file_id, line_no, line, reason`` of the lines that are neither a header nor data: blank ones and those above it."""
    wanted = decisions.select("file_id", "header_row", "header_line_no")
    above = F.col("row") < F.col("header_row") if "row" in lines.columns else F.col("line_no") < F.col("header_line_no")
    reason = F.when(~F.col("line").rlike(r"\S"), "blank").when(above, "above_header")
    return lines.join(wanted, "file_id").withColumn("reason", reason).where("reason is not null").select("file_id", "line_no", "line", "reason")


class Scan(NamedTuple):
    """Data rows, what was decided per file, and the lines left out. Every line that is not blank is in one of them."""

    rows: DataFrame
    decisions: DataFrame
    skipped: DataFrame


def scan_files(spark: SparkSession, *paths: str, mode: str = "robust", sniff_bytes: int = heads.SNIFF_BYTES, **scan: int) -> Scan:
    """Detect and read any number of delimited files.

    Heads decide on format and header row; the files themselves are read once to find quotes that stay open, once to
    count the lines of their splits and once for the data. Heads and decisions are written once to the shared folder, so
    that each file is opened for its head once, and joins know their measured size. A head that ends within the header or
    the line after it still decides on the row, but the columns come from the whole lines. A quoted field with line
    breaks is one field, wherever the file is split; only files that hold such fields are read and numbered apart. Rows
    tell in ``_lines`` how many lines they took.
    """
    head = stored(heads.read_heads(spark, *paths, sniff_bytes=sniff_bytes), "heads")
    encodings = head.groupBy("file_id").agg(F.first("encoding").alias("encoding"))
    numbered = formats.head_lines(head)
    if head.where(F.contains("line", F.lit('"'))).limit(1).count():
        sniffed = formats.sniff_delimiter(numbered, mode)
        broken = stored(records.open_files(head, sniffed), "broken")
        if broken.limit(1).count():
            joined = records.merged_head(head.join(broken, "file_id", "left_semi"), sniffed)
            numbered = numbered.join(broken, "file_id", "left_anti").drop("encoding").unionByName(formats.head_lines(joined))
    ends = numbered.groupBy("file_id").agg(F.max("row").alias("_last_row"))
    longer = heads.list_files(spark, *paths).where(F.col("length") > sniff_bytes).select("file_id")
    found = decide(numbered, mode, **scan).join(encodings, "file_id").join(ends, "file_id")
    found = found.join(longer.withColumn("_longer", F.lit(True)), "file_id", "left")
    found = found.withColumn("_cut", F.coalesce("_longer", F.lit(False)) & (F.col("header_row") + 1 >= F.col("_last_row"))).drop("_longer", "_last_row")
    decisions = stored(found, "decisions")
    lines = numbered_records(spark, *paths, decisions=decisions)
    cut, decisions = decisions.where("_cut").select("file_id"), decisions.drop("_cut")
    if cut.limit(1).count():
        decisions = with_full_names(decisions, lines, cut)
    return Scan(scan_rows(lines, decisions), decisions, skipped_lines(lines, decisions))


def numbered_records(spark: SparkSession, *paths: str, decisions: DataFrame) -> DataFrame:
    """``file_id, line_no, line, _lines, row``: the records of all files, numbered by file."""
    lines = read_lines(spark, *paths, encodings=decisions)
    opened = stored(records.open_files(lines, decisions), "opened")
    if not opened.limit(1).count():
        return number_lines(lines.withColumn("_lines", F.lit(1).cast("long")))
    whole = number_lines(lines.join(opened, "file_id", "left_anti").withColumn("_lines", F.lit(1).cast("long")))
    every = read_lines(spark, *paths, encodings=decisions, keep_blank=True).join(opened, "file_id", "left_semi")
    return whole.unionByName(number_records(stored(records.merged(every, decisions), "records")))


def header_groups(decisions: DataFrame) -> DataFrame:
    """Files that share their column names, so that each group can become one table."""
    return decisions.groupBy("names").agg(F.count(F.lit(1)).alias("files"))


def as_table(rows: DataFrame, names: list[str]) -> DataFrame:
    """The rows of all files with exactly these columns, as a wide table of strings."""
    same = F.col("names") == F.array(*[F.lit(n) for n in names])
    cells = [F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(names)]
    keys = [c for c in ("file_id", "line_no", "_row_idx") if c in rows.columns]
    return rows.where(same).select(*keys, *cells)


def value_of(rows: DataFrame, name: str) -> Column:
    """One cell of a row by column name, null where the file has no such column."""
    return F.get("cells", (F.array_position("names", name) - 1).cast("int"))
