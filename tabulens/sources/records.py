"""Records that run over several lines: the state of quotes at every line, as a parallel scan.

A line begins outside of quotes or inside a quoted field, and ends so; what it does is a map of these two states. Lines
without a quote keep the state. A file's splits are scanned apart: inside a split the state is that of the last line that
ends alike from both states, turned by each line since that swaps them; the maps of whole splits are composed in the same
way over a file. Only quoted lines take part, as a position and a map; no line is moved to find the records.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.functions.fields import DELIMITERS
from tabulens.sources.workdir import stored


def _opens(line: Column, delimiter: str) -> Column:
    """Whether a line that begins outside of quotes ends inside: its last field has a quote first and none that closes."""
    sep = re.escape(delimiter)
    quoted = r'"[^"]*+(?:""[^"]*+)*+'
    field = rf'(?:{quoted}"[^{sep}]*+|[^"{sep}][^{sep}]*+|)'
    return F.rlike(line, F.lit(rf"\A(?:{field}{sep})*+{quoted}\z"))


def quote_map(line: Column, delimiter: Column, delimiters: tuple[str, ...] = DELIMITERS) -> Column:
    """Struct of ``outside`` and ``inside``: whether a line ends inside of quotes, by where it begins."""

    def after(text: Column) -> Column:
        branches = F.when(delimiter == delimiters[0], _opens(text, delimiters[0]))
        for candidate in delimiters[1:]:
            branches = branches.when(delimiter == candidate, _opens(text, candidate))
        return F.coalesce(branches, F.lit(False))

    has = F.contains(line, F.lit('"'))
    # Inside of quotes a line is what it would be with a quote before it.
    return F.struct((has & after(line)).alias("outside"), F.when(has, after(F.concat(F.lit('"'), line))).otherwise(True).alias("inside"))


def _state(values: Column, swaps: Column, start: Column) -> Column:
    """The state after the last fixed value, struct of (value, swaps so far), and the swaps since; ``start`` without any."""
    turned = F.coalesce(swaps, F.lit(0)) - F.coalesce(values["swaps"], F.lit(0))
    return F.coalesce(values["value"], start) != (turned % 2 == 1)


def _scanned(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Rows with (outside, inside) get, by ``keys`` in ``order``: what lies before them (fixed, swaps) and up to them (so_fixed, so_swaps)."""
    order_by = Window.partitionBy(*keys).orderBy(order)
    before, here = (order_by.rowsBetween(Window.unboundedPreceding, end) for end in (-1, Window.currentRow))
    swap = F.when(F.col("outside") & ~F.col("inside"), 1).otherwise(0)
    counted = rows.withColumns({"swaps": F.sum(swap).over(before), "so_swaps": F.sum(swap).over(here)})
    fixed = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").alias("value"), F.col("so_swaps").alias("swaps")))
    counted = counted.withColumn("_fixed", fixed)
    return counted.withColumns({"fixed": F.last("_fixed", True).over(before), "so_fixed": F.last("_fixed", True).over(here)}).drop("_fixed")


def open_files(lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """``file_id`` of files with a line that ends inside of quotes; in all others every line is a record."""
    asked = lines.where(F.contains("line", F.lit('"'))).join(decisions.select("file_id", "delimiter"), "file_id")
    return asked.where(quote_map(F.col("line"), F.col("delimiter"))["outside"]).select("file_id").distinct()


def quote_states(lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """``file_id, block, position, begins, ends`` of lines that hold quotes: whether they begin and end inside of them."""
    quoted = lines.where(F.contains("line", F.lit('"'))).join(decisions.select("file_id", "delimiter"), "file_id")
    maps = quoted.select("file_id", "line_no.block", "line_no.position", quote_map(F.col("line"), F.col("delimiter")).alias("m"))
    inside = _scanned(maps.select("file_id", "block", "position", "m.*"), ("file_id", "block"), "position")
    # What a whole split does to either state, and the state it begins with; a file has one row for each split here.
    splits = inside.groupBy("file_id", "block").agg(F.max_by(F.struct("so_fixed", "so_swaps"), "position").alias("x"))
    ends = {c: _state(F.col("x.so_fixed"), F.col("x.so_swaps"), F.lit(start)) for c, start in (("outside", False), ("inside", True))}
    splits = _scanned(splits.select("file_id", "block", *(x.alias(c) for c, x in ends.items())), ("file_id",), "block")
    starts = splits.select("file_id", "block", _state(F.col("fixed"), F.col("swaps"), F.lit(False)).alias("start"))
    found = inside.join(starts, ["file_id", "block"]).withColumn("begins", _state(F.col("fixed"), F.col("swaps"), F.col("start")))
    return found.select("file_id", "block", "position", "begins", F.when(F.col("begins"), F.col("inside")).otherwise(F.col("outside")).alias("ends"))


def record_ranges(lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """``file_id, block, low, high, head``: positions of a split that belong to a record of several lines, its first line.

    A record that runs on into other splits has a range in each. Quotes that no line of the file closes hold no record:
    from the line with the last opening quote on, lines stand for themselves.
    """
    marks = stored(quote_states(lines, decisions).where("begins <> ends"), "marks")
    order = Window.partitionBy("file_id", "block").orderBy("position")
    near = marks.withColumns({"_next": F.lead("position").over(order), "_first": F.row_number().over(order) == 1})
    head = F.struct("block", "position")
    inner = near.where(F.col("ends") & F.col("_next").isNotNull()).select("file_id", "block", F.col("position").alias("low"), F.col("_next").alias("high"), head.alias("head"))
    # Of each split: the quote still open at its end, and the first one closed, which then was open at its beginning.
    edges = near.groupBy("file_id", "block").agg(
        F.max(F.when(F.col("ends") & F.col("_next").isNull(), F.col("position"))).alias("tail"), F.max(F.when(F.col("begins") & F.col("_first"), F.col("position"))).alias("closer")
    )
    splits = lines.groupBy("file_id", F.col("line_no.block").alias("block")).agg(F.min("line_no.position").alias("first"), F.max("line_no.position").alias("last"))
    by_file = Window.partitionBy("file_id").orderBy("block")
    marked = F.when(F.col("_marked"), F.struct("block", F.col("tail").alias("position")))
    splits = splits.join(edges.withColumn("_marked", F.lit(True)), ["file_id", "block"], "left").withColumns({
        "carried": F.last(marked, True).over(by_file.rowsBetween(Window.unboundedPreceding, -1)),
        "closes": F.first("_marked", True).over(by_file.rowsBetween(1, Window.unboundedFollowing)).isNotNull(),
    })
    begun = splits.where(F.col("carried.position").isNotNull() & (F.col("closer").isNotNull() | (F.col("_marked").isNull() & F.col("closes")))).select(
        "file_id", "block", F.col("first").alias("low"), F.coalesce("closer", "last").alias("high"), F.col("carried").alias("head")
    )
    left = splits.where(F.col("tail").isNotNull() & F.col("closes")).select(
        "file_id", "block", F.col("tail").alias("low"), F.col("last").alias("high"), F.struct("block", F.col("tail").alias("position")).alias("head")
    )
    return inner.unionByName(begun).unionByName(left)


def merged(lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """Records of lines with ``line_no`` (block, position), blank ones among them: ``file_id, line_no, line, _lines``.

    A record has the number of its first line, its lines joined by line feeds, and their count. Lines of a record of
    several lines are met by position and are the only ones that are grouped; blank lines outside of records go.
    """
    ranges = record_ranges(lines, decisions).select("file_id", F.col("block").alias("_block"), F.explode(F.sequence("low", "high")).alias("_position"), "head")
    each = lines.withColumns({"_block": F.col("line_no.block"), "_position": F.col("line_no.position")}).join(ranges, ["file_id", "_block", "_position"], "left")
    single = each.where(F.col("head").isNull() & F.col("line").rlike(r"\S")).select("file_id", "line_no", "line", F.lit(1).cast("long").alias("_lines"))
    parts = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    several = each.where(F.col("head").isNotNull()).groupBy("file_id", F.col("head").alias("line_no")).agg(
        F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("line"), F.count(F.lit(1)).alias("_lines")
    )
    return single.unionByName(several)


def merged_head(head: DataFrame, delimiters: DataFrame) -> DataFrame:
    """The same for file heads, whose ``line_no`` is a plain number; a record that the head cuts off stays as lines."""
    numbered = head.select("file_id", F.struct(F.lit(0).cast("long").alias("block"), F.col("line_no").alias("position")).alias("line_no"), "line")
    return merged(numbered, delimiters).select("file_id", F.col("line_no.position").alias("line_no"), "line")
