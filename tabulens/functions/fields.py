"""Splitting one delimited line into its fields without leaving the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Delimiters that are tried, in order of preference.
DELIMITERS = (",", "\t", "|", ";")


def _quoted_pieces(line: Column, delimiter: str) -> Column:
    """Fields of a line holding quotes, each still in its quotes.

    A field is a delimiter followed either by a quoted text that runs up to the next delimiter or by
    anything free of delimiters. The possessive quantifiers keep Java's matcher iterative, so a very long
    quoted field cannot overflow its stack.
    """
    sep = re.escape(delimiter)
    pattern = rf'{sep}("[^"]*+(?:""[^"]*+)*+"(?={sep}|$)|[^{sep}]*+)'
    return F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(pattern), F.lit(1))


def _unquote(field: Column) -> Column:
    inner = F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
    is_quoted = field.startswith('"') & field.endswith('"') & (F.length(field) >= 2)
    return F.when(is_quoted, inner).otherwise(field)


def plain_split(line: Column, delimiter: str) -> Column:
    return F.split(line, re.escape(delimiter), -1)


def quoted_split(line: Column, delimiter: str) -> Column:
    """Quote-aware split; lines without a quote take the cheap way."""
    return F.when(
        F.contains(line, F.lit('"')),
        F.transform(_quoted_pieces(line, delimiter), _unquote),
    ).otherwise(plain_split(line, delimiter))


def field_count(line: Column, delimiter: str) -> Column:
    """Number of fields, quotes respected."""
    plain = F.length(line) - F.length(F.replace(line, F.lit(delimiter), F.lit(""))) + 1
    return F.when(F.contains(line, F.lit('"')), F.size(_quoted_pieces(line, delimiter))).otherwise(plain)


def split_by(line: Column, delimiter: Column, quotes: bool = True, delimiters: tuple[str, ...] = DELIMITERS) -> Column:
    """Split with a delimiter taken from a column; each branch keeps its pattern constant."""
    split = quoted_split if quotes else plain_split
    branches = F.when(delimiter == delimiters[0], split(line, delimiters[0]))
    for candidate in delimiters[1:]:
        branches = branches.when(delimiter == candidate, split(line, candidate))
    return branches
