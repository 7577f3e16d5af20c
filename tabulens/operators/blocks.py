"""Figures of candidate header lines and of the lines below them, for many files at once.

The kinds and numbers of all cells come judged; here they are only counted and added up, as flat arrays over all cells of
a batch, in the order of their lines.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from tabulens.operators.typescores import CATEGORICAL_MEAN_LENGTH, CATEGORICAL_RATIO

# Texts that stand for "no time" and so pass a lenient date parser.
NO_TIME = ("NaT", "nat", "NAT", "nan", "NaN", "NAN")
# What a cell that is not missing can be.
BLANK, NUMERIC, DATETIME, OTHER = range(4)
#: Cells whose files are worked on together; a cell falls into the blocks of at most all candidates of its file.
TOGETHER = 200_000

FIGURES = {
    # Of the block: leading fields beyond the candidate's, whether it can be read, means over columns.
    "shift": pa.int32(), "parsed": pa.bool_(), "width": pa.int32(), "dominant": pa.float64(), "spread": pa.float64(),
    # Of columns with anything in them, and of those whose first row is a number.
    "filled": pa.int32(), "filled_dominant": pa.float64(), "first_numeric": pa.int32(),
    # Of the candidate's tokens.
    "tokens": pa.int32(), "likeness": pa.float64(), "distinct": pa.int32(), "numeric": pa.int32(), "datetime": pa.int32(),
}
_SQL = {pa.int32(): "int", pa.bool_(): "boolean", pa.float64(): "double"}
FIGURES_TYPE = f"array<struct<{', '.join(f'{name}: {_SQL[kind]}' for name, kind in FIGURES.items())}>>"


def _spans(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The span each number belongs to, and the numbers ``start, start + 1, ...`` of all spans one after the other."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) + (starts - (np.cumsum(sizes) - sizes))[owner]


def _quotient(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """0 where there is nothing to divide by."""
    return np.divide(part, whole, out=np.zeros(len(whole)), where=whole > 0)


def _distinct(owner: np.ndarray, code: np.ndarray, owners: int) -> np.ndarray:
    """How many codes each owner has."""
    span = int(code.max(initial=0)) + 1
    return np.bincount(pd.unique(owner * span + code) // span, minlength=owners)


class _Lists:
    """A column of lists, as one flat array and where each list begins."""

    def __init__(self, lists: pa.ListArray) -> None:
        offsets = np.asarray(lists.offsets, np.int64)
        self.flat, self.starts = lists.flatten(), offsets - offsets[0]

    def numbers(self, null: object) -> np.ndarray:
        return pc.fill_null(self.flat, pa.scalar(null, self.flat.type)).to_numpy(zero_copy_only=False)

    def codes(self) -> np.ndarray:
        return self.flat.dictionary_encode().indices.to_numpy()


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _block_figures(files, line, cells, widths, first, ends, look_ahead: int, robust: bool) -> dict[str, np.ndarray]:
    """Of candidate lines ``line`` (a file's lines end at ``ends``; a line's cells begin at ``first``): their blocks."""
    n = len(line)
    begin = line + 1
    size = np.minimum(begin + look_ahead, ends) - begin
    width = widths[line]
    shift = np.maximum(np.where(size > 0, widths[np.minimum(begin, len(widths) - 1)], 0) - width, 0)
    of, row = _spans(begin, size)
    fits = widths[row] <= (width + shift)[of]
    wide = size - np.bincount(of[fits], minlength=n)
    parsed = (wide == 0) | ((2 * wide < size) & robust)
    kept = fits & parsed[of]
    of, row = of[kept], row[kept]
    # Columns of all candidates, one after the other.
    column = _starts(width)[:-1]
    owner, at = _spans(shift, width)
    top = np.full(n, -1)
    top[of[::-1]] = row[::-1]
    there = (top[owner] >= 0) & (at < widths[top[owner]])
    cell = np.where(there, first[top[owner]] + at, 0)
    # A missing cell reads as "nan", which is a number to the parser.
    first_numeric = ~there | cells["missing"][cell] | (cells["kind"][cell] == NUMERIC) if len(cells["kind"]) else ~there
    line_of, cell = _spans(first[row] + shift[of], np.maximum(widths[row] - shift[of], 0))
    place = cell - first[row[line_of]] - shift[of[line_of]] + column[of[line_of]]
    kept = ~cells["missing"][cell]
    cell, place = cell[kept], place[kept]
    kind, columns = cells["kind"][cell], len(owner)
    counts = np.bincount(place * 4 + kind, minlength=4 * columns).reshape(-1, 4)
    present = counts[:, NUMERIC] + counts[:, DATETIME] + counts[:, OTHER]
    length = np.bincount(place, cells["size"][cell], columns)
    # Anything is at least one value, so most columns are out of reach without a look at their texts.
    few = (_quotient(np.ones(columns), present) < CATEGORICAL_RATIO) & (_quotient(length, present) < CATEGORICAL_MEAN_LENGTH) & (present > 0)
    asked = few[place] & (kind != BLANK)
    distinct = _distinct(place[asked], cells["code"][cell[asked]], columns)
    categorical = (few & (_quotient(distinct, present) < CATEGORICAL_RATIO)).astype(float)
    numeric, datetime = _quotient(counts[:, NUMERIC], present), _quotient(counts[:, DATETIME], present)
    largest = np.maximum(np.maximum(numeric, datetime), categorical)
    total = numeric + datetime + categorical + 1.0 - largest
    dominant = np.where(present > 0, np.maximum(largest, 1.0 - largest) / total, 0.0)
    number = cells["number"][cell]
    finite = np.isfinite(number)
    number, place = number[finite], place[finite]
    found = np.bincount(place, minlength=columns)
    away = number - _quotient(np.bincount(place, number, columns), found)[place]
    spread = np.sqrt(_quotient(np.bincount(place, away * away, columns), found))
    filled = counts.sum(1) > 0
    return {
        "shift": shift, "parsed": parsed, "width": width,
        "dominant": _quotient(np.bincount(owner, dominant, n), width),
        "spread": _quotient(np.bincount(owner, spread, n), width),
        "filled": np.bincount(owner[filled], minlength=n),
        "filled_dominant": _quotient(np.bincount(owner[filled], dominant[filled], n), np.bincount(owner[filled], minlength=n)),
        "first_numeric": np.bincount(owner[first_numeric], minlength=n),
    }


def block_figures(max_scan: int, look_ahead: int, robust: bool) -> Callable:
    """A function of judged cells and tokens, each with the widths of their lines, that gives the ``FIGURES`` of a file's candidates.

    Sums are taken in the order of lines and of columns.
    """

    def parts(starts: np.ndarray) -> list[int]:
        """Where to cut files into parts of about TOGETHER cells."""
        lot = starts[:-1] // TOGETHER
        return [0, *(np.flatnonzero(np.diff(lot)) + 1), len(lot)] if len(lot) else [0]

    @F.arrow_udf(FIGURES_TYPE)
    def figures(
        widths: pa.Array, text: pa.Array, missing: pa.Array, numeric: pa.Array, date: pa.Array, number: pa.Array,
        token_widths: pa.Array, token_text: pa.Array, token_numeric: pa.Array, token_date: pa.Array, likeness: pa.Array,
    ) -> pa.Array:
        lines, words, token_lines, token_words, likely = map(_Lists, (widths, text, token_widths, token_text, likeness))
        every = lines.numbers(0).astype(np.int64)
        first = _starts(every)
        is_number, is_date = _Lists(numeric).numbers(False), _Lists(date).numbers(False)
        size = pc.utf8_length(words.flat).to_numpy(zero_copy_only=False)
        kind = np.where(size == 0, BLANK, np.where(is_number, NUMERIC, np.where(is_date, DATETIME, OTHER)))
        cells = {
            "missing": _Lists(missing).numbers(False), "kind": kind, "size": size, "code": words.codes().astype(np.int64),
            "number": _Lists(number).numbers(np.nan),
        }
        token_every = token_lines.numbers(0).astype(np.int64)
        token_first, token_code = _starts(token_every), token_words.codes().astype(np.int64)
        token_is_number = _Lists(token_numeric).numbers(False)
        # A blank parses as "no time" instead of failing, hence counts as a date here and only here.
        no_time = pc.is_in(token_words.flat, pa.array(["", *NO_TIME], token_words.flat.type)).to_numpy(zero_copy_only=False)
        token_is_date = _Lists(token_date).numbers(False) | no_time
        chance = likely.numbers(0.0)
        candidates = np.minimum(np.diff(lines.starts), max_scan + 1)
        cuts, found = parts(words.starts), []
        for low, high in zip(cuts, cuts[1:]):
            count = candidates[low:high]
            file, line = _spans(lines.starts[low:high], count)
            file += low
            out = _block_figures(file, line, cells, every, first, lines.starts[file + 1], look_ahead, robust)
            token_line = line - lines.starts[file] + token_lines.starts[file]
            tokens = token_every[token_line]
            owner, token = _spans(token_first[token_line], tokens)
            like = chance[token - token_words.starts[file[owner]] + likely.starts[file[owner]]]
            n = len(line)
            out |= {
                "tokens": tokens, "likeness": _quotient(np.bincount(owner, like, n), tokens), "distinct": _distinct(owner, token_code[token], n),
                "numeric": np.bincount(owner[token_is_number[token]], minlength=n), "datetime": np.bincount(owner[token_is_date[token]], minlength=n),
            }
            found.append(pa.StructArray.from_arrays([pa.array(out[k], t) for k, t in FIGURES.items()], fields=[pa.field(k, t) for k, t in FIGURES.items()]))
        kind_of = pa.struct(list(FIGURES.items()))
        return pa.ListArray.from_arrays(pa.array(_starts(candidates), pa.int32()), pa.concat_arrays(found) if found else pa.array([], kind_of))

    # Else Spark copies it, with all that it is asked of, into filters on what is made of its answer.
    return figures.asNondeterministic()
