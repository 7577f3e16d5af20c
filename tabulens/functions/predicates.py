"""Column expressions that answer what one text value looks like.

Every expression is built from JVM functions only, so it stays inside whole-stage code generation. Callers
evaluate them once per distinct value (see ``operators.histogram``) wherever a histogram exists.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that count as missing when a delimited file is read.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

WHITE_SPACE = " \t\n\r\x0b\x0c"

# Text a line starts with when it is a comment.
COMMENT_PREFIXES = ("#", "//", "--", "/*", "<!--", ";", "%")

_DIGITS = r"\d+(_\d+)*"
_PLAIN_DIGITS = r"\d+"


def _float_grammar(digits: str) -> str:
    mantissa = rf"({digits}(\.({digits})?)?|\.{digits})"
    return rf"^\s*[+-]?({mantissa}([eE][+-]?{digits})?|(?i:inf(inity)?|nan))\s*$"


# What Python's float() accepts, and the narrower set that can be cast (no digit separators "_").
FLOAT_TEXT = _float_grammar(_DIGITS)
CASTABLE_TEXT = _float_grammar(_PLAIN_DIGITS)

# The closed list of shapes that count as a date or time. Dates must exist in the calendar and
# lie within the years a nanosecond timestamp can hold.
_CLOCK = r"([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?( ?[AaPp][Mm])?"
_ZONE = r"(Z|[+-]\d{2}:?\d{2})?"
_MONTH = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
_DAY = r"(0?[1-9]|[12]\d|3[01])"
_YEAR = r"(1[7-9]\d{2}|2[01]\d{2}|22[0-5]\d)"
YEAR_FIRST_SHAPE = rf"^\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}([ T]{_CLOCK}{_ZONE})?$"
YEAR_FIRST_PARTS = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2}).*$"
YEAR_LAST_SHAPE = rf"^\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{4}}( {_CLOCK})?$"
YEAR_LAST_PARTS = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4}).*$"
COMPACT_SHAPE = r"^\d{8}$"
COMPACT_PARTS = r"^(\d{4})(\d{2})(\d{2})$"
OTHER_SHAPES = "|".join(
    (
        rf"^{_YEAR}$",
        rf"^{_YEAR}Q[1-4]$",
        rf"^{_YEAR}[-/](0?[1-9]|1[0-2])$",
        rf"^(0?[1-9]|1[0-2])/{_YEAR}$",
        r"^[1-9][ ,/;-](3[2-9]|[4-9]\d)$",
        rf"^{_MONTH} ({_DAY},? )?{_YEAR}$",
        rf"^{_DAY}[- ]{_MONTH}[- ]{_YEAR}$",
        rf"^{_CLOCK}$",
    )
)

# The shortest and longest texts that any shape can match, and all shapes in one pattern, which begins with the one place
# where any may begin, so that a text is not searched for others.
MIN_DATE_LENGTH, MAX_DATE_LENGTH = 4, 48
ANY_SHAPE = rf"^(?:{'|'.join((YEAR_FIRST_SHAPE, YEAR_LAST_SHAPE, COMPACT_SHAPE, OTHER_SHAPES))})"


def is_null_token(value: Column) -> Column:
    return value.isin(*NULL_TOKENS)


def null_tokens_to_null(value: Column) -> Column:
    """Exact match, no trimming."""
    return F.when(~is_null_token(value), value)


def strip(value: Column) -> Column:
    """Remove white space at both ends, tabs and line ends included."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def without_commas(value: Column) -> Column:
    return F.replace(value, F.lit(","), F.lit(""))


def is_numeric(value: Column) -> Column:
    """Is the text a number once commas are removed? ``1,50`` is (150), ``1d`` and blanks are not."""
    return without_commas(value).rlike(FLOAT_TEXT)


def to_number(value: Column) -> Column:
    """The number, or null. Texts meaning "not a number" give null as well."""
    digits = without_commas(value)
    number = F.trim(digits).try_cast("double")
    return F.when(digits.rlike(CASTABLE_TEXT) & ~F.isnan(number), number)


def _is_calendar_day(text: Column, parts: str, *orders: str) -> Column:
    """Do the parts make a real day in one of the orders, each given as a replacement ``y-m-d``?"""
    found = F.lit(False)
    for order in orders:
        year = F.year(F.regexp_replace(text, parts, order).try_cast("date"))
        found = found | F.coalesce(year.between(1678, 2261), F.lit(False))
    return found


def is_datetime(value: Column) -> Column:
    """Is the text a date or time in one of the closed list of shapes, spaces around it aside?"""
    return is_datetime_text(strip(value))


def is_datetime_text(text: Column) -> Column:
    """The same for a text without surrounding spaces.

    Length and one pattern for all shapes come first, so that only texts that look like a date are parsed.
    Month first is tried before day first.
    """
    return (
        F.when(~F.length(text).between(MIN_DATE_LENGTH, MAX_DATE_LENGTH), F.lit(False))
        .when(~text.rlike(ANY_SHAPE), F.lit(False))
        .when(text.rlike(YEAR_FIRST_SHAPE), _is_calendar_day(text, YEAR_FIRST_PARTS, "$1-$2-$3"))
        .when(text.rlike(YEAR_LAST_SHAPE), _is_calendar_day(text, YEAR_LAST_PARTS, "$3-$1-$2", "$3-$2-$1"))
        .when(text.rlike(COMPACT_SHAPE), _is_calendar_day(text, COMPACT_PARTS, "$1-$2-$3"))
        .otherwise(F.lit(True))
    )


def is_all_digits(value: Column) -> Column:
    return value.rlike(r"^\p{Nd}+$")


def is_alphanumeric(value: Column) -> Column:
    return value.rlike(r"^[\p{L}\p{N}]+$")


def is_comment_line(line: Column) -> Column:
    text = F.ltrim(line)
    found = F.lit(False)
    for prefix in COMMENT_PREFIXES:
        found = found | text.startswith(prefix)
    return found


def header_likeness(token: Column) -> Column:
    """How much a token looks like a column name, between 0 and 1."""
    return text_likeness(strip(token))


def text_likeness(text: Column, numeric: Column | None = None, date: Column | None = None) -> Column:
    """The same for a trimmed text, of which it may be known already whether it is a number and whether it is a date."""
    numeric = is_numeric(text) if numeric is None else numeric
    date = is_datetime_text(text) if date is None else date
    size = F.length(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    identifier = is_alphanumeric(F.translate(text, "_-", "")) & ~text.rlike(r"^\p{Nd}")
    score = (
        F.when(numeric, 0.0).otherwise(0.3)
        + F.when(date, 0.0).otherwise(0.2)
        + 0.25 * letters / F.greatest(size, F.lit(1))
        + F.when(identifier, 0.15).otherwise(0.0)
        + F.when(size.between(2, 30), 0.1).when(size > 50, -0.2).otherwise(0.0)
    )
    return F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
