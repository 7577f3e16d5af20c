"""File heads: the first bytes of many files, decoded to lines, read by the executors.

Spark's own readers would read whole files; listing them and opening each for a few kilobytes does not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Sample size, byte order mark, encodings tried in turn.
SNIFF_BYTES = 65_536
UTF8_MARK = b"\xef\xbb\xbf"
ENCODINGS = ("ascii", "utf-8-sig", "utf-8", "gbk", "latin1")
FILES_PER_TASK = 256

HEAD_SCHEMA = "file_id string, encoding string, line_no long, line string"


def _open(path: str):
    from pyarrow import fs

    local = path.removeprefix("file:")
    if local.startswith("/"):
        return fs.LocalFileSystem().open_input_stream(re.sub("^/+", "/", local))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner)


def _without_cut_character(data: bytes) -> bytes:
    """Drop the beginning of a UTF-8 character that the sample cuts off."""
    for back in range(1, min(4, len(data)) + 1):
        byte = data[-back]
        if byte < 0x80:
            break
        if byte >= 0xC0:
            size = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
            return data[:-back] if back < size else data
    return data


def encoding_of(data: bytes, cut: bool = False) -> str:
    """The first of the known encodings that can decode the bytes."""
    if data.startswith(UTF8_MARK):
        return "utf-8-sig"
    sample = _without_cut_character(data) if cut else data
    for encoding in ENCODINGS:
        if encoding == "utf-8-sig":
            continue
        try:
            (data if encoding in ("gbk", "latin1") else sample).decode(encoding)
            return encoding
        except UnicodeDecodeError as problem:
            # A sample cut inside a two-byte character fails at its very last byte only.
            if cut and encoding == "gbk" and problem.start >= len(data) - 1:
                return encoding
    return "utf-8"


def _head_lines(sniff_bytes: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file_id, path, length in zip(batch["file_id"], batch["path"], batch["length"]):
                with _open(path) as stream:
                    data = stream.read(sniff_bytes)
                encoding = encoding_of(data, cut=length > sniff_bytes)
                lines = data.decode(encoding, errors="replace").replace("\r\n", "\n").replace("\r", "\n").split("\n")
                if lines and not lines[-1]:
                    lines.pop()
                yield pd.DataFrame(
                    {"file_id": file_id, "encoding": encoding, "line_no": range(len(lines)), "line": lines}
                ).astype({"line_no": "int64"})

    return read


def list_files(spark: SparkSession, *paths: str, pattern: str | None = None) -> DataFrame:
    """``file_id, path, length`` of every file; the content is never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(list(paths)).select(F.col("_metadata.file_path").alias("file_id"), "path", "length")


def read_heads(
    spark: SparkSession, *paths: str, pattern: str | None = None, sniff_bytes: int = SNIFF_BYTES,
    tasks: int | None = None,
) -> DataFrame:
    """``file_id, encoding, line_no, line`` of the first bytes of every file."""
    files = list_files(spark, *paths, pattern=pattern)
    if tasks is None:
        tasks = max(1, min(files.count() // FILES_PER_TASK + 1, 100_000))
    return files.repartition(tasks, "path").mapInPandas(_head_lines(sniff_bytes), HEAD_SCHEMA)


@F.pandas_udf(StringType())
def _encoding_udf(content: pd.Series) -> pd.Series:
    return content.map(lambda data: None if data is None else encoding_of(bytes(data)))


def detect_encoding(content: Column) -> Column:
    """Encoding of a binary column. Only bytes that are not valid UTF-8 are handed to Python."""
    text = content.cast("string")
    valid = F.is_valid_utf8(text)
    rest = _encoding_udf(F.when(~valid, content))
    return (
        F.when(F.substring(content, 1, 3) == F.lit(bytearray(UTF8_MARK)), "utf-8-sig")
        .when(valid & (F.octet_length(content) == F.length(text)), "ascii")
        .when(valid, "utf-8")
        .otherwise(rest)
    )


@F.pandas_udf(StringType())
def _decode_udf(content: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series(
        [None if c is None else bytes(c).decode(e, errors="replace") for c, e in zip(content, encoding)]
    )


def decode_line(raw: Column, encoding: Column) -> Column:
    """Text of a line's bytes; UTF-8 and Latin-1 stay in the JVM, other encodings go through Python."""
    in_jvm = encoding.isin("ascii", "utf-8", "utf-8-sig", "latin1")
    other = _decode_udf(F.when(~in_jvm, raw), encoding)
    return (
        F.when(encoding == "latin1", F.decode(raw, "ISO-8859-1"))
        .when(in_jvm, F.make_valid_utf8(raw.cast("string")))
        .otherwise(other)
    )
