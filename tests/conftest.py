import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from workload.session import local_session  # noqa: E402

SAMPLE = """id,timestamp,amount,category,description
1,2025-01-01 10:00:00,123.45,A,normal entry
2,2025-01-01 10:05:00,130.00,A,normal entry
3,2025-01-01 10:10:00,99999999,A,outlier amount
4,not a date,200.00,B,weird timestamp
5,2025-01-01 10:20:00,150.00,A,normal entry
6,,,,
7,2025-01-01 10:30:00,160.00,C,normal entry
"""


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def lines_of(spark, texts: dict[str, str]):
    """Literal texts as the ``lines`` contract: one file per key."""
    rows = [(name, i, line) for name, text in texts.items() for i, line in enumerate(text.splitlines())]
    return spark.createDataFrame(rows, "file_id string, line_no long, line string")


@pytest.fixture(scope="session")
def sample_lines(spark):
    return lines_of(spark, {"sample_mixed.csv": SAMPLE})


@pytest.fixture(scope="session")
def sample(spark, sample_lines):
    """The sample as the adaptive scan reads it: all strings, missing cells null."""
    from pyspark.sql import functions as F

    from tabulens.sources import delimited, formats

    decisions = delimited.decide(formats.head_lines(sample_lines))
    scanned = delimited.scan_rows(sample_lines, decisions)
    table = delimited.as_table(scanned, decisions.first().names)
    table = table.withColumn("_row_idx", F.col("line_no") - 1).drop("file_id", "line_no")
    return spark.createDataFrame(table.collect(), table.schema)
