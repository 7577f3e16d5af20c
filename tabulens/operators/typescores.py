"""Type scores of a group of values, from the group's aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulens.functions.scoring import ratio

# A group is categorical below this distinct ratio and mean length.
CATEGORICAL_RATIO = 0.2
CATEGORICAL_MEAN_LENGTH = 30


def is_categorical(n: Column, distinct: Column, mean_length: Column) -> Column:
    return F.coalesce(
        (ratio(distinct, n) < CATEGORICAL_RATIO) & (mean_length < CATEGORICAL_MEAN_LENGTH) & (n > 0), F.lit(False)
    )


def type_scores(n: Column, numeric: Column, datetime: Column, categorical: Column) -> Column:
    """Struct of four scores that add up to 1; all zero for an empty group.

    ``numeric`` and ``datetime`` are counts of values (a numeric value is never counted as a datetime),
    ``categorical`` is a flag.
    """
    raw = {
        "numeric": ratio(numeric, n),
        "datetime": ratio(datetime, n),
        "categorical": F.when(categorical, 1.0).otherwise(0.0),
    }
    raw["text"] = F.when(n > 0, 1.0 - F.greatest(*raw.values())).otherwise(F.lit(0.0))
    total = raw["numeric"] + raw["datetime"] + raw["categorical"] + raw["text"]
    return F.struct(*[ratio(score, total).alias(name) for name, score in raw.items()])


def dominant_score(n: Column, numeric: Column, datetime: Column, categorical: Column) -> Column:
    """The largest of the four scores, from shares that are plain references."""
    top = F.greatest(numeric, datetime, categorical)
    total = numeric + datetime + categorical + 1.0 - top
    return F.when(n > 0, F.greatest(top, 1.0 - top) / total).otherwise(F.lit(0.0))
