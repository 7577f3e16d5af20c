"""Adaptive ingest from start to end: read, profile, coerce and mark, by chunk or as a whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions.predicates import to_number
from tabulens.functions.scoring import finite
from tabulens.operators import anomaly, histogram, iforest, profile
from tabulens.operators.tablefacts import quoted
from tabulens.sources.rows import CHUNK_ROWS, with_chunks


@dataclass(frozen=True)
class Ingested:
    """Scored rows and column profiles of one table of strings."""

    rows: DataFrame
    profiles: DataFrame
    methods: tuple[str, ...]


def ingest(
    df: DataFrame, scope: str = "chunk", chunk_rows: int = CHUNK_ROWS, forest: bool = False, row_idx: str = "_row_idx"
) -> Ingested:
    """Profile and score a table of strings with a row number.

    ``scope="chunk"`` treats every ``chunk_rows`` rows by themselves; ``"global"`` the table as a whole.
    ``forest`` adds an isolation forest, of the chunk or of the whole table, to the ensemble.
    """
    keys = (anomaly.CHUNK_KEY,) if scope == "chunk" else ()
    chunked = with_chunks(df, row_idx, chunk_rows)
    columns = histogram.data_columns(df, exclude=(row_idx,))
    hist = histogram.value_histogram(chunked, columns, keys, row_idx)
    profiles = profile.column_profile(hist, keys, source=chunked, columns=columns, order=row_idx)
    rows, name = chunked, None
    if forest:
        features = {c: finite(to_number(quoted(c))) for c, t in df.dtypes if t == "string" and not c.startswith("_")}
        if scope == "chunk":
            rows = iforest.chunk_isolation_scores(chunked, features, order=row_idx)
        else:
            rows = iforest.isolation_scores(chunked, features, F.col(row_idx))
        name = "_iforest_score"
    marked = anomaly.score_rows(
        rows, anomaly.scope_of(scope), columns=columns, iforest_score=name
    )
    return Ingested(marked, profiles, tuple(anomaly.methods_used(forest)))
