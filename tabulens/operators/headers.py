"""Header-row detection for many files in one job.

One grouped aggregate by ``file_id`` gathers the statistics and first lines of a file (at most ``max_scan +
look_ahead + 1``, whatever its size); scoring is then a projection, and ranking and selection reuse the same
partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.functions.fields import split_by
from tabulens.functions.predicates import (
    FLOAT_TEXT,
    is_datetime_text,
    is_null_token,
    strip,
    text_likeness,
    without_commas,
)
from tabulens.operators.blocks import block_figures
from tabulens.sources import formats

# Scan depth, look-ahead, weights of the candidate score, thresholds.
MAX_SCAN = 8
LOOK_AHEAD = 20
CONSISTENCY_WEIGHT = 0.30
TOKEN_WEIGHT = 0.40
UNIQUENESS_WEIGHT = 0.15
STABILITY_WEIGHT = 0.15
PENALTY_WEIGHT = 0.4
PENALTY_DATETIME_WEIGHT = 0.8
SCORE_GAP = 0.40
HIGH, MEDIUM, LOW = 0.75, 0.50, 0.30
TINY = 1e-9


def _judged(files: DataFrame, kind: str, fields: Column, asked: Column) -> DataFrame:
    """Of all fields of a file, one after the other: trimmed texts, whether they are missing, numbers or dates, the numbers.

    Of a number it is asked in the first ``asked`` fields alone whether it is a date. Each answer is an array of its own:
    a function over an array copies what it gives, and structs of answers would be copied at each step.
    """
    texts, digits, numeric = (f"{kind}_{c}" for c in ("text", "digits", "numeric"))

    def date(both: Column, at: Column) -> Column:
        return F.when((at < asked) | ~both[numeric], is_datetime_text(both[texts]))

    def number(both: Column) -> Column:
        # Numbers with separated digits cannot be cast.
        return F.when(both[numeric] & ~F.contains(both[digits], F.lit("_")), both[digits].try_cast("double"))

    return (
        files.withColumn(f"{kind}_text", F.transform(fields, strip))
        .withColumn(f"{kind}_missing", F.transform(fields, is_null_token))
        .withColumn(f"{kind}_digits", F.transform(fields, lambda f: F.trim(without_commas(f))))
        .withColumn(f"{kind}_numeric", F.transform(digits, lambda d: d.rlike(FLOAT_TEXT)))
        .withColumn(f"{kind}_date", F.transform(F.arrays_zip(texts, numeric), date))
        .withColumn(f"{kind}_number", F.transform(F.arrays_zip(digits, numeric), number))
    )


def _dealt(files: DataFrame) -> DataFrame:
    """The files in twice as many tasks as a shuffle has partitions.

    Judging costs far more than its few bytes tell: cut by bytes, files come to hardly more tasks than there are cores,
    and most cores wait for the last few. With another number than a shuffle has, Spark keeps the exchange; what is
    grouped by file later on finds the files together.
    """
    return files.repartition(2 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_id")


def _with_figures(files: DataFrame, mode: str, max_scan: int, look_ahead: int) -> DataFrame:
    """Split a line once and judge every field once, however many candidate blocks it falls into; then count."""
    delimiter, size = F.col("delimiter"), lambda fields: F.size(fields)
    files = files.withColumn("fields", F.transform("entries", lambda e: split_by(e.getField("line"), delimiter)))
    files = files.withColumn("cell_widths", F.transform("fields", size)).withColumn("fields", F.flatten("fields"))
    if mode == "robust":
        # The tokens of candidates are the first cells.
        first = F.aggregate(F.slice("cell_widths", 1, max_scan + 1), F.lit(0), lambda acc, x: acc + x)
        files = _judged(files.withColumn("asked", first), "cell", F.col("fields"), F.col("asked"))
        kind, tokens = "cell", F.slice("cell_text", 1, F.col("asked"))
    else:
        plain = F.transform(F.slice("entries", 1, max_scan + 1), lambda e: split_by(e.getField("line"), delimiter, quotes=False))
        files = _judged(files, "cell", F.col("fields"), F.lit(0)).withColumn("plain", plain)
        files = files.withColumn("token_widths", F.transform("plain", size)).withColumn("plain", F.flatten("plain"))
        files = _judged(files, "token", F.col("plain"), F.size("plain"))
        kind, tokens = "token", F.col("token_text")
    likeness = F.transform(
        tokens, lambda text, at: text_likeness(text, F.get(F.col(f"{kind}_numeric"), at), F.get(F.col(f"{kind}_date"), at))
    )
    judged = [*(f"cell_{c}" for c in ("widths", "text", "missing", "numeric", "date", "number")), *(f"{kind}_{c}" for c in ("widths", "text", "numeric", "date"))]
    counted = block_figures(max_scan, look_ahead, mode == "robust")
    files = files.withColumn("likeness", likeness).withColumn("figures", counted(*judged, "likeness"))
    return files.drop("fields", "plain", "asked", "likeness", *judged, *(f"{k}_{c}" for k in ("cell", "token") for c in ("missing", "digits", "number")))


def _blocks(
    head: DataFrame, mode: str, max_scan: int, look_ahead: int, drop_comments: bool
) -> DataFrame:
    """One row per candidate with the figures of its tokens and of the columns of the rows that follow it.

    Columns are named by the candidate line. Extra leading fields of the first data row are an index; a
    later row wider than that cannot be parsed. ``robust`` leaves such rows out as long as they are fewer than
    half; ``compat`` gives the candidate up.
    """
    files = _dealt(formats.file_heads(head, mode, max_scan + look_ahead + 1))
    candidates = _with_figures(files, mode, max_scan, look_ahead).select(
        "file_id",
        "delimiter",
        "delimiter_score",
        F.get("entries", F.lit(0)).getField("comment").alias("first_is_comment"),
        F.forall("entries", lambda e: e.getField("comment")).alias("all_comments"),
        "figures",
        # Not the figures: Spark would ask for them once more, to leave out files without any.
        F.posexplode(F.slice("entries", 1, max_scan + 1)).alias("at", "candidate"),
    )
    candidates = candidates.withColumn("figures", F.get("figures", F.col("at"))).drop("at")
    if drop_comments:
        candidates = candidates.where(~F.col("candidate.comment") | F.col("all_comments"))
    return candidates.drop("all_comments")


def _parts(figures: Column) -> dict[str, Column]:
    """The parts of a candidate's score."""
    count = figures["tokens"]
    return {
        "consistency_score": figures["dominant"],
        "token_score": figures["likeness"],
        "uniqueness_score": figures["distinct"] / (count + TINY),
        "stability": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - figures["spread"])),
        "data_row_penalty": PENALTY_WEIGHT
        * (figures["numeric"] / count + PENALTY_DATETIME_WEIGHT * (figures["datetime"] / count)),
    }


def _score(parsed: Column, parts: dict[str, Column]) -> Column:
    score = (
        CONSISTENCY_WEIGHT * parts["consistency_score"]
        + TOKEN_WEIGHT * parts["token_score"]
        + UNIQUENESS_WEIGHT * parts["uniqueness_score"]
        + STABILITY_WEIGHT * parts["stability"]
        - parts["data_row_penalty"]
    )
    return F.when(parsed, F.greatest(F.lit(0.0), score)).otherwise(0.0)


def score_candidates(
    head: DataFrame, mode: str = "robust", max_scan: int = MAX_SCAN, look_ahead: int = LOOK_AHEAD
) -> DataFrame:
    """Explainable score of every candidate header row.

    ``row, line_no, line, token_count, consistency_score, token_score, uniqueness_score, stability,
    data_row_penalty, score, reason`` with reason ``parse_failed`` or ``scored``, and what the selection
    needs per file: ``delimiter, delimiter_score, first_is_comment`` and the candidate's ``fields`` and ``index_width``.
    """
    parts = _parts(F.col("figures"))
    return (
        _blocks(head, mode, max_scan, look_ahead, drop_comments=mode == "robust")
        .select(
            "file_id",
            "delimiter",
            "delimiter_score",
            "first_is_comment",
            "figures.parsed",
            "candidate.row",
            "candidate.line_no",
            "candidate.line",
            split_by(F.col("candidate.line"), F.col("delimiter")).alias("fields"),
            F.col("figures.shift").alias("index_width"),
            F.col("figures.tokens").alias("token_count"),
            *[F.when(F.col("figures.parsed"), part).alias(name) for name, part in parts.items()],
        )
        .withColumn("score", _score(F.col("parsed"), {name: F.col(name) for name in parts}))
        .withColumn("reason", F.when(F.col("parsed"), "scored").otherwise("parse_failed"))
        .drop("parsed")
    )


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Add ``rank`` from 1, best score first, upper row first among equals."""
    best_first = Window.partitionBy("file_id").orderBy(F.desc("score"), F.asc("row"))
    return candidates.withColumn("rank", F.row_number().over(best_first))


def select_header(ranked: DataFrame, score_gap: float = SCORE_GAP) -> DataFrame:
    """Pick one header row per file, with a preference for the first row.

    ``file_id, header_row, header_line_no, score, first_row_score, selection_reason``, the file's
    ``delimiter`` and ``delimiter_score``, the ``fields`` of the header and the three best candidates.
    """
    best, first = F.col("rank") == 1, F.col("row") == 0
    choice = F.struct("row", "line_no", "score", "fields", "index_width")
    top = F.struct(
        "rank", "row", F.round("score", 4).alias("score"), F.substring("line", 1, 80).alias("preview")
    )
    picked = ranked.groupBy("file_id").agg(
        F.max(F.when(best, choice)).alias("best"),
        F.max(F.when(first, choice)).alias("first"),
        F.max("first_is_comment").alias("first_is_comment"),
        F.max("delimiter").alias("delimiter"),
        F.max("delimiter_score").alias("delimiter_score"),
        F.sort_array(F.collect_list(F.when(F.col("rank") <= 3, top))).alias("top"),
    )
    return _selected(picked.withColumn("top", F.transform("top", lambda c: c.dropFields("rank"))), score_gap)


def _selected(picked: DataFrame, score_gap: float = SCORE_GAP) -> DataFrame:
    """The choice between the ``best`` and the ``first`` candidate of a file."""
    # A nudge far below the printed precision keeps exact halves from depending on float noise.
    gap = F.col("best.score") - F.col("first.score")
    gap_text = F.round(gap + TINY, 3).cast("decimal(10,3)").cast("string")
    reason = (
        F.when(F.col("first_is_comment"), "first_row_is_comment")
        .when(F.col("first").isNull(), "first_row_not_in_candidates")
        .when(F.col("best.row") == 0, "first_row_is_best")
        .when(gap < score_gap, F.concat(F.lit("small_gap_"), gap_text))
        .otherwise(F.concat(F.lit("first_row_rejected_gap_"), gap_text))
    )
    keep_first = F.col("selection_reason").rlike("^(first_row_is_best|small_gap_)")
    return (
        picked.withColumn("selection_reason", reason)
        .withColumn("chosen", F.when(keep_first, F.col("first")).otherwise(F.col("best")))
        .select(
            "file_id",
            F.col("chosen.row").alias("header_row"),
            F.col("chosen.line_no").alias("header_line_no"),
            F.col("chosen.score").alias("score"),
            F.coalesce(F.col("first.score"), F.lit(0.0)).alias("first_row_score"),
            "selection_reason",
            "delimiter",
            "delimiter_score",
            F.col("chosen.fields").alias("fields"),
            F.col("chosen.index_width").alias("index_width"),
            F.col("top").alias("candidate_summary"),
        )
    )


def confidence(score: Column, high: float = HIGH, medium: float = MEDIUM, low: float = LOW) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").when(score >= low, "LOW").otherwise("UNCERTAIN")


def review_flag(confidence_level: Column) -> Column:
    return confidence_level.isin("UNCERTAIN", "LOW")


def review_reason(confidence_level: Column, selection_reason: Column) -> Column:
    return (
        F.when(confidence_level == "UNCERTAIN", "confidence_too_low")
        .when(confidence_level == "LOW", "low_confidence_suggest_review")
        .when(F.contains(selection_reason, F.lit("rejected")), "first_row_rejected_but_confident")
        .otherwise("confident")
    )


def detection_result(selected: DataFrame) -> DataFrame:
    """The full answer per file, with the three best candidates as an ordered array."""
    level = confidence(F.col("score"))
    return selected.select(
        "file_id",
        "header_row",
        "header_line_no",
        level.alias("confidence"),
        F.round("score", 4).alias("confidence_score"),
        review_flag(level).alias("needs_review"),
        review_reason(level, F.col("selection_reason")).alias("review_reason"),
        "selection_reason",
        F.round("first_row_score", 4).alias("first_row_score"),
        "candidate_summary",
        "delimiter",
        "delimiter_score",
        "fields",
        "index_width",
    )


def detect_headers(
    head: DataFrame, mode: str = "robust", max_scan: int = MAX_SCAN, look_ahead: int = LOOK_AHEAD
) -> DataFrame:
    """Format and header of every file: one grouped aggregate by file, then narrow steps on its result.

    The same as scoring, ranking and selecting candidates one after the other, with a file's few candidates as an array.
    """
    files = _dealt(formats.file_heads(head, mode, max_scan + look_ahead + 1))
    scanned, comment = F.slice("entries", 1, max_scan + 1), lambda e: e.getField("comment")
    allowed = lambda c: F.lit(True)
    if mode == "robust":
        # Comments are no candidates, unless there is nothing else.
        files = files.withColumn("comments", F.forall("entries", comment))
        files = files.where(F.col("comments") | F.exists(scanned, lambda e: ~comment(e)))
        allowed = lambda c: ~c.getField("comment") | F.col("comments")

    def candidate(entry: Column, figures: Column) -> Column:
        score = _score(figures["parsed"], _parts(figures))
        return F.struct(
            (-score).alias("order"), *[entry[c].alias(c) for c in ("row", "line_no", "line", "comment")], figures["shift"].alias("index_width")
        )

    def choice(c: Column) -> Column:
        fields = split_by(c["line"], F.col("delimiter")).alias("fields")
        return F.when(c.isNotNull(), F.struct(c["row"].alias("row"), c["line_no"].alias("line_no"), (-c["order"]).alias("score"), fields, c["index_width"].alias("index_width")))

    def top(c: Column) -> Column:
        return F.struct(c["row"].alias("row"), F.round(-c["order"], 4).alias("score"), F.substring(c["line"], 1, 80).alias("preview"))

    picked = (
        _with_figures(files, mode, max_scan, look_ahead)
        .withColumn("candidates", F.zip_with(scanned, "figures", candidate))
        # Best score first, upper row first among equals.
        .withColumn("ranked", F.sort_array(F.filter("candidates", allowed)))
        .withColumn("best", F.get("ranked", F.lit(0)))
        .withColumn("first", F.get(F.filter("ranked", lambda c: c.getField("row") == 0), F.lit(0)))
        .select(
            "file_id",
            choice(F.col("best")).alias("best"),
            choice(F.col("first")).alias("first"),
            comment(F.get("entries", F.lit(0))).alias("first_is_comment"),
            "delimiter",
            "delimiter_score",
            F.transform(F.slice("ranked", 1, 3), top).alias("top"),
        )
    )
    return detection_result(_selected(picked))


def header_by_consistency(head: DataFrame, max_scan: int = MAX_SCAN, look_ahead: int = LOOK_AHEAD) -> DataFrame:
    """Alternative detection: the row below which columns are most uniform in type.

    ``file_id, header_row, score``; row 0 with score -1 where no candidate has more than one column.
    """
    blocks = _blocks(head, "compat", max_scan, look_ahead, drop_comments=False)
    figures = lambda name: F.col(f"figures.{name}")
    score = figures("filled_dominant") - 0.3 * (figures("first_numeric") / figures("width"))
    usable = figures("parsed") & (figures("width") > 1) & (figures("filled") > 0)
    return (
        blocks.withColumn("score", F.when(usable, score))
        .groupBy("file_id")
        .agg(F.max(F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("candidate.row")).alias("up")))).alias("best"))
        .select(
            "file_id",
            F.coalesce(-F.col("best.up"), F.lit(0)).alias("header_row"),
            F.coalesce(F.col("best.score"), F.lit(-1.0)).alias("score"),
        )
    )
