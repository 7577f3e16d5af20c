"""Mixing sources to target weights by subset sums.

Every source gets a target of words. Whole passes over a source come first; what is left of its budget is fitted by a
choice of documents, made on counts alone: how many documents of each exact length to take. A proportional share of
every length is taken, single documents are added while the budget is wide, and a bounded knapsack fits the rest to
the word. Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import quoted, table, whole, words_of, written

WEIGHTS = (3, 1, 2)
VOLUME, MOST_REPEATS, SEED = 1.5, 2, 17
#: Budgets up to this many words are fitted by dynamic programming; its table takes at most so many bits a length.
KNAPSACK = 65_536


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, volume: float = VOLUME, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) with ``target``: weights go round by code point, null last; no target exceeds ``most`` sizes.

    Giving the excess of full sources to the others by weight, until none is above, ends at one level: every target is
    the lesser of its limit and its weight times the level. Sources that fill up first stand first by limit over weight,
    so the level is known from running sums. One row per source; a window over them all.
    """
    # Partial sums of exact integers, then one division: the same in every run.
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("fills", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    limit = F.col("source_size") * most
    ranked = sources.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), place)).withColumn("fills", limit / F.col("weight"))
    open_budget = F.sum("source_size").over(everything) * volume - F.coalesce(F.sum(limit).over(before), F.lit(0))
    open_weight = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("level", open_budget / open_weight)
    # The first source that does not fill at its level sets the level of all after it.
    level = F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "source", "level"))).over(everything)["level"]
    target = F.least(limit.cast("double"), F.col("weight") * F.coalesce(level, F.lit(math.inf)))
    return levels.select("source", "source_size", target.alias("target"))


def fit_counts(lengths: Sequence[int], counts: Sequence[int], budget: int, knapsack: int = KNAPSACK) -> list[int]:
    """How many documents of each length to take so that their words come as near to ``budget`` as they can, not above.

    ``lengths`` are distinct and positive. The last ``knapsack`` words are fitted exactly over what is left of each
    length; before, lengths are taken in proportion and then one by one, largest remainder first.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    share = budget / total if total else 0.0
    taken = [min(c, int(share * c)) for c in counts]
    rest = budget - sum(n * k for n, k in zip(lengths, taken))
    for i in sorted(range(len(lengths)), key=lambda i: (taken[i] - share * counts[i], -lengths[i])):
        if taken[i] < counts[i] and rest - lengths[i] >= knapsack // 2:
            taken[i] += 1
            rest -= lengths[i]
    # Where the remainders did not narrow the budget enough, whole lengths do.
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        more = min(counts[i] - taken[i], max(0, rest - knapsack // 2) // lengths[i])
        taken[i] += more
        rest -= more * lengths[i]
    # Bounded knapsack: bit s of ``sums`` says that s words can be made; counts go as powers of two.
    mask = (1 << (rest + 1)) - 1
    sums, steps = 1, []
    for i in sorted((i for i in range(len(lengths)) if lengths[i] <= rest), key=lambda i: -lengths[i]):
        left, part = min(counts[i] - taken[i], rest // lengths[i]), 1
        while left and not sums >> rest & 1:
            part = min(part, left)
            steps.append((i, part, sums))
            sums |= sums << (part * lengths[i]) & mask
            left, part = left - part, part * 2
    made = sums.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> made & 1:
            taken[i] += part
            made -= part * lengths[i]
    return taken


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    """The lengths of one source: whole passes and, of each length, how many documents more."""
    rows = rows.sort_values("size", ignore_index=True)
    size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    passes = math.floor(target / size) if size else 0
    words = rows["size"] > 0
    more = fit_counts(rows.loc[words, "size"].tolist(), rows.loc[words, "n"].tolist(), round(target - passes * size))
    rows["passes"], rows["more"] = passes, 0
    rows.loc[words, "more"] = more
    return rows[["source", "size", "n", "target", "source_size", "passes", "more"]]


def _cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with ``cut``, the largest luck that is taken, for lengths of which some documents are taken.

    A length may hold a third of all documents, so its cut is found in two steps: its documents fall into as many slices
    of the luck as a slice has documents; counts tell the slice of the cut, and only that one is put in order.
    """
    named = plan.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "n", "more").where("more > 0 and more < n")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    slices = F.ceil(F.sqrt("n"))
    place = F.least(F.floor((F.col("luck").cast("double") / 2.0**64 + 0.5) * slices), slices - 1)
    dealt = rows.join(named, same).select("source", "size", "luck", "more", place.alias("slice"))
    counts = dealt.groupBy("source", "size", "slice", "more").agg(F.count(F.lit(1)).alias("here"))
    so_far = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    left = counts.withColumn("left", F.col("more") - F.coalesce(F.sum("here").over(so_far), F.lit(0))).where("left > 0 and left <= here")
    left = left.select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("slice").alias("_slice"), "left")
    order = Window.partitionBy("source", "size").orderBy("luck")
    nth = dealt.join(left, same & (F.col("slice") == F.col("_slice"))).withColumn("nth", F.row_number().over(order))
    cut = nth.where(F.col("nth") == F.col("left")).select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("luck").alias("cut"))
    return plan.join(cut, same, "left").drop("_source", "_size")


def mix(
    docs: DataFrame, size: Column, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS,
    volume: float = VOLUME, most: int = MOST_REPEATS, seed: int = SEED,
) -> DataFrame:
    """The rows with a column ``mix`` (in place of one of that name): size, source_size, target, and times, how often the
    mix takes the row.

    Null sources are a source of their own, last in order. A source without words has target 0, its documents and any
    other without words are taken in whole passes only. Rows of equal key and text are taken alike. No rows give no rows.
    A task holds the distinct lengths of one source, whose number is bounded by the longest document, never its documents.
    """
    luck = F.xxhash64(F.lit(seed), F.col(quoted(key)), F.col(quoted(text)))
    rows = written(docs.select(F.col(quoted(source)).alias("source"), size.cast("long").alias("size"), luck.alias("luck")), "sizes")
    lengths = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sources, weights, volume, most).withColumnRenamed("source", "_source")
    fitted = written(
        lengths.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .groupBy("source").applyInPandas(_fit_source, "source string, size long, n long, target double, source_size long, passes int, more long"),
        "fitted",
    )
    plan = written(_cuts(rows, fitted), "plan")
    plan = plan.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "n", "target", "source_size", "passes", "more", "cut")
    names = [c for c in docs.columns if c != "mix"]
    measured = docs.select(
        F.struct(*[F.col(quoted(c)) for c in names]).alias("row"), F.col(quoted(source)).alias("source"), size.cast("long").alias("size"), luck.alias("luck")
    )
    met = measured.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    once_more = F.when(F.col("more") >= F.col("n"), True).when(F.col("more") == 0, False).otherwise(F.col("luck") <= F.col("cut"))
    mixed = F.struct("size", "source_size", "target", (F.col("passes") + once_more.cast("int")).alias("times"))
    return met.select(*[F.col("row")[c].alias(c) for c in names], mixed.alias("mix"))


def text_words(text: Column) -> Column:
    return F.size(words_of(whole(text))).cast("long")


def op4_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(docs, text_words(F.col("text")))
    taken = (F.col("mix.times") * F.col("mix.size")).cast("long")
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", taken.alias("taken"), "source")
