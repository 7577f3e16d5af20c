"""Isolation forest (Liu, Ting and Zhou 2008) with trees built in parallel and scoring in Arrow batches.

A tree sees at most ``subsample`` rows, so the model is bounded by ``trees * 2 * subsample`` nodes whatever the
table's size. The model is collected and shipped with the scoring function; the table is scored where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tabulens.operators.quantiles import exact_medians

# Ensemble size, rows per tree, seed, fewest rows worth a forest, Euler's constant.
TREES = 100
SUBSAMPLE = 256
SEED = 42
MIN_ROWS = 5
EULER = 0.5772156649

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, length double"


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, int, float, int, int, float]]:
    """Nodes ``(node, feature, threshold, left, right, length)``; a leaf has feature -1."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[tuple[int, int, float, int, int, float]] = []
    pending = [(0, np.arange(len(x)), 0)]
    used = 1
    while pending:
        node, members, depth = pending.pop()
        part = x[members]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(members) > 1 else np.empty(0, int)
        if depth >= limit or not len(spread):
            nodes.append((node, -1, 0.0, -1, -1, depth + mean_path(len(members))))
            continue
        feature = int(rng.choice(spread))
        low, high = part[:, feature].min(), part[:, feature].max()
        threshold = float(rng.uniform(low, high))
        to_left = part[:, feature] <= threshold
        if to_left.all():  # rounding put the threshold on the maximum
            threshold = float(low)
            to_left = part[:, feature] <= threshold
        left, right = used, used + 1
        used += 2
        nodes.append((node, feature, threshold, left, right, 0.0))
        pending += [(left, members[to_left], depth + 1), (right, members[~to_left], depth + 1)]
    return nodes


class Streams:
    """What many generators give to ``choice`` and ``uniform`` in turn, drawn for all of them at once.

    The numbers are those of numpy's own calls, one generator at a time: a double takes a word of 64 bits, a choice among
    several half a word, of which the other half is kept for the next choice; a choice of one takes nothing.
    """

    def __init__(self, generators: list[np.random.Generator], words: int):
        states = [g.bit_generator.state for g in generators]
        self.kept = np.array([s["uinteger"] for s in states], np.uint64)
        self.has_kept = np.array([s["has_uint32"] for s in states], bool)
        self.words = np.array([g.bit_generator.random_raw(words) for g in generators])
        self.at = np.zeros(len(generators), np.intp)

    @classmethod
    def joined(cls, parts: list[Streams]) -> Streams:
        """Streams of their own that go on where the given ones are."""
        self = cls.__new__(cls)
        longest = max(p.words.shape[1] for p in parts)
        self.words = np.concatenate([np.pad(p.words, ((0, 0), (0, longest - p.words.shape[1]))) for p in parts])
        self.kept, self.has_kept, self.at = (np.concatenate([getattr(p, c) for p in parts]) for c in ("kept", "has_kept", "at"))
        return self

    def _word(self, who: np.ndarray) -> np.ndarray:
        words = self.words[who, self.at[who]]
        self.at[who] += 1
        return words

    def below(self, who: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A number from 0 to ``n - 1`` of each generator in ``who``."""
        out, pending = np.zeros(len(who), np.intp), np.flatnonzero(n > 1)
        while len(pending):
            asked = who[pending]
            half, fresh = self.kept[asked], ~self.has_kept[asked]
            words = self._word(asked[fresh])
            half[fresh] = words & np.uint64(0xFFFFFFFF)
            self.kept[asked[fresh]] = words >> np.uint64(32)
            self.has_kept[asked] = fresh
            several = n[pending].astype(np.uint64)
            product = half * several
            out[pending] = product >> np.uint64(32)
            pending = pending[(product & np.uint64(0xFFFFFFFF)) < np.uint64(1 << 32) % several]
        return out

    def double(self, who: np.ndarray) -> np.ndarray:
        return (self._word(who) >> np.uint64(11)) * 2.0**-53


@lru_cache(maxsize=8)
def _drawn(n: int, trees: int, psi: int, seed: int) -> tuple[np.ndarray, Streams]:
    """The rows that every tree takes of ``n``, and the generators after that; alike for all chunks of ``n`` rows."""
    generators = [np.random.default_rng([seed, tree]) for tree in range(trees)]
    picked = np.array([g.choice(n, psi, replace=False) for g in generators], np.intp)
    return picked, Streams(generators, 2 * psi)  # fewer than ``psi`` splits, each of at most a word and a half


class Forest:
    """All trees as perfect binary trees of equal depth, for scoring whole batches without branches.

    The children of slot ``i`` are ``2i + 1`` and ``2i + 2``. A leaf above the bottom sends everything to its left
    child, so every row takes the same number of steps and ends in a bottom slot that holds its path length.
    """

    def __init__(self, nodes: pd.DataFrame, subsample: int):
        """From the nodes that ``grow_tree`` gives, with their ``tree``."""
        trees = sorted(nodes["tree"].unique())
        self.__dict__.update(vars(self._empty(len(trees), subsample)))
        parts = dict(list(nodes.groupby("tree")))
        for t, tree in enumerate(trees):
            part = parts[tree].sort_values("node")  # nodes are numbered 0, 1, ... within a tree
            feature, threshold, left, right, length = (
                part[c].tolist() for c in ("feature", "threshold", "left", "right", "length")
            )
            pending = [(0, 0, 0)]
            while pending:
                node, slot, depth = pending.pop()
                if feature[node] < 0:
                    slot = (slot + 1) * 2 ** (self.depth - depth) - 1
                    self.length[t, slot - self.bottom] = length[node]
                else:
                    self.feature[t, slot] = feature[node]
                    self.threshold[t, slot] = threshold[node]
                    pending.append((left[node], 2 * slot + 1, depth + 1))
                    pending.append((right[node], 2 * slot + 2, depth + 1))

    @classmethod
    def _empty(cls, trees: int, subsample: int) -> Forest:
        self = cls.__new__(cls)
        self.depth = int(np.ceil(np.log2(max(subsample, 2))))
        slots, self.bottom = 2 ** (self.depth + 1) - 1, 2**self.depth - 1
        self.feature = np.zeros((trees, slots), np.intp)
        self.threshold = np.full((trees, slots), np.inf)
        self.length = np.zeros((trees, slots - self.bottom))
        self.scale = max(mean_path(subsample), 1e-12)
        return self

    @classmethod
    def grown(cls, tables: list[np.ndarray], trees: int, subsample: int, seed: int) -> list[Forest]:
        """For each table of numbers the forest of ``grow_tree`` with each tree's generator and rows.

        The trees of all tables grow together, a split of each at a time. A tree's next split is that of the node put last
        on its stack, as there. A node is a stretch of its tree's rows, which are parted in place; bounds tell the leaves.
        """
        psi = [min(subsample, len(x)) for x in tables]
        drawn = [_drawn(len(x), trees, n, seed) for x, n in zip(tables, psi)]
        forests = [cls._empty(trees, n) for n in psi]
        begin = np.cumsum([0, *map(len, tables)])[:-1]
        members = np.concatenate([(picked + at).ravel() for (picked, _), at in zip(drawn, begin)])
        streams, columns = Streams.joined([s for _, s in drawn]), np.concatenate(tables).T.copy()
        flat, total, paths = columns.ravel(), columns.shape[1], np.array([mean_path(n) for n in range(subsample + 1)])
        # Of every tree: its forest's depth, and where its slots begin when forests lie one after the other.
        limit = np.repeat([f.depth for f in forests], trees)
        slots = np.repeat([f.feature.shape[1] for f in forests], trees)
        bottom = slots // 2
        slot_at, length_at = np.cumsum(slots) - slots, np.cumsum(bottom + 1) - (bottom + 1)
        features, thresholds = np.zeros(slots.sum(), np.intp), np.full(slots.sum(), np.inf)
        lengths = np.zeros((bottom + 1).sum())
        # Of every tree's open nodes: first row, number of rows, slot, depth, bounds of the features.
        deepest, height = limit.max() + 2, np.zeros(len(limit), np.intp)
        stack = np.zeros((len(limit) * deepest, 4), np.intp)
        bounds = np.zeros((len(limit) * deepest, 2, len(columns)))

        def add(tree: np.ndarray, node: np.ndarray, bound: np.ndarray) -> None:
            """Leaves get their length, other nodes the next place on their tree's stack."""
            inner = (node[:, 3] < limit[tree]) & (bound[:, 1] > bound[:, 0]).any(axis=1)
            leaf = ~inner
            of, (_, size, slot, depth) = tree[leaf], node[leaf].T
            lengths[length_at[of] + (slot + 1) * (1 << (limit[of] - depth)) - 1 - bottom[of]] = depth + paths[size]
            tree = tree[inner]
            at = tree * deepest + height[tree]
            stack[at], bounds[at] = node[inner], bound[inner]
            height[tree] += 1

        size = np.repeat(psi, trees)
        first = np.cumsum(size) - size
        values = columns[:, members]
        add(np.arange(len(limit)), np.stack([first, size, 0 * size, 0 * size], axis=1), np.stack([f.reduceat(values, first, axis=1).T for f in (np.minimum, np.maximum)], axis=1))
        while len(tree := np.flatnonzero(height)):
            height[tree] -= 1
            at = tree * deepest + height[tree]
            (first, size, slot, depth), bound = stack[at].T, bounds[at]
            varies = bound[:, 1] > bound[:, 0]
            nth = streams.below(tree, varies.sum(axis=1))
            feature = (np.cumsum(varies, axis=1) > nth[:, None]).argmax(axis=1)
            low, high = bound[np.arange(len(tree)), :, feature].T
            width = high - low
            if not np.isfinite(width).all():
                raise OverflowError("the range of a feature exceeds that of doubles")
            threshold = low + width * streams.double(tree)
            threshold = np.where(threshold >= high, low, threshold)  # rounding put it on the maximum
            features[slot_at[tree] + slot], thresholds[slot_at[tree] + slot] = feature, threshold
            start = np.cumsum(size) - size
            place = np.arange(start[-1] + size[-1]) + np.repeat(first - start, size)
            rows = members[place]
            to_left = flat[np.repeat(feature * total, size) + rows] <= np.repeat(threshold, size)
            # Left rows go to the front of their stretch, each as far as there are left rows before it; right rows behind.
            count = np.cumsum(to_left)
            before = np.concatenate([[0], count])[start]
            left = count[start + size - 1] - before
            ahead = count - np.repeat(before, size)
            inside = np.arange(len(rows)) - np.repeat(start, size)
            target = np.where(to_left, ahead - 1, inside - ahead + np.repeat(left, size)) + np.repeat(start, size)
            parted = np.empty_like(rows)
            parted[target] = rows
            members[place] = parted
            # Of each split the left child, then the right one, which is put on top.
            cuts = np.stack([start, start + left], axis=1).ravel()
            values = columns[:, parted]
            bound = np.stack([f.reduceat(values, cuts, axis=1).T for f in (np.minimum, np.maximum)], axis=1)
            add(tree, np.stack([first, left, 2 * slot + 1, depth + 1], axis=1), bound[::2])
            add(tree, np.stack([first + left, size - left, 2 * slot + 2, depth + 1], axis=1), bound[1::2])
        for forest, at in zip(forests, range(0, len(limit), trees)):
            forest.feature[:] = features[slot_at[at]:][: forest.feature.size].reshape(trees, -1)
            forest.threshold[:] = thresholds[slot_at[at]:][: forest.feature.size].reshape(trees, -1)
            forest.length[:] = lengths[length_at[at]:][: forest.length.size].reshape(trees, -1)
        return forests

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected path length), higher is more anomalous."""
        n = len(x)
        flat, rows = np.ascontiguousarray(x.T).ravel(), np.arange(n)
        total = np.zeros(n)
        for feature, threshold, length in zip(self.feature * n, self.threshold, self.length):
            at = np.zeros(n, np.intp)
            for _ in range(self.depth):
                go_right = flat.take(feature.take(at) + rows) > threshold.take(at)
                at = 2 * at + 1 + go_right
            total += length.take(at - self.bottom)
        return np.power(2.0, -total / len(self.feature) / self.scale)


def _joins(trees: int, share: float) -> list[float]:
    """The chance that a row joins so many trees or fewer, for 0, 1, ... of ``trees`` that each take it with ``share``."""
    if share >= 1:
        return [0.0] * trees
    chances = [(1 - share) ** trees]
    for k in range(1, trees):
        chances.append(chances[-1] * share / (1 - share) * (trees - k + 1) / k)
    return np.minimum(np.cumsum(chances), 1.0).tolist()


def _sample(df: DataFrame, key: Column, n: int, trees: int, subsample: int, seed: int) -> DataFrame:
    """``tree`` and its rows, chosen by hashes of the row key, so the same in every run and on any cluster.

    One rule at every size: one hash of a row tells how many trees it joins, as if each tree drew about twice as many rows
    as it needs; most rows of a large table join none and are hashed once. Which trees these are, and which rows of a
    tree come first to be taken, other hashes tell, of the rows that are drawn alone.
    """
    keyed = df.withColumn("_key", F.xxhash64(key.cast("string"), F.lit(seed)))
    chances = _joins(trees, min(1.0, 2.0 * subsample / n))
    luck = F.pmod(F.xxhash64("_key", F.lit("trees")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    drawn = keyed.withColumn("_luck", luck).where(F.col("_luck") >= chances[0])
    joins = F.size(F.filter(F.array(*[F.lit(c) for c in chances]), lambda c: F.col("_luck") >= c))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(F.xxhash64("_key", F.lit("draw"), t).alias("by"), t.alias("tree")))
    drawn = drawn.withColumn("tree", F.explode(F.slice(F.sort_array(numbers), F.lit(1), joins))).withColumn("tree", F.col("tree.tree"))
    order = Window.partitionBy("tree").orderBy(F.xxhash64("_key", "tree"), "_key")
    return (
        drawn.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= subsample).drop("_key", "_rank", "_luck")
    )


def fit(
    df: DataFrame, features: dict[str, Column], key: Column, trees: int = TREES, subsample: int = SUBSAMPLE,
    seed: int = SEED,
) -> tuple[Forest, dict[str, float]] | None:
    """Grow a forest on the table's numeric expressions; ``None`` for fewer than ``MIN_ROWS`` rows.

    Missing values are filled with the column's median, which is only computed where values are missing; columns
    without any value are left out.
    """
    counts = df.agg(F.count(F.lit(1)), *[F.count(x) for x in features.values()]).first()
    n, present = counts[0], dict(zip(features, counts[1:]))
    incomplete = {c: x for c, x in features.items() if 0 < present[c] < n}
    medians = {c: 0.0 for c in features if present[c] == n} | exact_medians(df, incomplete)
    medians = {c: medians[c] for c in features if c in medians}
    if n < MIN_ROWS or not medians:
        return None
    names = list(medians)
    x = F.array(*[F.coalesce(features[c].cast("double"), F.lit(medians[c])) for c in names])
    psi = min(subsample, n)

    def grow(batch: pd.DataFrame) -> pd.DataFrame:
        tree = int(batch["tree"].iloc[0])
        rows = np.stack(batch.sort_values("order")["x"].to_numpy())
        nodes = grow_tree(rows, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "length"])
        return out.assign(tree=tree)[["tree", "node", "feature", "threshold", "left", "right", "length"]]

    sampled = _sample(df.select(x.alias("x"), key.cast("string").alias("order")), F.col("order"), n, trees, psi, seed)
    nodes = sampled.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    return Forest(nodes, psi), medians


def score(
    df: DataFrame, forest: Forest, features: dict[str, Column], medians: dict[str, float], name: str = "_iforest_score", spread: int | None = None
) -> DataFrame:
    """Add the forest's score to every row; only the feature columns travel to Python.

    Scoring is what takes time, so a table that is read as few partitions may be dealt into ``spread`` before.
    """
    context = df.sparkSession.sparkContext
    if spread:
        df = df.repartition(spread)
    shipped = context.broadcast(forest)

    @F.pandas_udf(DoubleType())
    def scorer(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = shipped.value
        for columns in batches:
            yield pd.Series(model.score(np.column_stack([c.to_numpy() for c in columns])))

    filled = [F.coalesce(features[c].cast("double"), F.lit(m)) for c, m in medians.items()]
    return df.withColumn(name, scorer(*filled))


def isolation_scores(
    df: DataFrame, features: dict[str, Column], key: Column, name: str = "_iforest_score", spread: int | None = None, **options
) -> DataFrame:
    """Fit and score; a table too small for a forest gets a null score."""
    fitted = fit(df, features, key, **options)
    if fitted is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    forest, medians = fitted
    return score(df, forest, features, medians, name, spread)


def chunk_isolation_scores(
    df: DataFrame,
    features: dict[str, Column],
    chunk: tuple[str, ...] = ("_chunk_id",),
    order: str = "_row_idx",
    name: str = "_iforest_score",
    trees: int = TREES,
    subsample: int = SUBSAMPLE,
    seed: int = SEED,
) -> DataFrame:
    """A forest of its own for every chunk; a chunk is bounded by its row count, so it fits one task.

    Within a chunk, columns without any value are left out and missing values take the chunk's median. A chunk
    of fewer than ``MIN_ROWS`` rows, or without numbers, gets null. ``chunk`` and ``order`` together name a row.
    """
    names = [f"_feature_{i}" for i in range(len(features))]
    keys = [*chunk, order]
    schema = df.select(*keys).withColumn(name, F.lit(None).cast("double")).schema

    def scored(rows: pa.Table) -> pa.Table:
        """Rows of whole chunks, chunk by chunk, with their scores."""
        x = np.column_stack([rows[n].to_numpy().astype(float) for n in names])
        tables, cuts = [], [*np.flatnonzero(rows["_first"].to_numpy()), len(x)]
        found = np.full(len(x), np.nan)
        for low, high in zip(cuts[:-1], cuts[1:]):
            part = x[low:high]
            empty = np.isnan(part).all(axis=0)
            if high - low < MIN_ROWS or empty.all():
                continue
            part[:, empty] = 0.0  # what never varies is never split
            tables.append((low, high, np.where(np.isnan(part), np.nanmedian(part, axis=0), part)))
        forests = Forest.grown([x for *_, x in tables], trees, subsample, seed) if tables else []
        for (low, high, part), forest in zip(tables, forests):
            found[low:high] = forest.score(part)
        return rows.select(keys).append_column(name, pa.array(found, from_pandas=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the chunk that may go on
        for batch in batches:
            first = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
            last = first[-1] if len(first) else 0
            if len(first) and (held or last):
                yield from scored(pa.Table.from_batches([*held, batch.slice(0, last)])).to_batches()
                held, batch = [], batch.slice(last)
            held.append(batch)
        if held:
            yield from scored(pa.Table.from_batches(held)).to_batches()

    # Only keys and features go through Python; all other columns stay where they are and meet the scores by key. The work
    # is in the chunks, not in their bytes, so tasks are as many as a shuffle has partitions however small those are.
    inputs = df.select(*keys, *[x.cast("double").alias(n) for n, x in zip(names, features.values())])
    inputs = inputs.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *chunk)
    here = Window.partitionBy(*chunk).orderBy(F.asc_nulls_last(order))
    marked = inputs.withColumn("_first", F.row_number().over(here) == 1)
    scores = marked.mapInArrow(run, schema)
    return df.join(scores, keys, "left").select(*[F.col("`" + c.replace("`", "``") + "`") for c in (*df.columns, name)])
