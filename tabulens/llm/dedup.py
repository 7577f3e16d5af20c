"""Near-duplicate documents by MinHash: one permutation, optimal densification, banded buckets, star-shaped candidates.

Texts become sets of word shingles; equal sets are one class from there on, so exact copies cost one row. A class has
one sketch from a single hash of each shingle: the hash picks a bin and competes in it, and an empty bin borrows from
bins that a second hash of (bin, attempt) names until one is filled. Bands of the sketch are buckets. In each bucket
only the edges of a star are compared, on full sets. Buckets of more than two may then still hold several components.
Of these, classes are left out that are out of reach: sets cannot reach the similarity if their sizes do not allow it,
or if too many of their shingles stand in no other set that is still looked at, or, for a pair, if their other shingles
do not agree in number over the parts of the hashes' range. What is left is compared by a second star,
whose centre comes from the bucket's largest component and has few shingles of its own, as that is likest to all others;
and at last every class outside of a bucket's largest component with all of other components, each pair in the first
bucket that it shares. So buckets need no cap, and every pair that shares a bucket is compared, connected otherwise, or
out of reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import GOLDEN, dropped, mixed, quoted, table, written
from tabulens.llm.components import components

#: Bands and rows a band: two sets of similarity 0.8 share no bucket with a chance of (1 - 0.8 ** ROWS) ** BANDS = 5e-6.
BANDS, ROWS = 40, 6
SHINGLE, PERCENT = 5, 80
#: Parts of the hashes' range in which shingles that others have too are counted; two sets share no more than their counts do.
PARTS = 128


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words than ``width`` make one shingle, no words none."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, joined), np.uint64, len(joined)))


class Sketcher:
    """One-permutation sketches with optimal densification, and their bands."""

    def __init__(self, bands: int, rows: int) -> None:
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.places = np.arange(self.bins, dtype=np.uint64)
        self.odd = mixed((self.places + np.uint64(1)) * GOLDEN) | np.uint64(1)
        self.attempts: list[np.ndarray] = []

    def donors(self, attempt: int) -> np.ndarray:
        """The bin that each bin borrows from at an attempt; the same in every sketch."""
        while len(self.attempts) <= attempt:
            seed = np.uint64((len(self.attempts) + 1) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)
            self.attempts.append((mixed(mixed(self.places + seed) ^ seed) % np.uint64(self.bins)).astype(np.int64))
        return self.attempts[attempt]

    def sketch(self, hashes: np.ndarray) -> np.ndarray:
        values = mixed(hashes)
        bins = ((values >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        top = np.uint64(0xFFFFFFFFFFFFFFFF)
        out = np.full(self.bins, top)
        np.minimum.at(out, bins, values)
        filled = out != top
        source, empty, attempt = out.copy(), np.flatnonzero(~filled), 0
        while len(empty):
            donor = self.donors(attempt)[empty]
            got = filled[donor]
            out[empty[got]] = source[donor[got]]
            empty, attempt = empty[~got], attempt + 1
        return out

    def band_keys(self, hashes: np.ndarray) -> np.ndarray:
        """One 64-bit key per band, distinct between bands."""
        weighed = mixed(self.sketch(hashes) * self.odd).reshape(self.bands, self.rows)
        return mixed(weighed.sum(axis=1, dtype=np.uint64) + np.arange(1, self.bands + 1, dtype=np.uint64) * GOLDEN)


def _classes(rows: DataFrame, width: int, bands: int, per_row: int) -> DataFrame:
    """(key, n_shingles, class) and the bands of each row; a row without shingles has no class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketcher = Sketcher(bands, per_row)
        for batch in batches:
            sizes, classes, keys = [], [], []
            for text in batch["text"]:
                hashes = shingle_hashes(text, width)
                sizes.append(len(hashes))
                classes.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                keys.append(sketcher.band_keys(hashes).view(np.int64) if len(hashes) else None)
            yield pd.DataFrame({"key": batch["key"], "text_hash": batch["text_hash"], "n_shingles": sizes, "class": classes, "bands": keys})

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, text_hash long, n_shingles long, class binary, bands array<long>")


def _reach(n: str, m: str, percent: int, own: str | None = None, others: str | None = None) -> Column:
    """Whether sets of n and m shingles, some of them their own, can reach the similarity."""
    most = F.least(F.col(n) - F.col(own), F.col(m) - F.col(others)) if own and others else F.least(n, m)
    return most * 100 >= (F.col(n) + F.col(m) - most) * percent


def _open_rows(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, class, n, own, parts, buckets, root, main, centre): the members of buckets that hold several components.

    ``main`` is the largest of a bucket's components, ``centre`` the class of it with the fewest shingles of its own.
    Components come to one row per class; only what stays in an open bucket is more than that.
    """
    rooted = classes.join(labels.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    rows = rooted.select(F.explode("buckets").alias("bucket"), "class", "n", "own", "parts", "buckets", "root")
    best = F.min(F.struct("own", "class", "n")).alias("centre")
    groups = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("size"), best)
    several = groups.groupBy("bucket").agg(F.count(F.lit(1)).alias("groups"), F.max(F.struct("size", "root", "centre")).alias("x")).where("groups > 1")
    return rows.join(several.select("bucket", F.col("x.root").alias("main"), "x.centre"), "bucket")


def _own_shingles(texts: DataFrame, width: int) -> DataFrame:
    """(class, own, parts): how many of its shingles stand in no other of the texts, and the others, counted by part.

    ``parts`` is null where a count is too large to be kept, and then rules nothing out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"class": batch["class"], "found": [shingle_hashes(t, width).view(np.int64) for t in batch["text"]]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for text, alone in zip(batch["text"], batch["alone"]):
                every = np.bincount(shingle_hashes(text, width) % np.uint64(PARTS), minlength=PARTS)
                own = np.bincount(np.asarray(alone, np.int64), minlength=PARTS) if alone is not None else 0
                parts.append(every - own if every.max() < 2**15 else None)
            yield pd.DataFrame({"class": batch["class"], "own": [0 if x is None else len(x) for x in batch["alone"]], "parts": parts})

    each = texts.mapInPandas(run, "class binary, found array<long>").select("class", F.explode("found").alias("h"))
    alone = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.first("class").alias("class")).where("n = 1")
    alone = alone.groupBy("class").agg(F.collect_list(F.col("h").bitwiseAND(PARTS - 1)).alias("alone"))
    return texts.join(alone, "class", "left").select("class", "text", "alone").mapInPandas(count, "class binary, own long, parts array<smallint>")


def _share_enough(n: str, m: str, parts: str, others: str, percent: int) -> Column:
    """Whether sets of n and m shingles can reach the similarity by their counts in all parts."""
    most = F.aggregate(F.zip_with(parts, others, lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda total, x: total + x)
    return F.coalesce(most * 100 >= (F.col(n) + F.col(m) - most) * percent, F.lit(True))


def _texts(plain: DataFrame, sketched: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, text): one text for each of the wanted classes, found by the key and text hash of one of its rows."""
    named = sketched.join(wanted, "class").groupBy("class").agg(F.min(F.struct("key", "text_hash")).alias("row"))
    named = named.select("class", F.col("row.key").alias("_key"), F.col("row.text_hash").alias("_hash"))
    found = plain.join(named, (F.col("text_hash") == F.col("_hash")) & F.col("key").eqNullSafe(F.col("_key")))
    return written(found.groupBy("class").agg(F.first("text").alias("text")), "texts")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs of classes (a, b), those whose full sets reach the similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (a, x, y) in enumerate(zip(batch["a"], batch["x"], batch["y"])):
                if a != last:  # a star's edges come one after the other
                    last, left = a, shingle_hashes(x, width)
                right = shingle_hashes(y, width)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(left) + len(right) - both)
            yield batch.loc[keep, ["a", "b"]]

    left = texts.select(F.col("class").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("class").alias("b"), F.col("text").alias("y"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInPandas(run, "a binary, b binary")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row: ``key``, n_shingles, component_id (the least key that links reach), kept (key = component_id).

    Rows without words have an empty set and are linked with nothing: their own key is their component. A null key is
    larger than every other; a component of nothing but null keys has a null id, and its rows are not kept unless
    they stand alone without words. Rows that repeat a key are rows of their own with that key. No rows give no rows.
    """
    found = _decided(docs, key, text, width, percent, bands, rows)
    alone = F.col("class").isNull()
    return found.select(
        F.col("key").alias(key), "n_shingles", "component_id", (alone | F.coalesce(F.col("key") == F.col("component_id"), F.lit(False))).alias("kept")
    )


def keep_one_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """The rows that stay, with their columns as they are: of each component the one with the least key, null last.

    Of rows that share that key the one with the least text hash stays, of repeated rows one. Rows without words stay.
    """
    found = _decided(docs, key, text, width, percent, bands, rows)
    alone = found.where(F.col("class").isNull()).select("key", "text_hash").distinct().withColumn("copies", F.lit(1))
    each = found.where(F.col("class").isNotNull()).groupBy("root", "key", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    first = F.min(F.struct(F.col("key").isNull(), "key", "text_hash", "copies"))
    best = each.groupBy("root").agg(first.alias("x")).select("x.key", "x.text_hash", "x.copies")
    staying = written(best.union(alone).select(F.col("key").alias("_key"), F.col("text_hash").alias("_hash"), "copies"), "staying")
    names = docs.columns
    whole_rows = docs.select(F.struct(*[F.col(quoted(c)) for c in names]).alias("row"), F.col(quoted(key)).alias("key"), F.xxhash64(F.col(quoted(text))).alias("text_hash"))
    met = whole_rows.join(staying, (F.col("text_hash") == F.col("_hash")) & F.col("key").eqNullSafe(F.col("_key")))
    if staying.where("copies > 1").limit(1).count():  # repeated rows: only they are gathered, to keep one
        met = met.where("copies = 1").unionByName(met.where("copies > 1").dropDuplicates(["key", "text_hash"]))
    return met.select(*[F.col("row")[c].alias(c) for c in names])


def _decided(docs: DataFrame, key: str, text: str, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(key, text_hash, n_shingles, class, root, component_id) of every row."""
    plain = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sketched = written(_classes(plain, width, bands, rows), "sketches")
    # Equal sets have equal bands: any row of a class stands for it. Buckets know classes by a short hash; should two
    # share it, both are looked at.
    classes = sketched.where(F.col("class").isNotNull()).groupBy("class").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("id", F.xxhash64("class")), "classes")
    placed = classes.select("id", "n", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("size"), F.min("n").alias("smallest")).where("size > 1")
    members = written(placed.drop("n").join(shared, "bucket"), "members")
    known = classes.select("id", "class", "n")
    stars = members.where("id <> centre").select("centre", "id").distinct()
    twins = members.where("id = centre").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(members, "bucket").select("centre", "id").distinct()
    ends = known.select(F.col("id").alias("centre"), F.col("class").alias("a"), F.col("n").alias("m"))
    compared = stars.union(twins).distinct().join(known, "id").join(ends, "centre").where((F.col("a") != F.col("class")) & _reach("n", "m", percent))
    compared = written(compared.select("a", F.col("class").alias("b")), "pairs")
    # A bucket of two is settled; from larger ones the centre goes, as it was compared with all others.
    crowded = members.where("size > 2 and id <> centre").groupBy("id").agg(F.collect_list(F.struct("bucket", "smallest")).alias("buckets"))
    crowded = written(crowded.join(known, "id").drop("id"), "crowded")
    texts = _texts(plain, sketched, compared.select(F.col("a").alias("class")).union(compared.select("b")).union(crowded.select("class")).distinct())
    links = written(_confirmed(compared, texts, width, percent), "confirmed")
    labels = written(components(links), "labels")
    dropped(members, compared, links)
    # Of a set with ``own`` shingles that no other has, the likest set of any size in its bucket.
    own = _own_shingles(texts.join(crowded, "class", "left_semi"), width)
    left = F.col("n") - F.col("own")
    fitting = F.filter("buckets", lambda x: left * 100 >= (F.greatest(x["smallest"], left) + F.col("own")) * percent)
    rest = crowded.join(own, "class", "left").withColumn("own", F.coalesce("own", F.lit(0))).withColumn("buckets", F.transform(fitting, lambda x: x["bucket"]))
    rest = written(rest.where(F.size("buckets") > 0), "rest")
    dropped(crowded)
    for all_pairs in (False, True):
        rows = written(_open_rows(rest, labels), "open")
        outside = rows.where(F.col("root") != F.col("main"))
        if all_pairs:
            ends = outside.select("bucket", F.col("class").alias("c"), F.col("n").alias("m"), F.col("own").alias("others"), F.col("parts").alias("its_parts"), F.col("root").alias("other"), F.col("buckets").alias("its"))
            # A pair is met in the first bucket it shares, and once where both are outside of the main component.
            first = F.array_min(F.array_intersect("buckets", "its")) == F.col("bucket")
            once = (F.col("root") == F.col("main")) | (F.col("class") < F.col("c"))
            near = _reach("n", "m", percent, "own", "others") & first & _share_enough("n", "m", "parts", "its_parts", percent)
            pairs = rows.drop("centre").join(ends, "bucket").where((F.col("root") != F.col("other")) & once & near)
            pairs = pairs.select(F.least("class", "c").alias("a"), F.greatest("class", "c").alias("b"))
        else:
            ends = outside.select("class", "n", "own", F.col("centre.class").alias("c"), F.col("centre.n").alias("m"), F.col("centre.own").alias("others"))
            pairs = ends.where(_reach("n", "m", percent, "own", "others")).select(F.col("c").alias("a"), F.col("class").alias("b")).distinct()
        new = written(pairs, "pairs")
        if new.limit(1).count():
            links = written(_confirmed(new, texts, width, percent), "confirmed")
            joined, old = labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links), labels
            labels = written(components(joined), "labels")
            dropped(links, old)
        dropped(rows, new)
    dropped(rest, texts)
    least = sketched.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("key").alias("least"))
    rooted = least.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(ids, "root").select(F.col("class").alias("_class"), "root", "component_id")
    out = sketched.join(found, F.col("class") == F.col("_class"), "left")
    component = F.when(F.col("class").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select("key", "text_hash", "n_shingles", "class", "root", component.alias("component_id"))


def op1_near_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, width=2)


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i, len(w) AS n FROM w),
s AS (SELECT DISTINCT doc_id, CASE WHEN n = 1 THEN x ELSE x || ' ' || y END AS g
  FROM (SELECT *, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM k) WHERE y IS NOT NULL OR n = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
