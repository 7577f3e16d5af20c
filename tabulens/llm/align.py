"""Two tokenizers over the same bytes: groups that both end together, links between overlapping tokens, counts of links.

Batches stay in Arrow. Token lists are flattened and every token keeps its document's index; a cumulative sum of the
tokens' bytes, less what stood before the document, gives each token's end; (document, end) is a key. Where the two sides
are joined on it, they end together: those keys cut a document into groups. All keys of either side, in order, cut it
into stretches that lie in one token of each side, and no two tokens share two stretches, so a stretch is a link.

Links are counted by pair of ids, in each document by Arrow, over all documents by Spark. Of these counts, each token of
the one side knows its best partner. The pairs that hold more than a fixed share of all links, of which there can be only
so many, are broadcast, so that no frequent pair is a hot key; the other pairs of a document are joined with their counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.bpe import lists_of, parts_of, vocabulary_of
from tabulens.llm.common import quoted, table, written
from tabulens.llm.pieces import texts_of
from tabulens.llm.tokens import public_path

#: Pairs that hold one in so many links or more are broadcast: no more than that number can.
SHARE = 100_000
#: Ids of the second side take this many bits of a pair's number.
BITS = 24


class Aligned(NamedTuple):
    """Of some texts: tokens of both sides; of each stretch its document, pair, and whether both sides end with it."""

    a: pa.ListArray
    b: pa.ListArray
    doc: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray
    both: np.ndarray

    def pairs(self) -> np.ndarray:
        """The pair of each link: both ids in one number."""
        return (self.a.flatten().to_numpy().astype(np.int64)[self.at_a] << BITS) | self.b.flatten().to_numpy()[self.at_b]


class Sides:
    """Encodes texts by a byte-level BPE and a sentencepiece model, without special tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = vocabulary_of(path_a, True), texts_of(path_b)
        self.bytes_a = np.zeros(max(self.a.raw) + 1, np.int64)
        self.bytes_a[list(self.a.raw)] = [len(x) for x in self.a.raw.values()]
        self.bytes_b = np.array([len(x) for x in self.b.raw], np.int64)

    def encode(self, texts: Sequence[str | None]) -> tuple[pa.ListArray, pa.ListArray]:
        """Of a space and the text, and of the text; both empty where their bytes are not those of a space and the text."""
        flat, sizes = self.a.encode([" " + t if t else None for t in texts])
        found_a = np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []
        found_b = self.b.model.encode([t or "" for t in texts], num_threads=1)
        raw_a, raw_b = self.a.raw, self.b.raw
        for i, (t, x, y) in enumerate(zip(texts, found_a, found_b)):
            want = (" " + t).encode() if t else b""
            if b"".join(map(raw_b.__getitem__, y)) != want or b"".join(map(raw_a.__getitem__, x.tolist())) != want:
                found_a[i], found_b[i] = flat[:0], []
        sides = ([np.asarray(x, np.int32) for x in side] for side in (found_a, found_b))
        a, b = (lists_of(np.concatenate([flat[:0], *side]), np.array([len(x) for x in side], np.int64)) for side in sides)
        return a, b

    def align(self, texts: Sequence[str | None]) -> Aligned:
        a, b = self.encode(texts)
        left, right = _ends(a, self.bytes_a, "at_a"), _ends(b, self.bytes_b, "at_b")
        met = left.join(right, keys=["doc", "end"], join_type="full outer").sort_by([("doc", "ascending"), ("end", "ascending")])
        both = pc.and_(pc.is_valid(met["at_a"]), pc.is_valid(met["at_b"]))
        # A stretch lies in the next token to end, of either side; the last of a document is the last of both.
        at_a, at_b = (pc.fill_null_backward(met[c].combine_chunks()).to_numpy() for c in ("at_a", "at_b"))
        return Aligned(a, b, met["doc"].to_numpy(), at_a, at_b, both.to_numpy())


def _ends(tokens: pa.ListArray, sizes: np.ndarray, name: str) -> pa.Table:
    """(doc, end, place in the flat list) of every token."""
    doc, flat = pc.list_parent_indices(tokens), pc.list_flatten(tokens)
    total = pc.cumulative_sum(pa.array(sizes).take(flat))
    before = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(tokens.offsets.cast(pa.int64()))
    end = pc.subtract(total, before.take(doc))
    return pa.table({"doc": doc.cast(pa.int64()), "end": end, name: pa.array(np.arange(len(flat)))})


@lru_cache(maxsize=2)
def sides_of(path_a: str, path_b: str) -> Sides:
    return Sides(path_a, path_b)


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", out: str = "aligned") -> DataFrame:
    """The rows with a column ``out`` (in place of one of that name): a_ids, b_ids and groups of whole texts.

    ``groups`` holds for each stretch of bytes that both sides end together the number of tokens (n_a, n_b) that it
    takes from the two lists in turn. The first side encodes a space and the text, the second the text. Null and empty
    texts, and those whose tokens do not give back a space and the text, have empty lists.
    """

    @F.arrow_udf("a_ids array<int>, b_ids array<int>, groups array<struct<n_a: int, n_b: int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sides = sides_of(path_a, path_b)
        for batch in batches:
            found = []
            for texts in parts_of(batch):
                x = sides.align(texts.to_pylist())
                a, b = (np.concatenate([[-1], side[x.both]]) for side in (x.at_a, x.at_b))
                groups = pa.StructArray.from_arrays([pa.array(np.diff(a), pa.int32()), pa.array(np.diff(b), pa.int32())], names=["n_a", "n_b"])
                cuts = np.concatenate([[0], np.cumsum(np.bincount(x.doc[x.both], minlength=len(texts)))])
                found.append(pa.StructArray.from_arrays([x.a, x.b, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), groups)], names=["a_ids", "b_ids", "groups"]))
            yield pa.concat_arrays(found) if found else pa.array([], pa.struct([("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())), ("groups", pa.list_(pa.struct([("n_a", pa.int32()), ("n_b", pa.int32())])))]))

    return docs.withColumn(out, run(F.col(quoted(text))))


class Written:
    """Group texts: ids and the signs after them, looked up by id and sign."""

    def __init__(self, ids_a: int, ids_b: int) -> None:
        self.ids_a, self.ids_b = ids_a, ids_b
        self.parts = [f"{i}{sign}" for sign in ",|" for i in range(ids_a)] + [f"{i}{sign}" for sign in ",;" for i in range(ids_b)]

    def digests(self, x: Aligned, docs: int) -> list[str]:
        """sha256 of ``a1,a2|b1;a3|b2,b3`` of each document: both sides' ids, group by group; '' without tokens."""
        a, b = x.a.flatten().to_numpy(), x.b.flatten().to_numpy()
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[x.at_a[x.both]] = last_b[x.at_b[x.both]] = True
        group = [np.cumsum(last) - last for last in (last_a, last_b)]
        order = np.argsort(np.concatenate([group[0] * 2, group[1] * 2 + 1]), kind="stable")
        codes = np.concatenate([a + last_a * self.ids_a, b + last_b * self.ids_b + 2 * self.ids_a])[order].tolist()
        cuts = (x.a.offsets.to_numpy() + x.b.offsets.to_numpy()).tolist()
        texts = ("".join(map(self.parts.__getitem__, codes[low:high]))[:-1] for low, high in zip(cuts[:-1], cuts[1:]))
        return [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]


def linked(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Of rows (key, text): key, n_a, n_b, n_groups, n_links, groups_sha256, links (each pair of ids and how many), row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = sides_of(path_a, path_b)
        text_of = Written(len(sides.bytes_a), len(sides.bytes_b))
        for batch in batches:
            low = 0
            for texts in parts_of(batch.column(1)):
                n = len(texts)
                x = sides.align(texts.to_pylist())
                counted = pa.table({"doc": x.doc, "pair": x.pairs()}).group_by(["doc", "pair"]).aggregate([([], "count_all")]).sort_by("doc")
                cuts = pa.array(np.searchsorted(counted["doc"].to_numpy(), np.arange(n + 1)), pa.int32())
                pairs = pa.StructArray.from_arrays([counted["pair"].combine_chunks(), counted["count_all"].combine_chunks()], names=["pair", "n"])
                columns = [
                    batch.column(0).slice(low, n), *(pa.array(np.diff(side.offsets.to_numpy()), pa.int64()) for side in (x.a, x.b)),
                    pa.array(np.bincount(x.doc[x.both], minlength=n)), pa.array(np.bincount(x.doc, minlength=n)), pa.array(text_of.digests(x, n)),
                    pa.ListArray.from_arrays(cuts, pairs),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])
                low += n

    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(run, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair: long, n: long>>")
    # Rows get a number that joins can go by: keys may be null or repeat. It is fixed by being written.
    return written(found.withColumn("row", F.monotonically_increasing_id()), "linked")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, count, is_best): how many links hold each pair of ids, and whether no pair of its second id holds more."""
    counts = written(links.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    second = F.col("pair").bitwiseAND((1 << BITS) - 1)
    most = counts.groupBy(second.alias("b")).agg(F.max("count").alias("most"))  # as many rows as the vocabulary has ids
    return counts.join(F.broadcast(most), second == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("is_best"))


def align_and_count(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", share: int = SHARE) -> DataFrame:
    """One row per row: ``key``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_links counts the pairs of token occurrences that overlap, count_sum adds up how often each one's pair of ids is
    linked in all rows, n_best counts those whose pair is linked as often as any pair with the same second id (all that
    tie). Repeated rows count as often as they come; keys may be null or repeat; other columns are not looked at. Texts
    without tokens (see `align`) give zeros and ''. No rows give no rows.
    """
    done = linked(docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text")), path_a, path_b)
    links = done.select("row", F.inline("links"))
    counts = pair_counts(links)
    total = done.agg(F.coalesce(F.sum("n_links"), F.lit(0)).alias("n")).first().n
    frequent = F.col("count") * share >= total
    seen = links.join(F.broadcast(counts.where(frequent)), "pair", "left")
    rest = seen.where(F.col("count").isNull()).select("row", "pair", "n").join(counts.where(~frequent), "pair")
    sums = [F.sum(F.col("n") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).alias("n_best")]
    # Added up within the tasks first: a document has one row from each part.
    each = [df.groupBy("row").agg(*sums) for df in (seen.where(F.col("count").isNotNull()), rest)]
    both = each[0].union(each[1]).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = done.drop("links").join(both, "row", "left")
    return out.select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")), "groups_sha256"
    )


def op12_token_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_and_count(docs, public_path("byte_bpe_50k.json"), public_path())
