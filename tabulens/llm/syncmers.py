"""Document fingerprints from closed syncmers, with Spark expressions only.

Words are the symbols. Of every k words in a row, the hashes of the runs of s words inside are compared: where the
least is the first or the last, the k words are an anchor. Whether k words are an anchor depends on them alone, so a
passage has the same anchors wherever it stands, and no more than k - s + 1 starts go by without one. The fingerprint
is the hashes of the anchors in text order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import let, lower_ascii, quoted, table, whole, words_of

K, S = 6, 2
#: 31 random bits below a set one: eight hex digits, always.
LOW, HIGH = 0x7FFFFFFF, 0x80000000


def _short(h: Column) -> Column:
    return h.bitwiseAND(F.lit(LOW)).bitwiseOR(F.lit(HIGH))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<position, hash>> of a text, null as empty; A-Z do not differ from a-z.

    A text of fewer than k words has one anchor, all its words; one without words has none.
    """
    if not 0 < s < k:
        raise ValueError("0 < s < k")
    last = k - s

    def of(h: Column) -> Column:
        n = F.size(h)
        inner = F.transform(F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(s)]))

        def closed(m: Column, i: Column) -> Column:
            least = F.array_min(F.slice(m, i + 1, last + 1))
            return (F.get(m, i) == least) | (F.get(m, i + last) == least)

        starts = let(inner, lambda m: F.filter(F.sequence(F.lit(0), n - k), lambda i: closed(m, i)))
        found = F.transform(starts, lambda i: F.struct(i.alias("position"), _short(F.xxhash64(*[F.get(h, i + j) for j in range(k)])).alias("hash")))
        alone = F.array(F.struct(F.lit(0).alias("position"), _short(F.xxhash64(h)).alias("hash")))
        return F.when(n >= k, found).when(n > 0, alone).otherwise(F.array().cast("array<struct<position:int,hash:bigint>>"))

    return let(F.transform(words_of(lower_ascii(whole(text))), lambda w: F.xxhash64(w)), of)


def fingerprint(found: Column) -> Column:
    """Eight hex digits per anchor, in text order."""
    return F.array_join(F.transform(found["hash"], lambda h: F.lower(F.hex(h))), "")


def likeness(a: Column, b: Column) -> Column:
    """Twice the anchors that both have, over the anchors of both (0 to 1), of two arrays of distinct hashes.

    Two texts without words are alike, a text with and one without are not.
    """
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2 * F.size(F.array_intersect(a, b)) / F.when(total > 0, total))


def matched_positions(a: Column, b: Column) -> Column:
    """The positions in ``a`` whose anchors ``b`` has too, for two arrays of anchors."""
    return let(F.array_intersect(a["hash"], b["hash"]), lambda both: F.filter(a, lambda x: F.array_contains(both, x["hash"]))["position"])


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", blocks: int | None = None) -> DataFrame:
    """(key, text, block, place, echo): texts dealt into blocks of the key, each with a copy of the row after its last.

    Within a block, the row after another in order of ``echo, key`` is the next one of the table, and the first of the
    table follows its last. Null texts are empty, null keys come last, rows with equal keys go by text. Block bounds are
    approximate quantiles of the keys: their number, not the table's, is what the driver sees.
    """
    n = blocks or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(quoted(key)).alias("key"), whole(F.col(quoted(text))).alias("text"))
    seen = rows.agg(
        F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n).alias("cuts"), F.min("key").alias("low"), F.count(F.when(F.col("key").isNull(), 1)).alias("unnamed"),
    ).first()
    bounds = sorted({seen.low, *(seen.cuts or [])} - {None})
    firsts = [*bounds, *([None] if seen.unnamed else [])]
    cuts = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    block = F.when(F.col("key").isNull(), len(bounds)).otherwise(F.size(F.filter(cuts, lambda c: c <= F.col("key"))) - 1)
    # The first row of a block is echoed in the block before it, and the first of all in the last.
    opens = F.col("key").isNull() if not bounds else F.coalesce(F.array_contains(cuts, F.col("key")), F.lit(True))
    before = F.pmod(F.col("block") - 1, F.lit(max(1, len(firsts))))
    copies = F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("echo")), F.struct(before.alias("block"), F.lit(True).alias("echo")))
    dealt = rows.withColumn("block", block).withColumn("at", F.explode(F.when(opens, copies).otherwise(F.slice(copies, 1, 1))))
    return dealt.select("key", "text", "at.block", "at.echo")


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, s: int = S, blocks: int | None = None) -> DataFrame:
    """One row per row: key, text, edited text, hashes of both and of the next text.

    The edited text has its last quarter (rounded down, in code points) replaced by as many first code points of the next
    text, or by all of it where it has fewer. A single row is followed by itself. Repeated rows follow each other.
    """
    order = Window.partitionBy("block").orderBy("echo", F.col("key").asc_nulls_last(), "text")
    rows = with_next(docs, key, text, blocks).withColumn("next", F.lead("text").over(order))
    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.when(F.col("echo"), "").otherwise(F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.coalesce("next", "text"), F.lit(1), quarter)))
    found = rows.select(
        "key", "text", "block", "echo", edited.alias("edited"), anchors(F.col("text"), k, s)["hash"].alias("hashes"),
    ).withColumn("edited_hashes", anchors(F.col("edited"), k, s)["hash"])
    ahead = found.withColumn("next_hashes", F.lead("hashes").over(order))
    return ahead.where(~F.col("echo")).drop("echo", "block")


def hex_of(hashes: Column) -> Column:
    return F.lower(F.array_join(F.transform(hashes, lambda h: F.hex(h)), ""))


def op2_fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = edited_pairs(docs)
    sets = [F.array_distinct(c).alias(f"{c}_set") for c in ("hashes", "edited_hashes", "next_hashes")]
    measured = pairs.select("*", *sets)
    return measured.select(
        F.col("key").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        hex_of(F.col("hashes")).alias("fingerprint"), hex_of(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes_set"), F.col("edited_hashes_set")).alias("near_edited"),
        likeness(F.col("hashes_set"), F.col("next_hashes_set")).alias("near_next"),
    )
