"""Quality rules with Spark expressions only: repetition within a text, and lines that fill a host.

Lines are normalised (A-Z lower-cased, runs of white space one space) and hashed. A line's frequency is the number of
distinct documents of its host that hold it, distinct by a digest of all their normalised lines, so exact copies are one
document. Lines above the limit are rows that meet the lines of documents by host and hash; what they take away is added
up for each distinct document and meets the rows by the same digest, so no host is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import SPACES, SPACE_CHARACTERS, let, lower_ascii, quoted, table, whole, words_of, written

#: A line goes if it stands in so many distinct documents of its host.
LEAST_DOCUMENTS = 20
#: Parts into which the rows of one line of a host are dealt where they meet its count.
SALT = 16
#: A document goes if the removed lines leave less than this share of its words, in percent.
LEAST_LEFT_PERCENT = 30
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that the array holds twice or more, the first included."""

    def windows(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - width)
        found = F.transform(places, lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(width)]).alias("h"), i.alias("at")))
        return F.when(F.size(w) >= width, F.sort_array(found))

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: F.coalesce((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), F.lit(False)))
        # Of three-valued logic: a missing neighbour and an equal one make true, a missing and another make null.
        return F.sort_array(F.transform(twice, lambda x: x["at"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(width), F.get(p, j + 1) - x), F.lit(width))), F.lit(0), lambda a, b: a + b)

    return F.coalesce(let(windows(words), lambda s: let(repeated(s), covered)), F.lit(0)).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARACTERS)) != "")


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.btrim(lower_ascii(line), F.lit(SPACE_CHARACTERS)), SPACES, " ")


def line_hash(line: Column) -> Column:
    return F.unhex(F.md5(normalised(line)))


def features(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text that is not null."""

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACE_CHARACTERS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        )

    return let(words_of(text), of)


def line_counts(hashes: Column, sizes: Column) -> Column:
    """Of the hashes of a text's lines and their words: each distinct hash once, with the words of all its lines."""

    def firsts(s: Column) -> Column:
        placed = F.transform(s, lambda x, i: F.struct(x["line"].alias("line"), x["n"].alias("n"), i.alias("at")))
        return F.filter(placed, lambda x, i: (i == 0) | (F.get(s, i - 1)["line"] != x["line"]))

    def runs(s: Column, f: Column) -> Column:
        return F.transform(f, lambda x, i: F.struct(x["line"].alias("line"), (x["n"] * (F.coalesce(F.get(f, i + 1)["at"], F.size(s)) - x["at"])).alias("words")))

    each = F.sort_array(F.arrays_zip(hashes.alias("line"), sizes.alias("n")))
    return let(each, lambda s: let(firsts(s), lambda f: runs(s, f)))


def digest(hashes: Column) -> Column:
    return F.unhex(F.md5(F.array_join(F.transform(hashes, F.hex), "")))


def document_lines(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """(host, digest, line, words): the distinct lines of distinct documents of each host (null is one), and their words."""
    lines = F.transform(lines_with_words(F.col("text")), lambda x: F.struct(line_hash(x).alias("line"), F.size(words_of(x)).alias("n")))
    each = docs.select(F.col(quoted(host)).alias("host"), whole(F.col(quoted(text))).alias("text"))
    each = each.select("host", F.explode(F.array(lines)).alias("lines")).where(F.size("lines") > 0)
    hashes = F.col("lines.line")
    return each.select("host", digest(hashes).alias("digest"), F.inline(line_counts(hashes, F.col("lines.n")))).distinct()


def frequent_lines(lines: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(host, line, n): lines that stand in ``least`` distinct documents of their host or more."""
    return lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def removed_lines(docs: DataFrame, text: str = "text", host: str = "source", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(_host, _digest, removed, lines): of documents that hold frequent lines, the words and the hashes of these.

    A line that very many documents hold is dealt into parts by the documents' digests; its count comes to each part.
    There are at most as many frequent lines as lines of documents over ``least``.
    """
    each = written(document_lines(docs, text, host), "lines")
    salted = each.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALT)).cast("int"))
    many = frequent_lines(each, least).select(
        F.col("host").alias("_host"), F.col("line").alias("_line"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    )
    met = salted.join(many, F.col("host").eqNullSafe(F.col("_host")) & (F.col("line") == F.col("_line")) & (salted["salt"] == many["salt"]))
    return met.groupBy(F.col("host").alias("_host"), F.col("digest").alias("_digest")).agg(
        F.sum("words").alias("removed"), F.collect_list("line").alias("lines")
    )


def apply_quality(
    docs: DataFrame, text: str = "text", host: str = "source", least: int = LEAST_DOCUMENTS, clean_text: bool = True
) -> DataFrame:
    """The rows with a column ``quality``: the counts of `features`, base_failed, n_removed_words, kept, clean_text.

    Rows stay as they are, repeated ones too, and all their columns but one named ``quality``. Null texts count as
    empty and fail; ``clean_text`` is the text without the frequent lines (the text itself, null too, if it has none); where
    it is not asked for, and the text itself is not, no text is moved.
    Rows with a null host share a host. Ties cannot arise: every limit is a count. No rows give no rows. A host or a text
    that a large part of the rows share is met by joins alone, which Spark splits where they are skewed.
    """
    names = [c for c in docs.columns if c != "quality"]
    rows = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)])
    raw, its_host = F.col(f"c{names.index(text)}"), F.col(f"c{names.index(host)}")
    # A generator's output is worked out once, whatever is filtered or chosen by it later.
    judged = rows.select(
        "*", F.explode(F.array(F.struct(features(whole(raw)).alias("f"), digest(F.transform(lines_with_words(whole(raw)), line_hash)).alias("digest")))).alias("q")
    )
    hits = removed_lines(docs, text, host, least)
    joined = judged.join(hits, its_host.eqNullSafe(F.col("_host")) & (F.col("q.digest") == F.col("_digest")), "left")
    stays = lambda x: (F.btrim(x, F.lit(SPACE_CHARACTERS)) == "") | ~F.array_contains(F.col("lines"), line_hash(x))
    clean = F.when(F.col("lines").isNull(), raw).otherwise(F.array_join(F.filter(F.split(raw, "\n", -1), stays), "\n"))
    n, removed = F.col("q.f.n_words"), F.coalesce(F.col("removed"), F.lit(0)).cast("long")
    failed = (n < LEAST_WORDS) | (100 * F.col("q.f.n_repeat_words") > MOST_REPEATED_PERCENT * n)
    depleted = (removed > 0) & (100 * (n - removed) < LEAST_LEFT_PERCENT * n)
    quality = F.struct(
        "q.f.*", failed.alias("base_failed"), removed.alias("n_removed_words"), (~failed & ~depleted).alias("kept"),
        *([clean.alias("clean_text")] if clean_text else []),
    )
    done = joined.select(*rows.columns, quality.alias("quality"))
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "quality")


def op6_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return apply_quality(docs, clean_text=False).select(
        "doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines", "quality.n_repeat_words",
        "quality.base_failed", "quality.kept", "quality.n_removed_words",
    )


OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
l AS (SELECT r, i, source, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws, md5(array_to_string(regexp_extract_all(
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ')) AS h
  FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r),
t AS (SELECT r, md5(string_agg(h, '' ORDER BY i)) AS d FROM l GROUP BY r),
freq AS (SELECT source, h FROM l JOIN t USING (r) GROUP BY source, h HAVING count(DISTINCT d) >= {LEAST_DOCUMENTS}),
rem AS (SELECT r, sum(len(ws))::BIGINT AS n FROM l WHERE EXISTS (
  SELECT 1 FROM freq WHERE freq.h = l.h AND freq.source IS NOT DISTINCT FROM l.source) GROUP BY r),
f AS (SELECT d.doc_id, len(w.ws)::BIGINT AS n_words, length(array_to_string(w.ws, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(rem.n, 0)::BIGINT AS n_removed_words
  FROM d JOIN w USING (r) LEFT JOIN dl USING (r) LEFT JOIN rep USING (r) LEFT JOIN rem USING (r)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND NOT (n_removed_words > 0 AND 100 * (n_words - n_removed_words) < {LEAST_LEFT_PERCENT} * n_words) AS kept FROM b
"""
