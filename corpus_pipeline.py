"""The corpus pipeline: documents in, documents that a model can learn from out, as token ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read as the next stage's
docs. All but the last give the columns of documents. Each stage gives no rows for no rows, leaves other columns as they
are, and takes null texts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.llm.common import quoted, table, written
from tabulens.llm.dedup import keep_one_of_each
from tabulens.llm.mixing import mix, text_words
from tabulens.llm.pieces import encode_sampled
from tabulens.llm.quality import apply_quality
from tabulens.llm.tokens import public_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that fill their host; n_chars follows a text that changed."""
    judged = apply_quality(docs).where("quality.kept")
    clean = F.col("quality.clean_text")
    changed = {"text": clean}
    if "n_chars" in docs.columns:
        same = F.col("quality.n_removed_words") == 0
        changed["n_chars"] = F.when(same, F.col("n_chars")).otherwise(F.length(clean).cast(docs.schema["n_chars"].dataType))
    return judged.select(*[changed.get(c, F.col(quoted(c))).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates on five-word shingles: the one with the least id."""
    return keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as many times as it is taken."""
    mixed = mix(docs, text_words(F.col("text")))
    taken = mixed.where("mix.times > 0").withColumn("mix", F.explode(F.array_repeat(F.lit(0), F.col("mix.times"))))
    return taken.select(*[F.col(quoted(c)) for c in docs.columns])


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, token_ids (a sampled segmentation) and lossless, whether they decode to the very text."""
    done = encode_sampled(docs.select("doc_id", "source", "text"), public_path(), check="lossless")
    return done.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "lossless")


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("mixing", mix_sources), ("pieces", sampled_pieces)]

#: Neither the choice of documents by seeded hashes nor sampled segmentations can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
