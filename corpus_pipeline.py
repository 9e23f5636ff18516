"""A text corpus in five stages, each on all rows that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns documents of the same columns; the last one adds tokens.  Stages share
nothing: what a result still reads (numbers of removed lines, ids of documents that go, places of passages) are small tables
of its own, which go with the session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import bpe, decontaminate, langid, line_dedup, minhash
from scanloom.llm._rt import Scratch, fresh, row_hash, text_or_empty


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the predicted language; documents without letters go, null and empty texts with them.

    Profiles are learned from the documents' own labels; where there are none to learn from, lang stays null.
    Repeated rows stay."""
    profiles = langid.learn_profiles(docs.select("text", "lang"))
    (letters,) = fresh(docs.columns, "letters")
    found = langid.identify(docs, profiles, letters_col=letters).where(F.col(letters))
    return found.withColumn("lang", F.col("lang_pred") if profiles else F.lit(None).cast("string")).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later matches of lines; n_chars follows the text.  Documents stay, if need be with an empty text; a null
    text stays null, with null n_chars.  Rows that repeat doc_id and text lose the same lines."""
    out = line_dedup.line_dedup(docs, scratch=Scratch(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates; null and empty texts stay, as do rows that repeat the kept one's
    doc_id and text."""
    return minhash.near_dedup(docs, scratch=Scratch(spark)).select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold passages of the benchmark; null and empty texts stay."""
    marks = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch=Scratch(spark))
    d, t, h = fresh(docs.columns, "gone_id", "gone_th", "th")
    gone = marks.where("contaminated").select(F.col("doc_id").alias(d), F.col("th").alias(t)).distinct()
    keyed = docs.withColumn(h, row_hash(text_or_empty()))
    return keyed.join(gone, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(h) == F.col(t)), "left_anti").select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_tokens, ids (as text), and the text decoded from the ids, in one pass; a null text counts as empty."""
    return bpe.encode(docs, decode=True)


#: Name and function of each stage, in order.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", bpe_stage),
]

#: Rank-order profiles and set joins by likeness have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again."""
    docs, stored = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = stored.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
