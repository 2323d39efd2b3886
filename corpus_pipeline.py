"""The corpus pipeline: stages over the documents table, each written and reread.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep
the columns of documents, extra ones included.  Stages see every row that the stage
before has kept.

Edge cases: texts that are null, empty or without letters go in the first stage, as
they are in no language; where no row has a lang, nothing can be learned and every
text with letters stays with the lang it has; null and repeated ids are rows like
others, and one row of each group of near copies stays; an empty or missing-text
benchmark removes nothing; very long texts are read whole; an empty table gives an
empty table; extra columns pass through, whatever their names, to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, decontaminate, jaccard, langid, pii
from brindle.llm.work import Work

WORDS, NUM, DEN = 5, 80, 100

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; their lang becomes the predicted one.

    One rule for texts of all lengths (langid.SHARE of the score expected)."""
    return langid.label(docs, langid.learn(docs.filter(~F.coalesce(langid.held_out(), F.lit(True)))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id."""
    return jaccard.keep_one(docs, WORDS, NUM, DEN)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, n_chars renewed."""
    return pii.redact(docs).withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document: doc_id, lang, source, n_chars, n_tokens, ids, and
    whether they decode to the text again."""
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "n_chars", "text"), bpe.default_vocabulary())
    exact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontamination", contamination),
    ("pii", personal_data),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage reads what the one before has written."""
    work, docs = Work(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = work.saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
