"""The corpus pipeline: language ID, one document of each near-duplicate group, repeated passages out, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. ``run`` writes each stage's
documents once to the shared folder and reads them back. Stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm.common import materialize, table
from vitrine.llm.jaccard import near_duplicates
from vitrine.llm.langid import label_documents, learn
from vitrine.llm.packing import pack
from vitrine.llm.queries import tokenizer
from vitrine.llm.suffixes import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that are of no one language: mean label probability under 0.4."""
    told = label_documents(docs.select(*COLUMNS), learn(docs))
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked at 0.8 on shingles of five words: that of the smallest id, then text hash; rows without an id come last.

    Rows are told apart by id and text, so other texts of a repeated id are judged by themselves. Of rows with one id (or
    none) and one text, one stays. Documents without words are otherwise no copies of each other."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("__k")
    found = near_duplicates(docs, k=5, num=80, den=100, keep_hash=True)
    lost = materialize(found.filter("not first").select(key("doc_id"), F.col("text_hash").alias("__h")).distinct(), "lost")
    kept = docs.select(*COLUMNS, key("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__h")).join(lost, ["__k", "__h"], "left_anti")
    ranked = kept.withColumn("__n", F.row_number().over(Window.partitionBy("__k", "__h").orderBy("lang", "source", "n_chars")))
    return ranked.filter("__n = 1").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of 200 bytes or more that stands at two places; n_chars follows the text."""
    done = remove_repeats(docs.select(*COLUMNS), keep_text=True).withColumnRenamed("kept_text", "text")
    return done.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 ids along the curve; a document that ended up empty has its end id only."""
    return pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("ngram_jaccard", one_of_each_group), ("suffix_dedup", repeated_passages), ("packing", packing)]

#: SQL can't express the learned first stage; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
