"""Corpus pipeline: language ID, near-duplicate removal, decontamination, secret
redaction, mixing.

STAGES lists (name, function).  A function takes (spark, docs, sf_dir) and returns
a DataFrame; all but the last return the columns of documents.  run() applies them
in order to the documents table.

Every stage works on all rows that it gets, whole, and gives an empty table for an empty
one.  Texts of any length are taken whole.  Columns beyond those that a stage names are
carried along, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tomeline.llm import crf_langid, decontamination, jaccard_join, mixing, secret_scan
from tomeline.llm.store import materialise

#: A text of which no language has this share is rejected, as is one without letters.
LEAST_LANGUAGE_SHARE = 0.4
#: Near copies share this percentage of their shingles of so many words.  The query op5_jaccard_join has its own values.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents with a recognised main language.

    Null or empty texts and those without letters go.  Null doc_id or lang, repeated rows
    and ties make no difference: each row is judged by its text alone, and equal texts alike.
    Without any labelled document nothing is recognised and all go."""
    rows = docs.select(F.struct(*_columns(docs)).alias("row"), "text")  # whatever the columns are called
    predicted = crf_langid.predict(rows, crf_langid.fit(docs), ["row"])
    return predicted.where((F.col("lang_pred") != crf_langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SHARE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keep the document with the least doc_id.

    Rows that repeat a doc_id are one document, of which the row that comes first by text and
    then by the other columns stays.  Rows with a null doc_id pass as they are, and so do
    texts without words, which are copies of nothing."""
    classes = materialise(jaccard_join.near_duplicate_classes(docs, NEAR_WORDS, NEAR_PERCENT), "classes")
    kept = docs.join(classes.where("component_id < doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*_columns(docs))
    repeated = materialise(classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    others = kept.join(repeated, "doc_id", "left_anti").select(*_columns(docs))
    row = F.struct(*_columns(docs))
    first = W.partitionBy("id").orderBy("said", "rest")
    again = kept.join(repeated, "doc_id", "left_semi").select(row.alias("row")).select("row", F.col("row.doc_id").alias("id"), F.col("row.text").alias("said"), F.to_json("row").alias("rest"))
    return others.unionByName(again.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item or an edited copy of one.

    All rows of such a doc_id go.  Null texts and rows with a null doc_id stay; so does
    everything if benchmark is empty or its items are null or too short for a seed."""
    leaks = decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*_columns(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace the secrets in the texts; all rows stay, and n_chars follows where a text changes.

    Null texts stay null.  Every row is handled by its own text, so null or repeated doc_ids
    make no difference."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes: doc_id, source, size, source_size, target, taken.

    Null source is a source, null text has no words and is not taken, and rows that repeat a
    doc_id are taken each for itself."""
    return mixing.taken_words(docs).where("taken > 0")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("mix_sources", mix_sources),
]

#: The stages learn, align and draw at random, which SQL can't express; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
