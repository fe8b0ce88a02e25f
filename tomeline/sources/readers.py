"""Readers: releases, pages, authored documents, submissions, rules, cases, expectations.

Schemas are declared, never inferred.  Bad rows are not dropped: readers that check
give (valid, quarantine), the latter with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIENCES = ("public", "trade", "staff")
FETCHED = "url string, path string, kind string, doc_type string, title string, link_text string, product string, status string, content_hash string, version int"
RELEASE = f"log struct<fetched:array<struct<{', '.join(x.replace(' ', ':') for x in FETCHED.split(', '))}>>, skipped:array<struct<url:string,reason:string>>, errors:array<struct<url:string,reason:string>>>, ledger map<string,struct<content_hash:string,version:int>>"
AUTHORED = "canonical_url string, title string, link_text string, document_type string, audience string, product string, source_date string, approved boolean, approved_by string, sections array<struct<heading:string,text:string>>, _corrupt string"


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The first reason of which the condition is not true, or null."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in rules])


def read_release(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """-> fetched, skipped, errors, ledger of the bundle named by the pointer file current.json."""
    pointer = spark.read.schema("bundle string").json(f"{path}/current.json").first()  # one row
    b = spark.read.schema(RELEASE).json(f"{path}/{pointer.bundle}", multiLine=True)
    rows = lambda c: b.select(F.explode(c).alias("x")).select("x.*")
    return rows("log.fetched"), rows("log.skipped"), rows("log.errors"), b.select(F.explode("ledger").alias("url", "x")).select("url", "x.*")


def read_pages(spark: SparkSession, path: str, glob: str = "*.html") -> DataFrame:
    """path, html of page files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", F.decode("content", "UTF-8").alias("html"))


def read_authored(spark: SparkSession, path: str, require_approval: bool = False) -> tuple[DataFrame, DataFrame]:
    """Authored JSON documents -> (valid, quarantine with reason)."""
    d = spark.read.schema(AUTHORED).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    again = d.where("canonical_url is not null").groupBy("canonical_url").agg(F.count("*").alias("same"))
    d = d.join(again, "canonical_url", "left")
    rules = [
        ("unreadable", F.col("_corrupt").isNull()),
        ("no canonical_url", F.trim("canonical_url") != ""),
        ("unknown audience", F.col("audience").isin(*AUDIENCES)),
        ("no sections", F.size("sections") > 0),
        ("blank section", F.forall("sections", lambda s: F.trim(s["text"]) != "")),
        ("repeated canonical_url", F.col("same") == 1),
    ]
    if require_approval:
        rules.append(("not approved", F.col("approved") & (F.trim("approved_by") != "")))
    d = d.withColumn("reason", first_reason(*rules)).drop("same", "_corrupt")
    return d.where("reason is null").drop("reason"), d.where("reason is not null")


def check_submissions(df: DataFrame) -> DataFrame:
    """Submissions with reason: required fields, approver and approval time (ends in Z and
    parses), confidence high, medium or low where given.  The first failing rule is the reason."""
    some = lambda c: F.trim(c) != ""
    moment = lambda c: F.col(c).endswith("Z") & F.try_to_timestamp(c).isNotNull()
    return df.withColumn(
        "reason",
        first_reason(
            ("no question", some("question")),
            ("no answer", some("answer")),
            ("no approver", some("approved_by")),
            ("approval time", moment("approved_at")),
            ("tags", F.col("tags").isNotNull()),
            ("confidence", F.col("confidence").isNull() | F.col("confidence").isin("high", "medium", "low")),
        ),
    )


def rule_tables(spark: SparkSession, text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested rule configuration (one JSON text) -> topics(nth, topic, pattern) and
    slots(slot, value, term); keys that start with _ are skipped."""
    j = text.select(F.from_json("json", "topics map<string,array<string>>, slots map<string,map<string,array<string>>>").alias("x"))
    named = lambda c: ~F.startswith(c, F.lit("_"))
    topics = j.select(F.posexplode(F.map_entries("x.topics")).alias("nth", "e")).select("nth", F.col("e.key").alias("topic"), F.explode("e.value").alias("pattern")).where(named("topic"))
    slots = j.select(F.explode("x.slots").alias("slot", "v")).select("slot", F.explode("v").alias("value", "t")).select("slot", "value", F.explode("t").alias("term")).where(named("slot") & named("value"))
    return topics, slots


def check_compat(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compatibility rules with defaults -> (valid, quarantine)."""
    true = lambda c: F.coalesce(c, F.lit(True)).alias(c)
    d = df.select("nth", "product", "substrate", true("interior"), true("exterior"), true("recommended"), F.coalesce("caveats", F.array().cast("array<string>")).alias("caveats"))
    d = d.withColumn("reason", first_reason(("no product", F.trim("product") != ""), ("no substrate", F.trim("substrate") != "")))
    return d.where("reason is null").drop("reason"), d.where("reason is not null")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Diagnosed cases below folders named by date; unreadable files are skipped."""
    schema = "case_id string, question string, expert_diagnosis string, advisor_id string, confidence_level string, tags array<string>, _corrupt string"
    d = spark.read.schema(schema).json(f"{path}/[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]/*.json", multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    d = d.withColumn("day", F.to_date(F.regexp_extract("_metadata.file_path", "/([0-9]{4}-[0-9]{2}-[0-9]{2})/", 1)))
    return d.where(F.col("_corrupt").isNull() & (F.trim("expert_diagnosis") != "")).drop("_corrupt")


def read_expectations(spark: SparkSession, path: str) -> DataFrame:
    """case_id, key, wanted of situation files: expect is a map of JSON values."""
    d = spark.read.schema("id string, question string, expect map<string,string>").json(path, multiLine=True)
    one = F.from_json("value", "array<string>")
    return d.select(F.col("id").alias("case_id"), F.explode("expect").alias("key", "value")).select("case_id", "key", F.when(F.startswith("value", F.lit("[")), one).otherwise(F.array("value")).alias("wanted"))


def read_acceptance(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Acceptance sets: CSV with a header, quotes, line breaks in cells and maybe a byte order mark."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', enforceSchema=True)
