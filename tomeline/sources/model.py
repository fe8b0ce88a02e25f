"""The engine's tables derived from the driver's parquet tables.

Each view exists as a Spark DataFrame and, for the SQL twins, as the text of a
DuckDB common table expression; both mean the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATHS = ["compose", "extract", "ask_back", "diagnosis", "topic_gate", "refuse", "state", "elsewhere"]
SPAN_NAMES = {"view": "part", "click": "retrieval", "error": "generation", "purchase": "checks", "signup": "cache_lookup"}
SOURCES = ["cli", "Web", "evaluation", "unknown", "kiosk"]
TYPES = ["datasheet", "guide", "commercial", "product_page", "faq", "staff_note"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index):
    """values[index] as a column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _sql_pick(values: list[str], index: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST({index} AS INT) + 1]"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace spans from events."""
    e = _table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    name = F.create_map(*[F.lit(x) for kv in SPAN_NAMES.items() for x in kv])
    return e.select(
        F.col("event_id").alias("span_id"),
        F.expr("event_id div 5").alias("trace_id"),
        F.expr("CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 <= 2 THEN event_id - event_id % 5 ELSE event_id - 2 END").alias("parent_id"),
        F.coalesce(F.try_element_at(name, F.col("event_type")), F.lit("odd one")).alias("name"),
        F.col("ts").cast("timestamp").alias("started_at"),
        F.when(F.col("event_id") % 97 == 0, -F.round(F.col("value") * 10)).otherwise(F.round(F.col("value") * 10)).alias("duration_ms"),
        F.col("user_id").alias("session_id"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        pick(SOURCES, F.col("user_id") % 5).alias("source"),
        (k / 100.0).cast("double").alias("top_score"),
        pick(PATHS, k % 8).alias("path"),
        (k % 2 == 0).alias("hit"),
        F.when(k % 3 == 0, F.array(F.concat(F.lit("check "), (k % 9).cast("string")))).alias("failed"),
        k.alias("k"),
    )


_NAME_CASE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPAN_NAMES.items()) + " ELSE 'odd one' END"
SPANS = f"""spans AS (
  SELECT event_id AS span_id, event_id // 5 AS trace_id,
    CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 <= 2 THEN event_id - event_id % 5 ELSE event_id - 2 END AS parent_id,
    {_NAME_CASE} AS name, ts AS started_at,
    CASE WHEN event_id % 97 = 0 THEN -round(value * 10) ELSE round(value * 10) END AS duration_ms,
    user_id AS session_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
    {_sql_pick(SOURCES, 'user_id % 5')} AS source, k / 100.0::DOUBLE AS top_score, {_sql_pick(PATHS, 'k % 8')} AS path,
    k % 2 = 0 AS hit, CASE WHEN k % 3 = 0 THEN ['check ' || CAST(k % 9 AS VARCHAR)] END AS failed, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded passages: every row of documents with its whole text, four of them to a
    document served, each with the vector whose number is its own, counted round."""
    v = _table(spark, sf_dir, "embeddings")
    n = v.agg(F.count("*").alias("vectors"))  # one number
    d = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.expr("doc_id div 4").alias("doc_no")).crossJoin(F.broadcast(n))
    return d.join(v, F.col("doc_id") % F.col("vectors") == F.col("vec_id")).select(
        F.concat(F.lit("doc://"), F.col("doc_no").cast("string")).alias("canonical_url"),
        F.lit(1).cast("long").alias("version"),
        (F.col("doc_id") % 4).alias("chunk_index"),
        F.concat(F.lit("p"), F.col("label").cast("string")).alias("product"),
        (F.col("doc_no") % 6 + 1).alias("authority"),
        pick(TYPES, F.col("doc_no") % 6).alias("document_type"),
        F.when(F.col("doc_no") % 10 == 0, "staff").when(F.col("doc_no") % 10 <= 2, "trade").otherwise("public").alias("audience"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_no") % 28).cast("int")).alias("source_date"),
        F.concat(F.lit("Section "), (F.col("doc_id") % 7).cast("string")).alias("section"),
        "content",
        "embedding",
        F.col("doc_id").alias("passage_id"),
    )


PASSAGES = f"""passages AS (
  SELECT 'doc://' || CAST(doc_id // 4 AS VARCHAR) AS canonical_url, CAST(1 AS BIGINT) AS version, doc_id % 4 AS chunk_index,
    'p' || CAST(label AS VARCHAR) AS product, doc_id // 4 % 6 + 1 AS authority, {_sql_pick(TYPES, 'doc_id // 4 % 6')} AS document_type,
    CASE WHEN doc_id // 4 % 10 = 0 THEN 'staff' WHEN doc_id // 4 % 10 <= 2 THEN 'trade' ELSE 'public' END AS audience,
    DATE '2024-01-01' + CAST(doc_id // 4 % 28 AS INT) AS source_date, 'Section ' || CAST(doc_id % 7 AS VARCHAR) AS section,
    text AS content, embedding, doc_id AS passage_id
  FROM documents JOIN embeddings ON doc_id % (SELECT count(*) FROM embeddings) = vec_id)"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval requests: every 25th vector."""
    return (
        _table(spark, sf_dir, "embeddings")
        .where("vec_id % 25 = 0")
        .select(
            F.col("vec_id").alias("qid"),
            "embedding",
            F.when(F.col("vec_id") % 3 == 0, F.array(F.lit("public"))).when(F.col("vec_id") % 3 == 1, F.array(F.lit("public"), F.lit("trade"))).otherwise(F.array(F.lit("public"), F.lit("trade"), F.lit("staff"))).alias("audiences"),
            F.when(F.col("vec_id") % 50 == 0, F.concat(F.lit("p"), F.col("label").cast("string"))).otherwise("").alias("product"),
        )
    )


QUERIES = """queries AS (
  SELECT vec_id AS qid, embedding,
    CASE vec_id % 3 WHEN 0 THEN ['public'] WHEN 1 THEN ['public', 'trade'] ELSE ['public', 'trade', 'staff'] END AS audiences,
    CASE WHEN vec_id % 50 = 0 THEN 'p' || CAST(label AS VARCHAR) ELSE '' END AS product
  FROM embeddings WHERE vec_id % 25 = 0)"""


def release(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Fetched pages of release A or B: url, html, content_hash, version, document_type."""
    p = _table(spark, sf_dir, "pages")
    if which == "A":
        p = p.where("page_id % 10 != 1")
    else:
        p = p.where("page_id % 10 != 0").withColumn("html", F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit("<p>rev 2</p>"))).otherwise(F.col("html")))
    return p.select("page_id", "url", "html", F.sha2("html", 256).alias("content_hash"), pick(TYPES, F.col("page_id") % 6).alias("document_type"))


RELEASES = f"""release_a AS (
  SELECT page_id, url, html, sha256(html) AS content_hash, {_sql_pick(TYPES, 'page_id % 6')} AS document_type FROM pages WHERE page_id % 10 != 1),
release_b AS (
  SELECT page_id, url, html, sha256(html) AS content_hash, document_type FROM (
    SELECT page_id, url, CASE WHEN page_id % 7 = 0 THEN html || '<p>rev 2</p>' ELSE html END AS html, {_sql_pick(TYPES, 'page_id % 6')} AS document_type
    FROM pages WHERE page_id % 10 != 0))"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with a time: 20 minutes apart, a gap of two hours before turn 4."""
    c = _table(spark, sf_dir, "conversations")
    at = F.expr("timestampadd(MINUTE, cast(conv_id * 60 + turn * 20 + CASE WHEN turn >= 4 THEN 120 ELSE 0 END as int), timestamp'2024-01-01 00:00:00')")
    return c.select("conv_id", "turn", "role", "text", at.alias("at"))


TURNS = """turns AS (
  SELECT conv_id, turn, role, text, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id * 60 + turn * 20 + CASE WHEN turn >= 4 THEN 120 ELSE 0 END AS BIGINT)) AS at
  FROM conversations)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions: benchmark items and user turns, in one line each, with a question mark."""
    b = _table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("qid"), "text")
    c = _table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("qid"), "text")
    return b.unionByName(c)


QUESTIONS = """questions AS (
  SELECT 'b' || CAST(item_id AS VARCHAR) AS qid, text FROM benchmark
  UNION ALL SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text FROM conversations WHERE role = 'user')"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnosis cases from error events."""
    e = _table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    tag = lambda kind, n: F.concat(F.lit(kind + "_"), (F.col("k") % n).cast("string"))
    return e.select(
        F.col("event_id").alias("case_id"),
        F.concat(F.lit("question "), F.col("user_id").cast("string")).alias("question"),
        F.col("ts").cast("timestamp").alias("at"),
        F.when(F.col("k") % 11 == 0, F.array(tag("symptom", 3))).otherwise(F.array(tag("substrate", 4), tag("symptom", 3), tag("cause", 5), tag("substrate", 3))).alias("tags"),
        F.when(F.col("k") % 6 == 0, None).otherwise(F.concat(F.lit("diagnosis "), (F.col("k") % 5).cast("string"))).alias("expert_diagnosis"),
        F.when(F.col("k") % 4 == 0, None).otherwise("high").alias("confidence_level"),
        F.when(F.col("k") % 5 == 0, None).otherwise(F.concat(F.lit("advisor "), (F.col("user_id") % 7).cast("string"))).alias("advisor_id"),
    )


CASES = """cases AS (
  SELECT event_id AS case_id, 'question ' || CAST(user_id AS VARCHAR) AS question, ts AS at,
    CASE WHEN k % 11 = 0 THEN ['symptom_' || CAST(k % 3 AS VARCHAR)] ELSE ['substrate_' || CAST(k % 4 AS VARCHAR), 'symptom_' || CAST(k % 3 AS VARCHAR), 'cause_' || CAST(k % 5 AS VARCHAR), 'substrate_' || CAST(k % 3 AS VARCHAR)] END AS tags,
    CASE WHEN k % 6 != 0 THEN 'diagnosis ' || CAST(k % 5 AS VARCHAR) END AS expert_diagnosis,
    CASE WHEN k % 4 != 0 THEN 'high' END AS confidence_level,
    CASE WHEN k % 5 != 0 THEN 'advisor ' || CAST(user_id % 7 AS VARCHAR) END AS advisor_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type = 'error'))"""

ATTRIBUTES = ["substrate", "existing_finish", "location", "exposure"]


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image observations: image, attribute, value, confidence (text), region."""
    e = _table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.select(
        F.col("event_id").alias("obs_id"),
        F.col("user_id").alias("image"),
        pick(ATTRIBUTES, F.col("k") % 4).alias("attribute"),
        F.concat(F.lit("value "), (F.col("k") % 3).cast("string")).alias("value"),
        F.when(F.col("k") % 10 == 0, "high").otherwise(F.col("k").cast("string")).alias("confidence"),
        F.when(F.col("k") % 7 == 0, None).otherwise(F.array(F.lit(0.1), F.lit(0.1), (F.col("k") / 100.0).cast("double"), F.lit(0.9))).alias("region"),
    )


OBSERVATIONS = f"""observations AS (
  SELECT event_id AS obs_id, user_id AS image, {_sql_pick(ATTRIBUTES, 'k % 4')} AS attribute, 'value ' || CAST(k % 3 AS VARCHAR) AS value,
    CASE WHEN k % 10 = 0 THEN 'high' ELSE CAST(k AS VARCHAR) END AS confidence,
    CASE WHEN k % 7 != 0 THEN [0.1::DOUBLE, 0.1::DOUBLE, k / 100.0::DOUBLE, 0.9::DOUBLE] END AS region
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""
