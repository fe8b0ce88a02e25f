"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant and all others as named users; masks are the stretches
of the text that the assistant is to learn, what they said and the end mark.

A dialogue is rendered in parts of TURNS turn numbers, so that a conversation
with any number of turns is many bounded rows, not one that grows.  More than
CROWD different rows in one part (repeated turn numbers) are cut into pieces of
CROWD rows each, in the order below, so that a piece is a stretch of the dialogue
too; piece 0 is the only one otherwise.

Defined results: order is turn (null first), then role, then text, by code point.
Fully equal rows count once.  Null role is the speaker 'unknown', null text is
empty.  Null conv_id is one conversation of its own.  Control marks inside texts and
names are written with a space after '<', so they can't end a turn.  Further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import materialise

TURNS = 64
CROWD = 512
END = "<|end|>"


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _cut(rows: DataFrame, crowd: int) -> DataFrame:
    """The rows of overfull parts with their piece.  Buckets of a range order hold
    neighbours, so a place in the part is the count of the buckets before and the place
    in the bucket: no task needs a whole part."""
    order = ["turn", "speaker", "text"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(rows.repartitionByRange(n, "conv", "part", *order).withColumn("bucket", F.spark_partition_id()), "crowded")
    sums = dealt.groupBy("conv", "part", "bucket").agg(F.count("*").alias("n"))
    base = sums.select("conv", "part", "bucket", (F.sum("n").over(W.partitionBy("conv", "part").orderBy("bucket")) - F.col("n")).alias("base"))
    inside = F.row_number().over(W.partitionBy("conv", "part", "bucket").orderBy(*order)) - 1
    placed = dealt.withColumn("inside", inside).join(base, ["conv", "part", "bucket"])
    return placed.withColumn("piece", F.floor((F.col("base") + F.col("inside")) / crowd)).select(*rows.columns, "piece")


def rotate(conversations: DataFrame, turns: int = TURNS, crowd: int = CROWD) -> DataFrame:
    """One row per conversation, speaker, part and piece: conv_id, speaker, part,
    piece, n_turns, text, masks (start, stop in code points, stop exclusive)."""
    c = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(_safe(F.col("role").cast("string")), F.lit("unknown")).alias("speaker"),
        F.coalesce(_safe(F.col("text").cast("string")), F.lit("")).alias("text"),
    ).distinct()
    c = c.withColumn("part", F.floor(F.coalesce("turn", F.lit(0)) / turns))
    # Only overfull parts are cut, and those are few.
    over = c.groupBy("conv", "part").agg(F.count("*").alias("rows")).where(F.col("rows") > crowd).select("conv", "part", F.lit(True).alias("over"))
    c = c.join(over, ["conv", "part"], "left")
    whole_parts = c.where("over is null").drop("over").withColumn("piece", F.lit(0).cast("long"))
    c = whole_parts.unionByName(_cut(c.where("over").drop("over"), crowd))
    parts = c.groupBy("conv", "conv_id", "part", "piece").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "text"))).alias("said"))
    speakers = c.select("conv", F.col("speaker").alias("me")).distinct()
    seen = parts.join(speakers, "conv")
    mine = lambda t: t["speaker"] == F.col("me")
    head = lambda t: F.when(mine(t), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), t["speaker"], F.lit("|>\n")))
    whole = F.concat_ws("", F.transform("said", lambda t: F.concat(head(t), t["text"], F.lit(END + "\n"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("masks"))
    body = lambda t: F.length(t["text"]) + len(END)
    masks = F.aggregate(
        "said",
        start,
        lambda acc, t: F.struct(
            (acc["at"] + F.length(head(t)) + body(t) + 1).alias("at"),
            F.when(mine(t), F.concat(acc["masks"], F.array(F.struct((acc["at"] + F.length(head(t))).alias("start"), (acc["at"] + F.length(head(t)) + body(t)).alias("stop"))))).otherwise(acc["masks"]).alias("masks"),
        ),
        lambda acc: acc["masks"],
    )
    return seen.select("conv_id", F.col("me").alias("speaker"), "part", "piece", F.size("said").alias("n_turns"), whole.alias("text"), masks.alias("masks"))


def op8_chat_rotation(spark, sf_dir: str) -> DataFrame:
    rows = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    written = F.concat_ws(",", F.transform("masks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["stop"].cast("string"))))
    return rows.select("conv_id", "speaker", "part", "piece", F.col("n_turns").cast("long").alias("n_turns"), "text", written.alias("masks"))


OP8_SQL = f"""
WITH c AS (
  SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), 'null') AS conv, turn,
         coalesce(replace(role, '<|', '< |'), 'unknown') AS speaker,
         coalesce(replace(text, '<|', '< |'), '') AS text,
         CAST(floor(coalesce(turn, 0) / {TURNS}) AS BIGINT) AS part
  FROM conversations),
p AS (SELECT *, CAST((row_number() OVER (PARTITION BY conv, part ORDER BY turn NULLS FIRST, speaker, text) - 1) // {CROWD} AS BIGINT) AS piece FROM c),
who AS (SELECT DISTINCT conv, speaker AS me FROM c),
s AS (
  SELECT p.*, me, speaker = me AS mine,
         CASE WHEN speaker = me THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || speaker || '|>' || chr(10) END AS head,
         text || '{END}' AS body
  FROM p JOIN who USING (conv)),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
         PARTITION BY conv, me, part, piece ORDER BY turn NULLS FIRST, speaker, text
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_
  FROM s)
SELECT conv_id, me AS speaker, part, piece, count(*) AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, speaker, text) AS text,
       coalesce(string_agg(CASE WHEN mine THEN CAST(CAST(at_ + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(at_ + length(head) + length(body) AS BIGINT) AS VARCHAR) END, ','
         ORDER BY turn NULLS FIRST, speaker, text), '') AS masks
FROM o GROUP BY conv, conv_id, me, part, piece
"""
