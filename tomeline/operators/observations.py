"""Image observations: parsing, matching, resolving, certainty and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import whole_word

HIGH, UNCERTAIN, LIKELY = 0.80, 0.50, 0.65
COUNTED = ("substrate", "existing_finish", "location", "exposure")


def confidence(text: Column) -> Column:
    """A band's floor, a share from 0 to 1, or a whole percentage from 2 to 100; else null."""
    t = F.lower(F.trim(text))
    n = F.expr("try_cast(trim(confidence) as double)")
    return F.when(t == "high", HIGH).when(t == "uncertain", UNCERTAIN).when(t == "low", 0.0).when((n >= 0) & (n <= 1), n).when((n >= 2) & (n <= 100) & (n == F.floor(n)), n / 100)


def parse_observations(obs: DataFrame, attributes=COUNTED) -> DataFrame:
    """Known attributes with a value; confidence as a number (null: rejected); regions
    that are four numbers in 0..1 with positive size, else null."""
    r = F.col("region")
    good = (F.size(r) == 4) & F.forall(r, lambda v: (v >= 0) & (v <= 1)) & (F.try_element_at(r, F.lit(3)) > F.try_element_at(r, F.lit(1))) & (F.try_element_at(r, F.lit(4)) > F.try_element_at(r, F.lit(2)))
    o = obs.where(F.col("attribute").isin(*attributes) & (F.trim("value") != ""))
    return o.withColumns({"confidence": confidence(F.col("confidence")), "region": F.when(good, r)})


def band(c: Column) -> Column:
    return F.when(c >= HIGH, "HIGH").when(c >= UNCERTAIN, "UNCERTAIN").otherwise("NOT_DETERMINABLE")


def match_value(obs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """obs_id, matched, reason: the one vocabulary value of which a term is in the text; none or several are rejected."""
    v = F.broadcast(vocabulary.select("attribute", F.col("value").alias("word"), "term"))
    hit = obs.join(v, "attribute").where(whole_word(F.col("value"), F.col("term"))).groupBy("obs_id").agg(F.collect_set("word").alias("words"))
    j = obs.select("obs_id").join(hit, "obs_id", "left").withColumn("n", F.coalesce(F.size("words"), F.lit(0)))
    return j.select("obs_id", F.when(F.col("n") == 1, F.element_at("words", 1)).alias("matched"), F.when(F.col("n") < 1, "no known value").when(F.col("n") > 1, "several values").alias("reason"))


def resolve_observations(obs: DataFrame) -> DataFrame:
    """image, attribute, status, value, confidence, withheld from parsed observations.

    Only HIGH rows with a region decide; two values conflict; else the best
    confidence.  Substrate is withheld where a finish is seen on the same image."""
    strong = obs.where((F.col("confidence") >= HIGH) & F.col("region").isNotNull())
    s = strong.groupBy("image", "attribute").agg(F.count_distinct("value").alias("values"), F.max(F.struct("confidence", "value")).alias("x"))
    weak = obs.where("confidence is not null").groupBy("image", "attribute").agg(F.max(F.struct("confidence", "value")).alias("w"))
    finish = s.where("attribute = 'existing_finish'").select("image", F.lit(True).alias("finish"))
    j = weak.join(s, ["image", "attribute"], "left").join(finish, "image", "left")
    status = F.when(F.col("values") > 1, "conflicting").when(F.col("values") == 1, "confirmed").otherwise("not determinable")
    value = F.when(F.col("values") > 1, None).when(F.col("values") == 1, F.col("x.value")).otherwise(F.col("w.value"))
    return j.select("image", "attribute", status.alias("status"), value.alias("value"), F.coalesce("x.confidence", "w.confidence").alias("confidence"), ((F.col("attribute") == "substrate") & F.coalesce("finish", F.lit(False))).alias("withheld"))


def certainty(resolved: DataFrame) -> DataFrame:
    c = F.when((F.col("status") == "confirmed") & ~F.col("withheld"), "OBSERVED").when(F.col("status") == "conflicting", "UNCERTAIN").when(F.col("status") == "not determinable", F.when(F.col("confidence") >= LIKELY, "LIKELY").otherwise("CANNOT_DETERMINE")).when(F.col("confidence") >= LIKELY, "LIKELY").otherwise("UNCERTAIN")
    return resolved.withColumn("certainty", c)


def score_observations(resolved: DataFrame, forbidden: DataFrame, safe: DataFrame) -> DataFrame:
    """image, dangerous_routed, dangerous_reported, safe_hits, safe_misses.

    forbidden: image, rule ('attribute' or 'attribute=v1|v2'); safe: image, attribute, value."""
    f = forbidden.select("image", F.substring_index("rule", "=", 1).alias("attribute"), F.when(F.contains("rule", F.lit("=")), F.split(F.substring_index("rule", "=", -1), "\\|")).alias("bad"))
    r = resolved.where("value is not null")
    hit = r.join(f, ["image", "attribute"]).where(F.col("bad").isNull() | F.expr("array_contains(bad, value)")).groupBy("image").agg(F.count_if(F.col("certainty") == "OBSERVED").alias("dangerous_routed"), F.count("*").alias("dangerous_reported"))
    s = safe.join(r.select("image", "attribute", "value", F.lit(1).alias("seen")), ["image", "attribute", "value"], "left").groupBy("image").agg(F.count("seen").alias("safe_hits"), (F.count("*") - F.count("seen")).alias("safe_misses"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return hit.join(s, "image", "full").select("image", *map(zero, ("dangerous_routed", "dangerous_reported", "safe_hits", "safe_misses")))
