"""Which products a request may get: facts, candidates, evidence, rules, decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import sentences
from .matching import occurrences, with_terms
from .retrieval import product_match


def missing_facts(requests: DataFrame, requirements: DataFrame) -> DataFrame:
    """qid, missing: required slots of the objective (always, or when a slot has a value),
    less known ones, plus unsettled ones.  requests: qid, objective, known (map),
    unsettled (array); requirements: objective, slot, if_slot, if_value (small)."""
    j = requests.join(F.broadcast(requirements), "objective", "left")
    due = F.col("if_slot").isNull() | (F.try_element_at("known", "if_slot") == F.col("if_value"))
    need = F.when(due & ~F.map_contains_key("known", F.coalesce("slot", F.lit(""))), F.col("slot"))
    g = j.groupBy("qid").agg(F.collect_set(need).alias("need"), F.first("unsettled").alias("unsettled"))
    return g.select("qid", F.array_sort(F.array_union("need", "unsettled")).alias("missing"))


def discover(named: DataFrame, hits: DataFrame, proposals: DataFrame, registry: DataFrame, most: int = 8) -> DataFrame:
    """qid, product, rank: the named product, then products of hits by rank, then proposals;
    registry members only, the first most."""
    n = named.select("qid", "product", F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"))
    h = hits.select("qid", "product", F.lit(1).alias("a"), F.col("rank").cast("long").alias("b"))
    p = proposals.select("qid", "product", F.lit(2).alias("a"), F.col("nth").cast("long").alias("b"))
    one = n.unionByName(h).unionByName(p).join(registry.select("product"), "product", "left_semi").groupBy("qid", "product").agg(F.min(F.struct("a", "b")).alias("x"))
    return one.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("x", "product"))).where(F.col("rank") <= most).select("qid", "product", "rank")


def assess(candidates: DataFrame, properties: DataFrame, evidence: DataFrame, caveats: DataFrame, excluded: DataFrame) -> DataFrame:
    """qid, product, status, supported, unsupported.  properties: qid, property;
    evidence: property, product, passage_id (owned by the product); caveats and excluded: product.
    substrate unsupported: insufficient; another gap or a caveat: conditional."""
    want = candidates.join(properties, "qid")
    have = evidence.groupBy("product", "property").agg(F.count("*").alias("n"))
    g = want.join(have, ["product", "property"], "left").groupBy("qid", "product").agg(F.collect_set(F.when(F.col("n").isNotNull(), F.col("property"))).alias("supported"), F.collect_set(F.when(F.col("n").isNull(), F.col("property"))).alias("unsupported"))
    flag = lambda df, n: df.select("product", F.lit(True).alias(n)).distinct()
    j = g.join(flag(caveats, "caveat"), "product", "left").join(flag(excluded, "out"), "product", "left")
    status = F.when(F.col("out"), "incompatible").when(F.array_contains("unsupported", "substrate"), "insufficient").when((F.size("unsupported") > 0) | F.col("caveat"), "conditional").otherwise("supported")
    return j.select("qid", "product", status.alias("status"), F.array_sort("supported").alias("supported"), F.array_sort("unsupported").alias("unsupported"))


def compatible(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """qid, product, compatible (null without a rule: not permission), caveats of the first
    rule.  requests: qid, product, substrate, location (inside, outside or null);
    rules: nth, product, substrate, interior, exterior, recommended, caveats."""
    r = rules.select("nth", F.lower("product").alias("p"), F.lower("substrate").alias("s"), "interior", "exterior", "recommended", "caveats")
    j = requests.join(r, (F.lower("product") == F.col("p")) & (F.lower("substrate") == F.col("s")), "left")
    side = F.when(F.col("location") == "inside", F.col("interior")).when(F.col("location") == "outside", F.col("exterior")).otherwise(F.col("interior") | F.col("exterior"))
    g = j.groupBy("qid", "product").agg(F.min_by(F.struct((side & F.col("recommended")).alias("ok"), "caveats"), "nth").alias("x"))
    return g.select("qid", "product", F.col("x.ok").alias("compatible"), F.col("x.caveats").alias("caveats"))


def decide(missing: DataFrame, assessments: DataFrame) -> DataFrame:
    """qid, outcome, approved, rejected: missing facts first; then none approved, any fully
    supported, or conditional."""
    ok = F.col("status").isin("supported", "conditional")
    g = assessments.groupBy("qid").agg(F.array_sort(F.collect_set(F.when(ok, F.col("product")))).alias("approved"), F.array_sort(F.collect_set(F.when(~ok, F.col("product")))).alias("rejected"), F.bool_or(F.col("status") == "supported").alias("full"), F.bool_or(F.col("status") == "incompatible").alias("bad"))
    j = missing.join(g, "qid", "left")
    empty = F.array().cast("array<string>")
    outcome = F.when(F.size("missing") > 0, "missing facts").when(F.size(F.coalesce("approved", empty)) == 0, F.when(F.col("bad"), "none: incompatible").otherwise("none: unsupported")).when(F.col("full"), "supported").otherwise("conditional")
    return j.select("qid", outcome.alias("outcome"), F.coalesce("approved", empty).alias("approved"), F.coalesce("rejected", empty).alias("rejected"))


def recommended_products(answers: DataFrame, registry: DataFrame, phrases: str = "recommend|suitable|use ") -> DataFrame:
    """qid, product: registry products named in sentences that recommend."""
    s = answers.select("qid", F.explode(sentences(F.col("text"))).alias("text")).where(F.regexp_like(F.lower("text"), F.lit(phrases)))
    return with_terms(occurrences(s, registry.select("product")).select("qid", "term").distinct(), registry, "product").select("qid", "product").distinct()


def unapproved(answers: DataFrame, registry: DataFrame, decisions: DataFrame) -> DataFrame:
    """qid, product: registry products in the text that are neither approved nor part of an approved name."""
    found = occurrences(answers.select("qid", "text"), registry.select("product")).select("qid", "term").distinct()
    named = with_terms(found, registry, "product").select("qid", "product").distinct()
    j = named.join(decisions.select("qid", "approved"), "qid", "left")
    ok = F.exists(F.coalesce("approved", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), F.lower("product")))
    return j.where(~ok).select("qid", "product")


def owned(product: Column, other: Column) -> Column:
    return product_match(product, other)
