"""Answer reuse, the case library and evaluation jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squash


# Answer reuse
def answer_key(question: Column, audiences: Column, snapshot: Column, slots: Column, history: Column) -> Column:
    """Digest of what an answer depends on; history may be empty."""
    pairs = F.transform(F.array_sort(F.map_entries(slots)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    past = F.when(history == "", "").otherwise(F.substring(F.sha2(history, 256), 1, 16))
    return F.sha2(F.concat_ws("\x1f", squash(question), F.array_join(F.array_sort(audiences), ","), snapshot, F.array_join(pairs, ","), past), 256)


def reuse_answers(questions: DataFrame, answered: DataFrame) -> DataFrame:
    """Questions with hit and the stored answer id; several questions of one key share it.  Both have key."""
    a = answered.groupBy("key").agg(F.max("answer_id").alias("answer_id"))
    return questions.join(a, "key", "left").withColumn("hit", F.col("answer_id").isNotNull())


def misses(questions: DataFrame, answered: DataFrame) -> DataFrame:
    return questions.select("key").distinct().join(answered.select("key"), "key", "left_anti")


def evict(answered: DataFrame, most: int = 256) -> DataFrame:
    """The most recently used keys."""
    return answered.orderBy(F.desc("used_at"), "key").limit(most)


# Case library
def capture_cases(rows: DataFrame) -> DataFrame:
    """Cases with a question, trimmed, images as digests, the day as partition.  rows:
    question, images (array of binary), chunk_ids, tags, at."""
    r = rows.where(F.trim("question") != "")
    return r.select(F.sha2(F.concat_ws("|", F.trim("question"), F.col("at").cast("string")), 256).alias("case_id"), F.trim("question").alias("question"), F.transform("images", lambda b: F.sha2(b, 256)).alias("image_hashes"), "chunk_ids", "tags", "at", F.to_date("at").alias("day"))


def record_diagnosis(cases: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """-> cases with the updates' diagnosis and advisor; updates of unknown cases."""
    u = updates.select("case_id", F.col("expert_diagnosis").alias("d"), F.col("advisor_id").alias("a"))
    out = cases.join(u, "case_id", "left").withColumns({"expert_diagnosis": F.coalesce("d", "expert_diagnosis"), "advisor_id": F.coalesce("a", "advisor_id")}).drop("d", "a")
    return out, updates.join(cases.select("case_id"), "case_id", "left_anti")


def case_tags(cases: DataFrame) -> DataFrame:
    """substrate, symptom and cause of the tags; the last of a kind wins."""
    last = lambda kind: F.substring(F.try_element_at(F.filter("tags", lambda t: F.startswith(t, F.lit(kind + "_"))), F.lit(-1)), len(kind) + 2, 1000).alias(kind)
    return cases.select("case_id", last("substrate"), last("symptom"), last("cause"))


def case_statistics(tags: DataFrame) -> DataFrame:
    """kind, value, n by grouping sets: total, substrate, symptom, cause."""
    kinds = ("substrate", "symptom", "cause")
    g = tags.groupingSets([[], *[[k] for k in kinds]], *kinds).agg(F.count("*").alias("n"), F.grouping_id(*kinds).alias("g"))
    kind = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "substrate").when(F.col("g") == 5, "symptom").otherwise("cause")
    return g.select(kind.alias("kind"), F.coalesce(*kinds).alias("value"), "n").where("kind = 'total' or value is not null")


def curate(cases: DataFrame) -> DataFrame:
    """Cases with an expert's diagnosis; confidence medium and advisor unknown by default."""
    return cases.where(F.trim("expert_diagnosis") != "").select("case_id", "question", "expert_diagnosis", F.coalesce("confidence_level", F.lit("medium")).alias("confidence_level"), F.coalesce("advisor_id", F.lit("unknown")).alias("advisor_id"))


# Evaluation
def check_expectations(results: DataFrame, expectations: DataFrame) -> DataFrame:
    """case_id, key, passed.  results: case_id, answer, path, step, refused, sources
    (array), slots (map); expectations: case_id, key, wanted (array of strings).
    Unknown keys and missing results fail."""
    j = expectations.join(results, "case_id", "left")
    low, wanted = F.lower(F.coalesce("answer", F.lit(""))), F.col("wanted")
    inside = lambda w: F.contains(low, F.lower(w))
    first = F.try_element_at(wanted, F.lit(1))
    passed = (
        F.when(F.col("answer").isNull(), False)
        .when(F.col("key") == "path_in", F.array_contains(wanted, F.col("path")))
        .when(F.col("key") == "step_in", F.array_contains(wanted, F.col("step")))
        .when(F.col("key") == "path_not_in", ~F.array_contains(wanted, F.col("path")))
        .when(F.col("key") == "refused", F.col("refused").cast("string") == first)
        .when(F.col("key") == "contains_all", F.forall(wanted, inside))
        .when(F.col("key") == "contains_any", F.exists(wanted, inside))
        .when(F.col("key") == "absent", ~F.exists(wanted, inside))
        .when(F.col("key") == "must_not_match", ~F.exists(wanted, lambda w: F.regexp_like(low, w)))
        .when(F.col("key") == "must_cite", F.regexp_like("answer", F.lit("\\[[0-9]+\\]")))
        .when(F.col("key") == "source_contains", F.exists(wanted, lambda w: F.exists("sources", lambda s: F.contains(s, w))))
        .when(F.col("key") == "min_documents", F.size(F.array_distinct("sources")) >= first.try_cast("int"))
        .when(F.col("key") == "slots_include", F.forall(wanted, lambda w: F.coalesce(F.try_element_at("slots", F.substring_index(w, "=", 1)) == F.substring_index(w, "=", -1), F.lit(False))))
        .when(F.col("key") == "slots_exclude", F.forall(wanted, lambda w: ~F.map_contains_key("slots", w)))
        .otherwise(False)
    )
    return j.select("case_id", "key", F.coalesce(passed, F.lit(False)).alias("passed"))


def check_probes(results: DataFrame, probes: DataFrame, known_phones: list[str]) -> DataFrame:
    """probe_id, fault (null if none).  probes: probe_id, banned, wanted_any, restricted (url
    prefix), must_refuse; results: probe_id, answer, refused, sources."""
    j = probes.join(results, "probe_id", "left")
    low = F.lower("answer")
    phones = F.array_except(F.transform(F.regexp_extract_all("answer", F.lit("\\+?[0-9][0-9 ]{8,}[0-9]"), F.lit(0)), lambda p: F.replace(p, F.lit(" "), F.lit(""))), F.array(*map(F.lit, known_phones)))
    fault = (
        F.when(F.col("answer").isNull(), "no result")
        .when(F.exists("banned", lambda b: F.contains(low, F.lower(b))), "banned text")
        .when(F.col("must_refuse") & ~F.col("refused"), "not refused")
        .when((F.size("wanted_any") > 0) & ~F.exists("wanted_any", lambda w: F.contains(low, F.lower(w))), "nothing wanted")
        .when((F.col("restricted") != "") & F.exists("sources", lambda s: F.startswith(s, F.col("restricted"))), "restricted source")
        .when(F.size(phones) > 0, "unknown phone number")
    )
    return j.select("probe_id", fault.alias("fault"))


def audience_leak(public: DataFrame, restricted: DataFrame) -> DataFrame:
    """Hits of the public run that only restricted audiences may see: there must be none."""
    return public.join(restricted.select("passage_id"), "passage_id", "left_semi")


def gold_metrics(results: DataFrame) -> DataFrame:
    """expected, total, passed, over_refusals, unsupported.  results: case_id, expected (answer
    or abstain), answered, supported."""
    ok = F.when(F.col("expected") == "answer", F.col("answered") & F.col("supported")).otherwise(~F.col("answered"))
    return results.groupBy("expected").agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.count_if((F.col("expected") == "answer") & ~F.col("answered")).alias("over_refusals"), F.count_if(F.col("answered") & ~F.col("supported")).alias("unsupported"))


def threshold_sweep(scored: DataFrame, values: list[float]) -> DataFrame:
    """threshold, answered, refused, wrongly_refused, wrongly_admitted; inclusive; one pass.  scored: score, answerable."""
    yes = F.col("answerable")
    row = lambda v: F.struct(F.lit(v).alias("threshold"), F.count_if(F.col("score") >= v).alias("answered"), F.count_if(F.col("score") < v).alias("refused"), F.count_if(yes & (F.col("score") < v)).alias("wrongly_refused"), F.count_if(~yes & (F.col("score") >= v)).alias("wrongly_admitted"))
    return scored.agg(F.array(*[row(v) for v in values]).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def evidence_coverage(decisions: DataFrame, met: DataFrame) -> DataFrame:
    """path, n, covered: share of questions whose asked terms are in the evidence, by route."""
    return decisions.join(met, "qid").groupBy("path").agg(F.count("*").alias("n"), F.round(F.avg(F.col("met").cast("double")), 6).alias("covered"))


def near_misses(top: DataFrame, met: DataFrame, threshold: float) -> DataFrame:
    """Questions above the threshold whose asked terms are absent."""
    return top.where(F.col("top_score") >= threshold).join(met.where("not met"), "qid").select("qid", "top_score")


def readiness(snapshot: DataFrame, passages: DataFrame, dims: int, chunking: str) -> DataFrame:
    """One row of booleans and their conjunction."""
    s = snapshot.where("is_active").agg((F.count("*") == 1).alias("active_snapshot"), F.coalesce(F.max("embedding_dimensions") == dims, F.lit(False)).alias("dimensions_match"), F.coalesce(F.max("chunking_version") == chunking, F.lit(False)).alias("chunking_match"))
    p = passages.agg((F.count("*") > 0).alias("live_chunks"))
    return s.crossJoin(p).withColumn("ready", reduce(lambda a, b: a & b, [F.col(c) for c in ("active_snapshot", "dimensions_match", "chunking_match", "live_chunks")]))
