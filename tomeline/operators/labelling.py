"""Labels of questions: topics, slots, intents, products, routes.

Vocabularies are tables of any size, which the dictionary matcher reads in shards; patterns are
short lists that become literal expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import MARK, sentences, words
from .matching import longest, occurrences, with_terms


def topic_gate(questions: DataFrame, topics: list[tuple[str, str]], source_only: str | None = None) -> DataFrame:
    """qid, topic: the first topic of the ordered (topic, pattern) list that matches.
    Source-only instructions are taken out before, unless nothing would remain."""
    text = F.lower("text")
    if source_only:
        rest = F.trim(F.regexp_replace(text, source_only, ""))
        text = F.when(rest != "", rest).otherwise(text)
    topic = F.lit(None).cast("string")
    for name, pattern in reversed(topics):
        topic = F.when(F.regexp_like(text, F.lit(pattern)), name).otherwise(topic)
    return questions.select("qid", topic.alias("topic"))


def split_questions(questions: DataFrame, topics: list[tuple[str, str]], opener: str = "what|how|can|is|the", least: int = 3) -> DataFrame:
    """qid, nth, part.  A question is split after . ? ; and before 'and' + a question
    word; the split holds only if its parts differ in topic (or in having one)."""
    marked = F.regexp_replace(F.regexp_replace("text", "([.?;])[ \\t\\r\\n]+", "$1" + MARK), f"(?i) and ({opener}) ", MARK + "$1 ")
    parts = F.filter(F.split(marked, MARK), lambda p: F.size(words(p)) >= least)
    x = questions.select("qid", "text", F.posexplode_outer(parts).alias("nth", "part"))
    topic = F.lit("none")
    for name, pattern in reversed(topics):
        topic = F.when(F.regexp_like(F.lower("part"), F.lit(pattern)), name).otherwise(topic)
    x = x.withColumn("topic", topic)
    keep = F.size(F.collect_set("topic").over(W.partitionBy("qid"))) > 1
    x = x.withColumn("keep", keep)
    whole = questions.join(x.where("keep").select("qid").distinct(), "qid", "left_anti").select("qid", F.lit(0).cast("long").alias("nth"), F.col("text").alias("part"))
    return x.where("keep").select("qid", F.col("nth").cast("long").alias("nth"), "part").unionByName(whole)


def slot_scores(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """qid, slot, value, score: sum of the lengths of the whole-word terms found.
    vocabulary: slot, value, term, ask_only.  Ask-only terms count only where the
    value's own terms score nothing."""
    found = occurrences(questions.select("qid", "text"), vocabulary.select("term")).select("qid", "term").distinct()
    hit = with_terms(found, vocabulary.distinct(), "term")
    g = hit.groupBy("qid", "slot", "value").agg(F.sum(F.when(~F.col("ask_only"), F.length("term"))).alias("own"), F.sum(F.when(F.col("ask_only"), F.length("term"))).alias("asked"))
    return g.select("qid", "slot", "value", F.coalesce("own", "asked").alias("score"), F.col("own").isNull().alias("ask_only"))


def detect_slots(scores: DataFrame) -> DataFrame:
    """The best value of each slot, by score, then value, descending."""
    best = F.row_number().over(W.partitionBy("qid", "slot").orderBy(F.desc("score"), F.desc("value")))
    return scores.withColumn("n", best).where("n = 1").select("qid", "slot", "value", "score")


def all_properties(scores: DataFrame, slot: str) -> DataFrame:
    order = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), F.desc("value")))
    return scores.where(F.col("slot") == slot).select("qid", "value", "score", order.alias("rank"))


def primary_properties(scores: DataFrame, slot: str) -> DataFrame:
    """Properties with at least half the leader's score; ask-only ones only if they lead."""
    top = F.max("score").over(W.partitionBy("qid"))
    s = scores.where(F.col("slot") == slot).withColumn("top", top)
    return s.where((2 * F.col("score") >= F.col("top")) & (~F.col("ask_only") | (F.col("score") == F.col("top")))).select("qid", "value", "score")


def measurements(questions: DataFrame, largest_area: float = 10_000.0) -> DataFrame:
    """First area (m2) and thickness (mm) in a text, within their bounds."""
    number = lambda pattern: F.expr(f"try_cast(regexp_extract(lower(text), r'{pattern}', 1) as double)")
    area, thick = number("([0-9]+(?:[.][0-9]+)?) ?(?:m2|sqm|square met)"), number("([0-9]+(?:[.][0-9]+)?) ?mm")
    return questions.select("qid", F.when((area > 0) & (area <= largest_area), area).alias("area"), F.when((thick > 0) & (thick <= 500), thick).alias("thickness"))


def product_aliases(registry: DataFrame, brand: str, generic: list[str]) -> DataFrame:
    """alias, product: names without the brand, and first words that belong to one product only."""
    name = F.trim(F.regexp_replace(F.lower("product"), f"^{brand} ", ""))
    full = registry.select(name.alias("alias"), "product")
    head = full.select(F.substring_index("alias", " ", 1).alias("head"), "product")
    single = head.where(~F.col("head").isin(*generic)).groupBy("head").agg(F.count_distinct("product").alias("n"), F.min("product").alias("product")).where("n = 1").select(F.col("head").alias("alias"), "product")
    return full.unionByName(single).distinct()


def mentions(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """qid, product: products of which an alias stands in the text as whole words; where a
    longer alias stands, those inside it don't count."""
    found = longest(occurrences(texts.select("qid", "text"), aliases.select("alias")), "qid").select("qid", "term").distinct()
    return with_terms(found, aliases, "alias").select("qid", "product").distinct()


def reference_text(text: Column, aside: str) -> Column:
    """Text without quotations and without hypothetical or negated sentences."""
    return F.concat_ws(" ", F.filter(sentences(F.regexp_replace(text, '"[^"]*"', " ")), lambda s: ~F.regexp_like(F.lower(s), F.lit(aside))))


def asserted_text(text: Column, aside: str, requests: str) -> Column:
    return F.concat_ws(" ", F.filter(sentences(reference_text(text, aside)), lambda s: ~(F.regexp_like(F.lower(s), F.lit(requests)) | s.endswith("?"))))


def scenario_only(text: Column, opener: str, suited: str, claim: str) -> Column:
    low = F.lower(text)
    return F.regexp_like(low, F.lit(opener)) & F.regexp_like(low, F.lit(suited)) & ~F.regexp_like(low, F.lit(claim))


def denied_slots(questions: DataFrame, vocabulary: DataFrame, negation: str = "not|no|never|without") -> DataFrame:
    """qid, slot, value where every occurrence of the value's terms is shortly after a negation."""
    found = with_terms(occurrences(questions.select("qid", "text"), vocabulary.select("term"), before=3), vocabulary.distinct(), "term")
    negated = F.exists("before", lambda w: F.regexp_like(w, F.lit(f"^(?:{negation})$")))
    return found.groupBy("qid", "slot", "value").agg(F.count("*").alias("n"), F.count_if(negated).alias("negated")).where("n = negated").select("qid", "slot", "value")


def intent(questions: DataFrame, gate: DataFrame, rules: list[tuple[str, str]], default: str = "unknown") -> DataFrame:
    """escalate where a topic was found, else the first rule (intent, pattern) that matches."""
    kind = F.lit(default)
    for name, pattern in reversed(rules):
        kind = F.when(F.regexp_like(F.lower("text"), F.lit(pattern)), name).otherwise(kind)
    return questions.join(gate, "qid", "left").select("qid", F.when(F.col("topic").isNotNull(), "escalate").otherwise(kind).alias("intent"))


def compares_products(questions: DataFrame, aliases: DataFrame, words_: str = "versus|compare|better than|difference", choice: str = "should i|which", alternative: str = "or", window: int = 3) -> DataFrame:
    """qid, compares, topic_product, compared.

    A question compares if it has an explicit comparison anywhere, or the alternative word
    with a product within window words of it.  The one product named where nothing is
    compared is the topic; two or more named in an explicit comparison without a word of
    choice are the compared ones (sorted).  aliases: alias, product."""
    n = mentions(questions, aliases).groupBy("qid").agg(F.array_sort(F.collect_set("product")).alias("named"))
    w = F.split(F.trim("text"), "[ \\t\\r\\n]+")
    bare = F.transform("w", lambda x: F.regexp_replace(F.lower(x), "^[,.;:?!]+|[,.;:?!]+$", ""))
    beside = lambda i: F.concat_ws(" ", F.slice("w", F.greatest(F.lit(1), i - window), F.least(i - 1, F.lit(window))), F.slice("w", i + 1, window))
    at = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: F.element_at("bare", i) == alternative)
    q = questions.select("qid", "text", w.alias("w")).withColumn("bare", bare).select("qid", "text", F.transform(at, beside).alias("around"))
    near = occurrences(q.select("qid", F.explode("around").alias("text")), aliases.select("alias")).select("qid").distinct().withColumn("near", F.lit(True))
    explicit = F.regexp_like(F.lower("text"), F.lit(words_))
    j = q.join(n, "qid", "left").join(near, "qid", "left").withColumn("named", F.coalesce("named", F.array().cast("array<string>")))
    compares = explicit | F.coalesce("near", F.lit(False))
    sides = explicit & ~F.regexp_like(F.lower("text"), F.lit(choice)) & (F.size("named") >= 2)
    return j.select("qid", compares.alias("compares"), F.when(~compares & (F.size("named") == 1), F.element_at("named", 1)).alias("topic_product"), F.when(sides, F.col("named")).otherwise(F.array().cast("array<string>")).alias("compared"))


def asked_terms(questions: DataFrame, properties: DataFrame, terms: DataFrame, phrase: str) -> DataFrame:
    """qid, terms: the terms of the detected properties, else the noun phrase that a pattern finds."""
    own = properties.join(terms, properties["value"] == terms["property"]).groupBy("qid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("own"))
    noun = F.regexp_extract(F.lower("text"), phrase, 1)
    return questions.join(own, "qid", "left").select("qid", F.coalesce("own", F.when(noun != "", F.array(noun)).otherwise(F.array().cast("array<string>"))).alias("terms"))


def asked_substrate(questions: DataFrame, slots: DataFrame, classes: DataFrame) -> DataFrame:
    """qid, substrate, published: the slot's value, else the word after on, onto, over or
    against; with its published class.  classes: substrate, published."""
    word = F.regexp_extract(F.lower("text"), "(?:^| )(?:on|onto|over|against) ([a-z]+)", 1)
    s = slots.where("slot = 'substrate'").select("qid", "value")
    j = questions.join(s, "qid", "left").select("qid", F.coalesce("value", F.nullif(word, F.lit(""))).alias("substrate"))
    return j.join(classes, "substrate", "left").select("qid", "substrate", "published")


def is_deferral(hits: DataFrame, pattern: str) -> DataFrame:
    return hits.where("rank = 1").select("qid", F.regexp_like(F.lower("content"), F.lit(pattern)).alias("defers"))


def relevance_gate(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, met: any asked term stands in any hit (no terms: met).  asked: qid, terms."""
    j = asked.join(hits.select("qid", F.lower(F.concat_ws("\n", "section", "content")).alias("body")), "qid", "left")
    met = F.exists("terms", lambda t: F.contains(F.coalesce("body", F.lit("")), F.lower(t)))
    return j.groupBy("qid").agg(F.max((F.size("terms") == 0) | met).alias("met"))


def route(facts: DataFrame) -> DataFrame:
    """qid, path, step from boolean facts, in this order: below the threshold, deferral,
    cause asked, property absent, substrate absent, substrate needed, calculation, one
    document and asked for, staff only, else compose."""
    steps = [
        ("1", "below", "refuse"), ("2", "defers", "refuse"), ("3", "asks_cause", "diagnosis"), ("4", "property_absent", "refuse"), ("4s", "substrate_absent", "refuse"),
        ("5", "needs_substrate", "ask_back"), ("6", "calculation", "extract"), ("7", "one_document", "extract"), ("7s", "staff_only", "extract"),
    ]
    out = F.struct(F.lit("compose").alias("path"), F.lit("8").alias("step"))
    for step, fact, path in reversed(steps):
        out = F.when(F.coalesce(F.col(fact), F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(step).alias("step"))).otherwise(out)
    return facts.select("qid", out.alias("r")).select("qid", "r.path", "r.step")


def needs_substrate(text: Column, choice: str, own: str, comparison: str) -> Column:
    """A product choice about the asker's own building that isn't a comparison."""
    low = F.lower(text)
    return F.regexp_like(low, F.lit(choice)) & F.regexp_like(low, F.lit(own)) & ~F.regexp_like(low, F.lit(comparison))


def location_matters(asked: DataFrame, sensitive: list[str]) -> DataFrame:
    """qid, matters: a property is asked for whose answer depends on where the work is.  asked: qid, value."""
    return asked.groupBy("qid").agg(F.max(F.col("value").isin(*sensitive)).alias("matters"))


def askback_answer(text: Column, has_slot: Column, most: int = 10) -> Column:
    """A short reply, no question, which holds a building slot."""
    return (F.size(words(text)) <= most) & ~F.trim(text).endswith("?") & has_slot


def resolve_audience(requested: Column, allowed: Column, known=("public", "trade", "staff")) -> Column:
    """Known names, clipped to what is allowed; nothing usable: all that is allowed."""
    wanted = F.array_intersect(F.array_distinct(F.transform(requested, lambda x: F.lower(F.trim(x)))), F.array(*map(F.lit, known)))
    clipped = F.array_intersect(wanted, allowed)
    return F.when(F.size(F.coalesce(clipped, F.array().cast("array<string>"))) == 0, allowed).otherwise(clipped)


def resolve_request(now: DataFrame, history: DataFrame, denied: DataFrame) -> DataFrame:
    """qid, slot, value, provenance: this turn's slots over those carried; denied values
    aren't inherited, and two values in one turn are unsettled (null).  now and
    history: qid, slot, value; denied: qid, slot, value."""
    n = now.groupBy("qid", "slot").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value"))
    h = history.join(denied, ["qid", "slot", "value"], "left_anti").groupBy("qid", "slot").agg(F.max("value").alias("carried"))
    j = n.join(h, ["qid", "slot"], "full")
    return j.select("qid", "slot", F.when(F.col("n") > 1, None).otherwise(F.coalesce("value", "carried")).alias("value"), F.when(F.col("n") > 1, "unsettled").when(F.col("n") == 1, "stated").otherwise("carried").alias("provenance"))


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
