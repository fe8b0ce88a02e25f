"""Verification of an answer table against its evidence, claim by claim.

answers: aid, question, text (markers [n]); evidence: aid, marker, product, section,
content.  Every check gives (aid, seq, check, note) rows for what fails; an
answer is printable if it has none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_words, sentences, squash, whole_word
from ..store import materialise
from .relations import QUALIFIER, found_set, limits, relations, without_markers

FIGURE = "[0-9]+(?:[.,][0-9]+)? ?(?:mm|cm|m2|m|kg|litres|hours|days|%)"
_STRINGS = "array<string>"


def claims(answers: DataFrame) -> DataFrame:
    """aid, seq, sentence, markers, clauses: the sentences, the markers in them, and
    clauses split at ; : and a comma before an opener."""
    s = answers.select("aid", F.posexplode(sentences(F.col("text"))).alias("seq", "sentence"))
    plain = F.trim(F.regexp_replace("sentence", "\\[[0-9]+\\]", ""))
    clauses = F.filter(F.transform(F.split(plain, "[;:]|, (?=and |but |which |when |if )"), lambda x: F.trim(x)), lambda c: c != "")
    markers = F.transform(F.regexp_extract_all("sentence", F.lit("\\[([0-9]+)\\]"), F.lit(1)), lambda m: m.cast("int"))
    return s.select("aid", F.col("seq").cast("long").alias("seq"), "sentence", markers.alias("markers"), clauses.alias("clauses"))


def cited(claims_: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with the text they cite (all of the answer's evidence where they cite nothing valid)."""
    e = evidence.groupBy("aid").agg(F.collect_list(F.struct("marker", F.concat_ws("\n", "section", "content").alias("body"), "product")).alias("e"))
    j = claims_.join(e, "aid", "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<marker:bigint,body:string,product:string>>")))
    own = F.filter("e", lambda x: F.array_contains("markers", x["marker"].cast("int")))
    return j.withColumn("own", own).withColumn("cited", F.concat_ws("\n", F.transform("own", lambda x: x["body"]))).withColumn("n", F.size("e"))


def _fails(df: DataFrame, check: int, bad: Column, note: Column | str) -> DataFrame:
    note = F.lit(note) if isinstance(note, str) else note
    return df.where(bad).select("aid", "seq", F.lit(check).cast("long").alias("check"), note.alias("note"))


def check_citation(c: DataFrame) -> DataFrame:
    """1: no marker, or one beyond the evidence."""
    return _fails(c, 1, (F.size("markers") == 0) | (F.coalesce(F.array_max("markers"), F.lit(0)) > F.col("n")), "citation")


def check_overlap(c: DataFrame, share: float = 0.4) -> DataFrame:
    """1: a clause shares less than share of its content words with the cited text; one without such words passes."""
    have = content_words(F.col("cited"))
    x = c.where("cited != ''").withColumn("have", have).select("aid", "seq", "have", F.explode("clauses").alias("clause"))
    w = content_words(F.col("clause"))
    x = x.withColumn("w", w).where((F.size("w") > 0) & (F.size(F.array_intersect("w", "have")) < share * F.size("w")))
    return x.groupBy("aid", "seq").agg(F.count("*").alias("k")).select("aid", "seq", F.lit(1).cast("long").alias("check"), F.lit("overlap").alias("note"))


def figures(text: Column) -> Column:
    """Figures with units in one spelling: no spaces, point as decimal mark, no trailing .0"""
    raw = F.regexp_extract_all(F.lower(text), F.lit(FIGURE), F.lit(0))
    return F.array_distinct(F.transform(raw, lambda f: F.regexp_replace(F.regexp_replace(F.replace(F.replace(f, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")), "\\.0+(?![0-9])", ""), "sqm", "m2")))


def check_numbers(c: DataFrame) -> DataFrame:
    """2: a figure with its unit isn't in the cited text."""
    lost = F.array_except(figures(F.col("sentence")), figures(F.col("cited")))
    return _fails(c, 2, F.size(lost) > 0, F.array_join(F.array_sort(lost), ","))


def check_attribution(c: DataFrame, products: list[str]) -> DataFrame:
    """3: a sentence with a figure names a product which is none of the cited ones and not in the cited text."""
    names = F.array(*map(F.lit, products))
    own = F.transform("own", lambda x: F.lower(x["product"]))
    strange = F.filter(names, lambda p: whole_word(F.col("sentence"), p) & ~F.array_contains(own, F.lower(p)) & ~F.contains(F.lower("cited"), F.lower(p)))
    return _fails(c, 3, F.regexp_like("sentence", F.lit("[0-9]")) & (F.size(strange) > 0), F.array_join(F.array_sort(strange), ","))


def check_qualifiers(c: DataFrame, qualifiers: str = "up to|at least|about|minimum|maximum") -> DataFrame:
    """4: the first qualifier of a sentence with a figure doesn't stand in a cited sentence with one."""
    q = F.regexp_extract(F.lower("sentence"), f"(?:^|[^a-z])({qualifiers})(?:[^a-z]|$)", 1)
    there = F.exists(sentences(F.col("cited")), lambda s: F.contains(F.lower(s), q) & F.regexp_like(s, F.lit("[0-9]")))
    return _fails(c, 4, (q != "") & F.regexp_like(F.regexp_replace("sentence", "\\[[0-9]+\\]", ""), F.lit("[0-9]")) & ~there, q)


def check_names(c: DataFrame, registry: DataFrame, common: list[str], brand: str = "") -> DataFrame:
    """5: a capitalised name (after the first word) is neither known nor in the cited text."""
    body = F.regexp_replace(F.regexp_replace("sentence", "\\[[0-9]+\\]", ""), "^[^ ]+ ", "")
    x = c.select("aid", "seq", F.lower("cited").alias("low"), F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)*"), F.lit(0)))).alias("name"))
    x = x.where(~F.lower("name").isin(*common) & ~F.contains("low", F.lower("name")))
    x = x.withColumn("key", F.lower(F.trim(F.regexp_replace("name", f"^{brand}", "")))).join(registry.select(F.lower("name").alias("key")).distinct(), "key", "left_anti")
    return x.groupBy("aid", "seq").agg(F.array_sort(F.collect_set("name")).alias("names")).select("aid", "seq", F.lit(5).cast("long").alias("check"), F.array_join("names", ",").alias("note"))


def check_property(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """6: none of the asked terms (terms) is in any passage of the answer."""
    e = evidence.groupBy("aid").agg(F.lower(F.concat_ws("\n", F.collect_list(F.concat_ws("\n", "section", "content")))).alias("body"))
    j = answers.join(e, "aid", "left").withColumn("seq", F.lit(-1).cast("long"))
    return _fails(j, 6, (F.size("terms") > 0) & ~F.exists("terms", lambda t: F.contains(F.coalesce("body", F.lit("")), F.lower(t))), "property")


def check_scope(c: DataFrame, products: list[str], asked: DataFrame) -> DataFrame:
    """7: a product is named which wasn't asked about and which no cited passage of the
    asked product names.  asked: aid, asked (array)."""
    names = F.array(*map(F.lit, products))
    j = c.join(asked, "aid").where(F.size("asked") > 0)
    bridge = F.concat_ws("\n", F.transform(F.filter("own", lambda x: F.array_contains("asked", x["product"])), lambda x: x["body"]))
    out = F.array_except(F.filter(names, lambda p: whole_word(F.col("sentence"), p) & ~F.contains(F.lower(bridge), F.lower(p))), F.col("asked"))
    return _fails(j, 7, F.size(out) > 0, F.array_join(F.array_sort(out), ","))


def check_relations(c: DataFrame, names: list[str]) -> DataFrame:
    """8: a relation of a claim isn't stated so in a cited sentence: with the same direction, polarity,
    certainty and states, and equal sets of conditions, state words and warnings."""
    said = relations(c.select(F.struct("aid", "seq").alias("id"), F.col("sentence").alias("s")), names)
    known = relations(c.select(F.struct("aid", "seq").alias("id"), F.explode(sentences(F.col("cited"))).alias("s")).where("not endswith(s, '?')"), names)
    lost = said.join(known, said.columns, "left_anti").groupBy("id").agg(F.array_sort(F.collect_set(F.concat_ws(" ", "layer", "kind", "base"))).alias("x"))
    return lost.select("id.aid", "id.seq", F.lit(8).cast("long").alias("check"), F.array_join("x", ",").alias("note"))


def check_unestablished(c: DataFrame, names: list[str], linking: str = "over|under|beneath|onto|compatible|incompatible|finished|coated") -> DataFrame:
    """8: a claim names two products and links them, but says nothing that can be checked, and
    doesn't stand word for word in a cited sentence."""
    said = relations(c.select(F.struct("aid", "seq").alias("id"), F.col("sentence").alias("s")), names).select("id.aid", "id.seq").distinct()
    plain = F.trim(F.lower(without_markers(F.col("sentence"))), F.lit(" ."))
    named = F.size(F.filter(F.array(*map(F.lit, names)), lambda p: whole_word(F.col("sentence"), p)))
    bad = (named > 1) & F.regexp_like(F.lower("sentence"), F.lit(f"(^|[^a-z])({linking})([^a-z]|$)")) & ~F.exists(sentences(F.col("cited")), lambda s: F.contains(F.lower(s), plain))
    return _fails(c.join(said, ["aid", "seq"], "left_anti"), 8, bad, "relation")


def check_requested_relations(answers: DataFrame, c: DataFrame, names: list[str]) -> DataFrame:
    """8: a relation of the question is stated nowhere in the answer, whatever its polarity."""
    keys = ["aid", "kind", "layer", "base"]
    asked = relations(answers.select(F.col("aid").alias("id"), F.explode(sentences(F.col("question"))).alias("s")), names).withColumnRenamed("id", "aid").select(*keys).distinct()
    said = relations(c.select(F.col("aid").alias("id"), F.col("sentence").alias("s")), names).withColumnRenamed("id", "aid").select(*keys)
    lost = asked.join(said, keys, "left_anti").groupBy("aid").agg(F.array_sort(F.collect_set(F.concat_ws(" ", "layer", "kind", "base"))).alias("x"))
    return lost.select("aid", F.lit(-1).cast("long").alias("seq"), F.lit(8).cast("long").alias("check"), F.array_join("x", ",").alias("note"))


def check_sensitive(c: DataFrame, claims_: str = "waterproof|structural|certified") -> DataFrame:
    """8: a sensitive claim without a cited sentence that makes it with the same polarity."""
    word = F.regexp_extract(F.lower("sentence"), f"(?:^|[^a-z])({claims_})(?:[^a-z]|$)", 1)
    no = lambda s: F.regexp_like(F.lower(s), F.lit("(^|[^a-z])(not|never|no)([^a-z]|$)"))
    backed = F.exists(sentences(F.col("cited")), lambda s: F.contains(F.lower(s), word) & (no(s) == no(F.col("sentence"))))
    return _fails(c, 8, (word != "") & ~backed, word)


def check_numeric_binding(c: DataFrame, products: list[str]) -> DataFrame:
    """8: no cited sentence with the figure is about a product that the claim names."""
    named = F.filter(F.array(*map(F.lit, products)), lambda p: whole_word(F.col("sentence"), p))
    x = c.withColumn("named", named).where(F.size("named") > 0).select("aid", "seq", "cited", "named", F.explode(figures(F.col("sentence"))).alias("figure"))
    about = F.exists(sentences(F.col("cited")), lambda s: F.array_contains(figures(s), F.col("figure")) & F.exists("named", lambda p: whole_word(s, p)))
    return x.where(~about).groupBy("aid", "seq").agg(F.array_sort(F.collect_set("figure")).alias("f")).select("aid", "seq", F.lit(8).cast("long").alias("check"), F.array_join("f", ",").alias("note"))


def check_numeric_limits(c: DataFrame, products: list[str]) -> DataFrame:
    """4: a figure of a named product is published, but every cited sentence that binds it has a
    qualifier that the claim leaves out, or other conditions, state words or warnings."""
    named = F.filter(F.array(*map(F.lit, products)), lambda p: whole_word(F.col("sentence"), p))
    x = c.withColumn("named", named).where(F.size("named") > 0).select("aid", "seq", F.lower("sentence").alias("low"), limits(F.col("sentence")).alias("own"), "named", sentences(F.col("cited")).alias("s"), F.explode(figures(F.col("sentence"))).alias("figure"))
    bound = F.filter("s", lambda s: F.array_contains(figures(s), F.col("figure")) & F.exists("named", lambda p: whole_word(s, p)))
    kept = lambda s: F.forall(found_set(F.lower(s), QUALIFIER), lambda q: F.contains(F.col("low"), q)) & (limits(s) == F.col("own"))
    lost = x.withColumn("bound", bound).where((F.size("bound") > 0) & ~F.exists("bound", kept))
    return lost.groupBy("aid", "seq").agg(F.array_sort(F.collect_set("figure")).alias("f")).select("aid", "seq", F.lit(4).cast("long").alias("check"), F.array_join("f", ",").alias("note"))


def rewrite_preserved(pairs: DataFrame, internal: str = "chunk|embedding") -> DataFrame:
    """aid, reason (null if the rewrite is faithful): same markers, same figures, no lost
    limitation, no new internal words, not empty.  pairs: aid, original, rewritten."""
    marks = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit("\\[[0-9]+\\]"), F.lit(0)))
    figs = lambda c: F.array_sort(F.regexp_extract_all(F.regexp_replace(c, "\\[[0-9]+\\]", ""), F.lit("[0-9]+(?:\\.[0-9]+)?"), F.lit(0)))
    has = lambda c, p: F.regexp_like(F.lower(c), F.lit(p))
    limit = "(^|[^a-z])(not|never|only|unless|except)([^a-z]|$)"
    return pairs.select(
        "aid",
        F.when(F.trim("rewritten") == "", "empty")
        .when(marks("original") != marks("rewritten"), "markers")
        .when(figs("original") != figs("rewritten"), "figures")
        .when(has("original", limit) & ~has("rewritten", limit), "limitation")
        .when(has("rewritten", internal) & ~has("original", internal), "vocabulary")
        .alias("reason"),
    )


def field_answers(questions: DataFrame, hits: DataFrame, rules: DataFrame) -> DataFrame:
    """qid, field, answer: verbatim sentences of the hits that satisfy the rule of a field
    asked for, in order of rank and place, each once.  questions: qid, fields; rules: field, pattern."""
    ask = questions.select("qid", F.explode("fields").alias("field")).join(F.broadcast(rules), "field")
    s = hits.select("qid", "rank", F.posexplode(sentences(F.col("content"))).alias("nth", "s")).join(ask, "qid").where(F.expr("regexp_like(lower(s), pattern)"))
    one = s.groupBy("qid", "field", squash(F.col("s")).alias("key")).agg(F.min(F.struct("rank", "nth", "s")).alias("x"))
    found = one.groupBy("qid", "field").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return ask.select("qid", "field").join(found, ["qid", "field"], "left").select("qid", "field", F.concat_ws(" ", F.transform("x", lambda r: r["s"])).alias("answer"))


def published_numbers(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """aid, strange: numbers of the body that are neither in the evidence nor in the question."""
    nums = lambda c: F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.replace(c, F.lit("½"), F.lit(".5")), "\\[[0-9]+\\]", ""), F.lit("[0-9]+(?:\\.[0-9]+)?|\\.[0-9]+"), F.lit(0)))
    e = evidence.groupBy("aid").agg(F.array_distinct(F.flatten(F.collect_list(nums(F.col("content"))))).alias("known"))
    j = answers.join(e, "aid", "left")
    return j.select("aid", F.array_sort(F.array_except(F.array_except(nums(F.col("text")), F.coalesce("known", F.array().cast(_STRINGS))), nums(F.col("question")))).alias("strange"))


def verify(answers: DataFrame, evidence: DataFrame, products: list[str], registry: DataFrame, common: list[str]) -> DataFrame:
    """All failures of all answers: aid, seq, check, note.  answers may have terms and asked
    (arrays) for the checks of property and scope; without them these find nothing.
    What the claims cite is written once, as every check reads it."""
    none = F.array().cast(_STRINGS)
    answers = answers.withColumns({c: none for c in ("terms", "asked") if c not in answers.columns})
    c = materialise(cited(claims(answers), evidence), "cited")
    parts = [check_property(answers, evidence), check_scope(c, products, answers.select("aid", "asked")), check_citation(c), check_overlap(c), check_numbers(c), check_attribution(c, products), check_qualifiers(c), check_names(c, registry, common), check_relations(c, products), check_unestablished(c, products), check_requested_relations(answers, c, products), check_sensitive(c), check_numeric_binding(c, products), check_numeric_limits(c, products)]
    return reduce(DataFrame.unionByName, parts)


def printable(answers: DataFrame, failures: DataFrame) -> DataFrame:
    return answers.join(failures.select("aid").distinct(), "aid", "left_anti")

