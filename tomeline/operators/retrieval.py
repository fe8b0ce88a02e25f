"""Batch retrieval: a table of requests against a table of passages.

passages: passage_id, canonical_url, chunk_index, product, authority, document_type,
audience, source_date, section, content, embedding.  queries: qid, embedding,
audiences, product.  Hits: qid, rank, passage_id, score and the passage's columns.
Scores are rounded to six decimals before ranking, and every ranking is total:
effective score, newest date, url, chunk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import content_words, same_product, sentences, squash, whole_word, words
from ..store import materialise
from .matching import containing
from .search import bounded, of_documents, overlapping

BOOST, AUTHORITY_SPAN, THRESHOLD = 0.15, 0.02, 0.45


def audience_filter(audiences: Column, audience: Column) -> Column:
    """Who may see a passage; part of the join condition, so it comes before scoring."""
    return F.array_contains(audiences, audience)


def product_match(a: Column, b: Column) -> Column:
    """Names contain one another, without regard to case, neither empty."""
    a, b = F.lower(a), F.lower(b)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def product_boost(a: Column, b: Column, boost: float = BOOST) -> Column:
    return F.when(product_match(a, b), boost).otherwise(0.0)


def authority_bonus(authority: Column) -> Column:
    """Up to AUTHORITY_SPAN for the best of the levels 1 to 6."""
    return (6 - F.greatest(F.lit(1), F.least(F.lit(6), authority))) * AUTHORITY_SPAN / 6


def order(name: str = "qid") -> W:
    return W.partitionBy(name).orderBy(F.desc("effective"), F.desc_nulls_last("source_date"), "canonical_url", "chunk_index")


def per_document_cap(hits: DataFrame, cap: int) -> DataFrame:
    w = W.partitionBy("qid", "canonical_url").orderBy(F.desc("effective"), F.desc_nulls_last("source_date"), "canonical_url", "chunk_index")
    return hits.withColumn("in_document", F.row_number().over(w)).where(F.col("in_document") <= cap).drop("in_document")


def ranked(hits: DataFrame, k: int) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(order())).where(F.col("rank") <= k)


def best(queries: DataFrame, passages: DataFrame, k: int = 5, cap: int = 3) -> DataFrame:
    """The k best visible passages of each request, without their texts.  score is the
    cosine, effective the score with boosts; tasks give k rows a request, and only those
    are shuffled, once."""
    return ranked(per_document_cap(bounded(queries, passages, k, cap, BOOST, AUTHORITY_SPAN).repartition("qid"), cap), k)


def best_of_documents(queries: DataFrame, passages: DataFrame, cap: int = 3, columns: list[str] | None = None) -> DataFrame:
    """The cap best visible passages of each request and document; columns: which of the passages' ones to give (all)."""
    return of_documents(queries, passages, cap, BOOST, AUTHORITY_SPAN, columns)


def visible_counts(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """qid, audience, product, n, boosted: how many passages of each audience and product a request
    may see, and whether the product boost is theirs.  Passages are counted before requests meet them."""
    n = passages.groupBy("audience", "product").agg(F.count("*").alias("n"))
    q = queries.select("qid", F.explode(F.array_distinct("audiences")).alias("audience"), F.col("product").alias("q_product"))
    return q.join(n, "audience").select("qid", "audience", "product", "n", product_match(F.col("q_product"), F.col("product")).alias("boosted"))


def topk(queries: DataFrame, passages: DataFrame, k: int = 5, cap: int = 3) -> DataFrame:
    """The same with texts, which only the hits' passages bring along."""
    return best(queries, passages, k, cap).join(passages.select("passage_id", "section", "content"), "passage_id")


def distinct_passages(hits: DataFrame, k: int = 5) -> DataFrame:
    """Hits of different text, the better ranked kept, then k."""
    w = W.partitionBy("qid", F.sha2(squash(F.col("content")), 256)).orderBy("rank")
    h = hits.withColumn("same", F.row_number().over(w)).where("same = 1").drop("same")
    return h.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("rank"))).where(F.col("rank") <= k)


def abstain(queries: DataFrame, hits: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """qid, top_score, documents, below (threshold inclusive; no hits: 0 and below)."""
    g = hits.groupBy("qid").agg(F.max("score").alias("top_score"), F.count_distinct("canonical_url").alias("documents"))
    j = queries.select("qid").join(g, "qid", "left").select("qid", F.coalesce("top_score", F.lit(0.0)).alias("top_score"), F.coalesce("documents", F.lit(0)).alias("documents"))
    return j.withColumn("below", F.col("top_score") < threshold)


def find_passages(requests: DataFrame, passages: DataFrame, limit: int = 3) -> DataFrame:
    """Lexical lookup: product containment (empty: any) and any term as a substring of
    content or section; by authority, date, url, chunk.  No terms: nothing.

    Every passage is read once for all terms; of the passages with a term, only the first limit
    of each audience and product are held against the requests, as no other can be among the
    first limit of a request."""
    order = ("authority", F.desc_nulls_last("source_date"), "canonical_url", "chunk_index")
    asked = requests.select("qid", "audiences", F.col("product").alias("q_product"), F.explode(F.array_distinct(F.transform("terms", F.lower))).alias("term"))
    body = passages.withColumn("body", F.lower(F.concat_ws("\n", "section", "content"))).drop("embedding", "content")
    found = containing(body, "body", asked.select("term"))
    first = found.withColumn("n", F.row_number().over(W.partitionBy("term", "audience", "product").orderBy(*order))).where(F.col("n") <= limit).drop("n")
    met = first.join(asked, "term").where(audience_filter(F.col("audiences"), F.col("audience")) & ((F.col("q_product") == "") | product_match(F.col("q_product"), F.col("product"))))
    once = met.drop("term", "audiences").dropDuplicates(["qid", "passage_id"])
    return once.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= limit).withColumn("score", F.lit(0.0))


def expand_query(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """qid, expanded: synonyms of phrases in the text that aren't there yet, in order of
    rule.  synonyms: nth, phrase, synonym (small configuration)."""
    low = F.lower("text")
    hit = queries.join(F.broadcast(synonyms), F.contains(low, F.lower("phrase")) & ~F.contains(low, F.lower("synonym")))
    more = hit.groupBy("qid").agg(F.transform(F.array_sort(F.collect_set(F.struct("nth", "synonym"))), lambda x: x["synonym"]).alias("more"))
    return queries.select("qid", "text").join(more, "qid", "left").select("qid", F.concat_ws(" ", F.col("text"), F.array_distinct(F.coalesce("more", F.array().cast("array<string>")))).alias("expanded"))


def merge_hits(*passes: DataFrame) -> DataFrame:
    """Hits of several passes: earlier passes first, each passage once, ranked anew."""
    both = reduce(DataFrame.unionByName, [p.select("qid", "passage_id", "score", "rank").withColumn("pass", F.lit(i)) for i, p in enumerate(passes)])
    first = both.groupBy("qid", "passage_id").agg(F.min(F.struct("pass", "rank", "score")).alias("x"))
    return first.select("qid", "passage_id", "x.score", F.row_number().over(W.partitionBy("qid").orderBy("x.pass", "x.rank", "passage_id")).alias("rank"))


def topk_per_product(queries: DataFrame, passages: DataFrame, k: int = 5, cap: int = 3, products: int = 3) -> DataFrame:
    """One window for each of the first products named (products: array), put together by score."""
    each = queries.select(F.posexplode(F.slice("products", 1, products)).alias("nth", "product"), F.col("qid").alias("of"), "embedding", "audiences")
    each = each.withColumn("qid", F.concat_ws("/", F.col("of").cast("string"), F.col("nth").cast("string")))
    hits = best(each, passages, k, cap).withColumn("of", F.substring_index("qid", "/", 1).cast("long"))
    once = hits.groupBy("of", "passage_id").agg(F.max("score").alias("score"))
    return once.select(F.col("of").alias("qid"), "passage_id", "score", F.row_number().over(W.partitionBy("of").orderBy(F.desc("score"), "passage_id")).alias("rank"))


def property_evidence(queries: DataFrame, hits: DataFrame, passages: DataFrame, fields: DataFrame, limit: int = 3) -> DataFrame:
    """Up to limit lexical hits for each product and field asked for, after the scored
    ones.  queries: qid, audiences, product, fields (array); fields: field, terms."""
    ask = queries.select("qid", "audiences", "product", F.explode("fields").alias("field")).join(fields, "field")
    ask = ask.withColumn("of", F.col("qid")).withColumn("qid", F.concat_ws("/", F.col("of").cast("string"), "field"))
    found = find_passages(ask, passages, limit).select(F.substring_index("qid", "/", 1).cast("long").alias("qid"), "passage_id", "score", "rank")
    return merge_hits(hits, found)


def missed_evidence(queries: DataFrame, hits: DataFrame, passages: DataFrame, noise: list[str], rare: int = 6, shared: int = 3, most: int = 3) -> DataFrame:
    """Passages that hold a rare word of the question which no hit has, and share more than
    shared content words with it: qid, word, passage_id, at most most.  queries: qid, text,
    audiences, product.  A word is looked up among the passages of the product, and where these
    don't have it, or no product is named, among all; it is rare if so many of them hold it.
    Passages are cut into words once; counts cover all of them."""
    q = queries.select("qid", "audiences", F.col("product").alias("q_product"), content_words(F.col("text"), 5).alias("asked"))
    p = materialise(passages.select("passage_id", "audience", "product", content_words(F.concat_ws(" ", "section", "content"), 5).alias("w")), "words")
    have = hits.select("qid", "passage_id").join(p.select("passage_id", "w"), "passage_id").groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("have"))
    q = q.join(have, "qid", "left").withColumn("missing", F.array_except(F.array_except("asked", F.coalesce("have", F.array().cast("array<string>"))), F.array(*map(F.lit, noise))))
    wanted = q.select("qid", "audiences", "q_product", "asked", F.explode("missing").alias("word"))
    # Only words and ids are shuffled for the counts; a passage's words come back for the rare ones' passages.
    post = p.select("passage_id", "product", F.explode("w").alias("word")).join(wanted.select("word").distinct(), "word", "left_semi")
    per = post.groupBy("word", "product").agg(F.count("*").alias("n"))
    own = wanted.join(per, "word").where(product_match(F.col("q_product"), F.col("product"))).groupBy("qid", "word").agg(F.sum("n").alias("own"))
    all_ = per.groupBy("word").agg(F.sum("n").alias("n"))
    scope = wanted.join(all_, "word").join(own, ["qid", "word"], "left").select("qid", "audiences", "q_product", "asked", "word", F.coalesce("own", "n").alias("df"), F.col("own").isNotNull().alias("inside")).where(F.col("df") <= rare)
    within = scope.join(post, "word").where(~F.col("inside") | F.coalesce(product_match(F.col("q_product"), F.col("product")), F.lit(False))).drop("product")
    found = within.join(p.drop("product"), "passage_id").where(audience_filter(F.col("audiences"), F.col("audience")) & (F.size(F.array_intersect("asked", "w")) > shared))
    once = found.groupBy("qid", "passage_id").agg(F.min(F.struct("df", "word")).alias("x"))
    n = F.row_number().over(W.partitionBy("qid").orderBy("x.df", "x.word", "passage_id"))
    return once.withColumn("rank", n).where(F.col("rank") <= most).select("qid", "passage_id", F.col("x.word").alias("word"), "rank")


def gate_second_chance(queries: DataFrame, hits: DataFrame, passages: DataFrame, limit: int = 3) -> DataFrame:
    """Where no hit holds an asked term (terms), lexical hits are appended."""
    held = hits.join(queries.select("qid", "terms"), "qid").join(passages.select("passage_id", F.lower(F.concat_ws("\n", "section", "content")).alias("body")), "passage_id")
    met = held.where(F.exists("terms", lambda x: F.contains(F.col("body"), F.lower(x)))).select("qid").distinct()
    again = queries.join(met, "qid", "left_anti")
    return merge_hits(hits, find_passages(again, passages, limit).select("qid", "passage_id", "score", "rank"))


def contextual_retry(queries: DataFrame, hits: DataFrame, retry: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Second search adopted where the first stayed below the threshold and the second's
    top score is higher; the old hits stay behind."""
    top = lambda h, n: h.groupBy("qid").agg(F.max("score").alias(n))
    adopt = top(retry, "b").join(top(hits, "a"), "qid", "left").where((F.coalesce("a", F.lit(0.0)) < threshold) & (F.col("b") > F.coalesce("a", F.lit(0.0)))).select("qid")
    return merge_hits(retry.join(adopt, "qid", "left_semi"), hits)


def diagnostic_passages(hits: DataFrame, marketing=("product_page", "commercial"), n: int = 3) -> DataFrame:
    """Stable partition: marketing pages last, then n."""
    r = F.row_number().over(W.partitionBy("qid").orderBy(F.col("document_type").isin(*marketing), "rank"))
    return hits.withColumn("rank", r).where(F.col("rank") <= n)


def documents_for(queries: DataFrame, manifest: DataFrame, n: int = 6) -> DataFrame:
    """Documents by word overlap of question and name + product, then authority; none: the
    first n datasheets.  Tasks give the n best of each question, and only those are shuffled."""
    q = queries.select("qid", F.array_distinct(words(F.col("text"))).alias("words"))
    d = manifest.select("canonical_url", "authority", F.array_distinct(words(F.concat_ws(" ", "title", "product"))).alias("words"))
    best = W.partitionBy("qid").orderBy(F.desc("overlap"), "authority", "canonical_url")
    hit = overlapping(q, d, n).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select("qid", "canonical_url", "rank")
    sheets = manifest.where("document_type = 'datasheet'").orderBy("authority", "canonical_url").limit(n).select("canonical_url", F.row_number().over(W.orderBy("authority", "canonical_url")).alias("rank"))
    none = queries.select("qid").join(hit, "qid", "left_anti").crossJoin(F.broadcast(sheets))  # n rows
    return hit.unionByName(none.select("qid", "canonical_url", "rank"))


def scoped_evidence(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits owned by a requested product or naming one; nothing requested: all.  queries: qid, products."""
    j = hits.join(queries.select("qid", "products"), "qid")
    mine = F.exists("products", lambda p: product_match(p, F.col("product")) | F.contains(F.lower("content"), F.lower(p)))
    return j.where((F.size("products") == 0) | mine).drop("products")


def evidence_binding(queries: DataFrame, hits: DataFrame, properties: DataFrame, most: int = 2, brand: str = "") -> DataFrame:
    """qid, property, passage_id, strength: for each property the passages with the
    longest matched term, + 100 if one sentence holds it and a figure; the best, with
    ties, at most most.  Where a product is named, its own passages come first, then those that
    name it, then others.  queries: qid, product, properties; properties: property, terms."""
    ask = queries.select("qid", F.col("product").alias("named"), F.explode("properties").alias("property")).join(properties, "property")
    j = hits.select("qid", "passage_id", "product", "content", "rank").join(ask, "qid")
    tier = F.when(F.coalesce("named", F.lit("")) == "", 0).when(same_product(F.col("named"), F.col("product"), brand), 0).when(whole_word(F.col("content"), F.col("named")), 1).otherwise(2)
    s = j.select("qid", "property", "passage_id", "rank", "terms", tier.alias("tier"), F.explode(sentences(F.col("content"))).alias("s"))
    longest = F.array_max(F.transform(F.filter("terms", lambda t: F.contains(F.lower("s"), F.lower(t))), F.length))
    g = s.withColumn("term", longest).where("term is not null").groupBy("qid", "property", "passage_id", "rank", "tier").agg((F.max("term") + F.max(F.when(F.regexp_like("s", F.lit("[0-9]")), 100).otherwise(0))).alias("strength"))
    w = W.partitionBy("qid", "property").orderBy("tier", F.desc("strength"))
    g = g.withColumn("place", F.rank().over(w)).where("place = 1").withColumn("nth", F.row_number().over(W.partitionBy("qid", "property").orderBy("rank", "passage_id")))
    return g.where(F.col("nth") <= most).select("qid", "property", "passage_id", F.col("strength").cast("long").alias("strength"))


def binding_distinguishes(bindings: DataFrame) -> DataFrame:
    """qid, distinguishes: no passage supports two properties."""
    per = bindings.groupBy("qid", "passage_id").agg(F.count_distinct("property").alias("n"))
    return per.groupBy("qid").agg((F.max("n") == 1).alias("distinguishes"))


def promote_bound(hits: DataFrame, bindings: DataFrame) -> DataFrame:
    """Where exactly one property is bound to exactly one passage, that passage comes first."""
    one = bindings.groupBy("qid").agg(F.count_distinct("property", "passage_id").alias("n"), F.min("passage_id").alias("bound")).where("n = 1").select("qid", "bound")
    h = hits.join(one, "qid", "left")
    return h.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.coalesce(F.col("passage_id") != F.col("bound"), F.lit(True)), "rank"))).drop("bound")


def rank_caveats(queries: DataFrame, hits: DataFrame, caveats: DataFrame, n: int = 3) -> DataFrame:
    """Caveats of cited documents only, each text once, by overlap with the question, shorter first."""
    cited = hits.select("qid", F.col("canonical_url").alias("url")).distinct()
    j = cited.join(caveats, "url").join(queries.select("qid", words(F.col("text")).alias("asked")), "qid")
    j = j.withColumn("key", squash(F.col("sentence"))).withColumn("overlap", F.size(F.array_intersect(words(F.col("sentence")), "asked")))
    one = j.groupBy("qid", "key").agg(F.max("overlap").alias("overlap"), F.min("sentence").alias("sentence"))
    r = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("overlap"), F.length("key"), "key"))
    return one.withColumn("rank", r).where(F.col("rank") <= n).select("qid", "sentence", "rank")


def source_rows(hits: DataFrame) -> DataFrame:
    """Marker (the rank) and whether it is the first of its document."""
    first = F.row_number().over(W.partitionBy("qid", "canonical_url").orderBy("rank")) == 1
    return hits.select("qid", F.col("rank").alias("marker"), "canonical_url", first.alias("first_of_document"))


def renumber_citations(answers: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """If every marker [n] of an answer is backed, only cited rows stay and both sides
    are numbered anew; else nothing changes.  answers: qid, text; rows: qid, marker."""
    used = answers.select("qid", F.array_distinct(F.regexp_extract_all("text", F.lit("\\[([0-9]+)\\]"), F.lit(1))).alias("used"))
    have = rows.groupBy("qid").agg(F.collect_set(F.col("marker").cast("string")).alias("have"))
    ok = used.join(have, "qid").where((F.size("used") > 0) & (F.size(F.array_except("used", "have")) == 0)).select("qid", F.array_sort(F.transform("used", lambda x: x.cast("int"))).alias("used"))
    a = answers.join(ok, "qid", "left")
    safe = F.regexp_replace("text", "\\[([0-9]+)\\]", "[\x01$1]")
    new = F.aggregate(F.coalesce("used", F.array().cast("array<int>")), safe, lambda t, m: F.replace(t, F.concat(F.lit("[\x01"), m.cast("string"), F.lit("]")), F.concat(F.lit("["), F.array_position("used", m).cast("string"), F.lit("]"))))
    out = a.select("qid", F.replace(new, F.lit("[\x01"), F.lit("[")).alias("text"))
    r = rows.join(ok, "qid", "left").where(F.col("used").isNull() | F.array_contains("used", F.col("marker").cast("int")))
    return out, r.withColumn("marker", F.when(F.col("used").isNull(), F.col("marker")).otherwise(F.array_position("used", F.col("marker").cast("int")))).drop("used")


def approved_evidence(decisions: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits of approved products (exact, lower case); none left: all of them.  decisions: qid, approved."""
    j = hits.join(decisions, "qid").withColumn("ok", F.exists("approved", lambda p: F.lower(p) == F.lower(F.col("product"))))
    return j.withColumn("any", F.max("ok").over(W.partitionBy("qid"))).where("ok or not any").drop("ok", "any", "approved")
