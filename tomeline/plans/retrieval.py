"""Retrieval and evidence queries over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embeddings as emb
from ..operators import retrieval as r
from ..sources import model as m
from .base import collection

QUERIES, ORACLES, add = collection()

_N = lambda v: f"list_sum(list_transform({v}, lambda a: CAST(a AS DOUBLE) * CAST(a AS DOUBLE)))"
_DOT = lambda a, b: f"list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
_MATCH = lambda a, b: f"({a} <> '' AND {b} <> '' AND (contains(lower({a}), lower({b})) OR contains(lower({b}), lower({a}))))"
SCORED = f"""scored AS (SELECT *, round(score + CASE WHEN {_MATCH('q_product', 'product')} THEN 0.15 ELSE 0 END + (6 - greatest(1, least(6, authority))) * 0.02 / 6, 6) AS effective FROM (
  SELECT q.qid, q.product AS q_product, p.* EXCLUDE (embedding), round({_DOT('q.embedding', 'p.embedding')} / sqrt({_N('q.embedding')}) / sqrt({_N('p.embedding')}), 6) AS score
  FROM passages p JOIN queries q ON list_contains(q.audiences, p.audience)))"""
_ORDER = "effective DESC, source_date DESC NULLS LAST, canonical_url, chunk_index"
HITS = f"""hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {_ORDER}) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, canonical_url ORDER BY {_ORDER}) AS d FROM scored) WHERE d <= 3 QUALIFY rank <= 5)"""
_H = (m.PASSAGES, m.QUERIES, SCORED, HITS)
q, p = m.queries, m.passages


def _hits(s, d):
    return r.topk(q(s, d), p(s, d))


_SHORT = ("qid", "rank", "passage_id", "score")
add("g1_topk", lambda s, d: r.best(q(s, d), p(s, d)).select(*_SHORT), *_H, "SELECT qid, rank, passage_id, score FROM hits")
add("g2_audience_filter", lambda s, d: r.visible_counts(q(s, d), p(s, d)).groupBy("qid", "audience").agg(F.sum("n").alias("n")), m.PASSAGES, m.QUERIES, "SELECT qid, audience, count(*) AS n FROM passages p JOIN queries q ON list_contains(audiences, audience) GROUP BY ALL")
add("g3_product_boost", lambda s, d: r.visible_counts(q(s, d), p(s, d)).where("boosted").groupBy("qid").agg(F.sum("n").alias("boosted")), m.PASSAGES, m.QUERIES, f"SELECT qid, count(*) AS boosted FROM passages p JOIN queries q ON list_contains(audiences, audience) WHERE {_MATCH('q.product', 'p.product')} GROUP BY ALL")
add("g4_authority_bonus", lambda s, d: p(s, d).select("passage_id", F.round(r.authority_bonus(F.col("authority")), 6).alias("bonus")), m.PASSAGES, "SELECT passage_id, round((6 - authority) * 0.02::DOUBLE / 6, 6) AS bonus FROM passages")
add("g5_recency_tiebreak", lambda s, d: r.best(q(s, d).withColumn("embedding", F.array(F.lit(0.0))), p(s, d).withColumns({"authority": F.lit(6), "product": F.lit("")}), 3, 3).select("qid", "rank", "passage_id"), m.PASSAGES, m.QUERIES,
    "SELECT qid, rank, passage_id FROM (SELECT qid, passage_id, row_number() OVER (PARTITION BY qid ORDER BY source_date DESC, canonical_url, chunk_index) AS rank FROM passages JOIN queries ON list_contains(audiences, audience)) WHERE rank <= 3")
add("g6_per_document_cap", lambda s, d: r.best_of_documents(q(s, d), p(s, d), 1, ["canonical_url", "passage_id"]).select("qid", "canonical_url", "passage_id"), m.PASSAGES, m.QUERIES, SCORED, f"SELECT qid, canonical_url, passage_id FROM scored QUALIFY row_number() OVER (PARTITION BY qid, canonical_url ORDER BY {_ORDER}) = 1")
_wide = lambda s, d, k: r.topk(q(s, d), p(s, d), k, k)
_W = lambda k: f"wide AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {_ORDER}) AS rank FROM scored QUALIFY rank <= {k})"
_SQUASH = "lower(trim(regexp_replace(content, '[ \\t\\r\\n]+', ' ', 'g'), ' '))"
add("g7_distinct_passages", lambda s, d: r.distinct_passages(_wide(s, d, 10)).select(*_SHORT), m.PASSAGES, m.QUERIES, SCORED, _W(10),
    f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank, passage_id, score FROM (SELECT * FROM wide QUALIFY row_number() OVER (PARTITION BY qid, {_SQUASH} ORDER BY rank) = 1) x QUALIFY row_number() OVER (PARTITION BY qid ORDER BY x.rank) <= 5")
add("g8_abstain", lambda s, d: r.abstain(q(s, d), _hits(s, d).where("qid % 75 != 0")), *_H,
    "SELECT q.qid, coalesce(max(score), 0) AS top_score, count(DISTINCT canonical_url) AS documents, coalesce(max(score), 0) < 0.45 AS below FROM queries q LEFT JOIN hits h ON h.qid = q.qid AND h.qid % 75 <> 0 GROUP BY q.qid")


def _asks(s, d):
    return q(s, d).withColumn("terms", F.when(F.col("qid") % 100 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Section 3"), F.lit("ingth"))))


_ASKS = "asks AS (SELECT qid, audiences, product, CASE WHEN qid % 100 <> 0 THEN ['section 3', 'ingth'] ELSE [] END AS terms FROM queries)"
_LEX = lambda ask, n=3: f"""SELECT qid, passage_id, row_number() OVER (PARTITION BY qid ORDER BY authority, source_date DESC, canonical_url, chunk_index) AS rank FROM passages p JOIN {ask} a ON list_contains(a.audiences, p.audience) AND (a.product = '' OR {_MATCH('a.product', 'p.product')})
  AND len(list_filter(a.terms, lambda t: contains(lower(concat_ws(chr(10), section, content)), t))) > 0 QUALIFY rank <= {n}"""  # noqa: E731
add("g9_find_passages", lambda s, d: r.find_passages(_asks(s, d), p(s, d)).select("qid", "rank", "passage_id"), m.PASSAGES, m.QUERIES, _ASKS, _LEX("asks"))
SYN = [(0, "the", "article"), (1, "of", "belonging"), (2, "and", "with"), (3, "tion", "article")]
add("g10_expand_query", lambda s, d: r.expand_query(m.questions(s, d), s.createDataFrame(SYN, "nth int, phrase string, synonym string")), m.QUESTIONS,
    f"syn AS (SELECT * FROM (VALUES {', '.join(str(x) for x in SYN)}) v(nth, phrase, synonym))",
    "x AS (SELECT qid, synonym, min(nth) AS nth FROM questions JOIN syn ON contains(lower(text), phrase) AND NOT contains(lower(text), synonym) GROUP BY ALL)",
    "SELECT q.qid, q.text || coalesce(' ' || s.more, '') AS expanded FROM questions q LEFT JOIN (SELECT qid, string_agg(synonym, ' ' ORDER BY nth) AS more FROM x GROUP BY qid) s USING (qid)")


def _products(s, d):
    return q(s, d).withColumn("products", F.when(F.col("qid") % 50 == 0, F.array(F.lit("p1"), F.lit("p2"), F.lit("p3"), F.lit("p4"))).otherwise(F.array().cast("array<string>")))


_PER = lambda x: f"s{x} AS (SELECT qid, passage_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid, canonical_url ORDER BY {_ORDER}) AS d FROM e{x}) WHERE d <= 3 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {_ORDER}) <= 5)"
_EFF = lambda x: f"e{x} AS (SELECT * EXCLUDE (effective), round(score + CASE WHEN {_MATCH(repr('p' + str(x)), 'product')} THEN 0.15 ELSE 0 END + (6 - authority) * 0.02 / 6, 6) AS effective FROM scored WHERE qid % 50 = 0)"
add("g11_topk_per_product", lambda s, d: r.topk_per_product(_products(s, d), p(s, d)), m.PASSAGES, m.QUERIES, SCORED, *[f(i) for i in (1, 2, 3) for f in (_EFF, _PER)],
    "SELECT qid, passage_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, passage_id) AS rank FROM (SELECT DISTINCT * FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3))")
_MERGE = lambda a, b: f"SELECT qid, passage_id, score, row_number() OVER (PARTITION BY qid ORDER BY pass, r, passage_id) AS rank FROM (SELECT qid, passage_id, min((pass, rank, score)) AS x, x[1] AS pass, x[2] AS r, x[3] AS score FROM (SELECT 0 AS pass, qid, passage_id, rank, score FROM {a} UNION ALL SELECT 1, qid, passage_id, rank, 0.0 FROM {b}) GROUP BY qid, passage_id)"
FIELDS = [("cover", ["section 1", "anhea"]), ("mix", ["section 2"])]
add("g12_property_evidence", lambda s, d: r.property_evidence(q(s, d).withColumn("fields", F.array(F.lit("cover"), F.lit("mix"))), _hits(s, d), p(s, d), s.createDataFrame(FIELDS, "field string, terms array<string>")), *_H,
    *[f"a{i} AS (SELECT qid, audiences, product, {t} AS terms FROM queries)" for i, (_, t) in enumerate(FIELDS)], f"more AS (SELECT * FROM ({_LEX('a0')}) UNION ALL SELECT * FROM ({_LEX('a1')}))", _MERGE("hits", "more"))
_qt = lambda s, d: q(s, d).join(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), F.col("qid") == F.col("doc_id")).drop("doc_id")
QT = "qt AS (SELECT q.*, text FROM queries q JOIN documents ON doc_id = qid)"
_CW = lambda c, n: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: length(w) >= {n}))"
add("g13_missed_evidence", lambda s, d: r.missed_evidence(_qt(s, d), _hits(s, d), p(s, d), ["about"]), *_H, QT,
    f"pw AS (SELECT passage_id, audience, product, {_CW('concat_ws(chr(32), section, content)', 5)} AS w FROM passages), aw AS (SELECT qid, audiences, product AS q_product, {_CW('text', 5)} AS asked FROM qt)",
    "hv AS (SELECT qid, flatten(list(w)) AS have FROM hits JOIN pw USING (passage_id) GROUP BY qid), ms AS (SELECT qid, audiences, q_product, asked, unnest(list_filter(asked, lambda x: NOT list_contains(coalesce(have, []), x) AND x <> 'about')) AS word FROM aw LEFT JOIN hv USING (qid))",
    "ps AS (SELECT passage_id, audience, product, w, unnest(w) AS word FROM pw), pc AS (SELECT word, product, count(*) AS n FROM ps GROUP BY ALL), al AS (SELECT word, sum(n) AS n FROM pc GROUP BY word)",
    f"ow AS (SELECT qid, ms.word, sum(n) AS own FROM ms JOIN pc ON pc.word = ms.word AND {_MATCH('q_product', 'product')} GROUP BY ALL), sc AS (SELECT ms.*, coalesce(own, al.n) AS df, own IS NOT NULL AS inside FROM ms JOIN al ON al.word = ms.word LEFT JOIN ow ON ow.qid = ms.qid AND ow.word = ms.word)",
    f"fd AS (SELECT qid, passage_id, min((df, sc.word)) AS x FROM sc JOIN ps ON ps.word = sc.word AND (NOT inside OR {_MATCH('q_product', 'product')}) WHERE df <= 6 AND list_contains(audiences, audience) AND len(list_intersect(asked, w)) > 3 GROUP BY ALL)",
    "SELECT qid, passage_id, x[2] AS word, row_number() OVER (PARTITION BY qid ORDER BY x[1], x[2], passage_id) AS rank FROM fd QUALIFY rank <= 3")
_rare = lambda s, d: q(s, d).withColumn("terms", F.array(F.lit("Section 5")))
add("g14_gate_second_chance", lambda s, d: r.gate_second_chance(_rare(s, d), _hits(s, d), p(s, d)), *_H, "rr AS (SELECT qid, audiences, product, ['section 5'] AS terms FROM queries WHERE qid NOT IN (SELECT qid FROM hits WHERE contains(lower(concat_ws(chr(10), section, content)), 'section 5')))", f"more AS ({_LEX('rr')})", _MERGE("hits", "more"))
_again = lambda s, d: r.topk(q(s, d).join(q(s, d).select((F.col("qid") + 25).alias("qid"), F.col("embedding").alias("e")), "qid").withColumn("embedding", F.when(F.col("qid") % 3 == 0, F.col("e")).otherwise(F.col("embedding"))).drop("e"), p(s, d))
add("g15_contextual_retry", lambda s, d: r.contextual_retry(q(s, d), _hits(s, d).where("rank > 1"), _again(s, d)), *_H,
    "q2 AS (SELECT q.* REPLACE (CASE WHEN q.qid % 3 = 0 THEN e.embedding ELSE q.embedding END AS embedding) FROM queries q JOIN queries e ON q.qid = e.qid + 25)", SCORED.replace("scored AS", "scored2 AS", 1).replace("JOIN queries q", "JOIN q2 q"), HITS.replace("hits AS", "hits2 AS", 1).replace("FROM scored)", "FROM scored2)"),
    "ad AS (SELECT qid FROM (SELECT qid, max(score) AS b FROM hits2 GROUP BY qid) LEFT JOIN (SELECT qid, max(score) AS a FROM hits WHERE rank > 1 GROUP BY qid) USING (qid) WHERE coalesce(a, 0) < 0.45 AND b > coalesce(a, 0))",
    "bh AS (SELECT 0 AS pass, qid, passage_id, rank, score FROM hits2 WHERE qid IN (SELECT qid FROM ad) UNION ALL SELECT 1, qid, passage_id, rank, score FROM hits WHERE rank > 1)",
    "SELECT qid, passage_id, score, row_number() OVER (PARTITION BY qid ORDER BY pass, r, passage_id) AS rank FROM (SELECT qid, passage_id, min((pass, rank, score)) AS x, x[1] AS pass, x[2] AS r, x[3] AS score FROM bh GROUP BY qid, passage_id)")
add("g16_diagnostic_passages", lambda s, d: r.diagnostic_passages(_hits(s, d)).select("qid", "rank", "passage_id"), *_H, "SELECT qid, passage_id, row_number() OVER (PARTITION BY qid ORDER BY document_type IN ('product_page', 'commercial'), hits.rank) AS rank FROM hits QUALIFY row_number() OVER (PARTITION BY qid ORDER BY document_type IN ('product_page', 'commercial'), hits.rank) <= 3")
_man = lambda s, d: s.read.parquet(f"{d}/pages.parquet").select(F.col("url").alias("canonical_url"), (F.col("page_id") % 6 + 1).alias("authority"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"), F.lit("zz").alias("product"), m.pick(m.TYPES, F.col("page_id") % 6).alias("document_type")).dropDuplicates(["canonical_url"])
_WORDS = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'))"
add("g17_documents_for", lambda s, d: r.documents_for(m.questions(s, d).withColumn("text", F.when(F.col("qid").endswith("7"), "???").otherwise(F.col("text"))), _man(s, d)), m.QUESTIONS,
    f"man AS (SELECT url AS canonical_url, page_id % 6 + 1 AS authority, {_WORDS('regexp_extract(html, ' + repr('<h1>([^<]*)</h1>') + ', 1)')} AS w, page_id % 6 = 0 AS sheet FROM pages), qw AS (SELECT qid, CASE WHEN qid LIKE '%7' THEN [] ELSE {_WORDS('text')} END AS w FROM questions)",
    "ov AS (SELECT qid, canonical_url, authority, len(list_intersect(qw.w, man.w)) AS overlap FROM qw, man), h AS (SELECT qid, canonical_url, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, authority, canonical_url) AS rank FROM ov WHERE overlap > 0 QUALIFY rank <= 6)",
    "SELECT * FROM h UNION ALL SELECT qid, canonical_url, rank FROM (SELECT qid FROM questions WHERE qid NOT IN (SELECT qid FROM h)), (SELECT canonical_url, row_number() OVER (ORDER BY authority, canonical_url) AS rank FROM man WHERE sheet QUALIFY rank <= 6)")
add("g18_scoped_evidence", lambda s, d: r.scoped_evidence(_products(s, d), _hits(s, d)).select("qid", "passage_id"), *_H,
    f"SELECT qid, passage_id FROM hits WHERE qid % 50 <> 0 OR {' OR '.join(_MATCH(repr(x), 'product') + f' OR contains(lower(content), {x!r})' for x in ('p1', 'p2', 'p3', 'p4'))}")
PROPS = [("p", ["the", "und", "inger"]), ("q", ["der", "que"])]
_SENT = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(content, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '')"
BIND = f"""pr AS (SELECT * FROM (VALUES ('p', ['the', 'und', 'inger']), ('q', ['der', 'que'])) v(property, terms)),
sb AS (SELECT qid, property, passage_id, rank, tier, list_max(list_transform(list_filter(terms, lambda t: contains(lower(s), t)), lambda t: length(t))) AS term, regexp_matches(s, '[0-9]') AS fig FROM (SELECT qid, passage_id, rank, CASE WHEN q_product = '' OR lower(q_product) = lower(product) THEN 0 WHEN contains(' ' || regexp_replace(lower(content), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g') || ' ', ' ' || lower(q_product) || ' ') THEN 1 ELSE 2 END AS tier, unnest({_SENT}) AS s FROM hits), pr),
gb AS (SELECT qid, property, passage_id, rank, tier, max(term) + max(CASE WHEN fig THEN 100 ELSE 0 END) AS strength FROM sb WHERE term IS NOT NULL GROUP BY ALL),
bd AS (SELECT qid, property, passage_id, strength FROM (SELECT * FROM gb QUALIFY rank() OVER (PARTITION BY qid, property ORDER BY tier, strength DESC) = 1) QUALIFY row_number() OVER (PARTITION BY qid, property ORDER BY rank, passage_id) <= 2)"""
_bind = lambda s, d: r.evidence_binding(q(s, d).withColumn("properties", F.array(F.lit("p"), F.lit("q"))), _hits(s, d), s.createDataFrame(PROPS, "property string, terms array<string>"))
add("g19_evidence_binding", _bind, *_H, BIND, "SELECT qid, property, passage_id, CAST(strength AS BIGINT) AS strength FROM bd")
add("g20_binding_distinguishes", lambda s, d: r.binding_distinguishes(_bind(s, d)), *_H, BIND, "SELECT qid, max(n) = 1 AS distinguishes FROM (SELECT qid, passage_id, count(DISTINCT property) AS n FROM bd GROUP BY ALL) GROUP BY qid")
add("g20_promote_bound", lambda s, d: r.promote_bound(_hits(s, d), _bind(s, d).where("property = 'q'")).select("qid", "rank", "passage_id"), *_H, BIND,
    "one AS (SELECT qid, min(passage_id) AS bound FROM bd WHERE property = 'q' GROUP BY qid HAVING count(*) = 1)", "SELECT qid, passage_id, row_number() OVER (PARTITION BY qid ORDER BY coalesce(passage_id <> bound, true), hits.rank) AS rank FROM hits LEFT JOIN one USING (qid)")
_cav = lambda s, d: p(s, d).select(F.col("canonical_url").alias("url"), F.substring_index("content", ".", 1).alias("sentence"))
add("g21_rank_caveats", lambda s, d: r.rank_caveats(_qt(s, d), _hits(s, d), _cav(s, d)), *_H, QT,
    f"cd AS (SELECT qid, lower(trim(regexp_replace(sentence, '[ \\t\\r\\n]+', ' ', 'g'), ' ')) AS key, sentence, len(list_intersect({_WORDS('sentence')}, {_WORDS('text')})) AS overlap FROM (SELECT DISTINCT qid, canonical_url FROM hits) JOIN (SELECT canonical_url, string_split(content, '.')[1] AS sentence FROM passages) USING (canonical_url) JOIN qt USING (qid))",
    "oc AS (SELECT qid, key, max(overlap) AS overlap, min(sentence) AS sentence FROM cd GROUP BY ALL)", "SELECT qid, sentence, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, length(key), key) AS rank FROM oc QUALIFY rank <= 3")
add("g22_source_rows", lambda s, d: r.source_rows(_hits(s, d)), *_H, "SELECT qid, rank AS marker, canonical_url, row_number() OVER (PARTITION BY qid, canonical_url ORDER BY rank) = 1 AS first_of_document FROM hits")
_ans = lambda s, d: q(s, d).select("qid", F.expr("CASE WHEN qid % 50 = 0 THEN 'A [4] then [2], [4].' ELSE 'B [2] and [9].' END").alias("text"))
add("g22_renumber_citations", lambda s, d: r.renumber_citations(_ans(s, d), r.source_rows(_hits(s, d)))[0], m.QUERIES, "SELECT qid, CASE WHEN qid % 50 = 0 THEN 'A [2] then [1], [2].' ELSE 'B [2] and [9].' END AS text FROM queries")
add("g23_approved_evidence", lambda s, d: r.approved_evidence(q(s, d).select("qid", F.array(F.lit("P1"), F.lit("p5")).alias("approved")), _hits(s, d)).select("qid", "passage_id"), *_H, "SELECT qid, passage_id FROM hits QUALIFY product IN ('p1', 'p5') OR NOT max(product IN ('p1', 'p5')) OVER (PARTITION BY qid)")
_gold = lambda s, d: q(s, d).select("qid", F.lit("tion").alias("text"), F.concat(F.lit("doc://"), F.expr("qid div 4").cast("string")).alias("url"))
add("f8_recall_at_k", lambda s, d: emb.recall_at_k(_hits(s, d).withColumnRenamed("canonical_url", "url"), _gold(s, d)), *_H, "SELECT count(*) AS queries, round(avg(CASE WHEN EXISTS (SELECT 1 FROM hits h WHERE h.qid = q.qid AND contains(content, 'tion') AND contains(canonical_url, 'doc://' || CAST(q.qid // 4 AS VARCHAR))) THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall FROM queries q")
