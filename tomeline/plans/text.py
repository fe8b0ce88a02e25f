"""Section, chunk and embedding queries over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import chunking as c
from ..operators import embeddings as e
from ..operators import sections as x
from ..sources import model as m
from .base import collection

QUERIES, ORACLES, add = collection()

HAZARD, LABEL, SKIP, RULES = "hazard|precaution", "^(the|der|le|la)", "contact us|the best", [("temperature", "(^|[^a-z])(the|und)[^a-z]"), ("diy", "(^|[^a-z])(of|der|le)[^a-z]"), ("incompatibility", "(^|[^a-z])(not|nicht|no)[^a-z]")]
MARK = "chr(1)"


def _docs(s, d):
    return s.read.parquet(f"{d}/documents.parquet")


def _pages(s, d):
    return s.read.parquet(f"{d}/pages.parquet").withColumnRenamed("page_id", "doc_id")


_ZERO = "' ​‌‍﻿'"
CLEAN = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate({c}, {_ZERO}, ' '), '[ \\t]+', ' ', 'g'), '([0-9]) ?m ([23])([^0-9]|$)', '\\1 m\\2\\3', 'g'), '([0-9]) ?° ?([CF])', '\\1 °\\2', 'g'), '([0-9]) %', '\\1%', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ')"
SENTENCES = lambda c: f"list_filter(list_transform(string_split(regexp_replace(regexp_replace({c}, '([.!?])[ \\t\\r\\n]+', '\\1' || {MARK}, 'g'), '\\n+', {MARK}, 'g'), {MARK}), lambda s: trim(s, ' ')), lambda s: s <> '')"
_NOISE = lambda c: f"{c} || ' 1.5 m 2 at 8 ° C, 5 % x'"

add("d1_clean_text", lambda s, d: _docs(s, d).select("doc_id", F.sha2(t.clean_text(t.nfc(F.concat("text", F.lit("   1.5 m 2 at 8 ° C, 5 % x e\u0301a\u030a")))), 256).alias("digest")),
    f"SELECT doc_id, sha256({CLEAN('nfc_normalize(text || chr(32) || chr(160) || chr(32) || ' + repr('1.5 m 2 at 8 ° C, 5 % x e\u0301a\u030a') + ')')}) AS digest FROM documents")
_NOT_SHOWN = "|".join(("script", "style", "noscript", "form", "svg", "head", "nav", "footer"))
_STRIP = "regexp_replace(html, '(?s)<!--.*?-->|" + "|".join(f"<{n}\\b[^>]*>.*?</{n}\\s*>" for n in _NOT_SHOWN.split("|")) + "', '', 'g')"
_UNESC = "replace(replace(replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"
PLAIN = lambda c: CLEAN(_UNESC.replace("{c}", f"regexp_replace(regexp_replace({c}, '<br */?>', chr(10), 'g'), '<[^>]*>', '', 'g')"))
_SECTIONS = f"""body AS (SELECT page_id AS doc_id, {_STRIP} AS body FROM pages),
part AS (SELECT doc_id, i - 1 AS seq, parts[i] AS part FROM (SELECT doc_id, string_split(regexp_replace(body, '<h[1-5][^>]*>', {MARK}, 'g'), {MARK}) AS parts FROM body), unnest(range(1, len(parts) + 1)) u(i)),
cut AS (SELECT doc_id, seq, {PLAIN("regexp_extract(part, '(?s)^(.*?)</h[1-5]>(.*)$', 1)")} AS heading, {PLAIN("CASE WHEN regexp_matches(part, '(?s)^.*?</h[1-5]>') THEN regexp_extract(part, '(?s)^(.*?)</h[1-5]>(.*)$', 2) ELSE part END")} AS text FROM part),
sect AS (SELECT * FROM cut WHERE length(text) >= 40),
lead_ AS (SELECT doc_id, CAST(-1 AS BIGINT) AS seq, '' AS heading, array_to_string(list_filter(list_transform(regexp_extract_all(body, '(?s)<p[^>]*>(.*?)</p>', 1), lambda p: {PLAIN('p')}), lambda p: length(p) > 60)[1:8], chr(10)) AS text
  FROM body WHERE coalesce((SELECT sum(length(text)) FROM sect WHERE sect.doc_id = body.doc_id), 0) < 300),
secs AS (SELECT * FROM sect UNION ALL SELECT * FROM lead_ WHERE text <> '')"""
_secs = lambda s, d: x.html_sections(_pages(s, d))
add("d2_html_sections", lambda s, d: _secs(s, d).select("doc_id", "seq", "heading", F.sha2("text", 256).alias("digest")), _SECTIONS, "SELECT doc_id, seq, heading, sha256(text) AS digest FROM secs")


def _faq(s, d):
    parts = F.transform(F.split("text", "\n"), lambda v, i: F.when(i % 2 == 0, F.concat(F.lit("<dt>"), v, F.lit("</dt>"))).otherwise(F.concat(F.lit("<dd>"), v, F.lit("</dd>"))))
    return _docs(s, d).select("doc_id", F.concat(F.lit("<dl>"), F.concat_ws("", parts), F.lit("</dl>")).alias("html"))


_LINES = "string_split(text, chr(10))"
add("d3_faq_sections", lambda s, d: x.faq_sections(_faq(s, d)).select("doc_id", "seq", F.length("heading").cast("long").alias("h"), F.length("text").cast("long").alias("n")),
    f"q AS (SELECT doc_id, i // 2 AS seq, l[i + 1] AS q, l[i + 2] AS a FROM (SELECT doc_id, {_LINES} AS l FROM documents), unnest(range(0, len(l) - 1, 2)) u(i))",
    f"SELECT doc_id, seq, length({PLAIN('q')}) AS h, length({PLAIN('a')}) AS n FROM q")
add("d4_citable_heading", lambda s, d: _docs(s, d).select("doc_id", t.citable_heading(F.substring_index("text", "\n", 1), F.concat(F.lit("Title "), F.col("source"), F.lit(" | Site"))).alias("heading")),
    """SELECT doc_id, CASE WHEN h <> '' AND length(h) <= 60 AND h NOT LIKE '%.' THEN h WHEN cut <> '' THEN cut WHEN coalesce(name, '') <> '' THEN name ELSE 'Introduction' END AS heading FROM (
      SELECT *, trim(regexp_extract(h, '^(.{3,60}?)(?: [-–—] |: |\\. )', 1), ' ') AS cut, 'Title ' || source AS name FROM (SELECT *, trim(string_split(text, chr(10))[1], ' ') AS h FROM documents))""")  # fmt: skip


def _lines(s, d):
    rows = _docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return rows.select("doc_id", F.floor(F.col("i") / 10).alias("page"), (F.col("i") % 10).cast("long").alias("line"), F.when(F.col("i") % 10 == 9, F.lit("Page footer")).otherwise(F.col("text")).alias("text"), F.when(F.col("i") % 7 == 3, 12.0).otherwise(10.0).alias("size"), (F.col("i") % 11 == 5).alias("bold"))


_HEAD = lambda c: f"(length(trim({c}, ' ')) BETWEEN 3 AND {x.HEADING} AND regexp_matches(trim({c}, ' '), '^[A-Z0-9]') AND regexp_matches({c}, '[A-Za-z]') AND len(regexp_extract_all({c}, '[^ \\t]+')) <= 8 AND NOT (regexp_matches(trim({c}, ' '), '[.,;:]$') AND NOT ends_with(trim({c}, ' '), 's:')) AND lower(trim({c}, ' ')) NOT IN ({', '.join(repr(p) for p in x.PLACEHOLDERS)}))"
_LN = f"""l0 AS (SELECT doc_id, i // 10 AS page, i % 10 AS line, CASE WHEN i % 10 = 9 THEN 'Page footer' ELSE l[i + 1] END AS text, CASE WHEN i % 7 = 3 THEN 12.0::DOUBLE ELSE 10.0 END AS size, i % 11 = 5 AS bold FROM (SELECT doc_id, {_LINES} AS l FROM documents), unnest(range(len(l))) u(i)),
l1 AS (SELECT *, coalesce(lead(text) OVER (PARTITION BY doc_id ORDER BY page, line), '') AS ahead FROM l0),
ln AS (SELECT * EXCLUDE (ahead), length(ahead) > 55 AND NOT {_HEAD('ahead')} AS leads FROM l1),
pg AS (SELECT doc_id, count(DISTINCT page) AS pages FROM ln GROUP BY doc_id),
fu AS (SELECT doc_id, text FROM ln JOIN pg USING (doc_id) WHERE length(text) <= 90 GROUP BY doc_id, text, pages HAVING count(DISTINCT page) >= greatest(3, floor(0.6 * pages))),
kp AS (SELECT ln.* FROM ln ANTI JOIN fu USING (doc_id, text)),
bd AS (SELECT doc_id, max_by(size, (chars, size)) AS body FROM (SELECT doc_id, size, sum(length(text)) AS chars FROM kp GROUP BY ALL) GROUP BY doc_id),
hd AS (SELECT kp.*, {_HEAD('text')} AND (size > body + 0.4 OR (bold AND size >= body - 0.2) OR leads) AS head FROM kp JOIN bd USING (doc_id)),
sq AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY page, line) AS heads FROM hd),
s2 AS (SELECT *, CASE WHEN max(heads) OVER (PARTITION BY doc_id) > 0 THEN heads ELSE page END AS seq FROM sq)"""
add("d5_lines_to_sections", lambda s, d: x.lines_to_sections(_lines(s, d)).select("doc_id", "seq", "heading", F.sha2("text", 256).alias("digest")), _LN,
    "SELECT doc_id, CAST(seq AS BIGINT) AS seq, coalesce(first(text ORDER BY page, line) FILTER (head), '') AS heading, sha256(coalesce(string_agg(text, chr(10) ORDER BY page, line) FILTER (NOT head), '')) AS digest FROM s2 GROUP BY ALL")


def _parts(s, d):
    """Documents as sections of four lines each."""
    g = _docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t")).groupBy("doc_id", F.floor(F.col("i") / 4).alias("seq"))
    return g.agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("x")).select("doc_id", "seq", F.concat(F.lit("Part "), F.col("seq").cast("string")).alias("heading"), F.concat_ws("\n", F.transform("x", lambda r: r["t"])).alias("text"))


_PT = f"pt AS (SELECT doc_id, i // 4 AS seq, 'Part ' || CAST(i // 4 AS VARCHAR) AS heading, string_agg(l[i + 1], chr(10) ORDER BY i) AS text FROM (SELECT doc_id, {_LINES} AS l FROM documents), unnest(range(len(l))) u(i) GROUP BY ALL)"
add("d6_strip_hazard", lambda s, d: x.strip_hazard(_parts(s, d), "part 1", LABEL).select("doc_id", "seq", F.sha2("text", 256).alias("digest")), _PT,
    f"""hl AS (SELECT doc_id, seq, i, l[i + 1] AS t FROM (SELECT doc_id, seq, {_LINES} AS l FROM pt WHERE NOT regexp_matches(lower(heading), 'part 1')), unnest(range(len(l))) u(i)),
    hm AS (SELECT *, CASE WHEN regexp_matches(lower(t), '{LABEL}') AND NOT regexp_matches(t, '[0-9] ?(mm|kg|m2|litres|%)') THEN true WHEN regexp_matches(t, '[0-9] ?(mm|kg|m2|litres|%)') OR length(t) >= 60 THEN false END AS mark FROM hl),
    hi AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id, seq ORDER BY i), false) AS inside FROM hm)""",
    "SELECT doc_id, seq, sha256(text) AS digest FROM (SELECT doc_id, seq, string_agg(t, chr(10) ORDER BY i) AS text FROM hi WHERE NOT inside GROUP BY ALL) WHERE trim(text, ' ') <> ''")


def _links(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<a [^>]*>([^<]*)</a>"), F.lit(1))).alias("nth", "text"))


_LK = "lk AS (SELECT page_id, i AS nth, l[i + 1] AS text FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1) AS l FROM pages), unnest(range(len(l))) u(i))"
add("d7_harvest_names", lambda s, d: x.harvest_names(_links(s, d), "sample|brochure"), _LK, "SELECT lower(text) AS key, min_by(text, (page_id, nth)) AS name FROM lk WHERE length(text) <= 60 AND regexp_matches(text, '^[A-Z]') AND NOT regexp_matches(lower(text), 'sample|brochure') GROUP BY 1")
add("d8_contact_details", lambda s, d: x.contact_details(_docs(s, d).withColumn("text", F.concat("text", F.lit("\nMon to Fri 9:30 to 17:00 daily")))),
    "SELECT doc_id, nullif(regexp_extract(text, '(\\+?[0-9][0-9 ()-]{7,}[0-9])', 1), '') AS phone, nullif(trim(regexp_extract(text || chr(10) || 'Mon to Fri 9:30 to 17:00 daily', '(?i)((?:mon|tue|wed|thu|fri)[a-z]*[^\\n]{0,60}[0-9]{1,2}[:.][0-9]{2}[^\\n]{0,20})', 1), ' '), '') AS hours FROM documents")
_DATES = "CASE doc_id % 4 WHEN 0 THEN 'printed ' || CAST(doc_id % 28 + 1 AS STRING) || '/' || CAST(doc_id % 12 + 1 AS STRING) || '/2021' WHEN 1 THEN 'on ' || CAST(doc_id % 28 + 1 AS STRING) || 'th April 2017' WHEN 2 THEN 'on 45/13/2020' ELSE 'undated' END"
add("d9_iso_date", lambda s, d: _docs(s, d).select("doc_id", t.iso_date(F.expr(_DATES), F.lit("2024-05-06T07:08:09")).alias("day")),
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN strftime(make_date(2021, doc_id % 12 + 1, doc_id % 28 + 1), '%Y-%m-%d') WHEN 1 THEN strftime(make_date(2017, 4, doc_id % 28 + 1), '%Y-%m-%d') ELSE '2024-05-06' END AS day FROM documents")
add("d10_extraction_quality", lambda s, d: x.extraction_quality(_secs(s, d)), _SECTIONS, "SELECT doc_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CASE WHEN sum(length(text)) < 200 THEN 'failed' WHEN count(*) FILTER (heading <> '') >= 3 THEN 'clean' WHEN count(*) FILTER (heading <> '') >= 1 THEN 'partial' ELSE 'flat' END AS quality FROM secs GROUP BY doc_id")
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower(s), '{p}') THEN '{n}'" for n, p in RULES) + " END"
CAVEATS = f"""sn AS (SELECT doc_id, seq, i AS nth, trim(regexp_replace(l[i + 1], '^[-*•·–— ]+', ''), ' ') AS s FROM (SELECT doc_id, seq, {SENTENCES('text')} AS l FROM pt), unnest(range(len(l))) u(i)),
cvt AS (SELECT doc_id, min((seq, nth, {_KIND}, s)) AS x FROM sn WHERE length(s) > 15 AND length(s) < 320 AND NOT regexp_matches(lower(s), '{SKIP}') AND {_KIND} IS NOT NULL GROUP BY doc_id, lower(s))"""
add("d11_caveats", lambda s, d: x.caveats(_parts(s, d), RULES, SKIP).select("doc_id", "type", "sentence"), _PT, CAVEATS, "SELECT doc_id, x[3] AS type, x[4] AS sentence FROM cvt")
_ENTRY = "CASE WHEN page_id % 3 = 0 THEN 'Solo coat, Duo coat | Site' WHEN page_id % 3 = 1 THEN 'Forte for walls' ELSE '' END"
add("d12_product_name", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", t.product_name(F.expr(_ENTRY), F.lit("x | y"), F.expr("concat('http://h/some-thing_', cast(page_id as string), '?q')")).alias("name")),
    "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Solo coat' WHEN 1 THEN 'Forte' ELSE 'Some Thing ' || CAST(page_id AS VARCHAR) END AS name FROM pages")
add("d13_citation_name", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", t.citation_name(F.expr("CASE WHEN page_id % 3 = 0 THEN ' Link | a' END"), F.expr("CASE WHEN page_id % 3 = 1 THEN 'Title|b' ELSE ' ' END"), F.col("url")).alias("name")),
    "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Link' WHEN 1 THEN 'Title' ELSE url END AS name FROM pages")

add("e1_chunk_sections", lambda s, d: c.chunk_sections(_parts(s, d)).select("doc_id", "chunk_index", "heading", F.length("content").cast("long").alias("n")))
_BULLETED = "regexp_replace(text, '\\n', '\\n- ')"
add("e2_split_on_bullets", lambda s, d: _docs(s, d).select("doc_id", F.size(c.split_on_bullets(F.regexp_replace("text", "\\n", "\n- "))).cast("long").alias("pieces")),
    "SELECT doc_id, CASE WHEN len(l) - 1 + CAST(regexp_matches(l[1], '^[ \\t]*(?:[-–—•*·]|[a-z]\\)|[0-9]{1,2}\\.)[ \\t]+') AS INT) >= 2 THEN len(list_filter(list_transform(l, lambda p: trim(p, ' ')), lambda p: p <> '')) ELSE 1 END AS pieces FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
add("e3_paragraph_chunks", lambda s, d: c.paragraph_chunks(_docs(s, d).withColumn("text", F.regexp_replace("text", "\\n", "\n\n"))).select("doc_id", "chunk_index", "section", F.sha2("content", 256).alias("digest")),
    "SELECT doc_id, i AS chunk_index, 'Paragraph ' || CAST(i + 1 AS VARCHAR) AS section, sha256(trim(l[i + 1], ' ')) AS digest FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(len(l))) u(i) WHERE trim(l[i + 1], ' ') <> ''")
add("e4_chunk_id", lambda s, d: m.passages(s, d).select("passage_id", c.chunk_id(F.col("canonical_url"), F.col("version"), F.col("chunk_index")).alias("chunk_id"), F.sha2(c.embedding_text(F.when(F.col("passage_id") % 2 == 0, F.col("product")).otherwise(""), F.when(F.col("passage_id") % 3 == 0, F.col("section")).otherwise(""), F.col("content")), 256).alias("digest")), m.PASSAGES,
    "SELECT passage_id, canonical_url || '#v1-' || CAST(chunk_index AS VARCHAR) AS chunk_id, sha256(CASE WHEN p = '' THEN content ELSE p || chr(10) || content END) AS digest FROM (SELECT *, concat_ws(' — ', CASE WHEN passage_id % 2 = 0 THEN product END, CASE WHEN passage_id % 3 = 0 THEN section END) AS p FROM passages)")
add("e5_chunk_stats", lambda s, d: c.chunk_stats(m.passages(s, d).withColumnRenamed("canonical_url", "doc_id")), m.PASSAGES, "SELECT canonical_url AS doc_id, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars, max(length(content)) AS longest FROM passages GROUP BY 1")


def _cache(s, d):
    return _docs(s, d).where("doc_id % 3 = 0").select(e.embedding_key(F.col("text"), "m", 8).alias("key"), F.array(F.lit(1.0)).alias("embedding")).dropDuplicates(["key"])


_KEY = "'m|8|' || sha256(text)"
_CACHE = f"cache AS (SELECT DISTINCT {_KEY} AS key FROM documents WHERE doc_id % 3 = 0)"
add("f1_embedding_key", lambda s, d: _docs(s, d).select("doc_id", e.embedding_key(F.col("text"), "m", 8).alias("key")), f"SELECT doc_id, {_KEY} AS key FROM documents")
add("f2_cache_lookup", lambda s, d: e.cache_lookup(_docs(s, d), _cache(s, d), "m", 8)[1].select("key"), _CACHE, f"SELECT DISTINCT {_KEY} AS key FROM documents WHERE {_KEY} NOT IN (SELECT key FROM cache)")
add("f2_cache_counts", lambda s, d: e.cache_counts(_docs(s, d), _cache(s, d), "m", 8), _CACHE, f"SELECT count(*) FILTER ({_KEY} IN (SELECT key FROM cache)) AS hits, count(*) FILTER ({_KEY} NOT IN (SELECT key FROM cache)) AS misses FROM documents")
add("f3_embed_missing", lambda s, d: e.embed_missing(e.cache_lookup(_docs(s, d), _cache(s, d), "m", 8)[1], e.letter_embedder(8), 8).select("key", F.size("embedding").alias("dims"), "error"))
add("f4_cache_merge", lambda s, d: e.cache_merge(_cache(s, d).withColumn("at", F.lit(1)), _docs(s, d).where("doc_id % 2 = 0").select(e.embedding_key(F.col("text"), "m", 8).alias("key"), F.array(F.lit(2.0)).alias("embedding"), F.lit(2).alias("at"))).select("key", "at"),
    f"SELECT key, max(n) AS at FROM (SELECT {_KEY} AS key, 1 AS n FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT {_KEY}, 2 FROM documents WHERE doc_id % 2 = 0) GROUP BY key")
_vec = lambda s, d: s.read.parquet(f"{d}/embeddings.parquet")
def _bad():
    return F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 9)).when(F.col("vec_id") % 5 == 1, F.transform("embedding", lambda v: v * 0)).when(F.col("vec_id") % 5 == 2, None).otherwise(F.col("embedding"))
add("f5_vector_fault", lambda s, d: _vec(s, d).select("vec_id", e.vector_fault(_bad(), 64).alias("fault")), "SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 'length' WHEN 1 THEN 'zero' WHEN 2 THEN 'missing' END AS fault FROM embeddings")
add("f6_l2_normalise", lambda s, d: _vec(s, d).select("vec_id", F.round(F.element_at(e.l2_normalise(F.transform("embedding", lambda v: v * 2)), 5), 6).alias("fifth")),
    "SELECT vec_id, round(CAST(embedding[5] * 2 AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda v: CAST(v * 2 AS DOUBLE) * CAST(v * 2 AS DOUBLE)))), 6) AS fifth FROM embeddings")
add("f7_require_compatible", lambda s, d: e.require_compatible(_vec(s, d).agg(F.max(F.size("embedding")).alias("embedding_dimensions")).select(F.lit(True).alias("is_active"), F.lit("m").alias("embedding_model"), "embedding_dimensions", F.lit("1").alias("chunking_version")), "m", 32, "1"),
    "SELECT CASE WHEN max(len(embedding)) <> 32 THEN 'other width' END AS reason FROM embeddings")
