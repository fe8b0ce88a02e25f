"""Boundary, ledger, version and snapshot queries over two releases of pages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import boundary as b
from ..operators import versions as v
from ..sources import model as m
from .base import collection

QUERIES, ORACLES, add = collection()

#: Boundary rules over the paths of pages (/en/12 and so on).
RULES = [("exact", "/en/25", "a test page", 0), ("exclude", "/de/", None, 0), ("exclude", "/es/1", "old section", 1), ("include", "/en/", None, 0), ("include", "/fr", None, 1), ("include", "/es", None, 2)]
PREFIXES = [("/en/1", "datasheet"), ("/en/", "guide"), ("/fr/", "faq")]
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
NOW, FIRST = "2024-02-01", "2024-01-01"


def _pages(s, d):
    return s.read.parquet(f"{d}/pages.parquet")


def _rules(s):
    return s.createDataFrame(RULES, "kind string, rule string, reason string, nth int")


_BOUNDARY = "CASE " + " ".join(
    f"WHEN {'path = ' if k == 'exact' else 'starts_with(path, '}'{r}'{'' if k == 'exact' else ')'} THEN {'NULL' if k == 'include' else repr(why or b.DEFAULT_REASON)}" for k, r, why, _ in sorted(RULES, key=lambda x: (["exact", "exclude", "include"].index(x[0]), x[3]))
) + f" ELSE '{b.OUTSIDE}' END"
add("b1_corpus_boundary", lambda s, d: b.corpus_boundary(_pages(s, d), _rules(s)), f"SELECT url, {_BOUNDARY} IS NULL AS keep, {_BOUNDARY} AS reason FROM (SELECT DISTINCT url, {PATH} AS path FROM pages)")
add("b2_classify_page", lambda s, d: _pages(s, d).select("page_id", b.classify_page(F.col("url"), PREFIXES).alias("document_type")),
    "SELECT page_id, CASE " + " ".join(f"WHEN starts_with({PATH}, '{p}') THEN '{t}'" for p, t in PREFIXES) + " ELSE 'commercial' END AS document_type FROM pages")
_A = """links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS text, unnest(range(len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)))) AS nth, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS host FROM pages)"""
add("b3_classify_link", lambda s, d: b.extract_links(_pages(s, d)).select("target", b.classify_link(F.col("text"), ["th", "the"], ["and", "re"]).alias("kind")), _A,
    """SELECT target, CASE WHEN t = '' OR contains(t, 'and') OR contains(t, 're') THEN NULL WHEN contains(t, 'th') THEN 'datasheet' END AS kind FROM (
       SELECT target, lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))) AS t FROM (SELECT CASE WHEN starts_with(href, '/') THEN host || href ELSE href END AS target, *, row_number() OVER (PARTITION BY target ORDER BY page_id, nth) AS r FROM links) WHERE r = 1)""")  # fmt: skip
add("b4_extract_links", lambda s, d: b.extract_links(_pages(s, d), "th").withColumn("nth", F.col("nth").cast("long")), _A,
    "SELECT target, page_id, nth, text FROM (SELECT CASE WHEN starts_with(href, '/') THEN host || href ELSE href END AS target, page_id, nth, text, row_number() OVER (PARTITION BY target ORDER BY page_id, nth) AS r FROM links) WHERE r = 1 AND contains(target, 'th')")
add("b5_same_origin", lambda s, d: b.same_origin(_pages(s, d).select("url").distinct(), "https://thther.example.org:443/"),
    "SELECT url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) = 'https' AND lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) = 'thther.example.org' AND regexp_extract(url, '^[A-Za-z]+://[^/?#:]*:([0-9]+)', 1) IN ('', '443') AS same FROM (SELECT DISTINCT url FROM pages)")


def _sitemaps(s, d):
    return _pages(s, d).groupBy((F.col("page_id") % 10).alias("g")).agg(F.concat(F.lit("<urlset>"), F.concat_ws("", F.sort_array(F.collect_list(F.concat(F.lit("<url><loc> "), "url", F.lit("</loc></url>"))))), F.lit("</urlset>")).alias("xml"))


add("b6_sitemap_urls", lambda s, d: b.sitemap_urls(_sitemaps(s, d)), "SELECT DISTINCT url FROM pages WHERE regexp_matches(url, '^[^<[:space:]]+$')")


def _ledger(s, d):
    a = m.release(s, d, "A").groupBy("url").agg(F.min("content_hash").alias("content_hash"))
    return a.select("url", "content_hash", F.lit(1).cast("long").alias("version"), F.lit(FIRST).alias("first_seen_at"), F.lit(FIRST).alias("checked_at"), F.lit(None).cast("string").alias("supersedes"), F.array().cast("array<struct<version:bigint,content_hash:string>>").alias("history"), F.lit(True).alias("active"))


def _b(s, d):
    return m.release(s, d, "B").groupBy("url").agg(F.min("content_hash").alias("content_hash"))


_L = "la AS (SELECT url, min(content_hash) AS h FROM release_a GROUP BY url), lb AS (SELECT url, min(content_hash) AS h FROM release_b GROUP BY url), j AS (SELECT url, la.h AS a, lb.h AS b FROM la FULL JOIN lb USING (url))"
add("b7_reconcile_ledger", lambda s, d: b.reconcile_ledger(_ledger(s, d), _b(s, d), NOW).withColumn("history", F.concat_ws(",", F.transform("history", lambda x: F.concat_ws(":", x["version"].cast("string"), x["content_hash"])))), m.RELEASES, _L,
    f"SELECT url, coalesce(b, a) AS content_hash, CAST(CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a <> b THEN 2 ELSE 1 END AS BIGINT) AS version, CASE WHEN a IS NULL THEN '{NOW}' ELSE '{FIRST}' END AS first_seen_at, CASE WHEN b IS NULL THEN '{FIRST}' ELSE '{NOW}' END AS checked_at, CASE WHEN a <> b THEN a END AS supersedes, CASE WHEN a <> b THEN '1:' || a ELSE '' END AS history FROM j")
add("b8_deactivate_unfetched", lambda s, d: b.deactivate_unfetched(_ledger(s, d), _b(s, d), _b(s, d).limit(0)).select("url", "active"), m.RELEASES, _L, "SELECT url, b IS NOT NULL AS active FROM j WHERE a IS NOT NULL")
_delta = lambda s, d, errors=False: v.classify_delta(_ledger(s, d), _b(s, d).withColumn("read_hash", F.when(~F.col("url").endswith("7"), F.col("content_hash"))), _pages(s, d).where("page_id % 30 = 0").select("url"), errors)
_DELTA = """delta AS (SELECT url, CASE WHEN b IS NOT NULL AND url LIKE '%7' THEN 'failed' WHEN a IS NULL THEN 'new' WHEN b IS NULL THEN CASE WHEN url IN (SELECT url FROM pages WHERE page_id % 30 = 0) THEN 'unchanged' ELSE 'removed' END WHEN a = b THEN 'unchanged' ELSE 'changed' END AS change FROM j)"""
add("c1_classify_delta", _delta, m.RELEASES, _L, _DELTA, "SELECT * FROM delta")
add("b9_source_counts", lambda s, d: b.source_counts(_pages(s, d).select(m.pick(m.TYPES, F.col("page_id") % 6).alias("document_type"), "url").join(_delta(s, d), "url"), b.corpus_boundary(_pages(s, d), _rules(s)).where("not keep")), m.RELEASES, _L, _DELTA,
    f"""p AS (SELECT {m._sql_pick(m.TYPES, 'page_id % 6')} AS document_type, change FROM pages JOIN delta USING (url)), k AS (SELECT {_BOUNDARY} AS reason FROM (SELECT DISTINCT url, {PATH} AS path FROM pages))""",
    "SELECT 'document_type' AS kind, document_type AS value, count(*) AS n FROM p GROUP BY 2 UNION ALL SELECT 'change', change, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'skipped', reason, count(*) FROM k WHERE reason IS NOT NULL GROUP BY 2")
add("c2_verify_hashes", lambda s, d: v.verify_hashes(m.release(s, d, "B").withColumn("content_hash", F.when(F.col("page_id") % 13 == 0, F.lit("other")).otherwise(F.col("content_hash")))).groupBy("valid").agg(F.count("*").alias("n")), m.RELEASES, "SELECT page_id % 13 <> 0 AS valid, count(*) AS n FROM release_b WHERE html IS NOT NULL GROUP BY 1")


def _first_pages(pages):
    """Of the pages of one url, the one with the least page_id."""
    return pages.withColumn("nth", F.row_number().over(W.partitionBy("url").orderBy("page_id", "content_hash"))).where("nth = 1").drop("nth")


def _cut(pages, *cols):
    """A row for each 1,000 characters of html: cols, i, content."""
    parts = F.posexplode(F.sequence(F.lit(0), F.floor(F.length("html") / 1000).cast("int"))).alias("i", "x")
    return pages.select(*cols, "html", parts).withColumn("content", F.expr("substring(html, i * 1000 + 1, 1000)")).drop("html", "x")


def tables(s, d) -> v.Tables:
    """Snapshot tables of release A: pages as documents, a chunk for each 1,000 characters of html."""
    p = _first_pages(m.release(s, d, "A"))
    one = F.lit(1).cast("long").alias("version")
    audience = m.pick(["public", "trade", "staff", "public"], F.col("page_id") % 4).alias("audience")
    chunk = _cut(p, "url", one, "page_id", audience)
    return {
        "documents": p.select("url", F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), "document_type", (F.col("page_id") % 6 + 1).alias("authority"), audience, F.concat(F.lit("p"), (F.col("page_id") % 10).cast("string")).alias("product")),
        "versions": p.select("url", one, "content_hash", F.lit(True).alias("is_active"), F.lit(FIRST).alias("fetched_at"), F.lit(None).cast("string").alias("supersedes")),
        "chunks": chunk.select("url", "version", F.col("i").cast("long").alias("chunk_index"), "content", "audience", F.when(F.col("page_id") % 9 != 0, F.array(F.lit(1.0))).alias("embedding")),
        "caveats": p.where("page_id % 5 = 0").select("url", one, F.lit("diy").alias("type"), F.concat(F.lit("Caveat "), F.col("page_id").cast("string")).alias("sentence")),
        "excluded": b.corpus_boundary(_pages(s, d), _rules(s)).where("not keep").select("url", "reason"),
    }


def updated(s, d) -> v.Tables:
    """The tables after release B: changed and new pages come in, removed ones go."""
    t = tables(s, d)
    change = _delta(s, d)
    p = _first_pages(m.release(s, d, "B")).join(change.where("change in ('new', 'changed')"), "url", "left_semi")
    up = {
        "documents": p.select("url", F.concat(F.lit("Page "), F.col("page_id").cast("string"), F.lit(" B")).alias("title"), "document_type", (F.col("page_id") % 6 + 1).alias("authority"), F.lit("public").alias("audience"), F.concat(F.lit("p"), (F.col("page_id") % 10).cast("string")).alias("product")),
        "versions": p.select("url", "content_hash", F.lit(NOW).alias("fetched_at")),
        "chunks": _cut(p, "url").select("url", F.col("i").cast("long").alias("chunk_index"), "content", F.lit("public").alias("audience"), F.array(F.lit(1.0)).alias("embedding")),
        "caveats": p.where("page_id % 5 = 0").select("url", F.lit("diy").alias("type"), F.concat(F.lit("Caveat B "), F.col("page_id").cast("string")).alias("sentence")),
    }
    return v.apply_delta(t, up, change.where("change = 'removed'"))


_AUD = m._sql_pick(["public", "trade", "staff", "public"], "page_id % 4")
_T = f"""pa AS (SELECT * FROM release_a QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
pb AS (SELECT release_b.* FROM release_b JOIN delta USING (url) WHERE change IN ('new', 'changed') QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
rm AS (SELECT url FROM delta WHERE change = 'removed'),
v1 AS (SELECT url, CAST(1 AS BIGINT) AS version, content_hash, url NOT IN (SELECT url FROM pb) AND url NOT IN (SELECT url FROM rm) AS is_active, '{FIRST}' AS fetched_at, CAST(NULL AS VARCHAR) AS supersedes FROM pa),
vs AS (SELECT * FROM v1 UNION ALL SELECT pb.url, CASE WHEN v1.url IS NULL THEN 1 ELSE 2 END, pb.content_hash, true, '{NOW}', v1.content_hash FROM pb LEFT JOIN v1 USING (url)),
ck AS (SELECT url, CAST(1 AS BIGINT) AS version, i AS chunk_index, substr(html, CAST(i * 1000 + 1 AS BIGINT), 1000) AS content, {_AUD} AS audience, page_id % 9 <> 0 AS embedded FROM (SELECT *, unnest(range(length(html) // 1000 + 1)) AS i FROM pa)
  UNION ALL SELECT url, vs.version, i, substr(html, CAST(i * 1000 + 1 AS BIGINT), 1000), 'public', true FROM (SELECT *, unnest(range(length(html) // 1000 + 1)) AS i FROM pb) pb JOIN vs USING (url, content_hash) WHERE vs.fetched_at = '{NOW}'),
dc AS (SELECT url, 'Page ' || CAST(page_id AS VARCHAR) AS title, document_type, page_id % 6 + 1 AS authority, {_AUD} AS audience, 'p' || CAST(page_id % 10 AS VARCHAR) AS product FROM pa WHERE url NOT IN (SELECT url FROM pb)
  UNION ALL SELECT url, 'Page ' || CAST(page_id AS VARCHAR) || ' B', document_type, page_id % 6 + 1, 'public', 'p' || CAST(page_id % 10 AS VARCHAR) FROM pb),
cv AS (SELECT url, CAST(1 AS BIGINT) AS version, 'diy' AS type, 'Caveat ' || CAST(page_id AS VARCHAR) AS sentence FROM pa WHERE page_id % 5 = 0
  UNION ALL SELECT pb.url, vs.version, 'diy', 'Caveat B ' || CAST(page_id AS VARCHAR) FROM pb JOIN vs ON vs.url = pb.url AND vs.fetched_at = '{NOW}' WHERE page_id % 5 = 0)"""
_ALL = (m.RELEASES, _L, _DELTA, _T)
add("c3_apply_delta", lambda s, d: updated(s, d)["versions"], *_ALL, "SELECT * FROM vs")
add("c3_apply_delta_chunks", lambda s, d: updated(s, d)["chunks"].select("url", "version", "chunk_index", F.length("content").cast("long").alias("n")), *_ALL, "SELECT url, version, chunk_index, length(content) AS n FROM ck")
add("c4_publish", lambda s, d: v.publish(updated(s, d) | {"versions": updated(s, d)["versions"].where("version = 1")})["chunks"].groupBy("url").agg(F.count("*").alias("n")), *_ALL, "SELECT url, count(*) AS n FROM ck WHERE version = 1 GROUP BY url")
add("c6_snapshot_manifest", lambda s, d: v.snapshot_manifest(updated(s, d)), *_ALL, "SELECT url, version, content_hash, (SELECT count(*) FROM ck WHERE ck.url = vs.url AND ck.version = vs.version) AS chunks FROM vs WHERE is_active")
add("c6_snapshot_counts", lambda s, d: v.snapshot_counts(updated(s, d)), *_ALL, "SELECT count(*) AS document_count, CAST(sum((SELECT count(*) FROM ck WHERE ck.url = vs.url AND ck.version = vs.version)) AS BIGINT) AS chunk_count FROM vs WHERE is_active")
add("c7_active_hashes", lambda s, d: v.active_hashes(updated(s, d)), *_ALL, "SELECT url, content_hash FROM vs WHERE is_active")
add("c8_served_passages", lambda s, d: v.served_passages(updated(s, d)).select("url", "version", "chunk_index", "title", "audience", "authority"), *_ALL, "SELECT url, version, chunk_index, title, ck.audience, authority FROM ck JOIN vs USING (url, version) JOIN dc USING (url) WHERE is_active AND embedded")
add("c9_version_history", lambda s, d: v.version_history(updated(s, d)).select("url", "version", "is_active"), *_ALL, "SELECT url, version, is_active FROM vs")
add("c9_recent_runs", lambda s, d: v.recent_runs(m.cases(s, d).select(F.col("case_id").alias("run_id"), F.col("at").alias("started_at")), 10).select("run_id"), m.CASES, "SELECT run_id FROM (SELECT case_id AS run_id, cases.\"at\" AS t FROM cases) ORDER BY t DESC, run_id DESC LIMIT 10")


def _audit(s, d):
    c = updated(s, d)["chunks"].where("chunk_index = 0")
    ident = F.concat("url", F.lit("#v"), F.col("version").cast("string"), F.lit("-"), F.col("chunk_index").cast("string"))
    return c.select(F.concat(F.lit("a"), F.col("url"), F.col("version").cast("string")).alias("answer_id"), F.when(F.col("version") == 1, "2024-03-01").otherwise("2024-01-15").alias("asked_at"), F.when(F.length("url") % 2 == 0, "snap").alias("snapshot_id"), F.array(ident).alias("chunk_ids"))


add("c10_audit_lineage", lambda s, d: v.audit_lineage(_audit(s, d), updated(s, d)).select("answer_id", "version", F.length("content").cast("long").alias("n"), "still_active"), *_ALL,
    """lg AS (SELECT 'a' || url || CAST(version AS VARCHAR) AS answer_id, url, version AS stated, CASE WHEN version = 1 THEN '2024-03-01' ELSE '2024-01-15' END AS asked_at, length(url) % 2 = 0 AS snap FROM ck WHERE chunk_index = 0),
    r AS (SELECT answer_id, url, CASE WHEN snap THEN stated ELSE (SELECT max_by(version, (fetched_at, version)) FROM vs WHERE vs.url = lg.url AND fetched_at <= asked_at) END AS version FROM lg)""",
    "SELECT answer_id, r.version, length(content) AS n, coalesce(is_active, false) AS still_active FROM r LEFT JOIN vs ON vs.url = r.url AND vs.version = r.version LEFT JOIN ck ON ck.url = r.url AND ck.version = r.version AND chunk_index = 0")
add("c11_manifest", lambda s, d: v.manifest(updated(s, d), ["public", "trade"]), *_ALL, "SELECT * FROM dc WHERE audience IN ('public', 'trade') AND url IN (SELECT url FROM vs WHERE is_active)")
add("c12_lookup_document", lambda s, d: v.lookup_document(updated(s, d), _pages(s, d).where("page_id % 3 = 0").select("url").distinct()), *_ALL, "SELECT u.url, title, document_type, authority, audience, product FROM (SELECT DISTINCT url FROM pages WHERE page_id % 3 = 0) u LEFT JOIN dc USING (url)")
add("c12_caveats_for", lambda s, d: v.caveats_for(updated(s, d)), *_ALL, "SELECT cv.* FROM cv JOIN vs USING (url, version) WHERE is_active")
add("c12_excluded", lambda s, d: v.excluded(tables(s, d)), f"SELECT url, {_BOUNDARY} AS reason FROM (SELECT DISTINCT url, {PATH} AS path FROM pages) WHERE {_BOUNDARY} IS NOT NULL")


def _broken(s, d):
    t = updated(s, d)
    return t | {"versions": t["versions"].withColumn("is_active", F.lit(True)), "documents": t["documents"].where("authority != 3").withColumn("audience", F.when(F.col("authority") == 2, "nobody").otherwise(F.col("audience")))}


add("c13_check_invariants", lambda s, d: v.check_invariants(_broken(s, d)), *_ALL,
    """SELECT 'several active versions' AS "check", url AS key, count(*) AS n FROM vs GROUP BY url HAVING count(*) > 1
    UNION ALL SELECT 'unknown audience', url, count(*) FROM dc WHERE authority = 2 GROUP BY url
    UNION ALL SELECT 'version without document', url, count(*) FROM vs WHERE url NOT IN (SELECT url FROM dc WHERE authority <> 3) GROUP BY url""")  # fmt: skip


def _snapshot(s, d):
    return v.snapshot_counts(tables(s, d)).select(F.lit(True).alias("is_active"), F.lit("model").alias("embedding_model"), F.lit(64).alias("embedding_dimensions"), F.lit("2.0").alias("chunking_version"))


add("c14_needs_reprocess", lambda s, d: v.needs_reprocess(_snapshot(s, d), "model", 64, "2.1", _delta(s, d).where("change = 'failed'")), m.RELEASES, _L, _DELTA, "SELECT true AS reprocess, count(*) > 0 AS refused FROM delta WHERE change = 'failed'")
_quality = lambda s, d: _pages(s, d).groupBy("url").agg(F.max(F.when(F.length("html") > 3000, "clean").otherwise("partial")).alias("quality"))
add("c15_ingestion_report", lambda s, d: v.ingestion_report(_delta(s, d), updated(s, d), _quality(s, d)), *_ALL,
    """lc AS (SELECT url, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars FROM ck JOIN vs USING (url, version) WHERE is_active GROUP BY url), lv AS (SELECT url, count(*) AS caveats FROM cv JOIN vs USING (url, version) WHERE is_active GROUP BY url),
    q AS (SELECT url, max(CASE WHEN length(html) > 3000 THEN 'clean' ELSE 'partial' END) AS quality FROM pages GROUP BY url)""",
    "SELECT url, change, quality, coalesce(chunks, 0) AS chunks, coalesce(chars, 0) AS chars, coalesce(caveats, 0) AS caveats FROM delta LEFT JOIN q USING (url) LEFT JOIN lc USING (url) LEFT JOIN lv USING (url)")
add("c16_table_counts", lambda s, d: v.table_counts(updated(s, d)), *_ALL, f"SELECT 'documents' AS table_name, count(*) AS n FROM dc UNION ALL SELECT 'versions', count(*) FROM vs UNION ALL SELECT 'chunks', count(*) FROM ck UNION ALL SELECT 'caveats', count(*) FROM cv UNION ALL SELECT 'excluded', count(*) FROM (SELECT DISTINCT url, {PATH} AS path FROM pages) WHERE {_BOUNDARY} IS NOT NULL")
add("c17_authored_collisions", lambda s, d: v.authored_collisions(_pages(s, d).where("page_id % 7 = 1").select("url"), m.release(s, d, "B")), m.RELEASES, "SELECT DISTINCT url FROM release_b WHERE url IN (SELECT url FROM pages WHERE page_id % 7 = 1)")
