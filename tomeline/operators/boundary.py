"""Corpus boundary and source tables: which urls belong, what they are, how the ledger moves on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OUTSIDE = "outside the corpus boundary"
DEFAULT_REASON = "excluded by rule"


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def corpus_boundary(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url -> keep, reason.  rules(kind, rule, reason, nth), kind one of exact,
    exclude, include; the first kind that applies decides, prefixes in order.
    The rule table is small configuration."""
    rank = F.when(F.col("kind") == "exact", 0).when(F.col("kind") == "exclude", 1).otherwise(2)
    r = F.broadcast(rules.withColumn("rank", rank))
    u = urls.select("url", url_path(F.col("url")).alias("path")).distinct()
    fits = ((F.col("kind") == "exact") & (F.col("path") == F.col("rule"))) | ((F.col("kind") != "exact") & F.startswith("path", "rule"))
    hit = u.join(r, fits, "left").groupBy("url").agg(F.min_by(F.struct("kind", "reason"), F.struct("rank", "nth")).alias("x"))
    keep = F.col("x.kind") == "include"
    return hit.select("url", F.coalesce(keep, F.lit(False)).alias("keep"), F.when(F.col("x.kind").isNull(), OUTSIDE).when(~keep, F.coalesce("x.reason", F.lit(DEFAULT_REASON))).alias("reason"))


def classify_page(url: Column, prefixes: list[tuple[str, str]], default: str = "commercial") -> Column:
    """Document type by the first path prefix that fits."""
    out, path = F.lit(None).cast("string"), url_path(url)
    for prefix, kind in reversed(prefixes):
        out = F.when(F.startswith(path, F.lit(prefix)), kind).otherwise(out)
    return F.coalesce(out, F.lit(default))


def classify_link(text: Column, include: list[str], exclude: list[str], kind: str = "datasheet") -> Column:
    """Type of a link by words of its text; null when empty, excluded or unknown."""
    t = F.lower(F.trim(F.regexp_replace(text, "[ \\t\\r\\n]+", " ")))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w))
    return F.when((t == "") | has(exclude), None).when(has(include), kind)


def extract_links(pages: DataFrame, suffix: str = "") -> DataFrame:
    """url, href, text: first sighting of each target, in order of page and link."""
    pattern = r'<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>'
    host = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    found = pages.select(
        "page_id",
        host.alias("host"),
        F.posexplode(F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), 1).alias("href"), F.regexp_extract_all("html", F.lit(pattern), 2).alias("text"))).alias("nth", "x"),
    ).select("page_id", "nth", F.when(F.startswith("x.href", F.lit("/")), F.concat("host", "x.href")).otherwise(F.col("x.href")).alias("target"), F.col("x.text").alias("text"))
    first = found.where(F.contains("target", F.lit(suffix))).groupBy("target").agg(F.min(F.struct("page_id", "nth", "text")).alias("x"))
    return first.select("target", "x.page_id", "x.nth", "x.text")


def origin(url: Column) -> Column:
    """Scheme, host and port, default ports filled in; null when there is none."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]*)", 1))
    port = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#:]*:([0-9]+)", 1)
    port = F.when(port != "", port).when(scheme == "https", "443").when(scheme == "http", "80").otherwise("")
    return F.when((scheme != "") & (host != ""), F.concat_ws("|", scheme, host, port))


def same_origin(urls: DataFrame, site: str) -> DataFrame:
    return urls.select("url", F.coalesce(origin(F.col("url")) == origin(F.lit(site)), F.lit(False)).alias("same"))


def sitemap_urls(docs: DataFrame) -> DataFrame:
    """The <loc> values; fails when there is none at all (an empty sitemap is an error, not an empty corpus)."""
    locs = docs.select(F.explode(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("url"))
    n = docs.agg(F.coalesce(F.sum(F.regexp_count("xml", F.lit(r"<loc>\s*[^<\s]+\s*</loc>"))), F.lit(0)).alias("n"))
    fails = n.select(F.when(F.col("n") == 0, F.raise_error(F.lit("empty sitemap")).cast("string")).alias("url")).where("url is not null")
    return locs.unionByName(fails).distinct()


def reconcile_ledger(ledger: DataFrame, fetched: DataFrame, now) -> DataFrame:
    """Ledger after a fetch, by content hash: new, same (only checked_at moves) or
    changed (version + 1, supersedes, old record into history)."""
    old = ledger.select("url", *[F.col(c).alias(f"old_{c}") for c in ("content_hash", "version", "first_seen_at", "checked_at", "supersedes", "history")])
    j = old.join(fetched.select("url", "content_hash"), "url", "full")
    same = F.col("content_hash") == F.col("old_content_hash")
    new, gone = F.col("old_content_hash").isNull(), F.col("content_hash").isNull()
    record = F.struct(F.col("old_version").alias("version"), F.col("old_content_hash").alias("content_hash"))
    return j.select(
        "url",
        F.coalesce("content_hash", "old_content_hash").alias("content_hash"),
        F.when(new, 1).when(gone | same, F.col("old_version")).otherwise(F.col("old_version") + 1).cast("long").alias("version"),
        F.coalesce("old_first_seen_at", F.lit(now)).alias("first_seen_at"),
        F.when(gone, F.col("old_checked_at")).otherwise(F.lit(now)).alias("checked_at"),
        F.when(new | gone | same, F.col("old_supersedes")).otherwise(F.col("old_content_hash")).alias("supersedes"),
        F.when(new, F.array().cast("array<struct<version:bigint,content_hash:string>>")).when(gone | same, F.col("old_history")).otherwise(F.array_append("old_history", record)).alias("history"),
    )


def deactivate_unfetched(ledger: DataFrame, fetched: DataFrame, errors: DataFrame) -> DataFrame:
    """Ledger with active: urls that were not fetched become inactive, but only in a run without errors."""
    n = F.broadcast(errors.agg(F.count("*").alias("n_errors")))
    seen = fetched.select("url", F.lit(True).alias("seen")).distinct()
    return ledger.join(seen, "url", "left").crossJoin(n).withColumn("active", F.col("active") & (F.col("seen").isNotNull() | (F.col("n_errors") > 0))).drop("seen", "n_errors")


def source_counts(fetched: DataFrame, skipped: DataFrame) -> DataFrame:
    """kind, value, n: fetched by document type and change, skipped by reason."""
    sets = fetched.groupingSets([["document_type"], ["change"]], "document_type", "change").agg(F.count("*").alias("n"), F.grouping("document_type").alias("g"))
    f = sets.select(F.when(F.col("g") == 0, "document_type").otherwise("change").alias("kind"), F.when(F.col("g") == 0, F.col("document_type")).otherwise(F.col("change")).alias("value"), "n")
    return f.unionByName(skipped.groupBy("reason").agg(F.count("*").alias("n")).select(F.lit("skipped").alias("kind"), F.col("reason").alias("value"), "n"))
