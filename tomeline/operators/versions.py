"""Document versions: deltas between releases, snapshots, lineage and invariants.

tables is a dictionary of DataFrames: documents (url, title, document_type,
authority, audience, product), versions (url, version, content_hash, is_active,
fetched_at, supersedes), chunks (url, version, chunk_index, content, audience,
embedding), caveats (url, version, type, sentence), excluded (url, reason).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


def classify_delta(served: DataFrame, fetched: DataFrame, protected: DataFrame, had_errors: bool) -> DataFrame:
    """url, change: new, changed, unchanged, failed or removed, against the hashes
    being served.  fetched: url, content_hash (recorded), read_hash (of the bytes,
    null if missing).  Removal needs a run without errors and an unprotected url."""
    j = served.select("url", F.col("content_hash").alias("old")).join(fetched, "url", "full").join(protected.select("url", F.lit(True).alias("protected")).distinct(), "url", "left")
    change = (
        F.when(F.col("content_hash").isNotNull() & ~F.equal_null("content_hash", "read_hash"), "failed")
        .when(F.col("old").isNull(), "new")
        .when(F.col("content_hash").isNull(), F.when(F.lit(had_errors) | F.col("protected").isNotNull(), "unchanged").otherwise("removed"))
        .when(F.col("old") == F.col("content_hash"), "unchanged")
        .otherwise("changed")
    )
    return j.select("url", change.alias("change"))


def verify_hashes(fetched: DataFrame) -> DataFrame:
    """url, valid: the recorded hash is that of the bytes read."""
    return fetched.select("url", F.coalesce(F.sha2("html", 256) == F.col("content_hash"), F.lit(False)).alias("valid"))


def active_hashes(tables: Tables) -> DataFrame:
    return tables["versions"].where("is_active").select("url", "content_hash")


def apply_delta(tables: Tables, updates: Tables, removed: DataFrame, excluded: DataFrame | None = None) -> Tables:
    """Tables after the updates: old versions inactive, new ones max + 1 and active;
    removed documents keep their history, inactive.  updates has documents,
    versions (url, content_hash, fetched_at), chunks and caveats without versions."""
    top = tables["versions"].groupBy("url").agg(F.max("version").alias("top"), F.max_by("content_hash", F.when(F.col("is_active"), F.col("version"))).alias("served"))
    new = updates["versions"].join(top, "url", "left").select(
        "url", (F.coalesce("top", F.lit(0)) + 1).alias("version"), "content_hash", F.lit(True).alias("is_active"), "fetched_at", F.col("served").alias("supersedes")
    )
    touched = updates["versions"].select("url").unionByName(removed.select("url")).distinct().withColumn("touched", F.lit(True))
    kept = tables["versions"].join(touched, "url", "left").withColumn("is_active", F.col("is_active") & F.col("touched").isNull()).drop("touched")
    number = new.select("url", "version")
    out = {
        "versions": kept.unionByName(new),
        "documents": tables["documents"].join(updates["documents"].select("url"), "url", "left_anti").unionByName(updates["documents"]),
        "chunks": tables["chunks"].unionByName(updates["chunks"].join(number, "url").select(tables["chunks"].columns)),
        "caveats": tables["caveats"].unionByName(updates["caveats"].join(number, "url").select(tables["caveats"].columns)),
        "excluded": tables["excluded"] if excluded is None else excluded,
    }
    return out


def publish(tables: Tables) -> Tables:
    """The tables of one snapshot: chunks and caveats without a version are dropped."""
    known = tables["versions"].select("url", "version")
    return tables | {n: tables[n].join(known, ["url", "version"], "left_semi") for n in ("chunks", "caveats")}


def live(tables: Tables, name: str) -> DataFrame:
    return tables[name].join(tables["versions"].where("is_active").select("url", "version"), ["url", "version"], "left_semi")


def snapshot_manifest(tables: Tables) -> DataFrame:
    """One row per live url with its version, hash and chunk count: the manifest,
    computed from the tables."""
    v = tables["versions"].where("is_active")
    n = tables["chunks"].groupBy("url", "version").agg(F.count("*").alias("chunks"))
    return v.join(n, ["url", "version"], "left").select("url", "version", "content_hash", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def snapshot_counts(tables: Tables) -> DataFrame:
    m = snapshot_manifest(tables)
    return m.agg(F.count("*").alias("document_count"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunk_count"))


def served_passages(tables: Tables) -> DataFrame:
    """Chunks of active versions that have an embedding, with their document."""
    return live(tables, "chunks").where("embedding is not null").join(tables["documents"].drop("audience"), "url")


def version_history(tables: Tables, url: str | None = None) -> DataFrame:
    v = tables["versions"] if url is None else tables["versions"].where(F.col("url") == url)
    return v.orderBy("url", F.desc("version"))


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def as_of(asks: DataFrame, versions: DataFrame, bucket: str = "day") -> DataFrame:
    """answer_id, chunk_id, as_of: the version of the ask's url fetched last by asked_at (of several
    at one time, the greatest); none: no row.

    A merge in time: asks and versions of a url are one sequence, and the latest version is
    carried along it.  Within a bucket of time it is a running maximum; from bucket to bucket
    the buckets' maxima are carried.  So rows are asks plus versions, however many a url has
    of both, and no task has more of a url than a bucket's, or a row a bucket."""
    kind = "struct<fetched_at:timestamp,version:bigint>"
    seen = versions.where("fetched_at is not null").select("url", F.col("fetched_at").cast("timestamp").alias("at"), F.lit(0).alias("asks"), F.struct(F.col("fetched_at").cast("timestamp"), F.col("version").cast("long")).cast(kind).alias("v"))
    asked = asks.where("asked_at is not null").select("url", F.col("asked_at").cast("timestamp").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast(kind).alias("v"), F.struct("answer_id", "chunk_id").alias("of"))
    rows = seen.withColumn("of", F.lit(None).cast(asked.schema["of"].dataType)).unionByName(asked).withColumn("bucket", F.date_trunc(bucket, "at"))
    before = W.partitionBy("url").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.groupBy("url", "bucket").agg(F.max("v").alias("latest"), F.max("asks").alias("asked")).withColumn("carried", F.max("latest").over(before)).where("asked = 1").select("url", "bucket", "carried")
    within = W.partitionBy("url", "bucket").orderBy("at", "asks").rowsBetween(W.unboundedPreceding, 0)
    last = rows.withColumn("here", F.max("v").over(within)).where("asks = 1").join(carried, ["url", "bucket"], "left")
    found = last.select("of.*", F.greatest("here", "carried")["version"].alias("as_of")).where("as_of is not null")
    return found.groupBy("answer_id", "chunk_id").agg(F.max("as_of").alias("as_of"))


def audit_lineage(log: DataFrame, tables: Tables) -> DataFrame:
    """Per logged answer and chunk id (url#vN-i): what was served then and whether
    it still is.  Without a snapshot the version is the latest one fetched by then."""
    pattern = r"^(.*)#v([0-9]+)-([0-9]+)$"
    x = log.select("answer_id", "asked_at", "snapshot_id", F.explode("chunk_ids").alias("chunk_id"))
    x = x.select("*", F.regexp_extract("chunk_id", pattern, 1).alias("url"), F.expr(f"try_cast(regexp_extract(chunk_id, r'{pattern}', 2) as bigint)").alias("stated"), F.expr(f"try_cast(regexp_extract(chunk_id, r'{pattern}', 3) as bigint)").alias("chunk_index"))
    v = tables["versions"].select("url", "version", "is_active", "fetched_at")
    then = as_of(x.where("snapshot_id is null").select("answer_id", "chunk_id", "url", "asked_at"), v)
    x = x.join(then, ["answer_id", "chunk_id"], "left").withColumn("version", F.when(F.col("snapshot_id").isNull(), F.col("as_of")).otherwise(F.col("stated")))
    c = tables["chunks"].select("url", "version", "chunk_index", "content")
    return x.join(v.select("url", "version", "is_active"), ["url", "version"], "left").join(c, ["url", "version", "chunk_index"], "left").select("answer_id", "chunk_id", "url", "version", "content", F.coalesce("is_active", F.lit(False)).alias("still_active"))


def manifest(tables: Tables, audiences: list[str]) -> DataFrame:
    """Live documents these audiences may see, by authority and url."""
    d = tables["documents"].where(F.col("audience").isin(*audiences))
    return d.join(tables["versions"].where("is_active").select("url"), "url", "left_semi").orderBy("authority", "url")


def lookup_document(tables: Tables, urls: DataFrame) -> DataFrame:
    """Identity by url, whatever the audience; unknown urls have null columns."""
    return urls.select("url").join(tables["documents"], "url", "left")


def caveats_for(tables: Tables) -> DataFrame:
    return live(tables, "caveats")


def excluded(tables: Tables) -> DataFrame:
    return tables["excluded"].orderBy("url")


def check_invariants(tables: Tables, audiences=("public", "trade", "staff")) -> DataFrame:
    """check, key, n: every breach of the model's invariants."""

    def rows(df, check, key):
        return df.select(F.lit(check).alias("check"), key.cast("string").alias("key"), F.col("n").cast("long").alias("n"))

    v, c, d = tables["versions"], tables["chunks"], tables["documents"]
    many = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
    orphan = c.join(v.select("url", "version"), ["url", "version"], "left_anti").groupBy("url").agg(F.count("*").alias("n"))
    homeless = v.join(d.select("url"), "url", "left_anti").groupBy("url").agg(F.count("*").alias("n"))
    return reduce(
        DataFrame.unionByName,
        [
            rows(many(v.where("is_active"), "url"), "several active versions", F.col("url")),
            rows(many(v, "url", "version"), "repeated version", F.concat_ws("#", "url", "version")),
            rows(many(c, "url", "version", "chunk_index"), "repeated chunk", F.concat_ws("#", "url", "version", "chunk_index")),
            rows(d.where(~F.col("audience").isin(*audiences)).groupBy("url").agg(F.count("*").alias("n")), "unknown audience", F.col("url")),
            rows(orphan, "chunk without version", F.col("url")),
            rows(homeless, "version without document", F.col("url")),
        ],
    )


def needs_reprocess(snapshot: DataFrame, model: str, dimensions: int, chunking: str, failed: DataFrame) -> DataFrame:
    """One row: reprocess (the snapshot was built otherwise) and refused (it is due, but sources failed)."""
    n = failed.agg(F.count("*").alias("failed"))
    other = (F.col("embedding_model") != model) | (F.col("embedding_dimensions") != dimensions) | (F.col("chunking_version") != chunking)
    return snapshot.where("is_active").crossJoin(F.broadcast(n)).select(other.alias("reprocess"), (other & (F.col("failed") > 0)).alias("refused"))


def ingestion_report(delta: DataFrame, tables: Tables, quality: DataFrame) -> DataFrame:
    """One row per url: change, quality, chunks, chars and caveats as the tables now hold them."""
    c = live(tables, "chunks").groupBy("url").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))
    k = live(tables, "caveats").groupBy("url").agg(F.count("*").alias("caveats"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return delta.join(quality, "url", "left").join(c, "url", "left").join(k, "url", "left").select("url", "change", "quality", zero("chunks"), zero("chars"), zero("caveats"))


def table_counts(tables: Tables) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()])


def authored_collisions(authored: DataFrame, fetched: DataFrame) -> DataFrame:
    return authored.select("url").join(fetched.select("url"), "url", "left_semi").distinct()
