"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans are matches of fixed patterns, found on the whole text.  Candidates
which alone mean little (key-like strings, endpoints) and the parts that make
them telling (access identifiers, named secrets) are located likewise.  An
interval join links them: a candidate is reported only where a complementary
part lies within SCOPE code points of it.

The join is on (document, cell of SCOPE code points): of each cell only the
first and last place of a part is kept (a partial aggregate), which decides
exactly whether some part of the own cell or of the next ones is in reach.  So
no pairs are built, however many parts a scope holds.

Places are code points: a text is split at the matches, and the lengths of
pieces and matches are added up in a window over the document's matches.  Only
these short rows are shuffled, never the texts.

Defined results: null text counts as empty: no spans, the digest of the empty
string.  Null doc_id stays null.  Rows that repeat a doc_id are each scanned by
themselves; fully equal rows give equal results.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import materialise

#: The kinds in listed order and their patterns.  Runs of one
#: class which are too short to count are left out by the pattern itself, as no
#: other match can begin inside them; assign is filtered after matching.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "endpoint": r"""(?:https?|ftp|wss?|ssh|s3|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\x00-\x20"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])(?::[0-9]{1,5})?""",
    "weak": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}",
}
LEAST_VALUE = 6
BASE = ("assign", "access", "hex")
#: What makes a candidate telling.
COMPLEMENTS = {"endpoint": ("assign", "access", "hex"), "weak": ("assign", "access", "endpoint")}
SCOPE = 400
MARK = "[REDACTED]"

_KINDS = list(PATTERNS)
_KEY = ["key_id", "key_text"]


def _keyed(documents: DataFrame) -> DataFrame:
    """Spans depend on the text alone, so equal keys have equal spans."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(-1)).alias("key_id"), F.xxhash64("text").alias("key_text")
    )


def _located(docs: DataFrame) -> DataFrame:
    """(key, kind, start, stop) of all matches of all patterns."""
    found = docs.select(*_KEY, "text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m{i}") for i, p in enumerate(PATTERNS.values())])

    def one(i: int, pattern: str) -> Column:
        gaps = F.transform(F.split("text", pattern, -1), F.length)
        row = F.transform(
            F.arrays_zip(F.transform(f"m{i}", F.length).alias("n"), F.slice(gaps, 1, F.size(f"m{i}")).alias("g"), F.transform(f"m{i}", lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) if i == 0 else F.lit(LEAST_VALUE)).alias("v")),
            lambda x, j: F.struct(F.lit(i).alias("kind"), j.alias("nth"), x["n"].alias("n"), x["g"].alias("gap"), x["v"].alias("value")),
        )
        return F.when(F.size(f"m{i}") > 0, row)

    some = F.array_compact(F.array(*[one(i, p) for i, p in enumerate(PATTERNS.values())]))
    rows = found.where(F.greatest(*[F.size(f"m{i}") for i in range(len(PATTERNS))]) > 0).select(*_KEY, F.explode(F.flatten(some)).alias("x")).select(*_KEY, "x.*")
    rows = rows.dropDuplicates([*_KEY, "kind", "nth"])
    stop = F.sum(F.col("gap") + F.col("n")).over(W.partitionBy(*_KEY, "kind").orderBy("nth"))
    return rows.withColumn("stop", stop).where(F.col("value") >= LEAST_VALUE).select(*_KEY, "kind", (F.col("stop") - F.col("n")).alias("start"), "stop")


def _telling(spans: DataFrame, scope: int) -> DataFrame:
    """The candidates with a complementary part within scope."""
    base = spans.where(F.col("kind") < len(BASE))
    # Key-like strings that overlap a base span are that span, not another part.
    per = W.partitionBy(*_KEY).orderBy("start", "kind")
    before = F.max(F.when(F.col("kind") < len(BASE), F.col("stop"))).over(per.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(F.when(F.col("kind") < len(BASE), F.col("start"))).over(per.rowsBetween(1, W.unboundedFollowing))
    candidates = spans.select("*", before.alias("before"), after.alias("after")).where(F.col("kind") >= len(BASE))
    candidates = candidates.where((F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("stop")) >= F.col("stop")))
    needs = [(_KINDS.index(k), _KINDS.index(c)) for k, cs in COMPLEMENTS.items() for c in cs]
    parts = base.unionByName(candidates.select(base.columns).where(F.col("kind") == _KINDS.index("endpoint")))
    cells = parts.select(*_KEY, F.col("kind").alias("part"), F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("stop") - 1) / scope))).alias("cell"), "start", "stop")
    cells = cells.groupBy(*_KEY, "part", "cell").agg(F.min("start").alias("first"), F.max("stop").alias("last"))
    lo, hi = F.floor(F.col("start") / scope), F.floor((F.col("stop") - 1) / scope)
    reach = candidates.select(*_KEY, "kind", "start", "stop", F.explode(F.sequence(lo - 1, hi + 1)).alias("cell"))
    fits = F.lit(False)
    for k, c in needs:
        fits = fits | ((F.col("kind") == k) & (F.col("part") == c))
    near = (F.col("first") <= F.col("stop") + scope) & (F.col("last") >= F.col("start") - scope)
    hits = reach.join(cells, [*_KEY, "cell"]).where(fits & near)
    return hits.select(*_KEY, "kind", "start", "stop").distinct()


def _spans(docs: DataFrame, scope: int) -> DataFrame:
    located = materialise(_located(docs), "located")  # short rows, used three times; the texts are read once
    base = located.where(F.col("kind") < len(BASE))
    return base.unionByName(_telling(located, scope))


def secret_spans(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per span: doc_id, kind, start, stop, value.  Places are code
    points, stop exclusive."""
    docs = _keyed(documents)
    name = F.element_at(F.array(*map(F.lit, _KINDS)), F.col("kind") + 1)
    return docs.join(_spans(docs, scope), _KEY).select("doc_id", name.alias("kind"), "start", "stop", F.expr("substring(text, cast(start + 1 as int), cast(stop - start as int))").alias("value"))


def _grouped(docs: DataFrame, scope: int) -> DataFrame:
    return _spans(docs, scope).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("found"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, _KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))))


def scan(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id and found, its sorted spans
    (start, kind number, stop)."""
    docs = _keyed(documents)
    none = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")
    return docs.select("doc_id", *_KEY).join(_grouped(docs, scope), _KEY, "left").select("doc_id", F.coalesce("found", none).alias("found"))


def redact(documents: DataFrame, scope: int = SCOPE, mark: str = MARK) -> DataFrame:
    """The documents with every span replaced by mark, and n_chars (if there)
    measured again.  Every row and column stays."""
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    docs = documents.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("key_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("whole"))
    docs = docs.withColumn("key_text", F.xxhash64("whole")).join(_grouped(_keyed(documents), scope), _KEY, "left")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    piece = lambda at, n: F.substring(F.col("whole"), (at + 1).cast("int"), n.cast("int"))
    cut = F.aggregate(
        "found",
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], piece(acc["at"], s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], piece(acc["at"], F.length("whole"))),
    )
    docs = docs.select("row", F.when(F.col("found").isNotNull(), cut).otherwise(F.col("row")["text"]).alias("now"), F.col("found").isNotNull().alias("changed"))
    kind = dict(documents.dtypes)
    changed = {"text": F.col("now"), "n_chars": F.when(F.col("changed"), F.length("now").cast(kind.get("n_chars", "long"))).otherwise(F.col("row").getField("n_chars") if "n_chars" in kind else None)}
    return docs.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in documents.columns])


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_written(F.filter("found", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"),
        _written(F.col("found")).alias("spans"),
    )
