"""Telemetry over span tables: normalising, counting, rates, quantiles, trees, retention.

A span has trace_id, span_id, parent_id, name, started_at, duration_ms, session_id,
status, source and the attributes top_score, path, hit, failed.  Every function
takes and gives DataFrames and works the same on a batch of a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..store import materialise

SOURCES = ("cli", "web", "evaluation", "unknown")
NAMES = ("turn", "part", "retrieval", "cache_lookup", "generation", "checks")
OUTCOMES = {"compose": "answered", "extract": "answered", "diagnosis": "answered", "state": "answered", "refuse": "refused", "topic_gate": "handoff", "ask_back": "handoff"}
# Upper bounds of the buckets of retrieval scores.
BOUNDS = (0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.9, 1.0)
QUANTILES, ACCURACY = (0.5, 0.9, 0.95, 0.99), 1_000
CHECKS = tuple(f"check {i}" for i in range(1, 9))


def _domain(spans: DataFrame, name: str, values) -> DataFrame:
    return spans.sparkSession.createDataFrame([(v,) for v in values], f"{name} string")


def normalise_spans(spans: DataFrame, names=NAMES, sources=SOURCES) -> DataFrame:
    """Known sources and names only, negative or non-numeric durations null."""
    source = F.lower("source")
    duration = F.expr("try_cast(duration_ms as double)")
    return spans.withColumns(
        {
            "source": F.when(source.isin(*sources), source).otherwise("other"),
            "name": F.when(F.col("name").isin(*names), F.col("name")).otherwise("other"),
            "duration_ms": F.when((duration >= 0) & ~F.isnan(duration), duration),
        }
    )


def span_counts(spans: DataFrame, cap: int) -> DataFrame:
    """Spans per source, and whether the row cap of the window was reached in total."""
    per = spans.groupBy("source").agg(F.count("*").alias("n"))
    return per.select("source", "n", (F.sum("n").over(W.partitionBy()) >= cap).alias("truncated"))


def _parts(spans: DataFrame) -> DataFrame:
    return spans.where("name = 'part'")


def route_counts(spans: DataFrame, paths) -> DataFrame:
    """Parts per source and path, paths outside the domain counted nowhere, absent ones zero."""
    grid = spans.select("source").distinct().join(F.broadcast(_domain(spans, "path", paths)))
    counted = _parts(spans).groupBy("source", "path").agg(F.count("*").alias("n"))
    return grid.join(counted, ["source", "path"], "left").select("source", "path", F.coalesce("n", F.lit(0)).alias("n"))


def outcome_rates(spans: DataFrame, outcomes=OUTCOMES) -> DataFrame:
    """Share of answered, refused and handed-off parts per source, zero rows kept."""
    lookup = F.create_map(*[F.lit(x) for kv in outcomes.items() for x in kv])
    known = _parts(spans).select("source", F.try_element_at(lookup, F.col("path")).alias("outcome")).where("outcome is not null")
    counted = known.groupBy("source", "outcome").agg(F.count("*").alias("n"))
    grid = spans.select("source").distinct().join(F.broadcast(_domain(spans, "outcome", sorted(set(outcomes.values())))))
    out = grid.join(counted, ["source", "outcome"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(W.partitionBy("source"))
    return out.select("source", "outcome", "n", F.round(F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)), 6).alias("rate"))


def cache_rate(spans: DataFrame) -> DataFrame:
    """Lookups and hits (the attribute exactly true) per source."""
    return spans.where("name = 'cache_lookup'").groupBy("source").agg(F.count("*").alias("lookups"), F.count_if(F.col("hit")).alias("hits"))


def check_failures(spans: DataFrame, checks=CHECKS) -> DataFrame:
    """Runs and failures by check; every check has a row; a malformed list counts as a run."""
    runs = spans.where("name = 'checks'")
    failed = runs.select("source", F.explode("failed").alias("label")).where(F.col("label").isin(*checks)).groupBy("source", "label").agg(F.count("*").alias("failures"))
    total = runs.groupBy("source").agg(F.count("*").alias("runs"))
    grid = total.join(F.broadcast(_domain(spans, "label", checks)))
    return grid.join(failed, ["source", "label"], "left").select("source", "label", "runs", F.coalesce("failures", F.lit(0)).alias("failures"))


def score_histogram(spans: DataFrame, bounds=BOUNDS) -> DataFrame:
    """Cumulative buckets of retrieval top scores, with sum and count, in one pass."""
    scored = spans.where("name = 'retrieval' and top_score is not null")
    edges = [*bounds, float("inf")]
    sums = scored.groupBy("source").agg(
        F.array(*[F.count_if(F.col("top_score") <= b) for b in edges]).alias("counts"),
        F.round(F.sum("top_score"), 6).alias("total"),
        F.count("*").alias("n"),
    )
    named = F.array(*[F.lit(str(b) if b != float("inf") else "+Inf") for b in edges])
    return sums.select("source", F.explode(F.arrays_zip(named.alias("bound"), F.col("counts").alias("n"))).alias("x"), "total", F.col("n").alias("observed")).select("source", "x.bound", F.col("x.n").alias("n"), "total", "observed")


def latency_quantiles(spans: DataFrame, quantiles=QUANTILES, accuracy: int = ACCURACY) -> DataFrame:
    """Observed (nearest rank) duration quantiles, sum and count per source and span.

    By selection: a sketch of bounded size brackets each rank between two observed values;
    one more pass counts what lies below each bracket and how often each value inside it
    occurs, and the value at the rank follows from running sums over those.  No group's rows
    are held; a bracket has about 4 / accuracy of them."""
    timed = spans.where("duration_ms is not null")
    g = ["source", "name"]
    asked = [(float(q), min(max(q + d / accuracy, 0.0), 1.0)) for q in quantiles for d in (-2.0, 2.0)]
    sketch = timed.groupBy(*g).agg(F.percentile_approx("duration_ms", [p for _, p in asked], accuracy).alias("p"), F.sum("duration_ms").alias("total"), F.count("*").alias("n"))
    rank = lambda q: F.greatest(F.lit(1), F.ceil(F.round(F.col("n") * F.lit(float(q)), 6))).cast("long")  # noqa: E731  n * 0.9 isn't always exact
    brackets = sketch.select(*g, "total", "n", F.array(*[F.struct(F.lit(i).alias("i"), rank(q).alias("rank"), F.get("p", F.lit(2 * i)).alias("low"), F.get("p", F.lit(2 * i + 1)).alias("high")) for i, q in enumerate(quantiles)]).alias("b"))
    met = timed.join(brackets.select(*g, "b"), g).select(*g, "duration_ms", F.explode("b").alias("b"))
    # A row for each bracket's values, and one for all below it; equal values are added up before they are shuffled.
    inside = F.when((F.col("duration_ms") >= F.col("b.low")) & (F.col("duration_ms") <= F.col("b.high")), F.col("duration_ms"))
    counted = met.where(F.col("duration_ms") <= F.col("b.high")).groupBy(*g, F.col("b.i").alias("i"), F.col("b.rank").alias("rank"), inside.alias("v")).agg(F.count("*").alias("k"))
    w = W.partitionBy(*g, "i").orderBy(F.asc_nulls_first("v"))
    at = counted.withColumn("upto", F.sum("k").over(w)).where("v is not null and upto >= rank").groupBy(*g, "i").agg(F.min("v").alias("v"))
    wide = at.groupBy(*g).pivot("i", list(range(len(quantiles)))).agg(F.first("v"))
    return sketch.select(*g, "total", "n").join(wide, g).select(*g, *[F.col(str(i)).alias(f"q{str(q)[2:]}") for i, q in enumerate(quantiles)], "total", "n")


def window_measures(paths, outcomes=OUTCOMES, checks=CHECKS, bounds=BOUNDS, quantiles=QUANTILES, accuracy: int = ACCURACY) -> list[Column]:
    """One pass over the normalised spans of a group, as mergeable aggregates: n, errors,
    lookups, hits, total_ms, paths, outcomes and failures (counts in the order of paths, of the
    sorted outcomes and of checks), runs, scores (counts of top scores up to each bound, then
    all of them), scored (their sum) and quantiles of the durations, whose ranks are within
    1 / accuracy of the group's rows of those of latency_quantiles."""
    part, run, score = F.col("name") == "part", F.col("name") == "checks", F.when(F.col("name") == "retrieval", F.col("top_score"))
    same = lambda c: lambda x: x == c
    of = {o: [p for p in paths if outcomes.get(p) == o] for o in sorted(set(outcomes.values()))}
    return [
        F.count("*").alias("n"),
        F.count_if(F.col("status") != "ok").alias("errors"),
        F.count_if(F.col("name") == "cache_lookup").alias("lookups"),
        F.count_if(F.col("hit") & (F.col("name") == "cache_lookup")).alias("hits"),
        F.sum("duration_ms").alias("total_ms"),
        F.array(*[F.count_if(part & (F.col("path") == p)) for p in paths]).alias("paths"),
        F.array(*[F.count_if(part & F.col("path").isin(*ps)) for ps in of.values()]).alias("outcomes"),
        F.count_if(run).alias("runs"),
        F.array(*[F.sum(F.when(run & F.col("failed").isNotNull(), F.size(F.filter("failed", same(c)))).otherwise(0)) for c in checks]).alias("failures"),
        F.array(*[F.count_if(score <= b) for b in bounds], F.count(score)).alias("scores"),
        F.round(F.sum(score), 6).alias("scored"),
        F.percentile_approx("duration_ms", [float(q) for q in quantiles], accuracy).alias("quantiles"),
    ]


def span_errors(spans: DataFrame) -> DataFrame:
    return spans.where("status != 'ok'").groupBy("source", "name").agg(F.count("*").alias("errors"))


def stage_times(spans: DataFrame, stages) -> DataFrame:
    """Per trace the time of each stage, null where it is absent."""
    return spans.groupBy("trace_id").pivot("name", list(stages)).agg(F.sum("duration_ms"))


def load_levels(times: DataFrame, level: Column, stages) -> DataFrame:
    """min, median, 95th percentile (interpolated) and max of stages by load level."""
    long = times.select(level.alias("level"), F.explode(F.create_map(*[x for s in stages for x in (F.lit(s), F.col(s))])).alias("stage", "ms")).where("ms is not null")
    cont = lambda q: F.round(F.expr(f"percentile_cont({q}) WITHIN GROUP (ORDER BY ms)"), 6)
    return long.groupBy("level", "stage").agg(F.min("ms").alias("least"), cont(0.5).alias("median"), cont(0.95).alias("p95"), F.max("ms").alias("most"), F.count("*").alias("n"))


def traces(spans: DataFrame, limit: int, session_id: int | None = None) -> DataFrame:
    """The newest limit spans (of one session), oldest first."""
    if session_id is not None:
        spans = spans.where(F.col("session_id") == session_id)
    return spans.orderBy(F.desc("started_at"), F.desc("span_id")).limit(limit).orderBy("started_at", "span_id")


def span_tree(spans: DataFrame) -> DataFrame:
    """Depth, path from the roots and nth, the place by start among the children of the same
    parent (or the roots of the trace; by id without started_at); a span whose parent is
    absent is a root.  Spans that lead to no root, being in a circle, are left out.

    Pointers are doubled: a span knows an ancestor and the way down from it, and in each
    round takes over the ancestor's own; so rounds grow with the logarithm of the depth.  Each
    is written, so that a plan holds one.  A span comes but once in a path, even where ids repeat."""
    by = [c for c in ("started_at", "span_id") if c in spans.columns]
    s = materialise(spans.select("trace_id", "parent_id", *by), "spans")
    ids = s.groupBy("trace_id", "span_id").agg(F.count("*").alias("k"))
    present = ids.select(F.col("trace_id").alias("t"), F.col("span_id").alias("p"))
    repeats = ids.groupBy("trace_id").agg((F.max("k") > 1).alias("repeats"))
    rooted = s.join(present, (F.col("trace_id") == F.col("t")) & (F.col("parent_id") == F.col("p")), "left").join(repeats, "trace_id")
    rooted = rooted.withColumn("nth", F.row_number().over(W.partitionBy("trace_id", "p").orderBy(*by)).cast("long"))
    at = materialise(rooted.select("trace_id", "span_id", "nth", F.col("p").alias("up"), F.lit(0).alias("depth"), F.col("span_id").cast("string").alias("path"), "repeats"), "pointers")
    out, rounds = at.where("up is null"), 0
    most = ids.groupBy("trace_id").agg(F.sum("k").alias("n")).agg(F.max("n")).first()[0] or 0
    known = at  # where each span's way up leads, by as many steps as rounds have doubled
    left = at.where("up is not null")
    while 2**rounds <= 2 * most and not left.isEmpty():
        above = known.select(F.col("trace_id").alias("t"), F.col("span_id").alias("a"), F.col("up").alias("above_up"), F.col("depth").alias("above_depth"), F.col("path").alias("above_path"))
        step = left.join(above, (F.col("trace_id") == F.col("t")) & (F.col("up") == F.col("a")))
        path = F.concat("above_path", F.lit("/"), "path")
        step = step.select("trace_id", "span_id", "nth", F.col("above_up").alias("up"), (F.col("depth") + F.col("above_depth") + 1).alias("depth"), path.alias("path"), "repeats")
        once = F.size(F.array_distinct(F.split("path", "/"))) == F.col("depth") + 1
        moved = materialise(step.where(~F.col("repeats") | once), "pointers")
        out = out.unionByName(moved.where("up is null"))
        left, rounds = moved.where("up is not null"), rounds + 1
        known = out.unionByName(left)
    return out.select("trace_id", "span_id", "nth", "depth", "path")


def trace_identity(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, name, source, session_id of each trace's first root (by start), its
    number of spans, and failed: the names of its spans that went wrong, sorted."""
    present = spans.select(F.col("trace_id").alias("t"), F.col("span_id").alias("p")).distinct()
    root = spans.join(present, (F.col("trace_id") == F.col("t")) & (F.col("parent_id") == F.col("p")), "left_anti")
    first = root.groupBy("trace_id").agg(F.min(F.struct("started_at", "span_id", "name", "source", "session_id")).alias("x"))
    of = spans.groupBy("trace_id").agg(F.count("*").alias("spans"), F.array_sort(F.collect_set(F.when(F.col("status") != "ok", F.col("name")))).alias("failed"))
    return first.join(of, "trace_id").select("trace_id", "x.span_id", "x.name", "x.source", "x.session_id", "spans", "failed")


def self_time(spans: DataFrame) -> DataFrame:
    """Duration less that of the direct children."""
    below = spans.where("parent_id is not null").groupBy(F.col("trace_id").alias("t"), F.col("parent_id").alias("p")).agg(F.sum("duration_ms").alias("below"))
    return spans.join(below, (F.col("trace_id") == F.col("t")) & (F.col("span_id") == F.col("p")), "left").select("trace_id", "span_id", "name", (F.col("duration_ms") - F.coalesce("below", F.lit(0.0))).alias("self_ms"))


def recent_traces(spans: DataFrame, n: int) -> DataFrame:
    """The latest root span of each trace, newest first."""
    roots = spans.where("parent_id is null")
    last = roots.groupBy("trace_id").agg(F.max(F.struct("started_at", "span_id", "name", "status")).alias("x"))
    return last.select("trace_id", "x.*").orderBy(F.desc("started_at"), F.desc("span_id")).limit(n)


def retain(spans: DataFrame, newest, days: int = 14, rows: int = 200_000) -> DataFrame:
    """Drop what is older than the window, then keep the newest rows by id.

    Ids are dealt by range, newest first; counts of the ranges before say how many rows of
    a range stay, so no task sees all rows that do."""
    kept = spans.where(F.col("started_at") >= F.lit(newest) - F.expr(f"interval {days} days"))
    n = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(kept.repartitionByRange(n, F.desc("span_id")).withColumn("range", F.spark_partition_id()), "spans")
    sums = dealt.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range
    before = sums.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before")).where(F.col("before") < rows)
    nth = F.row_number().over(W.partitionBy("range").orderBy(F.desc("span_id")))
    return dealt.join(before, "range").withColumn("nth", nth).where(F.col("before") + F.col("nth") <= rows).select(spans.columns)


def span_sessions(spans: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Activity sessions of each session id; spans without one are left out."""
    return (
        spans.where("session_id is not null")
        .groupBy("session_id", F.session_window("started_at", gap).alias("w"))
        .agg(F.count("*").alias("spans"), F.count_if(F.col("status") != "ok").alias("errors"))
        .select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "spans", "errors")
    )


def answer_feed(log: DataFrame, n: int) -> DataFrame:
    return log.orderBy(F.desc("asked_at"), F.desc("answer_id")).limit(n)


def refusal_rates(log: DataFrame) -> DataFrame:
    """Answers and refusals by source; evaluation runs are a source of their own."""
    return log.groupBy("source").agg(F.count("*").alias("answers"), F.round(F.avg(F.when(F.col("route") == "refuse", 1.0).otherwise(0.0)), 6).alias("refusal_rate"))


def fingerprint(text: Column) -> Column:
    """First 12 hexadecimal digits of the digest of the trimmed lower-cased text."""
    return F.substring(F.sha2(F.lower(F.trim(text)), 256), 1, 12)


def privacy_scan(attributes: DataFrame, texts: DataFrame) -> DataFrame:
    """Attribute values that contain a protected text.  attributes: span_id, trace_id,
    key, value; texts: trace_id, kind, text."""
    return attributes.join(texts, "trace_id").where((F.length("text") > 0) & F.contains("value", "text")).select("span_id", "key", "kind")


def span_events(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """Structured log lines (one JSON text each) joined to their spans; unknown ids stay with null names."""
    parsed = logs.select(F.from_json("line", "span_id long, level string, event string").alias("x")).select("x.*")
    return parsed.join(spans.select("span_id", "name", "trace_id"), "span_id", "left")
