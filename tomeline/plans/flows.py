"""Source, sink and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import telemetry as t
from ..sources import model as m
from ..sources import readers as rd
from ..sources import sinks as sk
from ..store import shared_dir
from ..streaming import streams as st
from .answers import CASES, FACT_KINDS, FOLD, KNOWN
from .answers import joined as _joined
from .base import collection

QUERIES, ORACLES, add = collection()


def _submissions(s, d):
    e = m.cases(s, d)
    k = F.col("case_id")
    return e.select("case_id", F.when(k % 7 == 0, " ").otherwise(F.col("question")).alias("question"), F.lit("a").alias("answer"), F.when(k % 5 == 0, None).otherwise(F.lit("x")).alias("approved_by"), F.when(k % 3 == 0, "2024-01-02T03:04:05").when(k % 11 == 0, "soonZ").otherwise("2024-01-02T03:04:05Z").alias("approved_at"), F.when(k % 13 == 0, None).otherwise(F.col("tags")).alias("tags"), F.when(k % 17 == 0, "sure").alias("confidence"))


add("a2_read_pages", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.length(F.decode(F.encode("html", "UTF-8"), "UTF-8")).cast("long").alias("n")), "SELECT page_id, length(html) AS n FROM pages")
add("a4_check_submissions", lambda s, d: rd.check_submissions(_submissions(s, d)).select("case_id", "reason"), m.CASES,
    "SELECT case_id, CASE WHEN case_id % 7 = 0 THEN 'no question' WHEN case_id % 5 = 0 THEN 'no approver' WHEN case_id % 3 = 0 OR case_id % 11 = 0 THEN 'approval time' WHEN case_id % 13 = 0 THEN 'tags' WHEN case_id % 17 = 0 THEN 'confidence' END AS reason FROM cases")


def _compat(s, d):
    p = m.passages(s, d)
    i = F.col("passage_id")
    return p.select(i.alias("nth"), F.when(i % 7 == 0, None).otherwise(F.col("product")).alias("product"), F.when(i % 5 == 0, "").otherwise("brick").alias("substrate"), F.when(i % 2 == 0, False).alias("interior"), F.lit(None).cast("boolean").alias("exterior"), F.lit(None).cast("boolean").alias("recommended"), F.lit(None).cast("array<string>").alias("caveats"))


add("a6_check_compat", lambda s, d: rd.check_compat(_compat(s, d))[0].select("nth", "product", "interior", "exterior", F.size("caveats").cast("long").alias("caveats")), m.PASSAGES, "SELECT passage_id AS nth, product, passage_id % 2 <> 0 AS interior, true AS exterior, CAST(0 AS BIGINT) AS caveats FROM passages WHERE passage_id % 7 <> 0 AND passage_id % 5 <> 0")


def _metrics(s, d):
    n = t.normalise_spans(m.spans(s, d))
    return n.groupBy("source", "name").agg(F.count("*").alias("n"), F.avg("top_score").alias("mean"))


def _lines(s, d):
    g = _metrics(s, d)
    row = lambda f, v: g.select(F.lit(f).alias("family"), F.create_map(F.lit("source"), "source", F.lit("name"), "name").alias("labels"), F.col(v).cast("double").alias("value"))
    fam = s.createDataFrame([("spans", "Spans seen", "counter"), ("scores", "Mean score", "gauge"), ("none", "Nothing", "gauge")], "family string, help string, kind string")
    return sk.metric_lines(row("spans", "n").unionByName(row("scores", "mean")), fam).select("line")


add("a13_metric_lines", _lines, m.SPANS,
    f"n AS (SELECT CASE WHEN lower(source) IN ('cli', 'web', 'evaluation', 'unknown') THEN lower(source) ELSE 'other' END AS source, CASE WHEN name IN ({', '.join(repr(x) for x in t.NAMES)}) THEN name ELSE 'other' END AS name, top_score FROM spans), g AS (SELECT source, name, count(*) AS n, avg(top_score) AS mean FROM n GROUP BY ALL)",
    "SELECT 'spans{name=\"' || name || '\",source=\"' || source || '\"} ' || CAST(n AS VARCHAR) AS line FROM g UNION ALL SELECT 'scores{name=\"' || name || '\",source=\"' || source || '\"} ' || format('{:.6f}', mean) FROM g UNION ALL SELECT unnest(['# HELP spans Spans seen', '# TYPE spans counter', '# HELP scores Mean score', '# TYPE scores gauge', '# HELP none Nothing', '# TYPE none gauge'])")
add("a14_store_images", lambda s, d: sk.store_images(m.cases(s, d).select(F.col("question").cast("binary").alias("content"))).select("image_hash"), m.CASES, "SELECT DISTINCT sha256(question) AS image_hash FROM cases")


def _stream(s, d, columns):
    """The events table as a stream, by way of its schema."""
    e = s.read.parquet(f"{d}/events.parquet")
    return s.readStream.schema(e.schema).parquet(f"{d}/events.parquet*"), columns  # a file or a folder of files


def _span_stream(s, d):
    e, _ = _stream(s, d, None)
    k = F.get_json_object("props", "$.k").cast("int")
    name = F.create_map(*[F.lit(x) for kv in m.SPAN_NAMES.items() for x in kv])
    return e.select(
        F.col("event_id").alias("span_id"), F.coalesce(F.try_element_at(name, F.col("event_type")), F.lit("odd one")).alias("name"), F.col("ts").cast("timestamp").alias("started_at"),
        F.when(F.col("event_id") % 97 == 0, -F.round(F.col("value") * 10)).otherwise(F.round(F.col("value") * 10)).alias("duration_ms"), F.col("user_id").alias("session_id"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), m.pick(m.SOURCES, F.col("user_id") % 5).alias("source"), (k % 2 == 0).alias("hit"),
        (k / 100.0).cast("double").alias("top_score"), m.pick(m.PATHS, k % 8).alias("path"), F.when(k % 3 == 0, F.array(F.concat(F.lit("check "), (k % 9).cast("string")))).alias("failed"),
    )


def _run(df):
    return st.run_available(df, f"t{uuid.uuid4().hex}")


def _upserted(stream, keys):
    spark = stream.sparkSession
    return st.run_upserts(stream, keys, f"{shared_dir(spark)}/upserts-{uuid.uuid4().hex}").read(spark)


def _windows(s, d, *columns, slide=None):
    out = _upserted(st.metrics_stream(_span_stream(s, d), m.PATHS[:-1], "1 hour", slide), ["start", "source", "name"])
    flat = {c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c, kind in out.dtypes if kind.startswith("array") and c in columns}
    return out.select("start", "stop", "source", "name", *columns).withColumns({c: F.unix_micros(c) for c in ("start", "stop")} | flat)


_SPAN_ROWS = f"n AS (SELECT span_id, epoch_us(time_bucket(INTERVAL 1 HOUR, started_at)) AS start, epoch_us(time_bucket(INTERVAL 15 MINUTE, started_at)) AS quarter, CASE WHEN lower(source) IN ('cli', 'web', 'evaluation', 'unknown') THEN lower(source) ELSE 'other' END AS source, CASE WHEN name IN ({', '.join(repr(x) for x in t.NAMES)}) THEN name ELSE 'other' END AS name, CASE WHEN duration_ms >= 0 THEN duration_ms END AS duration_ms, status, hit, path, failed, top_score FROM spans)"
_MEASURES = "count(*) AS n, count(*) FILTER (status <> 'ok') AS errors, count(*) FILTER (hit AND name = 'cache_lookup') AS hits, sum(duration_ms) AS total_ms"
_COUNTS = lambda what: "array_to_string([" + ", ".join(f"count(*) FILTER ({x})" for x in what) + "], ',')"
_OUTCOME = {o: [p for p in m.PATHS[:-1] if t.OUTCOMES.get(p) == o] for o in sorted(set(t.OUTCOMES.values()))}
add("m15_metrics_stream", lambda s, d: _windows(s, d, "n", "errors", "hits", "total_ms"), m.SPANS, _SPAN_ROWS, f"SELECT start, start + 3600000000 AS stop, source, name, {_MEASURES} FROM n GROUP BY ALL")
add("m15_sliding_windows", lambda s, d: _windows(s, d, "n", "errors", "hits", "total_ms", slide="15 minutes"), m.SPANS, _SPAN_ROWS,
    f"SELECT s AS start, s + 3600000000 AS stop, source, name, {_MEASURES} FROM (SELECT *, unnest([quarter, quarter - 900000000, quarter - 1800000000, quarter - 2700000000]) AS s FROM n) GROUP BY ALL")
add("m15_routes_checks_scores", lambda s, d: _windows(s, d, "paths", "outcomes", "lookups", "runs", "failures", "scores"), m.SPANS, _SPAN_ROWS,
    f"""SELECT start, start + 3600000000 AS stop, source, name, {_COUNTS(f"name = 'part' AND path = '{p}'" for p in m.PATHS[:-1])} AS paths, {_COUNTS("name = 'part' AND path IN (" + ", ".join(repr(p) for p in ps) + ")" for ps in _OUTCOME.values())} AS outcomes,
    count(*) FILTER (name = 'cache_lookup') AS lookups, count(*) FILTER (name = 'checks') AS runs, {_COUNTS(f"name = 'checks' AND list_contains(failed, '{c}')" for c in t.CHECKS)} AS failures, {_COUNTS([*(f"name = 'retrieval' AND top_score <= {b}" for b in t.BOUNDS), "name = 'retrieval' AND top_score IS NOT NULL"])} AS scores FROM n GROUP BY ALL""")  # fmt: skip
add("m16_session_stream", lambda s, d: _run(st.session_stream(_span_stream(s, d))).withColumns({c: F.unix_micros(c) for c in ("start", "stop")}), m.SPANS,
    "x AS (SELECT session_id, started_at AS t, status, CASE WHEN started_at < lag(started_at) OVER (PARTITION BY session_id ORDER BY started_at) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM spans WHERE session_id IS NOT NULL), y AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM x)",
    "SELECT session_id, epoch_us(min(t)) AS start, epoch_us(max(t) + INTERVAL 30 MINUTE) AS stop, count(*) AS spans, count(*) FILTER (status <> 'ok') AS errors FROM y GROUP BY session_id, k HAVING max(t) + INTERVAL 30 MINUTE <= (SELECT max(started_at) - INTERVAL 10 MINUTE FROM spans)")


def _turn_stream(s, d):
    c = s.read.parquet(f"{d}/conversations.parquet")
    r = s.readStream.schema(c.schema).parquet(f"{d}/conversations.parquet*")
    at = F.expr("timestampadd(MINUTE, cast(conv_id * 60 + turn * 20 + CASE WHEN turn >= 4 THEN 120 ELSE 0 END as int), timestamp'2024-01-01 00:00:00')")
    return r.select("conv_id", "turn", at.alias("at"), F.when(F.length("text") % 3 == 0, F.substring("text", 1, 3)).alias("substrate"), F.when(F.length("text") % 5 == 0, F.col("role")).alias("location"))


add("k8_conversation_state", lambda s, d: _run(st.conversation_state(_turn_stream(s, d))).where("not expired").select("conv_id", "turn", "substrate", "location", "turns"), m.TURNS,
    "SELECT conv_id, turn, last_value(CASE WHEN length(text) % 3 = 0 THEN left(text, 3) END IGNORE NULLS) OVER w AS substrate, last_value(CASE WHEN length(text) % 5 = 0 THEN role END IGNORE NULLS) OVER w AS location, count(*) OVER w AS turns FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")


def _fact_stream(s, d):
    """Turns with two facts each and a case of every four turns, as a stream (as case_facts has them in a table)."""
    c = s.read.parquet(f"{d}/conversations.parquet")
    r = s.readStream.schema(c.schema).parquet(f"{d}/conversations.parquet*")
    at = F.expr("timestampadd(MINUTE, cast(conv_id * 60 + turn * 20 + CASE WHEN turn >= 4 THEN 120 ELSE 0 END as int), timestamp'2024-01-01 00:00:00')")
    n = F.length("text")
    slot = lambda by: F.element_at(F.array(F.lit("substrate"), F.lit("location")), (n % by % 2 + 1).cast("int"))
    fact = lambda by, kind: F.struct(slot(by).alias("slot"), F.concat(F.lit("v"), (n % by % 3).cast("string")).alias("value"), F.expr(kind).alias("provenance"), (n % 3 != 0).alias("keep"))
    both = F.array(fact(7, FACT_KINDS[0]), fact(5, FACT_KINDS[1]))
    return r.select("conv_id", F.expr("turn div 4").alias("case_id"), "turn", at.alias("at"), F.expr("turn % 4 = 0 and turn > 0").alias("opens"), both.alias("facts"))


def _session_facts(s, d):
    return _upserted(st.session_facts(_fact_stream(s, d)), ["conv_id", "case_id", "slot"])


add("k8_session_facts", lambda s, d: _joined(_session_facts(s, d).drop("touched", "expired")), m.TURNS, CASES, FOLD, KNOWN)
add("k8_session_rows", lambda s, d: st.session_rows(_session_facts(s, d)).select("conv_id", "cases", "slots"), m.TURNS, CASES, FOLD,
    "SELECT conv_id, count(DISTINCT case_id) AS cases, count(*) FILTER (case_id = last AND status = 'active') AS slots FROM (SELECT *, max(case_id) OVER (PARTITION BY conv_id) AS last FROM folded) GROUP BY conv_id")
add("k5_turn_sessions", lambda s, d: _run(st.turn_sessions(_turn_stream(s, d))).select("conv_id", "first", "last", "turns"), m.TURNS,
    "x AS (SELECT conv_id, turn, turns.\"at\" AS t, CASE WHEN turns.\"at\" < lag(turns.\"at\") OVER (PARTITION BY conv_id ORDER BY turns.\"at\", turn) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM turns), y AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY t, turn) AS k FROM x)",
    "SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS turns FROM y GROUP BY conv_id, k HAVING max(t) + INTERVAL 30 MINUTE <= (SELECT max(turns.\"at\") - INTERVAL 10 MINUTE FROM turns)")
