"""Telemetry queries over the spans derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import telemetry as t
from ..sources import model as m
from .base import collection

QUERIES, ORACLES, add = collection()

_OTHER = "CASE WHEN lower(source) IN ('cli', 'web', 'evaluation', 'unknown') THEN lower(source) ELSE 'other' END"
_NORM = f"""n AS (SELECT * REPLACE ({_OTHER} AS source,
  CASE WHEN name IN ({', '.join(repr(x) for x in t.NAMES)}) THEN name ELSE 'other' END AS name,
  CASE WHEN duration_ms >= 0 THEN duration_ms END AS duration_ms) FROM spans)"""
_PATHS = m.PATHS[:7]


def _n(spark, sf):
    return t.normalise_spans(m.spans(spark, sf))


def _values(items):
    return "(VALUES " + ", ".join(f"('{i}')" for i in items) + ")"


add("m1_normalise_spans", lambda s, d: _n(s, d).select("span_id", "source", "name", "duration_ms"), m.SPANS, _NORM, "SELECT span_id, source, name, duration_ms FROM n")
add("m2_span_counts", lambda s, d: t.span_counts(_n(s, d), 5000), m.SPANS, _NORM, "SELECT source, count(*) AS n, (SELECT count(*) FROM n) >= 5000 AS truncated FROM n GROUP BY source")
add(
    "m3_route_counts", lambda s, d: t.route_counts(_n(s, d), _PATHS), m.SPANS, _NORM,
    f"SELECT g.source, g.path, count(n.span_id) AS n FROM (SELECT DISTINCT source, path FROM (SELECT source FROM n) CROSS JOIN {_values(_PATHS)} v(path)) g LEFT JOIN n ON n.source = g.source AND n.path = g.path AND n.name = 'part' GROUP BY ALL",
)
_OUT = "CASE path " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in t.OUTCOMES.items()) + " END"
add(
    "m3_outcome_rates", lambda s, d: t.outcome_rates(_n(s, d)), m.SPANS, _NORM,
    f"""SELECT source, outcome, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY source), 0), 0), 6)::DOUBLE AS rate FROM (
      SELECT g.source, g.outcome, count(p.o) AS n FROM (SELECT DISTINCT source, outcome FROM n CROSS JOIN {_values(sorted(set(t.OUTCOMES.values())))} v(outcome)) g
      LEFT JOIN (SELECT source, {_OUT} AS o FROM n WHERE name = 'part') p ON p.source = g.source AND p.o = g.outcome GROUP BY ALL)""",
)
add("m4_cache_rate", lambda s, d: t.cache_rate(_n(s, d)), m.SPANS, _NORM, "SELECT source, count(*) AS lookups, count(*) FILTER (hit) AS hits FROM n WHERE name = 'cache_lookup' GROUP BY source")
add(
    "m5_check_failures", lambda s, d: t.check_failures(_n(s, d)), m.SPANS, _NORM,
    f"""SELECT r.source, v.label, r.runs, count(f.label) AS failures FROM (SELECT source, count(*) AS runs FROM n WHERE name = 'checks' GROUP BY 1) r
      CROSS JOIN {_values(t.CHECKS)} v(label) LEFT JOIN (SELECT source, unnest(failed) AS label FROM n WHERE name = 'checks') f ON f.source = r.source AND f.label = v.label GROUP BY ALL""",
)
add(
    "m6_score_histogram", lambda s, d: t.score_histogram(_n(s, d)), m.SPANS, _NORM,
    f"""SELECT source, b AS bound, count(*) FILTER (b = '+Inf' OR top_score <= try_cast(b AS DOUBLE)) AS n, round(sum(top_score), 6) AS total, count(*) AS observed
      FROM n CROSS JOIN {_values([*map(str, t.BOUNDS), '+Inf'])} v(b) WHERE name = 'retrieval' AND top_score IS NOT NULL GROUP BY ALL""",
)
add(
    "m7_latency_quantiles", lambda s, d: t.latency_quantiles(_n(s, d)), m.SPANS, _NORM,
    "SELECT source, name, quantile_disc(duration_ms, 0.5) AS q5, quantile_disc(duration_ms, 0.9) AS q9, quantile_disc(duration_ms, 0.95) AS q95, quantile_disc(duration_ms, 0.99) AS q99, sum(duration_ms) AS total, count(*) AS n FROM n WHERE duration_ms IS NOT NULL GROUP BY ALL",
)
add("m8_span_errors", lambda s, d: t.span_errors(_n(s, d)), m.SPANS, _NORM, "SELECT source, name, count(*) AS errors FROM n WHERE status <> 'ok' GROUP BY ALL")
_STAGES = ("part", "retrieval", "generation", "checks")
_PIVOT = "times AS (SELECT trace_id, " + ", ".join(f"sum(duration_ms) FILTER (name = '{x}') AS {x}" for x in _STAGES) + " FROM n GROUP BY trace_id)"
add("m9_stage_times", lambda s, d: t.stage_times(_n(s, d), _STAGES), m.SPANS, _NORM, _PIVOT, "SELECT * FROM times")
add(
    "m9_load_levels", lambda s, d: t.load_levels(t.stage_times(_n(s, d), _STAGES), (F.col("trace_id") % 3).alias("level"), _STAGES), m.SPANS, _NORM, _PIVOT,
    "SELECT level, stage, min(ms) AS least, round(quantile_cont(ms, 0.5), 6) AS median, round(quantile_cont(ms, 0.95), 6) AS p95, max(ms) AS most, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT trace_id % 3 AS level, '{x}' AS stage, {x} AS ms FROM times" for x in _STAGES) + ") WHERE ms IS NOT NULL GROUP BY ALL",
)
add("m10_traces", lambda s, d: t.traces(m.spans(s, d), 100).select("span_id", "trace_id", "name"), m.SPANS, "SELECT span_id, trace_id, name FROM spans ORDER BY started_at DESC, span_id DESC LIMIT 100")
add(
    "m11_span_tree", lambda s, d: t.span_tree(m.spans(s, d)),
    "RECURSIVE " + m.SPANS, "sp AS (SELECT s.trace_id, s.span_id, p.span_id AS above, row_number() OVER (PARTITION BY s.trace_id, p.span_id ORDER BY s.started_at, s.span_id) AS nth FROM spans s LEFT JOIN spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_id)",
    "tree AS (SELECT trace_id, span_id, nth, 0 AS depth, CAST(span_id AS VARCHAR) AS path FROM sp WHERE above IS NULL UNION ALL SELECT s.trace_id, s.span_id, s.nth, tree.depth + 1, tree.path || '/' || CAST(s.span_id AS VARCHAR) FROM tree JOIN sp s ON s.trace_id = tree.trace_id AND s.above = tree.span_id)", "SELECT * FROM tree",
)
add("m11_trace_identity", lambda s, d: t.trace_identity(m.spans(s, d)).withColumn("failed", F.array_join("failed", ",")), m.SPANS,
    "rt AS (SELECT * FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_id) QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY started_at, span_id) = 1)",
    "SELECT rt.trace_id, rt.span_id, rt.name, rt.source, rt.session_id, count(*) AS spans, coalesce(string_agg(DISTINCT CASE WHEN s.status <> 'ok' THEN s.name END, ',' ORDER BY CASE WHEN s.status <> 'ok' THEN s.name END), '') AS failed FROM rt JOIN spans s USING (trace_id) GROUP BY ALL")
add("m12_self_time", lambda s, d: t.self_time(m.spans(s, d)), m.SPANS, "SELECT trace_id, span_id, name, duration_ms - coalesce((SELECT sum(c.duration_ms) FROM spans c WHERE c.trace_id = s.trace_id AND c.parent_id = s.span_id), 0) AS self_ms FROM spans s")
add("m13_recent_traces", lambda s, d: t.recent_traces(m.spans(s, d), 50).drop("started_at"), m.SPANS, "SELECT trace_id, span_id, name, status FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY started_at DESC, span_id DESC) AS r FROM spans WHERE parent_id IS NULL) WHERE r = 1 ORDER BY started_at DESC, span_id DESC LIMIT 50")


def _newest(spans):
    return spans.agg(F.max("started_at")).first()[0]  # one value


add("m14_retain", lambda s, d: t.retain(m.spans(s, d), _newest(m.spans(s, d)), 14, 5000).select("span_id"), m.SPANS, "SELECT span_id FROM spans WHERE started_at >= (SELECT max(started_at) FROM spans) - INTERVAL 14 DAY ORDER BY span_id DESC LIMIT 5000")
add(
    "m16_span_sessions", lambda s, d: t.span_sessions(m.spans(s, d)).withColumns({c: F.unix_micros(c) for c in ("start", "stop")}), m.SPANS,
    """SELECT session_id, epoch_us(min(started_at)) AS start, epoch_us(max(started_at)) + 1800000000 AS stop, count(*) AS spans, count(*) FILTER (status <> 'ok') AS errors FROM (
      SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY started_at, span_id) AS g FROM (
        SELECT *, CASE WHEN started_at < lag(started_at) OVER (PARTITION BY session_id ORDER BY started_at, span_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM spans WHERE session_id IS NOT NULL)) GROUP BY session_id, g""",
)


def _log(s, d):
    return m.spans(s, d).where("name = 'part'").select(F.col("span_id").alias("answer_id"), F.col("started_at").alias("asked_at"), "source", F.col("path").alias("route"))


_LOG = "log AS (SELECT span_id AS answer_id, started_at AS asked_at, source, path AS route FROM spans WHERE name = 'part')"
add("m17_answer_feed", lambda s, d: t.answer_feed(_log(s, d), 30).select("answer_id", "source", "route"), m.SPANS, _LOG, "SELECT answer_id, source, route FROM log ORDER BY asked_at DESC, answer_id DESC LIMIT 30")
add("m17_refusal_rates", lambda s, d: t.refusal_rates(_log(s, d)), m.SPANS, _LOG, "SELECT source, count(*) AS answers, round(avg(CASE WHEN route = 'refuse' THEN 1.0::DOUBLE ELSE 0 END), 6) AS refusal_rate FROM log GROUP BY source")
add("m18_fingerprint", lambda s, d: m.questions(s, d).select("qid", t.fingerprint(F.col("text")).alias("fingerprint")), m.QUESTIONS, "SELECT qid, left(sha256(lower(trim(text, ' '))), 12) AS fingerprint FROM questions")


def _attributes(s, d):
    return m.turns(s, d).where("turn % 2 = 1").select((F.col("conv_id") * 100 + F.col("turn")).alias("span_id"), F.col("conv_id").alias("trace_id"), F.lit("note").alias("key"), F.col("text").alias("value"))


def _texts(s, d):
    return m.turns(s, d).where("turn % 2 = 1").select(F.col("conv_id").alias("trace_id"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("kind"), "text")


add(
    "m19_privacy_scan", lambda s, d: t.privacy_scan(_attributes(s, d), _texts(s, d)), m.TURNS,
    "SELECT a.conv_id * 100 + a.turn AS span_id, 'note' AS key, 'turn ' || CAST(b.turn AS VARCHAR) AS kind FROM turns a JOIN turns b ON a.conv_id = b.conv_id WHERE a.turn % 2 = 1 AND b.turn % 2 = 1 AND length(b.text) > 0 AND contains(a.text, b.text)",
)


def _lines(s, d):
    return m.spans(s, d).where("span_id % 3 = 0").select(F.to_json(F.struct((F.col("span_id") * 2).alias("span_id"), F.lit("info").alias("level"), F.col("name").alias("event"))).alias("line"))


add("m20_span_events", lambda s, d: t.span_events(_lines(s, d), m.spans(s, d)), m.SPANS, "SELECT l.span_id, 'info' AS level, l.name AS event, s.name, s.trace_id FROM (SELECT span_id * 2 AS span_id, name FROM spans WHERE span_id % 3 = 0) l LEFT JOIN spans s ON s.span_id = l.span_id")
