"""Question labels and product eligibility over benchmark items and user turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import eligibility as el
from ..operators import labelling as lb
from ..operators import retrieval as r
from ..sources import model as m
from ..store import materialise
from .base import collection
from .retrieval import HITS, SCORED

QUERIES, ORACLES, add = collection()

TOPICS = [("safety", "(^|[^a-z])(nicht|not)([^a-z]|$)"), ("cost", "(^|[^a-z])(que|from)([^a-z]|$)"), ("order", "(^|[^a-z])(und|for)([^a-z]|$)")]
VOCAB = [("substrate", "brick", "the", False), ("substrate", "brick", "of", False), ("substrate", "stone", "die", False), ("property", "cover", "and", False), ("property", "mix", "that", False), ("property", "mix", "le", False), ("property", "dry", "with", True), ("property", "dry", "la", False), ("location", "inside", "in", False), ("location", "outside", "on", False)]
PRODUCTS = [("Acme the",), ("Acme and of",), ("Acme der",), ("Acme le ch",), ("Acme in",)]
INTENTS = [("calculate", "[0-9]"), ("select", "(^|[^a-z])that([^a-z]|$)"), ("lookup", "(^|[^a-z])(is|die)([^a-z]|$)")]
qs = m.questions
_topic = lambda t: "CASE " + " ".join(f"WHEN regexp_matches(lower({t}), '{p}') THEN '{n}'" for n, p in TOPICS) + " END"
_PAD = lambda t: f"(' ' || regexp_replace(lower({t}), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g') || ' ')"
_WW = lambda t, w: f"contains({_PAD(t)}, ' ' || lower({w}) || ' ')"
_V = "vocab AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in VOCAB) + ") v(slot, value, term, ask_only))"
_SC = f"""sc AS (SELECT qid, slot, value, coalesce(own, asked) AS score, own IS NULL AS ask_only FROM (
  SELECT qid, slot, value, sum(length(term)) FILTER (NOT ask_only) AS own, sum(length(term)) FILTER (ask_only) AS asked FROM questions JOIN vocab ON {_WW('text', 'term')} GROUP BY ALL))"""
_vocab = lambda s: s.createDataFrame(VOCAB, "slot string, value string, term string, ask_only boolean")
_scores = lambda s, d: lb.slot_scores(qs(s, d), _vocab(s))
_Q = m.QUESTIONS
_NW = lambda t: f"len(regexp_extract_all(lower({t}), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'))"
add("h1_split_questions", lambda s, d: lb.split_questions(qs(s, d), TOPICS), _Q,
    f"pt AS (SELECT qid, text, list_filter(string_split(regexp_replace(regexp_replace(text, '([.?;])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), '(?i) and (what|how|can|is|the) ', chr(1) || '\\1 ', 'g'), chr(1)), lambda p: {_NW('p')} >= 3) AS l FROM questions)",
    f"px AS (SELECT qid, i AS nth, l[i + 1] AS part, coalesce({_topic('l[i + 1]')}, 'none') AS topic FROM pt, unnest(range(len(l))) u(i))", "kp AS (SELECT qid FROM px GROUP BY qid HAVING count(DISTINCT topic) > 1)",
    "SELECT qid, nth, part FROM px WHERE qid IN (SELECT qid FROM kp) UNION ALL SELECT qid, 0, text FROM questions WHERE qid NOT IN (SELECT qid FROM kp)")
add("h2_topic_gate", lambda s, d: lb.topic_gate(qs(s, d), TOPICS, "^[a-z]+ "), _Q, f"SELECT qid, {_topic('CASE WHEN trim(regexp_replace(lower(text), ' + repr('^[a-z]+ ') + ', ' + repr('') + ', ' + repr('g') + '), ' + repr(' ') + ') <> ' + repr('') + ' THEN trim(regexp_replace(lower(text), ' + repr('^[a-z]+ ') + ', ' + repr('') + ', ' + repr('g') + '), ' + repr(' ') + ') ELSE lower(text) END')} AS topic FROM questions")
add("h3_detect_slots", lambda s, d: lb.detect_slots(_scores(s, d)), _Q, _V, _SC, "SELECT qid, slot, value, CAST(score AS BIGINT) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY qid, slot ORDER BY score DESC, value DESC) = 1")
add("h3_all_properties", lambda s, d: lb.all_properties(_scores(s, d), "property"), _Q, _V, _SC, "SELECT qid, value, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY qid ORDER BY sc.score DESC, value DESC) AS rank FROM sc WHERE slot = 'property'")
add("h4_primary_properties", lambda s, d: lb.primary_properties(_scores(s, d), "property"), _Q, _V, _SC, "SELECT qid, value, CAST(score AS BIGINT) AS score FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM sc WHERE slot = 'property') WHERE 2 * score >= top AND (NOT ask_only OR score = top)")
_m = lambda s, d: qs(s, d).withColumn("text", F.concat(F.col("text"), F.lit(" "), F.length("text").cast("string"), F.lit(".5 m2 at "), (F.length("text") % 600).cast("string"), F.lit(" mm")))
add("h5_measurements", lambda s, d: lb.measurements(_m(s, d)), _Q, "SELECT qid, CASE WHEN length(text) + 0.5 <= 10000 THEN CAST(length(text) AS DOUBLE) + 0.5 END AS area, CASE WHEN length(text) % 600 BETWEEN 1 AND 500 THEN CAST(length(text) % 600 AS DOUBLE) END AS thickness FROM questions")
_reg = lambda s: s.createDataFrame(PRODUCTS, "product string")
_al = lambda s: lb.product_aliases(_reg(s), "acme", ["in"])
_AL = """al AS (SELECT * FROM (VALUES ('the', 'Acme the'), ('and of', 'Acme and of'), ('and', 'Acme and of'), ('der', 'Acme der'), ('le ch', 'Acme le ch'), ('le', 'Acme le ch'), ('in', 'Acme in')) v(alias, product))"""
_MN = f"mn AS (SELECT DISTINCT qid, product FROM questions JOIN al ON {_WW('text', 'alias')})"
add("h6_product_aliases", lambda s, d: _al(s).crossJoin(F.broadcast(qs(s, d).agg(F.count("*").alias("questions")))), _Q, _AL, "SELECT alias, product, (SELECT count(*) FROM questions) AS questions FROM al")
add("h6_mentions", lambda s, d: lb.mentions(qs(s, d), _al(s)), _Q, _AL, _MN, "SELECT * FROM mn")
_S = lambda t: f"list_filter(list_transform(string_split(regexp_replace(regexp_replace({t}, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '')"
_RT = f"array_to_string(list_filter({_S('text')}, lambda s: NOT regexp_matches(lower(s), '(^| )(of|nicht) ')), ' ')"
add("h7_reference_text", lambda s, d: qs(s, d).select("qid", lb.reference_text(F.col("text"), "(^| )(of|nicht) ").alias("reference"), lb.asserted_text(F.col("text"), "(^| )(of|nicht) ", "(^| )that ").alias("asserted")), _Q,
    f"SELECT qid, {_RT} AS reference, array_to_string(list_filter({_S(_RT)}, lambda s: NOT (regexp_matches(lower(s), '(^| )that ') OR s LIKE '%?')), ' ') AS asserted FROM questions")
add("h8_scenario_only", lambda s, d: qs(s, d).select("qid", lb.scenario_only(F.col("text"), "the", "of", "with").alias("scenario")), _Q, "SELECT qid, contains(lower(text), 'the') AND contains(lower(text), 'of') AND NOT contains(lower(text), 'with') AS scenario FROM questions")
add("h8_denied_slots", lambda s, d: lb.denied_slots(qs(s, d), _vocab(s), "and|of|der"), _Q, _V, "qw AS (SELECT qid, regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM questions)",
    "oc AS (SELECT qid, slot, value, len(list_filter(w[greatest(1, i - 3):i - 1], lambda x: x IN ('and', 'of', 'der'))) > 0 AS negated FROM qw, vocab, unnest(range(1, len(w) + 1)) u(i) WHERE w[i] = lower(term))",
    "SELECT qid, slot, value FROM oc GROUP BY ALL HAVING bool_and(negated)")
_gate = lambda s, d: lb.topic_gate(qs(s, d), TOPICS[:1])
_INT = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in INTENTS) + " ELSE 'unknown' END"
add("h10_intent", lambda s, d: lb.intent(qs(s, d), _gate(s, d), INTENTS), _Q, f"SELECT qid, CASE WHEN regexp_matches(lower(text), '{TOPICS[0][1]}') THEN 'escalate' ELSE {_INT} END AS intent FROM questions")
add("h9_compares_products", lambda s, d: lb.compares_products(qs(s, d), _al(s), "with|avec", "and").withColumn("compared", F.array_join("compared", ",")), _Q, _AL, _MN,
    "wd AS (SELECT qid, string_split_regex(trim(text, ' '), '[ \\t\\r\\n]+') AS w FROM questions), bs AS (SELECT qid, array_to_string(w[greatest(1, i - 3):i - 1] || w[i + 1:i + 3], ' ') AS around FROM wd, unnest(range(1, len(w) + 1)) u(i) WHERE regexp_replace(lower(w[i]), '^[,.;:?!]+|[,.;:?!]+$', '', 'g') = 'or')",
    f"nr AS (SELECT DISTINCT qid FROM bs, al WHERE {_WW('around', 'alias')}), nm AS (SELECT qid, list_sort(list_distinct(list(product))) AS named FROM mn GROUP BY qid), cq AS (SELECT q.qid, text, coalesce(named, []) AS named, regexp_matches(lower(text), 'with|avec') AS ex, q.qid IN (SELECT qid FROM nr) AS near FROM questions q LEFT JOIN nm USING (qid))",
    "SELECT qid, ex OR near AS compares, CASE WHEN NOT (ex OR near) AND len(named) = 1 THEN named[1] END AS topic_product, CASE WHEN ex AND NOT contains(lower(text), 'and') AND len(named) >= 2 THEN array_to_string(named, ',') ELSE '' END AS compared FROM cq")
_TERMS = [("cover", ["zeta", "alpha"]), ("mix", ["beta"])]
add("h11_asked_terms", lambda s, d: lb.asked_terms(qs(s, d), lb.primary_properties(_scores(s, d), "property"), s.createDataFrame(_TERMS, "property string, terms array<string>"), "(?:^| )die ([a-z]+)").select("qid", F.array_join("terms", ",").alias("terms")), _Q, _V, _SC,
    "pp AS (SELECT qid, value FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM sc WHERE slot = 'property') WHERE 2 * score >= top AND (NOT ask_only OR score = top))",
    "SELECT q.qid, coalesce(own, regexp_extract(lower(text), '(?:^| )die ([a-z]+)', 1)) AS terms FROM questions q LEFT JOIN (SELECT qid, array_to_string(list_sort(list_distinct(flatten(list(CASE value WHEN 'cover' THEN ['zeta', 'alpha'] ELSE ['beta'] END)))), ',') AS own FROM pp WHERE value IN ('cover', 'mix') GROUP BY qid) USING (qid)")
add("h12_asked_substrate", lambda s, d: lb.asked_substrate(qs(s, d), lb.detect_slots(_scores(s, d)), s.createDataFrame([("brick", "masonry"), ("erth", "soil")], "substrate string, published string")), _Q, _V, _SC,
    "SELECT qid, substrate, CASE substrate WHEN 'brick' THEN 'masonry' WHEN 'erth' THEN 'soil' END AS published FROM (SELECT q.qid, coalesce(value, nullif(regexp_extract(lower(text), '(?:^| )(?:on|onto|over|against) ([a-z]+)', 1), '')) AS substrate FROM questions q LEFT JOIN (SELECT qid, value FROM sc WHERE slot = 'substrate' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, value DESC) = 1) USING (qid))")
_H = (m.PASSAGES, m.QUERIES, SCORED, HITS)
_hits = lambda s, d: r.topk(m.queries(s, d), m.passages(s, d))
add("h13_is_deferral", lambda s, d: lb.is_deferral(_hits(s, d), "ation|nicht"), *_H, "SELECT qid, regexp_matches(lower(content), 'ation|nicht') AS defers FROM hits WHERE rank = 1")
_asked = lambda s, d: m.queries(s, d).select("qid", F.when(F.col("qid") % 3 == 0, F.array(F.lit("Section 4"))).when(F.col("qid") % 3 == 1, F.array(F.lit("zzz"))).otherwise(F.array().cast("array<string>")).alias("terms"))
_MET = "met AS (SELECT q.qid, CASE q.qid % 3 WHEN 0 THEN max(contains(lower(concat_ws(chr(10), section, content)), 'section 4')) WHEN 1 THEN false ELSE true END AS met FROM queries q JOIN hits h USING (qid) GROUP BY q.qid)"
add("h14_relevance_gate", lambda s, d: lb.relevance_gate(_asked(s, d), _hits(s, d)), *_H, _MET, "SELECT * FROM met")


def _facts(s, d):
    hits = materialise(_hits(s, d), "hits")  # read four times
    top = r.abstain(m.queries(s, d), hits, 0.3)
    one = hits.groupBy("qid").agg((F.count_distinct("canonical_url") == 1).alias("one_document"), F.min(F.col("audience") == "staff").alias("staff_only"))
    j = top.join(lb.relevance_gate(_asked(s, d), hits), "qid").join(lb.is_deferral(hits, "ation"), "qid").join(one, "qid")
    return j.select("*", (F.col("qid") % 7 == 0).alias("asks_cause"), (~F.col("met")).alias("property_absent"), F.lit(False).alias("substrate_absent"), (F.col("qid") % 11 == 0).alias("needs_substrate"), (F.col("qid") % 13 == 0).alias("calculation"))


_ROUTE = f"""fx AS (SELECT q.qid, coalesce(max(score), 0) < 0.3 AS below, bool_or(rank = 1 AND contains(lower(content), 'ation')) AS defers, count(DISTINCT canonical_url) = 1 AS one_document, min(audience = 'staff') AS staff_only FROM queries q JOIN hits USING (qid) GROUP BY q.qid),
rt AS (SELECT qid, CASE WHEN below THEN ('refuse', '1') WHEN defers THEN ('refuse', '2') WHEN qid % 7 = 0 THEN ('diagnosis', '3') WHEN NOT met THEN ('refuse', '4') WHEN qid % 11 = 0 THEN ('ask_back', '5') WHEN qid % 13 = 0 THEN ('extract', '6') WHEN one_document THEN ('extract', '7') WHEN staff_only THEN ('extract', '7s') ELSE ('compose', '8') END AS r FROM fx JOIN met USING (qid))"""
add("h15_route", lambda s, d: lb.route(_facts(s, d)), *_H, _MET, _ROUTE, "SELECT qid, r[1] AS path, r[2] AS step FROM rt")
add("h16_needs_substrate", lambda s, d: qs(s, d).join(lb.detect_slots(_scores(s, d)).where("slot = 'substrate'").select("qid", "value"), "qid", "left").select("qid", lb.needs_substrate(F.col("text"), "the", "in", "with").alias("needs"), lb.askback_answer(F.col("text"), F.col("value").isNotNull(), 40).alias("answers")), _Q, _V, _SC,
    f"SELECT qid, contains(lower(text), 'the') AND contains(lower(text), 'in') AND NOT contains(lower(text), 'with') AS needs, {_NW('text')} <= 40 AND trim(text, ' ') NOT LIKE '%?' AND qid IN (SELECT qid FROM sc WHERE slot = 'substrate') AS answers FROM questions")
add("h16_location_matters", lambda s, d: lb.location_matters(lb.primary_properties(_scores(s, d), "property"), ["cover", "dry"]), _Q, _V, _SC,
    "pp AS (SELECT qid, value FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM sc WHERE slot = 'property') WHERE 2 * score >= top AND (NOT ask_only OR score = top))", "SELECT qid, bool_or(value IN ('cover', 'dry')) AS matters FROM pp GROUP BY qid")
add("h17_resolve_audience", lambda s, d: m.queries(s, d).select("qid", F.array_join(lb.resolve_audience(F.when(F.col("qid") % 2 == 0, F.array(F.lit(" Staff"), F.lit("PUBLIC"))).otherwise(F.array(F.lit("nobody"))), F.col("audiences")), ",").alias("audience")), m.QUERIES,
    "SELECT qid, CASE WHEN qid % 2 = 1 THEN array_to_string(audiences, ',') WHEN qid % 3 = 2 THEN 'staff,public' ELSE 'public' END AS audience FROM queries")


def _history(s, d):
    return qs(s, d).select("qid", F.explode(F.array(F.lit("substrate"), F.lit("exposure"))).alias("slot")).select("qid", "slot", F.when(F.col("slot") == "substrate", "stone").otherwise("high").alias("value"))


add("h18_resolve_request", lambda s, d: lb.resolve_request(_scores(s, d).select("qid", "slot", "value"), _history(s, d), qs(s, d).where(F.col("qid").endswith("0")).select("qid", F.lit("exposure").alias("slot"), F.lit("high").alias("value"))), _Q, _V, _SC,
    "nw AS (SELECT qid, slot, count(DISTINCT value) AS n, min(value) AS value FROM sc GROUP BY ALL), hs AS (SELECT qid, 'substrate' AS slot, 'stone' AS carried FROM questions UNION ALL SELECT qid, 'exposure', 'high' FROM questions WHERE qid NOT LIKE '%0')",
    "SELECT qid, slot, CASE WHEN n > 1 THEN NULL ELSE coalesce(value, carried) END AS value, CASE WHEN n > 1 THEN 'unsettled' WHEN n = 1 THEN 'stated' ELSE 'carried' END AS provenance FROM nw FULL JOIN hs USING (qid, slot)")

# Eligibility: requests are the retrieval queries, candidates the products of their hits.
REQ = [("select", "substrate", None, None), ("select", "location", None, None), ("select", "exposure", "location", "outside"), ("repair", "symptom", None, None)]


def _requests(s, d):
    known = F.when(F.col("qid") % 3 == 0, F.create_map(F.lit("location"), F.lit("outside"))).otherwise(F.create_map(F.lit("substrate"), F.lit("brick"), F.lit("location"), F.lit("inside")))
    return m.queries(s, d).select("qid", F.when(F.col("qid") % 2 == 0, "select").otherwise("repair").alias("objective"), known.alias("known"), F.when(F.col("qid") % 5 == 0, F.array(F.lit("location"))).otherwise(F.array().cast("array<string>")).alias("unsettled"))


_req = lambda s: s.createDataFrame(REQ, "objective string, slot string, if_slot string, if_value string")
_MISS = "ms AS (SELECT qid, list_sort(list_distinct(CASE WHEN qid % 2 = 1 THEN ['symptom'] WHEN qid % 3 = 0 THEN ['substrate', 'exposure'] ELSE [] END || CASE WHEN qid % 5 = 0 THEN ['location'] ELSE [] END)) AS missing FROM queries)"
add("i1_missing_facts", lambda s, d: el.missing_facts(_requests(s, d), _req(s)).select("qid", F.array_join("missing", ",").alias("missing")), m.QUERIES, _MISS, "SELECT qid, array_to_string(missing, ',') AS missing FROM ms")


def _candidates(s, d):
    named = m.queries(s, d).where("product != ''").select("qid", "product")
    proposals = m.queries(s, d).select("qid", F.explode(F.array(F.lit("p1"), F.lit("p9"), F.lit("zz"))).alias("product"), F.lit(1).alias("nth"))
    return el.discover(named, _hits(s, d).select("qid", "product", "rank"), proposals, m.passages(s, d).select("product").distinct(), 4)


_CAND = "cd AS (SELECT qid, product, row_number() OVER (PARTITION BY qid ORDER BY x, product) AS rank FROM (SELECT qid, product, min((a, b)) AS x FROM (SELECT qid, product, 0 AS a, 0 AS b FROM queries WHERE product <> '' UNION ALL SELECT qid, product, 1, rank FROM hits UNION ALL SELECT qid, unnest(['p1', 'p9']), 2, 1 FROM queries) GROUP BY ALL) QUALIFY rank <= 4)"
add("i2_discover", _candidates, *_H, _CAND, "SELECT * FROM cd")


CAVEATS, EXCLUDED = ("p2", "p5"), ("p3",)  # products with a published caveat, and those ruled out


def _assess(s, d):
    ev = m.passages(s, d).select(F.when((F.col("authority") == 1) & (F.col("audience") == "staff"), "substrate").otherwise("cover").alias("property"), "product", "passage_id")
    cav, out = (s.createDataFrame([(x,) for x in names], "product string") for names in (CAVEATS, EXCLUDED))
    prop = m.queries(s, d).select("qid", F.explode(F.array(F.lit("substrate"), F.lit("cover"))).alias("property"))
    return el.assess(_candidates(s, d), prop, ev, cav, out)


_ASSESS = """ev AS (SELECT DISTINCT product, CASE WHEN authority = 1 AND audience = 'staff' THEN 'substrate' ELSE 'cover' END AS property FROM passages),
ax AS (SELECT qid, product, coalesce(list(property) FILTER (ok), []) AS s, coalesce(list(property) FILTER (NOT ok), []) AS u FROM (SELECT qid, product, property, (product, property) IN (SELECT (product, property) FROM ev) AS ok FROM cd, (VALUES ('substrate'), ('cover')) v(property)) GROUP BY ALL),
ay AS (SELECT qid, product, CASE WHEN product IN ('p3') THEN 'incompatible' WHEN list_contains(u, 'substrate') THEN 'insufficient' WHEN len(u) > 0 OR product IN ('p2', 'p5') THEN 'conditional' ELSE 'supported' END AS status, list_sort(s) AS s, list_sort(u) AS u FROM ax)"""
add("i3_assess", lambda s, d: _assess(s, d).select("qid", "product", "status", F.array_join("supported", ",").alias("supported"), F.array_join("unsupported", ",").alias("unsupported")), *_H, _CAND, _ASSESS, "SELECT qid, product, status, array_to_string(s, ',') AS supported, array_to_string(u, ',') AS unsupported FROM ay")
RULES = [(0, "P1", "brick", True, False, True, ["prime first"]), (1, "p1", "brick", False, True, True, []), (2, "p2", "Brick", True, True, False, []), (3, "p3", "stone", True, True, True, [])]
_compat = lambda s, d: el.compatible(_candidates(s, d).select("qid", "product", F.lit("brick").alias("substrate"), F.when(F.col("qid") % 3 == 0, "outside").when(F.col("qid") % 3 == 1, "inside").alias("location")), s.createDataFrame(RULES, "nth int, product string, substrate string, interior boolean, exterior boolean, recommended boolean, caveats array<string>"))
add("i4_compatible", lambda s, d: _compat(s, d).select("qid", "product", "compatible", F.array_join("caveats", ",").alias("caveats")), *_H, _CAND, "SELECT qid, product, CASE product WHEN 'p1' THEN qid % 3 <> 0 WHEN 'p2' THEN false END AS compatible, CASE product WHEN 'p1' THEN 'prime first' WHEN 'p2' THEN '' END AS caveats FROM cd")
_decide = lambda s, d: el.decide(el.missing_facts(_requests(s, d).withColumn("unsettled", F.array().cast("array<string>")), _req(s)), _assess(s, d))
_DEC = """dc AS (SELECT qid, CASE WHEN qid % 2 = 1 OR qid % 3 = 0 THEN 'missing facts' WHEN len(a) = 0 THEN CASE WHEN bad THEN 'none: incompatible' ELSE 'none: unsupported' END WHEN f THEN 'supported' ELSE 'conditional' END AS outcome, a, rj FROM (SELECT qid, list_sort(coalesce(list(product) FILTER (status IN ('supported', 'conditional')), [])) AS a, list_sort(coalesce(list(product) FILTER (status NOT IN ('supported', 'conditional')), [])) AS rj, bool_or(status = 'supported') AS f, bool_or(status = 'incompatible') AS bad FROM ay GROUP BY qid))"""
add("i5_decide", lambda s, d: _decide(s, d).select("qid", "outcome", F.array_join("approved", ",").alias("approved"), F.array_join("rejected", ",").alias("rejected")), *_H, _CAND, _ASSESS, _DEC, "SELECT qid, outcome, array_to_string(a, ',') AS approved, array_to_string(rj, ',') AS rejected FROM dc")
_NAMES = [("the",), ("and",), ("und",), ("la",)]
_answers = lambda s, d: m.turns(s, d).where("role = 'assistant'").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"), "text")
_AN = "an AS (SELECT conv_id || '-' || turn AS qid, text FROM turns WHERE role = 'assistant'), nm AS (SELECT * FROM (VALUES ('the'), ('and'), ('und'), ('la')) v(product))"
add("i6_recommended_products", lambda s, d: el.recommended_products(_answers(s, d), s.createDataFrame(_NAMES, "product string"), "ation|ung "), m.TURNS, _AN,
    f"SELECT DISTINCT qid, product FROM (SELECT qid, unnest({_S('text')}) AS s FROM an), nm WHERE regexp_matches(lower(s), 'ation|ung ') AND {_WW('s', 'product')}")
add("i7_unapproved", lambda s, d: el.unapproved(_answers(s, d), s.createDataFrame(_NAMES, "product string"), _answers(s, d).where(F.length("text") % 2 == 0).select("qid", F.array(F.lit("brand and"), F.lit("la")).alias("approved"))), m.TURNS, _AN,
    f"SELECT DISTINCT qid, product FROM an, nm WHERE {_WW('text', 'product')} AND NOT (length(text) % 2 = 0 AND product IN ('and', 'la'))")
