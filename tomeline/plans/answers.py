"""Verification, conversation, observation, reuse, case and evaluation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import conversation as cv
from ..operators import jobs as j
from ..operators import observations as ob
from ..operators import relations as rl
from ..operators import retrieval as r
from ..operators import verification as v
from ..sources import model as m
from .base import collection
from .labelling import _S, _WW
from .retrieval import HITS, SCORED

QUERIES, ORACLES, add = collection()

PRODUCTS = ["the", "und", "que", "of", "la"]
_NOTE = "'waterproof 12 mm, up to 5 kg'"


def answers(s, d):
    """Assistant turns; the first sentence of every other one cites [1], figures come from the turn's length."""
    t = m.turns(s, d).where("role = 'assistant'")
    figure = F.concat(F.lit(" up to "), (F.col("conv_id") % 40).cast("string"), F.lit(" mm [2]. Acme Solo is not waterproof [3]."))
    return t.select((F.col("conv_id") * 100 + F.col("turn")).alias("aid"), F.lit("How thick is 7 mm?").alias("question"), F.concat(F.regexp_replace("text", "^([^.]*)\\.", "$1 [1]."), figure).alias("text"), F.col("conv_id").alias("doc"))


def evidence(s, d):
    """Three passages for each answer: the document of the conversation's number, counted round, and the two after it."""
    a = answers(s, d).select("aid", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<long>")).alias("i"), "doc")
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    x = a.crossJoin(F.broadcast(docs.agg(F.count("*").alias("docs")))).join(docs, (F.col("doc") + F.col("i")) % F.col("docs") == F.col("doc_id"))
    return x.select("aid", (F.col("i") + 1).alias("marker"), v.F.element_at(F.array(*map(F.lit, PRODUCTS)), (F.col("doc_id") % 5 + 1).cast("int")).alias("product"), F.concat(F.lit("Part "), F.col("i").cast("string")).alias("section"), F.concat("text", F.lit(" Cover up to "), (F.col("doc_id") % 40).cast("string"), F.lit(" mm. It is not waterproof.")).alias("content"))


_A = """an AS (SELECT conv_id * 100 + turn AS aid, 'How thick is 7 mm?' AS question, regexp_replace(text, '^([^.]*)\\.', '\\1 [1].') || ' up to ' || CAST(conv_id % 40 AS VARCHAR) || ' mm [2]. Acme Solo is not waterproof [3].' AS text, conv_id AS doc FROM turns WHERE role = 'assistant'),
ev AS (SELECT aid, i + 1 AS marker, (['the', 'und', 'que', 'of', 'la'])[CAST(doc_id % 5 AS INT) + 1] AS product, 'Part ' || CAST(i AS VARCHAR) AS section, documents.text || ' Cover up to ' || CAST(doc_id % 40 AS VARCHAR) || ' mm. It is not waterproof.' AS content FROM (SELECT aid, doc, unnest(range(3)) AS i FROM an) JOIN documents ON (doc + i) % (SELECT count(*) FROM documents) = doc_id)"""
_C = f"""cl AS (SELECT aid, i AS seq, l[i + 1] AS sentence, list_transform(regexp_extract_all(l[i + 1], '\\[([0-9]+)\\]', 1), lambda x: CAST(x AS INT)) AS markers FROM (SELECT aid, {_S('text')} AS l FROM an), unnest(range(len(l))) u(i)),
ct AS (SELECT aid, seq, sentence, markers, coalesce((SELECT string_agg(section || chr(10) || content, chr(10) ORDER BY marker) FROM ev WHERE ev.aid = cl.aid AND list_contains(cl.markers, ev.marker)), '') AS cited, coalesce((SELECT list(product) FROM ev WHERE ev.aid = cl.aid AND list_contains(cl.markers, ev.marker)), []) AS own FROM cl)"""
_all = (m.TURNS, _A, _C)
_claims = lambda s, d: v.claims(answers(s, d))
_cited = lambda s, d: v.cited(_claims(s, d), evidence(s, d))
add("j1_claims", lambda s, d: _claims(s, d).select("aid", "seq", "sentence", F.array_join(F.transform("markers", lambda x: x.cast("string")), ",").alias("markers")), *_all, "SELECT aid, seq, sentence, array_to_string(markers, ',') AS markers FROM cl")
add("j2_check_citation", lambda s, d: v.check_citation(_cited(s, d)), *_all, "SELECT aid, seq, CAST(1 AS BIGINT) AS \"check\", 'citation' AS note FROM cl WHERE len(markers) = 0 OR list_max(markers) > 3")
_CW = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: length(w) >= 4))"
_PLAIN = "trim(regexp_replace(sentence, '\\[[0-9]+\\]', '', 'g'), ' ')"
_CLAUSES = f"list_filter(list_transform(string_split(regexp_replace(regexp_replace({_PLAIN}, '[;:]', chr(1), 'g'), ', (and |but |which |when |if )', chr(1) || '\\1', 'g'), chr(1)), lambda c: trim(c, ' ')), lambda c: c <> '')"
add("j3_check_overlap", lambda s, d: v.check_overlap(_cited(s, d)), *_all, f"cx AS (SELECT aid, seq, {_CW('cited')} AS have, unnest({_CLAUSES}) AS clause FROM ct WHERE cited <> '')",
    f"SELECT DISTINCT aid, seq, CAST(1 AS BIGINT) AS \"check\", 'overlap' AS note FROM cx WHERE len({_CW('clause')}) > 0 AND len(list_intersect({_CW('clause')}, have)) < 0.4 * len({_CW('clause')})")
_FIG = lambda c: f"list_distinct(list_transform(regexp_extract_all(lower({c}), '{v.FIGURE}'), lambda f: replace(replace(f, ' ', ''), ',', '.')))"
_LOST = f"list_sort(list_filter({_FIG('sentence')}, lambda f: NOT list_contains({_FIG('cited')}, f)))"
add("j4_check_numbers", lambda s, d: v.check_numbers(_cited(s, d)), *_all, f"SELECT aid, seq, CAST(2 AS BIGINT) AS \"check\", array_to_string({_LOST}, ',') AS note FROM ct WHERE len({_LOST}) > 0")
_STR = "list_sort(list_filter(['the', 'und', 'que', 'of', 'la'], lambda p: " + _WW("sentence", "p") + " AND NOT list_contains(own, p) AND NOT contains(lower(cited), p)))"
add("j5_check_attribution", lambda s, d: v.check_attribution(_cited(s, d), PRODUCTS), *_all, f"SELECT aid, seq, CAST(3 AS BIGINT) AS \"check\", array_to_string({_STR}, ',') AS note FROM ct WHERE regexp_matches(sentence, '[0-9]') AND len({_STR}) > 0")
_QUAL = "regexp_extract(lower(sentence), '(?:^|[^a-z])(up to|at least|about|minimum|maximum)(?:[^a-z]|$)', 1)"
add("j6_check_qualifiers", lambda s, d: v.check_qualifiers(_cited(s, d).withColumn("cited", F.when(F.col("aid") % 3 == 0, F.regexp_replace("cited", "up to", "near")).otherwise(F.col("cited")))), *_all,
    f"SELECT aid, seq, CAST(4 AS BIGINT) AS \"check\", {_QUAL} AS note FROM (SELECT * REPLACE (CASE WHEN aid % 3 = 0 THEN replace(cited, 'up to', 'near') ELSE cited END AS cited) FROM ct) WHERE {_QUAL} <> '' AND regexp_matches(regexp_replace(sentence, '\\[[0-9]+\\]', '', 'g'), '[0-9]') AND len(list_filter({_S('cited')}, lambda x: contains(lower(x), {_QUAL}) AND regexp_matches(x, '[0-9]'))) = 0")
_NM = "list_distinct(regexp_extract_all(regexp_replace(regexp_replace(sentence, '\\[[0-9]+\\]', '', 'g'), '^[^ ]+ ', ''), '[A-Z][a-z]+(?: [A-Z][a-z]+)*'))"
add("j7_check_names", lambda s, d: v.check_names(_cited(s, d), s.createDataFrame([("Duo",)], "name string"), ["in", "die"]), *_all,
    f"nm AS (SELECT aid, seq, cited, unnest({_NM}) AS name FROM ct)", "SELECT aid, seq, CAST(5 AS BIGINT) AS \"check\", string_agg(name, ',' ORDER BY name) AS note FROM nm WHERE lower(name) NOT IN ('in', 'die', 'duo') AND NOT contains(lower(cited), lower(name)) GROUP BY aid, seq")
_terms = lambda s, d: answers(s, d).withColumn("terms", F.when(F.col("aid") % 2 == 0, F.array(F.lit("cover"))).otherwise(F.array(F.lit("zzz"), F.lit("inger"))))
add("j8_check_property", lambda s, d: v.check_property(_terms(s, d), evidence(s, d)), *_all, "SELECT aid, CAST(-1 AS BIGINT) AS seq, CAST(6 AS BIGINT) AS \"check\", 'property' AS note FROM an WHERE aid % 2 = 1 AND NOT coalesce((SELECT bool_or(contains(lower(content), 'zzz') OR contains(lower(content), 'inger')) FROM ev WHERE ev.aid = an.aid), false)")
add("j9_check_scope", lambda s, d: v.check_scope(_cited(s, d), PRODUCTS, answers(s, d).select("aid", F.array(F.lit("la")).alias("asked"))), *_all,
    f"sx AS (SELECT aid, seq, list_sort(list_filter(['the', 'und', 'que', 'of'], lambda p: {_WW('sentence', 'p')} AND NOT contains(b, p))) AS o FROM (SELECT *, lower(coalesce((SELECT string_agg(content, chr(10)) FROM ev WHERE ev.aid = cl.aid AND list_contains(cl.markers, ev.marker) AND product = 'la'), '')) AS b FROM cl))",
    "SELECT aid, seq, CAST(7 AS BIGINT) AS \"check\", array_to_string(o, ',') AS note FROM sx WHERE len(o) > 0")
_REL = ["the", "of", "that", "in", "der", "die", "que"]
_JOINTS = [(" and ", " over "), (" und ", " over "), (" to ", " not under "), (" la ", " with ")]  # so that the texts link names

_q = lambda p: "'" + p.replace("'", "''") + "'"
_SET = lambda t, p, g=0: f"list_sort(list_distinct(list_transform(regexp_extract_all({t}, {_q(p)}, {g}), lambda x: trim(regexp_replace(x, '[ \\t\\r\\n]+', ' ', 'g'), ' .'))))"
_BARE = lambda t: f"lower(regexp_replace({t}, ' ?\\[[0-9]+\\]', '', 'g'))"
LIMITS = lambda t: "concat_ws('#', " + ", ".join(f"array_to_string({_SET(_BARE(t), p, g)}, '|')" for p, g in ((rl.CONDITION, 0), (rl.MODIFIER, 0), (rl.WARNING, 1))) + ")"


def relation_sql(name, source, names):
    """The relations of a table source(id, s) as a table expression."""
    part = lambda g: f"regexp_extract_all(doubled, {_q(rl.pair_pattern(names))}, {g})"
    cut = f"regexp_replace(regexp_replace({_BARE('s')}, {_q(rl.BREAKS)}, chr(1), 'g'), {_q(rl.PROHIBITION)}, chr(1) || '\\1', 'g')"
    main = f"regexp_replace(regexp_replace(clause, {_q(rl.FIRST_CONDITION)}, ''), {_q(rl.LATER_CONDITION)}, '')"
    b_state = f"regexp_extract(after, {_q(chr(92) + 'b(' + '|'.join(rl.STATES) + ') $')}, 1)"
    of = lambda n: f"CASE WHEN a = {n} THEN coalesce(state, '') ELSE {b_state} END"
    coated = f"regexp_matches(between_, {_q(rl.COATED)})"
    return f"""{name}_c AS (SELECT id, {LIMITS('s')} AS limits, unnest(string_split({cut}, chr(1))) AS clause FROM {source}),
{name}_d AS (SELECT *, regexp_replace(clause, {_q(rl.twice_pattern(names))}, '\\1\\2  \\1\\2', 'g') AS doubled FROM {name}_c),
{name}_x AS (SELECT id, limits, regexp_matches({main}, {_q(rl.NEGATED)}) AS negated, regexp_matches({main}, {_q(rl.DOUBTED)}) AS uncertain, unnest({part(1)}) AS state, unnest({part(2)}) AS a, unnest({part(3)}) AS between_, unnest({part(4)}) AS link, unnest({part(5)}) AS after, unnest({part(6)}) AS b FROM {name}_d),
{name}_k AS (SELECT *, CASE WHEN NOT {coated} AND link = 'with' THEN 'pair' WHEN link IN ('over', 'onto', 'on top of', 'on', 'under', 'beneath', 'below') OR {coated} THEN 'layer' END AS kind FROM {name}_x WHERE a <> b),
{name}_l AS (SELECT *, CASE WHEN kind = 'pair' THEN least(a, b) WHEN link IN ('over', 'onto', 'on top of', 'on') THEN a ELSE b END AS layer FROM {name}_k WHERE kind IS NOT NULL),
{name} AS (SELECT id, kind, layer, CASE WHEN layer = a THEN b ELSE a END AS base, negated, uncertain, CASE WHEN kind = 'pair' THEN '' ELSE concat_ws(',', {of('layer')}, {of('CASE WHEN layer = a THEN b ELSE a END')}) END AS states, limits FROM {name}_l)"""


_jointed = lambda c: reduce(lambda x, ab: F.replace(x, F.lit(ab[0]), F.lit(ab[1])), _JOINTS, F.col(c))
_JOINTED = lambda c: reduce(lambda x, ab: f"replace({x}, '{ab[0]}', '{ab[1]}')", _JOINTS, c)
_THAT = f"replace({_JOINTED('text')}, ' the ', ' that ')"
_linked = lambda c: c.withColumns({n: _jointed(n) for n in ("sentence", "cited") if n in c.columns})
_rel = lambda s, d: rl.relations(_linked(_claims(s, d)).select(F.struct("aid", "seq").alias("id"), F.col("sentence").alias("s")), _REL)
_SAID = f"sd0 AS (SELECT (aid, seq) AS id, {_JOINTED('sentence')} AS s FROM ct)"
_KNOWN = f"kn0 AS (SELECT * FROM (SELECT (aid, seq) AS id, unnest({_S(_JOINTED('cited'))}) AS s FROM ct) WHERE s NOT LIKE '%?')"
add("j10_relations", lambda s, d: _rel(s, d).select("id.aid", "id.seq", "kind", "layer", "base", "negated", "uncertain", "states", "limits"), *_all, _SAID, relation_sql("sd", "sd0", _REL),
    "SELECT id[1] AS aid, id[2] AS seq, kind, layer, base, negated, uncertain, states, limits FROM sd")
add("j10_check_relations", lambda s, d: v.check_relations(_linked(_cited(s, d)), _REL), *_all, _SAID, relation_sql("sd", "sd0", _REL), _KNOWN, relation_sql("kn", "kn0", _REL),
    "SELECT id[1] AS aid, id[2] AS seq, CAST(8 AS BIGINT) AS \"check\", string_agg(x, ',' ORDER BY x) AS note FROM (SELECT DISTINCT id, layer || ' ' || kind || ' ' || base AS x FROM (SELECT * FROM sd EXCEPT SELECT * FROM kn)) GROUP BY id")
add("j10_requested_relations", lambda s, d: v.check_requested_relations(answers(s, d).withColumn("question", F.replace(_jointed("text"), F.lit(" the "), F.lit(" that "))), _linked(_claims(s, d)), _REL), *_all, _SAID, relation_sql("sd", "sd0", _REL),
    f"as0 AS (SELECT aid AS id, unnest({_S(_THAT)}) AS s FROM an)", relation_sql("rq", "as0", _REL),
    "SELECT id AS aid, CAST(-1 AS BIGINT) AS seq, CAST(8 AS BIGINT) AS \"check\", string_agg(layer || ' ' || kind || ' ' || base, ',' ORDER BY layer || ' ' || kind || ' ' || base) AS note FROM (SELECT DISTINCT id, kind, layer, base FROM rq WHERE (id, kind, layer, base) NOT IN (SELECT (id[1], kind, layer, base) FROM sd)) GROUP BY id")
_NO = lambda c: f"regexp_matches(lower({c}), '(^|[^a-z])(not|never|no)([^a-z]|$)')"
_SENS = "regexp_extract(lower(sentence), '(?:^|[^a-z])(waterproof|structural|certified)(?:[^a-z]|$)', 1)"
add("j11_check_sensitive", lambda s, d: v.check_sensitive(_cited(s, d).withColumn("cited", F.when(F.col("aid") % 4 == 0, F.replace("cited", F.lit("It is not waterproof"), F.lit("It is waterproof"))).otherwise(F.col("cited")))), *_all,
    f"SELECT aid, seq, CAST(8 AS BIGINT) AS \"check\", {_SENS} AS note FROM (SELECT * REPLACE (CASE WHEN aid % 4 = 0 THEN replace(cited, 'It is not waterproof', 'It is waterproof') ELSE cited END AS cited) FROM ct) WHERE {_SENS} <> '' AND len(list_filter({_S('cited')}, lambda x: contains(lower(x), {_SENS}) AND {_NO('x')} = {_NO('sentence')})) = 0")
_la = lambda c: c.withColumns({"sentence": F.when(F.col("aid") % 3 == 0, F.concat(F.lit("la "), "sentence")).otherwise(F.col("sentence")), "cited": F.when(F.col("aid") % 2 == 0, F.replace("cited", F.lit("Cover up"), F.lit("For la up"))).otherwise(F.col("cited"))})
add("j12_check_numeric_binding", lambda s, d: v.check_numeric_binding(_la(_cited(s, d)), PRODUCTS), *_all,
    "cl2 AS (SELECT * REPLACE (CASE WHEN aid % 3 = 0 THEN 'la ' || sentence ELSE sentence END AS sentence, CASE WHEN aid % 2 = 0 THEN replace(cited, 'Cover up', 'For la up') ELSE cited END AS cited) FROM ct)",
    f"nb AS (SELECT aid, seq, cited, list_filter(['the', 'und', 'que', 'of', 'la'], lambda p: {_WW('sentence', 'p')}) AS named, unnest({_FIG('sentence')}) AS figure FROM cl2)",
    f"SELECT aid, seq, CAST(8 AS BIGINT) AS \"check\", string_agg(DISTINCT figure, ',' ORDER BY figure) AS note FROM nb WHERE len(named) > 0 AND len(list_filter({_S('cited')}, lambda x: list_contains({_FIG('x')}, figure) AND len(list_filter(named, lambda p: {_WW('x', 'p')})) > 0)) = 0 GROUP BY aid, seq")
_LOW2 = "CASE WHEN aid % 4 = 0 THEN replace(sentence, 'up to', 'near') ELSE sentence END"
_OWN = "cited || ' Take la up to ' || regexp_extract(sentence, '([0-9]+) mm', 1) || ' mm' || CASE WHEN aid % 5 = 0 THEN ' if dry.' ELSE '.' END"
_less = lambda c: c.withColumns({"sentence": F.when(F.col("aid") % 4 == 0, F.replace("sentence", F.lit("up to"), F.lit("near"))).otherwise(F.col("sentence")), "cited": F.expr(_OWN)})
add("j12_check_numeric_limits", lambda s, d: v.check_numeric_limits(_less(_la(_cited(s, d))), PRODUCTS), *_all,
    "cl2 AS (SELECT * REPLACE (CASE WHEN aid % 3 = 0 THEN 'la ' || sentence ELSE sentence END AS sentence, CASE WHEN aid % 2 = 0 THEN replace(cited, 'Cover up', 'For la up') ELSE cited END AS cited) FROM ct)",
    f"cl3 AS (SELECT * REPLACE ({_LOW2} AS sentence, {_OWN} AS cited) FROM cl2), nb AS (SELECT aid, seq, cited, lower(sentence) AS low, {LIMITS('sentence')} AS own, list_filter(['the', 'und', 'que', 'of', 'la'], lambda p: {_WW('sentence', 'p')}) AS named, unnest({_FIG('sentence')}) AS figure FROM cl3)",
    f"bn AS (SELECT aid, seq, low, own, figure, unnest(list_filter({_S('cited')}, lambda x: list_contains({_FIG('x')}, figure) AND len(list_filter(named, lambda p: {_WW('x', 'p')})) > 0)) AS s FROM nb WHERE len(named) > 0)",
    f"lk AS (SELECT aid, seq, figure FROM bn GROUP BY aid, seq, figure HAVING NOT bool_or(len(list_filter({_SET('lower(s)', rl.QUALIFIER)}, lambda q: NOT contains(low, q))) = 0 AND {LIMITS('s')} = own))",
    "SELECT aid, seq, CAST(4 AS BIGINT) AS \"check\", string_agg(DISTINCT figure, ',' ORDER BY figure) AS note FROM lk GROUP BY aid, seq")
_pairs = lambda s, d: answers(s, d).select("aid", F.col("text").alias("original"), F.expr("CASE aid % 5 WHEN 0 THEN text WHEN 1 THEN '' WHEN 2 THEN replace(text, '[2]', '[1]') WHEN 3 THEN replace(text, ' mm', '1 mm') ELSE replace(text, ' not ', ' ') END").alias("rewritten"))
add("j13_rewrite_preserved", lambda s, d: v.rewrite_preserved(_pairs(s, d)), *_all, "SELECT aid, CASE aid % 5 WHEN 1 THEN 'empty' WHEN 2 THEN 'markers' WHEN 3 THEN 'figures' WHEN 4 THEN CASE WHEN NOT regexp_matches(lower(replace(text, ' not ', ' ')), '(^|[^a-z])(not|never|only|unless|except)([^a-z]|$)') THEN 'limitation' END END AS reason FROM an")
_H = (m.PASSAGES, m.QUERIES, SCORED, HITS)
_hits = lambda s, d: r.topk(m.queries(s, d), m.passages(s, d))
add("j14_field_answers", lambda s, d: v.field_answers(m.queries(s, d).select("qid", F.array(F.lit("a"), F.lit("b")).alias("fields")), _hits(s, d), s.createDataFrame([("a", "ation$|ation[.]"), ("b", "zzz")], "field string, pattern string")).select("qid", "field", F.sha2("answer", 256).alias("digest")), *_H,
    f"fs AS (SELECT qid, rank, i AS nth, l[i + 1] AS s FROM (SELECT qid, rank, {_S('content')} AS l FROM hits), unnest(range(len(l))) u(i)), fo AS (SELECT qid, min((rank, nth, s)) AS x FROM fs WHERE regexp_matches(lower(s), 'ation$|ation[.]') GROUP BY qid, lower(trim(regexp_replace(s, '[ \\t\\r\\n]+', ' ', 'g'), ' ')))",
    "SELECT qid, 'a' AS field, sha256(coalesce((SELECT string_agg(x[3], ' ' ORDER BY x[1], x[2]) FROM fo WHERE fo.qid = q.qid), '')) AS digest FROM queries q UNION ALL SELECT qid, 'b', sha256('') FROM queries")
add("j15_verify", lambda s, d: v.verify(_terms(s, d).withColumn("asked", F.when(F.col("aid") % 5 == 0, F.array(F.lit("la"))).otherwise(F.array().cast("array<string>"))), evidence(s, d), PRODUCTS, s.createDataFrame([("Duo",)], "name string"), ["in"]))
_NU = lambda c: f"list_distinct(regexp_extract_all(regexp_replace({c}, '\\[[0-9]+\\]', '', 'g'), '[0-9]+(?:\\.[0-9]+)?|\\.[0-9]+'))"
add("j16_published_numbers", lambda s, d: v.published_numbers(answers(s, d), evidence(s, d)).select("aid", F.array_join("strange", ",").alias("strange")), *_all,
    f"kn AS (SELECT aid, flatten(list({_NU('content')})) AS known FROM ev GROUP BY aid)", f"SELECT aid, array_to_string(list_sort(list_filter({_NU('text')}, lambda n: NOT list_contains(known, n) AND n <> '7')), ',') AS strange FROM an JOIN kn USING (aid)")

# Conversations
_fact = "CASE turn % 4 WHEN 0 THEN 'stated' WHEN 1 THEN 'observed' WHEN 2 THEN 'carried' ELSE 'denied' END"


def facts(s, d):
    t = m.turns(s, d)
    return t.select("conv_id", F.lit(0).cast("long").alias("case_id"), "turn", F.element_at(F.array(F.lit("substrate"), F.lit("location")), (F.length("text") % 2 + 1).cast("int")).alias("slot"), F.concat(F.lit("v"), (F.length("text") % 3).cast("string")).alias("value"), F.expr(_fact).alias("provenance"))


joined = lambda df: df.withColumns({c: F.array_join(c, ",") for c in ("superseded", "conflicting")})
_NEW = "value := x.value, provenance := x.provenance, turn := x.turn, status := 'active'"
_MADE = lambda new, old, beside: f"struct_pack({new}, superseded := {old}, conflicting := {beside})"
_OLDER = "list_append(a.superseded, a.value)"
#: facts f (conv_id, case_id, slot, turn, nth, provenance, value), those that count, folded.
FOLD = f"""folded AS (SELECT conv_id, case_id, slot, unnest(list_reduce(l, lambda a, x: CASE
  WHEN x.provenance = 'denied' THEN CASE WHEN a.value IS NOT NULL AND coalesce(x.value = a.value, true) THEN {_MADE("value := NULL::VARCHAR, provenance := NULL::VARCHAR, turn := NULL::BIGINT, status := NULL::VARCHAR", _OLDER, "[]::VARCHAR[]")} ELSE a END
  WHEN a.value IS NULL THEN {_MADE(_NEW, "a.superseded", "a.conflicting")}
  WHEN x.provenance = 'stated' THEN CASE WHEN a.value = x.value AND a.provenance IN ('stated', 'carried') THEN {_MADE(_NEW, "a.superseded", "a.conflicting")} ELSE {_MADE(_NEW, _OLDER, "[]::VARCHAR[]")} END
  WHEN a.provenance = 'observed' THEN {_MADE(_NEW, "a.superseded", "a.conflicting")}
  WHEN x.provenance = 'carried' OR a.value = x.value THEN a
  ELSE {_MADE("value := a.value, provenance := a.provenance, turn := a.turn, status := CASE WHEN a.turn = x.turn THEN a.status ELSE 'conflicting' END", "a.superseded", "list_append(a.conflicting, x.value)")} END,
  {_MADE("value := NULL::VARCHAR, provenance := NULL::VARCHAR, turn := NULL::BIGINT, status := NULL::VARCHAR", "[]::VARCHAR[]", "[]::VARCHAR[]")})) FROM (
  SELECT conv_id, case_id, slot, list({_MADE("value := value, provenance := provenance, turn := turn, status := NULL::VARCHAR", "[]::VARCHAR[]", "[]::VARCHAR[]")} ORDER BY turn, nth) AS l FROM f GROUP BY ALL))"""
_F1 = f"f AS (SELECT conv_id, CAST(0 AS BIGINT) AS case_id, (['substrate', 'location'])[CAST(length(text) % 2 AS INT) + 1] AS slot, turn, CAST(1 AS BIGINT) AS nth, {_fact} AS provenance, 'v' || CAST(length(text) % 3 AS VARCHAR) AS value FROM turns)"
KNOWN = "SELECT conv_id, case_id, slot, value, provenance, turn, status, array_to_string(superseded, ',') AS superseded, array_to_string(conflicting, ',') AS conflicting FROM folded"
add("k1_merge_facts", lambda s, d: joined(cv.merge_facts(facts(s, d))), m.TURNS, _F1, FOLD, KNOWN)

FACT_KINDS = (
    "CASE length(text) % 3 WHEN 0 THEN 'carried' WHEN 1 THEN 'stated' ELSE 'observed' END",
    "CASE length(text) % 4 WHEN 0 THEN 'stated' WHEN 1 THEN 'denied' ELSE 'observed' END",
)


def case_facts(s, d):
    """Two facts a turn, a case of every four turns; what a case's first turn doesn't keep stays behind."""
    t = m.turns(s, d)
    slot = lambda n: F.element_at(F.array(F.lit("substrate"), F.lit("location")), (F.length("text") % n % 2 + 1).cast("int"))
    row = lambda nth, by, kind: t.select("conv_id", F.expr("turn div 4").alias("case_id"), "turn", F.lit(nth).alias("nth"), slot(by).alias("slot"), F.concat(F.lit("v"), (F.length("text") % by % 3).cast("string")).alias("value"), F.expr(kind).alias("provenance"), (F.length("text") % 3 != 0).alias("keep"))
    return row(0, 7, FACT_KINDS[0]).unionByName(row(1, 5, FACT_KINDS[1]))


_CASE = lambda nth, by, kind: f"SELECT conv_id, turn // 4 AS case_id, turn, {nth} AS nth, (['substrate', 'location'])[CAST(length(text) % {by} % 2 AS INT) + 1] AS slot, 'v' || CAST(length(text) % {by} % 3 AS VARCHAR) AS value, {kind} AS provenance, length(text) % 3 <> 0 AS keep FROM turns"
CASES = f"f AS (SELECT * FROM ({_CASE(0, 7, FACT_KINDS[0])} UNION ALL {_CASE(1, 5, FACT_KINDS[1])}) WHERE turn % 4 <> 0 OR case_id = 0 OR keep)"
add("k1_merge_cases", lambda s, d: joined(cv.merge_facts(case_facts(s, d))), m.TURNS, CASES, FOLD, KNOWN)
add("k2_case_boundaries", lambda s, d: cv.case_boundaries(m.turns(s, d), "the|und", "not|nicht"), m.TURNS, "SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' AND turn > 0 AND regexp_matches(lower(text), 'the|und') AND NOT regexp_matches(lower(text), 'not|nicht') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS case_id FROM turns")
_slots = lambda s, d: m.turns(s, d).withColumns({"substrate": F.when(F.length("text") % 3 == 0, F.substring("text", 1, 3)), "location": F.when(F.length("text") % 5 == 0, F.col("role"))})
add("k3_carried_slots", lambda s, d: cv.carried_slots(_slots(s, d), ["substrate", "location"]), m.TURNS, "SELECT conv_id, turn, last_value(CASE WHEN length(text) % 3 = 0 THEN left(text, 3) END IGNORE NULLS) OVER w AS substrate, last_value(CASE WHEN length(text) % 5 = 0 THEN role END IGNORE NULLS) OVER w AS location FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
add("k4_transcript", lambda s, d: cv.transcript(m.turns(s, d), 3, 40).select("conv_id", F.array_join("lines", "|").alias("lines")), m.TURNS, "SELECT conv_id, string_agg(role || ': ' || CASE WHEN role = 'assistant' THEN left(text, 40) ELSE text END, '|' ORDER BY turn) AS lines FROM (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) GROUP BY conv_id")
add("k5_sessionize", lambda s, d: cv.sessionize(m.turns(s, d)), m.TURNS, "SELECT conv_id, turn, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY t, turn) - 1 AS BIGINT) AS session FROM (SELECT conv_id, turn, turns.\"at\" AS t, CASE WHEN turns.\"at\" < lag(turns.\"at\") OVER (PARTITION BY conv_id ORDER BY turns.\"at\", turn) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM turns)")
add("k6_active_sessions", lambda s, d: cv.active_sessions(m.turns(s, d).groupBy(F.col("conv_id").alias("session_id")).agg(F.max("at").alias("touched")), 50).select("session_id"), m.TURNS, "SELECT session_id FROM (SELECT conv_id AS session_id, max(turns.\"at\") AS t FROM turns GROUP BY 1) ORDER BY t DESC, session_id LIMIT 50")
_pend = lambda s, d: m.turns(s, d).where("role = 'user'").withColumns({"asks_back": F.length("text") % 2 == 0, "answers": F.length("text") % 3 == 0})
add("k7_resume_pending", lambda s, d: cv.resume_pending(_pend(s, d)), m.TURNS, "SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 AND lag(length(text) % 2 = 0) OVER w THEN lag(text) OVER w END AS resumes FROM turns WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
_simple = lambda s, d: facts(s, d).where("provenance = 'stated'")
_FOLD = "fold AS (SELECT conv_id, slot, max_by(value, turn) AS value, count(*) AS n FROM (SELECT conv_id, turn, (['substrate', 'location'])[CAST(length(text) % 2 AS INT) + 1] AS slot, 'v' || CAST(length(text) % 3 AS VARCHAR) AS value FROM turns WHERE turn % 4 = 0) GROUP BY ALL)"
add("k9_active_facts", lambda s, d: cv.active_facts(cv.merge_facts(_simple(s, d))).select("conv_id", "slot", "value"), m.TURNS, _FOLD, "SELECT conv_id, slot, value FROM fold")
add("k9_unsettled", lambda s, d: cv.unsettled(cv.merge_facts(facts(s, d))), m.TURNS, _F1, FOLD, "SELECT conv_id, case_id, slot FROM folded WHERE status = 'conflicting'")
add("k9_drop_observations", lambda s, d: cv.drop_observations(facts(s, d)).groupBy("provenance").agg(F.count("*").alias("n")), m.TURNS, f"SELECT {_fact} AS provenance, count(*) AS n FROM turns WHERE turn % 4 <> 1 GROUP BY 1")
_askst = lambda s, d: m.turns(s, d).select("conv_id", F.lit("substrate").alias("slot")).distinct()
add("k10_recall_state", lambda s, d: cv.recall_state(_askst(s, d), cv.merge_facts(_simple(s, d)).drop("case_id")), m.TURNS, _FOLD, "SELECT t.conv_id, 'substrate' AS slot, CASE WHEN value IS NULL THEN 'not stated' ELSE 'stated' END AS kind, value FROM (SELECT DISTINCT conv_id FROM turns) t LEFT JOIN fold ON fold.conv_id = t.conv_id AND fold.slot = 'substrate'")

# Observations
_CONF = "CASE WHEN confidence = 'high' THEN 0.8::DOUBLE WHEN CAST(confidence AS INT) <= 1 THEN CAST(confidence AS DOUBLE) ELSE CAST(confidence AS DOUBLE) / 100 END"
_PO = f"""po AS (SELECT obs_id, image, attribute, value, CASE WHEN confidence = 'high' THEN 0.8::DOUBLE ELSE (SELECT CASE WHEN n <= 1 THEN n WHEN n <= 100 THEN n / 100 END FROM (SELECT try_cast(confidence AS DOUBLE) AS n)) END AS confidence, CASE WHEN region[3] > region[1] AND region[4] > region[2] THEN region END AS region FROM observations)"""
_PO = "po AS (SELECT obs_id, image, attribute, value, CASE WHEN confidence = 'high' THEN 0.8::DOUBLE WHEN n <= 1 THEN n ELSE n / 100 END AS confidence, CASE WHEN region[3] > region[1] THEN region END AS region FROM (SELECT *, try_cast(confidence AS DOUBLE) AS n FROM observations))"
_parsed = lambda s, d: ob.parse_observations(m.observations(s, d))
add("l1_parse_observations", lambda s, d: _parsed(s, d).select("obs_id", "attribute", "confidence", F.col("region").isNotNull().alias("placed")), m.OBSERVATIONS, _PO, "SELECT obs_id, attribute, confidence, region IS NOT NULL AS placed FROM po")
add("l2_band", lambda s, d: _parsed(s, d).groupBy(ob.band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n")), m.OBSERVATIONS, _PO, "SELECT CASE WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'UNCERTAIN' ELSE 'NOT_DETERMINABLE' END AS band, count(*) AS n FROM po GROUP BY 1")
_voc = [("substrate", "zero", "0"), ("substrate", "any", "value"), ("location", "one", "1"), ("exposure", "two", "2")]
add("l3_match_value", lambda s, d: ob.match_value(m.observations(s, d), s.createDataFrame(_voc, "attribute string, value string, term string")), m.OBSERVATIONS,
    "SELECT obs_id, CASE WHEN attribute = 'substrate' AND value <> 'value 0' THEN 'any' WHEN attribute = 'location' AND value = 'value 1' THEN 'one' WHEN attribute = 'exposure' AND value = 'value 2' THEN 'two' END AS matched, CASE WHEN attribute = 'substrate' THEN CASE WHEN value = 'value 0' THEN 'several values' END WHEN attribute = 'location' AND value = 'value 1' OR attribute = 'exposure' AND value = 'value 2' THEN NULL ELSE 'no known value' END AS reason FROM observations")
_RS = """st AS (SELECT image, attribute, count(DISTINCT value) AS vs, max((confidence, value)) AS x FROM po WHERE confidence >= 0.8 AND region IS NOT NULL GROUP BY ALL),
wk AS (SELECT image, attribute, max((confidence, value)) AS w FROM po GROUP BY ALL),
rs AS (SELECT image, attribute, CASE WHEN vs > 1 THEN 'conflicting' WHEN vs = 1 THEN 'confirmed' ELSE 'not determinable' END AS status, CASE WHEN vs > 1 THEN NULL WHEN vs = 1 THEN x[2] ELSE w[2] END AS value, coalesce(x[1], w[1]) AS confidence, attribute = 'substrate' AND image IN (SELECT image FROM st WHERE attribute = 'existing_finish') AS withheld FROM wk LEFT JOIN st USING (image, attribute)),
ce AS (SELECT *, CASE WHEN status = 'confirmed' AND NOT withheld THEN 'OBSERVED' WHEN status = 'conflicting' THEN 'UNCERTAIN' WHEN confidence >= 0.65 THEN 'LIKELY' WHEN status = 'not determinable' THEN 'CANNOT_DETERMINE' ELSE 'UNCERTAIN' END AS certainty FROM rs)"""
_res = lambda s, d: ob.certainty(ob.resolve_observations(_parsed(s, d)))
add("l4_resolve_observations", lambda s, d: ob.resolve_observations(_parsed(s, d)), m.OBSERVATIONS, _PO, _RS, "SELECT * FROM rs")
add("l5_certainty", lambda s, d: _res(s, d).select("image", "attribute", "certainty"), m.OBSERVATIONS, _PO, _RS, "SELECT image, attribute, certainty FROM ce")
_forbid = lambda s, d: m.observations(s, d).select("image", F.when(F.col("image") % 2 == 0, "location").otherwise("substrate=value 1|value 2").alias("rule")).distinct()
_safe = lambda s, d: m.observations(s, d).select("image", F.lit("exposure").alias("attribute"), F.lit("value 0").alias("value")).distinct()
add("l6_score_observations", lambda s, d: ob.score_observations(_res(s, d), _forbid(s, d), _safe(s, d)), m.OBSERVATIONS, _PO, _RS,
    "SELECT i.image, count(c.image) FILTER (c.bad AND certainty = 'OBSERVED') AS dangerous_routed, count(c.image) FILTER (c.bad) AS dangerous_reported, count(c.image) FILTER (c.safe) AS safe_hits, 1 - count(c.image) FILTER (c.safe) AS safe_misses FROM (SELECT DISTINCT image FROM observations) i LEFT JOIN (SELECT *, CASE WHEN image % 2 = 0 THEN attribute = 'location' ELSE attribute = 'substrate' AND value IN ('value 1', 'value 2') END AS bad, attribute = 'exposure' AND value = 'value 0' AS safe FROM ce WHERE value IS NOT NULL) c USING (image) GROUP BY i.image")

# Answer reuse
_keyed = lambda s, d: m.questions(s, d).select("qid", j.answer_key(F.col("text"), F.array(F.lit("b"), F.lit("a")), F.lit("s1"), F.create_map(F.lit("z"), F.lit("1"), F.lit("y"), F.lit("2")), F.when(F.length("text") % 2 == 0, "").otherwise("past")).alias("key"))
_K = "ky AS (SELECT qid, sha256(concat_ws(chr(31), lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ')), 'a,b', 's1', 'y=2,z=1', CASE WHEN length(text) % 2 = 0 THEN '' ELSE left(sha256('past'), 16) END)) AS key FROM questions)"
_done = lambda s, d: _keyed(s, d).where("qid like '%1'").select("key", F.col("qid").alias("answer_id"), F.col("qid").alias("used_at"))
add("n1_answer_key", _keyed, m.QUESTIONS, _K, "SELECT * FROM ky")
add("n2_reuse_answers", lambda s, d: j.reuse_answers(_keyed(s, d), _done(s, d)).select("qid", "answer_id", "hit"), m.QUESTIONS, _K, "SELECT qid, (SELECT max(qid) FROM ky x WHERE x.key = ky.key AND qid LIKE '%1') AS answer_id, key IN (SELECT key FROM ky WHERE qid LIKE '%1') AS hit FROM ky")
add("n2_misses", lambda s, d: j.misses(_keyed(s, d), _done(s, d)), m.QUESTIONS, _K, "SELECT DISTINCT key FROM ky WHERE key NOT IN (SELECT key FROM ky WHERE qid LIKE '%1')")
add("n3_evict", lambda s, d: j.evict(_done(s, d), 20).select("answer_id"), m.QUESTIONS, _K, "SELECT qid AS answer_id FROM ky WHERE qid LIKE '%1' ORDER BY qid DESC LIMIT 20")

# Cases
_cap = lambda s, d: j.capture_cases(m.cases(s, d).select(F.when(F.col("case_id") % 10 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("question"))).alias("question"), F.array(F.col("question").cast("binary")).alias("images"), F.array(F.lit("c1")).alias("chunk_ids"), "tags", "at"))
add("o1_capture_cases", lambda s, d: _cap(s, d).select("question", F.element_at("image_hashes", 1).alias("image")), m.CASES, "SELECT question, sha256(question) AS image FROM cases WHERE case_id % 10 <> 0")
_upd = lambda s, d: m.cases(s, d).where("case_id % 4 = 0").select((F.col("case_id") + 0 * F.col("case_id")).alias("case_id"), F.lit("new").alias("expert_diagnosis"), F.lit("adv").alias("advisor_id")).unionByName(m.cases(s, d).select((-F.col("case_id") - 1).alias("case_id"), F.lit("new").alias("expert_diagnosis"), F.lit("adv").alias("advisor_id")))
add("o2_record_diagnosis", lambda s, d: j.record_diagnosis(m.cases(s, d), _upd(s, d))[0].select("case_id", "expert_diagnosis", "advisor_id"), m.CASES, "SELECT case_id, CASE WHEN case_id % 4 = 0 THEN 'new' ELSE expert_diagnosis END AS expert_diagnosis, CASE WHEN case_id % 4 = 0 THEN 'adv' ELSE advisor_id END AS advisor_id FROM cases")
add("o2_unknown_cases", lambda s, d: j.record_diagnosis(m.cases(s, d), _upd(s, d))[1].select("case_id"), m.CASES, "SELECT -case_id - 1 AS case_id FROM cases")
_TAG = lambda k: f"substr(list_filter(tags, lambda t: starts_with(t, '{k}_'))[-1], {len(k) + 2}) AS {k}"
_TAGS = f"tg AS (SELECT case_id, {_TAG('substrate')}, {_TAG('symptom')}, {_TAG('cause')} FROM cases)"
add("o3_case_tags", lambda s, d: j.case_tags(m.cases(s, d)), m.CASES, _TAGS, "SELECT * FROM tg")
add("o4_case_statistics", lambda s, d: j.case_statistics(j.case_tags(m.cases(s, d))), m.CASES, _TAGS, "SELECT 'total' AS kind, NULL AS value, count(*) AS n FROM tg UNION ALL SELECT 'substrate', substrate, count(*) FROM tg WHERE substrate IS NOT NULL GROUP BY 2 UNION ALL SELECT 'symptom', symptom, count(*) FROM tg WHERE symptom IS NOT NULL GROUP BY 2 UNION ALL SELECT 'cause', cause, count(*) FROM tg WHERE cause IS NOT NULL GROUP BY 2")
add("o5_curate", lambda s, d: j.curate(m.cases(s, d)), m.CASES, "SELECT case_id, question, expert_diagnosis, coalesce(confidence_level, 'medium') AS confidence_level, coalesce(advisor_id, 'unknown') AS advisor_id FROM cases WHERE trim(expert_diagnosis, ' ') <> ''")

# Evaluation
KEYS = [("path_in", ["compose", "extract"]), ("refused", ["true"]), ("contains_all", ["the", "of"]), ("contains_any", ["und", "the"]), ("absent", ["nicht"]), ("must_not_match", ["^the"]), ("must_cite", []), ("source_contains", ["doc://1"]), ("min_documents", ["2"]), ("slots_include", ["a=1"]), ("slots_exclude", ["b"]), ("odd", [])]


def _results(s, d):
    q = m.questions(s, d)
    n = F.length("text")
    return q.select(F.col("qid").alias("case_id"), F.concat("text", F.when(n % 2 == 0, " [1]").otherwise("")).alias("answer"), m.pick(m.PATHS, n % 8).alias("path"), (n % 9).cast("string").alias("step"), (n % 8 == 5).alias("refused"), F.when(n % 3 == 0, F.array(F.lit("doc://12"), F.lit("doc://3"))).otherwise(F.array(F.lit("doc://3"))).alias("sources"), F.create_map(F.lit("a"), (n % 2).cast("string")).alias("slots")).where("case_id not like '%9'")


def _expect(s, d):
    e = s.createDataFrame(KEYS, "key string, wanted array<string>")
    return m.questions(s, d).select(F.col("qid").alias("case_id")).crossJoin(F.broadcast(e))


_P = f"""rs AS (SELECT qid AS case_id, lower(text || CASE WHEN length(text) % 2 = 0 THEN ' [1]' ELSE '' END) AS low, {m._sql_pick(m.PATHS, 'length(text) % 8')} AS path, length(text) AS n FROM questions WHERE qid NOT LIKE '%9'),
ex AS (SELECT qid AS case_id, key FROM questions, (VALUES {', '.join(f"('{k}')" for k, _ in KEYS)}) v(key))"""
add("p1_check_expectations", lambda s, d: j.check_expectations(_results(s, d), _expect(s, d)), m.QUESTIONS, _P,
    """SELECT case_id, key, coalesce(CASE key WHEN 'path_in' THEN path IN ('compose', 'extract') WHEN 'refused' THEN n % 8 = 5 WHEN 'contains_all' THEN contains(low, 'the') AND contains(low, 'of') WHEN 'contains_any' THEN contains(low, 'und') OR contains(low, 'the')
    WHEN 'absent' THEN NOT contains(low, 'nicht') WHEN 'must_not_match' THEN NOT starts_with(low, 'the') WHEN 'must_cite' THEN regexp_matches(low, '\\[[0-9]+\\]') WHEN 'source_contains' THEN n % 3 = 0 WHEN 'min_documents' THEN n % 3 = 0 WHEN 'slots_include' THEN n % 2 = 1 WHEN 'slots_exclude' THEN true ELSE false END AND low IS NOT NULL, false) AS passed
    FROM ex LEFT JOIN rs USING (case_id)""")  # fmt: skip


def _probes(s, d):
    n = F.length("text")
    return m.questions(s, d).select(F.col("qid").alias("probe_id"), F.array(F.lit("Nicht")).alias("banned"), F.when(n % 2 == 0, F.array(F.lit("the"))).otherwise(F.array().cast("array<string>")).alias("wanted_any"), F.when(n % 3 == 0, "doc://1").otherwise("").alias("restricted"), (n % 11 == 0).alias("must_refuse"))


add("p2_check_probes", lambda s, d: j.check_probes(_results(s, d).withColumn("answer", F.concat("answer", F.when(F.col("step") == "4", F.lit(" call 01234 567 890")).otherwise(F.lit("")))).withColumnRenamed("case_id", "probe_id"), _probes(s, d), ["0999999999"]), m.QUESTIONS, _P,
    """SELECT qid AS probe_id, CASE WHEN low IS NULL THEN 'no result' WHEN contains(low, 'nicht') THEN 'banned text' WHEN length(text) % 11 = 0 AND length(text) % 8 <> 5 THEN 'not refused' WHEN length(text) % 2 = 0 AND NOT contains(low, 'the') THEN 'nothing wanted' WHEN length(text) % 3 = 0 THEN 'restricted source' WHEN length(text) % 9 = 4 THEN 'unknown phone number' END AS fault FROM questions LEFT JOIN rs ON case_id = qid""")  # fmt: skip
add("p3_audience_leak", lambda s, d: j.audience_leak(_hits(s, d), m.passages(s, d).where("audience != 'public' or document_type = 'commercial'")).select("qid", "passage_id"), *_H, "SELECT qid, passage_id FROM hits WHERE audience <> 'public' OR document_type = 'commercial'")
_gold = lambda s, d: s.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("case_id"), F.when(F.col("quality") == 1, "answer").otherwise("abstain").alias("expected"), (F.col("doc_id") % 3 != 0).alias("answered"), (F.col("doc_id") % 5 != 0).alias("supported"))
_G = "gd AS (SELECT CASE WHEN quality = 1 THEN 'answer' ELSE 'abstain' END AS expected, doc_id % 3 <> 0 AS answered, doc_id % 5 <> 0 AS supported FROM labels)"
add("p4_gold_metrics", lambda s, d: j.gold_metrics(_gold(s, d)), _G, "SELECT expected, count(*) AS total, count(*) FILTER (CASE WHEN expected = 'answer' THEN answered AND supported ELSE NOT answered END) AS passed, count(*) FILTER (expected = 'answer' AND NOT answered) AS over_refusals, count(*) FILTER (answered AND NOT supported) AS unsupported FROM gd GROUP BY expected")
_TH = [0.2, 0.3, 0.35, 0.45]
_top = lambda s, d: r.abstain(m.queries(s, d), _hits(s, d))
add("p5_threshold_sweep", lambda s, d: j.threshold_sweep(_top(s, d).select(F.col("top_score").alias("score"), (F.col("qid") % 2 == 0).alias("answerable")), _TH), *_H, "tp AS (SELECT qid, max(score) AS score FROM hits GROUP BY qid)",
    f"SELECT t AS threshold, count(*) FILTER (score >= t) AS answered, count(*) FILTER (score < t) AS refused, count(*) FILTER (qid % 2 = 0 AND score < t) AS wrongly_refused, count(*) FILTER (qid % 2 <> 0 AND score >= t) AS wrongly_admitted FROM tp, (VALUES {', '.join(f'({x}::DOUBLE)' for x in _TH)}) v(t) GROUP BY t")
add("p6_wide_evidence", lambda s, d: r.topk(m.queries(s, d), m.passages(s, d), 20, 20).groupBy("qid").agg(F.sum(F.length("content")).alias("chars"), F.count("*").alias("n")), m.PASSAGES, m.QUERIES, SCORED, "SELECT qid, CAST(sum(length(content)) AS BIGINT) AS chars, count(*) AS n FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY qid ORDER BY effective DESC, source_date DESC NULLS LAST, canonical_url, chunk_index) <= 20) GROUP BY qid")
_dec = lambda s, d: m.queries(s, d).select("qid", m.pick(m.PATHS, F.col("qid") % 8).alias("path"), (F.col("qid") % 3 == 0).alias("met"))
add("p7_evidence_coverage", lambda s, d: j.evidence_coverage(_dec(s, d).select("qid", "path"), _dec(s, d).select("qid", "met")), m.QUERIES, f"SELECT {m._sql_pick(m.PATHS, 'qid % 8')} AS path, count(*) AS n, round(avg(CASE WHEN qid % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS covered FROM queries GROUP BY 1")
add("p7_near_misses", lambda s, d: j.near_misses(_top(s, d), _dec(s, d).select("qid", "met"), 0.3), *_H, "SELECT qid, max(score) AS top_score FROM hits WHERE qid % 3 <> 0 GROUP BY qid HAVING max(score) >= 0.3")
add("p8_readiness", lambda s, d: j.readiness(m.passages(s, d).agg(F.max(F.size("embedding")).alias("embedding_dimensions")).select(F.lit(True).alias("is_active"), "embedding_dimensions", F.lit("2").alias("chunking_version")), m.passages(s, d), 64, "3"), "SELECT true AS active_snapshot, true AS dimensions_match, false AS chunking_match, true AS live_chunks, false AS ready")
