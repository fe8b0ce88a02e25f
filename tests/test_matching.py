"""Dictionary matcher against regular expressions, substrings against contains, relations by their rules."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tomeline.functions import text
from tomeline.operators import labelling, matching, relations, retrieval, verification
from tomeline.plans.answers import relation_sql

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def plain(text, term):
    return f" {' '.join(WORD.findall(text.lower()))} ".count(f" {term} ") if text else 0


@pytest.mark.parametrize("shard", [3, 200_000])
def test_occurrences_equal_whole_word_search(spark, shard):
    rnd = random.Random(1)
    w = ["red", "Blue", "a", "wall", "x1", "größe"]
    terms = sorted({" ".join(rnd.choice(w) for _ in range(rnd.randint(1, 3))) for _ in range(40)}) + ["Red-wall", "", "..", None]
    texts = [(i, rnd.choice([" ", ", ", "-"]).join(rnd.choice(w) for _ in range(rnd.randint(0, 14)))) for i in range(60)] + [(98, None), (99, "")]
    found = matching.occurrences(spark.createDataFrame(texts, "qid long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), before=2, shard=shard)
    got = {}
    for r in found.collect():
        got[r.qid, r.term] = got.get((r.qid, r.term), 0) + 1
        tokens = WORD.findall(dict(texts)[r.qid].lower())
        assert tokens[r.at : r.at + r.n] == r.term.split(" ") and list(r.before) == tokens[max(0, r.at - 2) : r.at]
    plain_terms = {" ".join(WORD.findall(t.lower())) for t in terms if t} - {""}
    want = {}
    for q, text in texts:
        tokens = WORD.findall((text or "").lower())
        for t in plain_terms:
            n = sum(tokens[i : i + t.count(" ") + 1] == t.split(" ") for i in range(len(tokens)))
            if n:
                want[q, t] = n
    assert got == want


def test_a_hundred_thousand_terms_are_read_once_a_text(spark):
    terms = spark.range(100_000).selectExpr("concat('term', id, CASE WHEN id % 2 = 0 THEN ' of kind' ELSE '' END) AS term")
    texts = spark.createDataFrame([(1, "Term17 stands here, Term18 of kind too, term18 alone doesn't"), (2, "term99999 term100000")], "qid long, text string")
    got = {(r.qid, r.term, r.at) for r in matching.occurrences(texts, terms).collect()}
    assert got == {(1, "term17", 0), (1, "term18 of kind", 3), (2, "term99999", 0)}


def test_longest_occurrences_and_mentions(spark):
    aliases = spark.createDataFrame([("duo", "Acme Duo"), ("duo plus", "Acme Duo Plus"), ("plus", "Acme Plus")], "alias string, product string")
    texts = spark.createDataFrame([(1, "Duo plus, please"), (2, "duo and then plus"), (3, "Duo plus or duo"), (4, None)], "qid long, text string")
    got = {(r.qid, r["product"]) for r in labelling.mentions(texts, aliases).collect()}
    assert got == {(1, "Acme Duo Plus"), (2, "Acme Duo"), (2, "Acme Plus"), (3, "Acme Duo Plus"), (3, "Acme Duo")}


def test_same_product_is_stricter_than_containment(spark):
    rows = [("Acme Duo", "duo", True), ("Duo", "Acme Duo Fine", True), ("Duo", "Duofix", False), ("Duo Primer", "Duo", False), ("Duo primer", "Acme Duo Primer Fine", True), ("", "duo", False), (None, "duo", False), ("ultra duo", "duo", False)]
    df = spark.createDataFrame(rows, "a string, b string, same boolean")
    assert df.where(text.same_product(F.col("a"), F.col("b"), "acme") != F.col("same")).count() == 0


def test_substrings_equal_contains(spark):
    rnd = random.Random(3)
    make = lambda k: "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, k)))
    texts, terms = [(i, make(40)) for i in range(50)] + [(99, None)], [make(5) for _ in range(30)] + ["", None]
    for shard in (4, 100):
        found = matching.containing(spark.createDataFrame(texts, "id long, body string"), "body", spark.createDataFrame([(t,) for t in terms], "t string"), shard)
        rows = [(r.id, r.term) for r in found.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == {(i, t) for i, x in texts for t in terms if x and t and t in x}


def test_lexical_lookup_joins_no_texts_with_requests(spark):
    p = [(i, f"d{i}", i, ["p1", "q"][i % 2], i % 6 + 1, "public", None, "s", ["cover two", "MIX it", "none"][i % 3], [1.0]) for i in range(40)]
    passages = spark.createDataFrame(p, "passage_id long, canonical_url string, chunk_index long, product string, authority long, audience string, source_date date, section string, content string, embedding array<float>")
    q = spark.createDataFrame([(1, ["public"], "", ["Cover", "mix"]), (2, ["public"], "P1", ["mix"]), (3, ["staff"], "", ["mix"]), (4, ["public"], "", []), (5, ["public"], "", ["", "zz"])], "qid long, audiences array<string>, product string, terms array<string>")
    got = {}
    hits = retrieval.find_passages(q, passages, 3)
    for r in hits.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.passage_id)
    order = lambda rows: [x[0] for x in sorted(rows, key=lambda x: (x[4], x[1], x[2]))[:3]]
    assert got == {1: order([x for x in p if x[8] != "none"]), 2: order([x for x in p if x[8] == "MIX it" and x[3] == "p1"])}
    assert "NestedLoopJoin" not in hits._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("said", "known", "holds"),
    [
        ("Use duo over solo [1].", "Use duo over solo.", True),
        ("Use duo over solo [1].", "Use solo over duo.", False),
        ("Use duo over solo.", "Solo under duo.", True),  # the same layer and base
        ("Use duo over solo.", "Never use duo over solo.", False),
        ("Use duo over solo.", "You might use duo over solo.", False),
        ("Use duo over cured solo.", "Use duo over solo.", False),
        ("Use duo over cured solo.", "Use duo over cured solo.", True),
        ("Use duo over solo.", "Use duo over solo only if primed.", False),
        ("Use duo over solo only if primed.", "Use duo over solo only if  primed.", True),
        ("Use duo over solo; do not rush.", "Use duo over solo.", False),
        ("Duo is compatible with solo.", "Solo is compatible with duo.", True),
        ("Duo is compatible with solo.", "Duo is incompatible with solo.", False),
        ("Use duo over solo but never alone.", "Use duo over solo but never alone.", True),
    ],
)
def test_each_rule_of_relations(spark, said, known, holds):
    c = spark.createDataFrame([(1, 0, said, known)], "aid long, seq long, sentence string, cited string")
    assert (verification.check_relations(c, ["duo", "solo"]).count() == 0) is holds


def test_relations_of_a_chain_and_by_clause(spark):
    s = [(1, "Put duo over solo over trio."), (2, "Solo may be finished with duo, but never use trio on solo."), (3, "Duo with duo.")]
    got = {(r.id, r.kind, r.layer, r.base, r.negated) for r in relations.relations(spark.createDataFrame(s, "id long, s string"), ["duo", "solo", "trio"]).collect()}
    assert got == {(1, "layer", "duo", "solo", False), (1, "layer", "solo", "trio", False), (2, "layer", "duo", "solo", False), (2, "layer", "trio", "solo", True)}


def test_unestablished_requested_and_limited(spark):
    c = spark.createDataFrame([(1, 0, "Duo, solo and more are finished here [1].", "Nothing."), (2, 0, "Duo, solo are coated so.", "Yes: duo, solo are coated so.")], "aid long, seq long, sentence string, cited string")
    assert [r.aid for r in verification.check_unestablished(c, ["duo", "solo"]).collect()] == [1]
    a = spark.createDataFrame([(1, "Can I use duo over solo?"), (2, "Is duo fine?")], "aid long, question string")
    said = spark.createDataFrame([(1, 0, "Use solo over duo."), (2, 0, "Yes.")], "aid long, seq long, sentence string")
    assert [r.note for r in verification.check_requested_relations(a, said, ["duo", "solo"]).collect()] == ["duo layer solo"]
    n = [(1, "Duo takes 5 mm.", "Duo takes up to 5 mm."), (2, "Duo takes up to 5 mm.", "Duo takes up to 5 mm."), (3, "Duo takes 5 mm.", "Duo takes 5 mm if dry."), (4, "Duo takes 5 mm.", "Solo takes 5 mm.")]
    lost = verification.check_numeric_limits(spark.createDataFrame([(i, 0, s, k) for i, s, k in n], "aid long, seq long, sentence string, cited string"), ["duo", "solo"])
    assert sorted(r.aid for r in lost.collect()) == [1, 3]


@pytest.mark.parametrize("said", ["solo over duoüß", "üsolo over duo", "solo over duo énot", "solo over duo when dry it is not so", "solo over duo onceü not", "solo over duo"])
def test_relations_have_the_word_borders_of_sql(spark, said):
    """SQL's border of a word and end of a line know ASCII only."""
    want = duckdb.sql(f"WITH t AS (SELECT 1 AS id, '{said}' AS s), {relation_sql('rel', 't', ['duo', 'solo'])} SELECT id, kind, layer, base, negated, uncertain, states, limits FROM rel").fetchall()
    got = relations.relations(spark.createDataFrame([(1, said)], "id int, s string"), ["duo", "solo"]).select("id", "kind", "layer", "base", "negated", "uncertain", "states", "limits")
    assert [tuple(r) for r in got.collect()] == want != []


def test_claim_beside_a_letter_beyond_ascii_is_checked(spark):
    """Such a relation was in neither the claim nor what it cites."""
    c = spark.createDataFrame([(1, 0, "Solo over duoü.", "Duo over solo."), (2, 0, "Solo over duo.", "Éduo, and solo over duoü.")], "aid long, seq long, sentence string, cited string")
    assert [(r.aid, r.note) for r in verification.check_relations(c, ["duo", "solo"]).collect()] == [(1, "solo layer duo")]
