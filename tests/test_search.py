"""Bounded search against a plain ranking of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeline.operators import retrieval, search

PASSAGE = "passage_id long, canonical_url string, chunk_index long, product string, authority long, document_type string, audience string, source_date date, section string, content string, embedding array<float>"
QUERY = "qid long, embedding array<float>, audiences array<string>, product string"


def tables(spark, seed, many=160, hot=False):
    import datetime

    rnd = random.Random(seed)
    vec = lambda: [float(rnd.randint(-3, 3)) for _ in range(3)]  # noqa: E731  small integers: many ties
    p = []
    for i in range(many):
        url = "hot" if hot and rnd.random() < 0.5 else f"d{rnd.randint(0, 11)}"
        p.append((i, url, i, rnd.choice(["p1", "P1 plus", "q", "", None]), rnd.choice([None, *range(0, 8)]), "guide", rnd.choice(["public", "staff", None]), rnd.choice([None, datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)]), "s", f"c{i}", rnd.choice([vec(), vec(), vec(), None, [1.0]])))
    q = [(i, rnd.choice([vec(), vec(), [0.0, 0.0, 0.0]]), rnd.choice([["public"], ["public", "staff"], [], None]), rnd.choice(["p1", "", None])) for i in range(14)]
    return p, q


def plain(p, q, k, cap):
    """(qid, rank): (passage, score) by measuring all pairs."""
    out = {}
    unit = lambda v: [0.0] * 3 if v is None or len(v) != 3 or not any(v) else [x / sum(y * y for y in v) ** 0.5 for x in v]
    for qid, qv, audiences, product in q:
        rows = []
        for r in p:
            if r[6] is None or r[6] not in (audiences or []):
                continue
            score = round(sum(a * b for a, b in zip(unit(qv), unit(r[10]))), 6)
            a, b = (product or "").lower(), (r[3] or "").lower()
            boost = 0.15 if a and b and (a in b or b in a) else 0.0
            authority = max(1, min(6, 6 if r[4] is None else r[4]))
            rows.append((-round(score + boost + (6 - authority) * 0.02 / 6, 6), -(r[7].toordinal() if r[7] else 0), r[1], r[2], r[0], score))
        seen, rank = {}, 0
        for row in sorted(rows):
            seen[row[2]] = seen.get(row[2], 0) + 1
            if seen[row[2]] <= cap and rank < k:
                rank += 1
                out[qid, rank] = (row[4], row[5])
    return out


@pytest.mark.parametrize(("seed", "k", "cap", "hot"), [(1, 5, 3, False), (2, 5, 1, True), (3, 20, 20, True), (4, 3, 2, True)])
def test_bounded_search_equals_ranking_all_pairs(spark, monkeypatch, seed, k, cap, hot):
    p, q = tables(spark, seed, hot=hot)
    monkeypatch.setattr(search, "PRODUCTS", 200)  # many small batches
    got = retrieval.best(spark.createDataFrame(q, QUERY), spark.createDataFrame(p, PASSAGE).repartition(3), k, cap).collect()
    assert {(r.qid, r["rank"]): (r.passage_id, r.score) for r in got} == plain(p, q, k, cap)


def test_requests_in_blocks_and_empty_tables(spark):
    p, q = tables(spark, 5)
    passages, queries = spark.createDataFrame(p, PASSAGE), spark.createDataFrame(q, QUERY)
    rows = retrieval.ranked(retrieval.per_document_cap(search.bounded(queries, passages, 5, 3, 0.15, 0.02, block=3), 3), 5)
    assert {(r.qid, r["rank"]): (r.passage_id, r.score) for r in rows.collect()} == plain(p, q, 5, 3)
    assert retrieval.best(queries.limit(0), passages).count() == 0 and retrieval.best(queries, passages.limit(0)).count() == 0
    assert retrieval.topk(queries, passages).columns.count("content") == 1


def test_no_pairs_are_shuffled(spark):
    p, q = tables(spark, 6)
    df = retrieval.best(spark.createDataFrame(q, QUERY), spark.createDataFrame(p, PASSAGE))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    rows = search.bounded(spark.createDataFrame(q, QUERY), spark.createDataFrame(p, PASSAGE).coalesce(1), 5, 3, 0.15, 0.02)
    assert rows.groupBy("qid").count().agg(F.max("count")).first()[0] <= 5


@pytest.mark.parametrize("block", [4, 20_000])
def test_documents_by_words_in_common_equal_counting_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(search, "PRODUCTS", 60)
    rnd = random.Random(8)
    pick = lambda k: ["the", *{f"w{rnd.randint(0, 30)}" for _ in range(rnd.randint(0, k))}]  # noqa: E731  a word in every text
    docs = [(f"d{i}", rnd.randint(1, 3), pick(12)) for i in range(90)] + [("none", 1, None), ("empty", 1, [])]
    asks = [(i, pick(6)) for i in range(9)] + [(98, []), (99, ["nowhere"])]
    got = search.overlapping(spark.createDataFrame(asks, "qid long, words array<string>"), spark.createDataFrame(docs, "canonical_url string, authority long, words array<string>").repartition(3), 4, block)
    best = {}
    for r in sorted(got.collect(), key=lambda r: (r.qid, -r.overlap, r.authority, r.canonical_url)):
        best.setdefault(r.qid, []).append((-r.overlap, r.authority, r.canonical_url))
    want = {q: sorted((-len(set(w) & set(d)), a, u) for u, a, d in docs if d and set(w) & set(d))[:4] for q, w in asks}
    assert {q: b[:4] for q, b in best.items()} == {q: w for q, w in want.items() if w}
    assert got.groupBy("qid").count().agg(F.max("count")).first()[0] <= 4 * 3


@pytest.mark.parametrize(("seed", "cap", "large"), [(11, 1, 4_000), (12, 2, 4_000), (13, 3, 7), (14, 200, 7)])
def test_best_of_each_document_equals_ranking_all_pairs(spark, monkeypatch, seed, cap, large):
    p, q = tables(spark, seed, hot=True)
    monkeypatch.setattr(search, "LARGE", large)  # with 7, documents are cut into pieces
    got = retrieval.best_of_documents(spark.createDataFrame(q, QUERY), spark.createDataFrame(p, PASSAGE).repartition(3), cap)
    assert {"authority", "source_date", "q_product", "effective"} < set(got.columns)
    assert sorted((r.qid, r.passage_id, r.score) for r in got.collect()) == sorted((qid, *x) for (qid, _), x in plain(p, q, 10**6, cap).items())


def test_best_of_each_document_shuffles_no_pairs(spark):
    """Pairs are many times the passages, so none may be dealt again."""
    p, q = tables(spark, 15)
    df = retrieval.best_of_documents(spark.createDataFrame(q, QUERY), spark.createDataFrame(p, PASSAGE), 1, ["canonical_url", "passage_id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and plan.index("MapInArrow") < plan.index("Exchange")
    assert df.columns == ["passage_id", "canonical_url", "qid", "q_product", "score", "effective"]


def test_equal_scores_leave_few_candidates():
    """All passages alike: a part gives k a request, and later ones none."""
    doc = np.arange(400) // 3
    least, none = np.full(50, -np.inf), lambda of: np.full(len(of), 400)
    r, j = search._candidates(np.zeros((50, 400)), least, none, doc, 5, 2)
    assert sorted(zip(r.tolist(), j.tolist())) == [(i, x) for i in range(50) for x in (0, 1, 3, 4, 6)]
    r, j = search._candidates(np.zeros((50, 400)), np.zeros(50), lambda of: np.zeros(len(of), np.int64), doc, 5, 2)
    assert len(r) == 0
    r, j = search._candidates(np.zeros((2, 400)), least[:2], none, np.zeros(400, np.int64), 5, 2)  # one document
    assert {(0, 0), (0, 1), (1, 0), (1, 1)} <= set(zip(r.tolist(), j.tolist()))


@pytest.mark.parametrize(("seed", "k", "cap"), [(21, 3, 3), (22, 5, 2), (23, 4, 1)])
def test_equal_scores_are_told_apart_by_date_url_and_chunk(spark, seed, k, cap):
    p, q = tables(spark, seed, many=900, hot=True)
    p = [(*r[:3], "", 6, *r[5:]) for r in p]
    q = [(r[0], [0.0], *r[2:]) for r in q]
    got = retrieval.best(spark.createDataFrame(q, QUERY), spark.createDataFrame(p, PASSAGE).repartition(2), k, cap).collect()
    assert {(r.qid, r["rank"]): (r.passage_id, r.score) for r in got} == plain(p, [(a, [0.0] * 3, *b) for a, _, *b in q], k, cap)
