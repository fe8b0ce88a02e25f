"""Regions of the similarity join: rows grow with the documents of a family, not with its pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeline.llm import jaccard_join
from tomeline.llm.sketch import SKETCH


def family(rng, m, words=60):
    base, out = [f"w{i}" for i in range(words)], []
    for _ in range(m):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_rows_of_a_family_grow_with_its_documents(spark):
    rows = []
    for m in (150, 300):
        docs = spark.createDataFrame(list(enumerate(family(random.Random(3), m))), "doc_id long, text string")
        sets = docs.mapInArrow(jaccard_join._sets(4), "doc_id long, n long, a long, b long, key long, block long, counts binary").where("block is null")
        least = sets.groupBy("n", "key").agg(F.min("doc_id").alias("rep"))
        counts = spark.sparkContext.broadcast(np.zeros(SKETCH, np.int64))
        rows.append(jaccard_join._regions(docs, least, counts, 4, 85, 2048, 20_000).count())
    assert 0 < rows[1] < 3 * rows[0] and rows[1] < 300 * 30  # of 44,850 pairs


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_links_within_a_region_connect_what_is_linked(percent):
    rng = np.random.default_rng(percent)
    for _ in range(30):
        base = rng.integers(0, 2**63, (3, 40), dtype=np.uint64)
        sets = [np.unique(np.where(rng.random(40) < rng.choice([0, 0.04, 0.2]), rng.integers(0, 2**63, 40, dtype=np.uint64), base[rng.integers(3)])) for _ in range(40)]
        doc, size = rng.permutation(1000)[:40], np.array([len(x) for x in sets])
        u, v = jaccard_join._joined(doc, np.concatenate(sets), size, percent)
        name = {d: d for d in doc.tolist()}
        for x, y in zip(u.tolist(), v.tolist()):
            name = {d: name[x] if c == name[y] else c for d, c in name.items()}
        want = {d: d for d in doc.tolist()}
        for i in range(40):
            for j in range(i):
                same = len(np.intersect1d(sets[i], sets[j]))
                if 100 * same >= percent * (size[i] + size[j] - same):
                    want = {d: want[doc[i]] if c == want[doc[j]] else c for d, c in want.items()}
        groups = lambda n: {frozenset(d for d in n if n[d] == c) for c in n.values()}
        assert groups(name) == groups(want)
        assert len(u) == 40 - len(groups(want))


def test_rows_that_repeat_a_doc_id_in_a_split_region(spark):
    """Equally many differences from the pivot: the other text of the hub's document counts, too."""
    t = family(random.Random(5), 30)
    w = [f"w{i}" for i in range(60)]
    other = ["x"] * 12 + [f"y{i}" for i in range(48)]
    rows = [(i, x) for i, x in enumerate(t)] + [(7, " ".join(other)), (50, " ".join([*other[:-1], "z"])), (60, " ".join(w))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for leaf in (2, 2048):
        got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicate_classes(d, leaf=leaf).collect()}
        assert got[50] == got[7]


def test_documents_that_differ_alike_are_not_split_again_and_again(spark, monkeypatch):
    """They meet in the cells of the same differences at every round; regions that don't halve go by blocks."""
    rng, base, texts = random.Random(9), [f"w{i}" for i in range(60)], []
    for _ in range(90):
        w = list(base)
        for at in range(3, 60, 6):
            w[at] = rng.choice([w[at], f"e{at}"])
        texts.append(" ".join(w))
    shingles = [{tuple(t.split()[i : i + 4]) for i in range(57)} for t in texts]
    name = list(range(90))
    for i in range(90):
        for j in range(i):
            if 100 * len(shingles[i] & shingles[j]) >= 85 * len(shingles[i] | shingles[j]):
                name = [min(name[i], name[j]) if c in (name[i], name[j]) else c for c in name]
    dealt, deal = [], jaccard_join._deal
    monkeypatch.setattr(jaccard_join, "_deal", lambda *a: dealt.append(deal(*a)) or dealt[-1])
    got = jaccard_join.near_duplicate_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), leaf=8)
    assert [r.component_id for r in got.orderBy("doc_id").collect()] == name
    large = [df.where("large").count() for df in dealt]
    assert large[0] > 0 and all(2 * b <= a for a, b in zip(large, large[1:-1]))
