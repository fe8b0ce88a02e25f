"""Suffix deduplication, centroid clustering and periodic runs against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tomeline.llm import centroids, periodic_runs, suffix_dedup
from tomeline.llm.vectext import words

DOC = "doc_id long, text string"
sha = lambda b: hashlib.sha256(b).hexdigest()


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


# Suffix deduplication


def without_repeats(docs, window):
    texts = {i: (t or "").encode() for i, t in docs}
    n = Counter(x[i : i + window] for x in texts.values() for i in range(len(x) - window + 1))
    out = {}
    for d, x in texts.items():
        gone = np.zeros(len(x) + 2, bool)
        for i in range(len(x) - window + 1):
            if n[x[i : i + window]] > 1:
                gone[i + 1 : i + 1 + window] = True
        out[d] = (len(x), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), sha(bytes(v for v, g in zip(x, gone[1:]) if not g)))
    return out


def suffix_rows(df, *args):
    out = suffix_dedup.remove_repeated_bytes(df, *args)
    return {r[0]: tuple(r[1:]) for r in out.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()}


def some_texts(rnd, n=50):
    letters = lambda k, m: "".join(rnd.choice("abcdefgh"[:k]) for _ in range(rnd.randint(0, m)))
    base = [letters(3, 250) for _ in range(8)]
    out = []
    for i in range(n):
        x, y = rnd.choice(base), rnd.choice(base)
        c, d = rnd.randint(0, len(x)), rnd.randint(0, len(y))
        out.append((i, rnd.choice([x, x[c:] + "é" + y[:d], x[c:] + x[c:], "a" * rnd.randint(0, 90), None, "", letters(8, 200)])))
    return out


@pytest.mark.parametrize(("seed", "frequent"), [(1, 5_000), (2, 5_000), (3, -(10**9)), (4, -(10**9))])
def test_repeated_bytes_equal_brute_force(spark, seed, frequent):
    """frequent below zero: every anchor is dealt by its whole suffix."""
    docs = some_texts(random.Random(seed))
    assert suffix_rows(spark.createDataFrame(docs, DOC), 20, 6, frequent, 7) == without_repeats(docs, 20)


def test_op11_equals_brute_force(spark, sf):
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.op11_suffix_dedup(spark, sf).collect()}
    assert got == without_repeats(documents(spark, sf), 200)


def test_runs_are_merged_in_order_with_their_prefixes():
    rnd = random.Random(5)
    for _ in range(200):
        runs, every = [], []
        for r in range(rnd.randint(0, 9)):
            own = {}
            for _ in range(rnd.randint(0, 12)):
                own.setdefault((bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 6))), rnd.randint(0, 2), rnd.randint(1, 2), False), []).append((r, 1))
            entries = [(*k, own[k]) for k in sorted(own)]
            every += entries
            runs.append(suffix_dedup.decoded(suffix_dedup.coded(entries)))
        out = list(suffix_dedup.merged(runs))
        assert [e for _, e, _, _ in out] == sorted(e[:3] for e in every)
        before = b""
        for p, entry, _, _ in out:
            n = 0
            while n < min(len(before), len(entry[0])) and before[n] == entry[0][n]:
                n += 1
            assert p == n
            before = entry[0]


def test_texts_in_pieces_have_the_same_windows(monkeypatch):
    data = np.frombuffer(b"abcabd" * 60, np.uint8)
    offsets = np.array([0, 100, 100, 360])

    def anchors():
        return {w: (row, at) for rows, ats, first, last, _ in suffix_dedup.anchor_runs(data, offsets, 20, 6) for row, at, a, b in zip(rows, ats, first, last) for w in range(a, b + 1)}

    whole = anchors()
    assert set(whole) == {*range(0, 81), *range(100, 341)}
    monkeypatch.setattr(suffix_dedup, "PIECE", 37)
    assert anchors() == whole


def test_odd_documents_keep_what_they_have(spark):
    rnd = random.Random(1)
    long = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300_000))
    docs = [(1, None), (2, ""), (3, "x" * 199), (None, "y" * 500), (4, "z" * 500), (4, "z" * 500), (5, long), (6, "q" + long)]
    df = spark.createDataFrame(docs, DOC).selectExpr("doc_id", "text", "'s' AS runs", "1 AS start", "2 AS kept")
    got = {(r.doc_id, r.n_bytes): (r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeated_bytes(df).collect()}
    assert got[1, 0] == got[2, 0] == (0, 0, b"") and got[3, 199] == (0, 0, b"x" * 199)
    assert got[None, 500] == (0, 0, b"y" * 500)  # compared with none, itself included
    assert got[4, 500] == (500, 1, b"")  # its windows start at several places
    assert got[5, 300_000] == (300_000, 1, b"") and got[6, 300_001] == (300_000, 1, b"q")
    alone = spark.createDataFrame([(7, long), (7, long)], DOC)  # one document, given twice
    assert {r.n_removed for r in suffix_dedup.remove_repeated_bytes(alone).collect()} == {0}
    assert suffix_dedup.remove_repeated_bytes(df.limit(0)).count() == 0


# Centroid clustering


@pytest.mark.parametrize("table", ["sf0.001", "sf0.1"])
def test_op12_equals_sql_that_measures_every_centroid(spark, table):
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '/root/testdata/{table}/embeddings.parquet'")
    got = sorted(map(tuple, centroids.op12_centroid_clustering(spark, f"/root/testdata/{table}").collect()))
    assert got == sorted(c.sql(centroids.OP12_SQL).fetchall())


def plain_clusters(vectors, k, rounds):
    """vectors: (vec_id, list of integers)."""
    start = sorted(vectors, key=lambda v: (v[0] is None, hashlib.sha256(f"2:{v[0]}".encode()).hexdigest(), v[1]))[:k]
    c = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), i) for i, x in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in vectors]
        for i in range(len(c)):
            own = [v for (_, v), n in zip(vectors, of) if n == i]
            if own:
                c[i] = [sum(x) // len(own) for x in zip(*own)]
    return Counter((i, near(v)[1], near(v)[0]) for i, v in vectors), c


@pytest.mark.parametrize(("seed", "k", "leading"), [(1, 7, 2), (2, 12, 3), (3, 50, 1)])
def test_clusters_equal_measuring_everything(spark, seed, k, leading):
    rnd = random.Random(seed)  # few values: many ties and repeated vectors, also repeated and null ids
    rows = [(rnd.choice([i, i, 3, None]), [rnd.choice([-1.0, 0.0, 0.5, 1.3]) for _ in range(4)]) for i in range(40)]
    bad = [(100, None), (101, [1.0, 2.0]), (102, [1.0, None, 2.0, 3.0]), (103, [1.0, float("nan"), 2.0, 3.0]), (104, [float("inf"), 1.0, 1.0, 1.0]), (105, [-float("inf"), 1.0, 1.0, 1.0]), (106, [1e30, 1.0, 1.0, 1.0]), (107, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS cluster", "1 AS v")
    found, c = centroids.cluster(df, k=k, rounds=3, dim=4, scale=256, leading=leading)
    want, wanted = plain_clusters([(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows], k, 3)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in found.collect()) == want and c.tolist() == wanted


def test_no_vectors_give_no_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    found, c = centroids.cluster(none)
    assert found.count() == 0 and len(c) == 0


def test_bounds_leave_few_to_measure_and_lose_none():
    rnd = np.random.default_rng(3)
    basis = rnd.normal(size=(4, 64)) * 300
    x = (rnd.normal(size=(500, 4)) @ basis + rnd.normal(size=(500, 64))).astype(np.int64)
    c = x[:40].copy()
    mean = x.mean(0)
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :6]
    number, d, measured = centroids.nearest(x, *centroids.rotated(x.astype(float), mean, axes), c, mean, axes)
    every = ((x[:, None] - c) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (d == every.min(1)).all()
    assert measured < 2 * len(x)


# Periodic runs


def test_lyndon_lengths_equal_the_next_smaller_suffix():
    rnd = random.Random(1)
    for _ in range(500):
        x = [rnd.randint(1, rnd.randint(1, 4)) for _ in range(rnd.randint(0, 40))]
        want = [next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x)) - i for i in range(len(x))]
        assert periodic_runs.lyndon_lengths(x) == want


def plain_runs(x, exponent=4, least=6):
    out = set()
    for q in range(1, len(x) // exponent + 1):
        i = 0
        while i + q < len(x):
            b = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i + q - b >= max(least, exponent * q):
                out.add((b, i + q - b, q))
            i += i == b
    return sorted(r for r in out if not any(p < r[2] and b <= r[0] and b + n >= r[0] + r[1] for b, n, p in out))


def test_runs_equal_brute_force():
    rnd = random.Random(2)
    for _ in range(150):
        texts = []
        for _ in range(rnd.randint(1, 6)):
            x = []
            while len(x) < rnd.randint(0, 120):
                x += [rnd.choice("abc") for _ in range(rnd.randint(1, 8))] if rnd.random() < 0.5 else [rnd.choice("abcde") for _ in range(rnd.randint(1, 9))] * rnd.randint(2, 7)
            texts.append(x)
        w = words(pa.array(["  ".join(x) or None for x in texts]))
        origin = np.cumsum(w.counts) - w.counts
        for exponent, least in ((4, 6), (3, 1)):
            got = [[] for _ in texts]
            for a, b, q in zip(*periodic_runs.find_runs(w, exponent, least)):
                got[w.row[a]].append((int(a - origin[w.row[a]]), int(b - a), int(q)))
            assert got == [plain_runs(x, exponent, least) for x in texts]


def test_op13_equals_brute_force(spark, sf):
    got = {r.doc_id: tuple(r)[1:] for r in periodic_runs.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == len(documents(spark, sf)) and sum(r[0] > 0 for r in got.values()) > 5
    for d, text in documents(spark, sf):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(d).encode())
        if n > 2_500:
            continue  # the plain version takes the square of the words
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        gone = {i for b, m, q in runs for i in range(b + q, b + m)}
        lines = "".join(f"{b},{m},{q}\n" for b, m, q in runs)
        assert got[d] == (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines.encode()), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())), d


def test_odd_texts_and_long_ones(spark):
    long = " ".join(str(i % 50_000) for i in range(220_000))
    docs = [(1, None), (1, ""), (2, " \t\n"), (None, "a a a a a a"), (3, "a a a a a"), (4, "ä b\rä b ä b ä b"), (5, long)]
    df = spark.createDataFrame(docs, DOC).selectExpr("*", "'x' AS runs", "'y' AS kept", "0 AS n_words")
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.kept if r.n_words < 10 else len(r.kept.split())) for r in periodic_runs.collapse_runs(df).collect())
    assert got == Counter([(1, 0, (), ""), (1, 0, (), ""), (2, 0, (), ""), (None, 6, ((0, 6, 1),), "a"), (3, 5, (), "a a a a a"), (4, 8, ((0, 8, 2),), "ä b"), (5, 220_000, ((0, 220_000, 50_000),), 50_000)])
    assert periodic_runs.collapse_runs(df.limit(0)).count() == 0
    planted = {r.doc_id: r.text for r in periodic_runs.with_planted_periods(spark.createDataFrame([(i, f"w{i} x  y") for i in range(60)] + [(None, "n n")], DOC)).collect()}
    assert planted[None] == "n n" and sum(t == f"w{i} x  y" for i, t in planted.items() if i is not None) == sum(zlib.crc32(str(i).encode()) % 10 != 0 for i in range(60))
    with pytest.raises(ValueError):
        periodic_runs.collapse_runs(df, exponent=2)
