"""Approximate nearest neighbours by inner product on robust-pruned graphs.

Vectors are dealt to shards by a hash; each shard is a directed graph.  It grows
batch by batch: a greedy beam search from the nearest of ENTRIES points proposes neighbours of
each new point; pruning keeps a candidate only if no kept one is nearer to it by
the factor ALPHA, so the edges stay diverse; kept neighbours get the edge back and
are pruned again when they have more than DEGREE.  A query walks every shard with
a beam of BEAM points, and the shards' results are merged.

Inner product is not a distance, so a shard's points are put in classes of norms
within RATIO of each other; a class is a graph on the directions of its points (or,
up to EXACT points, no graph: all are compared) and is walked by inner product.
Classes go from the largest norms down, and a query leaves out a class whose largest
norm can't reach what it has.  Only directions and norms over the class's largest
enter, so norms of any size may lie in one shard.  What the beam holds is ranked by
scores in double precision on the original vectors.

Equal vectors are one point of the graph.  Of its rows the k + 1 with the least
ids are kept, which is all that a list of k can need, so a vector held by a third
of all rows is cheap and exact.

Scale: SHARDS graphs until each holds SHARD_ROWS points, then more graphs, so that
recall within a shard doesn't fall with the input.  Graphs are built once and written to
the shared folder; a task holds one shard and reads its queries batch by batch, PIECE
distinct ones at most, so no group grows with the queries and a lost executor costs one
piece.  Every query walks every shard: the method's cost is queries times shards.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; nor does a null vec_id.  Vectors of different lengths
are never compared.  Rows that repeat vec_id and vector count once.  Fewer than
k candidates: all of them.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import materialise
from .vectext import table

SHARDS = 8
SHARD_ROWS = 20_000
#: Distinct queries that walk a shard in one task, and partitions for each such task.
PIECE = 8192
SPREAD = 6
DEGREE = 32
BUILD_BEAM = 64
BEAM = 192
ALPHA = 1.2
WIDTH = 4
BATCH = 256
RATIO = 1.25
EXACT = 512
#: Points from which walks may start, and how many of them each walk takes.
ENTRIES = 256
STARTS = 16


def beam_search(graph: np.ndarray, x: np.ndarray, norm: np.ndarray | None, q: np.ndarray, entries: np.ndarray, beam: int):
    """For each row of q the beam's points and distances, nearest first; -1 pads.
    The walk starts from the nearest of the entries.  A distance is norm less twice
    the product, or squared differences if norm is None."""

    def far(r: np.ndarray, p: np.ndarray) -> np.ndarray:
        if norm is not None:
            return norm[p] - 2 * np.einsum("ij,ij->i", q[r], x[p])
        gap = q[r]
        gap -= x[p]
        return np.einsum("ij,ij->i", gap, gap)

    b, n = len(q), len(x)
    rows = np.arange(b)
    ids = np.full((b, beam), -1)
    dist = np.full((b, beam), np.inf, x.dtype)
    m = len(entries)
    d = far(np.repeat(rows, m), np.tile(entries, b)).reshape(b, m)
    o = np.argsort(d, axis=1, kind="stable")[:, : min(m, STARTS)]
    ids[:, : o.shape[1]], dist[:, : o.shape[1]] = entries[o], np.take_along_axis(d, o, 1)
    done = np.zeros((b, beam), bool)
    seen = np.zeros((b, n), bool)
    seen[:, entries] = True
    while True:
        todo = (ids >= 0) & ~done
        live = np.flatnonzero(todo.any(1))
        if not len(live):
            return ids, dist
        t = todo[live]
        pick = t & (np.cumsum(t, axis=1) <= WIDTH)
        r, c = np.nonzero(pick)
        done[live[r], c] = True
        near = graph[ids[live[r], c]]
        rr = np.repeat(live[r], near.shape[1])
        nn = near.ravel()
        ok = nn >= 0
        rr, nn = rr[ok], nn[ok]
        ok = ~seen[rr, nn]
        rr, nn = rr[ok], nn[ok]
        key = np.unique(rr * n + nn)
        rr, nn = key // n, key % n
        seen[rr, nn] = True
        if not len(rr):
            continue
        d = far(rr, nn)
        count = np.bincount(rr, minlength=b)
        place = np.arange(len(rr)) - np.repeat(np.cumsum(count) - count, count)
        width = int(count.max())
        more_i, more_d = np.full((b, width), -1), np.full((b, width), np.inf, x.dtype)
        more_i[rr, place], more_d[rr, place] = nn, d
        got = np.unique(rr)
        all_i = np.concatenate([ids[got], more_i[got]], 1)
        all_d = np.concatenate([dist[got], more_d[got]], 1)
        all_done = np.concatenate([done[got], np.zeros((len(got), width), bool)], 1)
        o = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        k = np.arange(len(got))[:, None]
        ids[got], dist[got], done[got] = all_i[k, o], all_d[k, o], all_done[k, o]


def prune(x: np.ndarray, point: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each point's candidates (-1 pads) at most degree diverse ones."""
    m, c = cand.shape
    safe = np.maximum(cand, 0)
    v = x[safe] - x[point][:, None]  # seen from the point, so that products of large coordinates don't hide small distances
    d = (v**2).sum(2)
    bad = (cand < 0) | (cand == point[:, None])
    d[bad] = np.inf
    o = np.argsort(d, axis=1, kind="stable")
    k = np.arange(m)[:, None]
    cand, v, d = cand[k, o], v[k, o], d[k, o]
    sq = (v**2).sum(2)
    between = sq[:, :, None] + sq[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    alive = np.isfinite(d)
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    out = np.full((m, degree), -1)
    rows = np.arange(m)
    for i in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        s = alive.argmax(1)
        out[some, i] = cand[rows, s][some]
        alive &= ~(alpha * alpha * between[rows, s] <= d) & some[:, None]
        alive[rows, s] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """The pruned graph (n x degree, -1 pads) of the points, and the entries of walks."""
    n = len(x)
    graph = np.full((n, degree), -1)
    centre = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.Generator(np.random.PCG64(1)).permutation(n)
    order = np.concatenate([[centre], order[order != centre]])
    entries = order[:ENTRIES]
    at = 1
    while at < n:
        new = order[at : at + min(at, BATCH)]
        ids, _ = beam_search(graph, x, None, x[new], entries[:at], beam)
        at += len(new)
        graph[new] = prune(x, new, ids, degree, alpha)
        src = np.repeat(new, degree)
        dst = graph[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        target, count = np.unique(dst, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(np.cumsum(count) - count, count)
        held = (graph[target] >= 0).sum(1)
        fits = held + count <= degree
        where = np.repeat(np.arange(len(target)), count)
        f = fits[where]
        graph[dst[f], held[where[f]] + place[f]] = src[f]
        full = np.flatnonzero(~fits)
        full = full[np.argsort(count[full])]
        for lo in range(0, len(full), BATCH):
            part = full[lo : lo + BATCH]
            width = int(count[part].max())
            more = np.full((len(part), width), -1)
            index = np.full(len(target), -1)
            index[part] = np.arange(len(part))
            sel = index[where] >= 0
            more[index[where[sel]], place[sel]] = src[sel]
            graph[target[part]] = prune(x, target[part], np.concatenate([graph[target[part]], more], 1), degree, alpha)
    return graph, entries


def classes(x: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """(largest norm, points) of the classes of norms, largest first."""
    top = np.abs(x).max(1)
    norm = top * np.sqrt(((x / top[:, None]) ** 2).sum(1))
    order = np.argsort(-norm, kind="stable")
    down, out, lo = -norm[order], [], 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(down, down[lo] / RATIO, side="right")))
        out.append((-down[lo], order[lo:hi]))
        lo = hi
    return out


def index(x: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """(largest norm, points, graph, entries) of each class; no graph for small ones."""
    out = []
    for top, at in classes(x):
        graph = entries = None
        if len(at) > EXACT:
            part = x[at] / top
            graph, entries = build((part / np.sqrt((part**2).sum(1, keepdims=True))).astype(np.float32))
        out.append((top, at, graph, entries))
    return out


def search(x: np.ndarray, parts: list, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q the k points of x found with the largest products (-1 pads), and these."""
    b = len(q)
    ids, score = np.full((b, k), -1), np.full((b, k), -np.inf)
    wide = np.abs(q).max(1)
    asked = q / wide[:, None]
    size = np.sqrt((asked**2).sum(1))
    for top, at, graph, entries in parts:
        # Rounding is below the slack; a class that might hold a better point is never left out.
        live = np.flatnonzero(~(score[:, -1] > top * size * wide * (1 + 1e-9)))
        part = None if graph is None else (x[at] / top).astype(np.float32)
        for lo in range(0, len(live), BATCH):
            rows = live[lo : lo + BATCH]
            if graph is None:
                got = np.broadcast_to(np.arange(len(at)), (len(rows), len(at)))
                s = q[rows] @ x[at].T
            else:
                got, _ = beam_search(graph, part, np.zeros(len(at), np.float32), asked[rows].astype(np.float32), entries, max(BEAM, 2 * k))
                s = np.where(got >= 0, np.einsum("ij,ikj->ik", q[rows], x[at[got]]), -np.inf)
            all_i = np.concatenate([ids[rows], np.where(got >= 0, at[got], -1)], 1)
            all_s = np.concatenate([score[rows], s], 1)
            o = np.argsort(-all_s, axis=1, kind="stable")[:, :k]
            r = np.arange(len(rows))[:, None]
            ids[rows], score[rows] = all_i[r, o], all_s[r, o]
    return ids, score


GRAPHS = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("top", pa.float64()), ("entries", pa.binary()), ("dims", pa.int32()), ("reps", pa.binary()), ("vectors", pa.binary()), ("edges", pa.binary())])


def _built(key: tuple, points: pd.DataFrame) -> pd.DataFrame:
    """Group: the classes of a shard as rows of GRAPHS.  Arrays are kept as bytes."""
    points = points.sort_values("rep")  # of equal scores the least ids are kept
    x = np.stack(points["embedding"].to_numpy()).astype(np.float64)
    reps = points["rep"].to_numpy().astype(np.int64)
    rows = [
        (key[1], i, top, b"" if graph is None else entries.tobytes(), x.shape[1], reps[at].tobytes(), x[at].tobytes(), b"" if graph is None else graph.astype(np.int32).tobytes())
        for i, (top, at, graph, entries) in enumerate(index(x))
    ]
    return pd.DataFrame(rows, columns=GRAPHS.names)


def _walk(k: int):
    """Reduce over rows sorted by (dims, shard, piece, role, part): the classes of a shard
    (role 0), then the queries that walk them (role 1), a batch at a time."""
    schema = pa.schema([("query", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reps, x, parts = None, [], [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("dims", "shard", "piece", "role"))))
            lo = 0
            while lo < len(keys):
                hi = lo + 1
                while hi < len(keys) and keys[hi] == keys[lo]:
                    hi += 1
                (*where, role), rows = keys[lo], batch.slice(lo, hi - lo)
                lo = hi
                if role == 0:
                    if at != where:
                        at, reps, x, parts = where, [], [], []
                    for r in rows.to_pylist():
                        first = sum(map(len, reps))
                        reps.append(np.frombuffer(r["reps"], np.int64))
                        x.append(np.frombuffer(r["vectors"], np.float64).reshape(-1, r["dims"]))
                        edges = np.frombuffer(r["edges"], np.int32).reshape(len(x[-1]), -1).astype(np.int64) if r["edges"] else None
                        parts.append((r["top"], np.arange(first, first + len(x[-1])), edges, np.frombuffer(r["entries"], np.int64)))
                elif at == where:
                    if len(x) > 1:
                        reps, x = [np.concatenate(reps)], [np.concatenate(x)]
                    q = np.stack(rows.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64)
                    ids, score = search(x[0], parts, q, k + 1)
                    r, c = np.nonzero(ids >= 0)
                    yield table({"query": rows.column("query").to_numpy()[r], "rep": reps[0][ids[r, c]], "score": score[r, c]}, schema)

    return run


def usable(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    v = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull()).where(finite & F.exists(e, lambda v: v != 0))
    return v.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, shards: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors found of each row of
    queries (vec_id, embedding), the row of the same vec_id left out."""
    v = usable(vectors)
    same = W.partitionBy("embedding").orderBy("vec_id")
    v = v.withColumn("nth", F.dense_rank().over(same)).where(F.col("nth") <= k + 1).distinct()
    v = materialise(v.withColumn("rep", F.min("vec_id").over(W.partitionBy("embedding"))), "vectors")
    reps = v.where("vec_id = rep").select("rep", "embedding")
    if shards is None:
        shards = max(SHARDS, -(-reps.count() // SHARD_ROWS))
    q = usable(queries)
    asked = materialise(q.groupBy("embedding").agg(F.min("vec_id").alias("query")).withColumn("dims", F.size("embedding")), "queries")
    points = reps.withColumn("dims", F.size("embedding")).withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("long"))
    # More partitions than keys, so that few tasks get two shards.
    built = points.repartition(SPREAD * shards, "dims", "shard").groupBy("dims", "shard").applyInPandas(_built, "shard long, part int, top double, entries binary, dims int, reps binary, vectors binary, edges binary")
    built = materialise(built, "graphs")
    pieces = -(-asked.count() // PIECE)
    graphs = built.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(max(pieces, 1) - 1)))).withColumns({"role": F.lit(0), "query": F.lit(None).cast("long"), "embedding": F.lit(None).cast("array<double>")})
    walks = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>"))).withColumns({"piece": F.pmod(F.xxhash64("query"), F.lit(max(pieces, 1))).cast("int"), "role": F.lit(1)})
    dealt = graphs.unionByName(walks, allowMissingColumns=True).repartition(SPREAD * shards * max(pieces, 1), "dims", "shard", "piece").sortWithinPartitions("dims", "shard", "piece", "role", "part")
    found = materialise(dealt.mapInArrow(_walk(k), "query long, rep long, score double"), "found")
    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = found.join(v.select("rep", "vec_id"), "rep").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).select("query", "vec_id", "score")
    ids = q.join(asked.drop("dims"), "embedding").select(F.col("vec_id").alias("query_id"), "query").distinct()
    own = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = ids.join(lists, "query").where("vec_id != query_id").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op7_graph_ann(spark, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(v, v.where("vec_id % 20 = 0"), 20)
