"""Exact n-gram Jaccard self-join by pivots, Voronoi regions and triangle windows.

Jaccard distance d = 1 - |A & B| / |A | B| is a metric, and two documents are linked
when d <= E = 1 - percent / 100.  Unrelated documents are all at distance 1, where no
pivot tells them apart, so the join starts from cells of documents that can be
close at all, and pivots work within them.

1. Equal sets are one class (by size and two 64-bit fingerprints); its least doc_id
   stands for it from then on.
2. Cells.  With shingles in a fixed order, rarest first, two linked sets share two of
   their first n - ceil(percent n / 100) + 2, so documents meet in the cells of these.
   The order comes from a sketch of shingle frequencies over the whole input; results
   don't depend on it.
3. Regions.  A cell's pivot is its member with the least hash, and the cells of one pivot are
   a region: a row for each document and pivot, and none for pairs.  In cells of up to FEW sets
   each is a pivot for those after it, and counts with those which it meets twice.  So two
   linked documents are in one region at least.
4. Regions of up to LEAF documents are for one task, which has their whole sets.  Up to
   SAMPLED pivots, each the farthest from those before, are measured against all.  From a
   document the search goes on to those linked with it that aren't reached yet, and from
   them on; x is measured against y only if |d(x, p) - d(y, p)| <= E for every pivot p.
   A family of copies is reached in a step or two, and the links are no more than its
   documents.
5. Larger regions are split.  A region takes up to SAMPLED documents, gathers those within
   distance 1/2, and takes the centre of each gathering (the shingles that more than half of
   them hold; any set would do) as a pivot.  Every document is measured against all pivots
   of its region.  It belongs to the Voronoi region of the nearest if that is within INNER,
   and is replicated to that of pivot p if d(x, p) <= min(d(x, nearest) + 2 E, INNER + E): as
   d is a metric, whoever is linked to x and belongs to p is then met there.  What is farther
   from all pivots belongs to the outer region, of which the centre of all sampled documents
   is the pivot; two such documents meet there, so it needs no replicas, and a document that
   nothing is near to is never replicated.  In a Voronoi region, with r(x) = |x ^ p|:
   * the document nearest to the pivot is the hub, and all others are compared with it by
     their differences from the pivot: |x ^ y| = r(x) + r(y) - 2 |(x ^ p) & (y ^ p)|;
   * of the others two are left to compare if one isn't linked with the hub.  They meet in the
     cells of the shingles in which they differ from the pivot; how long a prefix is needed
     follows from the overlap needed.  These cells are put together by their pivots again and
     are the regions of the next round.
6. Documents that differ from their pivots alike meet again and again, so once a round doesn't halve
   the rows of large regions, these are cut into blocks by size.  Any two blocks whose sizes fit
   are joined in one task: texts grow with the blocks of a region, and a task with neither.

Every link between different texts is found or implied by links found, so components
are exact.  Links are decided on whole sets, computed again from the texts.

Scale: shingles never leave a task except those in prefixes and differences; a text goes to
a task once for each region it is in, and a larger region is dealt to pieces of PIECE
documents.  Cells of shingles that the sketch shows to be very frequent (counter FREQUENT
above the mean) are dealt by document, not by shingle.  What is done with larger regions are
aggregations and joins that adaptive execution can split.

Defined results: null text or no words: n_shingles 0, linked with nothing.
Null doc_id: returned with its n_shingles and a null component, linked with nothing.
Rows that repeat a doc_id count as the same document; each is returned.  Further columns
are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .sketch import BLOCKS, SKETCH, counter, gathered, perhaps
from .store import discard, materialise
from .vectext import BASE_A, BASE_B, grams, mix, signed, slices, table, words

SHINGLE = 4
PERCENT = 85
#: A region of up to so many documents, shingles in all, and shingles times documents is for one task.
LEAF, SHINGLES, WORK = 2048, 2**22, 2**31
#: Sets of a cell whose pairs are taken one by one.
FEW = 8
SAMPLED = 8
INNER = 0.5
#: Regions are split so many times at most, and only while the rows of large ones at least halve; then they are taken by blocks.
ROUNDS = 6
PIECE = 1024
#: A shingle is very frequent if its counter is so much above the mean counter.
FREQUENT = 20_000
#: Rounding of a distance is below this; windows are wider by it.
SLACK = 1e-9


def shingle_sets(col: pa.Array, k: int):
    """(row, shingle hash) of all distinct shingles, sorted by row; set sizes."""
    w = words(col, lower=True)
    g = grams(w.hash, k, BASE_A)
    inside = np.flatnonzero(w.row[: len(g)] == w.row[k - 1 :]) if len(g) else np.zeros(0, np.int64)
    rows, hashes = [w.row[inside]], [g[inside]]
    first = np.cumsum(w.counts) - w.counts
    for m in range(1, k):  # texts with fewer words are one shingle
        short = np.flatnonzero(w.counts == m)
        if len(short):
            rows.append(short)
            hashes.append(mix(grams(w.hash, m, BASE_B)[first[short]] + np.uint64(m)))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    o = np.lexsort((h, row))
    row, h = row[o], h[o]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[new], h[new]
    return row, h, np.bincount(row, minlength=len(col)).astype(np.int64)


def _fingerprints(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of each row's set; 0 for empty ones."""
    a, b = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        start = (np.cumsum(size) - size)[full]
        a[full], b[full] = np.add.reduceat(h, start), np.bitwise_xor.reduceat(mix(h), start)
    return a, b


def _key(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One number for each set, equal for equal sets.  It only names candidates: should two sets
    share it, both are taken."""
    return signed(mix(a ^ mix(b + size.astype(np.uint64))))


def _sets(k: int):
    """Map: (doc_id, n, two fingerprints, key) of each text, and at the end of the task
    its shingle counters as (block, counts)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("block", pa.int64()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                _, h, size = shingle_sets(part.column("text"), k)
                count += np.bincount(counter(h), minlength=SKETCH)
                a, b = _fingerprints(h, size)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(signed(a)), pa.array(signed(b)), pa.array(_key(a, b, size)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=schema)
        none = pa.nulls(BLOCKS, pa.int64())
        raw = [part.tobytes() for part in count.reshape(BLOCKS, -1)]
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(range(BLOCKS), pa.int64()), pa.array(raw, pa.binary())], schema=schema)

    return run


def _high(counts: np.ndarray, frequent: int) -> float:
    """A shingle whose counter is above this is very frequent."""
    return np.minimum(counts, 2**31 - 1).mean() + frequent


def _prefixes(k: int, percent: int, counts, frequent: int):
    """Map: for each text the shingles (cells) of its prefix, once for equal sets of a slice.
    salt is 0, but for very frequent shingles a number above it that follows from the set."""
    schema = pa.schema([("cell", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("salt", pa.int16())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = np.minimum(counts.value, 2**31 - 1).astype(np.uint64)
        high = _high(counts.value, frequent)
        for batch in batches:
            for part in slices(batch, "text"):
                row, h, size = shingle_sets(part.column("text"), k)
                full = np.flatnonzero(size > 1)  # a set of one shingle is linked with its equals only
                if not len(full):
                    continue
                key = _key(*_fingerprints(h, size), size)
                alone = np.zeros(len(size), bool)
                alone[full[np.unique(key[full], return_index=True)[1]]] = True
                keep = alone[row]
                row, h = row[keep], h[keep]
                f = freq[counter(h)]
                o = np.lexsort((h, f, row))  # rarest first
                row, h, f = row[o], h[o], f[o]
                kept = np.where(alone, size, 0)
                place = np.arange(len(row)) - np.repeat(np.cumsum(kept) - kept, kept)
                take = place < (size - (percent * size + 99) // 100 + 2)[row]
                row, h, f = row[take], h[take], f[take]
                dealt = 1 + (mix(key.view(np.uint64)) % np.uint64(997)).astype(np.int16)
                yield table({"cell": signed(h), "key": key[row], "n": size[row].astype(np.int32), "salt": np.where(f > high, dealt[row], 0).astype(np.int16)}, schema)

    return run


def _grouped(batches: Iterator[pa.RecordBatch], names: tuple, leaf: int, small, large) -> Iterator[pa.RecordBatch]:
    """Reduce over rows sorted by region: small() gets all rows of regions of at most
    leaf rows, large() those of others; at most leaf rows are carried from batch to batch."""
    held, big = None, None  # the last region so far, or the large region being passed on
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        s = cols[0]
        if not len(s):
            continue
        group = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        wide = np.bincount(group) > leaf
        if big is not None and s[0] == big:
            wide[0] = True
        pick, last = wide[group], group == group[-1]
        if pick.any():
            yield large([x[pick] for x in cols])
        big, held = (s[-1], None) if wide[-1] else (None, [x[last] for x in cols])
        done = ~last & ~pick
        if done.any():
            yield small([x[done] for x in cols])
    if held is not None:
        yield small(held)


def _cells(percent: int):
    """Reduce over rows (cell, key, n, salt) sorted by cell and key: sets of a cell that may be linked by
    their sizes, as (region, key, sure).  Of cells of up to FEW sets it is each pair, named by its least
    key, and that key itself; of others each set, named by the cell's pivot, the set of the least key, and
    sure.  Rows of very frequent shingles pass as (cell, key, null).  A cell holds FREQUENT sets
    more than the mean counter at most, as numbers."""
    schema = pa.schema([("region", pa.int64()), ("key", pa.int64()), ("sure", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(cols):
            s, key, n = cols
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (key[1:] != key[:-1])
            s, key, n = s[new], key[new], n[new].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            size = np.diff(np.append(first, len(s)))
            pivot, size = np.repeat(key[first], size), np.repeat(size, size)
            few = np.flatnonzero((size > 1) & (size <= FEW))
            x, ks, ns = s[few], key[few], n[few]
            regions, keys, has = [], [], np.zeros(len(few), bool)
            for gap in range(1, FEW):
                hit = np.flatnonzero((x[gap:] == x[:-gap]) & (100 * np.minimum(ns[gap:], ns[:-gap]) >= percent * np.maximum(ns[gap:], ns[:-gap])))
                regions.append(ks[hit])
                keys.append(ks[hit + gap])
                has[hit] = True
            regions.append(ks[has])
            keys.append(ks[has])
            many = np.flatnonzero(size > FEW)
            many = many[np.lexsort((n[many], s[many]))]
            fits = np.zeros(len(many) + 1, bool)
            fits[1:-1] = (s[many][1:] == s[many][:-1]) & (100 * n[many][:-1] >= percent * n[many][1:])
            many = many[fits[1:] | fits[:-1]] if len(many) else many
            sure = np.repeat([False, True], [sum(map(len, keys)), len(many)])
            return table({"region": np.concatenate([*regions, pivot[many]]), "key": np.concatenate([*keys, key[many]]), "sure": sure}, schema)

        def usual():
            for batch in batches:
                salt = batch.column("salt").to_numpy()
                if salt.any():
                    often.append(batch.filter(pa.array(salt > 0)))
                    batch = batch.filter(pa.array(salt == 0))
                yield batch

        def passed():
            while often:
                rows = often.pop()
                yield pa.RecordBatch.from_arrays([rows.column("cell"), rows.column("key"), pa.nulls(rows.num_rows, pa.bool_())], schema=schema)

        often: list[pa.RecordBatch] = []
        for out in _grouped(usual(), ("cell", "key", "n"), 2**62, met, None):
            yield out
            yield from passed()
        yield from passed()

    return run


def _dealt(percent: int, leaf: int):
    """Reduce over rows (region, doc_id, n, component) sorted by region: those of regions that have
    to be looked at, large if the region is for several tasks.  Documents of a region for one task
    without another one of a size that fits are left out."""
    schema = pa.schema([("region", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("component", pa.int64()), ("large", pa.bool_())])
    names = ("region", "doc_id", "n", "component")

    def rows(cols, large):
        return table(dict(zip(names, cols)) | {"large": large}, schema)

    def small(cols):
        o = np.lexsort((cols[2], cols[0]))
        s, _, n, c = cols = [x[o] for x in cols]
        fits = np.zeros(len(s) + 1, bool)
        fits[1:-1] = (s[1:] == s[:-1]) & (100 * n[:-1] >= percent * n[1:])
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.append(first, len(s)))
        total = np.add.reduceat(n, first)
        large = np.repeat((total > SHINGLES) | (total * size > WORK), size)
        open_ = np.repeat(np.minimum.reduceat(c, first) < np.maximum.reduceat(c, first), size)
        keep = (fits[1:] | fits[:-1]) & open_
        return rows([x[keep] for x in cols], large[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _grouped(batches, names, leaf, small, lambda cols: rows(cols, np.ones(len(cols[0]), bool)))

    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _joined(doc: np.ndarray, h: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that connect the linked documents of a region, given the sets end to end.

    Up to SAMPLED pivots, each the farthest from those before, are measured against all.  From a
    document the search goes on to those linked with it, and from them to those linked with them
    that aren't reached yet; only documents within a window of E around its distance from every
    pivot are measured."""
    m = len(doc)
    _, at, times = np.unique(h, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), size)
    shared = times[at] > 1  # others are in no intersection
    at, row = at[shared], row[shared]
    end = np.cumsum(np.bincount(row, minlength=m))
    mark = np.zeros(len(times), bool)

    def common(p: int, at_: np.ndarray, row_: np.ndarray) -> np.ndarray:
        own = at[end[p - 1] if p else 0 : end[p]]
        mark[own] = True
        out = np.bincount(row_[mark[at_]], minlength=m)
        mark[own] = False
        return out

    window, pivots, least = 1 - percent / 100 + SLACK, np.zeros((0, m)), np.full(m, 2.0)
    for _ in range(min(SAMPLED, m // 4)):
        p = int(least.argmax())
        if least[p] <= window:
            break
        same = common(p, at, row)
        d = 1 - same / (size + size[p] - same)
        pivots, least = np.vstack([pivots, d]), np.minimum(least, d)
    todo, left, us, vs = np.ones(m, bool), m, [doc[:0]], [doc[:0]]
    near_at, near_row, held = at, row, m
    for s in range(m):
        if not todo[s]:
            continue
        todo[s], left, queue = False, left - 1, [s]
        while queue and left:
            p = queue.pop()
            may = todo & (100 * np.minimum(size, size[p]) >= percent * np.maximum(size, size[p]))
            for d in pivots:
                may &= np.abs(d - d[p]) <= window
            if not may.any():
                continue
            if 2 * left <= held:
                keep = todo[near_row]
                near_at, near_row, held = near_at[keep], near_row[keep], left
            same = common(p, near_at, near_row)
            found = np.flatnonzero(may & (100 * same >= percent * (size + size[p] - same)))
            todo[found], left = False, left - len(found)
            queue += found.tolist()
            us.append(np.full(len(found), doc[s]))
            vs.append(doc[found])
    return np.concatenate(us), np.concatenate(vs)


def _within(k: int, percent: int):
    """Reduce over rows (region, doc_id, text) sorted by region: the links of regions for one task."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def links():
            u, v = _joined(*(np.concatenate(x) for x in zip(*held)), percent)
            return table({"u": u, "v": v}, schema)

        for batch in batches:
            for part in slices(batch, "text"):
                _, h, size = shingle_sets(part.column("text"), k)
                region, doc = (part.column(c).to_numpy() for c in ("region", "doc_id"))
                start = np.concatenate([[0], np.cumsum(size)])
                cut = np.concatenate([[0], np.flatnonzero(region[1:] != region[:-1]) + 1, [len(region)]])
                for i, j in zip(cut[:-1], cut[1:]):
                    if held and region[i] != at:
                        yield links()
                        held = []
                    at = region[i]
                    held.append((doc[i:j].copy(), h[start[i] : start[j]].copy(), size[i:j]))
        if held:
            yield links()

    return run


def _centres(k: int):
    """Group: of a region's sampled texts the centre of all (nth 0), and those of such as lie
    within distance 1/2 of each other."""
    schema = pa.schema([("region", pa.int64()), ("nth", pa.int64()), ("centre", pa.list_(pa.int64()))])

    def run(group: pa.Table) -> pa.Table:
        gathered: list[list[np.ndarray]] = []
        for text in group.column("text").combine_chunks():
            x = shingle_sets(pa.array([text.as_py()], pa.string()), k)[1]
            for near in gathered:
                c = _common(x, near[0])
                if 2 * c >= len(x) + len(near[0]) - c:
                    near.append(x)
                    break
            else:
                gathered.append([x])
        centres = []
        for i, near in enumerate([[x for near in gathered for x in near], *gathered]):
            u, n = np.unique(np.concatenate(near), return_counts=True)
            c = u[2 * n > len(near)]
            centres.append(signed(c if len(c) or not i else near[0]))
        return pa.table({"region": pa.array([group.column("region")[0].as_py()] * len(centres), pa.int64()), "nth": pa.array(range(len(centres)), pa.int64()), "centre": pa.array(centres, pa.list_(pa.int64()))}, schema=schema)

    return run


def _voronoi(k: int, percent: int, counts):
    """Reduce over rows sorted by (region, piece, role, doc_id): each document (role 1) is measured
    against all centres of its region (role 0, doc_id their number).  One row for each Voronoi region
    in which it belongs: f = (100 + percent) |x ^ p| - (100 - percent) |x|, and
    the shingles in which it differs: its own first, rarest first, then the pivot's."""
    schema = pa.schema([("region", pa.int64()), ("doc_id", pa.int64()), ("component", pa.int64()), ("n", pa.int64()), ("f", pa.int64()), ("native", pa.bool_()), ("differs", pa.list_(pa.int64()))])
    reach = 2 * (1 - percent / 100) + SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centres = None, []
        for batch in batches:
            for part in slices(batch, "text"):
                _, h, size = shingle_sets(part.column("text"), k)
                start = np.cumsum(size) - size
                out: list[list] = [[] for _ in schema]
                centre = part.column("centre")
                for i, (region, piece, role, doc, component) in enumerate(zip(*(part.column(c).to_pylist() for c in ("region", "piece", "role", "doc_id", "component")))):
                    if role == 0:
                        if at != (region, piece):
                            at, centres = (region, piece), []
                        centres.append(centre[i].values.to_numpy().copy().view(np.uint64))
                        continue
                    x = h[start[i] : start[i] + size[i]]
                    same = [_common(x, c) for c in centres]
                    d = np.array([1 - s / (len(x) + len(c) - s) for s, c in zip(same, centres)])
                    nearest = 1 + int(d[1:].argmin())
                    met = 1 + np.flatnonzero(d[1:] <= min(d[nearest] + reach, INNER + reach / 2))
                    if d[nearest] > INNER:
                        nearest = 0
                        met = np.append(0, met)
                    for j in met:
                        c = centres[j]
                        own, others = np.setdiff1d(x, c, assume_unique=True), np.setdiff1d(c, x, assume_unique=True)
                        own = own[np.lexsort((own, counts.value[counter(own)]))]
                        others = others[np.lexsort((others, counts.value[counter(others)]))]
                        key = int(mix(mix(np.array([region], np.int64).view(np.uint64)) + np.uint64(j + 1))[0].view(np.int64))
                        differs = signed(np.concatenate([own, others]))
                        for col, v in zip(out, (key, doc, component, len(x), (100 + percent) * len(differs) - (100 - percent) * len(x), j == nearest, differs)):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    return run


def _by_pivot(rows: DataFrame, member: str, *more) -> DataFrame:
    """Cells (cell, member, more): those with the same pivot (the member with the least hash) are one
    region: (region, member, more)."""
    pivot = rows.groupBy("cell").agg(F.min(F.struct(F.xxhash64(member), member)).alias("pivot"), F.count("*").alias("size")).where("size > 1")
    return rows.join(pivot, "cell").select(F.col(f"pivot.{member}").alias("region"), member, *more)


def _regions(docs: DataFrame, sets: DataFrame, counts, k: int, percent: int, leaf: int, frequent: int) -> DataFrame:
    """(region, doc_id, n, component, large): two linked documents are in one region at least."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("text").mapInArrow(_prefixes(k, percent, counts, frequent), "cell long, key long, n int, salt smallint")
    dealt = rows.repartition(n, "cell", "salt").sortWithinPartitions("cell", "key")
    met = dealt.mapInArrow(_cells(percent), "region long, key long, sure boolean")
    written = None
    if (np.minimum(counts.value, 2**31 - 1) > _high(counts.value, frequent)).any():
        met = written = materialise(met, "cells")
        often = met.where("sure is null").select(F.col("region").alias("cell"), "key").distinct()
        met = met.where("sure is not null")
        if not often.isEmpty():
            met = met.unionByName(_by_pivot(materialise(often, "often"), "key", F.lit(True).alias("sure")))
    # Linked sets share two cells: a large one, or twice small ones.
    met = met.groupBy("region", "key").agg(F.max("sure").alias("sure"), F.count("*").alias("times")).where("sure or times > 1")
    regions = _deal(met.select("region", "key").join(sets, "key").select("region", F.col("rep").alias("doc_id"), "n", F.col("rep").alias("component")), percent, leaf)
    if written is not None:
        discard(written)
    return regions


def _deal(rows: DataFrame, percent: int, leaf: int) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("region", "doc_id", "n", "component").repartition(n, "region").sortWithinPartitions("region")
    return materialise(dealt.mapInArrow(_dealt(percent, leaf), "region long, doc_id long, n long, component long, large boolean"), "regions")


def _links_within(small: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    n = int(small.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = small.select("region", "doc_id").hint("merge").join(texts.hint("merge"), "doc_id")
    return whole.repartition(n, "region").sortWithinPartitions("region").mapInArrow(_within(k, percent), "u long, v long")


def _split(large: DataFrame, texts: DataFrame, counts, k: int, percent: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Regions for several tasks: -> links with the hubs, rows (region, doc_id, n, component) of the regions in
    which the others meet, and the tables to remove once these rows are written."""
    n = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = large.groupBy("region").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
    sample = large.withColumn("nth", F.row_number().over(W.partitionBy("region").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("nth") <= SAMPLED)
    centres = sample.join(texts, "doc_id").select("region", "text").groupBy("region").applyInArrow(_centres(k), "region long, nth long, centre array<long>")
    none = F.lit(None).cast("long")
    ones = centres.join(pieces, "region").select("region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.lit(0).alias("role"), F.col("nth").alias("doc_id"), none.alias("component"), F.lit(None).cast("string").alias("text"), "centre")
    piece = F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("long")
    others = large.join(pieces, "region").hint("merge").join(texts.hint("merge"), "doc_id").select("region", piece.alias("piece"), F.lit(1).alias("role"), "doc_id", "component", "text", F.lit(None).cast("array<long>").alias("centre"))
    dealt = ones.unionByName(others).repartition(n, "region", "piece").sortWithinPartitions("region", "piece", "role", "doc_id")
    held = dealt.mapInArrow(_voronoi(k, percent, counts), "region long, doc_id long, component long, n long, f long, native boolean, differs array<long>")
    held = materialise(held, "voronoi")
    hub = held.groupBy("region").agg(F.min(F.struct("f", "doc_id", "component", "n", "differs")).alias("hub"))
    # |x ^ hub| from the differences of both from the pivot.
    apart = F.size("differs") + F.size("hub.differs") - 2 * F.size(F.array_intersect("differs", "hub.differs"))
    met = held.join(hub, "region").where("doc_id != hub.doc_id or differs != hub.differs").withColumn("linked", (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("hub.n")))
    met = met.select("region", "doc_id", "component", "n", "f", "native", "differs", "linked", F.col("hub.doc_id").alias("hub"), F.col("hub.component").alias("hubs"))
    met = materialise(met, "hubs")  # read three times
    links = met.where("linked and doc_id != hub").select(F.col("hub").alias("u"), F.col("doc_id").alias("v"))
    ends = met.groupBy("region").agg(F.min("f").alias("any_f"), F.min(F.when(~F.col("linked"), F.col("f"))).alias("far_f"), F.min(F.when(F.col("linked"), F.col("component"))).alias("linked_c"))
    # What isn't linked with the hub may be with another document that differs from the pivot likewise.
    rest = met.join(ends.where("far_f is not null"), "region")
    overlap = F.greatest(F.lit(1), F.ceil((F.col("f") + F.when(F.col("linked"), F.col("far_f")).otherwise(F.col("any_f"))) / (2 * (100 + percent))))
    rest = rest.withColumn("component", F.when(F.col("linked"), F.least("linked_c", "hubs")).otherwise(F.col("component")))
    rest = rest.withColumn("prefix", (F.size("differs") - overlap + 1).cast("int")).where("prefix > 0")
    each = rest.select("region", "doc_id", "n", "component", "native", F.explode(F.slice("differs", F.lit(1), F.col("prefix"))).alias("shingle"))
    each = materialise(each.select(F.xxhash64("region", "shingle").alias("cell"), "doc_id", "n", "component", "native"), "cells")
    # A cell in which all are connected, or all are replicas, has nothing left to do.
    open_ = each.groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("native").alias("own")).where("lo < hi and own").select("cell")
    cells, each = each, materialise(each.join(open_, "cell"), "cells")
    discard(cells)
    rows = _by_pivot(each, "doc_id", "n", "component").groupBy("region", "doc_id", "n").agg(F.min("component").alias("component"))
    return links, rows, [held, each]


def _blocks(large: DataFrame, percent: int, leaf: int) -> DataFrame:
    """Rows (region, doc_id) of regions for one task, in which any two documents of a large region meet
    whose sizes fit: its documents in order of size are cut into blocks, and two blocks are a region."""
    weight = F.greatest(F.lit(2.0 / leaf), F.col("n") / (SHINGLES / 2), F.sqrt("n") / (WORK / 4) ** 0.5)
    before = W.partitionBy("region").orderBy("n", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    block = F.floor(F.coalesce(F.sum(weight).over(before), F.lit(0.0)))
    rows = materialise(large.select("region", "doc_id", "n", block.alias("block")), "blocks")
    ends = rows.groupBy("region", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    a, b = ends.select("region", F.col("block").alias("a"), "hi"), ends.select("region", F.col("block").alias("b"), "lo")
    pairs = a.join(b, "region").where((F.col("a") < F.col("b")) & (percent * F.col("lo") <= 100 * F.col("hi"))).select("region", "a", "b")
    both = pairs.select("region", "a", "b", F.explode(F.array("a", "b")).alias("block"))
    alone = ends.join(both.select("region", "block"), ["region", "block"], "left_anti").select("region", F.col("block").alias("a"), F.col("block").alias("b"), "block")
    return both.unionByName(alone).join(rows, ["region", "block"]).select(F.xxhash64("region", "a", "b").alias("region"), "doc_id")


def _region_links(regions: DataFrame, texts: DataFrame, counts, k: int, percent: int, leaf: int) -> DataFrame:
    """Links that connect the linked documents of all regions."""
    if regions.where("large").isEmpty():
        return _links_within(regions, texts, k, percent)
    texts = materialise(texts, "texts")
    todo = regions.where("not large").select("region", "doc_id")
    links, rounds = None, 0
    while not (large := regions.where("large")).isEmpty():
        many = large.count()
        if rounds < ROUNDS:
            more, rows, done = _split(large, texts, counts, k, percent)
            dealt = _deal(rows, percent, leaf)
            discard(*done)
            rounds += 1
            if 2 * dealt.where("large").count() <= many:
                links = more if links is None else links.unionByName(more)
                regions = dealt
                todo = todo.unionByName(regions.where("not large").select("region", "doc_id"))
                continue
        # Documents that differ from their pivots alike would meet again and again.
        todo = todo.unionByName(_blocks(large, percent, leaf))
        break
    found = _links_within(todo, texts, k, percent)
    return found if links is None else links.unionByName(found)


def join_sets(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT, leaf: int = LEAF, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """-> sizes (doc_id, n), a row for each row of documents, and links (u, v) that
    connect what is linked by similarity, directly or over others."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sets = materialise(docs.mapInArrow(_sets(k), "doc_id long, n long, a long, b long, key long, block long, counts binary"), "sets")
    counts = spark.sparkContext.broadcast(gathered(sets.where("block is not null").select("block", "counts"), np.add))
    sets = sets.where("block is null").drop("block", "counts")
    docs = docs.where("doc_id is not null")
    full = sets.where("n > 0 and doc_id is not null")
    least = full.groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"), F.max("doc_id").alias("last"))
    equal = full.join(least.where("last > rep").select("n", "a", "b", "rep"), ["n", "a", "b"]).where("doc_id != rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    regions = _regions(docs, least.where("n > 1").select("key", "rep", "n"), counts, k, percent, leaf, frequent)
    ids = regions.select("doc_id").distinct()
    if ids.isEmpty():
        return sets.select("doc_id", "n"), equal
    # From here on only these documents' texts are needed.
    links = _region_links(regions, perhaps(docs, ids), counts, k, percent, leaf)
    return sets.select("doc_id", "n"), links.unionByName(equal)


def near_duplicate_classes(documents: DataFrame, k: int = SHINGLE, percent: int = PERCENT, leaf: int = LEAF, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of documents: doc_id, n_shingles, component_id."""
    sizes, links = join_sets(documents, k, percent, leaf, frequent)
    member = components(links)
    return sizes.join(member, sizes.doc_id == member.node, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
