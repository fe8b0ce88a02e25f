"""Periodic runs of words by Lyndon roots from Baier's grouping.

A run is a stretch with smallest period q that no neighbouring word extends.  Every run holds,
for one of the two orders of words (ascending, descending), a place where the longest Lyndon
word has length q: its root.  Phase one of Baier's suffix sorter groups the suffixes of a text
by just that Lyndon word (lyndon_lengths): groups are taken from the highest down, each member
is put behind the nearest earlier suffix of a lower group, and such parents move to a group
with a longer context.  Roots that are followed by a copy of themselves are extended to both
sides by longest common extensions, found by halving over hashes of ranges; what reaches the
least length is a run, once for each start and period.

Words that can be in no run needn't be grouped: in a run of period q, 2^(s-1) < q <= 2^s and
exponent 3 or more, each word begins a stretch of 2^s words that comes again after q words, up
to the last such stretch, and the stretches with their copies cover the run.  So stretches of
1, 2, 4, ... words that come again at such a distance are found by sorting, and what they cover
is cut into regions; runs don't cross their borders, and each region is a text of its own.

Scale: a map over the documents without any shuffle; a task holds slices of bounded text size,
or one longer text with a few lists of its words.

Defined results: null, empty or blank text: no runs, and nothing kept.  Every row is its own
document, whatever its doc_id, repeated rows too.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectext import BASE_A, BASE_B, RangeHash, Words, grams, mix, slices, words

#: A run has at least so many periods and words.
EXPONENT, LEAST = 4, 6

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "array<struct<start:long,length:long,period:long>>"


def lyndon_lengths(x: list) -> list[int]:
    """Length of the longest Lyndon word that starts at each place of x."""
    n = len(x)
    letters = sorted(set(x))
    number = {c: g for g, c in enumerate(letters)}
    group = [number[c] for c in x]
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    size, up, down = [1] * len(letters), list(range(1, len(letters) + 1)), list(range(-1, len(letters) - 1))
    if letters:
        up[-1] = -1
    before, length = [-2] * n, [0] * n  # -2: not reached yet, so of a lower group
    g = len(letters) - 1
    while g >= 0:
        own = size[g]
        moved: dict[int, dict[int, list[int]]] = {}  # by group of the parents and their number of children
        parent, children = -1, 0
        for i in members[g]:
            if group[i] != g:
                continue  # has moved up
            p = i - 1
            while p >= 0 and before[p] != -2:
                p = before[p]
            before[i], length[i] = p, own
            if p != parent:
                if parent >= 0:
                    moved.setdefault(group[parent], {}).setdefault(children, []).append(parent)
                parent, children = p, 0
            children += 1
        if parent >= 0:
            moved.setdefault(group[parent], {}).setdefault(children, []).append(parent)
        for h, by_count in moved.items():
            low = h
            for c in sorted(by_count):  # the more children, the higher
                new, high = len(size), up[low]
                size.append(size[h] + c * own)
                members.append(by_count[c])
                up.append(high)
                down.append(low)
                up[low] = down[high] = new
                for p in by_count[c]:
                    group[p] = new
                low = new
        g = down[g]
    return length


def _again(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the places at (ascending): the distance to the next one with the same key (0: none),
    and whether there is a next or a previous one."""
    o = np.argsort(key, kind="stable")
    same = key[o][1:] == key[o][:-1]
    far, has = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    far[o[:-1][same]] = at[o[1:][same]] - at[o[:-1][same]]
    has[o[:-1][same]] = True
    has[o[1:][same]] = True
    return far, has


def regions(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 word of the stretches that hold every run of exponent 3 or more."""
    n = len(w)
    cover = np.zeros(n + 1, np.int64)
    at, step = np.arange(n), 1
    while len(at):
        inside = at[at + step <= n]
        inside = inside[w.row[inside] == w.row[inside + step - 1]]
        if not len(inside):
            break
        key = grams(w.hash, step, BASE_A)[inside] + mix(w.row[inside].astype(np.uint64))
        far, has = _again(key, inside)
        near = (far > step // 2) & (far <= step)
        np.add.at(cover, inside[near], 1)
        np.add.at(cover, (inside + far + step)[near], -1)
        at, step = inside[has], 2 * step  # a longer stretch comes again only where this one does
    held = np.cumsum(cover[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]])))
    first, stop = edge[::2], edge[1::2]
    if len(first):  # documents are apart
        cut = np.flatnonzero((w.row[1:] != w.row[:-1]) & held[1:] & held[:-1]) + 1
        first, stop = np.sort(np.append(first, cut)), np.sort(np.append(stop, cut))
    return first, stop


def _common(h: RangeHash, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """Longest common extension of the places a and b, or backwards of what ends there."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        equal = h(a - mid, a) == h(b - mid, b) if back else h(a, a + mid) == h(b, b + mid)
        low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
    return low


def find_runs(w: Words, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and period of the runs of all rows of w, by start and period."""
    first, stop = regions(w)
    none = np.zeros(0, np.int64)
    if not len(first):
        return none, none, none
    place = np.concatenate([np.arange(a, b) for a, b in zip(first, stop)])
    x = w.hash[place]
    edge = np.append(0, np.cumsum(stop - first))
    low, high = np.repeat(edge[:-1], stop - first), np.repeat(edge[1:], stop - first)
    hashes, at = RangeHash(x, BASE_B), np.arange(len(x))
    starts, stops, periods = [], [], []
    for descending in (False, True):
        root = np.zeros(len(x), np.int64)
        for a, b in zip(edge[:-1], edge[1:]):
            rank = np.unique(x[a:b], return_inverse=True)[1]
            root[a:b] = lyndon_lengths((-rank if descending else rank).tolist())
        i = at[at + 2 * root <= high]
        q = root[i]
        copied = hashes(i, i + q) == hashes(i + q, i + 2 * q)
        i, q = i[copied], q[copied]
        right = _common(hashes, i, i + q, high[i] - i - q, False)
        left = _common(hashes, i, i + q, i - low[i], True)
        starts.append(i - left)
        stops.append(i + q + right)
        periods.append(q)
    start, end, q = (np.concatenate(v) for v in (starts, stops, periods))
    long = end - start >= np.maximum(least, exponent * q)
    one = np.unique(np.stack([start[long], q[long], end[long]], 1), axis=0)
    start, q, end = one[:, 0], one[:, 1], one[:, 2]
    return place[start], place[start] + end - start, q


def _map(exponent: int, least: int, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"))
                start, stop, q = find_runs(w, exponent, least)
                origin = np.cumsum(w.counts) - w.counts
                row = w.row[start] if len(start) else start
                drop = np.zeros(len(w) + 1, np.int64)
                np.add.at(drop, start + q, 1)
                np.add.at(drop, stop, -1)
                gone = np.cumsum(drop[:-1]) > 0
                hit = set(row.tolist())
                kept = []
                for r, text in enumerate(part.column("text")):
                    said = (text.as_py() or "").encode().split()  # bytes: splits at the six ASCII white space characters
                    if r in hit:
                        said = [said[i] for i in np.flatnonzero(~gone[origin[r] : origin[r] + w.counts[r]])]
                    kept.append(b" ".join(said).decode())
                found = pa.StructArray.from_arrays([pa.array(start - origin[row]), pa.array(stop - start), pa.array(q)], fields=list(_RUN))
                offsets = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(w.counts), pa.ListArray.from_arrays(offsets, found), pa.array(kept, pa.string())], names=[*carried, "n_words", "runs", "kept"])

    return run


def collapse_runs(documents: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period) and kept:
    the text's words, joined by one space, without those that a run holds after its first
    period.  exponent (3 or more) and least: periods and words that a run has at least."""
    if exponent < 3:
        raise ValueError("regions hold runs of exponent 3 and more only")
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_map(exponent, least, ["doc_id"]), f"doc_id long, n_words long, runs {RUNS}, kept string")


def with_planted_periods(documents: DataFrame) -> DataFrame:
    """The texts of which the query tells the runs: by its doc_id one in ten goes on with a
    stretch of its own words, repeated up to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def planted(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        word = lambda i: F.element_at(w, (1 + F.when(i < a, i).otherwise(a + (i - a) % p)).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")).otherwise("")

    said = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return documents.select("doc_id", F.when(h % 10 == 0, F.transform(F.array(said), planted)[0]).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_runs; start, length, period and exponent_milli of the run with the greatest
    exponent; digests of all runs and of the words kept."""
    found = collapse_runs(with_planted_periods(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    more = lambda best, r: F.when(best.isNull() | (r.length * best.period > best.length * r.period), r).otherwise(best)
    best = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), more)
    line = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
