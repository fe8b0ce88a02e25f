"""Substring deduplication by relative Lempel-Ziv factors.

Every document is a reference block of every later one.  The index of the
blocks is a distributed table of anchors: of each WINDOW consecutive words the
ANCHOR-word gram with the smallest hash (a minimiser), so any two equal windows
carry the same anchor at the same place, while only about one word in seven
starts an anchor.  A document is parsed against the whole index at once: each
run of windows sharing an anchor either equals the same run around an earlier
occurrence as a whole, and becomes part of a factor (start, length, reference,
reference start), or its anchor is known with other surroundings only.  The
latter are the factor boundaries; there the windows are compared one by one.
Pieces on one diagonal of one reference are put together, and each document is then
parsed greedily from left to right: the next factor is the one that reaches furthest.
The words that factors cover go.

Scale: rows are (anchor, context, doc, place), one shuffle by anchor and one of
the texts by document.  Each task first settles repetitions inside its own
slices of text, so that a passage which a third of all documents share reaches
the shuffle once per slice, not once per document.  Anchors that a sketch of constant
size shows to be very frequent (a phrase with ever other surroundings) are dealt by
context, and taken for boundaries; results are the same.  Nothing else is collected.

Defined results: null text or no words: n_words 0, nothing removed, digest of
the empty string.  Fewer than WINDOW words: nothing removed.  Null doc_id: the
row is neither a reference nor parsed.  Rows that repeat a doc_id are the same
document: equal windows at equal places of it are not earlier than one another,
and a factor holds for each of the rows.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sketch import BLOCK_ROWS, SKETCH, blocks, counter, gathered
from .store import materialise
from .vectext import BASE_A, BASE_B, RangeHash, grams, mix, signed, slices, table, words

WINDOW = 20
ANCHOR = 8
#: An anchor is very frequent if its counter is so much above the mean counter.
FREQUENT = 20_000

_RUNS = "anchor long, context long, doc_id long, place long, often boolean, done boolean, start int, windows int, ref_doc long, ref_start int"
_PIECES = "doc_id long, start int, windows int, ref_doc long, ref_start int, settled boolean"
_RUN_SCHEMA = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("often", pa.bool_()), ("done", pa.bool_()), ("start", pa.int32()), ("windows", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())])
_PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32()), ("settled", pa.bool_())])


def _leftmost_minimum(g: np.ndarray, n: int, span: int) -> np.ndarray:
    """Index of the smallest of g[i : i + span] for the first n values of i."""
    at = np.arange(len(g))
    have, width = 1, span
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        at = np.where(g[b] < g[a], b, a)
        have += step
    return at[:n]


def window_runs(w, window: int, anchor: int):
    """Anchor place, first and last window of each run of windows with one anchor."""
    n = len(w) - window + 1
    if n <= 0:
        return np.zeros((3, 0), np.int64), np.zeros(0, np.uint64)
    g = grams(w.hash, anchor, BASE_A)
    at = _leftmost_minimum(g, n, window - anchor + 1)
    inside = np.flatnonzero(w.row[:n] == w.row[window - 1 :])
    if not len(inside):
        return np.zeros((3, 0), np.int64), g
    at = at[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(inside)) - 1
    return np.stack([at[first], inside[first], inside[last]]), g


def _order(*keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys[::-1])


def _count(window: int, anchor: int):
    """Map: counters of the anchors of a task, as (block, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                (at, _, _), g = window_runs(words(part.column("text")), window, anchor)
                if len(at):
                    total += np.bincount(counter(g[at]), minlength=SKETCH)
        yield from blocks(total)

    return run


def _settled(key, context, doc, place, before, count, often, by_window: bool) -> pa.RecordBatch:
    """The rows of a slice for the anchor table: those which repeat an earlier one of the
    slice are settled (done), and dealt evenly."""
    o = _order(key, context, doc, place)
    key, context, doc, place, before, count, often = (x[o] for x in (key, context, doc, place, before, count, often))
    new = np.ones(len(o), bool)
    new[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
    done = ~new & ((doc != doc[head]) | (place != place[head]))
    keep = new | done
    key = np.where(often, signed(mix(key.view(np.uint64) ^ context.view(np.uint64))), key)
    return table({
        "anchor": np.where(done, signed(mix(key.view(np.uint64) + place.astype(np.uint64))), key)[keep],
        "context": context[keep], "doc_id": doc[keep], "place": (place if by_window else place * 4096 + before * 64 + count)[keep], "often": often[keep], "done": done[keep],
        "start": (place - before)[keep], "windows": count[keep], "ref_doc": doc[head][keep], "ref_start": (place[head] - before)[keep],
    }, _RUN_SCHEMA)


def _runs(window: int, anchor: int, counts, frequent: int):
    """Map: the anchor table, with repetitions inside a slice settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = counts.value.mean() + frequent
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"))
                (at, lo, hi), g = window_runs(w, window, anchor)
                if not len(at):
                    continue
                doc = part.column("doc_id").to_numpy(zero_copy_only=False)[w.row[at]]
                origin = (np.cumsum(w.counts) - w.counts)[w.row[at]]
                context = RangeHash(w.hash, BASE_B)(lo, hi + window)
                context = signed(mix(context + ((at - lo) * 64 + (hi - lo)).astype(np.uint64)))
                yield _settled(signed(g[at]), context, doc, at - origin, at - lo, hi - lo + 1, counts.value[counter(g[at])] > high, False)

    return run


def _later(batches: Iterator[pa.RecordBatch], by_window: bool) -> Iterator[pa.RecordBatch]:
    """Reduce over rows sorted by anchor, context, document, place: rows after
    the first of a context are settled; first rows of an anchor's several
    contexts are boundaries.  One row is carried from batch to batch."""
    last = None  # the latest first row of a context, as a tuple, and whether its anchor has shown another context
    pending = None  # set while that row's anchor has one context only and isn't a very frequent one

    def unpack(p):
        place = p // 4096
        return (place - p // 64 % 64, p % 64) if not by_window else (p, np.ones_like(p))

    for batch in batches:
        if not batch.num_rows:
            continue
        c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        done, often = c["done"], c["often"]
        if done.any():
            yield table({"doc_id": c["doc_id"][done], "start": c["start"][done], "windows": c["windows"][done], "ref_doc": c["ref_doc"][done], "ref_start": c["ref_start"][done], "settled": np.ones(done.sum(), bool)}, _PIECE_SCHEMA)
        a, x, d, p, often = (c[n][~done] for n in ("anchor", "context", "doc_id", "place", "often"))
        if not len(a):
            continue
        carried = last is not None
        if carried:
            a, x, d, p, often = (np.concatenate([[v], y]) for v, y in zip(last, (a, x, d, p, often)))
        n = len(a)
        new_a = np.ones(n, bool)
        new_a[1:] = a[1:] != a[:-1]
        new = new_a.copy()
        new[1:] |= x[1:] != x[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        start, count = unpack(p)
        copy = ~new & ((d != d[head]) | (p != p[head]))
        if copy.any():
            yield table({"doc_id": d[copy], "start": start[copy], "windows": count[copy], "ref_doc": d[head][copy], "ref_start": start[head][copy], "settled": np.ones(copy.sum(), bool)}, _PIECE_SCHEMA)
        if not by_window:
            group = np.cumsum(new_a) - 1
            several = np.bincount(group[new], minlength=group[-1] + 1) > 1
            if carried and pending is None:
                several[0] = True
            edge = new & (several[group] | often)
            if carried and pending is None:
                edge[0] = False
            if edge.any():
                yield table({"doc_id": d[edge], "start": start[edge], "windows": count[edge], "ref_doc": np.zeros(edge.sum(), np.int64), "ref_start": np.zeros(edge.sum(), np.int32), "settled": np.zeros(edge.sum(), bool)}, _PIECE_SCHEMA)
            pending = None if several[-1] or often[-1] else True
        h = head[-1]
        last = (a[h], x[h], d[h], p[h], often[h])


def _edge_windows(window: int):
    """Map: the single windows of a document's boundary runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"))
                origin = np.cumsum(w.counts) - w.counts
                runs = part.column("runs")
                row = np.repeat(np.arange(part.num_rows), np.diff(runs.offsets.to_numpy()))
                flat = runs.flatten()
                start, count = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("start", "windows"))
                row, place = np.repeat(row, count), np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
                one = np.unique(row * 2**40 + place)
                row, place = one >> 40, one & (2**40 - 1)
                at = origin[row] + place
                one = np.ones(len(at), np.int64)
                yield _settled(signed(grams(w.hash, window, BASE_A)[at]), signed(grams(w.hash, window, BASE_B)[at]), part.column("doc_id").to_numpy()[row], place, one * 0, one, np.zeros(len(at), bool), True)

    return run


def _by_anchor(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "anchor").sortWithinPartitions("anchor", "context", "doc_id", "place")


def pieces(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, frequent: int = FREQUENT) -> DataFrame:
    """Runs of windows that start earlier too: doc_id, start (word number),
    windows, ref_doc, ref_start."""
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = documents.sparkSession.sparkContext.broadcast(gathered(docs.mapInArrow(_count(window, anchor), BLOCK_ROWS), np.add))
    first = _by_anchor(docs.mapInArrow(_runs(window, anchor, counts, frequent), _RUNS))
    found = materialise(first.mapInArrow(lambda b: _later(b, False), _PIECES), "factors")
    edges = found.where("not settled").groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    single = docs.join(edges, "doc_id").select("doc_id", "text", "runs").mapInArrow(_edge_windows(window), _RUNS)
    more = _by_anchor(single).mapInArrow(lambda b: _later(b, True), _PIECES)
    return found.where("settled").unionByName(more).drop("settled")


def greedy(start: np.ndarray, windows: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray, window: int) -> list[np.ndarray]:
    """The factors (start, length, ref_doc, ref_start) of a document, from its pieces:
    pieces that touch on a diagonal are one, and the parse takes, from left to right, what
    reaches furthest (of equals, what starts first, then the least reference)."""
    shift = ref_start - start
    o = np.lexsort((start, shift, ref_doc))
    start, stop, ref_doc, shift = start[o], (start + windows)[o], ref_doc[o], shift[o]
    line = np.ones(len(o), bool)
    line[1:] = (ref_doc[1:] != ref_doc[:-1]) | (shift[1:] != shift[:-1])
    group = np.cumsum(line) - 1
    # Within a diagonal a piece goes on the one before if it starts where that has reached.
    wide = int(stop.max(initial=0)) + 1
    reach = np.maximum.accumulate(stop + group * wide) - group * wide
    new = line.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    first, reach, ref, shift = start[at], np.maximum.reduceat(stop, at) if len(at) else stop, ref_doc[at], shift[at]
    o = np.lexsort((ref, -reach, first))
    out, end, i = [], -1, 0
    while i < len(o):
        best = o[i]
        j = i + 1  # all that start within what is covered so far, or where the first uncovered one does
        limit = max(end, int(first[o[i]]))
        while j < len(o) and first[o[j]] <= limit:
            if reach[o[j]] > reach[best]:
                best = o[j]
            j += 1
        i = j
        if reach[best] > end:
            out.append(best)
            end = int(reach[best])
    k = np.array(out, np.int64)
    return [first[k], reach[k] - first[k] + window - 1, ref[k], first[k] + shift[k]]


def _parsed(window: int):
    """Map: the factors of each document's pieces."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ref_doc", pa.int64()), ("ref_start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, runs in zip(batch.column("doc_id").to_pylist(), batch.column("runs")):
                found = greedy(*_columns(runs.values), window)
                yield table({"doc_id": np.full(len(found[0]), doc), "start": found[0], "length": found[1], "ref_doc": found[2], "ref_start": found[3]}, schema)

    return run


def _columns(runs: pa.StructArray) -> list[np.ndarray]:
    return [runs.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("start", "windows", "ref_doc", "ref_start")]


def _by_document(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows", "ref_doc", "ref_start")).alias("runs"))


def factors(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, frequent: int = FREQUENT) -> DataFrame:
    """The duplicate factors: doc_id, start and length in words, ref_doc, ref_start."""
    return _by_document(pieces(documents, window, anchor, frequent)).mapInArrow(_parsed(window), "doc_id long, start long, length long, ref_doc long, ref_start long")


def _kept(window: int):
    """Map: each text without the words of its factors."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = [[], [], []]
                for text, runs in zip(part.column("text"), part.column("runs")):
                    ws = (text.as_py() or "").encode().split()  # bytes: splits at the six ASCII white space characters
                    runs = runs.values if runs.is_valid else None
                    gone = 0
                    kept = ws
                    if runs is not None and len(runs):
                        cover = np.zeros(len(ws) + 1, np.int64)
                        s, length, _, _ = greedy(*_columns(runs), window)
                        np.add.at(cover, s, 1)
                        np.add.at(cover, np.minimum(s + length, len(ws)), -1)
                        covered = np.cumsum(cover[:-1]) > 0
                        gone = int(covered.sum())
                        kept = [ws[i] for i in np.flatnonzero(~covered)]
                    for o, v in zip(out, (len(ws), gone, b" ".join(kept).decode())):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(o, f.type) for o, f in zip(out, list(schema)[1:]))], schema=schema)

    return run


def remove_repeats(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left,
    joined by one space)."""
    runs = _by_document(pieces(documents, window, anchor, frequent))
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.join(runs, "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept string")


def op3_rlz_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
