"""Repeated byte strings by a distributed merge sort of suffixes that keeps common prefixes.

Suffixes begin at anchors: of each WINDOW bytes the ANCHOR-byte gram with the smallest hash (a
minimiser), so equal windows have equal anchors at equal places, and about one byte in eighty
begins a suffix.  Anchors whose hash occurs once in the corpus are in no repeated window and
stay out.  A suffix is the text from its anchor to the end of the last window with that anchor,
followed by what lies before the anchor, read backwards, to the start of the first one.

Each task sorts the suffixes of its slices of text and writes them front-coded: how many bytes a
suffix shares with the one before, and the rest.  Runs are exchanged by ranges of anchors, cut at
sampled ones, and each range is put together by a loser tree that carries common prefixes: of
two suffixes the one that shares more with the last output comes first, and only where they
share equally much are bytes compared, from there on.  The merged order tells, without another
comparison, equal suffixes (they share their whole length), whose windows are all repeated, and
suffixes with one anchor (they share ANCHOR bytes).  Of the latter, which differ somewhere, the
windows are held against one another within the group.

Very frequent anchors, by a sketch of constant size, are dealt by the whole suffix instead:
equal ones still meet, and windows of those that differ meet by a hash of window and place.

Scale: texts are shuffled to find the suffixes of repeated anchors and to cut out the spans.
A task holds slices and one range of runs; ranges are split by a hash of the anchor, so their
size doesn't grow with the input.  Of the corpus, the sketch and at most SAMPLE anchors reach the
driver.  Texts are taken whole, in pieces of PIECE windows.

Defined results: null or empty text: n_bytes 0 and no spans.  Shorter than WINDOW: nothing is
removed.  Null doc_id: the row is kept whole and compared with none.  Rows that repeat a doc_id
are one document: equal windows at equal places of it are the same.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sketch import BLOCK_ROWS, SKETCH, bitmap, blocks, counter, gathered, marked, perhaps
from .store import discard, materialise
from .vectext import BASE_A, BASE_B, grams, mix, raw_bytes, signed, slices, span_hash, text_lengths

WINDOW, ANCHOR = 200, 32
#: An anchor is very frequent if its counter is so much above the mean counter.
FREQUENT = 5_000
#: Windows of a text that are looked at together.
PIECE = 400_000
#: Anchors that the borders of ranges are chosen from, the most ranges, and about how many suffixes a range holds.
SAMPLE, RANGES, PER_RANGE = 65_536, 4_096, 8_000
#: Bytes of differing suffixes whose windows are compared together, if their anchors allow.
HELD = 1_000_000

_ORDER = (1 << 24) - 1
_NUMBERS = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 256, dtype=np.uint64)


def anchor_runs(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int):
    """Of each run of windows with one anchor: row, the anchor's place, the first and the last
    window (places in data), and the anchor's hash; piece by piece."""
    span, sizes = window - anchor + 1, np.diff(offsets)
    rows, ends = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.repeat(offsets[1:], sizes)
    for at in range(0, len(data) - window + 1, PIECE):
        d = data[at : at + PIECE + window - 1]
        g = grams(_NUMBERS[d], anchor, BASE_A)
        key = (g & np.uint64(2**64 - 1 - _ORDER)) | np.arange(len(g), dtype=np.uint64)
        wide = np.full(-(-len(key) // span) * span, 2**64 - 1, np.uint64)
        wide[: len(key)] = key
        wide = wide.reshape(-1, span)  # least of any span in a row by prefixes and suffixes of blocks
        ahead, behind = np.minimum.accumulate(wide, 1).ravel(), np.minimum.accumulate(wide[:, ::-1], 1)[:, ::-1].ravel()
        n = len(d) - window + 1
        least = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & np.uint64(_ORDER)).astype(np.int64)
        inside = np.flatnonzero(np.arange(at + window, at + window + n) <= ends[at : at + n])
        if not len(inside):
            continue
        least, first, row = least[inside], inside + at, rows[at : at + n][inside]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (first[1:] != first[:-1] + 1) | (row[1:] != row[:-1])
        new = np.flatnonzero(new)
        last = np.append(new[1:], len(least)) - 1
        yield row[new], least[new] + at, first[new], first[last], g[least[new]]


def _count(window: int, anchor: int):
    """Map: counters of the anchors of a task, as (block, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for *_, g in anchor_runs(*raw_bytes(part.column("text")), window, anchor):
                    total += np.bincount(counter(g), minlength=SKETCH)
        yield from blocks(total)

    return run


_ANCHORS = "key long, known boolean, doc_id long, place long, back int, windows int, often boolean, sample binary"


def _anchors(window: int, anchor: int, counts, frequent: int):
    """Map: the anchors of all windows.  Those which occur again in the same slice are known to
    be repeated; the first of a slice, with the key that it meets the other slices' by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = counts.value.mean() + frequent
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = raw_bytes(part.column("text"))
                ids = part.column("doc_id").to_numpy()
                for row, at, first, last, g in anchor_runs(data, offsets, window, anchor):
                    _, one, where, n = np.unique(g, return_index=True, return_inverse=True, return_counts=True)
                    often = counts.value[counter(g)] > high
                    head = np.zeros(len(g), bool)
                    head[one] = True
                    head &= ~often
                    key = np.where(head, signed(g), signed(mix(g + at.astype(np.uint64))))
                    sample = [data[a : a + anchor].tobytes() if chosen else None for a, chosen in zip(at, (mix(g) >> np.uint64(58)) == 0)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (key, (n[where] > 1) | often, ids[row], at - offsets[row], (at - first).astype(np.int32), (last - first + 1).astype(np.int32), often)] + [pa.array(sample, pa.binary())],
                        names=["key", "known", "doc_id", "place", "back", "windows", "often", "sample"],
                    )

    return run


def shared(a: bytes, b: bytes, at: int) -> int:
    """How many leading bytes a and b share, if they share at least at."""
    n = min(len(a), len(b))
    x, y = a[at:n], b[at:n]
    return n if x == y else n - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8


_RUN = pa.schema([("part", pa.int32()), ("prefix", pa.binary()), ("length", pa.binary()), ("rest", pa.binary()), ("shape", pa.binary()), ("owners", pa.binary()), ("owner", pa.binary())])
_RUN_DDL = "part int, prefix binary, length binary, rest binary, shape binary, owners binary, owner binary"


def coded(entries: list[tuple]) -> list[bytes]:
    """Sorted entries (suffix, back, windows, often, owners) as a front-coded run."""
    before, prefix, rest = b"", [], []
    for suffix, *_ in entries:
        p = shared(before, suffix, 0)
        prefix.append(p)
        rest.append(suffix[p:])
        before = suffix
    numbers = lambda x: np.array(x, np.int32).tobytes()
    owner = np.array([o for e in entries for o in e[4]], np.int64)
    return [numbers(prefix), numbers([len(r) for r in rest]), b"".join(rest), numbers([e[1:4] for e in entries]), numbers([len(e[4]) for e in entries]), owner.tobytes()]


def decoded(run: list[bytes]) -> Iterator[tuple]:
    """The entries of a run, each with the prefix it shares with the one before."""
    prefix, length, shape, owners = (np.frombuffer(run[i], np.int32).tolist() for i in (0, 1, 3, 4))
    rest, owner = run[2], np.frombuffer(run[5], np.int64).reshape(-1, 2)
    before, at, o = b"", 0, 0
    for i, (p, n, k) in enumerate(zip(prefix, length, owners)):
        before = before[:p] + rest[at : at + n]
        yield p, (before, shape[3 * i], shape[3 * i + 1]), shape[3 * i + 2], owner[o : o + k]
        at, o = at + n, o + k


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """All entries of the runs in order, each with the prefix it shares with the one before.

    Loser tree: a node keeps the run that lost there and the prefix which its first entry shares
    with the one that won, so after an output every entry's prefix is known against that output."""
    size = 1
    while size < len(runs):
        size *= 2
    done = (-1, None, None, None)
    heads = [next(r, done) for r in runs] + [done] * (size - len(runs))
    tree, level = [-1] * size, [-1] * size  # the loser of each node, and its prefix

    def play(run: int, p: int, node: int) -> tuple[int, int]:
        """The run goes up from a node as far as it can; what leaves the top."""
        while node:
            other, q = tree[node], level[node]
            if other == -1:  # nobody has come here yet
                tree[node], level[node] = run, p
                return -1, -1
            if p < q:
                tree[node], level[node], run, p = run, p, other, q
            elif p == q and p >= 0:
                a, b = heads[run][1], heads[other][1]
                m = shared(a[0], b[0], p)
                if (b[0][m:], *b[1:]) < (a[0][m:], *a[1:]):
                    tree[node], level[node], run = run, m, other
                else:
                    level[node] = m
            node //= 2
        return run, p

    top = (-1, -1)
    for run in range(size):
        top = play(run, 0 if heads[run][0] >= 0 else -1, (size + run) // 2)
    while top[1] >= 0:
        run, p = top
        yield p, *heads[run][1:]
        heads[run] = next(runs[run], done)
        top = play(run, heads[run][0], (size + run) // 2)


def _suffixes(window: int, borders, anchor: int, parts: int):
    """Map: the sorted, front-coded runs of a slice's suffixes, by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = raw_bytes(part.column("text"))
                data = data.tobytes()
                found: dict[tuple, list] = {}
                runs = part.column("runs")
                flat = runs.flatten()
                row = np.repeat(np.arange(part.num_rows), np.diff(runs.offsets.to_numpy()))
                place, back, windows, often = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("place", "back", "windows", "often"))
                at = offsets[row] + place
                for doc, p, a, b, w, o in zip(part.column("doc_id").to_numpy()[row].tolist(), place.tolist(), at.tolist(), back.tolist(), windows.tolist(), often.tolist()):
                    suffix = data[a : a - b + w - 1 + window] + data[a - b : a][::-1]
                    found.setdefault((suffix, b, w, o), []).append((doc, p))
                entries = [(*k, found[k]) for k in sorted(found)]
                if not entries:
                    continue
                whole = np.array([e[3] for e in entries], bool)
                dealt = [e[0] if e[3] else e[0][:anchor] for e in entries]
                sub = mix(span_hash(np.frombuffer(b"".join(dealt), np.uint8), np.array([len(x) for x in dealt])))
                ranges = np.searchsorted(borders.value, np.array([x[:anchor] for x in dealt], f"S{anchor}"), "right").astype(np.uint64)
                many = np.uint64(len(borders.value) + 1)
                number = np.where(whole, sub % (np.uint64(parts) * many), ranges * np.uint64(parts) + sub % np.uint64(parts)).astype(np.int32)
                o = np.argsort(number, kind="stable")
                cut = np.flatnonzero(np.append(True, number[o][1:] != number[o][:-1]))
                rows = [[int(number[o[i]]), *coded([entries[x] for x in o[i:j]])] for i, j in zip(cut, np.append(cut[1:], len(o)))]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _RUN)], schema=_RUN)

    return run


_SPANS = "doc_id long, start long, stop long, key long, known boolean"


def _distinct(entries: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct owners of all entries: the entry's number and the owner, in order, and how
    many of them each entry has."""
    owner = np.concatenate([a for e in entries for a in e[2]])
    entry = np.repeat(np.arange(len(entries)), [sum(map(len, e[2])) for e in entries])
    o = np.lexsort((owner[:, 1], owner[:, 0], entry))
    owner, entry = owner[o], entry[o]
    new = np.ones(len(o), bool)
    new[1:] = (entry[1:] != entry[:-1]) | (owner[1:] != owner[:-1]).any(1)
    return entry[new], owner[new], np.bincount(entry[new], minlength=len(entries))


def _windows(held: list[tuple], window: int) -> Iterator[pa.RecordBatch]:
    """Spans of the repeated windows among the held entries (entry, often, owners); of very
    frequent anchors also each window, once, with the key that it meets the other tasks' by."""
    if not held:
        return
    back, count = (np.array([e[0][i] for e in held], np.int64) for i in (1, 2))
    often = np.array([e[1] for e in held], bool)
    of, owners, many = _distinct(held)
    several, leads = many > 1, np.append(True, of[1:] != of[:-1])
    owner = owners[leads]
    texts = [s[len(s) - b :][::-1] + s[: len(s) - b] for (s, b, _), _, _ in held]
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum([0] + [len(t) for t in texts[:-1]])
    entry = np.repeat(np.arange(len(held)), count)
    nth = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
    key = mix(grams(_NUMBERS[data], window, BASE_B)[begin[entry] + nth] ^ mix((back[entry] - nth).astype(np.uint64)))
    _, one, where, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    again = (n[where] > 1) | several[entry]
    new = np.flatnonzero(again & ~np.concatenate([[False], again[:-1] & (entry[1:] == entry[:-1])]))
    end = np.flatnonzero(again & ~np.append(again[1:] & (entry[1:] == entry[:-1]), False))
    lo = owner[:, 1] - back
    yield _spans(owner[entry[new], 0], lo[entry[new]] + nth[new], lo[entry[end]] + nth[end] + window)
    yield _whole_spans(owners[~leads], back[of[~leads]], count[of[~leads]], window)
    one = one[often[entry[one]]]
    if len(one):
        yield _spans(owner[entry[one], 0], lo[entry[one]] + nth[one], lo[entry[one]] + nth[one] + window, signed(key[one]), again[one])


def _whole(entries: list[tuple], window: int) -> Iterator[pa.RecordBatch]:
    """The spans of entries with several owners, of which every window is repeated."""
    if entries:
        of, owner, many = _distinct(entries)
        back, count = (np.array([e[0][i] for e in entries], np.int64)[of] for i in (1, 2))
        some = many[of] > 1
        yield _whole_spans(owner[some], back[some], count[some], window)


def _whole_spans(owner, back, count, window: int) -> pa.RecordBatch:
    return _spans(owner[:, 0], owner[:, 1] - back, owner[:, 1] - back + count - 1 + window)


def _spans(doc, start, stop, key=None, known=None) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(stop), pa.nulls(n, pa.int64()) if key is None else pa.array(key), pa.nulls(n, pa.bool_()) if known is None else pa.array(known)], names=["doc_id", "start", "stop", "key", "known"])


def _one_order(runs: list[list[bytes]], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """The repeated windows of a range."""
    held, size, group, whole = [], 0, [], []

    def closed() -> None:
        """A group of one anchor is complete."""
        nonlocal size
        if len(group) > 1 or group and group[0][1]:
            held.extend(group)
            size += sum(len(e[0][0]) for e in group)
        elif group and (len(group[0][2]) > 1 or len(group[0][2][0]) > 1):  # equal suffixes only
            whole.append(group[0])
        group.clear()

    for p, entry, often, owners in merged([decoded(r) for r in runs]):
        if group and p == len(entry[0]) and entry == group[-1][0]:
            group[-1][2].append(owners)
            continue
        if group and (p < anchor or often):  # windows of a very frequent anchor meet later
            closed()
            if size > HELD or len(whole) > PER_RANGE:
                yield from _windows(held, window)
                yield from _whole(whole, window)
                held, size, whole = [], 0, []
        group.append([entry, often, [owners]])
    closed()
    yield from _windows(held, window)
    yield from _whole(whole, window)


def _ranges(window: int, anchor: int):
    """Reduce over rows sorted by part: the repeated windows of each part."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                number, *run = (c[i].as_py() for c in batch.columns)
                if number != part and runs:
                    yield from _one_order(runs, window, anchor)
                    runs = []
                part = number
                runs.append(run)
        yield from _one_order(runs, window, anchor)

    return mapped


def _borders(anchors: DataFrame, anchor: int, per_range: int) -> tuple[np.ndarray, int]:
    """Anchors that cut the order into ranges, and how many parts a range is split into."""
    many = anchors.count() // per_range + 1
    sample = anchors.where("sample IS NOT NULL AND NOT often").select("sample", F.xxhash64("sample", "doc_id").alias("by")).orderBy("by").limit(SAMPLE)
    drawn = np.sort(np.array([bytes(r.sample) for r in sample.collect()], f"S{anchor}"))  # SAMPLE rows at most
    ranges = min(many, RANGES)
    cut = drawn[(np.arange(1, ranges) * len(drawn)) // ranges] if len(drawn) else drawn
    return np.unique(cut), -(-many // ranges)


def repeated_spans(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, frequent: int = FREQUENT, per_range: int = PER_RANGE) -> DataFrame:
    """doc_id, start and stop (bytes of the UTF-8 text, stop exclusive) of stretches of windows that
    also start elsewhere; they overlap one another."""
    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = spark.sparkContext.broadcast(gathered(docs.mapInArrow(_count(window, anchor), BLOCK_ROWS), np.add))
    every = docs.mapInArrow(_anchors(window, anchor, counts, frequent), _ANCHORS)
    meet = W.partitionBy("key")
    often_enough = every.withColumn("n", F.count("*").over(meet)).withColumn("again", F.max("known").over(meet)).where("known OR again OR n > 1")
    anchors = materialise(often_enough.drop("key", "known", "n", "again"), "anchors")
    cut, parts = _borders(anchors, anchor, per_range)
    borders = spark.sparkContext.broadcast(cut)
    runs = anchors.groupBy("doc_id").agg(F.collect_set(F.struct("place", "back", "windows", "often")).alias("runs"))
    suffixes = perhaps(docs, anchors).join(runs.hint("merge"), "doc_id").select("doc_id", "text", "runs").mapInArrow(_suffixes(window, borders, anchor, parts), _RUN_DDL)
    found = materialise(suffixes.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_ranges(window, anchor), _SPANS), "spans")
    discard(anchors)
    one = found.where("key IS NOT NULL").withColumn("n", F.count("*").over(meet)).withColumn("again", F.max("known").over(meet)).where("again OR n > 1")
    return found.where("key IS NULL").select("doc_id", "start", "stop").unionByName(one.select("doc_id", "start", "stop"))


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map: each text without its spans."""
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = raw_bytes(part.column("text"))
            runs = part.column("runs")
            row = np.repeat(np.arange(part.num_rows), np.diff(runs.offsets.to_numpy()))
            flat = runs.flatten()
            at = offsets[row]
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, at + flat.field("start").to_numpy(), 1)
            np.add.at(change, at + flat.field("stop").to_numpy(), -1)
            gone = np.cumsum(change[:-1]) > 0
            left = np.add.reduceat(np.append(gone, False), np.minimum(offsets[:-1], len(data)), dtype=np.int64) * (np.diff(offsets) > 0)
            row_edge = np.zeros(len(data) + 1, bool)
            row_edge[offsets] = True
            start = np.flatnonzero(gone & (row_edge[:-1] | ~np.append(False, gone[:-1])))
            stop = np.flatnonzero(gone & (row_edge[1:] | ~np.append(gone[1:], False))) + 1
            of = np.searchsorted(offsets, start, "right") - 1
            lists = np.searchsorted(of, np.arange(part.num_rows + 1)).astype(np.int32)
            spans = pa.ListArray.from_arrays(lists, pa.StructArray.from_arrays([pa.array(start - offsets[of]), pa.array(stop - offsets[of])], names=["start", "stop"]))
            stays = data[~gone].tobytes()
            where = np.append(0, np.cumsum(np.diff(offsets) - left))
            kept = [stays[a:b] for a, b in zip(where[:-1].tolist(), where[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(left), spans, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def _uncut(bits):
    """Map: the texts that certainly have no spans, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            known = marked(bits.value, ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
            rest = batch.filter(pa.array(~known))
            for part in slices(rest, "text"):
                n = text_lengths(part.column("text"))
                none = pa.ListArray.from_arrays(np.zeros(part.num_rows + 1, np.int32), pa.array([], _SPAN))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(n * 0), none, part.column("text").fill_null("").cast(pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return run


def remove_repeated_bytes(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, frequent: int = FREQUENT, per_range: int = PER_RANGE) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (removed stretches as start and
    stop, maximal, in order) and kept (the remaining bytes)."""
    spans = materialise(repeated_spans(documents, window, anchor, frequent, per_range), "repeated")
    runs = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("runs"))
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    none = F.array().cast("array<struct<start:long,stop:long>>")
    whole = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary"
    shared = bitmap(spans)
    touched = perhaps(docs.where("doc_id is not null"), spans, shared).join(runs, "doc_id", "left").select("doc_id", "text", F.coalesce("runs", none).alias("runs"))
    return touched.mapInArrow(_cut, whole).unionByName(docs.mapInArrow(_uncut(shared), whole))  # most texts stay where they are


def op11_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    out = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
