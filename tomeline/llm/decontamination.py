"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Seeds.  The GRAM-word grams of the benchmark items are counted over the whole
   corpus (documents that hold them).  An item's seeds are its grams that are not
   common: held by at most COMMON times as many documents as three quarters of its
   grams that occur at all, and always the LEAST_SEEDS rarest.  The choice is
   relative to the item, so one that leaked into a third of all documents, whole or
   edited, still has its seeds.
2. Candidates.  Documents and items that share two seed places (one, if the item
   has fewer than LEAST_SEEDS grams).
3. Alignment.  Around the places the document's words are aligned locally with
   the item (match +2, mismatch -1, gap -1).  score is the best alignment over
   that of the item with itself, so an exact copy has 1.0, and a copy with a
   fifth of the words replaced about 0.7.  From MATCH on it is a leak.

Words are runs of letters, digits and other non-ASCII characters, with A-Z in
lower case; punctuation and white space don't matter.

Scale: the item grams are broadcast only while they are at most GRAMS_AT_MOST
(8 bytes each); beyond that the documents' grams are joined with them by a
shuffle, with the same result.  Of the texts only those of candidates are shuffled for
the alignment, once, by document.

Defined results: null or empty texts match nothing; an item of fewer than GRAM
words matches nothing.  Null doc_id or item_id: left out.  Rows that repeat a
doc_id or item_id give one row with the best score.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sketch import perhaps
from .store import materialise
from .vectext import ALNUM, BASE_A, grams, signed, slices, table, words

GRAM = 3
LEAST_SEEDS = 8
COMMON = 4
MATCH = 0.5
GRAMS_AT_MOST = 1_000_000


def _grams(id_name: str, k: int, wanted=None):
    """Map: (id, gram, place) of all k-word grams, or of the wanted ones."""
    schema = pa.schema([(id_name, pa.int64()), ("gram", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else wanted.value
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"), True, ALNUM)
                g = signed(grams(w.hash, k, BASE_A))
                ok = w.row[: len(g)] == w.row[k - 1 :] if len(g) else np.zeros(0, bool)
                if known is not None and len(known) and len(g):
                    at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                    ok = ok & (known[at] == g)
                elif known is not None:
                    ok = np.zeros(len(g), bool)
                at = np.flatnonzero(ok)
                first = np.cumsum(w.counts) - w.counts
                yield table({id_name: part.column("id").to_numpy()[w.row[at]], "gram": g[at], "place": at - first[w.row[at]]}, schema)

    return run


def _texts(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(name).isNotNull() & F.col("text").isNotNull()).select(F.col(name).cast("long").alias("id"), F.col("text").cast("string").alias("text"))


def candidates(documents: DataFrame, benchmark: DataFrame, k: int = GRAM, at_most: int = GRAMS_AT_MOST) -> DataFrame:
    """doc_id, item_id, hits: places of shared seeds (in the document, in the item)."""
    spark = documents.sparkSession
    items = materialise(_texts(benchmark, "item_id").mapInArrow(_grams("item_id", k), "item_id long, gram long, place long"), "item-grams")
    distinct = items.select("gram").distinct()
    docs = _texts(documents, "doc_id")
    schema = "doc_id long, gram long, place long"
    if distinct.limit(at_most + 1).count() <= at_most:
        known = np.sort(np.array([r.gram for r in distinct.collect()], np.int64))  # at most at_most
        hits = docs.mapInArrow(_grams("doc_id", k, spark.sparkContext.broadcast(known)), schema)
    else:
        hits = docs.mapInArrow(_grams("doc_id", k), schema).join(distinct, "gram").select("doc_id", "gram", "place")
    hits = materialise(hits, "gram-hits")
    held = hits.select("gram", "doc_id").distinct().groupBy("gram").agg(F.count("*").alias("held"))
    seeds = items.groupBy("item_id", "gram").agg(F.collect_set("place").alias("at")).join(held, "gram")
    usual = seeds.groupBy("item_id").agg(F.percentile("held", 0.75).alias("usual"))
    nth = F.row_number().over(W.partitionBy("item_id").orderBy("held", "gram"))
    seeds = seeds.join(usual, "item_id").withColumn("nth", nth).where((F.col("held") <= COMMON * F.col("usual")) | (F.col("nth") <= LEAST_SEEDS)).select("item_id", "gram", F.explode("at").alias("at"))
    both = hits.join(seeds, "gram").groupBy("doc_id", "item_id").agg(F.collect_set(F.struct("place", "at")).alias("hits"))
    words_of = items.groupBy("item_id").agg(F.count("*").alias("grams"))
    return both.join(words_of, "item_id").where((F.size("hits") >= 2) | (F.col("grams") < LEAST_SEEDS)).select("doc_id", "item_id", "hits")


def align(doc: np.ndarray, item: np.ndarray) -> tuple[float, int]:
    """Best local alignment score of two word sequences, and where in doc it ends."""
    n = len(doc)
    j = np.arange(n)
    h, best, end = np.zeros(n), 0.0, 0
    for w in item:
        t = np.where(doc == w, 2.0, -1.0)
        t[1:] += h[:-1]
        np.maximum(t, h - 1.0, out=t)
        np.maximum(t, 0.0, out=t)
        h = np.maximum.accumulate(t + j) - j  # gaps along the document
        top = int(h.argmax())
        if h[top] > best:
            best, end = float(h[top]), top + 1
    return best, end


def _score(least: float):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                d, b = words(part.column("text"), True, ALNUM), words(part.column("item_text"), True, ALNUM)
                d_at, b_at = np.cumsum(d.counts) - d.counts, np.cumsum(b.counts) - b.counts
                out = {f.name: [] for f in schema}
                hits = part.column("hits")
                offs, flat = hits.offsets.to_numpy(), hits.flatten()
                places, ats = (flat.field(n).to_numpy() for n in ("place", "at"))
                offs = offs - offs[0]
                for i, (doc_id, item_id) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("item_id").to_pylist())):
                    item = b.hash[b_at[i] : b_at[i] + b.counts[i]]
                    doc = d.hash[d_at[i] : d_at[i] + d.counts[i]]
                    m = len(item)
                    first = np.unique(places[offs[i] : offs[i + 1]] - ats[offs[i] : offs[i + 1]])
                    lo, hi = np.maximum(first - m // 2, 0), np.minimum(first + m + m // 2, len(doc))
                    best = (0.0, 0, 0)
                    k = 0
                    while k < len(lo):  # overlapping stretches are aligned once
                        e = k
                        while e + 1 < len(lo) and lo[e + 1] <= hi[e]:
                            e += 1
                        best = max(best, (*align(doc[lo[k] : hi[e]], item), int(lo[k])))
                        k = e + 1
                    if best[0] >= least * 2 * m:
                        stop = best[1] + best[2]
                        head = doc[best[2] : stop][::-1]
                        out["doc_id"].append(doc_id)
                        out["item_id"].append(item_id)
                        out["score"].append(best[0] / (2 * m))
                        out["start"].append(stop - align(head, item[::-1])[1])
                        out["stop"].append(stop)
                yield pa.RecordBatch.from_pydict({n: pa.array(v, schema.field(n).type) for n, v in out.items()}, schema=schema)

    return run


def contaminated(documents: DataFrame, benchmark: DataFrame, match: float = MATCH, k: int = GRAM, at_most: int = GRAMS_AT_MOST) -> DataFrame:
    """One row per leaked item and document: doc_id, item_id, score, start, stop
    (words of the document)."""
    found = materialise(candidates(documents, benchmark, k, at_most), "candidates")
    items = _texts(benchmark, "item_id").select(F.col("id").alias("item_id"), F.col("text").alias("item_text"))
    docs = _texts(documents, "doc_id").withColumnRenamed("id", "doc_id")
    rows = found.join(items, "item_id").join(perhaps(docs, found), "doc_id").select("doc_id", "item_id", "text", "item_text", "hits")
    scored = rows.mapInArrow(_score(match), "doc_id long, item_id long, score double, start long, stop long")
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("start")).alias("s"), "stop")).alias("x"))
    return best.select("doc_id", "item_id", "x.score", (-F.col("x.s")).alias("start"), "x.stop")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
