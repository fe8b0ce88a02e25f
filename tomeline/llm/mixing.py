"""Mixing sources to target weights, by whole blocks of tokens.

1. Targets.  Sources in order of code point (null last) weigh 5, 2, 1, 5, 2, ...
   They share SHARE times all words, none taking more than REPEAT times its own
   words; what is above that is shared again by weight.  The fixed point is
   min(cap, level * weight), and the level is found with two running sums.
2. Packing.  Each source's documents are laid end to end, in an order that
   follows from a hash of doc_id and text, and cut into blocks of BLOCK words.  The places
   are prefix sums in two levels (bucket, then inside a bucket), so a source that
   holds a third of all rows is many small groups.
3. Draws.  A source's slots are its target in blocks.  Every output shard has
   SHARD_SLOTS slots (the last one what is left), and a multinomial draw says how many of
   them each source gets; its weights are what the sources have left of their targets,
   and what it gives a source above that is drawn again, so the targets are met to the
   block.  A node of shards draws for up to FAN children, and so on until single shards
   are left.  A slot's number goes through the pseudorandom permutation of its source
   and epoch, so a block is taken again only when all have been.
4. Join of slots and packed pieces on (source, block).

All numbers come from hashes of SEED, source and place: reruns agree.

Defined results: null text has size 0.  A document without words has taken 0.
Null source is a source.  Null doc_id is packed like any other value.  Rows that
repeat a doc_id are packed one after the other; among fully equal rows it is open
which one takes which share.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import materialise
from .vectext import mix as scramble
from .vectext import table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEAT = 2
BLOCK = 64
SHARD_SLOTS = 4096
FAN = 64
BUCKET_ROWS = 10_000
SEED = 20_240_501
WORD = r"[^\x20\x09-\x0D]+"


def sizes(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text", F.lit(SEED)).alias("sign"))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: float = REPEAT) -> DataFrame:
    """source, sid, source_size, source_rows, target."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    # A row per source: these windows see the sources, not the documents.
    s = s.withColumn("sid", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(repeat)).withColumn("ratio", F.col("cap") / F.col("w"))
    by = W.orderBy("ratio", "sid")
    spent = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weight = F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy()) * float(share)
    s = s.withColumn("level", (total - spent) / weight)
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "sid", "level"))).over(W.partitionBy())["level"]
    return s.select("source", "sid", "source_size", "source_rows", F.coalesce(F.least("cap", level * F.col("w")), "cap").alias("target"))


def packed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """The documents with their place in their source: sid, doc_id, size, source_size, target, first."""
    d = sized.withColumnRenamed("source", "s").join(sources, F.col("s").eqNullSafe(F.col("source")))
    d = d.withColumn("bucket", F.pmod("sign", F.floor(F.col("source_rows") / BUCKET_ROWS) + 1))
    sums = d.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    base = sums.select("sid", "bucket", (F.sum("n").over(W.partitionBy("sid").orderBy("bucket")) - F.col("n")).alias("base"))
    inside = F.sum("size").over(W.partitionBy("sid", "bucket").orderBy("sign", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("inside", inside - F.col("size")).join(base, ["sid", "bucket"])
    return d.select("sid", "source", "doc_id", "size", "source_size", "target", (F.col("base") + F.col("inside")).alias("first"))


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document and block that it reaches into: row, sid, block, words, from_word."""
    p = placed.where("size > 0").select("*", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"(first + size - 1) div {block}"))).alias("block"))
    lo = F.greatest(F.col("first"), F.col("block") * block)
    hi = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block)
    return p.select("row", "sid", "block", (hi - lo).alias("words"), (lo - F.col("first")).alias("from_word"))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """index -> a pseudorandom permutation of 0 .. n - 1 that key picks: four
    Feistel rounds on the least even number of bits, walked until inside."""
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2)).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out = index.astype(np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo]
        left, right = out[todo] >> b, out[todo] & m
        for r in range(4):
            left, right = right, left ^ (scramble(right ^ k + np.uint64(0x9E37 + r)) & m)
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


_NODE = "shard long, shards long, sources array<struct<sid:int,blocks:long,at:long,slots:long>>"
_SOURCE = pa.struct([("sid", pa.int32()), ("blocks", pa.int64()), ("at", pa.int64()), ("slots", pa.int64())])
_NODE_SCHEMA = pa.schema([("shard", pa.int64()), ("shards", pa.int64()), ("sources", pa.list_(_SOURCE))])


def draw_counts(rng: np.random.Generator, size: int, left: np.ndarray) -> np.ndarray:
    """How many of size slots each source gets: a multinomial draw by what they have left.
    What goes beyond that is drawn again among the others."""
    got = np.zeros(len(left), np.int64)
    while size:
        open_ = left - got
        got = got + rng.multinomial(size, open_ / open_.sum())
        size = int(np.maximum(got - left, 0).sum())
        got = np.minimum(got, left)
    return got


def _deal(seed: int, size: int):
    """Map: deal the slots of each node of shards to its children, size to each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, shards = batch.column("shard")[i].as_py(), batch.column("shards")[i].as_py()
                s = batch.column("sources")[i].values
                sid, blocks, at, left = (s.field(n).to_numpy(zero_copy_only=False) for n in ("sid", "blocks", "at", "slots"))
                n = min(FAN, shards)
                width = np.diff(np.linspace(0, shards, n + 1).astype(np.int64))
                rng = np.random.Generator(np.random.Philox(key=[seed, shard * 64 + int(shards).bit_length()]))
                for w in width:
                    got = draw_counts(rng, min(int(w) * size, int(left.sum())), left)
                    some = np.flatnonzero(got)
                    part = pa.StructArray.from_arrays([pa.array(c[some]) for c in (sid, blocks, at, got)], fields=list(_SOURCE))
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([w], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), part)], schema=_NODE_SCHEMA)
                    shard, at, left = shard + int(w), at + got, left - got

    return run


def _take(seed: int):
    """Map: the block that each slot takes."""
    schema = pa.schema([("shard", pa.int64()), ("sid", pa.int32()), ("slot", pa.int64()), ("block", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a shard's slots, SHARD_SLOTS at most
                s = batch.column("sources")[i].values
                sid, blocks, at, count = (s.field(n).to_numpy(zero_copy_only=False) for n in ("sid", "blocks", "at", "slots"))
                k = np.repeat(at - np.cumsum(count) + count, count) + np.arange(count.sum())
                sid, n = np.repeat(sid, count), np.repeat(blocks, count)
                key = scramble((k // n).astype(np.uint64) + (sid.astype(np.uint64) + np.uint64(seed)) * np.uint64(2**20))
                yield table({"shard": np.full(len(k), batch.column("shard")[i].as_py()), "sid": sid, "slot": k, "block": permuted(k % n, n, key)}, schema)

    return run


def slots(sources: DataFrame, block: int = BLOCK, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix: shard, sid, slot (number within the source), block."""
    n = F.ceil(F.col("source_size") / block)
    # Whole epochs, and of the last one as many blocks as come nearest.
    epochs = F.floor(F.col("target") / F.col("source_size"))
    rest = F.round((F.col("target") - epochs * F.col("source_size")) * n / F.col("source_size"))
    s = sources.where("source_size > 0").select("sid", n.cast("long").alias("blocks"), (epochs * n + rest).cast("long").alias("slots"))
    total = s.agg(F.ceil(F.coalesce(F.sum("slots"), F.lit(0)) / shard_slots).cast("long").alias("shards"))
    shards = total.first()["shards"]  # one number
    every = F.array_sort(F.collect_list(F.struct(F.col("sid").cast("int").alias("sid"), "blocks", F.lit(0).cast("long").alias("at"), "slots")))
    nodes = s.where("slots > 0").agg(every.alias("sources")).where("size(sources) > 0").select(F.lit(0).cast("long").alias("shard"), F.lit(shards).cast("long").alias("shards"), "sources")
    width = shards
    while True:
        nodes = nodes.mapInArrow(_deal(seed, shard_slots), _NODE)
        width = -(-width // FAN)
        nodes = nodes.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")
        if width <= 1:
            break
    return nodes.mapInArrow(_take(seed), "shard long, sid int, slot long, block long")


def mix(documents: DataFrame, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """-> placed documents (with a row number), their pieces, the slots."""
    sized = materialise(sizes(documents), "sizes")
    sources = materialise(source_targets(sized), "sources")
    placed = packed(sized, sources).withColumn("row", F.struct("sid", "first", "size", "doc_id"))
    placed = materialise(placed, "placed")
    return placed, pieces(placed, block), slots(sources, block, seed)


def mixed_pieces(documents: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix itself: shard, source number, slot, doc_id, from_word, words, in
    order of nothing.  Sorting by (shard, slot) lays the blocks out."""
    _, part, slot = mix(documents, block, seed)
    return slot.join(part, ["sid", "block"]).select("shard", "sid", "slot", "block", F.col("row.doc_id").alias("doc_id"), "from_word", "words")


def taken_words(documents: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    placed, part, slot = mix(documents, block, seed)
    times = slot.groupBy("sid", "block").agg(F.count("*").alias("times"))
    # Pieces outgrow the small table that they come from, by which a broadcast would be judged.
    took = part.hint("merge").join(times, ["sid", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    # Documents without words share a row key; they take nothing, so they need no join.
    full = placed.where("size > 0").join(took, "row", "left")
    out = full.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    return out.unionByName(placed.where("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def op9_source_mixing(spark, sf_dir: str) -> DataFrame:
    return taken_words(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
