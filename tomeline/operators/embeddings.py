"""Embedding cache, calls of an embedding function, and vector checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FLOAT_MAX = 3.4028234663852886e38


def embedding_key(text: Column, model: str, dims: int) -> Column:
    return F.concat_ws("|", F.lit(model), F.lit(str(dims)), F.sha2(text, 256))


def cache_lookup(texts: DataFrame, cache: DataFrame, model: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """-> hits (texts with their vector) and distinct misses (key, text)."""
    keyed = texts.withColumn("key", embedding_key(F.col("text"), model, dims))
    hits = keyed.join(cache.select("key", "embedding"), "key")
    return hits, keyed.join(cache.select("key"), "key", "left_anti").select("key", "text").dropDuplicates(["key"])


def cache_counts(texts: DataFrame, cache: DataFrame, model: str, dims: int) -> DataFrame:
    keyed = texts.select(embedding_key(F.col("text"), model, dims).alias("key"))
    known = cache.select("key", F.lit(True).alias("known"))
    return keyed.join(known, "key", "left").agg(F.count("known").alias("hits"), (F.count("*") - F.count("known")).alias("misses"))


def embed_missing(df: DataFrame, embed: Callable[[list[str]], list[list[float]]], dims: int, batch: int = 64) -> DataFrame:
    """key, embedding, error of df(key, text), through a batch function.

    A batch that fails is halved until the bad texts are alone; those get an error
    and no vector, as do vectors of the wrong length."""

    def call(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            got = embed(texts)
            if len(got) != len(texts):
                raise ValueError("as many vectors as texts are expected")
            return [(v, None) if len(v) == dims else (None, f"{len(v)} dimensions") for v in got]
        except Exception as e:
            if len(texts) == 1:
                return [(None, type(e).__name__)]
            half = len(texts) // 2
            return call(texts[:half]) + call(texts[half:])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), batch):
                part = f.iloc[lo : lo + batch]
                got = call(part["text"].tolist())
                yield pd.DataFrame({"key": part["key"].to_numpy(), "embedding": [v for v, _ in got], "error": [e for _, e in got]})

    return df.select("key", "text").mapInPandas(run, "key string, embedding array<float>, error string")


def letter_embedder(dims: int) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for a model: sums of character codes by place."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dims
            for i, c in enumerate(t):
                v[i % dims] += ord(c) / 1000
            out.append(v)
        return out

    return embed


def cache_merge(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by key: the row with the greatest at stays."""
    both = cache.unionByName(new)
    return both.groupBy("key").agg(F.max_by(F.struct("embedding", "at"), "at").alias("x")).select("key", "x.*")


def vector_fault(v: Column, dims: int) -> Column:
    """Why a vector can't be used, or null."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= FLOAT_MAX))
    return F.when(v.isNull(), "missing").when(F.size(v) != dims, "length").when(~finite, "not finite").when(~F.exists(v, lambda x: x != 0), "zero")


def l2_normalise(v: Column) -> Column:
    """Divided by the norm (in double precision); a zero vector stays."""
    wide = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def require_compatible(snapshot: DataFrame, model: str, dims: int, chunking: str) -> DataFrame:
    """One row with the reason why a snapshot can't serve these queries, or null."""
    s = snapshot.where("is_active").agg(F.count("*").alias("n"), F.max("embedding_model").alias("m"), F.max("embedding_dimensions").alias("d"), F.max("chunking_version").alias("c"))
    return s.select(F.when(F.col("n") == 0, "no snapshot").when(F.col("m") != model, "other model").when(F.col("d") != dims, "other width").when(F.col("c") != chunking, "other chunking").alias("reason"))


def recall_at_k(hits: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """Share of queries whose first k hits hold the gold text in a passage of the
    gold document.  hits: qid, rank, url, content; gold: qid, text, url."""
    g = gold.select("qid", F.col("text").alias("gold_text"), F.col("url").alias("gold_url"))
    found = g.join(hits.where(F.col("rank") <= k), "qid", "left").groupBy("qid").agg(F.max(F.coalesce(F.contains("content", "gold_text") & F.contains("url", "gold_url"), F.lit(False))).alias("found"))
    return found.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("found").cast("double")), 6).alias("recall"))
