"""Terms of a dictionary in texts: as whole words, or anywhere.

Terms are read in shards of at most SHARD; each shard goes to the tasks as a list, is built
once a worker into a trie of words or an automaton of characters, and every text is read once
for it, so a text costs its length and its matches, however many terms there are.  Texts
aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words

#: Terms that a task holds at a time; more go in further passes over the texts.
SHARD = 200_000
_END = ""  # no word is empty


def _shards(terms: DataFrame, shard: int) -> list:
    """Broadcasts of the distinct terms (one column), at most about shard of them each."""
    one = terms.distinct()
    n = -(-one.count() // shard)
    name = one.columns[0]
    parts = [one if n == 1 else one.where(F.pmod(F.xxhash64(name), F.lit(n)) == i) for i in range(n)]
    return [terms.sparkSession.sparkContext.broadcast(sorted(r[0] for r in p.collect())) for p in parts]  # about shard rows each


def word_trie(terms: list[str]) -> dict:
    """Nested dictionaries by word; the term stands under _END."""
    root: dict = {}
    for t in terms:
        node = root
        for w in t.split(" "):
            node = node.setdefault(w, {})
        node[_END] = t
    return root


def found_words(trie: dict, tokens: list[str]) -> Iterator[tuple[str, int, int]]:
    """Every term that stands in tokens, with its first word's number and its number of words."""
    for at, w in enumerate(tokens):
        node, n = trie.get(w), 0
        while node is not None:
            n += 1
            if _END in node:
                yield node[_END], at, n
            node = node.get(tokens[at + n]) if at + n < len(tokens) else None


def _read(shared, build, find, column: str, carried: list[str], out: pa.Schema):
    """Map: for each row of the carried columns, what find gives for its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            known = known if known is not None else build(shared.value)
            row, rest = [], []
            for i, text in enumerate(batch.column(column)):
                if text.is_valid:
                    for x in find(known, text.as_py()):
                        row.append(i)
                        rest.append(x)
            if row:
                kept = batch.select(carried).take(pa.array(row, pa.int64()))
                more = [pa.array(v, f.type) for v, f in zip(zip(*rest), list(out)[len(carried) :])]
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(kept.columns, out)), *more], schema=out)

    return run


def _matched(texts: DataFrame, column: str, terms: DataFrame, build, find, more: list[T.StructField], shard: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    carried = [f for f in texts.schema if f.name != column]
    out = T.StructType([*carried, *more])
    schema, names = to_arrow_schema(out), [f.name for f in carried]
    parts = [texts.mapInArrow(_read(s, build, find, column, names, schema), out) for s in _shards(terms, shard)]
    return reduce(DataFrame.unionByName, parts) if parts else texts.sparkSession.createDataFrame([], out)


def occurrences(texts: DataFrame, terms: DataFrame, before: int = 0, shard: int = SHARD) -> DataFrame:
    """Every occurrence of a term as whole words: the columns of texts but text, and term (its
    words, in lower case, with one space), at (word number), n (words) and before (so many
    words before it).  terms: one column.  Letter case and what stands between words make no
    difference; null texts and terms without words match nothing."""
    name = terms.columns[0]
    plain = terms.select(F.array_join(words(F.col(name)), " ").alias("term")).where("term != ''")

    def find(trie, tokens):
        for term, at, n in found_words(trie, tokens):
            yield term, at, n, tokens[max(0, at - before) : at]

    more = [T.StructField("term", T.StringType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType()), T.StructField("before", T.ArrayType(T.StringType()))]
    return _matched(texts.withColumn("text", words(F.col("text"))), "text", plain, word_trie, find, more, shard)


def with_terms(found: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    """Occurrences with the dictionary's rows whose column has the term's words."""
    return found.join(dictionary.withColumn("term", F.array_join(words(F.col(column)), " ")), "term") if column != "term" else found.withColumnRenamed("term", "said").join(dictionary.withColumn("said", F.array_join(words(F.col("term")), " ")), "said").drop("said")


def longest(found: DataFrame, key: str) -> DataFrame:
    """Occurrences that lie in no other, longer one of their text."""
    end = F.col("at") + F.col("n")
    w = W.partitionBy(key).orderBy("at", F.desc("n")).rowsBetween(W.unboundedPreceding, -1)
    return found.withColumn("reach", F.max(end).over(w)).where(F.col("reach").isNull() | (F.col("reach") < end)).drop("reach")


def _automaton(terms: list[str]):
    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    a.make_automaton()
    return a


def containing(texts: DataFrame, column: str, terms: DataFrame, shard: int = SHARD) -> DataFrame:
    """Every text and term (one column) where the text's column contains the term, once: the
    other columns of texts, and term.  Case counts; empty and null terms match nothing."""
    name = terms.columns[0]
    plain = terms.select(F.col(name).alias("term")).where("term != ''")
    find = lambda a, text: ((t,) for t in sorted({t for _, t in a.iter(text)}))
    return _matched(texts, column, plain, _automaton, find, [T.StructField("term", T.StringType())], shard)
