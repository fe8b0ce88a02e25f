"""Language identification of words and documents by a linear-chain CRF.

A chain is up to CHAIN consecutive letter runs of a text.  A word's score for a
language is the sum of learned weights of its features: the word itself (the
lexicon), its prefixes and suffixes of 1 to 3 bytes, and its byte 2- and 3-grams,
hashed into SLOTS weights.  Transition weights tie neighbours.  Forward-backward
gives every word's marginal probabilities; so code-switched text gets labels word
by word, and a document gets the language with the largest mean marginal.

Training is here, by stochastic gradient on the conditional log-likelihood.  The
sample is bounded: of each language the SAMPLE documents with the least hash of
doc_id, among those of up to SAMPLE_CHARS characters; a share of the chains is
spliced from two documents so that switches are seen.  Prediction covers every
whole text of every document, in numpy over Arrow batches; the weights are
broadcast (SLOTS x languages floats, whatever the input).

Defined results: null text, or no letter: language 'und', score 0.0.  No usable
training rows: the same for all.  Rows are predicted one by one, so repeated or
null doc_ids (never held out) are fine; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectext import mix, raw_bytes, slices, span_hash

CHAIN = 128
SLOTS = 2**17
SAMPLE = 400
SAMPLE_CHARS = 20_000
EPOCHS = 4
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # SLOTS x languages
    moves: np.ndarray  # languages x languages


def letter_runs(col: pa.Array):
    """Row, start and end of every run of letters, and the lower-cased bytes."""
    data, offs = raw_bytes(col)
    data = _LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, data
    ink = _LETTER[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    left, right = edge[:-1].copy(), edge[1:].copy()
    left[1:] |= ~ink[:-1]
    right[:-1] |= ~ink[1:]
    start = np.flatnonzero(ink & left)
    return np.searchsorted(offs, start, "right") - 1, start, np.flatnonzero(ink & right) + 1, data


def _slot(code: np.ndarray, kind: int) -> np.ndarray:
    return (mix(code.astype(np.uint64) + np.uint64(kind << 40)) % np.uint64(SLOTS)).astype(np.int64)


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, slot) of all features of all words."""
    size = end - start
    n = len(start)
    at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    c = data[at].astype(np.uint64)
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(n), size)
    left = np.repeat(first + size, size) - np.arange(len(c))  # bytes from here to the word's end
    pad = np.concatenate([c, np.zeros(3, np.uint64)])
    code = [c, c * 256 + pad[1:-2], (c * 256 + pad[1:-2]) * 256 + pad[2:-1]]
    words, slots = [np.arange(n)], [_slot(span_hash(data[at], size), 1)]
    for k in (1, 2, 3):
        long = np.flatnonzero(size >= k)
        words += [long, long]
        slots += [_slot(code[k - 1][first[long]], 10 + k), _slot(code[k - 1][first[long] + size[long] - k], 20 + k)]
        if k > 1:
            inside = np.flatnonzero(left >= k)
            words.append(word[inside])
            slots.append(_slot(code[k - 1][inside], 30 + k))
    return np.concatenate(words), np.concatenate(slots)


def scores(model_weights: np.ndarray, data, start, end) -> np.ndarray:
    """Emission scores of every word, computed once per distinct word."""
    n = len(start)
    if not n:
        return np.zeros((0, model_weights.shape[1]))
    size = end - start
    at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    _, one, back = np.unique(span_hash(data[at], size), return_index=True, return_inverse=True)
    word, slot = features(data, start[one], end[one])
    out = np.stack([np.bincount(word, model_weights[slot, j], minlength=len(one)) for j in range(model_weights.shape[1])], axis=1)
    return out[back]


def chains(row: np.ndarray, length: int = CHAIN):
    """Chain number and place of each word; the number of chains."""
    n = len(row)
    new = np.ones(n, bool)
    new[1:] = row[1:] != row[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    place = (np.arange(n) - first) % length
    return np.cumsum(place == 0) - 1, place


def forward_backward(emit: np.ndarray, chain: np.ndarray, place: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Marginal probabilities of each word.  Also right for one-word chains."""
    n, k = emit.shape
    if not n:
        return emit
    m, length = chain[-1] + 1, int(place.max()) + 1
    e = np.ones((length, m, k))
    e[place, chain] = np.exp(emit - emit.max(1, keepdims=True))
    size = np.bincount(chain, minlength=m)
    t = np.exp(moves - moves.max())
    a = np.empty_like(e)
    a[0] = e[0] / e[0].sum(1, keepdims=True)
    for i in range(1, length):
        a[i] = (a[i - 1] @ t) * e[i]
        a[i] /= a[i].sum(1, keepdims=True)
    b = np.ones((m, k)) / k
    out = np.empty_like(e)
    for i in range(length - 1, -1, -1):
        b[size - 1 == i] = 1.0 / k  # a chain's last word
        p = a[i] * b
        out[i] = p / p.sum(1, keepdims=True)
        b = (e[i] * b) @ t.T
        b /= b.sum(1, keepdims=True)
    return out[place, chain]


def _pair_sums(emit, chain, place, moves, label):
    """Expected minus observed transition counts, from pairwise marginals."""
    k = emit.shape[1]
    m, length = chain[-1] + 1, int(place.max()) + 1
    e = np.ones((length, m, k))
    e[place, chain] = np.exp(emit - emit.max(1, keepdims=True))
    size = np.bincount(chain, minlength=m)
    t = np.exp(moves - moves.max())
    a = np.empty_like(e)
    a[0] = e[0] / e[0].sum(1, keepdims=True)
    for i in range(1, length):
        a[i] = (a[i - 1] @ t) * e[i]
        a[i] /= a[i].sum(1, keepdims=True)
    b, total = np.ones((m, k)) / k, np.zeros((k, k))
    for i in range(length - 1, 0, -1):
        b[size - 1 == i] = 1.0 / k
        live = size > i
        p = a[i - 1][live][:, :, None] * t[None] * (e[i] * b)[live][:, None, :]
        total += (p / p.sum((1, 2), keepdims=True)).sum(0)
        b = (e[i] * b) @ t.T
        b /= b.sum(1, keepdims=True)
    pair = np.flatnonzero(place[1:] > 0)
    seen = np.bincount(label[pair] * k + label[pair + 1], minlength=k * k).reshape(k, k)
    return total - seen


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit the field to texts with one language each (and spliced chains of them)."""
    langs = sorted(set(labels))
    k = len(langs)
    number = {v: i for i, v in enumerate(langs)}
    row, start, end, data = letter_runs(pa.array(texts, pa.string()))
    label = np.array([number[v] for v in labels], np.int64)[row]
    model = Model(langs, np.zeros((SLOTS, k)), np.zeros((k, k)))
    if not len(row):
        return model
    rng = np.random.Generator(np.random.PCG64(seed))
    chain, _ = chains(row, CHAIN // 2)
    begin = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]])
    stop = np.r_[begin[1:], len(chain)]
    square, square_moves = np.full((SLOTS, k), 1e-3), np.full((k, k), 1e-3)
    for _ in range(epochs):
        order = rng.permutation(len(begin))
        for lo in range(0, len(order), 192):
            pick = order[lo : lo + 192]
            words, cuts = [], []
            spliced = rng.random(len(pick)) < 0.3
            for i, c in enumerate(pick):
                w = np.arange(begin[c], stop[c])
                if spliced[i]:
                    o = rng.integers(len(begin))
                    w = np.concatenate([w[: rng.integers(1, len(w) + 1)], np.arange(begin[o], stop[o])])
                words.append(w[:CHAIN])
                cuts.append(len(words[-1]))
            w = np.concatenate(words)
            cuts = np.array(cuts)
            ch = np.repeat(np.arange(len(cuts)), cuts)
            pl = np.arange(len(w)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            word, slot = features(data, start[w], end[w])
            emit = np.stack([np.bincount(word, model.weights[slot, j], minlength=len(w)) for j in range(k)], axis=1)
            grad = forward_backward(emit, ch, pl, model.moves)
            grad[np.arange(len(w)), label[w]] -= 1
            g = np.stack([np.bincount(slot, grad[word, j], minlength=SLOTS) for j in range(k)], axis=1) / len(cuts)
            gm = _pair_sums(emit, ch, pl, model.moves, label[w]) / len(cuts)
            square += g * g
            square_moves += gm * gm
            model.weights -= 0.1 * g / np.sqrt(square)
            model.moves -= 0.1 * gm / np.sqrt(square_moves)
    return model


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The bounded sample: at most sample rows a language, none held out."""
    usable = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & (F.length("text") <= SAMPLE_CHARS))
    first = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = usable.select("doc_id", "lang").withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample).select("doc_id", F.col("lang").alias("learned"))
    return usable.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id").where("lang = learned").select("text", "lang")


def fit(documents: DataFrame, sample: int = SAMPLE) -> Model | None:
    rows = training_rows(documents, sample).orderBy(F.xxhash64("text"), "lang").collect()  # bounded by sample x languages
    return train([r.text for r in rows], [r.lang for r in rows]) if rows else None


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                best, score = np.full(n, -1), np.zeros(n)
                count = np.zeros(n, np.int64)
                if m is not None:
                    row, start, end, data = letter_runs(part.column("text"))
                    chain, place = chains(row)
                    p = forward_backward(scores(m.weights, data, start, end), chain, place, m.moves)
                    count = np.bincount(row, minlength=n)
                    total = np.stack([np.bincount(row, p[:, j] if len(p) else None, minlength=n) for j in range(len(m.langs))], axis=1)
                    ok = (count > 0) & part.column("lettered").to_numpy(zero_copy_only=False)
                    mean = total / np.maximum(count, 1)[:, None]
                    best = np.where(ok, mean.argmax(1), -1)
                    score = np.where(ok, np.clip(mean.max(1), 0.0, 1.0), 0.0)
                names = [*(m.langs if m else []), UNKNOWN]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([names[i] for i in best], pa.string()), pa.array(score, pa.float64()), pa.array(count, pa.int64())], names=["key", "lang_pred", "score", "n_words"])

    return run


def predict(documents: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The documents' columns named in keep (default doc_id) with lang_pred, score, n_words."""
    keep = keep or ["doc_id"]
    key = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("key")
    docs = documents.select(key, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("key", "text", F.col("text").rlike(r"\p{L}").alias("lettered"))
    schema = T.StructType([T.StructField("key", docs.schema["key"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType())])
    out = docs.mapInArrow(_predict(documents.sparkSession.sparkContext.broadcast(model)), schema)
    return out.select(*[F.col("key").getField(c).alias(c) for c in keep], "lang_pred", "score", "n_words")


def _segments(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                row, start, end, data = letter_runs(part.column("text"))
                chain, place = chains(row)
                p = forward_backward(scores(m.weights, data, start, end), chain, place, m.moves)
                if not len(row):
                    continue
                lab = p.argmax(1)
                _, offs = raw_bytes(part.column("text"))
                point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before a byte
                new = np.r_[True, (row[1:] != row[:-1]) | (lab[1:] != lab[:-1])]
                first = np.flatnonzero(new)
                last = np.r_[first[1:], len(row)] - 1
                base = point[offs[:-1]][row[first]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row[first])), pa.array(point[start[first]] - base, pa.int64()), pa.array(point[end[last]] - base, pa.int64()), pa.array([m.langs[i] for i in lab[first]], pa.string()), pa.array(last - first + 1, pa.int64())],
                    names=["doc_id", "start", "stop", "lang", "words"],
                )

    return run


def language_segments(documents: DataFrame, model: Model) -> DataFrame:
    """Runs of words with one label: doc_id, start, stop (code points), lang, words."""
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.mapInArrow(_segments(documents.sparkSession.sparkContext.broadcast(model)), "doc_id long, start long, stop long, lang string, words long")


def op2_crf_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_words")
