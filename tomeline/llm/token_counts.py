"""Token counts under a unigram vocabulary, by a Viterbi pass that only counts.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; the
dynamic programme keeps, for each place, the best score and the pieces on the way
to it.  The rules are those of the public unigram tokenizer model with a
metaspace: each space starts a word and becomes U+2581, the text gets one in front
unless it starts with a space; candidates are taken in order of their start and
replace the best only if their score is greater, so of equal ones the longest last
piece stays; a character which is no piece costs UNKNOWN_COST less than the least
score, and counts as its bytes where the vocabulary has all byte pieces, else a run
of such characters as one.

Words repeat, so a task counts each distinct word of a slice once and keeps up to
CACHE_WORDS counts from slice to slice.  The vocabulary (not more than VOCABULARY
pieces) is read on the driver and broadcast; its path is a parameter.

Defined results: null or empty text: 0 tokens, score 0.0.  Rows are counted one by
one, so repeated or null doc_ids are fine.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectext import slices, span_hash, words

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
VOCABULARY = 1_000_000
UNKNOWN_COST = 10.0
CACHE_WORDS = 500_000
SPACE = "▁"

_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[32] = False


@dataclass
class Vocabulary:
    pieces: list[tuple[str, float]]

    def __post_init__(self):
        if len(self.pieces) > VOCABULARY:
            raise ValueError(f"more than {VOCABULARY} pieces")
        names = {p for p, _ in self.pieces}
        self.bytes_known = all(f"<0x{i:02X}>" in names for i in range(256))
        self.least = min((s for _, s in self.pieces), default=0.0)


def read_vocabulary(path: str = TOKENIZER) -> Vocabulary:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return Vocabulary([(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())])


class Counter:
    """Best score and number of pieces of single words."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            if piece:
                self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.single = {p for p, _ in vocabulary.pieces if len(p) == 1}
        self.unknown = vocabulary.least - UNKNOWN_COST
        self.bytes_known = vocabulary.bytes_known
        self.known: dict[bytes, tuple[int, float]] = {}

    def count(self, word: str) -> tuple[int, float]:
        n = len(word)
        score, pieces, odd = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        ends: list[list] = [[] for _ in range(n)]
        for end, match in self.find.iter(word):
            ends[end].append(match)
        for end in range(n):
            best, at = None, 0
            for size, value in sorted(ends[end], reverse=True):  # longest, so least start, first
                s = value + score[end + 1 - size]
                if best is None or s > best:
                    best, at = s, end + 1 - size
            strange = False
            if word[end] not in self.single:
                s = self.unknown + score[end]
                if best is None or s > best:
                    best, at, strange = s, end, True
            score[end + 1], odd[end + 1] = best, strange
            if not strange:
                pieces[end + 1] = pieces[at] + 1
            elif self.bytes_known:
                pieces[end + 1] = pieces[at] + len(word[end].encode())
            else:
                pieces[end + 1] = pieces[at] + (not odd[at])
        return pieces[n], score[n]

    def __call__(self, raw: bytes) -> tuple[int, float]:
        got = self.known.get(raw)
        if got is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            got = self.known[raw] = self.count(SPACE + raw.decode())
        return got


_COUNTERS: dict[int, Counter] = {}  # of this worker, by broadcast


def _counts(vocabulary):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(vocabulary.value)
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = Counter(vocabulary.value)
        counter = _COUNTERS[key]
        lone = counter(b"")
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"), made_of=_NOT_SPACE)
                size = w.end - w.start
                _, one, back = np.unique(span_hash(w.data[_NOT_SPACE[w.data]], size), return_index=True, return_inverse=True)
                raw = w.data.tobytes()
                got = [counter(raw[s:e]) for s, e in zip(w.start[one].tolist(), w.end[one].tolist())]
                n, score = np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got])
                rows = part.num_rows
                # Spaces that no word follows directly are words of their own.
                lonely = part.column("spaces").to_numpy() - w.counts + part.column("bare").to_numpy()
                tokens = np.bincount(w.row, n[back] if len(n) else None, minlength=rows) + lonely * lone[0]
                total = np.bincount(w.row, score[back] if len(n) else None, minlength=rows) + lonely * lone[1]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tokens.astype(np.int64)), pa.array(total)], schema=schema)

    return run


def token_counts(documents: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, score (of the best segmentation)."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary())
    text = F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(SPACE), F.lit(" "))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    bare = (F.col("text") != "") & ~F.startswith("text", F.lit(" "))
    docs = docs.select("doc_id", "text", F.regexp_count("text", F.lit(" ")).cast("long").alias("spaces"), bare.cast("long").alias("bare"))
    return docs.mapInArrow(_counts(shared), "doc_id long, n_tokens long, score double")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
