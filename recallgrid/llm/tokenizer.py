"""Encoding of texts with a public byte-level BPE vocabulary.

Method: contiguous rank array. A word's part boundaries and the ranks of its
adjacent parts lie in two flat lists; the smallest rank is found by scanning,
its boundary deleted and the two neighbouring ranks refreshed. Words over
SHORT bytes, where repeated scans would cost the square of the length, take a
heap over the same merges; the ids are the same.

Defined results: null and empty texts give an empty list; texts are taken as
they stand, strings of special tokens are ordinary text; texts of any length
are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabulary lies; a parameter of everything below.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are split into words (fixed value of the vocabulary); white space is the Unicode property.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SHORT = 48
#: Words whose ids a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 200_000
NONE = 1 << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by scanning its contiguous rank array."""
    get = ranks.get
    at = list(range(len(word) + 1))
    pair = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while pair:
        least = min(pair)
        if least == NONE:
            break
        i = pair.index(least)
        del at[i + 1], pair[i]
        if i < len(pair):
            pair[i] = get(word[at[i] : at[i + 2]], NONE)
        if i:
            pair[i - 1] = get(word[at[i - 1] : at[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(at, at[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long words: lowest rank first, leftmost first among equals."""
    n, get = len(word), ranks.get
    end = list(range(1, n + 1))  # end of the part that starts here, 0 once merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        p = before[i]
        if p >= 0 and (r := get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], words: str = WORDS):
        import regex

        self.ranks, self.split, self.known = ranks, regex.compile(words).findall, {}

    def word(self, w: str) -> list[int]:
        b = w.encode("utf-8")
        one = self.ranks.get(b)
        if one is not None:
            return [one]
        return merge_short(b, self.ranks) if len(b) <= SHORT else merge_long(b, self.ranks)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for w in self.split(text):
            ids = known.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[w] = ids
            out.extend(ids)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(data: bytes, words: str = WORDS) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = hashlib.sha256(data + words.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(data), words)
    return _ENCODERS[key]


def encode_column(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY, words: str = WORDS) -> Column:
    """array<int> of a text column. The vocabulary file (under 1 MB) is broadcast once."""
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(shared.value, words)
        for batch in batches:
            flat, ends = [], [0]
            for t in batch.to_pylist():
                flat.extend(enc.encode(t))
                ends.append(len(flat))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    return ids(text)


def encode(df: DataFrame, text: str, out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the ids of column ``text`` in column ``out`` (replaced where it exists)."""
    return df.withColumn(out, encode_column(df.sparkSession, F.col(text), vocabulary))


def count_column(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a text column, without moving the ids out of Python."""
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("bigint")
    def size(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(shared.value)
        for batch in batches:
            yield pa.array([len(enc.encode(t)) for t in batch.to_pylist()], pa.int64())

    return size(text)
