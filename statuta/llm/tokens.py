"""Problem 8: a whole corpus as ids of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from statuta.runtime import widen

#: Place of the vocabulary files.
VOCABULARIES = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How this tokenizer cuts a text into pre-tokens, as published with it.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text whose ids a task holds at a time.
SLICE_BYTES = 4_000_000
#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 200_000


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys, n slots, one comparison a lookup.

    Keys are hashed into buckets; from the fullest down, each bucket takes the first displacement that puts all its
    keys on free slots, and buckets of one key take a free slot outright (stored as -1 - slot).
    """

    def __init__(self, keys: list[bytes], values: list[int]) -> None:
        self.n = n = max(1, len(keys))
        self.buckets = max(1, n // 2)
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [-1] * n
        by: list[list[int]] = [[] for _ in range(self.buckets)]
        parts = [self._hash(k) for k in keys]
        for i, (b, _, _) in enumerate(parts):
            by[b].append(i)
        used = bytearray(n)
        free = None
        for b in sorted(range(self.buckets), key=lambda x: -len(by[x])):
            if not by[b]:
                break
            if len(by[b]) == 1:
                free = free if free is not None else iter([s for s in range(n) if not used[s]])
                at = [next(free)]
                self.shift[b] = -1 - at[0]
            else:
                d = 0
                while True:
                    at = [self._slot(parts[i][1], parts[i][2], d) for i in by[b]]
                    if len(set(at)) == len(at) and not any(used[s] for s in at):
                        break
                    d += 1
                self.shift[b] = d
            for i, s in zip(by[b], at):
                used[s], self.keys[s], self.values[s] = 1, keys[i], values[i]

    def _hash(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h & 0xFFFFFFFF) % self.buckets, (h >> 32) & 0xFFFFFFFF, ((h >> 64) & 0xFFFFFFFF) | 1

    def _slot(self, f: int, g: int, d: int) -> int:
        # the second term walks on once the first has gone round
        return (f + d * g + d // self.n) % self.n

    def get(self, key: bytes) -> int:
        """The key's value, -1 if it isn't one of the keys."""
        b, f, g = self._hash(key)
        d = self.shift[b]
        s = -1 - d if d < 0 else self._slot(f, g, d)
        return self.values[s] if self.keys[s] == key else -1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token that isn't in the vocabulary: the lowest-ranked neighbours merge first, by heap over links.

    O(n log n) for n bytes, so a pre-token of any length is encoded whole.
    """
    n = len(piece)
    start, end = list(range(n)), list(range(1, n + 1))
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, e = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or end[j] != e:
            continue  # one of the two has merged since
        end[i], right[i], alive[j] = e, right[j], False
        if right[i] >= 0:
            left[right[i]] = i
            if (r := ranks.get(piece[start[i] : end[right[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[right[i]]))
        if (k := left[i]) >= 0 and (r := ranks.get(piece[start[k] : e])) is not None:
            heapq.heappush(heap, (r, k, e))
    return [ranks[piece[start[i] : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Text to ids; holds the vocabulary, a fixed number of entries."""

    def __init__(self, path: str) -> None:
        self.ranks = read_ranks(path)
        self.whole = PerfectHash(list(self.ranks), list(self.ranks.values()))
        self.known: dict[str, list[int]] = {}
        self.find = None

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "whole": self.whole, "known": {}, "find": None}

    def piece(self, p: str) -> list[int]:
        ids = self.known.get(p)
        if ids is None:
            b = p.encode()
            r = self.whole.get(b)
            ids = [r] if r >= 0 else merge(b, self.ranks)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(p) <= 64:
                self.known[p] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        self.find = self.find or regex.compile(PRE_TOKENS).findall
        out: list[int] = []
        known, piece = self.known, self.piece
        for p in self.find(text):
            out += known.get(p) or piece(p)
        return out


def encoder(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The vocabulary for all executors: its size is the file's, whatever the corpus."""
    return spark.sparkContext.broadcast(Encoder(path or os.path.join(VOCABULARIES, VOCABULARY)))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, as few at a time as hold about SLICE_BYTES of text; a longer text is alone."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
        at, total = 0, 0
        for i, n in enumerate(sizes):
            if i > at and total + n > SLICE_BYTES:
                yield b.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < b.num_rows:
            yield b.slice(at)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of every row; null and empty texts give an empty list, blank ones the ids of their blanks.

    Special tokens are never made: their strings in a text are ordinary text.
    """
    shared = encoder(df.sparkSession, path)
    kind = df.select(key).schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = shared.value
        for b in slices(batches):
            ids = [e.encode(t) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.fromiter((x for i in ids for x in i), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, flat)], [key, "ids"])

    return widen(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, tokens) of every row, 0 for null and empty texts."""
    shared = encoder(df.sparkSession, path)
    kind = df.select(key).schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = shared.value
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(e.encode(t)) for t in b.column(1).to_pylist()], pa.int64())], [key, "tokens"])

    return widen(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, tokens long")
