"""Encoding of the whole corpus with a public byte-level BPE.

Two tiers. Whole pre-tokens that are in the vocabulary are resolved by a minimal perfect hash over the vocabulary's byte strings,
looked up for all new pre-tokens of a batch at once. The others are merged with a heap of adjacent pairs over linked bytes,
which takes n log n steps also for a very long pre-token. Spark splits the corpus; each task works batch by batch.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the public vocabulary files lie; a parameter of every operator here.
TOKENIZERS = os.environ.get("NETSETS_TOKENIZERS", "/opt/tokenizers")
#: Pre-tokens remembered per task; the memory is emptied at this size, without effect on results.
REMEMBERED = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: token bytes to id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """A minimal perfect hash of byte strings to their values: one displacement per bucket, n slots for n keys."""

    def __init__(self, values: dict[bytes, int]):
        keys = list(values)
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 4)
        hashes = self.hashes(keys)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.int64)
        taken, slot_of = np.zeros(n, bool), np.empty(n, np.int64)
        sizes = np.diff(starts)
        by_size = np.argsort(-sizes, kind="stable")
        for b in by_size[: np.count_nonzero(sizes > 1)]:
            own = order[starts[b] : starts[b + 1]]
            tried, fits = 0, np.zeros(1, bool)
            while not fits.any():
                shifts = np.arange(tried, tried + 256)
                options = self._slots(hashes[own][None, :], shifts[:, None])
                fits = ~taken[options].any(1) & (np.diff(np.sort(options, 1), axis=1) != 0).all(1)
                tried += 256
            at = int(np.argmax(fits))
            self.shift[b] = shifts[at]
            taken[options[at]] = True
            slot_of[own] = options[at]
        # a lone key takes any free slot, kept as a negative displacement
        lone = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(~taken)
        self.shift[lone] = -1 - free
        slot_of[order[starts[lone]]] = free
        self.keys, self.values = [b""] * n, np.empty(n, np.int32)
        for i, key in enumerate(keys):
            self.keys[slot_of[i]] = key
            self.values[slot_of[i]] = values[key]

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _slots(self, hashes: np.ndarray, shifts: np.ndarray) -> np.ndarray:
        mixed = (hashes ^ (shifts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((mixed >> np.uint64(17)) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The value of each key, -1 where it isn't one of the hashed keys (the slot's key is compared)."""
        if not keys:
            return np.empty(0, np.int32)
        hashes = self.hashes(keys)
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(shift < 0, -1 - shift, self._slots(hashes, np.maximum(shift, 0)))
        same = np.fromiter((self.keys[s] == k for s, k in zip(slots.tolist(), keys)), bool, len(keys))
        return np.where(same, self.values[slots], -1).astype(np.int32)


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges in rank order, lowest rank and leftmost first, by a heap over linked pieces."""
    n = len(word)
    ends, before, after, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, end = heapq.heappop(heap)
        if not alive[i] or after[i] != j or ends[i] != j or j >= n or not alive[j] or ends[j] != end:
            continue  # one of the two pieces has changed since
        ends[i], alive[j], after[i] = end, False, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : ends[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end, ends[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : end])) is not None:
            heapq.heappush(heap, (r, before[i], i, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = after[i]
    return out


class Encoder:
    """Both tiers for one vocabulary; made once per task."""

    def __init__(self, ranks: dict[bytes, int], whole: PerfectHash):
        self.ranks, self.whole, self.split, self.known = ranks, whole, regex.compile(PATTERN).findall, {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; null and empty texts give an empty list."""
        pieces = [self.split(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list(set(chain.from_iterable(pieces)).difference(self.known))
        raw = [w.encode() for w in new]
        for word, data, found in zip(new, raw, self.whole.find(raw).tolist()):
            self.known[word] = [found] if found >= 0 else merge_bytes(data, self.ranks)
        ids = self.known.__getitem__
        return [list(chain.from_iterable(map(ids, p))) for p in pieces]


def _encoder_of(spark, path: str) -> Callable[[], Encoder]:
    """A function that makes the encoder in a task; the vocabulary (a fixed file of about 50,000 tokens) is broadcast once."""
    ranks = read_ranks(path)
    shared = spark.sparkContext.broadcast((ranks, PerfectHash(ranks)))
    return lambda: Encoder(*shared.value)


def vocabulary(name: str = "byte_bpe_50k") -> str:
    """The path of a public rank file."""
    return os.path.join(TOKENIZERS, f"{name}.tiktoken")


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, ids array<int>) of every row, without special tokens.

    A null text and an empty text both give an empty list; text that spells a special token is ordinary text. Rows keep their
    ids as they are (also null or repeated); other columns aren't read; an empty table gives no rows.
    """
    make = _encoder_of(docs.sparkSession, path or vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            ids = encoder.encode(batch.column(1).to_pylist())
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, f"id {kind}, ids array<int>").select(F.col("id").alias(id_col), "ids")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, n_tokens) of every row; null and empty texts have 0."""
    make = _encoder_of(docs.sparkSession, path or vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            sizes = list(map(len, encoder.encode(batch.column(1).to_pylist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, f"id {kind}, n_tokens long").select(F.col("id").alias(id_col), "n_tokens")
