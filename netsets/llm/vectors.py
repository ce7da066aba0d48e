"""Similar vectors by multi-index hashing over learned binary codes.

A vector becomes a unit vector of 16-bit numbers and a code of sign bits under rotations learned on a bounded sample (each rotation
brings the sample close to the corners of a cube). The code is split into substrings, each an index of its own. Rows are shuffled
by the first bits of a substring; within such a bucket the substring's other bits are probed: a row meets the rows of all values
within a Hamming radius, so probing copies nothing. By the pigeonhole principle every pair of codes that agrees in one of the
bucket parts and differs little beside it meets. Pairs that meet are ranked by the 16-bit vectors at once, each pair in the first
substring where it meets only; what is near a threshold or a rank is decided by the float vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsets.functions.sampling import bounded_sample
from netsets.session import written

DIM = 64
#: Vectors used to learn the rotations, about and at most; all vectors are indexed.
SAMPLE = 5_000
#: The lowest cosine asked for by default, and the share of pairs at the lowest cosine that may miss each other.
THRESHOLD = 0.85
MISSED = 0.02
#: Comparisons that cost as much as one more copy of a row in the shuffle.
COPY = 5_000
#: Rows of a bucket that one task compares with each other; larger buckets are split into pairs of blocks.
BLOCK = 1 << 17
#: Rows of a probed value, at least, by the layout; and rows up to which a bucket is compared without looking at its values.
CELL, SMALL = 64, 512
#: Cosines held in memory at once.
PRODUCT = 8_000_000
#: Split buckets whose list may be broadcast.
MAX_HOT = 100_000
#: Two low bits of `pair`: all rows compare with each other, or (0, 1) the rows of one block with those of the other.
_WITHIN = 2


def usable(vector: Column, dim: int = DIM) -> Column:
    """Whether a vector has `dim` finite elements, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & ~bad & F.exists(vector, lambda x: x != 0)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(kind, digest_1, digest_2, item_id, copies, vec) of the distinct vectors of (kind, item_id, vec); item_id is the lowest of the equal ones.

    Equal vectors are told by a digest of 128 bits and counted map-side, so a vector with very many copies is one partial row a task.
    """
    hashed = rows.withColumn("digest_1", F.xxhash64("vec")).withColumn("digest_2", F.xxhash64(F.lit(17), "vec"))
    first = hashed.groupBy("kind", "digest_1", "digest_2").agg(F.min(F.struct("item_id", "vec")).alias("first"), F.count(F.lit(1)).alias("copies"))
    return first.select("kind", "digest_1", "digest_2", F.col("first.item_id").alias("item_id"), "copies", F.col("first.vec").alias("vec"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit row vectors of a list column of equal lengths."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    values = values / np.abs(values).max(1, keepdims=True)  # safe for tiny and huge elements
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """16-bit numbers, their scale, and the length of what rounding leaves."""
    scale = (np.abs(unit).max(1) / 32767).astype(np.float32)
    numbers = np.clip(np.rint(unit / scale[:, None].astype(np.float64)), -32767, 32767).astype(np.int16)
    return numbers, scale, np.linalg.norm(unit - numbers * scale[:, None].astype(np.float64), axis=1).astype(np.float32) * np.float32(1.0001)


@dataclass(frozen=True)
class Layout:
    """`substrings` of `bucket_bits` that must agree and `near_bits` that may differ in `radius` places."""

    bucket_bits: int
    near_bits: int
    radius: int
    substrings: int

    @property
    def bits(self) -> int:
        return self.bucket_bits + self.near_bits

    def hit(self, flipped: float) -> float:
        """The chance that two codes meet in one substring when each bit differs with the chance `flipped`."""
        return (1 - flipped) ** self.bucket_bits * sum(math.comb(self.near_bits, i) * flipped**i * (1 - flipped) ** (self.near_bits - i) for i in range(self.radius + 1))

    def recall(self, cosine: float) -> float:
        return 1 - (1 - self.hit(math.acos(cosine) / math.pi)) ** self.substrings

    def compared(self, n: int) -> float:
        """The comparisons of a row in one substring, of `n` rows with independent bits."""
        return n / 2**self.bucket_bits / 2 * sum(math.comb(self.near_bits, i) for i in range(self.radius + 1)) / 2**self.near_bits


def layout(n: int, threshold: float = THRESHOLD) -> Layout:
    """The cheapest layout in copies and comparisons that lets pairs with a cosine of `threshold` miss each other in MISSED of the cases."""
    flipped = max(math.acos(threshold) / math.pi, 0.01)  # rounding may flip bits of all but equal vectors
    best, cost = None, math.inf
    for bucket_bits in range(3, 25):
        rows = n / 2**bucket_bits
        for near_bits in range(4, 13):
            for radius in (1, 2, 3):
                if (near_bits > 4 and rows / 2**near_bits < CELL) or (rows > BLOCK and bucket_bits < 24):
                    continue
                one = Layout(bucket_bits, near_bits, radius, 1)
                tried = Layout(bucket_bits, near_bits, radius, math.ceil(math.log(MISSED) / math.log(1 - one.hit(flipped))))
                if (c := tried.substrings * (COPY + tried.compared(n))) < cost:
                    best, cost = tried, c
    return best


@dataclass(frozen=True)
class Codes:
    """The rotations in whole numbers, and the layout.

    Codes are taken of the upper 8 bits of the numbers: the products are exact, whatever the order of summing.
    """

    rotation: np.ndarray
    layout: Layout

    @staticmethod
    def upper(quantised: np.ndarray) -> np.ndarray:
        return ((quantised.astype(np.int32) + 128) >> 8).astype(np.float32)

    def of(self, quantised: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bucket part and the probed part of each substring, as numbers."""
        y = self.layout
        signs = (self.upper(quantised) @ self.rotation > 0).reshape(len(quantised), y.substrings, y.bits)
        return signs[:, :, : y.bucket_bits] @ (1 << np.arange(y.bucket_bits)), signs[:, :, y.bucket_bits :] @ (1 << np.arange(y.near_bits))

    def near(self, quantised: np.ndarray, substring: int) -> np.ndarray:
        """The probed part of one substring."""
        y = self.layout
        part = self.rotation[:, substring * y.bits + y.bucket_bits : (substring + 1) * y.bits]
        return (self.upper(quantised) @ part > 0) @ (1 << np.arange(y.near_bits))

    def masks(self) -> np.ndarray:
        """The differences that probing allows, 0 first."""
        values = np.arange(1 << self.layout.near_bits)
        return values[np.bitwise_count(values) <= self.layout.radius]


def learn(rows: DataFrame, n: int, threshold: float = THRESHOLD, dim: int = DIM, seed: int = 7, rounds: int = 12) -> Codes:
    """Codes for `n` vectors: as many bits as layout(n, threshold) asks for, from rotations learned on at most SAMPLE rows."""
    plan = layout(n, threshold)
    sample = bounded_sample(rows.select("item_id", "vec"), "item_id", n, SAMPLE).select("vec").toArrow()
    random = np.random.default_rng(seed)
    blocks = []
    unit = _matrix(sample.column(0).combine_chunks()) if sample.num_rows else np.eye(dim)
    for _ in range(math.ceil(plan.bits * plan.substrings / dim)):
        turn = np.linalg.qr(random.normal(size=(dim, dim)))[0]
        for _ in range(rounds if len(unit) > dim else 0):
            left, _, right = np.linalg.svd(unit.T @ np.sign(unit @ turn))
            turn = left @ right
        blocks.append(turn)
    rotation = np.rint(np.concatenate(blocks, axis=1)[:, : plan.bits * plan.substrings] * 1024).astype(np.float32)
    return Codes(rotation, plan)


def _coded(codes: dict[str, Codes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            kinds = np.array(whole.column(0).to_pylist(), dtype=object)
            for k, kind in enumerate(sorted(codes)):
                batch = whole.filter(pa.array(kinds == kind))
                if not batch.num_rows:
                    continue
                quantised, scale, rest = _quantised(_matrix(batch.column(2)))
                own = codes[kind].of(quantised)[0]
                m = own.shape[1]
                bucket = (own | np.arange(m)[None, :] << 32 | k << 48).ravel()
                packed = np.concatenate([quantised.view(np.uint8), scale.view(np.uint8).reshape(-1, 4), rest.view(np.uint8).reshape(-1, 4)], axis=1)
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(packed), [None, pa.py_buffer(np.ascontiguousarray(packed))]).cast(pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * m), pa.array(bucket))
                yield pa.RecordBatch.from_arrays([batch.column(1), data, lists], names=["item_id", "packed", "buckets"])

    return run


def _blocked(coded: DataFrame) -> DataFrame:
    """The index: a row for each bucket of a record. Large buckets are split: a row goes to all pairs of its block with another, so no task compares more than two blocks at once."""
    index = coded.select(F.explode("buckets").alias("bucket"), "item_id", "packed")
    hot = coded.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    hot = written(hot.select("bucket", F.ceil(F.col("n") / (BLOCK // 2)).cast("int").alias("blocks")), "large-buckets")
    found = hot.count()
    if not found:
        return index.withColumn("pair", F.lit(_WITHIN).cast("long"))
    own = F.pmod(F.xxhash64("item_id"), F.col("blocks")).cast("long")
    code = lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other)
    side = lambda other: F.when(own == other, F.lit(_WITHIN)).when(own > other, F.lit(1)).otherwise(F.lit(0))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1), lambda other: (code(other) * 4 + side(other)).cast("long"))
    joined = index.join(F.broadcast(hot) if found <= MAX_HOT else hot, "bucket", "left")
    return joined.select("bucket", "item_id", "packed", F.explode(F.coalesce(pairs, F.array(F.lit(_WITHIN).cast("long")))).alias("pair"))


def largest_error(rest_a, rest_b):
    """The most that rounding to 16 bits and summing in 32-bit floats can move the product of two unit vectors."""
    return rest_a + rest_b + 3 * rest_a * rest_b + 5e-6


def _probed(near: np.ndarray, side: np.ndarray, masks: np.ndarray, values: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows of a value, rows of the values that probing reaches, whether both are the same rows), each pair of rows in one of them.

    `side` is _WITHIN for all rows, or says which rows (0) are compared with which (1).
    """

    def by_value(rows: np.ndarray) -> list[np.ndarray]:
        order = rows[np.argsort(near[rows], kind="stable")]
        return np.split(order, np.cumsum(np.bincount(near[rows], minlength=values))[:-1])

    within = bool(side[0] & _WITHIN)
    one = by_value(np.arange(len(near)) if within else np.flatnonzero(side == 0))
    two = one if within else by_value(np.flatnonzero(side == 1))
    for v in range(values):
        if len(one[v]):
            others = v ^ masks
            others = others[others > v] if within else others
            if within and len(one[v]) > 1:
                yield one[v], one[v], True
            reached = [two[w] for w in others.tolist() if len(two[w])]
            if reached:
                yield one[v], np.concatenate(reached), False


def _meet(codes: dict[str, Codes], threshold: float, keep: Callable) -> Callable:
    """Compare the rows of each bucket; rows come sorted by bucket, and an unfinished bucket is carried to the next batch."""
    kinds = sorted(codes)
    masks = {k: c.masks() for k, c in codes.items()}

    def close_pairs(bucket: np.ndarray, pair: np.ndarray, item: np.ndarray, data: np.ndarray) -> pa.RecordBatch | None:
        quantised = np.ascontiguousarray(data[:, :-8]).view(np.int16)
        scale, rest = np.ascontiguousarray(data[:, -8:]).view(np.float32).T
        unit = quantised.astype(np.float32) * scale[:, None]
        side, group = pair & 3, pair >> 2
        starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (group[1:] != group[:-1])])
        ends = np.r_[starts[1:], len(bucket)]
        found_a, found_b, found_cos = [], [], []

        def compare(a: np.ndarray, b: np.ndarray, same: bool, floor: float) -> None:
            at_once = max(1, PRODUCT // len(b))
            for at in range(0, len(a), at_once):
                cos = unit[a[at : at + at_once]] @ unit[b].T
                found = np.flatnonzero(cos.ravel() >= floor)
                if len(found):
                    i, j = np.divmod(found, len(b))
                    if same:
                        found, i, j = found[j > i + at], i[j > i + at], j[j > i + at]
                    found_a.append(a[at + i]), found_b.append(b[j]), found_cos.append(cos.ravel()[found])

        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            floor = threshold - largest_error(*[float(rest[s:e].max())] * 2)
            if e - s <= SMALL and side[s] & _WITHIN:
                own = np.arange(s, e)
                compare(own, own, True, floor)
                continue
            own = codes[kinds[bucket[s] >> 48]]
            near = own.near(quantised[s:e], int(bucket[s] >> 32) & 0xFFFF)
            for a, b, same in _probed(near, side[s:e], masks[kinds[bucket[s] >> 48]], 1 << own.layout.near_bits):
                compare(a + s, b + s, same, floor)
        if not found_a:
            return None
        a, b, cos = np.concatenate(found_a), np.concatenate(found_b), np.concatenate(found_cos)
        off = largest_error(rest[a], rest[b])
        near = cos + off >= threshold
        a, b, cos, off = a[near], b[near], cos[near], off[near]
        first = np.zeros(len(a), bool)
        for k, kind in enumerate(kinds):
            rows = np.flatnonzero(bucket[a] >> 48 == k)
            if len(rows):
                used, where = np.unique(np.r_[a[rows], b[rows]], return_inverse=True)
                buckets, values = codes[kind].of(quantised[used])
                left, right = where[: len(rows)], where[len(rows) :]
                at = (bucket[a[rows]] >> 32) & 0xFFFF
                for part in range(0, len(rows), 1 << 16):
                    x, y, z = left[part : part + (1 << 16)], right[part : part + (1 << 16)], at[part : part + (1 << 16)]
                    meets = (buckets[x] == buckets[y]) & (np.bitwise_count(values[x] ^ values[y]) <= codes[kind].layout.radius)
                    first[rows[part : part + (1 << 16)]] = meets[np.arange(len(x)), z] & (meets.argmax(1) == z)
        a, b, cos, off = a[first], b[first], cos[first], off[first]
        return keep(np.minimum(item[a], item[b]), np.maximum(item[a], item[b]), cos.astype(np.float64), off.astype(np.float64), threshold) if len(a) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        rows = 0

        def flush(final: bool):
            nonlocal held, rows
            bucket, pair, item, data = (np.concatenate(c) for c in zip(*held))
            cut = len(bucket)
            if not final:  # the last bucket may go on
                before = np.flatnonzero((bucket != bucket[-1]) | (pair >> 2 != pair[-1] >> 2))
                cut = int(before[-1]) + 1 if len(before) else 0
            out = close_pairs(bucket[:cut], pair[:cut], item[:cut], data[:cut]) if cut else None
            held = [(bucket[cut:], pair[cut:], item[cut:], data[cut:])] if cut < len(bucket) else []
            rows = len(bucket) - cut
            return out

        waiting = 40_000
        for batch in batches:
            if batch.num_rows:
                packed = batch.column("packed")
                offsets = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, packed.offset * 4)
                width = int(offsets[1] - offsets[0])
                data = np.frombuffer(packed.buffers()[2], np.uint8, len(packed) * width, int(offsets[0])).reshape(-1, width)
                held.append((batch.column("bucket").to_numpy(), batch.column("pair").to_numpy(), batch.column("item_id").to_numpy(), data.copy()))
                rows += batch.num_rows
                if rows >= waiting:
                    if (out := flush(False)) is not None:
                        yield out
                    waiting = max(40_000, 2 * rows)  # a bucket larger than this is put together once
        if held and (out := flush(True)) is not None:
            yield out

    return run


def meetings(vectors: DataFrame, codes: dict[str, Codes], threshold: float, keep: Callable, schema: str) -> DataFrame:
    """What `keep` makes of the pairs of (kind, item_id, vec) that meet and may have a cosine of at least `threshold`.

    keep(low ids, high ids, cosines by 16-bit vectors, largest errors, threshold) gets each pair of one kind once.
    """
    coded = vectors.select("kind", "item_id", "vec").mapInArrow(_coded(codes), "item_id long, packed binary, buckets array<long>")
    index = _blocked(written(coded, "codes"))
    return index.repartition("bucket", F.shiftright("pair", 2)).sortWithinPartitions("bucket", "pair").mapInArrow(_meet(codes, threshold, keep), schema)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            cos = (_matrix(batch.column("vec_a")) * _matrix(batch.column("vec_b"))).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(np.round(cos, 6))], names=["a", "b", "cos"])


def exact_cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, cos) of pairs (a, b) of item ids: the cosine of the float vectors, rounded to 6 decimals."""
    one = vectors.select(F.col("item_id").alias("a"), F.col("vec").alias("vec_a"))
    two = vectors.select(F.col("item_id").alias("b"), F.col("vec").alias("vec_b"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "vec_a", "vec_b").mapInArrow(_exact, "a long, b long, cos double")
