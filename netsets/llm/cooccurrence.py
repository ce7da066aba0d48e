"""Items that appear together: exact pair counts against a fitted bipartite configuration null.

Pair counts come from the baskets as arrays: each task counts pairs of integer item numbers over chunks of baskets and ships
partial counts, which Spark adds up. A large basket is cut into blocks, and each pair of its blocks is a row of its own, so its
pairs are counted by many tasks. The null model gives item i and basket b an edge with probability x_i y_b / (1 + x_i y_b),
fitted so that expected item frequencies and basket sizes are the observed ones; since x depends on the frequency only and y on the
size only, the fit runs on the two histograms (their lengths grow as the square root of the memberships at most), and only x and
y reach the tasks. A pair's count is then Poisson-binomial; its upper tail is a saddlepoint approximation. False discoveries are
controlled over all pairs of items: those below the least count aren't tested and enter as tests with p = 1, so that the rates of
the others are upper bounds.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsets.functions.numbering import discoveries, with_numbers
from netsets.functions.spread import spread_join
from netsets.session import written

#: Pairs counted at once in a task.
CHUNK = 4_000_000
#: Items of a block of a basket, about; a basket with more is cut into blocks.
BLOCK = 1024
#: Probabilities held in memory at once.
HELD = 2_000_000
_SHIFT = 31


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of packed pairs (low number << 31 | high number): within `own`, or between `own` and `other` where that isn't empty."""

    def counted(chunks: list[np.ndarray]) -> pa.RecordBatch:
        pairs, counts = np.unique(np.concatenate(chunks), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts.astype(np.int64))], names=["pair", "n"])

    def blocks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        own, other = batch.column("own"), batch.column("other")
        values, offsets = own.values.to_numpy(zero_copy_only=False).astype(np.int64), own.offsets.to_numpy()
        across = other.value_lengths().to_numpy() > 0
        sizes = np.where(across, 0, np.diff(offsets))
        for size in np.unique(sizes[sizes > 1]).tolist():
            starts = offsets[:-1][sizes == size]
            at_once = max(1, CHUNK // (size * size // 2 + 1))
            low, high = np.triu_indices(size, 1)
            for at in range(0, len(starts), at_once):
                items = values[starts[at : at + at_once, None] + np.arange(size)]
                yield (items[:, low] << _SHIFT | items[:, high]).ravel()
        for row in np.flatnonzero(across).tolist():
            one, two = (np.asarray(c[row].values, np.int64) for c in (own, other))
            yield (np.minimum(one[:, None], two) << _SHIFT | np.maximum(one[:, None], two)).ravel()

    chunks, held = [], 0
    for batch in batches:
        for block in blocks(batch):
            chunks.append(block)
            held += len(block)
            if held >= CHUNK:
                yield counted(chunks)
                chunks, held = [], 0
    if chunks:
        yield counted(chunks)


def _in_blocks(numbered: DataFrame) -> DataFrame:
    """(own, other): the sorted item numbers of each basket, or of each pair of its blocks; `other` is empty for a block with itself."""
    sizes = numbered.groupBy("basket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    large = written(sizes.select("basket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), "n"), "large-baskets")
    if large.isEmpty():
        placed = numbered.select("basket", "number", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(False).alias("second"))
    else:
        joined = spread_join(numbered, large, ["basket"], "n", [F.col("number")], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        mine = F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int")
        pair = lambda k: F.struct(F.least(mine, k).alias("x"), F.greatest(mine, k).alias("y"), (mine > k).alias("second"))
        placed = joined.select("basket", "number", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)).alias("p")).select("basket", "number", "p.*")
    number = F.col("number").cast("int")
    lists = [F.array_sort(F.collect_list(F.when(which, number))).alias(name) for which, name in ((~F.col("second"), "own"), (F.col("second"), "other"))]
    return placed.groupBy("basket", "x", "y").agg(*lists).select("own", "other")


def pair_counts(members: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(number_1, number_2, n12) of all pairs in at least `least` baskets, and the items (number, item, n_item).

    `members` has one row per basket and item: (basket, item). Items in fewer baskets than `least` can't be in a pair.
    """
    often = members.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")).where(F.col("n_item") >= least)
    items = with_numbers(written(often, "frequent-items"), ["item"], "items")
    numbered = written(members.join(items, "item").select("basket", "number"), "numbered")
    counts = _in_blocks(numbered).mapInArrow(_count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n12")).where(F.col("n12") >= least)
    return counts.select(F.shiftright("pair", _SHIFT).alias("number_1"), F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1)).alias("number_2"), "n12"), items


def probability(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The edge probabilities of items with weights x (rows) and baskets with weights y (columns)."""
    xy = x[:, None] * y[None, :]
    return np.where(np.isfinite(xy), xy / (1 + xy), 1.0)


def fit_null(frequencies: dict[int, int], sizes: dict[int, int], tol: float = 1e-9, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(frequency classes, their weights x, number of baskets per size class, weights y of the size classes).

    Sums over both kinds of classes are taken in chunks. A RuntimeWarning tells where the weights still change after `rounds`.
    """
    d, c = np.array(sorted(frequencies), float), np.array([frequencies[k] for k in sorted(frequencies)], float)
    k, m = np.array(sorted(sizes), float), np.array([sizes[s] for s in sorted(sizes)], float)
    total = max((d * c).sum(), 1.0)
    x, y = d / math.sqrt(total), k / math.sqrt(total)
    parts = [slice(at, at + max(1, HELD // len(k))) for at in range(0, len(d), max(1, HELD // len(k)))]
    for _ in range(rounds):
        x_new = np.concatenate([d[p] / np.maximum((m * y / (1 + x[p, None] * y)).sum(1), 1e-300) for p in parts])
        y_new = k / np.maximum(sum(((c[p] * x_new[p])[:, None] / (1 + x_new[p, None] * y)).sum(0) for p in parts), 1e-300)
        change = max(np.max(np.abs(x_new / x - 1), initial=0), np.max(np.abs(y_new / y - 1), initial=0))
        x, y = x_new, y_new
        if change < tol or not np.isfinite(change):
            break
    else:
        warnings.warn(f"the null model still changes by {change:.1e} after {rounds} rounds", RuntimeWarning, stacklevel=2)
    return d.astype(np.int64), x, m, y


def upper_tail(n: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """P(X >= n) of Poisson-binomial X with m[k] trials of probability q[row, k]; saddlepoint with lattice correction."""
    mean = (q * m).sum(1)
    ceiling = (m * (q > 0)).sum(1)
    target = np.minimum(n, ceiling - 1e-9)
    t = np.log(np.maximum(target, 1e-12) / np.maximum(mean, 1e-300))
    for _ in range(60):
        tilted = q * np.exp(t)[:, None]
        tilted = tilted / (1 - q + tilted)
        first, second = (m * tilted).sum(1), (m * tilted * (1 - tilted)).sum(1)
        step = np.clip((first - target) / np.maximum(second, 1e-300), -1, 1)
        t = t - step
        if np.max(np.abs(step), initial=0) < 1e-10:
            break
    cumulant = (m * np.log1p(q * np.expm1(t)[:, None])).sum(1)
    tilted = q * np.exp(t)[:, None]
    tilted = tilted / (1 - q + tilted)
    second = np.maximum((m * tilted * (1 - tilted)).sum(1), 1e-300)
    w = np.sign(t) * np.sqrt(np.maximum(2 * (t * target - cumulant), 0))
    u = -np.expm1(-t) * np.sqrt(second)
    normal = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in w.tolist()])
    density = np.exp(-w * w / 2) / math.sqrt(2 * math.pi)
    near = np.abs(w) < 1e-3
    with np.errstate(divide="ignore", invalid="ignore"):
        tail = normal + density * (1 / u - 1 / w)
    plain = (n - 0.5 - mean) / np.sqrt(np.maximum((m * q * (1 - q)).sum(1), 1e-300))
    plain = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in np.clip(plain, -40, 40).tolist()])
    tail = np.where(near | ~np.isfinite(tail), plain, tail)
    return np.where(n <= 0, 1.0, np.where(n > ceiling, 0.0, np.clip(tail, 0.0, 1.0)))


def _tails(classes: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, both = (batch.column(c).to_numpy() for c in ("n1", "n2", "n12"))
            a, b = x[np.searchsorted(classes, one)], x[np.searchsorted(classes, two)]
            expected, tail = np.empty(len(a)), np.empty(len(a))
            at_once = max(1, HELD // len(y))
            for at in range(0, len(a), at_once):
                part = slice(at, at + at_once)
                q = probability(a[part], y) * probability(b[part], y)
                expected[part] = (q * m).sum(1)
                tail[part] = upper_tail(both[part].astype(float), q, m)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected), pa.array(tail)], names=[*batch.schema.names, "expected", "p_value"])

    return run


def surprising_pairs(members: DataFrame, least: int = 2) -> DataFrame:
    """(item_1, item_2, n12, n1, n2, n_baskets, expected, p_value, q_value) of all pairs in at least `least` baskets, item_1 < item_2.

    `members` is (basket, item); null baskets and items are left out, repeated rows count once, a basket with one item counts for
    frequencies and the null. An empty table gives no rows. q_value bounds the rate of false discoveries over all pairs of items, those
    below `least` counting as tests with p = 1.
    """
    if least < 1:
        raise ValueError("least must be at least 1")
    full, by_frequency, by_size = _counted(members, least)
    n_items, n_baskets = sum(by_frequency.values()), sum(by_size.values())
    schema = "item_1 string, item_2 string, n12 long, n1 long, n2 long, expected double, p_value double"
    if not by_frequency:
        empty = full.select("*", F.lit(0.0).alias("expected"), F.lit(1.0).alias("p_value"), F.lit(1.0).alias("q_value"))
        return empty.withColumn("n_baskets", F.lit(0).cast("long"))
    tested = written(full.mapInArrow(_tails(*fit_null(by_frequency, by_size)), schema), "tested-pairs")
    found = discoveries(tested, "p_value", ["item_1", "item_2"], n_items * (n_items - 1) // 2)
    return found.withColumn("n_baskets", F.lit(n_baskets).cast("long"))


def _counted(members: DataFrame, least: int) -> tuple[DataFrame, dict[int, int], dict[int, int]]:
    """(item_1, item_2, n12, n1, n2) of the pairs, the number of items by frequency, and of baskets by size."""
    members = written(members.select("basket", "item").where("basket is not null and item is not null").distinct(), "members")
    histogram = lambda key: {r["n"]: r["of"] for r in members.groupBy(key).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("of")).collect()}
    pairs, items = pair_counts(members, least)
    named = lambda k: items.select(F.col("number").alias(f"number_{k}"), F.col("item").alias(f"item_{k}"), F.col("n_item").alias(f"n{k}"))
    return pairs.join(named(1), "number_1").join(named(2), "number_2").select("item_1", "item_2", "n12", "n1", "n2"), histogram("item"), histogram("basket")


def frequent_pairs(members: DataFrame, least: int = 2) -> DataFrame:
    """(item_1, item_2, n12, n1, n2) of all pairs in at least `least` baskets, as surprising_pairs counts them."""
    if least < 1:
        raise ValueError("least must be at least 1")
    return _counted(members, least)[0]


def at_least(lift: int) -> Column:
    """Whether a pair's count is at least `lift` times n1 * n2 / n_baskets, in whole numbers."""
    return F.col("n12") * F.col("n_baskets") >= F.lit(lift) * F.col("n1") * F.col("n2")
