"""All similar pairs between set-valued records: a prefix join with adaptively longer prefixes.

Tokens are ordered from rare to frequent. If two sets overlap in o tokens, their first size - o + l tokens share l of them, so the
join is on combinations of l prefix tokens; larger l gives more keys and far fewer candidates. Sets are banded by size, and l is
chosen for each band by a cost estimated from whole keys of a hash share of the key space. Candidates are verified exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsets.functions.spread import hot_keys, spread_join
from netsets.session import written

LENGTHS = (1, 2, 3)
#: One key in so many is counted to choose l; the choice changes the work, never the result.
KEY_SHARE = 16


def clean_members(values: Column) -> Column:
    """Trimmed, upper-cased, without null and blank ones, each once, in byte order; null for a null array."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda x: F.upper(F.trim(x))), lambda x: x.isNotNull() & (x != ""))))


def current_sets(rows: DataFrame, set_id: str, values: str, revision: str) -> DataFrame:
    """(set_id, members): the clean members of the row with the highest revision of each set.

    Null revisions are the lowest; rows without a set id are no sets; of several rows with the highest revision any is taken
    (the first in the order of their members). Sets without members stay, with an empty list.
    """
    slim = rows.select(F.col(set_id).alias("set_id"), F.col(revision).alias("revision"), F.coalesce(clean_members(F.col(values)), F.expr("array()").cast("array<string>")).alias("members")).where("set_id is not null")
    return slim.groupBy("set_id").agg(F.max(F.struct("revision", "members"))["members"].alias("members"))


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class_id, members, copies, sides) of the distinct non-empty member lists, and (set_id, class_id); the class is named by its lowest set id.

    `sides` holds the bits of the sets' `side` (3, both sides of a join, without such a column).
    """
    side = F.col("side") if "side" in sets.columns else F.lit(3)
    known = sets.where(F.size("members") > 0).select("set_id", "members", side.alias("side"), F.xxhash64("members").alias("digest"))
    distinct = known.groupBy("digest", "members").agg(F.min("set_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.bit_or("side").alias("sides"))
    distinct = written(distinct.select("class_id", "digest", "members", "copies", "sides"), "set-classes")
    # a class of its own names itself; only classes with copies are joined back
    single = distinct.where("copies = 1").select(F.col("class_id").alias("set_id"), "class_id")
    again = distinct.where("copies > 1").select("digest", "members", "class_id", "copies")
    many = spread_join(known.select("set_id", "digest", "members"), again, ["digest", "members"], "copies", [F.col("set_id")]).select("set_id", "class_id")
    return distinct, single.unionByName(many)


def _rare_first(distinct: DataFrame) -> DataFrame:
    """(class_id, size, tokens, sides): the members of each class from rare to frequent, ties in byte order."""
    long = distinct.select("class_id", "sides", F.explode("members").alias("token"))
    often = written(long.groupBy("token").agg(F.count(F.lit(1)).alias("often"), F.count(F.lit(1)).alias("rows")), "token-counts")
    sorted_tokens = F.transform(F.array_sort(F.collect_list(F.struct("often", "token"))), lambda s: s["token"])
    counted = spread_join(long, often, ["token"], "rows", [F.col("class_id")])
    return counted.groupBy("class_id", "sides").agg(sorted_tokens.alias("tokens")).withColumn("size", F.size("tokens"))


def _combinations(prefix: Column, length: int) -> Column:
    """Hashes of all combinations of `length` of the prefix tokens, each in prefix order; a collision only adds a candidate."""
    if length == 1:
        return F.transform(prefix, lambda a: F.xxhash64(a))
    after = lambda i: F.slice(prefix, i + 2, F.greatest(F.size(prefix) - i - 1, F.lit(0)))
    if length == 2:
        return F.flatten(F.transform(prefix, lambda a, i: F.transform(after(i), lambda b: F.xxhash64(a, b))))
    pairs = lambda a, i: F.flatten(F.transform(after(i), lambda b, j: F.transform(F.slice(prefix, i + j + 3, F.greatest(F.size(prefix) - i - j - 2, F.lit(0))), lambda c: F.xxhash64(a, b, c))))
    return F.flatten(F.transform(prefix, pairs))


def _bands(longest: int, num: int, den: int) -> list[tuple[int, int]]:
    """Size bands [low, high] so that a set's partner is in its own band or the next: high < low * den / num."""
    out, low = [], 1
    while low <= longest:
        high = max(low, -(-low * den // num) - 1)
        out.append((low, high))
        low = high + 1
    return out


def _keys(sets: DataFrame, bands: list[tuple[int, int]], lengths: list[int], num: int, den: int) -> DataFrame:
    """(band, key, class_id, size, sides, own): the keys of each class in its own band, where it may be the longer set, and in the next."""
    info = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(length).alias("length")) for (lo, hi), length in zip(bands, lengths)])
    own = sum((F.when(F.col("size") > hi, 1).otherwise(0) for _, hi in bands), F.lit(0))
    placed = sets.withColumn("own_band", own).withColumn("band", F.explode(F.array(F.col("own_band"), F.col("own_band") + 1))).where(F.col("band") < len(bands))
    placed = placed.withColumn("b", F.element_at(info, F.col("band") + 1))
    least = F.ceil(F.greatest(F.col("size"), F.col("b.lo")) * num / F.lit(den).cast("double") - 1e-9).cast("int")
    placed = placed.withColumn("least", least).where("size >= least and least >= b.length")
    prefix = F.slice("tokens", 1, F.least(F.col("size"), F.col("size") - F.col("least") + F.col("b.length")))
    placed = placed.select("band", "class_id", "size", "sides", (F.col("band") == F.col("own_band")).alias("own"), prefix.alias("prefix"), F.col("b.length").alias("length"))
    used = sorted(set(lengths))
    keys = F.coalesce(*[F.when(F.col("length") == n, _combinations(F.col("prefix"), n)) for n in used])
    return placed.select("band", F.explode(keys).alias("key"), "class_id", "size", "sides", "own")


def _choose(sets: DataFrame, bands: list[tuple[int, int]], num: int, den: int) -> list[int]:
    """For each band the l with the least keys plus candidates, both estimated from every KEY_SHARE-th key; at most what its sets allow."""
    cost: dict[tuple[int, int], float] = {}
    per_length = []
    for n in LENGTHS:
        counted = _keys(sets, bands, [min(n, -(-lo * num // den)) for lo, _ in bands], num, den)
        counted = counted.where(F.pmod("key", F.lit(KEY_SHARE)) == 0).groupBy("band", "key").agg(F.count(F.lit(1)).alias("c"))
        per_length.append(counted.groupBy("band").agg((F.sum("c") + F.sum(F.col("c") * (F.col("c") - 1) / 2)).alias("cost")).withColumn("length", F.lit(n)))
    costs = per_length[0]
    for x in per_length[1:]:
        costs = costs.unionByName(x)
    for r in costs.collect():  # one row per band and l: a few dozen
        cost[r["band"], r["length"]] = r["cost"]
    return [min(min(LENGTHS, key=lambda n: (cost.get((i, n), 0), n)), -(-lo * num // den)) for i, (lo, _) in enumerate(bands)]


def similar_classes(distinct: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """(class_1, class_2, common, size_1, size_2) of all pairs of distinct sets with Jaccard similarity of at least num / den.

    A pair needs a set with bit 1 and one with bit 2 among the classes' `sides`.
    """
    sets = written(_rare_first(distinct), "rare-first")
    longest = sets.agg(F.max("size")).first()[0] or 0
    bands = _bands(longest, num, den)
    if not bands:
        return sets.select(F.col("class_id").alias("class_1"), F.col("class_id").alias("class_2"), F.col("size").alias("common"), F.col("size").alias("size_1"), F.col("size").alias("size_2")).where("false")
    keys = written(_keys(sets, bands, _choose(sets, bands, num, den), num, den), "set-keys")
    # the rows of a frequent key are spread over tasks: the longer sets by their hash, the shorter ones to all parts
    hot = hot_keys(written(keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "key-counts"), ["band", "key"], "rows")
    parts = F.coalesce(F.col("_salts"), F.lit(1))
    marked = keys.join(hot, ["band", "key"], "left")
    part = F.pmod(F.xxhash64("class_id"), parts).cast("int").alias("part")
    a = marked.where("own").select("band", "key", part, F.col("class_id").alias("class_a"), F.col("size").alias("size_a"), F.col("sides").alias("sides_a"))
    b = marked.select("band", "key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("class_id").alias("class_b"), F.col("size").alias("size_b"), F.col("sides").alias("sides_b"))
    shorter = (F.col("size_b") < F.col("size_a")) | ((F.col("size_b") == F.col("size_a")) & (F.col("class_b") < F.col("class_a")))
    between = ((F.col("sides_a").bitwiseAND(1) > 0) & (F.col("sides_b").bitwiseAND(2) > 0)) | ((F.col("sides_a").bitwiseAND(2) > 0) & (F.col("sides_b").bitwiseAND(1) > 0))
    pairs = a.join(b, ["band", "key", "part"]).where(shorter & between & (F.col("size_b") * den >= F.col("size_a") * num)).select("class_a", "class_b").distinct()
    with_a = pairs.join(sets.select(F.col("class_id").alias("class_a"), F.col("tokens").alias("tokens_a")), "class_a")
    both = with_a.join(sets.select(F.col("class_id").alias("class_b"), F.col("tokens").alias("tokens_b")), "class_b")
    both = both.select("class_a", "class_b", F.size("tokens_a").alias("size_a"), F.size("tokens_b").alias("size_b"), F.size(F.array_intersect("tokens_a", "tokens_b")).alias("common"))
    found = both.where(F.col("common") * (num + den) >= num * (F.col("size_a") + F.col("size_b")))
    first = F.col("class_a") < F.col("class_b")
    return found.select(
        F.least("class_a", "class_b").alias("class_1"),
        F.greatest("class_a", "class_b").alias("class_2"),
        "common",
        F.when(first, F.col("size_a")).otherwise(F.col("size_b")).alias("size_1"),
        F.when(first, F.col("size_b")).otherwise(F.col("size_a")).alias("size_2"),
    )


def similar_sets(sets: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """(set_id_1, set_id_2), smaller first: all pairs of non-empty sets with Jaccard similarity of at least num / den.

    Equal sets form one class before the join; the pairs between classes are then given for each of their sets, and equal sets
    are pairs of each other, as the definition asks. Null and empty sets have no pairs; an empty table gives no rows.
    """
    distinct, named = classes(sets)
    named = written(named, "set-names")
    pairs = similar_classes(distinct, num, den)
    one = named.select(F.col("class_id").alias("class_1"), F.col("set_id").alias("x"))
    two = named.select(F.col("class_id").alias("class_2"), F.col("set_id").alias("y"))
    between = pairs.join(one, "class_1").join(two, "class_2").select("x", "y")
    equal = one.join(two.withColumnRenamed("class_2", "class_1"), "class_1").where("x < y").select("x", "y")
    return between.unionByName(equal).select(F.least("x", "y").alias("set_id_1"), F.greatest("x", "y").alias("set_id_2"))


def similar_between(left: DataFrame, right: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """(left_id, right_id): all pairs of a non-empty set of `left` and one of `right`, both (set_id, members), with Jaccard similarity of at least num / den.

    Ids may be the same on both sides. Pairs within a side aren't made. Null and empty sets have no pairs; an empty side gives
    no rows.
    """
    tagged = lambda sets, tag, side: sets.select(F.concat(F.lit(tag), F.col("set_id").cast("string")).alias("set_id"), "members", F.lit(side).alias("side"))
    distinct, named = classes(tagged(left, "l", 1).unionByName(tagged(right, "r", 2)))
    named = written(named, "set-names")
    own = lambda tag, name: named.where(F.col("set_id").startswith(tag)).select("class_id", F.expr("substring(set_id, 2)").alias(name))
    pairs = written(similar_classes(distinct, num, den).select("class_1", "class_2"), "class-pairs")
    pairs = pairs.unionByName(pairs.select(F.col("class_2").alias("class_1"), F.col("class_1").alias("class_2")))
    found = pairs.join(own("l", "left_id").withColumnRenamed("class_id", "class_1"), "class_1").join(own("r", "right_id").withColumnRenamed("class_id", "class_2"), "class_2")
    return found.select("left_id", "right_id").unionByName(own("l", "left_id").join(own("r", "right_id"), "class_id").select("left_id", "right_id"))
