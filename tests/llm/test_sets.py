"""Pairs of items and pairs of sets against brute force."""

from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netsets.llm import cooccurrence, set_join

MEMBERS = "basket string, item string, n12 long"


def baskets(seed=1, n=60, heavy=0):
    r = np.random.default_rng(seed)
    out = {f"b{i}": {f"g{int(x)}" for x in r.zipf(1.4, int(r.integers(1, 12))) if x < 60} for i in range(n)}
    for h in range(heavy):
        out[f"heavy{h}"] = {f"g{i}" for i in range(60)}
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("heavy", [0, 2, 12])
def test_pair_counts(spark, monkeypatch, heavy):
    monkeypatch.setattr(cooccurrence, "BLOCK", 8)
    monkeypatch.setattr(cooccurrence, "CHUNK", 50)
    sets = baskets(heavy=heavy)
    rows = [(b, i, 1) for b, v in sets.items() for i in v] * 2 + [(None, "g1", 0), ("b1", None, 0)]
    got = {(r["item_1"], r["item_2"]): r for r in cooccurrence.surprising_pairs(spark.createDataFrame(rows, MEMBERS), 4).collect()}
    single, pair = Counter(i for v in sets.values() for i in v), Counter(p for v in sets.values() for p in combinations(sorted(v), 2))
    assert {k: r["n12"] for k, r in got.items()} == {p: c for p, c in pair.items() if c >= 4}
    for (a, b), r in got.items():
        assert (r["n1"], r["n2"], r["n_baskets"]) == (single[a], single[b], len(sets)) and 0 <= r["p_value"] <= r["q_value"] <= 1
    assert cooccurrence.surprising_pairs(spark.createDataFrame([], MEMBERS), 4).collect() == []


def test_large_baskets(spark):
    """Nine baskets of 5,000 items each: all pairs come out with their counts."""
    r = np.random.default_rng(4)
    has = np.zeros((9, 6000), bool)
    for b in range(9):
        has[b, r.permutation(6000)[:5000]] = True
    basket, item = np.nonzero(has)
    members = spark.createDataFrame(pd.DataFrame({"basket": [f"b{i}" for i in basket], "item": [f"g{i:04d}" for i in item]}))
    pairs, items = cooccurrence.pair_counts(members, 6)
    both = np.triu(has.astype(int).T @ has, 1)
    got = pairs.agg(F.count(F.lit(1)), F.sum("n12"), F.sum(F.col("n12") * F.col("n12"))).first()
    assert tuple(got) == tuple(int((both[both >= 6] ** p).sum()) for p in (0, 1, 2))


def test_the_null_honours_frequencies_and_sizes(monkeypatch):
    sets = baskets(3, 200)
    single, sizes = Counter(i for v in sets.values() for i in v), Counter(map(len, sets.values()))
    for held in (10, 10**6):
        monkeypatch.setattr(cooccurrence, "HELD", held)
        d, x, m, y = cooccurrence.fit_null(dict(Counter(single.values())), dict(sizes))
        p = cooccurrence.probability(x, y)
        items = np.array([Counter(single.values())[f] for f in d.tolist()])
        assert (p * m).sum(1) == pytest.approx(d, rel=1e-4) and (p * items[:, None]).sum(0) == pytest.approx(sorted(sizes), rel=1e-4)
    with pytest.warns(RuntimeWarning, match="still changes"):
        cooccurrence.fit_null(dict(Counter(single.values())), dict(sizes), rounds=2)


def test_tails_against_exact_convolution():
    r = np.random.default_rng(5)
    for _ in range(20):
        q, m = r.uniform(0.001, 0.4, 6), r.integers(1, 30, 6).astype(float)
        exact = np.array([1.0])
        for x, n in zip(q, m):
            for _ in range(int(n)):
                exact = np.convolve(exact, [1 - x, x])
        mean = (q * m).sum()
        for n in range(int(mean) + 2, min(int(mean * 3) + 3, int(m.sum()))):
            tail = exact[n:].sum()
            if tail > 1e-250:
                got = cooccurrence.upper_tail(np.array([float(n)]), q[None, :], m)[0]
                assert got == pytest.approx(tail, rel=0.08)
    assert cooccurrence.upper_tail(np.array([0.0, 7.0]), np.full((2, 1), 0.5), np.array([6.0])).tolist() == [1.0, 0.0]


SETS = "set_id string, gene_sets array<string>, revision int, members int, size int"


def brute(sets):
    return {tuple(sorted(p)) for p in combinations(sets, 2) if sets[p[0]] and sets[p[1]] and 5 * len(sets[p[0]] & sets[p[1]]) >= 4 * len(sets[p[0]] | sets[p[1]])}


@pytest.mark.parametrize("lengths", [(1,), (2,), (3,), (1, 2, 3)])
def test_similar_sets(spark, monkeypatch, lengths):
    monkeypatch.setattr(set_join, "LENGTHS", lengths)
    r = np.random.default_rng(2)
    sets = {}
    for g in range(40):
        base = {f"T{int(x)}" for x in r.integers(0, 80 if g % 2 else 2000, int(r.integers(1, 60)))}
        for c in range(4):
            new = set(base)
            for _ in range(int(r.integers(0, 1 + len(base) // 6))):
                new.discard(sorted(new)[int(r.integers(0, len(new)))] if new else None)
                new.add(f"N{int(r.integers(0, 500))}")
            sets[f"s{g}-{c}"] = new
    rows = [(k, [f" {x.lower()} " for x in v] + ["", None] + list(v)[:1], 1, 0, 0) for k, v in sets.items()]
    got = [tuple(x) for x in set_join.similar_sets(set_join.current_sets(spark.createDataFrame(rows, SETS), "set_id", "gene_sets", "revision")).collect()]
    assert len(set(got)) == len(got) and set(got) == brute(sets)


def test_current_rows_and_dirty_sets(spark):
    rows = [("a", ["x"], 1, 0, 0), ("a", ["y", "Y", None, " "], 2, 0, 0), ("a", ["Y "], 2, 0, 0), ("b", None, 1, 0, 0), ("c", [], None, 0, 0), (None, ["x"], 1, 0, 0), ("d", ["q"], None, 0, 0), ("e", ["y"], 0, 0, 0)]
    sets = set_join.current_sets(spark.createDataFrame(rows, SETS), "set_id", "gene_sets", "revision")
    assert {r["set_id"]: r["members"] for r in sets.collect()} == {"a": ["Y"], "b": [], "c": [], "d": ["Q"], "e": ["Y"]}
    assert [tuple(r) for r in set_join.similar_sets(sets).collect()] == [("a", "e")]
    assert set_join.similar_sets(sets.where("false")).collect() == []
    distinct, named = set_join.classes(sets)
    assert {(r["class_id"], r["copies"]) for r in distinct.collect()} == {("a", 2), ("d", 1)} and named.count() == 3


def test_similar_sets_between_two_tables(spark):
    r = np.random.default_rng(5)
    sides = ({}, {})
    for g in range(60):
        base = {f"T{int(x)}" for x in r.integers(0, 60 if g % 2 else 900, int(r.integers(1, 40)))}
        for side in sides:
            for c in range(int(r.integers(0, 4))):
                side[f"s{g}-{c}"] = {x for x in base if r.random() > 0.05} | ({f"N{g}"} if r.random() < 0.3 else set())
    frames = [spark.createDataFrame([(k, sorted(v), 5) for k, v in side.items()] + [("none", [], 5)], "set_id string, members array<string>, size int") for side in sides]
    got = [tuple(x) for x in set_join.similar_between(*frames).collect()]
    want = {(a, b) for a, x in sides[0].items() for b, y in sides[1].items() if x and y and 5 * len(x & y) >= 4 * len(x | y)}
    assert len(got) == len(set(got)) and set(got) == want and any(sides[0][a] == sides[1][b] for a, b in want)
    assert set_join.similar_between(frames[0], frames[1].where("false")).collect() == []


def test_a_token_of_most_sets_is_spread(spark):
    sets = {f"s{i}": {"all", f"a{i // 2}"} | {f"b{i // 2}-{k}" for k in range(3)} | ({f"c{i}"} if i % 2 else set()) for i in range(200)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "set_id string, members array<string>")
    assert {tuple(x) for x in set_join.similar_sets(df).collect()} == brute(sets)
