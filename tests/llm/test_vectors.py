"""Neighbours and clusters against brute force."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsets.llm import clusters, neighbours, vectors

SCHEMA = "kind string, item_id long, vec array<float>, cos double, head long"  # the last two clash with names used inside


def sample(seed=1, groups=25, alone=200):
    r = np.random.default_rng(seed)
    rows, item = [], 1
    for g in range(groups):
        centre = r.normal(size=64)
        for _ in range(int(r.integers(2, 14))):
            v = (centre / np.linalg.norm(centre) + r.normal(size=64) * 0.03) * r.uniform(0.01, 50)
            rows.append(("gene" if g % 3 else "set", item, v.astype(np.float32).tolist()))
            item += 1
    for _ in range(alone):
        rows.append(("gene", item, r.normal(size=64).astype(np.float32).tolist()))
        item += 1
    copied = rows[3]
    for _ in range(9):
        rows.append((copied[0], item, copied[2]))
        item += 1
    bad = [None, [], [1.0] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [0.0] * 64, [None] + [1.0] * 63]
    for v in bad:
        rows.append(("gene", item, v))
        item += 1
    rows.append((None, item, rows[0][2]))
    order = r.permutation(len(rows))
    return [(*rows[i], 0.5, 7) for i in order]


def exact(rows):
    good = sorted((k, i, v) for k, i, v, *_ in rows if k and v and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v))
    out = {}
    for kind in ("gene", "set"):
        ids = [i for k, i, _ in good if k == kind]
        m = np.array([v for k, _, v in good if k == kind], float)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        out[kind] = (ids, np.round(m @ m.T, 6))
    return out


def test_neighbours_reach_the_recall(spark):
    rows = sample()
    got = {(r["item_id"], r["neighbour_id"], r["rank"]) for r in neighbours.nearest(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = set()
    for ids, cos in exact(rows).values():
        for a in range(len(ids)):
            near = sorted(((-cos[a, b], ids[b]) for b in range(len(ids)) if b != a and cos[a, b] >= 0.85))[:5]
            want |= {(ids[a], b, n + 1) for n, (_, b) in enumerate(near)}
    assert len(got & want) / len(want) > 0.98 and len(got - want) / len(got) < 0.02
    copies = sorted(i for _, i, v, *_ in rows if v == next(v for _, j, v, *_ in rows if j == 4))
    assert {(copies[-1], b, n + 1) for n, b in enumerate(copies[:5])} <= got  # equal values: lower ids first


def test_groups_are_the_connected_links(spark):
    rows = sample(2)
    members = clusters.clusters(spark.createDataFrame(rows, SCHEMA))
    got = {(r["head_item_id"], r["item_id"]) for r in clusters.grouped_pairs(members).collect()}
    want = set()
    for ids, cos in exact(rows).values():
        label = np.arange(len(ids))
        for _ in range(len(ids)):
            label = np.array([min(label[cos[a] >= 0.85]) for a in range(len(ids))])
        by = defaultdict(list)
        for i, lab in zip(ids, label):
            by[lab].append(i)
        want |= {(min(v), i) for v in by.values() if len(v) > 2 for i in v if i != min(v)}
    assert got == want
    described = {r["head_item_id"]: r for r in clusters.described(members).collect()}
    assert set(described) == {h for h, _ in want}
    for head, r in described.items():
        assert r["size"] == 1 + sum(h == head for h, _ in want) and len(set(r["typical"])) == 3


def test_a_chain_of_links_is_one_group(spark):
    """Neighbours of a chain are linked, its ends are far apart: the whole chain is one group."""
    rows = [("gene", i + 1, [float(np.cos(a)), float(np.sin(a))] + [0.0] * 62) for i, a in enumerate(np.arange(6) * 0.35)]
    got = {(r["head_item_id"], r["item_id"]) for r in clusters.grouped_pairs(clusters.clusters(spark.createDataFrame(rows, "kind string, item_id long, vec array<float>"))).collect()}
    assert got == {(1, i) for i in range(2, 7)}
    joined = clusters._joined(spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (7, 9), (2, 5)], "a long, b long")).collect()
    assert {r["label"]: r["root"] for r in joined} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7}


def share_repaired(members):
    found = members.groupBy("root").agg(F.max("repaired").alias("repaired"), F.count(F.lit(1)).alias("n")).where("n > 2")
    return found.agg(F.avg(F.col("repaired").cast("int"))).first()[0]


def test_groups_are_those_of_k_means(spark, monkeypatch):
    """The check repairs few groups; with one centre for all, or one for each record, it has to repair nearly all, so the groups come from k-means."""
    df = spark.createDataFrame(sample(4, 120), SCHEMA)
    assert share_repaired(clusters.clusters(df)) < 0.1
    monkeypatch.setattr(clusters, "_k_means", lambda points: points.select("item_id", F.lit(0).alias("centre")))
    assert share_repaired(clusters.clusters(df)) > 0.9
    monkeypatch.setattr(clusters, "_k_means", lambda points: points.select("item_id", F.col("item_id").alias("centre")))
    assert share_repaired(clusters.clusters(df)) > 0.9


def test_without_iterations_k_means_needs_repair(spark, monkeypatch):
    df = spark.createDataFrame(sample(4, 60), SCHEMA)
    monkeypatch.setattr(clusters, "_iterate", lambda around, start: start)
    assert share_repaired(clusters.clusters(df)) > 0.9


def test_sparse_links_keep_groups_connected(spark, monkeypatch):
    monkeypatch.setattr(clusters, "LINKS", 1)
    r = np.random.default_rng(8)
    centre = r.normal(size=64)
    rows = [("gene", i, (centre + r.normal(size=64) * 0.2).astype(np.float32).tolist()) for i in range(400)]
    members = clusters.clusters(spark.createDataFrame(rows, "kind string, item_id long, vec array<float>"))
    assert members.count() == 400 and members.select("root").distinct().count() == 1
    kept, label = clusters._forest(np.array([0, 1, 2, 5, 0]), np.array([1, 2, 0, 6, 2]), 8)
    assert sorted(label.tolist()) == [0, 0, 0, 3, 4, 5, 5, 7] and len(kept) <= 4


def test_split_buckets_give_the_same_pairs(spark, monkeypatch):
    r = np.random.default_rng(3)
    centre = r.normal(size=64)
    rows = [("gene", i, (centre + r.normal(size=64) * 0.2).astype(np.float32).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "kind string, item_id long, vec array<float>")
    codes = {"gene": vectors.learn(df, 300)}
    pairs = lambda: sorted((x["a"], x["b"]) for x in vectors.meetings(df, codes, 0.85, clusters._sparse(10**6), "a long, b long, affinity double, sure boolean").where("a <> b").collect())
    whole = pairs()
    monkeypatch.setattr(vectors, "BLOCK", 40)
    split = pairs()
    assert split == whole and len(set(split)) == len(split) > 1000


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "kind string, item_id long, vec array<float>")
    assert neighbours.nearest(empty).collect() == []
    assert clusters.grouped_pairs(clusters.clusters(empty)).collect() == []
    one = spark.createDataFrame([("gene", 1, [1.0] * 64)], "kind string, item_id long, vec array<float>")
    assert neighbours.nearest(one).collect() == [] and clusters.grouped_pairs(clusters.clusters(one)).collect() == []


def test_rounded_products_stay_within_their_bound():
    r = np.random.default_rng(0)
    v = r.normal(size=(200, 64)) * (r.random((200, 64)) < 0.3)
    v[:, 0] += 1e-3
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    q, s, rest = vectors._quantised(unit)
    back = q.astype(np.float32) * s[:, None]
    off = vectors.largest_error(rest[:, None], rest[None, :])
    assert (np.abs(unit @ unit.T - back @ back.T) <= off).all() and off.max() < 2e-4


@pytest.mark.parametrize("n", [10, 1000, 10**6, 10**9])
def test_layouts_fit_the_number_of_vectors(n):
    assert vectors.layout(n).recall(vectors.THRESHOLD) >= 1 - vectors.MISSED
    high, low = vectors.layout(n, 0.95), vectors.layout(n, 0.8)
    assert high.substrings < vectors.layout(n).substrings < low.substrings


def test_probing_meets_each_pair_within_the_radius_once():
    r = np.random.default_rng(2)
    near, masks = r.integers(0, 32, 300), np.array([v for v in range(32) if bin(v).count("1") <= 2])
    for side in (np.full(300, vectors._WITHIN), r.integers(0, 2, 300)):
        met = [tuple(sorted((int(i), int(j)))) for a, b, same in vectors._probed(near, side, masks, 32) for i in a for j in b if not same or i < j]
        want = {(i, j) for i in range(300) for j in range(i + 1, 300) if bin(near[i] ^ near[j]).count("1") <= 2 and (side[0] == vectors._WITHIN or side[i] != side[j])}
        assert len(met) == len(set(met)) and set(met) == want


@pytest.mark.parametrize("cosine, n", [(0.86, 20_000), (0.88, 20_000), (0.90, 20_000), (0.851, 10**6)])
def test_planted_pairs_are_found(spark, cosine, n):
    """Pairs planted at a cosine among others, with the codes for n vectors: neighbours find and rank them."""
    r = np.random.default_rng(6)
    one, turn = r.normal(size=(2, 3000, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    turn -= (turn * one).sum(1, keepdims=True) * one
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    two = cosine * one + np.sqrt(1 - cosine**2) * turn
    rest = r.normal(size=((14_000 if n == 20_000 else 0), 64))
    df = spark.createDataFrame([("gene", int(i), v.tolist()) for i, v in enumerate(np.concatenate([one, two, rest]))], "kind string, item_id long, vec array<double>")
    if n == 20_000:
        found = neighbours.nearest(df).where("neighbour_id - item_id = 3000")
    else:
        met = vectors.meetings(df, {"gene": vectors.learn(df, n)}, 0.85, clusters._sparse(10**6), "a long, b long, affinity double, sure boolean")
        found = met.where("b - a = 3000")
    assert found.count() / 3000 >= 0.97
