"""The five-node example: values computed by hand from the definitions."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsets.functions.numbering import discoveries, with_numbers
from netsets.operators import concise, diffusion, enrichment, gaussians, graph, joint, permutation, similarity
from netsets.operators.embedding import autoencoder_embedding, svd_embedding
from netsets.operators.joint import joint_fit
from netsets.plans.model import SetEmbedding, fit
from netsets.session import written

EDGES = [("A", "B", 1.0), ("A", "C", 1.0), ("B", "C", 1.0), ("C", "D", 1.0), ("D", "E", 1.0)]
SETS = [("S1", "A", 0), ("S1", "B", 1), ("S1", "C", 2), ("S2", "D", 0), ("S2", "E", 1)]
STATS = [("A", 2.0), ("B", 1.0), ("C", 0.5), ("D", -1.0), ("E", -2.0)]


def edges(spark, rows=EDGES):
    return spark.createDataFrame(rows, "node1 string, node2 string, weight double")


def sets(spark, rows=SETS):
    return spark.createDataFrame(rows, "set_id string, gene string, gene_pos int")


@pytest.fixture(scope="module")
def model(spark):
    return fit(edges(spark), sets(spark), weight="weight", dim=2, k=2)


def adjacency(g):
    return {(r["src"], r["dst"]): r["w"] for r in g.adjacency.collect()}


def test_landmarks_features_and_embedding(spark, model):
    assert [(r["landmark"], r["rank"]) for r in model.marks.orderBy("rank").collect()] == [("C", 1), ("A", 2)]
    f = {r["node"]: r["features"] for r in diffusion.node_features(model.graph, model.marks).collect()}
    assert f["A"] == pytest.approx([0.1320754717, 0.5773584906], abs=1e-9)
    assert f["E"] == pytest.approx([0.0283018868, 0.0094339623], abs=1e-9)
    e = {r["gene"]: np.abs(r["vec"]) for r in model.embedding.collect()}
    assert e["A"] == pytest.approx([0.2322353624, 0.3050900005], abs=1e-8)
    assert e["D"] == pytest.approx([0.1782558388, 0.0456885159], abs=1e-8)


def test_both_walks_reach_the_closed_form(spark, model):
    names = "ABCDE"
    a = np.zeros((5, 5))
    for x, y, w in EDGES:
        a[names.index(x), names.index(y)] = a[names.index(y), names.index(x)] = w
    w = a / a.sum(0)
    want = 0.5 * np.linalg.inv(np.eye(5) - 0.5 * w)[:, 2]
    for method in ("joins", "blocks"):
        got = {r["node"]: r["val"] for r in diffusion.random_walk(model.graph, spark.createDataFrame([("C", 3.0)], "node string, val double"), method=method).collect()}
        assert [got[x] for x in names] == pytest.approx(want.tolist(), abs=1e-9)
    zero = diffusion.random_walk(model.graph, spark.createDataFrame([("C", 3.0), ("A", 1.0)], "node string, val double"), max_iter=0)
    assert {r["node"]: r["val"] for r in zero.collect()} == {"C": 0.75, "A": 0.25}


def test_both_walks_stop_alike(spark, monkeypatch):
    """With a loose tolerance another number of steps would show; columns stop on their own, in groups and over several blocks."""
    monkeypatch.setattr(diffusion, "COLUMNS", 4)
    monkeypatch.setattr(diffusion, "CELL", 40)
    r = np.random.default_rng(3)
    g = graph.build_graph(edges(spark, [(f"n{a}", f"n{b}", float(w)) for a, b, w in zip(r.zipf(1.5, 300) % 40, r.integers(0, 40, 300), r.random(300) + 0.1)]), weight="weight")
    seeds = g.nodes.select("node", (F.col("pos") % 6).alias("col"), (F.col("pos") + 1.0).alias("val"))
    for how in ({"tol": 0.3, "alpha": 0.1}, {"tol": 0.0, "max_iter": 7}):
        one, two = ({(x["node"], x["col"]): x["val"] for x in diffusion.diffuse(g, seeds, method=m, **how).collect()} for m in ("joins", "blocks"))
        assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-14) for k in one)


def test_set_features_equal_walks_from_the_sets(spark, model):
    members = sets(spark, SETS + [("none", "Z", 0)])
    for how in ({}, {"max_iter": 3, "tol": 0.0}, {"normalize": "row"}):
        p = {(x["col"], x["node"]): x["val"] for x in diffusion.diffuse(model.graph, diffusion.set_seeds(model.graph, members), **how).collect()}
        got = {x["set_id"]: x["features"] for x in diffusion.set_features(model.graph, members, model.marks, **how).collect()}
        assert got["none"] is None and got["S1"] == pytest.approx([p["S1", "C"], p["S1", "A"]], abs=1e-9) and got["S2"] == pytest.approx([p["S2", "C"], p["S2", "A"]], abs=1e-9)


def test_no_seeds_and_no_edges(spark, model):
    none = spark.createDataFrame([], "node string, col int, val double")
    assert all(diffusion.diffuse(model.graph, none, method=m).count() == 0 for m in ("joins", "blocks"))
    alone = graph.build_graph(edges(spark, [("A", "B", 0.0)]), weight="weight")
    for m in ("joins", "blocks"):
        got = diffusion.random_walk(alone, spark.createDataFrame([("A", 2.0)], "node string, val double"), method=m).collect()
        assert [tuple(r) for r in got] == [("A", 1.0)]


def test_seed_errors(spark, model):
    with pytest.raises(ValueError, match="positive mass"):
        diffusion.random_walk(model.graph, spark.createDataFrame([("C", 0.0)], "node string, val double"))
    with pytest.raises(ValueError, match="not a node"):
        diffusion.random_walk(model.graph, spark.createDataFrame([("Z", 1.0)], "node string, val double"))


def test_graph_rules(spark):
    rows = [("A", "B", 1.0), ("B", "A", 2.0), ("A", "A", 1.0), ("A", "B", 0.5), ("C", "A", None), ("D", "B", 0.0), ("E", "B", 1.0), ("E", "B", -1.0), (None, "B", 1.0)]
    g = graph.build_graph(edges(spark, rows), weight="weight")
    assert adjacency(g) == {("A", "B"): 3.5, ("B", "A"): 3.5, ("A", "A"): 2.0}
    assert [r["node"] for r in g.nodes.orderBy("pos").collect()] == list("ABCDE")
    assert {r["node"]: r["degree"] for r in graph.degrees(g).collect()} == {"A": 2, "B": 1, "C": 0, "D": 0, "E": 0}
    part = graph.build_graph(edges(spark, rows), weight="weight", nodes=["B", "A", "B", "X"])
    assert [r["node"] for r in part.nodes.orderBy("pos").collect()] == ["B", "A", "X"]
    assert graph.build_graph(edges(spark, []), weight="weight").nodes.collect() == []
    with pytest.raises(ValueError, match="missing columns"):
        graph.build_graph(edges(spark), node1="nope")


def test_directed_cycle_transitions(spark):
    g = graph.build_graph(edges(spark, [("A", "B", 0.5), ("B", "C", 0.5), ("C", "A", 1.0), ("A", "C", 0.5)]), weight="weight", directed=True)
    col = {(r["src"], r["dst"]): r["x"] for r in graph.transition(g, "col").collect()}
    assert col == {("A", "B"): 1.0, ("B", "C"): 0.5, ("A", "C"): 0.5, ("C", "A"): 1.0}
    row = {(r["src"], r["dst"]): r["x"] for r in graph.transition(g, "row").collect()}
    assert row == {("A", "B"): 0.5, ("A", "C"): 0.5, ("B", "C"): 1.0, ("C", "A"): 1.0}


def test_set_features_and_empty_sets(spark, model):
    rows = SETS + [("S3", "Z", 0)]
    got = {r["set_id"]: r["features"] for r in diffusion.set_features(model.graph, sets(spark, rows), model.marks).collect()}
    assert got["S1"] == pytest.approx([0.3301886792, 0.2955974843], abs=1e-9)
    assert got["S2"] == pytest.approx([0.1273584906, 0.0283018868], abs=1e-9)
    assert got["S3"] is None


def test_gaussians(spark, model):
    rows = SETS + [("one", "A", 0), ("one", "A", 1), ("none", "Z", 0)]
    got = {r["set_id"]: r for r in gaussians.set_gaussians(model.embedding, sets(spark, rows)).collect()}
    assert np.abs(got["S1"]["mu"]) == pytest.approx([0.1449175840, 0.0159741440], abs=1e-8)
    assert got["S1"]["var"] == pytest.approx([0.0325656276, 0.0893733779], abs=1e-8)
    assert got["one"]["n"] == 1 and got["one"]["var"] == [1e-8, 1e-8]
    assert got["none"]["n"] == 0 and got["none"]["mu"] is None
    with pytest.raises(ValueError, match="no cluster"):
        gaussians.cluster_gaussians(model.embedding, sets(spark, [("one", "A", 0)]))


def test_distances(spark, model):
    table = lambda m: {(r["set_1"], r["set_2"]): r["distance"] for r in model.set_similarity(metric=m).collect()}
    w2, kl, compat = table("w2"), table("sym_kl"), table("sym_kl_compat")
    assert w2["S1", "S1"] == pytest.approx(0, abs=1e-12) and w2["S1", "S2"] == pytest.approx(0.2204560352, abs=1e-8)
    assert kl["S1", "S1"] == pytest.approx(2) and kl["S2", "S1"] == pytest.approx(77.0121750359, rel=1e-7)
    assert compat["S1", "S1"] == pytest.approx(0.7470309719, abs=1e-6) and compat["S2", "S2"] == pytest.approx(-29.9961261374, rel=1e-6)
    assert {(r["set_1"], r["set_2"]) for r in model.set_similarity(sets=["S2", "nope", "S2"]).collect()} == {("S2", "S2")}
    assert len(model.set_similarity(other_sets=["S2"]).collect()) == 2
    with pytest.raises(ValueError, match="no set found"):
        model.set_similarity(sets=["nope"])


def test_cosines(spark, model):
    cos = {(r["gene_1"], r["gene_2"]): r["similarity"] for r in model.gene_similarity().collect()}
    assert len(cos) == 25 and cos["A", "B"] == pytest.approx(-0.1431640032, abs=1e-8) and cos["D", "E"] == pytest.approx(0.9708130985, abs=1e-8)
    zero = spark.createDataFrame([("o", [0.0, 0.0]), ("p", [1.0, 0.0]), (None, [1.0, 1.0]), ("q", None)], "gene string, vec array<double>")
    got = {(r["gene_1"], r["gene_2"]): r["similarity"] for r in similarity.cosine(zero).collect()}
    assert got == {("o", "o"): 0.0, ("o", "p"): 0.0, ("p", "o"): 0.0, ("p", "p"): 1.0}
    top = similarity.cosine_top(model.embedding, 1).collect()
    assert {(r["gene_1"], r["gene_2"]) for r in top} >= {("D", "E"), ("E", "D")}


def test_scores_and_concise_sets(spark, model):
    s = {(r["gene"], r["set_id"]): r["score"] for r in concise.gene_set_scores(model.embedding, model.gaussians).collect()}
    assert s["A", "S1"] == pytest.approx(2.3350196377, abs=1e-7) and s["A", "S2"] == pytest.approx(-83.984738319, rel=1e-7)
    restricted = {(r["gene"], r["set_id"]): r["score"] for r in concise.gene_set_scores(model.embedding, model.gaussians, membership=sets(spark)).collect()}
    assert all(restricted[k] == pytest.approx(s[k]) for k in restricted) and len(restricted) == 5
    pick = lambda **how: {k: [r["gene"] for r in sorted((x for x in rows if x["set_id"] == k), key=lambda r: r["rank"])] for rows in [model.concise_sets(sets(spark), **how).collect()] for k in ("S1", "S2")}
    assert pick(top_n=2, min_size=1) == {"S1": ["A", "B"], "S2": ["D", "E"]}
    assert pick(top_n=1, min_size=2, max_size=1) == {"S1": ["A", "B"], "S2": ["D", "E"]}
    assert pick(top_n=0, min_size=9) == {"S1": ["A", "B", "C"], "S2": ["D", "E"]}
    assert pick(select="softmax_mass", mass=1.0, min_size=0) == {"S1": ["A", "B", "C"], "S2": ["D", "E"]}
    assert pick(select="softmax_mass", mass=0.3, min_size=0) == {"S1": ["A"], "S2": ["D"]}
    assert pick(select="quantile", quantile=0.99, min_size=0)["S1"] == ["A"]
    with pytest.raises(ValueError, match="quantile"):
        model.concise_sets(sets(spark), select="quantile", quantile=1.0)
    assert pick(select="score_threshold", score_threshold=2.2, min_size=0, max_size=9)["S1"] == ["A", "B"]
    with pytest.raises(ValueError):
        model.concise_sets(sets(spark), select="score_threshold")


def stats(spark, rows=STATS):
    return spark.createDataFrame(rows, "gene string, stat double")


def test_enrichment_scores(spark, model):
    got = {r["ID"]: r for r in model.gsea(stats(spark), sets(spark), nperm=0, top_genes=3).collect()}
    assert got["S1"]["ES"] == pytest.approx(0.8221472082, abs=1e-8) and got["S2"]["ES"] == pytest.approx(-1.4933917562, abs=1e-8)
    assert got["S1"]["core_enrichment"] == "A/B/C" and got["S1"]["setSize"] == 3 and got["S1"]["pvalue"] is None
    hub = {r["ID"]: r["ES"] for r in model.gsea(stats(spark), sets(spark), nperm=0, degree_beta=1.0).collect()}
    assert hub["S1"] == pytest.approx(0.7155706339, abs=1e-8) and hub["S2"] == pytest.approx(-1.6619633269, abs=1e-8)
    y = spark.createDataFrame([(g, 1.0 if g in "AB" else 0.0) for g, _ in STATS], "gene string, y double")
    ora = {r["ID"]: r for r in model.ora(y, sets(spark), nperm=0, restrict_to_members=True, top_genes=4).collect()}
    assert ora["S1"]["ES"] == pytest.approx(0.6947044941, abs=1e-8) and ora["S2"]["ES"] == 0
    assert ora["S1"]["core_enrichment"] == "A/B/C/D"  # filled up with a gene of weight 0
    with pytest.raises(ValueError, match="0 or 1"):
        model.ora(spark.createDataFrame([("A", 0.5), ("B", 1.0)], "gene string, y double"))


def test_permutation_null(spark, model):
    genes = enrichment.overlap(stats(spark), model.embedding)
    dealt = enrichment.permuted_stats(genes, 200)
    by = dealt.groupBy("b").agg(F.array_sort(F.collect_list("stat")).alias("s")).select("s").distinct().collect()
    assert [r["s"] for r in by] == [sorted(v for _, v in STATS)]
    w = enrichment.soft_membership(model.embedding, model.gaussians, genes)
    by_b = {r["b"]: r["null"] for r in enrichment.null_scores(w, genes, 200).where("set_id = 'S1'").collect()}
    joined = {r["b"]: r["null"] for r in w.where("set_id = 'S1'").join(dealt, "gene").groupBy("b").agg(F.sum(F.col("w") * F.col("stat")).alias("null")).collect()}
    assert by_b == pytest.approx(joined, abs=1e-12)
    nulls = list(by_b.values())
    weights = {r["gene"]: r["w"] for r in w.where("set_id = 'S1'").collect()}
    assert sum(weights.values()) == pytest.approx(1)
    exact = [sum(weights[g] * v for g, v in zip("ABCDE", p)) for p in itertools.permutations([v for _, v in STATS])]
    assert np.mean(exact) == pytest.approx(0.1) and np.std(exact) == pytest.approx(0.3691847775, abs=1e-8)
    assert all(min(abs(v - e) for e in exact) < 1e-9 for v in nulls)
    assert abs(np.mean(nulls) - 0.1) < 4 * 0.37 / math.sqrt(200)
    for how in enrichment.ALTERNATIVES:
        out = {r["ID"]: r for r in model.gsea(stats(spark), nperm=50, alternative=how).collect()}
        assert all(1 / 50 <= r["pvalue"] <= 1 and r["pvalue"] <= r["p_adjust"] + 1e-12 for r in out.values())
    assert all(r["z"] is None and r["pvalue"] is not None for r in model.gsea(stats(spark), nperm=1).collect())


def test_many_genes_take_the_way_by_joins(spark, model, monkeypatch):
    """Beyond the bound of the broadcast the null scores come from joins, with the same results."""
    run = lambda: {r["ID"]: tuple(r) for r in model.gsea(stats(spark), sets(spark), nperm=30, restrict_to_members=True).collect()}
    near = run()
    monkeypatch.setattr(enrichment, "MAX_BROADCAST_GENES", 0)
    far = run()
    assert near.keys() == far.keys() and all(a == pytest.approx(b) if isinstance(a, float) else a == b for k in near for a, b in zip(near[k], far[k]))


def test_small_pieces_give_the_same_null(spark, model, monkeypatch):
    genes = enrichment.overlap(stats(spark), model.embedding)
    w = enrichment.soft_membership(model.embedding, model.gaussians, genes)
    whole = {(r["set_id"], r["b"]): r["null"] for r in enrichment.null_scores(w, genes, 40).collect()}
    monkeypatch.setattr(enrichment, "HELD", 3)
    assert {(r["set_id"], r["b"]): r["null"] for r in enrichment.null_scores(w, genes, 40).collect()} == pytest.approx(whole)
    r = np.random.default_rng(1)
    values, gene, starts, x = r.normal(size=(50, 7)), r.integers(0, 50, 90), np.array([0, 1, 40, 60]), r.random(90)
    want = np.stack([(values[gene[a:b]] * x[a:b, None]).sum(0) for a, b in zip(starts, [1, 40, 60, 90])])
    for held in (1, 30, 10**6):
        monkeypatch.setattr(enrichment, "HELD", held)
        assert enrichment._sums(x, gene, starts, values) == pytest.approx(want) and enrichment._sums(x, gene, starts, np.tile(values, (40, 1))) == pytest.approx(want)


@pytest.mark.parametrize("n", [1, 2, 5, 257, 1000])
def test_places_are_permutations(n):
    p = permutation.places(np.arange(n), np.arange(1, 41), n, 7)
    assert all(sorted(c) == list(range(n)) for c in p.T.tolist()) and (permutation.places(np.arange(n)[::2], np.arange(9, 12), n, 7) == p[::2, 8:11]).all()
    if n == 5:  # every order is about as likely as any other
        seen = Counter(map(tuple, permutation.places(np.arange(5), np.arange(1, 12001), 5, 1).T.tolist()))
        assert len(seen) == 120 and sum((c - 100) ** 2 / 100 for c in seen.values()) / 119 < 1.5


def test_adjacency_as_a_source(spark):
    rows = [("A", "B", 2.0), ("B", "A", 1.0), ("C", "A", 0.0)]
    table = lambda r: spark.createDataFrame(r, "src string, dst string, w double")
    g = graph.from_adjacency(table(rows))
    assert adjacency(g) == {("A", "B"): 2.0, ("B", "A"): 1.0} and [r["node"] for r in g.nodes.orderBy("pos").collect()] == list("ABC")
    for bad in (("A", None, 1.0), ("A", "B", 3.0), ("A", "C", None), ("A", "C", -1.0), ("A", "C", float("nan")), ("A", "C", float("inf"))):
        with pytest.raises(ValueError):
            graph.from_adjacency(table([*rows, bad]))
    with pytest.raises(ValueError, match="not among"):
        graph.from_adjacency(table(rows), spark.createDataFrame([("A", 0), ("B", 1)], "node string, pos long"))


def test_sets_that_are_not_drawn_move_by_their_momentum(spark):
    """The steps of all sets are those of one Adam over all parameters, with gradients of 0 where nothing is drawn."""
    params = joint._set_start(spark.createDataFrame([("a",), ("b",)], "set_id string"), 2, 1)
    mu = {r["set_id"]: np.array(r["mu"]) for r in params.collect()}
    mean, square = {k: np.zeros(2) for k in mu}, {k: np.zeros(2) for k in mu}
    for step, drawn in enumerate(["a", "b", "b"], 1):
        g = np.array([0.5, -1.0]) * step
        params = joint._stepped(params, spark.createDataFrame([(drawn, g.tolist(), g.tolist())], "set_id string, to_mu array<double>, to_logvar array<double>"), step, 0.1, 2)
        for k in mu:
            mu[k], mean[k], square[k] = joint._adam(mu[k], g if k == drawn else np.zeros(2), mean[k], square[k], step, 0.1)
    assert {r["set_id"]: r["mu"] for r in params.collect()} == {k: pytest.approx(v.tolist()) for k, v in mu.items()}


def test_closest_sets_and_mean_cosines(spark, model):
    closest = {r["set_1"]: (r["set_2"], r["rank"]) for r in similarity.closest_sets(model.gaussians, 1).collect()}
    assert closest == {"S1": ("S2", 1), "S2": ("S1", 1)}
    pairs = model.gene_similarity().groupBy("gene_1").agg(F.avg("similarity").alias("m"))
    assert {r["gene"]: r["mean"] for r in similarity.mean_cosine(model.embedding).collect()} == pytest.approx({r["gene_1"]: r["m"] for r in pairs.collect()})


def test_the_grid_holds_every_pair_once(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(90, 5))
    df = spark.createDataFrame([(f"g{i:02d}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<double>")
    for left, right in ((df, df), (df, df.where("id < 'g07'")), (df.where("id < 'g07'"), df), (df, df.where("false"))):
        got = similarity.pairwise(left, right, ["vec"], ["vec"], "cosine", 1e-12, block=4).collect()
        assert len(got) == left.count() * right.count() == len({(p["id_1"], p["id_2"]) for p in got})


def test_partial_and_dirty_statistics(spark, model):
    some = stats(spark, [("A", 1.0), ("A", 5.0), ("B", 2.0), (None, 1.0), ("Z", 3.0)])
    assert {r["gene"]: r["stat"] for r in enrichment.overlap(some, model.embedding).collect()} == {"A": 1.0, "B": 2.0}
    with pytest.raises(ValueError, match="fewer than two"):
        model.gsea(stats(spark, [("A", 1.0)]))
    null = {r["ID"]: r["ES"] for r in model.gsea(stats(spark, [("A", None), ("B", 1.0), ("D", 1.0)]), sets(spark), nperm=0, restrict_to_members=True).collect()}
    assert null == {"S1": None, "S2": pytest.approx(1.0)}
    with pytest.raises(ValueError, match="unknown sets: nope"):
        model.gsea(stats(spark), sets=["S1", "nope"])
    for bad in ({"temperature": 0}, {"nperm": -1}, {"degree_beta": -1}, {"alternative": "no"}, {"restrict_to_members": True}):
        with pytest.raises(ValueError):
            model.gsea(stats(spark), **bad)


def test_sweep(spark, model):
    long, wide = model.sweep_hub_beta(stats(spark), sets(spark), betas=(0, 0.5, 1), nperm=0)
    assert long.count() == 6
    assert wide.columns == ["ID", "ES_beta_0", "ES_beta_0.5", "ES_beta_1", "deltaES_vs0_0.5", "deltaES_vs0_1"]
    row = {r["ID"]: r for r in wide.collect()}["S1"]
    assert row["deltaES_vs0_1"] == pytest.approx(0.7155706339 - 0.8221472082, abs=1e-8)


def test_false_discovery_rates(spark):
    rows = [(i, p) for i, p in enumerate([0.01, 0.02, 0.02, 0.5, None, 0.04, 0.9, 1.0])]
    got = {r["i"]: r["q_value"] for r in discoveries(spark.createDataFrame(rows, "i int, p double"), "p", ["i"], 7).collect()}
    ps = sorted(p for _, p in rows if p is not None)
    want = {p: min(min(q * 7 / (k + 1) for k, q in enumerate(ps) if q >= p), 1) for p in ps}
    assert got[4] is None and all(got[i] == pytest.approx(want[p]) for i, p in rows if p is not None)
    numbered = with_numbers(spark.range(1000).withColumn("x", F.col("id") * 37 % 1000), ["x"], "t").collect()
    assert all(r["number"] == r["x"] for r in numbered)


def test_autoencoder_and_joint_training_learn(spark, model):
    features = diffusion.node_features(model.graph, model.marks)
    _, losses = autoencoder_embedding(features, 2, epochs=25, lr=0.05)
    loss = [r["loss"] for r in losses.orderBy("epoch").collect()]
    assert loss[-1] < loss[0] / 2
    points, sets_fit, losses = joint_fit(model.graph, sets(spark), model.marks, dim=3, epochs=8, batch_size=2, lr=0.1)
    loss = [r["loss"] for r in losses.orderBy("epoch").collect()]
    assert loss[-1] < loss[0] and points.count() == 5 and {r["set_id"] for r in sets_fit.collect()} == {"S1", "S2"}


def test_autoencoder_takes_a_step_for_each_batch(spark):
    """On 3,000 rows the default epochs come close to the best linear code; one step an epoch stays far from it."""
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 4)) @ r.normal(size=(4, 16)) + r.normal(size=(3000, 16)) * 0.1 + 0.5
    features = spark.createDataFrame([(f"N{i}", i, v.tolist()) for i, v in enumerate(x)], "node string, pos long, features array<double>")
    embedding, losses = autoencoder_embedding(features, 4, lr=0.01)
    z = np.array([row["vec"] for row in embedding.orderBy("pos").collect()])
    centred = x - x.mean(0)
    best = np.square(np.linalg.svd(centred, compute_uv=False)[4:]).sum() / x.size
    code = np.c_[z, np.ones(len(z))]
    decoded = code @ np.linalg.lstsq(code, x, rcond=None)[0]
    assert np.square(decoded - x).mean() < 1.1 * best
    last = losses.orderBy("epoch").collect()[-1]
    assert last["loss"] < 1.1 * best and last["least"] == pytest.approx(best) and last["variance"] == pytest.approx(np.square(centred).mean())


def test_sets_are_drawn_by_hash_at_every_size(spark, model, monkeypatch):
    """The sets of an epoch are those of lowest hash of their names, on small tables too."""
    chosen = []
    epoch = joint._epoch
    monkeypatch.setattr(joint, "_epoch", lambda *a: chosen.append(a[5]) or epoch(*a))
    many = spark.createDataFrame([(f"S{i}", g) for i in range(9) for g in ("A", "B")], "set_id string, gene string")
    joint.joint_fit(model.graph, many, model.marks, dim=2, epochs=3, batch_size=2)
    names = many.select("set_id").distinct()
    want = [[r[0] for r in names.orderBy(F.xxhash64("set_id", F.lit(step), F.lit(1))).limit(2).collect()] for step in (1, 2, 3)]
    assert chosen == want


def test_svd_bounds(spark, model):
    with pytest.raises(ValueError, match="dim"):
        svd_embedding(diffusion.node_features(model.graph, model.marks), 3)


def test_save_and_load(spark, model, tmp_path):
    model.save(str(tmp_path / "m"))
    again = SetEmbedding.load(spark, str(tmp_path / "m"))
    assert again.method == "svd" and again.losses is None
    assert sorted(map(tuple, again.set_similarity().collect())) == sorted(map(tuple, model.set_similarity().collect()))
    assert set(again.all_similarities()) == {"gene_gene", "set_set_w2", "set_set_kl"}
    assert again.cluster_similarity(sets(spark)).count() == 4


def test_wide_tables_become_embeddings(spark):
    wide = spark.createDataFrame([(1, 1.0, 2)], "id int, a double, b int")
    assert similarity.as_embedding(wide, "id").collect()[0]["vec"] == [1.0, 2.0]
    with pytest.raises(ValueError, match="numeric"):
        similarity.as_embedding(spark.createDataFrame([(1, "x")], "id int, a string"), "id")


def test_written_tables_go_to_the_shared_folder(spark):
    from netsets.session import shared_dir

    df = written(spark.range(3).toDF("a"), "t")
    assert df.inputFiles()[0].split(":", 1)[-1].lstrip("/").startswith(shared_dir(spark).split(":", 1)[-1].lstrip("/"))


@pytest.mark.parametrize("scale", [1.0, 1e18])
def test_screened_pairs(monkeypatch, scale):
    """The screen keeps every pair within 1e-9 of a row's limit, has few others, and values them as the kernel does, ties and huge numbers included."""
    monkeypatch.setattr(similarity, "CHUNK", 64)
    random = np.random.default_rng(3)
    mu, var = scale * random.normal(size=(700, 6)), np.square(random.normal(size=(700, 6)))
    mu[100:140], var[100:140] = mu[7], var[7]
    points = similarity.SCREENS["w2"]([mu, var], 1e-8)
    want = similarity.KERNELS["w2"]([mu[:20], var[:20]], [mu, var], 1e-8)
    i, j, value = (np.concatenate(x) for x in zip(*similarity._lowest(points[:20], similarity._factors(points, np.float32), 4)))
    np.testing.assert_allclose(value, want[i, j], rtol=1e-12)
    assert set(zip(*np.nonzero(want <= np.sort(want, axis=1)[:, 3, None] + 1e-9))) == set(zip(i.tolist(), j.tolist()))


def test_closest_sets_copies(spark, monkeypatch):
    """The closest sets leave each cell as so many rows a set, not a block, and a vector goes to few cells."""
    sets = [(f"s{n:04}", [float(x) for x in row[:3]], [float(x) for x in row[3:]]) for n, row in enumerate(np.random.default_rng(5).uniform(0.5, 2, size=(400, 6)))]
    table = spark.createDataFrame(sets, "id string, mu array<double>, var array<double>")
    near = similarity.pairwise(table, table, ["mu", "var"], ["mu", "var"], "w2", 1e-8, top=3, lowest=True, block=16)
    cells = 2 * spark.sparkContext.defaultParallelism + 8
    assert near.rdd.getNumPartitions() <= cells
    rows = near.collect()
    assert len(rows) <= 400 * 3 * 6
    mu, var = np.array([s[1] for s in sets]), np.array([s[2] for s in sets])
    want = similarity.KERNELS["w2"]([mu, var], [mu, var], 1e-8)
    got = {(int(r["id_1"][1:]), int(r["id_2"][1:])): r["value"] for r in rows}
    for n in range(400):
        for k in np.argsort(want[n])[:3]:
            assert abs(got[n, int(k)] - want[n, k]) < 1e-9


def test_walks_by_copies(spark, monkeypatch):
    """Beyond the broadcast bound tasks that hold the edges give the walks of the other ways, long and a node a row, with isolated nodes."""
    random = np.random.default_rng(2)
    rows = [(f"n{a}", f"n{b}", float(w)) for a, b, w in zip(random.integers(0, 60, 150), random.integers(0, 60, 150), random.uniform(0.5, 2, 150))] + [("alone", "alone2", 0.0)]
    g = graph.settled(graph.build_graph(edges(spark, rows), weight="weight"))
    marks = graph.landmarks(g, 7)
    want = {r["node"]: r["features"] for r in diffusion.node_features(g, marks, method="blocks").collect()}
    monkeypatch.setattr(diffusion, "MAX_BROADCAST_EDGES", 10)
    monkeypatch.setattr(diffusion, "PIECE", 16)
    monkeypatch.setattr(diffusion, "NODES", 8)
    monkeypatch.setattr(diffusion, "_by_grid", None)  # the grid moves all values of all nodes in each step
    got = {r["node"]: r for r in diffusion.node_features(g, marks).collect()}
    assert got.keys() == want.keys()
    assert {r["node"]: r["pos"] for r in g.nodes.collect()} == {n: r["pos"] for n, r in got.items()}
    for node, values in want.items():
        np.testing.assert_allclose(got[node]["features"], values, atol=1e-12)
    seeds = spark.createDataFrame([("n1", "a", 1.0), ("n2", "a", 3.0), ("n3", "b", 1.0)], "node string, col string, val double")
    one, two = ({(x["node"], x["col"]): x["val"] for x in diffusion.diffuse(g, seeds, method=m).collect()} for m in ("copies", "blocks"))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-12 for k in one)


def test_joint_distributions_are_a_row_a_node(spark, model, monkeypatch):
    """The distributions that the epochs read have a row for each node, not for each node and landmark or set."""
    tables, epoch = [], joint._epoch
    monkeypatch.setattr(joint, "_epoch", lambda *a: tables.append(a[3].count()) or epoch(*a))
    joint_fit(model.graph, sets(spark), k=3, dim=2, epochs=1)
    assert tables == [model.graph.nodes.count()]
