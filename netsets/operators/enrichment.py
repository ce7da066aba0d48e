"""Soft-membership enrichment of gene statistics in sets, with a permutation null."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsets.contracts import check, embedding_contract, finite, membership_contract, one_of, require
from netsets.functions.numbering import discoveries, with_numbers
from netsets.operators.concise import gene_set_scores
from netsets.operators.graph import Graph, degrees
from netsets.operators.permutation import places
from netsets.session import written

ALTERNATIVES = ("two.sided", "greater", "less")
#: Genes whose statistics may be broadcast to the tasks (8 bytes each).
MAX_BROADCAST_GENES = 4_000_000
#: Weights, and null scores, that a task holds at once.
HELD = 4_000_000
#: A null score counts as reaching a score when it is this close to it.
TIE = 1e-9


def overlap(stats: DataFrame, embedding: DataFrame, stat: str = "stat") -> DataFrame:
    """(gene, pos, stat): the embedding's genes that have a statistic; of a repeated gene the first by `pos` (or the lowest statistic) counts.

    A null statistic stays null. ValueError with fewer than two genes.
    """
    require(stats, "gene", stat)
    pos = F.col("pos") if "pos" in stats.columns else F.lit(0)
    slim = stats.select(F.col("gene").cast("string").alias("gene"), pos.alias("pos"), F.col(stat).cast("double").alias("stat")).where("gene is not null")
    first = slim.groupBy("gene").agg(F.min(F.struct("pos", "stat")).alias("s"))
    order = F.col("s.pos") if "pos" in stats.columns else F.col("gene")
    found = written(first.select("gene", order.alias("pos"), F.col("s.stat").alias("stat")).join(embedding_contract(embedding).select("gene"), "gene", "left_semi"), "overlap")
    check(found.count() >= 2, "fewer than two genes have both a statistic and an embedding")
    return found


def soft_membership(embedding: DataFrame, gaussians: DataFrame, genes: DataFrame, membership: DataFrame | None = None, score: str = "loglik", temperature: float = 1.0, restrict_to_members: bool = False, eps: float = 1e-8) -> DataFrame:
    """(set_id, gene, pos, w): softmax of the scores / temperature over each set's genes among `genes`; members alone if restricted.

    A pair left out has weight 0. The largest score is taken off first; weights that aren't finite count 0.
    """
    check(temperature > 0, "temperature must be positive")
    check(not restrict_to_members or membership is not None, "restriction needs the membership")
    known = embedding_contract(embedding).drop("pos").join(genes.select("gene", "pos"), "gene")
    scores = gene_set_scores(known, gaussians, score, eps, membership if restrict_to_members else None)
    if restrict_to_members:
        scores = scores.drop("pos").join(genes.select("gene", "pos"), "gene")
    top = scores.where(~F.isnan("score")).groupBy("set_id").agg(F.max("score").alias("top"))
    raw = scores.join(top, "set_id").select("set_id", "gene", "pos", finite(F.exp((F.col("score") - F.col("top")) / temperature)).alias("w"))
    return _normalised(raw, eps)


def _normalised(raw: DataFrame, eps: float) -> DataFrame:
    sums = raw.groupBy("set_id").agg(F.greatest(F.sum("w"), F.lit(eps)).alias("total"))
    return raw.join(sums, "set_id").select("set_id", "gene", "pos", (F.col("w") / F.col("total")).alias("w"))


def hub_weights(weights: DataFrame, degree: DataFrame, beta: float, eps: float = 1e-8) -> DataFrame:
    """Weights divided by max(degree, 1)^beta and scaled to sum 1 again; genes without a degree count as 1. beta 0 changes nothing."""
    check(np.isfinite(beta) and beta >= 0, "beta must be finite and not negative")
    if abs(beta) < 1.5e-8:
        return weights
    own = degree.select(F.col("node").alias("gene"), "degree")
    lowered = weights.join(own, "gene", "left").withColumn("w", finite(F.col("w") / F.pow(F.greatest(F.coalesce("degree", F.lit(0.0)), F.lit(1.0)), F.lit(float(beta)))))
    return _normalised(lowered, eps)


def permuted_stats(genes: DataFrame, nperm: int, seed: int = 1) -> DataFrame:
    """(b, gene, stat): for each permutation b of 1..nperm the statistics dealt to the genes anew.

    The gene at place i of the genes' binary order gets the statistic of place permutation.places(i, b); all sets share b.
    """
    check(nperm >= 1, "nperm must be at least 1")
    own = _numbered(genes)
    n = own.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_once = max(1, HELD // nperm)
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                to = places(part.column("number").to_numpy(), np.arange(1, nperm + 1), n, seed)
                genes = part.column("gene").take(pa.array(np.repeat(np.arange(len(to)), nperm)))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(1, nperm + 1, dtype=np.int32), len(to))), genes, pa.array(to.ravel())], names=["b", "gene", "number"])

    dealt = own.select("gene", "number").mapInArrow(run, "b int, gene string, number long")
    return dealt.join(own.select("number", "stat"), "number").select("b", "gene", "stat")


def _numbered(genes: DataFrame) -> DataFrame:
    """(gene, stat, number): genes numbered 0, 1, ... in binary order."""
    return with_numbers(genes.select("gene", "stat"), ["gene"], "numbered-genes").select("gene", "stat", "number")


def _sums(w: np.ndarray, gene: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Weighted sums of the rows of `values`, one for each run of weights: by a product where the runs are dense, else run by run."""
    ends = np.r_[starts[1:], len(w)]
    out = np.empty((len(starts), values.shape[1]))
    if len(w) * 20 > len(starts) * len(values):
        for at in range(0, len(starts), max(1, HELD // len(values))):
            to = min(at + max(1, HELD // len(values)), len(starts))
            rows = slice(starts[at], ends[to - 1])
            dense = np.zeros((to - at, len(values)))
            np.add.at(dense, (np.repeat(np.arange(to - at), ends[at:to] - starts[at:to]), gene[rows]), w[rows])
            out[at:to] = dense @ values
        return out
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(w), max(1, HELD // values.shape[1]))))
    for at, to in zip(cuts, np.r_[cuts[1:], len(starts)]):
        if at < to:
            rows = slice(starts[at], ends[to - 1])
            out[at:to] = np.add.reduceat(values[gene[rows]] * w[rows, None], starts[at:to] - starts[at], axis=0)
    return out


def _null_kernel(stats, nperm: int, seed: int, keys: list[str], emit):
    """For each run of equal keys in sorted rows (keys, number, w): emit(one row of each key, scores, null scores keys x nperm).

    Each permutation is computed where it is needed: once for all keys that a task holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stat = stats.value
        held: list[pa.RecordBatch] = []

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, known
            table = pa.Table.from_batches(held).combine_chunks()
            codes = np.stack([table.column(k).chunk(0).dictionary_encode().indices.to_numpy() for k in keys])
            starts = np.flatnonzero(np.r_[True, (codes[:, 1:] != codes[:, :-1]).any(0)])
            cut = table.num_rows if final else int(starts[-1])  # the last key may go on
            if cut:
                own = starts[starts < cut]
                gene, w = (table.column(c).to_numpy()[:cut] for c in ("number", "w"))
                used, at = np.unique(gene, return_inverse=True)
                null = np.empty((len(own), nperm))
                step = max(1, HELD // len(used))
                for b in range(1, nperm + 1, step):
                    which = np.arange(b, min(b + step, nperm + 1))
                    null[:, which - 1] = _sums(w, at, own, stat[places(used, which, len(stat), seed)])
                yield emit(table.select(keys).take(pa.array(own)), _sums(w, at, own, stat[used, None])[:, 0], null)
            held = table.slice(cut).to_batches()
            known = 0

        known = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                first = batch.column(keys[-1]).dictionary_encode()
                known += len(first.dictionary)
                if sum(b.num_rows for b in held) >= HELD or known * nperm >= HELD:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return run


def _null_rows(weights: DataFrame, genes: DataFrame, nperm: int, seed: int, keys: list[str], emit, schema: str) -> DataFrame | None:
    """What `emit` makes of the keys' null scores; None where there are too many genes to broadcast their statistics."""
    numbered = _numbered(genes)
    n = numbered.count()
    if n > MAX_BROADCAST_GENES:
        return None
    stats = numbered.select("number", "stat").toArrow()  # at most MAX_BROADCAST_GENES rows
    stat = np.empty(n)
    stat[stats.column("number").to_numpy()] = stats.column("stat").to_numpy()
    shared = weights.sparkSession.sparkContext.broadcast(stat)
    rows = weights.join(numbered.select("gene", "number"), "gene").where("w <> 0").select(*keys, "number", "w")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_null_kernel(shared, nperm, seed, keys, emit), schema)


def null_scores(weights: DataFrame, genes: DataFrame, nperm: int, seed: int = 1) -> DataFrame:
    """(set_id, b, null): each set's weighted sum of each permutation's statistics (gene, stat)."""

    def emit(known: pa.Table, score: np.ndarray, null: np.ndarray) -> pa.RecordBatch:
        names = known.column("set_id").combine_chunks().take(pa.array(np.repeat(np.arange(len(null)), nperm)))
        return pa.RecordBatch.from_arrays([names, pa.array(np.tile(np.arange(1, nperm + 1, dtype=np.int32), len(null))), pa.array(null.ravel())], names=["set_id", "b", "null"])

    found = _null_rows(weights, genes, nperm, seed, ["set_id"], emit, "set_id string, b int, null double")
    return found if found is not None else _nulls_by_joins(weights, genes, nperm, seed, ["set_id"])


def _nulls_by_joins(weights: DataFrame, genes: DataFrame, nperm: int, seed: int, keys: list[str]) -> DataFrame:
    """(keys, b, null): null scores where the statistics are too many to broadcast."""
    dealt = permuted_stats(genes, nperm, seed)
    return weights.where("w <> 0").join(dealt, "gene").groupBy(*keys, "b").agg(F.sum(F.col("w") * F.col("stat")).alias("null"))


@dataclass(frozen=True)
class Options:
    """How to test; the names and defaults of every enrichment entry."""

    score: str = "loglik"
    temperature: float = 1.0
    nperm: int = 1000
    alternative: str = "two.sided"
    seed: int = 1
    eps: float = 1e-8
    top_genes: int = 30
    restrict_to_members: bool = False
    degree_beta: float = 0.0
    drop_zero_weight: bool = False

    def __post_init__(self):
        one_of(self.alternative, ALTERNATIVES, "alternative")
        check(self.temperature > 0, "temperature must be positive")
        check(self.nperm >= 0 and self.top_genes >= 0, "nperm and top_genes must not be negative")
        check(np.isfinite(self.degree_beta) and self.degree_beta >= 0, "degree_beta must be finite and not negative")


def _p_values(weights: DataFrame, genes: DataFrame, o: Options, keys: list[str]) -> DataFrame:
    """(keys, z, pvalue) of the sets that have weights."""

    def emit(known: pa.Table, score: np.ndarray, null: np.ndarray) -> pa.RecordBatch:
        mean = null.mean(1)
        spread = null.std(1, ddof=1) if o.nperm > 1 else np.full(len(null), np.nan)
        beyond = {"greater": lambda: null >= score[:, None] - TIE, "less": lambda: null <= score[:, None] + TIE, "two.sided": lambda: np.abs(null - mean[:, None]) >= np.abs(score - mean)[:, None] - TIE}[o.alternative]()
        z = pa.array((score - mean) / np.maximum(spread, o.eps), mask=np.isnan(spread))
        return pa.RecordBatch.from_arrays([*[known.column(k).combine_chunks() for k in keys], z, pa.array(np.maximum(beyond.mean(1), 1 / o.nperm))], names=[*keys, "z", "pvalue"])

    kinds = dict(weights.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "z double, pvalue double"])
    found = _null_rows(weights, genes, o.nperm, o.seed, keys, emit, schema)
    if found is not None:
        return found
    nulls = written(_nulls_by_joins(weights, genes, o.nperm, o.seed, keys), "null-scores")
    es = weights.join(genes.select("gene", "stat"), "gene").groupBy(*keys).agg(F.sum(F.col("w") * F.col("stat")).alias("ES"))
    moments = nulls.groupBy(*keys).agg(F.avg("null").alias("m"), F.stddev_samp("null").alias("sd"))
    both = nulls.join(es.join(moments, keys), keys)
    beyond = {"greater": F.col("null") >= F.col("ES") - TIE, "less": F.col("null") <= F.col("ES") + TIE, "two.sided": F.abs(F.col("null") - F.col("m")) >= F.abs(F.col("ES") - F.col("m")) - TIE}[o.alternative]
    shares = both.groupBy(*keys, "ES", "m", "sd").agg(F.avg(beyond.cast("double")).alias("share"))
    z = (F.col("ES") - F.col("m")) / F.when(F.col("sd").isNotNull(), F.greatest("sd", F.lit(o.eps)))
    return shares.select(*keys, z.alias("z"), F.greatest("share", F.lit(1.0 / o.nperm)).alias("pvalue"))


def core_genes(weights: DataFrame, genes: DataFrame, top_genes: int, drop_zero_weight: bool = False, keys: tuple[str, ...] = ("set_id",)) -> DataFrame:
    """(keys, core_enrichment): each set's genes of highest weight (to 12 decimals, ties by the genes' order), joined by "/".

    As a set's genes outside a restriction weigh 0, a small set is filled up with other genes unless `drop_zero_weight`.
    """
    order = Window.partitionBy(*keys).orderBy(F.round("w", 12).desc(), "pos")
    rows = weights.select(*keys, "gene", "pos", "w")
    rows = rows.where("w > 0") if drop_zero_weight else rows.where(F.round("w", 12) > 0)
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_genes)
    listed = weights.select(*keys).distinct().join(best, list(keys), "left").groupBy(*keys).agg(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gene"))), lambda s: s["gene"]), lambda g: g.isNotNull()).alias("l"))
    if not drop_zero_weight:
        # what may fill up a set, all of it at weight 0: the first genes in order, at most twice top_genes of them
        fill = [r["gene"] for r in genes.orderBy("pos").limit(2 * top_genes).select("gene").collect()]
        spare = F.array(*[F.lit(g) for g in fill]).cast("array<string>")
        listed = listed.withColumn("l", F.slice(F.concat("l", F.array_except(spare, "l")), 1, top_genes))
    return listed.select(*keys, F.array_join("l", "/").alias("core_enrichment"))


def enrichment(stats: DataFrame, embedding: DataFrame, gaussians: DataFrame, membership: DataFrame | None = None, graph: Graph | None = None, sets: list[str] | None = None, stat: str = "stat", **options) -> DataFrame:
    """(ID, ES, z, pvalue, p_adjust, setSize, core_enrichment, degree_beta) of each set.

    ES is the sum of weight times statistic over the genes that have both a statistic and an embedding; z and the p-value compare
    it with permutations of the statistics; rates of false discovery are over all tested sets. Without permutations z and
    p-values are null, with one z is null. A set without a Gaussian, or restricted to members it doesn't have, has ES 0, and z
    0 and p 1 (two-sided). setSize counts a set's members among the genes, null where its members aren't known. Unknown
    `sets` are an error. A null statistic makes ES null where it has weight, and z and p null for all sets with weights.
    """
    o = Options(**options)
    tested, genes, weights = _prepared(stats, embedding, gaussians, membership, sets, stat, o)
    if o.degree_beta:
        check(graph is not None, "degree_beta needs the graph")
        weights = written(hub_weights(weights, degrees(graph, weighted=True), o.degree_beta, o.eps), "weights")
    return _tested(tested, genes, weights.withColumn("degree_beta", F.lit(float(o.degree_beta))), membership, o, [float(o.degree_beta)])


def _prepared(stats: DataFrame, embedding: DataFrame, gaussians: DataFrame, membership: DataFrame | None, sets: list[str] | None, stat: str, o: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tested sets, the genes with their statistics, and the soft membership."""
    check(not o.restrict_to_members or membership is not None, "restriction needs the membership")
    tested = gaussians.select(F.col("set_id").cast("string").alias("set_id"), "mu", "var")
    if sets is not None:
        asked = stats.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(sets)], "set_id string")
        unknown = [r["set_id"] for r in asked.join(tested, "set_id", "left_anti").limit(3).collect()]
        check(not unknown, f"unknown sets: {', '.join(unknown)}")
        tested = tested.join(asked, "set_id", "left_semi")
    tested = written(tested, "tested")
    genes = overlap(stats, embedding, stat)
    weights = soft_membership(embedding, tested, genes, membership, o.score, o.temperature, o.restrict_to_members, o.eps)
    return tested, genes, written(weights, "weights")


def _tested(tested: DataFrame, genes: DataFrame, weights: DataFrame, membership: DataFrame | None, o: Options, betas: list[float]) -> DataFrame:
    """The tests of all sets and betas in one plan; `weights` has a column degree_beta. Rates are of each beta's tests."""
    keys = ["degree_beta", "set_id"]
    every = tested.select(F.explode(F.array(*[F.lit(b) for b in betas])).alias("degree_beta"), "set_id")
    undefined = not genes.where("stat is null").isEmpty()
    total = F.sum(F.col("w") * F.col("stat"))
    if undefined:
        total = F.when(F.count_if(F.col("stat").isNull() & (F.col("w") != 0)) == 0, total)
    sums = weights.join(genes.select("gene", "stat"), "gene").groupBy(*keys).agg(total.alias("ES"), F.lit(True).alias("weighed"))
    result = every.join(sums, keys, "left").select(*keys, F.when(F.col("weighed").isNull(), F.lit(0.0)).otherwise(F.col("ES")).alias("ES"), F.coalesce("weighed", F.lit(False)).alias("weighed"))
    if o.nperm and not undefined:
        result = result.join(_p_values(weights, genes, o, keys), keys, "left")
    else:
        result = result.withColumn("z", F.lit(None).cast("double")).withColumn("pvalue", F.lit(None).cast("double"))
    if o.nperm:
        # a set without weights: its score and all its null scores are 0
        flat = F.col("pvalue").isNull() & (F.col("ES") == 0) & (~F.col("weighed") if undefined else F.lit(True))
        result = result.withColumn("z", F.when(flat, F.lit(0.0) if o.nperm > 1 else F.lit(None)).otherwise(F.col("z"))).withColumn("pvalue", F.when(flat, F.lit(1.0)).otherwise(F.col("pvalue")))
    result = written(result.drop("weighed"), "tests")
    rated = None
    for b in betas:
        own = result.where(F.col("degree_beta") == b)
        own = discoveries(own, "pvalue", ["set_id"], own.where("pvalue is not null").count(), "p_adjust") if o.nperm else own.withColumn("p_adjust", F.lit(None).cast("double"))
        rated = own if rated is None else rated.unionByName(own)
    if membership is not None:
        sizes = membership_contract(membership).join(genes.select("gene"), "gene", "left_semi").groupBy("set_id").agg(F.count(F.lit(1)).cast("int").alias("members"))
        known = membership.select(F.col("set_id").cast("string").alias("set_id")).distinct().withColumn("known", F.lit(True))
        rated = rated.join(known, "set_id", "left").join(sizes, "set_id", "left").withColumn("setSize", F.when(F.col("known"), F.coalesce("members", F.lit(0))))
    else:
        rated = rated.withColumn("setSize", F.lit(None).cast("int"))
    if o.top_genes:
        rated = rated.join(core_genes(weights, genes, o.top_genes, o.drop_zero_weight, tuple(keys)), keys, "left")
    else:
        rated = rated.withColumn("core_enrichment", F.lit(None).cast("string"))
    return rated.select(F.col("set_id").alias("ID"), "ES", "z", "pvalue", "p_adjust", "setSize", "core_enrichment", "degree_beta")


def gsea(stats: DataFrame, *args, **kwargs) -> DataFrame:
    """Enrichment of a continuous statistic (gene, stat)."""
    return enrichment(stats, *args, **kwargs)


def _check_labels(labels: DataFrame, stat: str) -> None:
    require(labels, "gene", stat)
    value = F.col(stat).cast("double")
    check(labels.where(value.isNotNull() & ~value.isin(0.0, 1.0)).isEmpty(), "labels must be 0 or 1")


def ora(labels: DataFrame, *args, stat: str = "y", **kwargs) -> DataFrame:
    """Enrichment of 0/1 labels (gene, y); ValueError for other values. A null label makes the ES of sets that weigh it null."""
    _check_labels(labels, stat)
    return enrichment(labels, *args, stat=stat, **kwargs)


def sweep_hub_beta(stats: DataFrame, embedding: DataFrame, gaussians: DataFrame, membership: DataFrame | None = None, graph: Graph | None = None, betas: tuple[float, ...] = (0, 0.25, 0.5, 1), mode: str = "gsea", sets: list[str] | None = None, stat: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Enrichment for each beta: the long table, and (ID, ES_beta_<b>..., deltaES_vs0_<b>...) with deltas where 0 is among the betas.

    The soft membership is made once, and all betas are weighed and tested in one plan with the same permutations.
    """
    stat = stat or {"gsea": "stat", "ora": "y"}[one_of(mode, ("gsea", "ora"), "mode")]
    check(len(betas) > 0 and all(np.isfinite(b) and b >= 0 for b in betas), "betas must be finite and not negative")
    betas = list(dict.fromkeys(float(b) for b in betas))
    check(graph is not None or not any(betas), "betas above 0 need the graph")
    if mode == "ora":
        _check_labels(stats, stat)
    o = Options(**options)
    tested, genes, weights = _prepared(stats, embedding, gaussians, membership, sets, stat, o)
    degree = written(degrees(graph, weighted=True), "degrees") if any(betas) else None
    swept = None
    for b in betas:
        own = (hub_weights(weights, degree, b, o.eps) if b else weights).withColumn("degree_beta", F.lit(b))
        swept = own if swept is None else swept.unionByName(own)
    long = written(_tested(tested, genes, written(swept, "swept-weights"), membership, o, betas), "sweep")
    wide = long.groupBy("ID").pivot("degree_beta", betas).agg(F.first("ES"))
    named = wide.select("ID", *[F.col(f"`{b}`").alias(f"ES_beta_{b:g}") for b in betas])
    deltas = [(F.col(f"`ES_beta_{b:g}`") - F.col("ES_beta_0")).alias(f"deltaES_vs0_{b:g}") for b in betas if b] if 0.0 in betas else []
    return long, named.select("*", *deltas)
