"""Joint training of node points and set Gaussians on diffusion distributions.

Each node has a point z; each set a Gaussian (mu, log variance). A landmark's point should give, by a softmax over all nodes of
the negative squared distances / tau, the landmark's diffusion distribution; a set's Gaussian log-likelihoods should give the
set's. The nodes' points and their optimiser state stay a table: an epoch asks every partition for its part of the softmax
sums, then for its part of the gradients of the epoch's batch, and updates the points in place. Only the batch's
landmarks and sets (a few vectors) pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsets.contracts import check
from netsets.functions.batches import matrix
from netsets.operators.diffusion import set_seeds, spread_over
from netsets.operators.graph import Graph, landmarks
from netsets.session import discard, tidy, written


def _logits(z: np.ndarray, points: np.ndarray, mu: np.ndarray, logvar: np.ndarray, tau: float) -> np.ndarray:
    """node x (landmarks, sets): what the softmax over nodes takes."""
    to_points = -np.square(z[:, None, :] - points[None, :, :]).sum(2)
    to_sets = -0.5 * (np.square(z[:, None, :] - mu[None, :, :]) / np.exp(logvar)[None, :, :] + logvar[None, :, :]).sum(2)
    return np.concatenate([to_points, to_sets], axis=1) / tau


def _adam(value, grad, mean, square, step, lr):
    mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * np.square(grad)
    return value - lr * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8), mean, square


def _start(nodes: DataFrame, dim: int, seed: int) -> DataFrame:
    """Normal starting points from a hash of the node and the dimension, and empty optimiser state."""
    uniform = lambda i, s: (F.pmod(F.xxhash64("node", i, F.lit(s)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = lambda i: F.sqrt(-2 * F.ln(uniform(i, 2 * seed))) * F.cos(F.lit(2 * np.pi) * uniform(i, 2 * seed + 1))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return nodes.select("node", "pos", F.transform(F.sequence(F.lit(1), F.lit(dim)), normal).alias("z"), zeros.alias("mean"), zeros.alias("square"))


def joint_fit(graph: Graph, membership: DataFrame, marks: DataFrame | None = None, k: int = 128, dim: int = 64, tau: float = 1.0, lambda_set: float = 1.0, epochs: int = 200, lr: float = 5e-3, batch_size: int = 8, seed: int = 1, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gene, pos, vec), (set_id, mu, var) and (epoch, loss).

    Every epoch takes `batch_size` landmarks and sets, drawn by the seed, and one Adam step of all points and sets: what isn't drawn
    has a gradient of 0 and moves by its momentum. Sets without members in the graph are dropped. The result depends on the
    seed alone.
    """
    check(tau > 0 and lambda_set >= 0 and batch_size >= 1 and epochs >= 0, "tau and batch_size must be positive")
    spark = graph.nodes.sparkSession
    marks = written(marks if marks is not None else landmarks(graph, k), "landmarks")
    seeds = marks.select(F.col("landmark").alias("node"), F.concat(F.lit("l:"), "landmark").alias("col"), F.lit(1.0).alias("val"))
    sets = set_seeds(graph, membership).withColumn("col", F.concat(F.lit("s:"), "col"))
    by_draw = lambda t, c: t.select(c).distinct().orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), c)), c)
    names = [r[0] for r in by_draw(marks, "landmark").collect()]  # k names
    state = written(_start(graph.nodes, dim, seed), "points")
    random = np.random.default_rng(seed)
    params = written(_set_start(sets.select(F.substring("col", 3, 1 << 20).alias("set_id")).distinct(), dim, seed), "sets")
    draws = [_drawn(params, batch_size, step, seed) for step in range(1, epochs + 1)]
    # only sets that some epoch draws need a distribution
    drawn = [f"s:{s}" for s in sorted({s for own in draws for s in own})]
    wanted = spark.createDataFrame([(c,) for c in drawn], "col string")
    columns = [*(f"l:{name}" for name in names), *drawn]
    tidy(spark)
    spread = written(spread_over(graph, seeds.unionByName(sets.join(wanted, "col", "left_semi")), columns, **how).select("node", "features"), "distributions")
    tidy(spark)
    at = {c: k for k, c in enumerate(columns)}
    losses = []
    for step in range(1, epochs + 1):
        own = sorted(random.choice(len(names), min(batch_size, len(names)), replace=False).tolist())
        own = [names[i] for i in own]
        chosen = draws[step - 1]
        before = (state, params)
        state, params, loss = _epoch(spark, state, params, spread, own, chosen, step, lr, tau, lambda_set, dim, at)
        discard(*before)
        tidy(spark)
        losses.append((step, loss))
    points = state.select(F.col("node").alias("gene"), "pos", F.col("z").alias("vec"))
    gaussians = params.select("set_id", "mu", F.transform("logvar", F.exp).alias("var"))
    return points, gaussians, spark.createDataFrame(losses, "epoch int, loss double")


def _drawn(params: DataFrame, batch_size: int, step: int, seed: int) -> list[str]:
    """The sets of one epoch: those of lowest hash, whatever their number."""
    draw = F.xxhash64("set_id", F.lit(step), F.lit(seed))
    return [r[0] for r in params.orderBy(draw, "set_id").limit(batch_size).select("set_id").collect()]


def _set_start(sets: DataFrame, dim: int, seed: int) -> DataFrame:
    started = _start(sets.select(F.col("set_id").alias("node"), F.lit(0).alias("pos")), dim, seed + 1)
    zeros = F.array_repeat(F.lit(0.0), dim)
    return started.select(F.col("node").alias("set_id"), F.col("z").alias("mu"), F.array_repeat(F.lit(-2.0), dim).alias("logvar"), *[zeros.alias(c) for c in ("mean_mu", "square_mu", "mean_lv", "square_lv")])


def _epoch(spark, state, params, spread, own, chosen, step, lr, tau, lambda_set, dim, at):
    """One batch: the new points, the new set parameters and the loss."""
    starts = {r["node"]: np.array(r["z"]) for r in state.where(F.col("node").isin(own)).select("node", "z").collect()}
    points = np.stack([starts[name] for name in own])
    rows = {r["set_id"]: r for r in params.where(F.col("set_id").isin(chosen)).collect()}
    mu = np.array([rows[s]["mu"] for s in chosen]).reshape(-1, dim)
    logvar = np.array([rows[s]["logvar"] for s in chosen]).reshape(-1, dim)
    columns = [f"l:{m}" for m in own] + [f"s:{s}" for s in chosen]
    weight = np.r_[np.full(len(own), 1 / len(own)), np.full(len(chosen), lambda_set / max(1, len(chosen)))]
    target = F.array(*[F.col("features")[at[c]] for c in columns])
    batch_rows = written(state.join(spread.select("node", target.alias("target")), "node").select("node", "pos", "z", "mean", "square", "target"), "batch")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = total = None
        for batch in batches:
            if batch.num_rows:
                logits = _logits(matrix(batch.column(0)), points, mu, logvar, tau)
                top = logits.max(0) if high is None else np.maximum(high, logits.max(0))
                total = np.exp(logits - top).sum(0) + (0 if high is None else total * np.exp(high - top))
                high = top
        if high is not None:
            yield pa.RecordBatch.from_arrays([pa.array([high.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["high", "total"])

    parts = [(np.frombuffer(r["high"]), np.frombuffer(r["total"])) for r in batch_rows.select("z").mapInArrow(sums, "high binary, total binary").collect()]
    high = np.max([h for h, _ in parts], axis=0)
    log_total = high + np.log(sum(t * np.exp(h - high) for h, t in parts))

    def pulls(z: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """d loss / d logits, and the softmax's logarithm."""
        logs = _logits(z, points, mu, logvar, tau) - log_total
        return weight * (np.exp(logs) - target) / tau, logs

    n = len(own)

    def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if batch.num_rows:
                z, target = matrix(batch.column("z")), matrix(batch.column("target"))
                pull, logs = pulls(z, target)
                to_points = 2 * (pull[:, :n].T @ z - pull[:, :n].sum(0)[:, None] * points)
                precision = np.exp(-logvar)
                to_mu = (pull[:, n:].T @ z - pull[:, n:].sum(0)[:, None] * mu) * precision
                squares = np.stack([pull[:, n + s] @ np.square(z - mu[s]) for s in range(len(mu))]) if len(mu) else np.zeros((0, z.shape[1]))
                to_logvar = 0.5 * (squares * precision - pull[:, n:].sum(0)[:, None])
                own_sums = np.concatenate([to_points.ravel(), to_mu.ravel(), to_logvar.ravel(), [-(weight * target * logs).sum()]])
                out = own_sums if out is None else out + own_sums
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    total = sum(np.frombuffer(r["sums"]) for r in batch_rows.select("z", "target").mapInArrow(gradients, "sums binary").collect())
    to_points, to_mu, to_logvar = (x.reshape(-1, dim) for x in np.split(total[:-1], np.cumsum([points.size, mu.size])))
    extra = dict(zip(own, to_points))

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z, target = matrix(batch.column("z")), matrix(batch.column("target"))
                pull, _ = pulls(z, target)
                precision = np.exp(-logvar)
                grad = -2 * (pull[:, :n].sum(1)[:, None] * z - pull[:, :n] @ points)
                grad -= (pull[:, n:] @ precision) * z - pull[:, n:] @ (precision * mu)
                for i, name in enumerate(batch.column("node").to_pylist()):
                    if name in extra:
                        grad[i] += extra[name]
                new = _adam(z, grad, matrix(batch.column("mean")), matrix(batch.column("square")), step, lr)
                offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("pos"), *[pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in new]], names=["node", "pos", "z", "mean", "square"])

    kinds = dict(batch_rows.dtypes)
    state = written(batch_rows.mapInArrow(moved, f"node {kinds['node']}, pos {kinds['pos']}, z array<double>, mean array<double>, square array<double>"), "points")
    discard(batch_rows)
    drawn = spark.createDataFrame([(s, to_mu[k].tolist(), to_logvar[k].tolist()) for k, s in enumerate(chosen)], "set_id string, to_mu array<double>, to_logvar array<double>")
    return state, written(_stepped(params, drawn, step, lr, dim), "sets"), float(total[-1])


def _stepped(params: DataFrame, drawn: DataFrame, step: int, lr: float, dim: int) -> DataFrame:
    """All sets after the epoch's Adam step; those that weren't drawn have a gradient of 0 and move by their momentum."""
    rows = params.join(F.broadcast(drawn), "set_id", "left")  # at most batch_size rows
    zeros = F.array_repeat(F.lit(0.0), dim)
    for value, grad, mean, square in (("mu", "to_mu", "mean_mu", "square_mu"), ("logvar", "to_logvar", "mean_lv", "square_lv")):
        g = F.coalesce(grad, zeros)
        rows = rows.withColumn(mean, F.zip_with(mean, g, lambda m, x: 0.9 * m + 0.1 * x)).withColumn(square, F.zip_with(square, g, lambda s, x: 0.999 * s + 0.001 * x * x))
        move = F.zip_with(mean, square, lambda m, s: lr * (m / (1 - 0.9**step)) / (F.sqrt(s / (1 - 0.999**step)) + 1e-8))
        rows = rows.withColumn(value, F.zip_with(value, move, lambda v, d: v - d))
    return rows.select(params.columns)
