"""Dimension reduction of node features: centred SVD, and a linear autoencoder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from netsets.contracts import check, require, width
from netsets.functions.batches import mapped, summed
from netsets.session import tidy, written

#: The autoencoder is trained when its error is this close to the lowest possible one, as a share of the features' variance.
SETTLED = 1e-6


def _centred(features: DataFrame, dim: int) -> tuple[DataFrame, int, int, np.ndarray]:
    rows = require(features, "node", "pos", "features").where("features is not null")
    rows = written(rows, "features")
    tidy(rows.sparkSession)
    k, n = width(rows, "features"), rows.count()
    check(1 <= dim <= max(k, 1) and n > 0, f"dim must be between 1 and the number of features, {k}")
    return rows, k, n, summed(rows, "features", lambda x: x.sum(0)) / n


def svd_embedding(features: DataFrame, dim: int = 64) -> DataFrame:
    """(gene, pos, vec): the centred features times their first `dim` right singular vectors, that is U D.

    The signs of components are arbitrary; here the largest entry of each singular vector is positive. Rows without features are
    left out. The features' second moments (k x k, k the number of landmarks) are summed over the partitions.
    """
    rows, k, _, mean = _centred(features, dim)
    moments = summed(rows, "features", lambda x: ((x - mean).T @ (x - mean)).ravel()).reshape(k, k)
    _, vectors = np.linalg.eigh(moments)
    turn = vectors[:, ::-1][:, :dim]
    turn = turn * np.sign(turn[np.abs(turn).argmax(0), np.arange(dim)])
    return mapped(rows.withColumnRenamed("node", "gene"), "features", "vec", lambda x: (x - mean) @ turn)


def autoencoder_embedding(features: DataFrame, dim: int = 64, epochs: int = 50, lr: float = 1e-3, seed: int = 1, batch_size: int = 256) -> tuple[DataFrame, DataFrame]:
    """(gene, pos, vec) by a linear encoder and decoder trained on the mean squared error, and (epoch, loss, least, variance).

    An epoch is one Adam step for every `batch_size` rows. The error of a linear map and its gradient over all rows follow from the
    features' means and covariances (k x k, summed over the partitions once), so each step takes the gradient of the whole table
    instead of a batch's, and the result depends on the seed alone. `loss` is the error after the epoch, `least` the lowest one
    that any linear code of `dim` numbers has, `variance` the error of giving the mean. Training ends when `loss` is within
    SETTLED of `least`, else after `epochs`.
    """
    check(epochs >= 1 and batch_size >= 1, "epochs and batch_size must be at least 1")
    rows, k, n, centre = _centred(features, dim)
    spread = summed(rows, "features", lambda x: ((x - centre).T @ (x - centre)).ravel()).reshape(k, k) / n
    variance, least = float(np.trace(spread)) / k, max(float(np.linalg.eigvalsh(spread)[: k - dim].sum()) / k, 0.0)
    random = np.random.default_rng(seed)
    sizes = [k * dim, dim, dim * k, k]
    limit = 1 / np.sqrt(np.array([k, k, dim, dim]))
    flat = np.concatenate([random.uniform(-b, b, s) for b, s in zip(limit, sizes)])
    mean, square, losses = 0.0, 0.0, []

    def parts(v: np.ndarray) -> tuple[np.ndarray, ...]:
        w1, b1, w2, b2 = np.split(v, np.cumsum(sizes)[:-1])
        return w1.reshape(k, dim), b1, w2.reshape(dim, k), b2

    def errors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row x is given as x + (x - centre) @ off + shift; also spread @ off."""
        w1, b1, w2, b2 = parts(v)
        off = w1 @ w2 - np.eye(k)
        return off, centre @ off + b1 @ w2 + b2, spread @ off

    step = 0
    for epoch in range(1, epochs + 1):
        for _ in range(-(-n // batch_size)):
            step += 1
            w1, b1, w2, _ = parts(flat)
            _, shift, moved = errors(flat)
            pull = 2 * shift / k
            turn = 2 * moved / k + np.outer(centre, pull)
            gradient = np.concatenate([(turn @ w2.T).ravel(), w2 @ pull, (w1.T @ turn + np.outer(b1, pull)).ravel(), pull])
            mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * np.square(gradient)
            flat = flat - lr * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        off, shift, moved = errors(flat)
        losses.append((epoch, float((off * moved).sum() + np.square(shift).sum()) / k, least, variance))
        if losses[-1][1] - least <= SETTLED * variance:
            break
    w1, b1, _, _ = parts(flat)
    embedding = mapped(rows.withColumnRenamed("node", "gene"), "features", "vec", lambda x: x @ w1 + b1)
    return embedding, features.sparkSession.createDataFrame(losses, "epoch int, loss double, least double, variance double")
