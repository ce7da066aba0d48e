"""Subject areas of each document: averaged word and subword embeddings with independent logistic outputs.

A sentence is the mean of the embeddings of its words and their character n-grams (hashed to buckets); one logistic output per
subject says whether the sentence is about it. The labels are of documents, so a document's probability is that at least a third
of its sentences are about the subject, and the likelihood allows for a share of wrong labels. Every round, each partition of the
training rows sends one gradient; their sum moves the shared parameters. All documents are then scored sentence by sentence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from math import ceil, pi, sqrt

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsets.functions.sampling import bounded_sample
from netsets.session import written

#: Labelled documents used for training, at most (those with a low hash); everything else covers all rows.
MAX_TRAINING = 20_000
#: Numbers of the likelihood held in memory at once; and the exponent from which e^-x counts as nothing in it.
HELD, NOTHING = 1 << 19, 42.0
#: Shares of labels that are expected to be wrong, by default: subjects marked without ground, and subjects missed.
MARKED_WRONGLY, MISSED = 0.02, 0.08
BUCKETS, DIM, ROUNDS, TRAINING_TASKS, RATE = 1 << 15, 16, 32, 8, 0.1
_SENTENCE_END = regex.compile(r"(?<=[.!?…。])[\"'»”’)\]]*\s+")
_WORD = regex.compile(r"\p{L}+")
_TAG = regex.compile(r"</?\p{L}[^<>]*>")


def sentences(text: str | None) -> list[list[str]]:
    """The words, lower-cased, of each sentence; tags are no words, and what has no letters is no sentence."""
    found = (_WORD.findall(s.lower()) for s in _SENTENCE_END.split(_TAG.sub(" ", text or "")))
    return [words for words in found if words]


@lru_cache(maxsize=200_000)
def features(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its n-grams of 3 to 5 letters, with its borders."""
    marked = f"<{word}>"
    grams = {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
    return tuple(xxhash.xxh32_intdigest(g) % BUCKETS for g in [f"={word}", *sorted(grams)])


@dataclass
class Parameters:
    embedding: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(subjects: int, seed: int = 3) -> Parameters:
        random = np.random.default_rng(seed)
        return Parameters(random.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), random.normal(0, 0.3, (DIM, subjects)).astype(np.float32), np.full(subjects, -2, np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.embedding.ravel(), self.output.ravel(), self.bias])

    @staticmethod
    def of(flat: np.ndarray, subjects: int) -> Parameters:
        a, b = BUCKETS * DIM, BUCKETS * DIM + DIM * subjects
        return Parameters(flat[:a].reshape(BUCKETS, DIM), flat[a:b].reshape(DIM, subjects), flat[b:])


def _at_least(p: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """P(X >= least) for X the number of successes of the trials p[doc, trial, subject], and its derivative by each probability.

    The distribution comes from its characteristic function at an odd number of points (which keeps every factor from 0). The
    points cover all values of X, or where those are many, a window around the mean beyond which less than e^-NOTHING lies
    (Bernstein's inequality); frequencies whose function is below that are left out too. So the work grows with the trials.
    """
    docs, n, subjects = p.shape
    mean, variance = p.sum(1), (p * (1 - p)).sum(1)
    reach = NOTHING / 3 + sqrt(NOTHING * NOTHING / 9 + 2 * NOTHING * float(variance.max()))
    points = min(n + 1 | 1, 2 * ceil(reach) + 3)
    first = np.zeros_like(mean) if points > n else np.floor(mean) - points // 2
    start = np.clip(least, first, first + points)
    angle = 2 * pi / points * np.arange(1, points // 2 + 1)
    angle = angle[(1 - np.cos(angle)) * float(variance.min()) <= NOTHING + 2 * np.log(n + 1)]
    tail, slope = first + points - start, np.zeros_like(p)
    at_once = max(1, HELD // p.size)
    for some in (angle[at : at + at_once] for at in range(0, len(angle), at_once)):
        turn = np.exp(1j * some)[:, None, None]
        weight = 2 * (turn**-start - turn**-first) / (1 - 1 / turn)
        factors = 1 + (turn[:, :, None] - 1) * p
        whole = weight * factors.prod(2)
        tail += whole.real.sum(0)
        slope += ((whole * (turn - 1))[:, :, None] / factors).real.sum(0)
    return np.clip(tail / points, 0, 1), slope / points


def _third(about: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's probability that at least a third of its sentences are about a subject, and the derivatives by those of its sentences."""
    holds, slope = np.empty((len(per_doc), about.shape[1])), np.empty(about.shape)
    starts = np.r_[0, np.cumsum(per_doc)[:-1]]
    for n in np.unique(per_doc).tolist():
        same = np.flatnonzero(per_doc == n)
        at_once = max(1, HELD // (n * (n // 2 + 1) * about.shape[1]))
        for docs in (same[at : at + at_once] for at in range(0, len(same), at_once)):
            rows = starts[docs][:, None] + np.arange(n)
            holds[docs], slope[rows] = _at_least(about[rows], -(-n // 3))
    return holds, slope


def _gradient(p: Parameters, words: pa.DictionaryArray, per_sentence: np.ndarray, per_doc: np.ndarray, wanted: np.ndarray, wrongly: float, missed: float) -> tuple[np.ndarray, float]:
    """The gradient and loss of documents: all words, words by sentence, sentences by document, wanted subjects by document."""
    own = [features(w) for w in words.dictionary.to_pylist()]
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    feats = np.fromiter(chain.from_iterable(own), np.int64, int(sizes.sum()))
    word = words.indices.to_numpy()
    vectors = np.add.reduceat(p.embedding[feats], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
    sentence = np.r_[0, np.cumsum(per_sentence)[:-1]]
    parts = np.add.reduceat(sizes[word], sentence)[:, None]
    hidden = np.add.reduceat(vectors[word], sentence, axis=0) / parts
    about = 1 / (1 + np.exp(-np.clip(hidden @ p.output + p.bias, -30, 30)))
    holds, by_sentence = _third(about, per_doc)
    marked = wrongly + (1 - wrongly - missed) * holds
    loss = -float((wanted * np.log(marked) + (1 - wanted) * np.log(1 - marked)).sum())
    slope = (1 - wrongly - missed) * ((1 - wanted) / (1 - marked) - wanted / marked)
    pull = np.repeat(slope, per_doc, axis=0) * by_sentence * about * (1 - about)
    back = np.repeat(pull @ p.output.T / parts, per_sentence, axis=0)
    to_word = np.stack([np.bincount(word, back[:, d], len(own)) for d in range(DIM)], axis=1)
    to_feature = np.repeat(to_word, sizes, axis=0)
    embedding = np.stack([np.bincount(feats, to_feature[:, d], BUCKETS) for d in range(DIM)], axis=1)
    return np.concatenate([embedding.ravel(), (hidden.T @ pull).ravel(), pull.sum(0)]).astype(np.float32), loss


def _training_rows(docs: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(wanted, words, per_sentence) of labelled documents, at most MAX_TRAINING; `wanted` is each subject's share of the annotators."""
    known = labels.select("doc_id", "subject", F.coalesce("annotator", F.lit("")).alias("annotator")).where("doc_id is not null").distinct()
    share = lambda s: F.count_distinct(F.when(F.col("subject") == s, F.col("annotator"))) / F.count_distinct("annotator")
    wanted = known.groupBy("doc_id").agg(F.array(*[share(s).cast("float") for s in subjects]).alias("wanted"))
    chosen = bounded_sample(wanted, "doc_id", labels.select("doc_id").distinct().count(), MAX_TRAINING)
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("wanted", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], []]
            for wish, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if found := sentences(text):
                    for column, value in zip(out, (wish, [w for s in found for w in s], list(map(len, found)))):
                        column.append(value)
            types = (pa.list_(pa.float32()), pa.list_(pa.string()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["wanted", "words", "per_sentence"])

    return texts.mapInArrow(run, "wanted array<float>, words array<string>, per_sentence array<int>")


def train(docs: DataFrame, labels: DataFrame, subjects: list[str], rounds: int = ROUNDS, wrongly: float = MARKED_WRONGLY, missed: float = MISSED) -> Parameters:
    """Parameters fitted by Adam on the sum of the partitions' gradients; the starting parameters where nothing is labelled.

    `wrongly` and `missed` are the shares of labels expected to be wrong.
    """
    spark = docs.sparkSession
    rows = written(_training_rows(docs, labels, subjects).repartition(TRAINING_TASKS), "training")
    parameters = Parameters.start(len(subjects))
    total = rows.count()
    flat, mean, square = parameters.flat(), 0.0, 0.0
    for step in range(1, rounds + 1 if total else 1):
        shared = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]  # the training rows are a bounded sample
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                column = lambda name: t.column(name).chunk(0)
                wanted = column("wanted").flatten().to_numpy().reshape(t.num_rows, -1)
                sums, loss = _gradient(Parameters.of(shared.value, wanted.shape[1]), column("words").flatten().dictionary_encode(), column("per_sentence").flatten().to_numpy(), column("per_sentence").value_lengths().to_numpy(), wanted, wrongly, missed)
                yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary()), pa.array([loss])], names=["sums", "loss"])

        # one gradient of the parameters' size from each of the TRAINING_TASKS partitions
        gradient = sum(np.frombuffer(r["sums"], np.float32) for r in rows.mapInArrow(run, "sums binary, loss double").collect()) / total
        shared.unpersist()
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient * gradient
        flat = (flat - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Parameters.of(flat, len(subjects))


def subjects_of(docs: DataFrame, parameters: Parameters, subjects: list[str]) -> DataFrame:
    """(doc_id, subject, sentences, about): the subjects that at least a third of a document's sentences are about.

    Null, empty and wordless texts have no subjects; repeated rows give repeated results; languages and target texts aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parameters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, known, table = shared.value, {}, np.empty((1024, DIM + 1), np.float32)
        for batch in batches:
            if len(known) > 500_000:
                known = {}
            words, per_sentence, per_doc = [], [], []
            for text in batch.column(1).to_pylist():
                found = sentences(text)
                per_doc.append(len(found))
                for s in found:
                    per_sentence.append(len(s))
                    words.extend(s)
            fresh = []
            for w in words:
                if w not in known:
                    known[w] = len(known)
                    feats = list(features(w))
                    fresh.append(np.r_[p.embedding[feats].sum(0), np.float32(len(feats))])
            if len(known) > len(table):
                table = np.concatenate([table, np.empty((max(len(table), len(known)), DIM + 1), np.float32)])
            if fresh:
                table[len(known) - len(fresh) : len(known)] = fresh
            if not words:
                continue
            at = np.r_[0, np.cumsum(per_sentence)[:-1]]
            total = np.add.reduceat(table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))], at, axis=0)
            about = (total[:, :-1] / total[:, -1:]) @ p.output + p.bias > 0
            doc = np.repeat(np.arange(len(per_doc)), per_doc)
            counts = np.stack([np.bincount(doc, about[:, k], len(per_doc)) for k in range(len(subjects))], axis=1).astype(np.int64)
            per_doc = np.array(per_doc)
            row, k = np.nonzero((counts * 3 >= per_doc[:, None]) & (counts > 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array([subjects[i] for i in k], pa.string()), pa.array(per_doc[row].astype(np.int32)), pa.array(counts[row, k].astype(np.int32))],
                names=["doc_id", "subject", "sentences", "about"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, subject string, sentences int, about int")
