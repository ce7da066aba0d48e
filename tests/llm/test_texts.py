"""Encoding, packing and subjects."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netsets.llm import encoding, packing, subjects

pytestmark = pytest.mark.skipif(not os.path.exists(encoding.vocabulary()), reason="no vocabulary files here")
TEXTS = [None, "", " ", "\n\t  ", "Hello, world!", "it's 2024, isn't it?", "<|endoftext|>", "naïve café — ещё раз 日本語🙂", "a" * 30_000, "  leading", "x y​z", "1234567890 " * 50]


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(os.path.join(encoding.TOKENIZERS, "byte_bpe_50k.json"))
    library.encode_special_tokens = True
    ranks = encoding.read_ranks(encoding.vocabulary())
    return encoding.Encoder(ranks, encoding.PerfectHash(ranks)), lambda t: library.encode(t, add_special_tokens=False).ids, ranks


def test_ids_are_the_public_ones(spark, both):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (3, "repeated id", "x")]
    got = encoding.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    want = sorted(([i, both[1](t) if t else []] for i, t, _ in rows), key=repr)
    assert sorted(([r["doc_id"], r["ids"]] for r in got), key=repr) == want
    assert encoding.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_hash_is_minimal_and_perfect(both):
    encoder, _, ranks = both
    assert encoder.whole.find(list(ranks)).tolist() == list(ranks.values())
    assert sorted(encoder.whole.keys) == sorted(ranks)
    assert (encoder.whole.find([b"", b"not in the vocabulary", "ж".encode() * 20]) == -1).all()
    few = {b"one": 1}
    assert encoding.PerfectHash(few).find([b"one", b"two"]).tolist() == [1, -1]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_as_the_library_does(both, text):
    assert both[0].encode([text])[0] == both[1](text)


def test_a_small_memory_changes_nothing(both, monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED", 3)
    texts = [t for t in TEXTS if t] * 3
    assert [both[0].encode([t])[0] for t in texts] == [both[1](t) for t in texts]


def placed(spark, sizes, capacity, **how):
    df = spark.createDataFrame([(i, s, 0) for i, s in sizes], "doc_id long, size long, piece int")
    return packing.pack(df, capacity, "doc_id", "size", **how).collect()


def test_packing_is_whole_tight_and_repeatable(spark):
    random.seed(1)
    sizes = [(i, min(int(random.lognormvariate(4, 1)), 900)) for i in range(8000)] + [(9000, 2500), (9001, 1000), (9002, 2000), (9003, 0), (9004, None), (None, 5), (7, 33), (7, 33)]
    got = placed(spark, sizes, 1000, containers_per_task=200)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, placed(spark, sizes[::-1], 1000, containers_per_task=200)), key=repr)
    spans, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        spans[r["container_id"]].append((r["start"], r["start"] + r["n_tokens"]))
        pieces[r["doc_id"]].append((r["piece"], r["n_tokens"]))
    for own in spans.values():
        own.sort()
        assert own[-1][1] <= 1000 and all(a[1] <= b[0] for a, b in zip(own, own[1:]))
    assert sorted(pieces[9000]) == [(0, 1000), (1, 1000), (2, 500)] and sorted(pieces[9002]) == [(0, 1000), (1, 1000)]
    assert pieces[9001] == [(0, 1000)] and pieces[9003] == [(0, 0)] and pieces[9004] == [(0, 0)] and pieces[None] == [(0, 5)]
    assert sum(n for p in pieces.values() for _, n in p) == sum(s or 0 for _, s in sizes)
    assert all(len(pieces[i]) == 1 for i, s in sizes if i != 7 and (s or 0) <= 1000)
    assert sum(s or 0 for _, s in sizes) / (1000 * len(spans)) > 0.97
    assert placed(spark, [], 10) == [] and len(placed(spark, [(1, 0)], 10)) == 1


def test_many_empty_items_take_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 50)
    got = placed(spark, [(i, 0) for i in range(400)] + [(1000, 7)], 10)
    assert len(got) == 401 and len({r["container_id"] >> 33 for r in got}) > 4


def test_levels_minimise_the_sum_of_squares():
    random.seed(2)
    levels, counts = packing.Levels(12), [0] * 13
    for _ in range(400):
        size = random.randrange(1, 13)
        def after(h):
            new = list(counts)
            new[h] -= h > 0
            new[h + size] += h + size < 12
            return sum(c * c for c in new[1:12])
        options = [h for h in range(0, 13 - size) if h == 0 or counts[h]]
        best = min(after(h) for h in options)
        _, level = levels.place(size)
        assert level == max(h for h in options if after(h) == best)
        counts[level] -= level > 0
        counts[level + size] += level + size < 12


def test_sentences():
    assert subjects.sentences("<seg>One two. Three? <b>4</b> [?] ...</seg>") == [["one", "two"], ["three"]]
    assert subjects.sentences(None) == [] and subjects.sentences(" 12 . !") == [] and subjects.sentences("Où ? Là !") == [["où"], ["là"]]


@pytest.mark.parametrize("n, shape", [(n, shape) for n in (1, 2, 3, 4, 7, 40, 300, 2000) for shape in ((1, 1), (0.05, 0.05), (50, 50), (0.1, 0.9))])
def test_the_likelihood_counts_sentences_exactly(n, shape):
    def beyond(ps, least):
        distribution = np.ones(1)
        for q in ps:
            distribution = np.r_[distribution, 0] * (1 - q) + np.r_[0, distribution] * q
        return distribution[least:].sum() if least > 0 else 1.0

    about, least = np.random.default_rng(n).beta(*shape, (2 * n + 1, 2)), -(-n // 3)
    holds, slope = subjects._third(about, np.array([n, 1, n]))
    for doc, at in ((0, 0), (2, n + 1)):
        for k in range(2):
            own = about[at : at + n, k]
            assert abs(holds[doc, k] - beyond(own, least)) < 1e-12
            for i in {0, n // 2, n - 1}:
                others = np.delete(own, i)
                assert abs(slope[at + i, k] - (beyond(others, least - 1) - beyond(others, least))) < 1e-11
    assert np.allclose(holds[1], about[n]) and np.allclose(slope[n], 1)


def test_subjects_are_learned_and_held_out(spark):
    random.seed(3)
    nouns = {"law": ["judge", "court", "lawyer", "verdict"], "sport": ["goal", "team", "referee", "race"], None: ["rain", "chair", "window", "street"]}
    docs, labels, truth = [], [], {}
    for i in range(900):
        about = [random.choice([*nouns]) for _ in range(random.randrange(1, 6))]
        docs.append((i, " ".join(f"The {random.choice(nouns[a])} and the {random.choice(nouns[a])} came late." for a in about), "xx"))
        truth[i] = {a for a in set(about) if a and 3 * about.count(a) >= len(about)}
        if i % 2:
            labels += [(i, s, "a") for s in (sorted(truth[i]) or [None])]
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "12 34 !", "x")]
    labels += [(None, "law", "a"), (5000, "law", None)] + labels[:5]
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    t = spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    names = ["law", "sport"]
    got = defaultdict(set)
    for r in subjects.subjects_of(d, subjects.train(d, t, names), names).collect():
        got[r["doc_id"]].add(r["subject"])
    held_out = [i for i in truth if i % 2 == 0]
    assert sum(got[i] == truth[i] for i in held_out) / len(held_out) > 0.95
    assert not got[1000] and not got[1001] and not got[1002]
    nothing = subjects.train(d, t.where("false"), names)
    assert subjects.subjects_of(d.where("false"), nothing, names).collect() == []
