"""The hidden Markov model against its definition: enumerated paths, counts in plain Python, odd rows."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.llm import hmm
from formloom.llm.common import checkpointed

ODD = [(1, ""), (2, None), (3, " \n\t "), (4, "A a A"), (5, "same same"), (5, "same same"), (6, "x " * 5000), (7, "Été ÉTÉ\x0bline"), (None, "no id"), (8, "w" * 30000), (9, "日本語 words\x0cand")]
ODD += [(i, f"the mill of road{i % 3} is {'near' if i % 2 else 'far'} the lake") for i in range(20, 60)]


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def test_token_names(monkeypatch):
    texts = [t or "" for _, t in ODD] + ["a", "ab ba", "b a ab"]
    for size in (1 << 21, 7, 1):
        monkeypatch.setattr(hmm, "SLICE", size)
        names, sizes = hmm.token_names(t.encode() for t in texts)
        expected = [w for t in texts for w in tokens(t)]
        assert sizes.tolist() == [len(tokens(t)) for t in texts] and len(names) == len(expected)
        by = dict(zip(expected, names.tolist()))
        assert len(set(by.values())) == len(by) and [by[w] for w in expected] == names.tolist()


def a_model(states, classes=5):
    rng = np.random.default_rng(3)
    part = lambda *s: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(s) + 0.1)
    emit = np.zeros((hmm.CLASSES + 2, states))
    emit[:classes] = part(states, classes).T
    return hmm.Model(part(states), part(states, states), emit, np.ones(hmm.CLASSES + 2))


@pytest.mark.parametrize("states", [1, 2, 3])
def test_against_all_paths(states):
    """Likelihoods and expected counts are those of all paths of states."""
    model, rng = a_model(states), np.random.default_rng(1)
    sizes = np.array([3, 1, 5, 3, 2])
    classes = rng.integers(0, 5, sizes.sum()).astype(np.uint16)
    likelihood, starts, moves, emitted = 0.0, np.zeros(states), np.zeros((states, states)), np.zeros((hmm.CLASSES + 2, states))
    logs = []
    for text in np.split(classes, np.cumsum(sizes)[:-1]):
        found = []
        for path in itertools.product(range(states), repeat=len(text)):
            p = model.start[path[0]] * math.prod(model.move[a, b] for a, b in zip(path, path[1:])) * math.prod(model.emit[c, k] for c, k in zip(text, path))
            found.append((p, path))
        total = sum(p for p, _ in found)
        logs.append(math.log10(total))
        likelihood += math.log(total)
        for p, path in found:
            starts[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / total
            for c, k in zip(text, path):
                emitted[c, k] += p / total
    got = hmm.expectations(classes, sizes, model)
    for x, y in zip(got, (likelihood, starts, moves, emitted)):
        np.testing.assert_allclose(x, y, rtol=1e-4, atol=1e-5)
    np.testing.assert_allclose(hmm.text_scores(classes, sizes, np.zeros(len(sizes)), model), logs, rtol=1e-9)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", True) for i, t in ODD], "doc_id long, text string, classes string, held_out boolean")


def test_counts_and_base(docs):
    learns = [t for i, t in ODD if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1]
    count = Counter(w for t in learns for w in tokens(t))
    n = sum(count.values())
    expected = []
    for i, text in ODD:
        own = tokens(text)
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (len(count) + 1))) for w in own)
        expected.append((str(i), zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1, len(own), sum(count[w] > 0 for w in own), n, round(base, 6)))
    got = hmm.scored(docs, states=2, rounds=2).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(expected)
    assert all(r.score <= 1e-9 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 3 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_add_up(spark, docs):
    """After any first state, all known tokens and the unknown one have a probability of 1 together; likelihoods rise."""
    rows = docs.select("doc_id", F.lit(False).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = checkpointed(hmm.encoded(rows), 1)
    known = hmm.totals(blocks)
    count = Counter(w for _, t in ODD for w in tokens(t))
    assert known.counts.sum() == sum(count.values()) and known.types.sum() == len(count)
    model, likelihoods = hmm.trained(blocks, known, states=3, rounds=5)
    assert likelihoods == sorted(likelihoods)
    np.testing.assert_allclose(model.emit.sum(0), 1)
    names, _ = hmm.token_names(w.encode() for w in count if w)
    names = [x for x in names.tolist() if x != int(hmm.END_NAME)]
    total = model.emit[hmm.UNKNOWN] + (count[None] - hmm.DISCOUNT) * model.emit[hmm.END] / model.spread[hmm.END]
    for word, name in zip([w for w in count if w], names):
        total = total + (count[word] - hmm.DISCOUNT) * (model.emit / model.spread[:, None])[name % hmm.CLASSES]
    np.testing.assert_allclose(total, 1)


def test_blocks_and_shards_agree(docs, monkeypatch):
    """Counts and scores don't depend on how texts are dealt."""
    of = lambda: sorted((str(r.doc_id), r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 3)) for r in hmm.scored(docs, 2, 2).collect())
    whole = of()
    monkeypatch.setattr(hmm, "CHARS", 500)
    assert of() == whole


def test_sums_in_steps(spark, monkeypatch):
    """Sums over many tasks are those of all blocks, however many tasks are added up at a time."""
    blocks = spark.range(40).repartition(23).selectExpr("unhex(hex(id)) AS about", "unhex(hex(id)) AS classes", "unhex(hex(id)) AS types")
    for fan in (2, 3, 64):
        monkeypatch.setattr(hmm, "FAN", fan)
        got = hmm.summed(blocks, lambda about, classes, types: np.array([[int.from_bytes(about, "big"), 1.0]] * 20), (20, 2))
        assert got.tolist() == [[sum(range(40)), 40.0]] * 20
    assert hmm.summed(blocks.limit(0), lambda *x: np.ones((2, 2)), (2, 2)).tolist() == [[0, 0], [0, 0]]


def test_nothing_trains(spark, docs):
    held = [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    got = hmm.scored(spark.createDataFrame([(i, "some words here") for i in held], "doc_id long, text string")).collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(0, 0, 0.0, 0.0)] * 3 or all(abs(r.score) < 1e-9 and r.train_tokens == 0 for r in got)
    assert hmm.scored(docs.limit(0)).count() == 0


def test_groups():
    """Words that follow each other are one group; no words, no groups."""
    near = np.kron(np.eye(3), np.full((4, 4), 50.0)) + 1
    group = hmm._groups(near, 3)
    assert len(set(group)) == 3 and all(len(set(group[i : i + 4])) == 1 for i in (0, 4, 8))
    assert len(hmm._groups(np.zeros((0, 0)), 3)) == 0
