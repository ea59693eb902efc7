"""Language-model scoring by a hidden Markov model: Baum-Welch counts from all training text, exact likelihoods by the scaled
forward recursion.

States emit words by way of classes, which are hashes of words: P(word | state) = P(class | state) * P(word | class). The
second factor comes from the counts of all words, which are gathered in shards; the first, a bounded table, is trained.
Words that training text lacks are one kind of token together, whose probability each state gets by absolute discounting.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import block_count, checkpointed, from_payloads, mix, packed_blocks, release, releasing, shard_cuts, squeeze, table, text_of, texts_as_bytes, unsqueeze

#: Hidden states, word classes, rounds of Baum-Welch.
STATES, CLASSES, ROUNDS = 8, 65_000, 4
#: Two classes beside those of words: words that training text lacks, and the end of a text.
UNKNOWN, END = CLASSES, CLASSES + 1
#: What each word's count gives up to words not seen, and the pseudo-tokens by which each state leans to the counts of all text.
DISCOUNT, PRIOR = 0.6, 50.0
#: For the first model: the most frequent classes that are grouped, how much more likely a state emits those of its own group,
#: and how likely it stays.
SEEDS, LEAN, STAY = 256, 20.0, 0.9
#: Every fold-th part of documents is held out: those whose id, as text, has this remainder of its crc32.
FOLDS, HELD_OUT = 5, 1
#: Code points of text of a block, about; blocks that a task works through in each round; pieces in which counts are added up;
#: tasks whose counts are added up at a time; bytes that are cut into words at a time.
CHARS, BLOCKS_PER_TASK, PIECES, FAN, SLICE = 10_000_000, 5, 16, 8, 2 << 20
#: A-Z in lower case, the six white-space characters as spaces.
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: A number for each byte, an odd base and its inverse modulo 2^64, of which words' names are made; the name of a text's end.
BYTE_NAMES = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
BASE = xxhash.xxh3_64_intdigest(b"base") | 1
BASE, INVERSE = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
END_NAME = np.uint64(xxhash.xxh3_64_intdigest(b""))


class Model(NamedTuple):
    start: np.ndarray  #: (states)
    move: np.ndarray  #: (states, states), from the row to the column
    emit: np.ndarray  #: (classes + 2, states): probability of each class in each state
    spread: np.ndarray  #: (classes + 2): by what the discounted counts of a class's words are divided


class Totals(NamedTuple):
    counts: np.ndarray  #: training tokens of each class
    types: np.ndarray  #: distinct training tokens of each class


def word_names(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit names of the words between spaces, where each begins). A word's name is a polynomial of its bytes, modulo 2^64, as
    the difference of two prefix sums, mixed with its length."""
    inside = code != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = edges[::2], edges[1::2]
    base = np.full(len(code), BASE)
    base[:1] = 1
    upto = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(BYTE_NAMES[code] * np.cumprod(base), out=upto[1:])
    base[1:] = INVERSE
    return mix((upto[end] - upto[begin]) * np.cumprod(base)[begin], (end - begin).astype(np.uint64)), begin


def token_names(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit names of all texts' tokens one after another, each text's number of tokens); a text ends with END_NAME."""
    names, sizes, held, of = [np.zeros(0, np.uint64)], [], [], []

    def flush() -> None:
        found, begin = word_names(np.frombuffer(b" ".join([*held, b""]), np.uint8))
        names.append(found)
        for text, n in zip(of, np.diff(np.searchsorted(begin, np.cumsum([0, *(len(x) + 1 for x in held)]))).tolist()):
            sizes[text] += n
        held.clear(), of.clear()

    size = 0
    for text in texts:
        text, at = text.translate(LOWER), 0
        sizes.append(0)
        while at < len(text):  # a long text is cut at spaces
            upto = text.find(b" ", at + SLICE) if len(text) - at > SLICE else -1
            upto = upto if upto >= 0 else len(text)
            held.append(text[at:upto]), of.append(len(sizes) - 1)
            size, at = size + upto - at, upto
            if size >= SLICE:
                flush()
                size = 0
    if held:
        flush()
    sizes = np.array(sizes, np.int64) + 1
    out = np.full(int(sizes.sum()), END_NAME)
    word = np.ones(len(out), bool)
    word[np.cumsum(sizes) - 1] = False
    out[word] = np.concatenate(names)
    return out, sizes


def _distinct(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct names, each token's place among them, tokens of each row)."""
    names, sizes = token_names(texts_as_bytes(rows.column("text")))
    at, unique = pd.factorize(names)
    order = np.argsort(unique)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return unique[order], place[at], sizes


def encoded(docs: DataFrame) -> DataFrame:
    """(about, classes, types binary), a row for each block of documents: what all later steps read.

    about: id, whether there is one, held_out, n_tokens, n_known, sum of log10(c + 0.5), sum of log10(c - DISCOUNT) over known
    tokens, of each document; classes: each token's class; types: the distinct training tokens that this block stands for.
    docs: doc_id, text, held_out. Each block sends its distinct words to shards once; a shard adds up their counts in training
    text and answers every block.
    """
    blocks = block_count(docs, chars=CHARS)
    shards = max(16, math.ceil(blocks / 2))
    texts = packed_blocks(docs, blocks, level=6).groupBy("block")

    def send(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rows = from_payloads(group.column("payload"))
        unique, at, sizes = _distinct(rows)
        learns = np.repeat(~rows.column("held_out").to_numpy(), sizes)
        counts = np.bincount(at[learns], minlength=len(unique)).astype(np.uint32)
        cuts = shard_cuts(unique, shards)
        some = np.flatnonzero(np.diff(cuts))
        values = [squeeze(np.diff(unique[cuts[s] : cuts[s + 1]], prepend=np.uint64(0)), counts[cuts[s] : cuts[s + 1]]) for s in some]
        return pa.table({"block": pa.array([key[0].as_py()] * len(some), pa.int32()), "shard": pa.array(some.astype(np.int32)), "value": pa.array(values, pa.binary())})

    def answer(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        asked = [unsqueeze(v.as_py(), "u8", "u4") for v in group.column("value")]
        unique, first, which = np.unique(np.concatenate([np.cumsum(a[0]) for a in asked]), return_index=True, return_inverse=True)
        total = np.bincount(which, np.concatenate([a[1] for a in asked]), len(unique)).astype(np.uint64)
        told = total[which] << np.uint64(1)
        told[first] |= np.uint64(1)  # the first block that asks for a word stands for it
        cuts = np.cumsum([0, *(len(a[0]) for a in asked)])
        return pa.table({"block": group.column("block"), "shard": group.column("shard"), "value": pa.array([squeeze(told[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())})

    def encode(key: tuple[pa.Scalar, ...], group: pa.Table, told: pa.Table) -> pa.Table:
        rows = from_payloads(group.column("payload"))
        unique, at, sizes = _distinct(rows)
        told = np.concatenate([unsqueeze(v.as_py(), "u8")[0] for v in told.sort_by("shard").column("value")])
        count, stands = (told >> np.uint64(1)).astype(np.int64), (told & np.uint64(1)).astype(bool)
        kind = np.where(count > 0, np.where(unique == END_NAME, END, (unique % np.uint64(CLASSES)).astype(np.int64)), UNKNOWN)
        own, types = np.unique(kind[stands & (count > 0)], return_counts=True)
        starts = np.cumsum(sizes) - sizes
        known = np.add.reduceat((count > 0)[at].astype(np.int64), starts)
        plain = np.add.reduceat(np.log10(count + 0.5)[at], starts)
        within = np.add.reduceat(np.where(count > 0, np.log10(np.maximum(count, 1) - DISCOUNT), 0)[at], starts)
        ids = rows.column("doc_id")
        about = squeeze(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(), rows.column("held_out").to_numpy(), sizes, known, plain, within)
        return pa.table([pa.array([x], pa.binary()) for x in (about, squeeze(kind[at].astype(np.uint16)), squeeze(own.astype(np.uint16), types.astype(np.uint32)))], names=["about", "classes", "types"])

    asked = texts.applyInArrow(releasing(send), "block int, shard int, value binary")
    back = asked.groupBy("shard").applyInArrow(releasing(answer), "block int, shard int, value binary")
    return texts.cogroup(back.groupBy("block")).applyInArrow(releasing(encode), "about binary, classes binary, types binary")


def _about(value: bytes) -> list[np.ndarray]:
    return unsqueeze(value, "i8", "?", "?", "i8", "i8", "f8", "f8")


def _training(about: bytes, classes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(classes of the block's training tokens, each training document's number of tokens)."""
    held, sizes = _about(about)[2:4]
    return unsqueeze(classes, "u2")[0][np.repeat(~held, sizes)], sizes[~held]


def summed(blocks: DataFrame, measure, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all blocks of measure(about, classes, types), an array of this shape, which doesn't depend on the input.

    A task adds up its blocks before it sends PIECES parts. Parts are added up FAN tasks at a time, and their sums again, so no group
    grows with the number of tasks.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for x in batches:
            for row in zip(*(c.to_pylist() for c in x.columns)):
                total += measure(*row)
        parts = [squeeze(p) for p in np.array_split(total.reshape(-1), PIECES)]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([task // FAN] * PIECES, pa.int32()), pa.array(parts, pa.binary())], names=["piece", "task", "value"])
        release()

    def add_up(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        total = None
        for value in sorted(v.as_py() for v in group.column("value")):  # in the same order in every run
            part = unsqueeze(value, "f8")[0]
            total = part.copy() if total is None else np.add(total, part, out=total)
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py() // FAN], pa.int32()), "value": pa.array([squeeze(total)], pa.binary())})

    rows, tasks = blocks.mapInArrow(gather, "piece int, task int, value binary"), blocks.rdd.getNumPartitions()
    while True:
        rows, tasks = rows.groupBy("piece", "task").applyInArrow(add_up, "piece int, task int, value binary"), math.ceil(tasks / FAN)
        if tasks <= 1:
            break
    parts = [unsqueeze(r.value, "f8")[0] for r in sorted(rows.collect(), key=lambda r: r.piece)]  # PIECES rows
    return np.concatenate(parts).reshape(shape) if parts else np.zeros(shape)


def totals(blocks: DataFrame) -> Totals:
    def measure(about: bytes, classes: bytes, types: bytes) -> np.ndarray:
        own, n = unsqueeze(types, "u2", "u4")
        return np.stack([np.bincount(_training(about, classes)[0], minlength=CLASSES + 2), np.bincount(own, n, CLASSES + 2)])

    return Totals(*summed(blocks, measure, (2, CLASSES + 2)))


def emissions(expected: np.ndarray, known: Totals) -> tuple[np.ndarray, np.ndarray]:
    """(emit, spread) of a model by the expected tokens (classes + 2, states): each state's counts, discounted by DISCOUNT for each
    distinct word, and PRIOR tokens of all text's; what is taken off goes to words not seen. A state's column adds up to 1."""
    n = max(known.counts.sum(), 1)
    taken = DISCOUNT * known.types / np.maximum(known.counts, 1)  # share of each class that words not seen get
    lean = known.counts / n if known.counts.sum() else (np.arange(CLASSES + 2) == UNKNOWN).astype(float)
    weighed = expected + PRIOR * lean[:, None]
    emit = weighed * (1 - taken)[:, None]
    emit[UNKNOWN] += (weighed * taken[:, None]).sum(0)
    spread = np.where(known.counts > 0, known.counts - DISCOUNT * known.types, 1.0)
    return emit / weighed.sum(0), spread


def first_model(blocks: DataFrame, known: Totals, states: int = STATES) -> Model:
    """A model whose states each lean to a group of frequent words. Groups come from how often frequent words follow each other, with
    any rarer words between them, in all training text: k-means on the main eigenvectors of that bounded matrix."""
    seeds = np.argsort(-known.counts[:CLASSES], kind="stable")[:SEEDS]
    seeds = seeds[known.counts[seeds] > 0]
    number = np.full(CLASSES + 2, -1)
    number[seeds] = np.arange(len(seeds))

    def measure(about: bytes, classes: bytes, types: bytes) -> np.ndarray:
        tokens, sizes = _training(about, classes)
        seed, doc = number[tokens], np.repeat(np.arange(len(sizes)), sizes)
        doc, seed = doc[seed >= 0], seed[seed >= 0]
        same = doc[1:] == doc[:-1]
        return np.bincount(seed[:-1][same] * SEEDS + seed[1:][same], minlength=SEEDS * SEEDS).reshape(SEEDS, SEEDS)

    follows = summed(blocks, measure, (SEEDS, SEEDS))[: len(seeds), : len(seeds)]
    group = _groups(follows + follows.T, states)
    lean = np.ones((CLASSES + 2, states))
    lean[seeds, group] = LEAN
    emit, spread = emissions(known.counts[:, None] * lean / lean.sum(1, keepdims=True), known)
    move = np.full((states, states), (1 - STAY) / max(1, states - 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit, spread)


def _groups(near: np.ndarray, groups: int) -> np.ndarray:
    """A group number for each row of a symmetric matrix of likeness; the same in every run."""
    if not len(near):
        return np.zeros(0, int)
    degree = np.sqrt(near.sum(1) + 1)
    vectors = np.linalg.eigh(near / degree[:, None] / degree)[1][:, -groups:]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-12
    centres = vectors[:1]
    while len(centres) < groups:
        centres = np.r_[centres, vectors[[np.argmin((vectors @ centres.T).max(1))]]]
    for _ in range(25):
        own = np.argmax(vectors @ centres.T, axis=1)
        centres = np.stack([vectors[own == g].mean(0) if (own == g).any() else centres[g] for g in range(groups)])
    return own


def time_major(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each token, rank of each text, texts that reach each step): texts ranked by length, longest first, are laid out
    step by step, so that one step of all of them is a slice. Texts have a token each at least."""
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(sizes), np.int64)
    rank[order] = np.arange(len(sizes))
    longest = int(sizes.max()) if len(sizes) else 0
    reach = len(sizes) - np.cumsum(np.bincount(sizes, minlength=longest + 1))[:longest]
    begin = np.cumsum(reach) - reach
    step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return begin[step] + np.repeat(rank, sizes), rank, reach


def forward(emitted: np.ndarray, reach: np.ndarray, start: np.ndarray, move: np.ndarray, alpha: np.ndarray | None = None) -> np.ndarray:
    """Scale of each token of texts laid out by time_major(): emitted (tokens, states) holds each token's probability in each
    state. A text's likelihood is the product of its tokens' scales. alpha, if given, gets the states' probabilities at each token."""
    scale = np.empty(len(emitted), emitted.dtype)
    a, lo = np.empty((0, len(start)), emitted.dtype), 0
    for step, n in enumerate(reach.tolist()):
        hi = lo + n
        a = emitted[lo:hi] * (a[:n] @ move if step else start)
        s = a.sum(1)
        a /= s[:, None]
        scale[lo:hi] = s
        if alpha is not None:
            alpha[lo:hi] = a
        lo = hi
    return scale


def expectations(classes: np.ndarray, sizes: np.ndarray, model: Model) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log likelihood of the texts' classes, expected starts, moves and emissions): the counts of Baum-Welch."""
    states = len(model.start)
    if not len(sizes):
        return 0.0, np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES + 2, states))
    place, _, reach = time_major(sizes)
    token = np.empty(len(classes), np.int64)
    token[place] = classes
    start, move, emit = (x.astype(np.float32) for x in model[:3])
    emitted = emit[token]
    alpha = np.empty_like(emitted)
    scale = forward(emitted, reach, start, move, alpha)
    weight = emitted / scale[:, None]  # becomes the weight of what follows each token
    beta = np.ones_like(alpha)
    hi = len(token)
    for n, upto in zip(reach[:0:-1].tolist(), reach[-2::-1].tolist()):
        lo = hi - n
        weight[lo:hi] *= beta[lo:hi]
        np.matmul(weight[lo:hi], move.T, out=beta[lo - upto : lo - upto + n])
        hi = lo
    later = np.arange(reach[0], len(token))
    earlier = later - np.repeat(reach[:-1], reach[1:])
    moves = (alpha[earlier].T @ weight[later]).astype(np.float64) * model.move
    alpha *= beta
    alpha /= alpha.sum(1, keepdims=True)
    emissions = np.stack([np.bincount(token, alpha[:, k], CLASSES + 2) for k in range(states)], 1)
    return float(np.log(scale.astype(np.float64)).sum()), alpha[: reach[0]].sum(0, dtype=np.float64), moves, emissions


def trained(blocks: DataFrame, known: Totals, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model after so many rounds of Baum-Welch over all training text, and the log likelihood of its classes before each
    round. Tasks add up expected counts over their blocks; the model is sent to them, and is as large for any input."""
    model, likelihoods = first_model(blocks, known, states), []
    shape = (1 + states + 1 + CLASSES + 2, states)
    for _ in range(rounds):

        def measure(about: bytes, classes: bytes, types: bytes, model: Model = model) -> np.ndarray:
            gain, starts, moves, emitted = expectations(*_training(about, classes), model)
            return np.concatenate([np.full((1, states), gain), starts[None], moves, emitted])

        got = summed(blocks, measure, shape)
        likelihoods.append(float(got[0, 0]))
        starts, moves = got[1] + 1, got[2 : 2 + states] + 1
        model = Model(starts / starts.sum(), moves / moves.sum(1, keepdims=True), *emissions(got[2 + states :], known))
    return model, likelihoods


def text_scores(classes: np.ndarray, sizes: np.ndarray, within: np.ndarray, model: Model) -> np.ndarray:
    """log10 of the probability of each text: forward over its classes, times each known word's share of its class."""
    place, rank, reach = time_major(sizes)
    token = np.empty(len(classes), np.int64)
    token[place] = classes
    scale = forward((model.emit / model.spread[:, None])[token], reach, model.start, model.move)
    return np.add.reduceat(np.log10(scale)[place], np.cumsum(sizes) - sizes) + within


def scored(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs (doc_id, text).

    Documents that are not held out train the model; all are scored. Null texts count as empty and have the end alone; ids that
    are null count as an empty text for the fold and train. Repeated rows train and are scored as often as they stand there.
    Scores are log10 of a text's probability among the known tokens and one that stands for all others: base_score by smoothed
    counts of single tokens, score by the hidden Markov model. Where nothing trains, every token is unknown and score is 0. Other
    columns aren't read; an empty table gives no rows. A text is held whole by one task, beside its states' probabilities.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(name) % FOLDS == HELD_OUT).alias("held_out"), text_of().alias("text"))
    blocks = checkpointed(encoded(rows), math.ceil(block_count(rows, chars=CHARS) / BLOCKS_PER_TASK))
    known = totals(blocks)
    model, _ = trained(blocks, known, states, rounds)
    n, kinds = int(known.counts.sum()), int(known.types.sum())
    rest = math.log10(n + 0.5 * (kinds + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for about, classes in zip(*(c.to_pylist() for c in x.columns)):
                ids, named, held, sizes, seen, plain, within = _about(about)
                score = text_scores(unsqueeze(classes, "u2")[0], sizes, within, model)
                columns = [pa.array(ids, mask=~named), pa.array(held), pa.array(sizes), pa.array(seen), pa.array(np.full(len(ids), n)), pa.array(plain - sizes * rest), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        release()

    return blocks.select("about", "classes").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a hidden Markov model of the four fifths that aren't held out."""
    return scored(table(spark, sf_dir, "documents"))
