"""MinHash near-dedup by BagMinHash: weighted signatures, bands, verified multiset overlap, classes of linked texts.

A text is the multiset of its five-word shingles. Its signature holds, for each slot, the earliest point of Poisson
processes over (shingle, weight): weights are discretised to whole numbers and covered by dyadic intervals, each with a
process of its own whose rate is the interval's length; a point counts where it lies below the shingle's weight. Two
signatures agree in a slot with the probability of the weighted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import block_count, checkpointed, from_payloads, mix, packed_blocks, parts_of, release, releasing, row_key, staying_rows, table, text_hash, text_of, texts_as_bytes, to_payload, written

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of rows: a pair at similarity 0.8 shares no band with probability (1 - 0.8 ** 4) ** 32 = 5e-8.
BANDS, ROWS = 32, 4
#: Slots of a signature: the bands take the first of them, the estimate all.
SLOTS = 320
#: A pair is verified whose estimated similarity is at most so many standard deviations of the estimate below SIMILARITY:
#: a pair at SIMILARITY falls below that once in 4000 times. None verifies every pair that shares a band.
DEVIATIONS = 3.5
#: Partners of a text that one verifying task holds against it.
PARTNERS = 64
#: Bytes of text whose signatures are made at once.
SIGNED_BYTES = 1 << 20
#: Members of a band that one comparing task takes from either side.
PIECE = 512


def least_estimate(deviations: float | None) -> float:
    return -1.0 if deviations is None else SIMILARITY - deviations * (SIMILARITY * (1 - SIMILARITY) / SLOTS) ** 0.5


def shingle_names(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle name) of every shingle of each text; a text of fewer words than size is one shingle."""
    found = [t.split() for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    names = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(found)), np.uint64, int(sizes.sum()))
    whole = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(found)), sizes)
    left = np.repeat(whole + sizes, sizes) - np.arange(len(names))  # words from here to the text's end
    begins = (left >= size) | ((left == np.repeat(sizes, sizes)) & (left < size))
    name = names.copy()
    for i in range(1, size):
        more = np.flatnonzero(left[: max(0, len(names) - i)] > i)
        name[more] = mix(name[more], names[more + i])
    return text[begins], name[begins]


def weighed(text: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, name, weight) once for each shingle of a text."""
    if not len(name):
        return text, name, np.zeros(0, np.int64)
    both = mix(name, text.astype(np.uint64))
    order = np.argsort(both, kind="stable")
    at = np.flatnonzero(np.r_[True, both[order][1:] != both[order][:-1]])
    return text[order][at], name[order][at], np.diff(np.r_[at, len(order)])


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0


def bag_signatures(texts: list[bytes], slots: int = SLOTS) -> np.ndarray:
    """(texts, slots) of the bits of the earliest times; texts without words have the same row of ones."""
    text, name, weight = weighed(*shingle_names(texts))
    time = np.full((len(texts), slots), np.inf)
    flat = time.reshape(-1)
    # Dyadic intervals [0, 1), [1, 2), [2, 4), ... as far as each weight reaches into them.
    parts = [(text, mix(name, np.zeros(1, np.uint64)), weight, np.zeros(len(name)), np.ones(len(name)))]
    low = 1
    while len(more := np.flatnonzero(weight > low)):
        n = len(more)
        parts.append((text[more], mix(name[more], np.full(1, low, np.uint64)), weight[more], np.full(n, low, float), np.full(n, low, float)))
        low *= 2
    text, seed, weight, base, rate = (np.concatenate(c) for c in zip(*parts))
    clock, step = np.zeros(len(text)), 0
    while len(text):
        draw = mix(seed, np.full(1, step + 1, np.uint64))
        clock = clock - np.log(_unit(draw)) / rate
        other = mix(draw, np.full(1, 0xA5A5A5A5, np.uint64))
        slot = (other % np.uint64(slots)).astype(np.int64)
        counts = base + np.floor(_unit(mix(other, np.full(1, 0x5A5A, np.uint64))) * rate) < weight
        np.minimum.at(flat, text[counts] * slots + slot[counts], clock[counts])
        latest = time.max(1)
        on = np.flatnonzero(clock < latest[text])
        text, seed, weight, base, rate, clock = text[on], seed[on], weight[on], base[on], rate[on], clock[on]
        step += 1
    return time.view(np.uint64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        piece = ends // SIGNED_BYTES
        cuts = [*np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]][: len(piece)]).tolist(), whole.num_rows]
        for batch in (whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:])):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            sig = bag_signatures(texts)
            bands = np.empty((len(texts), BANDS), np.uint64)
            for b in range(BANDS):
                key = np.full(len(texts), b + 1, np.uint64)
                for r in range(ROWS):
                    key = mix(key, sig[:, b * ROWS + r])
                bands[:, b] = key
            short = (mix(sig, np.full(1, 77, np.uint64)) & np.uint64(255)).astype(np.uint8)
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([s.tobytes() for s in short], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(bands.reshape(-1).view(np.int64)))],
                ["doc_id", "text_hash", "signature", "bands"],
            )
    release()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity from signatures of one byte a slot; two unlike slots agree once in 256."""
    return ((a == b).mean(-1) - 1 / 256) * 256 / 255


def bag_similarity(a: bytes, b: bytes) -> float:
    """Exact weighted Jaccard similarity of the texts' shingle multisets; equal texts have 1."""
    text, name, weight = weighed(*shingle_names([a, b]))
    return _overlap(name[text == 0], weight[text == 0], name[text == 1], weight[text == 1])


def _overlap(name_a, weight_a, name_b, weight_b) -> float:
    """Both sides hold each name once."""
    if not len(name_a) and not len(name_b):
        return 1.0
    names = np.concatenate([name_a, name_b])
    weights = np.concatenate([weight_a, weight_b])
    order = np.argsort(names, kind="stable")
    twice = np.flatnonzero(names[order][1:] == names[order][:-1])
    both = int(np.minimum(weights[order][twice], weights[order][twice + 1]).sum())
    return both / (int(weights.sum()) - both)


def _dealt(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with `salt`: runs of at most PARTNERS partners of one a, within ranges of the sorted pairs, share one."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, size = None, 0, 0
        for x in batches:
            salts = []
            for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                if a != last or size == PARTNERS:
                    last, first, size = a, b, 0
                size += 1
                salts.append(first)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(salts, pa.int64())], ["a", "b", "salt"])
        release()

    ranged = pairs.select("a", "b").repartitionByRange("a", "b").sortWithinPartitions("a", "b")
    return ranged.mapInArrow(runs, "a long, b long, salt long")


def verified(pairs: DataFrame, texts: DataFrame, parts: int | None = None) -> DataFrame:
    """Of pairs (a, b), those of similarity SIMILARITY or more. texts: (doc_id, text), compressed pieces of texts.

    The partners of a text are dealt to groups of at most PARTNERS, so a text with a third of all as partners is worked
    on by many tasks.
    """
    dealt = checkpointed(_dealt(pairs), parts)
    side_b = dealt.join(texts, dealt.b == texts.doc_id).select("a", "salt", "b", "text")
    heads = dealt.select("a", "salt").distinct()
    side_a = heads.join(texts, heads.a == texts.doc_id).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")

    def compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        others = group.column("b").to_pylist()
        raw = [pa.ipc.open_stream(t).read_all().column(0)[0].as_py() for t in group.column("text").to_pylist()]
        head = others.index(None)
        text, name, weight = weighed(*shingle_names(raw))
        by = np.argsort(text, kind="stable")
        cuts = np.searchsorted(text[by], np.arange(len(raw) + 1))
        of = [by[c:d] for c, d in zip(cuts, cuts[1:])]
        good = [b for i, b in enumerate(others) if i != head and _overlap(name[of[head]], weight[of[head]], name[of[i]], weight[of[i]]) >= SIMILARITY]
        return pa.table({"a": pa.array([key[0].as_py()] * len(good), pa.int64()), "b": pa.array(good, pa.int64())})

    return side_b.unionByName(side_a).groupBy("a", "salt").applyInArrow(releasing(compare), "a long, b long")


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, class_id): the smallest id that links lead to, for every id in links (a, b).

    In each round every id hooks on to its smallest neighbour; ids then jump to where their target points until all point to the
    end of their tree, which takes as many steps as the logarithm of the tree's height; links are renamed, and what is left are
    links between different trees, at most half as many trees as ids before. Nothing is collected. Each step is written as a
    table and read again, so that no plan grows with the rounds and estimates of sizes are those of the files.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), parts)
    labels = None
    while edges.head(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"), F.lit(True).alias("moved")), parts)
        while hook.where("moved").head(1):
            after = hook.select(F.col("a").alias("to"), F.col("to").alias("then"))
            hook = written(hook.join(after, "to").select("a", F.col("then").alias("to"), (F.col("then") < F.col("to")).alias("moved")), parts)
        to = hook.select("a", "to")
        if labels is None:
            labels = to.select(F.col("a").alias("id"), F.col("to").alias("class_id"))
        else:
            labels = written(labels.join(to, labels.class_id == to.a, "left").select("id", F.coalesce("to", "class_id").alias("class_id")), parts)
        to_b = to.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        edges = written(edges.join(to, "a").join(to_b, "b").where("to <> to_b").select(F.least("to", "to_b").alias("a"), F.greatest("to", "to_b").alias("b")).distinct(), parts)
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("class_id"))
    return labels


def _estimated(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """pairs (a, b) with their estimated similarity, where it is high enough to verify them."""
    sig_a, sig_b = (reps.select(F.col("rep").alias(s), F.col("signature").alias(f"sig_{s}")) for s in "ab")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, SLOTS) for c in (x.column(2), x.column(3)))
            got = estimate(a, b)
            on = pa.array(np.flatnonzero(got >= least))
            yield pa.RecordBatch.from_arrays([x.column(0).take(on), x.column(1).take(on), pa.array(got).take(on)], ["a", "b", "estimate"])
        release()

    joined = pairs.join(sig_a, "a").join(sig_b, "b").select("a", "b", "sig_a", "sig_b")
    return joined.mapInArrow(score, "a long, b long, estimate double")


def text_classes(docs: DataFrame, deviations: float | None = DEVIATIONS) -> DataFrame:
    """(doc_id, text_hash, rep_id, class_id, class_hash), one row per input row: near_classes() with the text's own hash
    and that of the class's first text, the one whose (doc_id, hash) is the smallest. Hashes are 128 bits of SHA-256.

    Copies are joined first, so a group of equal texts is one entry. Entries are named by numbers of their text hashes, so
    texts that share a doc_id, or have none, are entries of their own. Each entry that shares a band with others is held
    against the most central of them, which joins most of a class at once (links that others imply need no check). Then
    members of a band that are still in different classes are held against each other, all of them: among entries that
    share a band no cap remains, and with deviations None no estimate either.
    """
    least = least_estimate(deviations)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), text_of().alias("text"))
    hashed = rows.withColumn("text_hash", text_hash())
    features = hashed.select("doc_id", "text", "text_hash").mapInArrow(_features, "doc_id long, text_hash binary, signature binary, bands array<long>")
    n = docs.count()
    entries = features.groupBy("text_hash").agg(F.min("doc_id").alias("first_id"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    reps = checkpointed(entries.withColumn("rep", F.monotonically_increasing_id()), parts_of(n, 5_000))  # fixed by the checkpoint

    members = reps.select(F.explode("bands").alias("band"), "rep")
    counts = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = checkpointed(members.join(counts, "band"), parts_of(n, 2_000))
    # The text that meets most others, over all its bands, is the likeliest to be near to those it shares a band with.
    central = shared.groupBy("rep").agg(F.sum("n").alias("met"))
    ranked = shared.join(central, "rep").select("band", F.struct("met", F.bitwise_not("rep").alias("back"), "rep").alias("rank"))
    hubs = ranked.groupBy("band").agg(F.max("rank")["rep"].alias("hub"))
    stars = shared.select("band", "rep").join(hubs, "band").where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    likely = checkpointed(_estimated(stars, reps, least).select("a", "b"), parts_of(n))
    # Texts that may have to be verified: all that share a band and whose band-mates are not ruled out by the estimate.
    texts = checkpointed(_texts_of(hashed, reps.join(shared.select("rep").distinct(), "rep").select("rep", "first_id", "text_hash")), parts_of(n, 5_000))

    classes = components(verified(likely, texts, parts_of(n)), parts_of(n))
    left = checkpointed(_pairs_in_bands(shared, classes, reps, least).join(likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), parts_of(n, 5_000))
    if left.head(1):
        # Links between classes join them: components of the classes, and what a text's class then belongs to.
        named = lambda c: classes.select(F.col("id").alias(c), F.col("class_id").alias(f"of_{c}"))
        between = verified(left, texts, parts_of(n, 5_000)).join(named("a"), "a", "left").join(named("b"), "b", "left")
        joined = components(between.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")), parts_of(n))
        outer = joined.select(F.col("id").alias("of"), F.col("class_id").alias("whole"))
        every = classes.unionByName(joined.join(classes, "id", "left_anti").select("id", F.col("id").alias("class_id")))
        classes = checkpointed(every.join(outer, every.class_id == outer["of"], "left").select("id", F.coalesce("whole", "class_id").alias("class_id")), parts_of(n))

    first = F.struct(F.col("first_id").alias("class_id"), F.col("text_hash").alias("class_hash"))
    linked = reps.join(classes, F.col("rep") == F.col("id")).select("id", F.col("class_id").alias("class"), first.alias("first"))
    of_class = linked.groupBy("class").agg(F.min("first").alias("first"))
    heads = linked.select("id", "class").join(of_class, "class").select("id", F.col("first").alias("head"))
    found = reps.select("text_hash", "first_id", "rep", first.alias("own")).join(heads, F.col("rep") == F.col("id"), "left").select("text_hash", "first_id", F.coalesce("head", "own").alias("head"))
    real = lambda c, name: F.when(F.col(c) != -(1 << 63), F.col(c)).alias(name)
    return hashed.select("doc_id", "text_hash").join(found, "text_hash").select(real("doc_id", "doc_id"), "text_hash", real("first_id", "rep_id"), real("head.class_id", "class_id"), "head.class_hash")


def near_classes(docs: DataFrame, deviations: float | None = DEVIATIONS) -> DataFrame:
    """(doc_id, rep_id, class_id, class_hash), one row per input row: classes are the components of links of SIMILARITY or
    more.

    rep_id is the smallest doc_id with the same text, class_id the smallest of the class. Null and empty texts are one
    class; null ids are smallest. Rows that share a doc_id, or have none, are documents of their own if their texts differ:
    where two classes so come to the same class_id, class_hash (hexadecimal, of the class's first text) tells them apart.
    deviations: as in least_estimate(); None verifies every pair that shares a band.
    Other columns aren't read; an empty table gives an empty result.
    """
    return text_classes(docs, deviations).select("doc_id", "rep_id", "class_id", F.lower(F.hex("class_hash")).alias("class_hash"))


def _texts_of(hashed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text) of the wanted entries (rep, first_id, text_hash), doc_id being rep; texts are compressed one by one
    before they are shuffled. Rows are dealt by id and text, so neither null ids nor copies meet in one block."""
    blocks = block_count(hashed)
    packed = packed_blocks(hashed.select(F.xxhash64("doc_id", "text_hash").alias("doc_id"), "text_hash", "text"), blocks)
    dealt = F.xxhash64(F.xxhash64(F.col("first_id"), F.col("text_hash")))
    asked = wanted.select(F.pmod(dealt, F.lit(blocks)).cast("int").alias("block"), "rep", "text_hash")

    def pick(key: tuple[pa.Scalar, ...], group: pa.Table, want: pa.Table) -> pa.Table:
        keep, ids, out = dict(zip(want.column("text_hash").to_pylist(), want.column("rep").to_pylist())), [], []
        if keep:
            rows = from_payloads(group.column("payload"))
            for h, t in zip(rows.column("text_hash").to_pylist(), texts_as_bytes(rows.column("text"))):
                if h in keep:
                    ids.append(keep.pop(h))  # a repeated text counts once
                    out.append(to_payload(pa.table({"text": pa.array([t], pa.binary())})))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(out, pa.binary())})

    return packed.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(releasing(pick), "doc_id long, text binary")


def _pairs_in_bands(shared: DataFrame, classes: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs of band-mates in different classes whose estimate is high enough, each once, as (smaller, larger).

    The members of a band's largest class need no check among themselves; all others are held against them and against
    each other. Both sides are cut in pieces of about PIECE members, and each task takes one piece of either, so a band of
    a third of all texts is many tasks. A pair that shares several bands is sent on in the first of them alone. Where that
    band has no other members, the pair has been held against each other already, as hub and member.
    """
    known = shared.join(classes, F.col("rep") == F.col("id"), "left").select("band", "rep", F.coalesce("class_id", "rep").alias("class_id"))
    sizes = known.groupBy("band", "class_id").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("band").agg(F.max(F.struct("size", "class_id")).alias("top"), F.sum("size").alias("n"), F.count(F.lit(1)).alias("classes")).where("classes > 1 and n > 2")
    pieces = lambda n: F.ceil(n / F.lit(PIECE)).cast("int")
    mixed = mixed.select("band", F.col("top.class_id").alias("top_class"), pieces(F.col("top.size")).alias("tops"), pieces(F.col("n") - F.col("top.size")).alias("others"))
    placed = known.join(mixed, "band").withColumn("is_top", F.col("class_id") == F.col("top_class"))
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("others"))).cast("int")
    placed = placed.withColumn("own", own)
    # A task is (left, right): -1 - i is piece i of the largest class, i piece i of the others; right is one of the others.
    others = F.sequence(F.lit(0), F.col("others") - 1)
    with_tops = F.transform(F.sequence(F.lit(1), F.col("tops")), lambda i: F.struct((-i).alias("left"), F.col("own").alias("right")))
    with_others = F.transform(others, lambda i: F.struct(F.least(i, F.col("own")).alias("left"), F.greatest(i, F.col("own")).alias("right")))
    tasks = F.when(F.col("is_top"), F.transform(others, lambda i: F.struct((-1 - F.col("own")).alias("left"), i.alias("right")))).otherwise(F.concat(with_tops, with_others))
    dealt = placed.select("band", "rep", "class_id", "is_top", "own", F.inline(tasks))
    with_sig = dealt.join(reps.select("rep", "signature", "bands"), "rep")

    def compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        band, left, right = (k.as_py() for k in key)
        rep, of, own = (group.column(c).to_numpy() for c in ("rep", "class_id", "own"))
        top = np.array(group.column("is_top").to_pylist(), bool)
        sig = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(-1, SLOTS)
        bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        this = int(np.flatnonzero(bands[0] == band)[0])
        on_left, on_right = top if left < 0 else ~top & (own == left), ~top & (own == right)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(on_right):
            near = np.flatnonzero(on_left & (of != of[i]) & ((rep > rep[i]) if left == right else True))
            near = near[~(bands[near, :this] == bands[i, :this]).any(1)]
            near = near[estimate(sig[near], sig[i]) >= least]
            a.append(np.minimum(rep[near], rep[i]))
            b.append(np.maximum(rep[near], rep[i]))
        return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

    return with_sig.groupBy("band", "left", "right").applyInArrow(releasing(compare), "a long, b long")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicate documents, a row per document."""
    return near_classes(table(spark, sf_dir, "documents"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the text with the smallest (doc_id, hash) goes on.

    Rows are told apart by id and text, so different texts of one id, or of none, are documents of their own. Rows repeated
    in both go on once, as staying_rows() says. An empty table stays empty; any other columns go along under their own
    names.
    """
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))
    return staying_rows(docs, text_classes(docs).where(first).select(row_key(F.col("doc_id"), F.col("text_hash")).alias("key")))
