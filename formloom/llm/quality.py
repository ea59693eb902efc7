"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text of each language.

Counts of the highest order come from all trusted documents; the lower orders are continuation counts. Every distinct
n-gram of the corpus gets its probability by joins of sharded count tables, and a document's perplexity, held against
quantiles of the trusted documents of its language, decides. Trusted documents are scored by models of the others.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm.common import block_count, checkpointed, fresh, from_payloads, mix, packed_blocks, parts_of, releasing, row_key, squeeze, table, text_hash, text_of, texts_as_bytes, unsqueeze

#: Characters of an n-gram: UTF-16 code units, so that each takes 16 bits of a 64-bit key and none is folded into another.
ORDER = 4
#: Documents above this quantile of their language's trusted perplexities are rejected; README gives what it catches.
QUANTILE = 0.98
#: Trusted documents are dealt to so many folds by a hash of their text (copies share one); a model without a fold scores it.
FOLDS = 4
#: Symbol before a text's first character.
BEGIN = 2
#: Keys that are held at a time while texts are counted and scored.
PIECE_KEYS = 1 << 20
#: Log probabilities travel as whole multiples of this, in 16 bits.
LOG_STEP = 1 / 2048
#: Thresholds are read from counts of perplexities in steps of this much of their logarithm.
STEP = 1e-4


def grams(text: str) -> np.ndarray:
    """The key of each UTF-16 code unit with the three before it."""
    code = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    code = np.r_[np.full(ORDER - 1, BEGIN, np.uint64), code]
    key = code[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        key |= code[ORDER - 1 - back : len(code) - back] << np.uint64(16 * back)
    return key


def _grams_by_language(rows: pa.Table):
    """(language, row numbers, keys of each of the rows' texts one after another, where each text begins), in pieces of
    about PIECE_KEYS keys, languages in order."""
    by: dict[str, list[int]] = {}
    for i, lang in enumerate(rows.column("lang").to_pylist()):
        by.setdefault(lang, []).append(i)
    texts = rows.column("text")
    for lang, at in sorted(by.items()):
        held, keys, size = [], [], 0
        for i in at:
            held.append(i)
            keys.append(grams(texts[i].as_py()))
            size += len(keys[-1])
            if size >= PIECE_KEYS or i == at[-1]:
                yield lang, np.array(held), np.concatenate(keys), np.cumsum([0, *map(len, keys)])
                held, keys, size = [], [], 0


def _distinct_grams(rows: pa.Table, model: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """language -> (its distinct keys, sorted; counts (FOLDS, keys) in the trusted texts of each fold)."""
    parts: dict[str, list] = {}
    for lang, at, keys, cuts in _grams_by_language(rows):
        of = np.repeat(model[at], np.diff(cuts))
        unique = np.unique(keys)
        counts = np.zeros((FOLDS, len(unique)), np.uint32)
        for m in range(FOLDS):
            known, n = np.unique(keys[of == m], return_counts=True)
            counts[m, np.searchsorted(unique, known)] = n
        parts.setdefault(lang, []).append((unique, counts))
    return {lang: _added_up([p[0] for p in ps], [p[1] for p in ps]) for lang, ps in parts.items()}


def _added_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 1:
        return keys[0], counts[0]
    unique, which = np.unique(np.concatenate(keys), return_inverse=True)
    by_fold = np.concatenate(counts, 1)
    return unique, np.stack([np.bincount(which, n, len(unique)) for n in by_fold]).astype(np.uint32)


def _steps(sorted_keys: np.ndarray) -> np.ndarray:
    """Sorted keys as their differences, which compress better; np.cumsum() undoes it."""
    return np.diff(sorted_keys, prepend=np.uint64(0))


def _suffix(gram: Column, order: int) -> Column:
    """The last `order` characters of a key."""
    return gram.bitwiseAND(F.lit((1 << (16 * order)) - 1)) if order < ORDER else gram


def _orders(counts: DataFrame, models: list[str], parts: int | None) -> dict[int, DataFrame]:
    """order -> (lang, gram, n of each model): counts of the highest order, continuation counts of those below."""
    n = [f"n{m}" for m in models]
    out = {ORDER: counts.where(F.greatest(*n, F.lit(0)) > 0).select("lang", "gram", *n)}
    for order in range(ORDER - 1, 0, -1):
        seen = [F.sum((F.col(c) > 0).cast("long")).alias(c) for c in n]
        out[order] = checkpointed(out[order + 1].groupBy("lang", _suffix(F.col("gram"), order).alias("gram")).agg(*seen), parts)
    return out


def _discounts(counts: DataFrame, models: list[str]) -> DataFrame:
    """(lang, d1, d2, d3 of each model): the modified discounts of one order from its counts of counts."""
    of = counts.groupBy("lang").agg(*(F.sum((F.col(f"n{m}") == k).cast("long")).cast("double").alias(f"t{k}{m}") for m in models for k in range(1, 5)))

    def part(k: int, m: str) -> Column:
        t = lambda i: F.col(f"t{i}{m}")
        y = F.when(t(1) > 0, t(1) / (t(1) + 2 * t(2))).otherwise(0.5)
        return F.greatest(F.lit(0.1 * k), F.least(F.lit(float(k)), F.when(t(k) > 0, k - (k + 1) * y * t(k + 1) / t(k)).otherwise(0.5 * k)))

    return of.select("lang", *(part(k, m).alias(f"d{k}{m}") for m in models for k in (1, 2, 3)))


def _discount(n: Column, m: str) -> Column:
    return F.when(n == 0, 0.0).when(n == 1, F.col(f"d1{m}")).when(n == 2, F.col(f"d2{m}")).otherwise(F.col(f"d3{m}"))


def probabilities(counts: DataFrame, models: tuple[str, ...] = ("",), parts: int | None = None) -> DataFrame:
    """(lang, gram, p of each model) for every row of counts (lang, gram, n of each model), also where n is 0: each model's
    probability of the last character after those before it. Columns of a model are n and p with its name behind.

    Languages without trusted text have no rows; where one model of a language has none, its p is null.
    """
    models = list(models)
    by_order = _orders(counts, models, parts)
    symbols = by_order[1].groupBy("lang").agg(*((F.sum((F.col(f"n{m}") > 0).cast("long")) + 1).alias(f"symbols{m}") for m in models))
    below = None
    for order in range(1, ORDER + 1):
        seen = by_order[order]
        discounts = F.broadcast(_discounts(seen, models))  # a row for each language
        context = F.shiftrightunsigned("gram", 16)
        sums = [c for m in models for c in (F.sum(f"n{m}").cast("double").alias(f"total{m}"), F.sum(_discount(F.col(f"n{m}"), m)).alias(f"held{m}"))]
        stats = seen.join(discounts, "lang").groupBy("lang", context.alias("context")).agg(*sums)
        if order < ORDER:
            asked = counts.select("lang", _suffix(F.col("gram"), order).alias("gram")).distinct().join(seen, ["lang", "gram"], "left")
        else:
            asked = counts
        rows = asked.join(discounts, "lang").withColumn("context", context).join(stats, ["lang", "context"], "left")
        if order == 1:
            first = symbols.select("lang", *(F.when(F.col(f"symbols{m}") > 1, 1 / F.col(f"symbols{m}")).alias(f"lower{m}") for m in models))
            rows = rows.join(F.broadcast(first), "lang")
        else:
            lower = below.select("lang", F.col("gram").alias("suffix"), *(F.col(f"p{m}").alias(f"lower{m}") for m in models))
            rows = rows.withColumn("suffix", _suffix(F.col("gram"), order - 1)).join(lower, ["lang", "suffix"])

        def p(m: str) -> Column:
            n, total, low = F.coalesce(f"n{m}", F.lit(0)), F.col(f"total{m}"), F.col(f"lower{m}")
            return F.when(total > 0, (n - _discount(n, m) + F.col(f"held{m}") * low) / total).otherwise(low).alias(f"p{m}")

        kept = [c for c in ("shard",) if c in counts.columns and order == ORDER]
        below = rows.select(*kept, "lang", "gram", *(p(m) for m in models))
        if order < ORDER:
            below = checkpointed(below, parts)
    return below


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, lang, text_hash, text_length, trusted, perplexity), one row per row of docs (doc_id, lang, text).

    trusted: the doc_ids whose text trains the model. Their own perplexity comes from the trusted text outside their fold;
    others are scored by all of it. Perplexity is per character; null for empty and null texts, for languages (null is
    one of its own) without trusted text, and for trusted documents without any outside their fold. Repeated rows count
    as often as they stand there. text_length counts UTF-16 code units, text_hash is the first half of the text's SHA-256.
    Other columns of docs aren't read; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text_of().alias("text"))
    blocks = block_count(rows)
    shards = max(16, math.ceil(blocks / 2))
    texts = packed_blocks(rows, blocks, level=6).groupBy("block")
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))

    scored = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text_hash", pa.binary()), ("text_length", pa.int64()), ("trusted", pa.bool_()), ("perplexity", pa.float64())])

    models = tuple(f"_{m}" for m in range(FOLDS + 1))

    def models_of(rows: pa.Table, good: set[int]) -> np.ndarray:
        """The fold of each row's text, FOLDS (the model of all trusted text) for rows that aren't trusted."""
        pairs = zip(rows.column("doc_id").to_pylist(), texts_as_bytes(rows.column("text")))
        return np.fromiter((xxhash.xxh3_64_intdigest(t) % FOLDS if i in good else FOLDS for i, t in pairs), np.int64, rows.num_rows)

    def shard_of(unique: np.ndarray) -> np.ndarray:
        return (mix(unique, np.zeros(1, np.uint64)) % np.uint64(shards)).astype(np.int64)

    def send(key: tuple[pa.Scalar, ...], group: pa.Table, trusted: pa.Table) -> pa.Table:
        out: dict[str, list] = {"block": [], "shard": [], "lang": [], "value": []}
        rows = from_payloads(group.column("payload")) if group.num_rows else None  # a block may have labels alone
        model = models_of(rows, set(trusted.column("doc_id").to_pylist())) if rows else None
        for lang, (unique, counts) in _distinct_grams(rows, model).items() if rows else []:
            shard = shard_of(unique)
            for s in np.unique(shard).tolist():
                own = shard == s
                out["block"].append(key[0].as_py()), out["shard"].append(s), out["lang"].append(lang)
                out["value"].append(squeeze(_steps(unique[own]), counts[:, own]))
        return pa.table({"block": pa.array(out["block"], pa.int32()), "shard": pa.array(out["shard"], pa.int32()), "lang": pa.array(out["lang"], pa.string()), "value": pa.array(out["value"], pa.binary())})

    def add_up(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        got = [unsqueeze(v.as_py(), "u8", "u4") for v in group.column("value")]
        gram, counts = _added_up([np.cumsum(g[0]) for g in got], [g[1].reshape(FOLDS, -1) for g in got])
        counts = counts.astype(np.int64)
        total = counts.sum(0)
        n = [*(total - counts), total]  # of the models without a fold, and of the whole one
        columns = [pa.array(np.full(len(gram), key[0].as_py()), pa.int32()), pa.array([key[1].as_py()] * len(gram), pa.string()), pa.array(gram.view(np.int64)), *map(pa.array, n)]
        return pa.table(columns, names=["shard", "lang", "gram", *(f"n{m}" for m in models)])

    def answer(key: tuple[pa.Scalar, ...], asked: pa.Table, known: pa.Table) -> pa.Table:
        gram = known.column("gram").to_numpy().view(np.uint64)
        order = np.argsort(gram)
        logs = np.zeros((FOLDS + 1, len(gram)), np.uint16)
        has = np.zeros(FOLDS + 1, bool)
        for i, m in enumerate(models):
            p = known.column(f"p{m}").to_numpy()[order]
            has[i] = len(p) > 0 and not np.isnan(p[0])
            if has[i]:
                logs[i] = np.minimum(np.round(-np.log(p) / LOG_STEP), 65535)
        gram = gram[order]
        values = []
        for v in asked.column("value"):
            steps, counts = unsqueeze(v.as_py(), "u8", "u4")
            keys = np.cumsum(steps)
            score = logs[:, np.searchsorted(gram, keys)] if len(gram) else np.zeros((FOLDS + 1, len(keys)), np.uint16)
            score[:FOLDS][counts.reshape(FOLDS, -1) == 0] = 0  # a fold's model is asked only for what the fold holds
            values.append(squeeze(score, has))
        return pa.table({"block": asked.column("block"), "shard": asked.column("shard"), "lang": asked.column("lang"), "value": pa.array(values, pa.binary())})

    def score(key: tuple[pa.Scalar, ...], group: pa.Table, scores: pa.Table) -> pa.Table:
        if not group.num_rows:
            return scored.empty_table()
        rows = from_payloads(group.column("payload"))
        parts, good = {}, set()
        for shard, lang, value in zip(scores.column("shard").to_pylist(), scores.column("lang").to_pylist(), scores.column("value")):
            if shard < 0:
                good.add(int(value.as_py()))
            else:
                score, has = unsqueeze(value.as_py(), "u2", "?")
                parts[lang, shard] = score.reshape(FOLDS + 1, -1), has
        model = models_of(rows, good)
        length, found = np.zeros(rows.num_rows, np.int64), np.full(rows.num_rows, np.nan)
        known = {}
        for lang, (unique, _) in _distinct_grams(rows, model).items():
            shard = shard_of(unique)
            logs, has = np.empty((FOLDS + 1, len(unique)), np.uint16), np.zeros(FOLDS + 1, bool)
            for s in np.unique(shard).tolist():  # in the order in which send put them
                logs[:, shard == s] = parts[lang, s][0]
                has |= parts[lang, s][1]
            known[lang] = unique, logs, has
        for lang, at, keys, cuts in _grams_by_language(rows):
            unique, logs, has = known[lang]
            length[at] = size = np.diff(cuts)
            each = logs[np.repeat(model[at], size), np.searchsorted(unique, keys)]
            total = np.bincount(np.repeat(np.arange(len(at)), size), each, len(at)) * LOG_STEP
            some = (size > 0) & has[model[at]]
            found[at[some]] = np.exp(total[some] / size[some])
        hashes = [hashlib.sha256(t).digest()[:16] for t in texts_as_bytes(rows.column("text"))]
        columns = [rows.column("doc_id"), rows.column("lang"), pa.array(hashes, pa.binary()), pa.array(length), pa.array(model < FOLDS), pa.array(found, mask=np.isnan(found))]
        return pa.table(columns, schema=scored)

    # What is sent is made again for the answers, from the same exchange of texts, rather than kept on disk in between.
    sending = texts.cogroup(ids.groupBy("block")).applyInArrow(releasing(send), "block int, shard int, lang string, value binary")
    numbers = ", ".join(f"n{m} long" for m in models)
    counts = checkpointed(sending.groupBy("shard", "lang").applyInArrow(releasing(add_up), f"shard int, lang string, gram long, {numbers}"), shards)
    known = probabilities(counts, models, shards)
    back = sending.groupBy("shard", "lang").cogroup(known.groupBy("shard", "lang")).applyInArrow(releasing(answer), "block int, shard int, lang string, value binary")
    marks = ids.select("block", F.lit(-1).alias("shard"), F.lit("").alias("lang"), F.encode(F.col("doc_id").cast("string"), "UTF-8").alias("value"))
    return texts.cogroup(back.unionByName(marks).groupBy("block")).applyInArrow(releasing(score), "doc_id long, lang string, text_hash binary, text_length long, trusted boolean, perplexity double")


def quantiles(values: DataFrame, quantile: float) -> DataFrame:
    """(lang, threshold) of values (lang, value > 0): the upper edge of the step, STEP of the logarithm wide, in which the
    smallest value with that share of the language's values at or below it lies. Reruns agree, and a language's steps,
    unlike its values, are bounded in number."""
    step = F.floor(F.log("value") / STEP)
    counts = values.groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    language = Window.partitionBy("lang")
    upto = counts.withColumn("upto", F.sum("n").over(language.orderBy("step"))).withColumn("all", F.sum("n").over(language))
    reached = upto.where(F.col("upto") >= quantile * F.col("all")).groupBy("lang").agg(F.min("step").alias("step"))
    return reached.select("lang", F.exp((F.col("step") + 1) * STEP).alias("threshold"))


def classified(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, text_hash, text_length, trusted, perplexity, threshold, kept), one row per row of docs.

    Trusted text is that labelled quality 1 and not toxic. A document is rejected if its perplexity is above its
    language's threshold: the quantile of the trusted documents' perplexities, each from a model without it. Where there is
    no perplexity or no threshold (empty text, language without trusted text in two folds) it is kept. All labels train,
    so what is counted grows with the corpus. Other columns aren't read; an empty table gives an empty result.
    """
    trusted = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id").distinct()
    scored = checkpointed(perplexities(docs, trusted), parts_of(docs.count(), 5_000))
    limits = quantiles(scored.where("trusted AND perplexity IS NOT NULL").select("lang", F.col("perplexity").alias("value")), quantile)
    out = scored.join(F.broadcast(limits), "lang", "left")  # a row for each language
    return out.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their perplexity and whether it is within their language's threshold."""
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "lang", "text_length", "trusted", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), "kept")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows that the classifier rejects go; rows that share an id, or have none, are judged by their own
    language and text.

    Null and empty texts are kept, and so are repeated rows. An empty table stays empty; any other columns go along under
    their own names.
    """
    language = lambda c: F.concat(F.hex(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("/"))
    rejected = classified(docs, table(spark, sf_dir, "labels")).where("NOT kept")
    key = fresh(docs, "row_key")
    named = lambda hashed: row_key(F.concat(language("lang"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), hashed)
    gone = rejected.select(named(F.col("text_hash")).alias(key)).distinct()
    return docs.withColumn(key, named(text_hash())).join(gone, key, "left_anti").select(*(f"`{c}`" for c in docs.columns))
