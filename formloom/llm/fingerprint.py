"""Document fingerprints from closed syncmers, with DataFrame functions alone.

A k-mer of tokens is a closed syncmer if the smallest of its inner s-mers stands at one of its two edges. That depends on
the k-mer alone, so an edit changes only the anchors that it touches. A fingerprint has all anchors of a text with their
positions. Two texts are held against each other by anchors and by links: two anchors that follow one another at the same
distance, wherever they stand, so what an insertion moves still matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm.common import table, text_of

#: Tokens of a k-mer and of an inner s-mer; a third of all k-mers are closed syncmers.
K, S = 8, 3
#: A piece of a word, of four letters at most; in scripts that are written without spaces, one letter. Texts of every
#: length are read in these.
TOKEN = r"[!-~\u00a1-\u024f]{1,4}+|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[^\s!-~\u00a1-\u024f\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]{1,4}+"
#: Documents of one range of doc_ids, about.
ROWS_PER_RANGE = 2000


def anchors(text: Column) -> Column:
    """array<struct<hash, pos>>: the closed syncmers of a text's tokens in order, at the position of their first token.

    K - 1 marks stand before the first token, so every text with a token has k-mers (with positions below 0). A text
    without anchors has one, of the whole text.
    """
    # One-element arrays bind what is looked up by position, so that it is computed once for a text.
    edge = K - S
    bind = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    names = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda x: F.hash(x))
    padded = F.concat(F.array_repeat(F.lit(0), K - 1), names)
    inner = bind(padded, lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - S), lambda i: F.hash(F.get(t, i), F.get(t, i + 1), F.get(t, i + 2))))

    def pick(h: Column) -> Column:
        at = lambda i, d: F.get(h, i + d)
        closed = lambda i: F.least(at(i, 0), at(i, edge)) <= F.least(*(at(i, d) for d in range(1, edge)))
        starts = F.filter(F.sequence(F.lit(0), F.size(h) - edge - 1), closed)
        return F.transform(starts, lambda i: F.struct(F.hash(at(i, 0), at(i, S), at(i, edge)).alias("hash"), (i - (K - 1)).alias("pos")))

    whole = F.array(F.struct(F.hash(F.lit("whole"), text).alias("hash"), F.lit(0).alias("pos")))
    found = bind(inner, lambda h: F.when(F.size(h) > edge, pick(h)))
    return bind(found, lambda a: F.when(F.size(a) > 0, a).otherwise(whole))


def fingerprint(found: Column) -> Column:
    """The anchors as text: hash in hexadecimal, colon, position, joined by blanks."""
    return F.array_join(F.transform(found, lambda x: F.concat(F.lower(F.hex(x["hash"])), F.lit(":"), x["pos"].cast("string"))), " ")


def marks(found: Column) -> Column:
    """The distinct hashes of the anchors and of their links (an anchor, the one after it, their distance)."""

    def both(a: Column) -> Column:
        hashes = F.transform(a, lambda x: x["hash"].cast("long"))
        links = F.transform(F.slice(a, 2, F.size(a)), lambda x, i: F.xxhash64(F.get(a, i)["hash"], x["hash"], x["pos"] - F.get(a, i)["pos"]))
        return F.array_distinct(F.concat(hashes, links))

    return F.get(F.transform(F.array(found), both), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Share of two texts' marks that they have in common (Dice), from 0 to 1."""
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, anchors, marks, next_text, next_marks): each document beside the one with the next larger doc_id.

    After the largest id the smallest follows. Rows that repeat an id follow one another by text; null ids stand first.
    Ranges of ids, cut at quantiles (ids that occur, so few rows mark the cuts), are sorted on their own; the first
    documents of a range are also sent to the range before, so the texts are shuffled once and no task holds them all.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), text_of().alias("text"))
    n = rows.count()
    parts = max(1, min(10_000, n // ROWS_PER_RANGE))
    cuts = rows.agg(F.percentile_approx("key", [i / parts for i in range(parts)] if parts > 1 else [0.0], 100 * parts), F.min("key")).first()
    starts = sorted({*(cuts[0] or []), *([] if cuts[1] is None else [cuts[1]])})
    if not starts:
        starts = [0]
    bounds = F.array(*(F.lit(x) for x in starts))
    # Where a key falls: a running step over at most 10,000 sorted cuts, found by their position in a sorted array.
    range_of = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(starts).bit_length()))), F.struct(F.lit(0).alias("low"), F.lit(len(starts)).alias("high")), lambda s, _: _halve(s, bounds), lambda s: s["low"])
    placed = rows.withColumn("range", range_of)
    ghost = F.array_position(bounds, F.col("key"))  # the first id of a range
    twice = F.when(ghost > 0, F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("late")), F.struct(F.when(ghost > 1, ghost - 2).otherwise(len(starts) - 1).cast("int").alias("range"), F.lit(1).alias("late")))).otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("late"))))
    sent = placed.withColumn("to", F.explode(twice)).select("doc_id", "key", "text", "to.range", "to.late")
    order = Window.partitionBy("range").orderBy("late", "key", "text")
    return (
        sent.repartition(F.col("range"))
        .withColumn("anchors", anchors(F.col("text")))
        .withColumn("marks", marks(F.col("anchors")))
        .withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_marks", F.lead("marks").over(order))
        .where("late = 0")
        .select("doc_id", "text", "anchors", "marks", "next_text", "next_marks")
    )


def _halve(s: Column, bounds: Column) -> Column:
    middle = F.shiftright(s["low"] + s["high"], 1)
    goes_up = F.get(bounds, middle) <= F.col("key")
    open_ = s["high"] - s["low"] > 1
    return F.struct(F.when(open_ & goes_up, middle).otherwise(s["low"]).alias("low"), F.when(open_ & ~goes_up, middle).otherwise(s["high"]).alias("high"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_anchors.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document. Null texts count as empty; an empty text has a fingerprint of its own, the same for all. Of rows that repeat
    an id the smaller text comes first. A table of one row is its own next; an empty table gives an empty result. Other
    columns aren't read.
    """
    pairs = with_next(docs)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = pairs.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).drop("text", "next_text").withColumn("edited_anchors", anchors(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("anchors")).alias("fingerprint"),
        fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("marks"), marks(F.col("edited_anchors"))).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
        F.size("anchors").cast("long").alias("n_anchors"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))
