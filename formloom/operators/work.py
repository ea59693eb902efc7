"""Operators of running work: roots and files, chunks and cycles, commands on texts, found strings, examples, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.functions.text import ordered_rules


def least_roots(roots: DataFrame, path: str) -> DataFrame:
    """Roots that lie below no other: each path is held against its own ancestors, not against all roots."""
    once = roots.select(F.regexp_replace(path, "/+$", "").alias(path)).distinct()
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    ancestors = once.select(F.col(path), F.explode(above).alias("ancestor")).where(F.col("ancestor") != F.col(path))
    covered = ancestors.join(once.withColumnRenamed(path, "ancestor"), "ancestor", "left_semi").select(path).distinct()
    return once.join(covered, path, "left_anti")


def file_kinds(files: DataFrame, path: str, size: str) -> DataFrame:
    """(root, extension, files, bytes) of paths: the first folder and the letters behind the last point."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return files.groupBy(F.regexp_extract(path, "^/?([^/]+)", 1).alias("root"), extension.alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))


def chunks(items: DataFrame, position: str, size: int) -> DataFrame:
    """(chunk, first, last, n): runs of work by a position that items keep, for a cursor that goes on after a stop."""
    chunk = F.floor(F.col(position) / size)
    return items.groupBy(chunk.alias("chunk")).agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("n"))


def after_cursor(items: DataFrame, position: str, cursor: Column, size: int) -> DataFrame:
    """The items of the next chunk behind a cursor."""
    return items.where((F.col(position) >= cursor) & (F.col(position) < cursor + size))


def running_totals(cycles: DataFrame, order: str, *measures: str) -> DataFrame:
    """cycles, one row each, with the totals so far. Cycles are counted rows of a report, so one task holds them."""
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cycles.select("*", *(F.sum(m).over(upto).alias(f"total_{m}") for m in measures))


def changed_files(seen: DataFrame, now: DataFrame, path: str, key: str) -> DataFrame:
    """(path, key, event): files whose detection key is new or another one; those that went are left out."""
    before = seen.select(path, F.col(key).alias("key_before"))
    event = F.when(F.col("key_before").isNull(), "created").when(F.col("key_before") != F.col(key), "modified")
    return now.join(before, path, "left").withColumn("event", event).where("event IS NOT NULL").select(path, key, "event")


def found_strings(texts: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, nth, start): where a string occurs in each text, without overlaps, code points from 0."""
    pieces = F.split(text, F.regexp_replace(F.lit(query), r"([\\.^$|?*+()\[\]{}])", r"\\$1"), -1)
    ends = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), lambda s, p: F.struct((s["at"] + F.length(p) + len(query)).alias("at"), F.concat(s["starts"], F.array(s["at"] + F.length(p))).alias("starts")), lambda s: s["starts"])
    starts = F.slice(ends, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return texts.select(key, F.posexplode(starts).alias("nth", "start"))


def replace_plan(texts: DataFrame, key: str, text: str, query: str, by: str) -> DataFrame:
    """(key, hits, before_sha256, after_sha256) of texts that hold a string: what replacing it everywhere would change."""
    after = F.replace(F.col(text), F.lit(query), F.lit(by))
    hits = ((F.length(text) - F.length(F.replace(F.col(text), F.lit(query), F.lit("")))) / len(query)).cast("int")
    return texts.select(key, hits.alias("hits"), F.sha2(text, 256).alias("before_sha256"), F.sha2(after, 256).alias("after_sha256")).where("hits > 0")


def folded(base: DataFrame, commands: DataFrame, key: str, text: str, seq: str) -> DataFrame:
    """(key, text, applied, refused): ordered commands (key, seq, start, chars, expected, insert) put into texts one after
    another; one whose expected text doesn't stand there is refused and changes nothing. A text's commands fold in one row."""
    log = commands.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(seq, "start", "chars", "expected", "insert"))).alias("log"))
    joined = base.join(log, key, "left").withColumn("log", F.coalesce("log", F.array().cast(log.schema["log"].dataType)))

    def step(state: Column, c: Column) -> Column:
        now = state["text"]
        fits = F.substring(now, c["start"] + 1, c["chars"]) == c["expected"]
        put = F.concat(F.substring(now, F.lit(1), c["start"]), c["insert"], F.substring(now, c["start"] + c["chars"] + 1, F.length(now)))
        return F.struct(F.when(fits, put).otherwise(now).alias("text"), (state["applied"] + fits.cast("int")).alias("applied"))

    done = F.aggregate("log", F.struct(F.col(text).alias("text"), F.lit(0).alias("applied")), step)
    return joined.select(key, done.alias("d"), F.size("log").alias("n")).select(key, F.col("d.text").alias(text), F.col("d.applied").alias("applied"), (F.col("n") - F.col("d.applied")).alias("refused"))


def examples(rows: DataFrame, item: str, document: str, most: int) -> DataFrame:
    """(item, examples): the first documents of each item; the ranks are pruned before they are gathered."""
    once = rows.select(item, document).distinct()
    first = once.withColumn("nth", F.row_number().over(Window.partitionBy(item).orderBy(document))).where(F.col("nth") <= most)
    return first.groupBy(item).agg(F.array_sort(F.collect_list(document)).alias("examples"))


def recommended(bucket: Column, flags: Column) -> Column:
    """A reviewer's likely decision by bucket and risk flags."""
    return ordered_rules([(F.array_contains(flags, "conflict"), "HOLD"), ((bucket == "strong") & (F.size(flags) == 0), "APPROVE"), (bucket == "noise", "REJECT")], "REVIEW")


def candidacy(has_schema: Column, applicants: Column, kind: Column) -> Column:
    return ordered_rules([(~has_schema, "no_schema"), (kind == "notice", "not_fillable"), (applicants > 0, "candidate")], "empty")


def bar_action(conflict: Column, has_cells: Column, reviewed: Column) -> Column:
    """What becomes of a bar that a schedule proposes."""
    return ordered_rules([(conflict & ~reviewed, "HOLD_CONFLICT"), (~has_cells, "SKIP_NO_CELLS"), (conflict, "OVERWRITE"), (reviewed, "APPLY")], "REVIEW")


def included(title: Column, wanted: list[str], unwanted: list[str]) -> Column:
    """struct<keep, reason>: unwanted words go before wanted ones."""
    first = lambda words: ordered_rules([(F.contains(title, F.lit(w)), w) for w in words], "")
    no, yes = first(unwanted), first(wanted)
    return F.when(no != "", F.struct(F.lit(False).alias("keep"), F.concat(F.lit("has "), no).alias("reason"))).when(yes != "", F.struct(F.lit(True).alias("keep"), F.concat(F.lit("has "), yes).alias("reason"))).otherwise(F.struct(F.lit(False).alias("keep"), F.lit("nothing wanted").alias("reason")))
