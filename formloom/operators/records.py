"""Operators on nested records and on proposals about them: lenient JSON, verdicts, edits of elements, pairwise overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lenient_array(text: Column, element: str) -> Column:
    """The JSON array that a text holds somewhere, elements of the given type; null where there is none that can be read."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit("")), f"array<{element}>")


def verdicts(raw: Column, allowed: list[str]) -> Column:
    """map<key, verdict> of a JSON array of {key, verdict}: allowed verdicts alone, the first of each key."""
    good = F.filter(lenient_array(raw, "struct<key:string,verdict:string>"), lambda x: x["key"].isNotNull() & x["verdict"].isin(allowed))
    first = F.transform(F.array(good), lambda a: F.filter(a, lambda x, i: F.array_position(F.transform(a, lambda y: y["key"]), x["key"]) == i + 1))
    return F.map_from_entries(F.get(first, F.lit(0)))


def with_tag(elements: Column, name: str, tag: Callable[[Column], Column]) -> Column:
    """Each struct of an array with one field set anew from the struct."""
    return F.transform(elements, lambda x: x.withField(name, tag(x)))


def input_schema(fields: Column, noise: Column | None = None) -> Column:
    """struct<fields, inputs, applicant, office, sensitive> of an array of fields (label, role, sensitive): noise left out,
    counts of the rest."""
    kept = F.filter(fields, lambda x: x["role"] != "noise")
    count = lambda of: F.size(F.filter(kept, of))
    return F.struct(kept.alias("fields"), F.size(kept).alias("inputs"), count(lambda x: x["role"] == "applicant").alias("applicant"), count(lambda x: x["role"] == "office").alias("office"), count(lambda x: x["sensitive"]).alias("sensitive"))


def stable(record: Column, volatile: list[str]) -> Column:
    """A map without the keys that change from run to run, as JSON with sorted keys, for comparison."""
    kept = F.map_filter(record, lambda k, v: ~k.isin(volatile))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def demoted(role: Column, kind: Column, confidence: Column, agrees: Column, least: float = 0.8) -> Column:
    """A field loses its role only on two signals: a confident reading that it is no field, and a second one that agrees."""
    return (role == "applicant") & (kind == "not_a_field") & (confidence >= least) & F.coalesce(agrees, F.lit(False))


def confidence_tier(confidence: Column, status: Column, conflict: Column) -> Column:
    """struct<decision, tier, reason> of a proposal: conflicts and missing targets first, then by confidence."""
    verdict = lambda decision, tier, reason: F.struct(F.lit(decision).alias("decision"), F.lit(tier).alias("tier"), F.lit(reason).alias("reason"))
    return (
        F.when(conflict, verdict("HOLD", 0, "conflict"))
        .when(status == "NOT_FOUND", verdict("REJECT", 0, "no_target"))
        .when(status == "AMBIGUOUS", verdict("REVIEW", 1, "ambiguous_target"))
        .when(confidence >= 0.9, verdict("AUTO", 3, "high_confidence"))
        .when(confidence >= 0.6, verdict("REVIEW", 2, "medium_confidence"))
        .otherwise(verdict("REJECT", 1, "low_confidence"))
    )


def valid_interpretations(raw: DataFrame, known: DataFrame, key: str, confidence: str, note: str, order: list[Column], most: int = 80) -> DataFrame:
    """raw rows whose key is known, the first of each by `order`, confidence clamped to 0..1, notes cut."""
    ranked = F.min_by(F.struct(confidence, note), F.struct(*order))
    first = raw.join(known.select(key).distinct(), key, "left_semi").groupBy(key).agg(ranked.alias("first"))
    return first.select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"first.{confidence}").cast("double"))).alias(confidence), F.substring(F.col(f"first.{note}"), 1, most).alias(note))


def sourced(proposals: DataFrame, source: DataFrame, by: list[str], value: str, text: str) -> DataFrame:
    """proposals with `accepted` and `reason`: a value counts if a source text of the same key holds it or is held by it,
    both without blanks and in lower case. The source texts of a key are joined to its proposals by that key."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    a, b = bare(F.col(value)), bare(F.col(text))
    hit = F.max((F.contains(b, a) | (F.contains(a, b) & (F.length(b) >= 2))).cast("int"))
    met = proposals.join(source.select(*by, text), by, "left").groupBy(*proposals.columns).agg(F.coalesce(hit, F.lit(0)).alias("hit"), F.count(text).alias("sources"))
    reason = F.when(F.trim(F.coalesce(F.col(value), F.lit(""))) == "", "empty").when(F.col("sources") == 0, "no_source").when(F.col("hit") == 0, "not_in_source").otherwise("")
    return met.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "").drop("hit", "sources")


def most_alike(sets: DataFrame, by: list[str], key: str, tokens: str) -> DataFrame:
    """(by, alike): the largest Jaccard overlap of two different keys' token sets within a group.

    Only keys that share a token meet, at that token; pairs without one have overlap 0."""
    flat = sets.select(*by, key, F.size(F.array_distinct(tokens)).alias("n"), F.explode(F.array_distinct(tokens)).alias("token"))
    a = flat.select(*by, "token", F.col(key).alias("a"), F.col("n").alias("na"))
    b = flat.select(*by, "token", F.col(key).alias("b"), F.col("n").alias("nb"))
    met = a.join(b, [*by, "token"]).where("a < b").groupBy(*by, "a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("common"))
    best = met.groupBy(*by).agg(F.max(F.round(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 6)).alias("alike"))
    return sets.select(*by).distinct().join(best, by, "left").withColumn("alike", F.coalesce("alike", F.lit(0.0)))


def changed_values(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, change): added, removed and changed values of two inspections; equal ones are left out."""
    a, b = before.select(F.col(key), F.col(value).alias("before"), F.lit(True).alias("had")), after.select(F.col(key), F.col(value).alias("after"), F.lit(True).alias("has"))
    change = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return a.join(b, key, "full").withColumn("change", change).where("change IS NOT NULL").select(key, "before", "after", "change")
