"""Operators that bring values to the fields of forms: aliases, candidates, templates, source lines, review items, commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions.values import label_and_value


def by_alias(targets: DataFrame, fields: DataFrame, key: Column, aliases: str) -> DataFrame:
    """(target, field, via): fields whose label key is one of a target's aliases; via is the alias' place in the list.

    targets: (target, aliases array<string>); fields: (field, label). Equal keys are joined; no pair is tried in vain."""
    wanted = targets.select("target", F.posexplode(aliases).alias("via", "alias")).withColumn("label", F.col("alias"))
    wanted = wanted.select("target", "via", key.alias("alias_key")).distinct()
    found = fields.select("field", key.alias("alias_key"))
    return wanted.join(found, "alias_key").groupBy("target", "field").agg(F.min("via").alias("via"))


def merged_candidates(direct: DataFrame, alias: DataFrame) -> DataFrame:
    """(target, field, via): direct candidates first, at via -1, then those by alias; a field counts once for a target."""
    both = direct.select("target", "field", F.lit(-1).alias("via")).unionByName(alias.select("target", "field", "via"))
    return both.groupBy("target", "field").agg(F.min("via").alias("via"))


def one_candidate(candidates: DataFrame) -> DataFrame:
    """(target, field, ambiguous): the candidate with the smallest via; ambiguous where several have it."""
    best = candidates.groupBy("target").agg(F.min("via").alias("via"))
    return candidates.join(best, ["target", "via"]).groupBy("target").agg(F.min("field").alias("field"), (F.count(F.lit(1)) > 1).alias("ambiguous"))


def source_values(sources: DataFrame, targets: DataFrame, key: Column) -> DataFrame:
    """(target, value, source, conflict): values of `label: value` lines of source texts whose label is a target's; conflict
    where a target has different values.

    sources: (source, text); targets: (target, label)."""
    lines = sources.select("source", F.explode(F.split("text", "\n")).alias("line")).select("source", label_and_value(F.col("line")).alias("p")).where("p IS NOT NULL AND p.value <> ''")
    said = lines.select("source", F.col("p.label").alias("label"), F.col("p.value").alias("value")).withColumn("k", key)
    met = said.join(targets.withColumn("k", key).select("target", "k"), "k").groupBy("target", "value").agg(F.min("source").alias("source"))
    kinds = met.groupBy("target").agg(F.count(F.lit(1)).alias("values"))
    return met.join(kinds, "target").select("target", "value", "source", (F.col("values") > 1).alias("conflict"))


def template_of(fingerprints: DataFrame, templates: DataFrame) -> DataFrame:
    """fingerprints (form, fingerprint) with the newest template (template, fingerprint, saved) of the same fingerprint."""
    newest = templates.groupBy("fingerprint").agg(F.max_by("template", F.struct("saved", "template")).alias("template"))
    return fingerprints.join(newest, "fingerprint", "left").select("form", "fingerprint", "template")


def template_applied(fields: DataFrame, values: DataFrame, slots: DataFrame) -> DataFrame:
    """(form, field, row, col, value, status): a template's fields at the slots of a form: filled, no_value or no_slot.

    fields: (form, field, label); values: (field, value); slots: (form, label, row, col)."""
    placed = fields.join(slots, ["form", "label"], "left").join(values, "field", "left")
    status = F.when(F.col("row").isNull(), "no_slot").when(F.coalesce("value", F.lit("")) == "", "no_value").otherwise("filled")
    return placed.select("form", "field", "row", "col", "value", status.alias("status"))


def review_items(requirements: DataFrame, matches: DataFrame, missing: DataFrame) -> DataFrame:
    """(requirement, status, evidence): MISSING, CONFLICT, MATCHED or OPEN, with the best evidence."""
    best = matches.groupBy("requirement").agg(F.max_by("evidence", F.struct("confidence", "evidence")).alias("evidence"), F.countDistinct("value").alias("values"))
    gone = missing.select("requirement").distinct().withColumn("is_missing", F.lit(True))
    joined = requirements.join(best, "requirement", "left").join(gone, "requirement", "left")
    status = F.when(F.col("is_missing"), "MISSING").when(F.col("values") > 1, "CONFLICT").when(F.col("values") == 1, "MATCHED").otherwise("OPEN")
    return joined.select("requirement", status.alias("status"), "evidence")


def fill_commands(plan: DataFrame, answers: DataFrame) -> DataFrame:
    """(field, value, origin): what to write where: automatic values, and answers to questions; unanswered ones are left.

    plan: (field, action auto/question/skip, value); answers: (field, answer), the longest of several."""
    said = answers.where("trim(answer) <> ''").groupBy("field").agg(F.max_by("answer", F.struct(F.length("answer"), "answer")).alias("answer"))
    joined = plan.join(said, "field", "left")
    value = F.when(F.col("action") == "auto", F.col("value")).when(F.col("action") == "question", F.col("answer"))
    return joined.select("field", value.alias("value"), F.when(F.col("action") == "auto", "profile").otherwise("answer").alias("origin")).where("value IS NOT NULL")


def proposals_applied(fields: DataFrame, proposals: DataFrame) -> DataFrame:
    """fields (field, value) with proposals put in where nothing stands yet, and whether one was."""
    best = proposals.groupBy("field").agg(F.max_by("proposal", F.struct("confidence", "proposal")).alias("proposal"))
    open_ = F.coalesce(F.trim("value"), F.lit("")) == ""
    joined = fields.join(best, "field", "left")
    return joined.select("field", F.when(open_, F.coalesce("proposal", "value")).otherwise(F.col("value")).alias("value"), (open_ & F.col("proposal").isNotNull()).alias("applied"))


def decision_errors(decisions: DataFrame, batch: DataFrame) -> DataFrame:
    """decisions (item, decision, decided_by) with `errors`: unknown item, unknown decision, nobody named, decided twice."""
    known = batch.select("item").distinct().withColumn("is_known", F.lit(True))
    times = decisions.groupBy("item").agg(F.count(F.lit(1)).alias("times"))
    error = lambda condition, name: F.when(condition, name)
    errors = F.array_compact(F.array(
        error(F.col("is_known").isNull(), "unknown_item"), error(~F.coalesce(F.col("decision"), F.lit("")).isin("APPROVED", "REJECTED", "HELD"), "unknown_decision"),
        error(F.trim(F.coalesce("decided_by", F.lit(""))) == "", "nobody_named"), error(F.col("times") > 1, "decided_twice"),
    ))
    return decisions.join(known, "item", "left").join(times, "item").select("item", "decision", "decided_by", errors.alias("errors"))


def semantic_conflicts(decisions: DataFrame) -> DataFrame:
    """(label, semantics): labels that people approved for more than one semantic type."""
    approved = decisions.where("decision = 'APPROVED'").groupBy("label").agg(F.array_sort(F.collect_set("semantic")).alias("semantics"))
    return approved.where(F.size("semantics") > 1)


def status_counts(rows: DataFrame, status: str, *measures: str) -> DataFrame:
    """(status, n, share, sums): a roll-up of work by its state; rows without one are pending. The total comes from the
    counted states, a handful of rows."""
    state = F.coalesce(F.col(status), F.lit("pending")).alias("status")
    by = rows.groupBy(state).agg(F.count(F.lit(1)).alias("n"), *(F.sum(m).alias(m) for m in measures))
    total = by.agg(F.sum("n").alias("of")).withColumn("one", F.lit(1))
    return by.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("status", "n", F.round(F.col("n") / F.col("of"), 6).alias("share"), *measures)


def kinds_of_documents(occurrences: DataFrame, classes: DataFrame, item: str, document: str, kind: str) -> DataFrame:
    """(item, kind, documents): in how many documents of each kind an item occurs."""
    once = occurrences.select(item, document).distinct()
    return once.join(classes.select(document, kind), document).groupBy(item, kind).agg(F.count(F.lit(1)).alias("documents"))
