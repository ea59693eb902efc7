"""Queries on state that is kept: a quota gate over a stream, a table merged by touched buckets, tables of a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.plans.queries import LINES, labels, query, t
from formloom.session import shared_folder
from formloom.sinks import buckets as K
from formloom.sinks import catalog as C
from formloom.sinks import survey as V
from formloom.streaming import quota as Q

PLANS = "CASE user_id % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' WHEN 2 THEN 'enterprise' ELSE 'other' END"


def calls_in_files(spark: SparkSession, d: str, folder: str) -> list[DataFrame]:
    """All calls in three parts of equal time, and the schema that a stream of their files has."""
    events = t(spark, d, "events").select(F.col("user_id").cast("string").alias("account"), F.expr(PLANS).alias("plan"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    first, last = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.least(F.lit(2), F.floor((F.unix_micros("ts") - F.lit(first or 0)) * 3 / F.lit(max(1, (last or 0) - (first or 0)))))
    return [events.where(part == i) for i in range(3)]


@query(f"""WITH e AS (SELECT user_id::VARCHAR AS account, strftime(ts, '%Y-%m') AS period, event_id, {PLANS} AS plan, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) - 1 AS n FROM events),
  q AS (SELECT *, CASE plan WHEN 'pro' THEN 100 WHEN 'enterprise' THEN NULL ELSE 10 END AS quota FROM e)
  SELECT account, period, event_id, CASE WHEN quota IS NULL OR n < quota THEN 'CHARGED' ELSE 'BLOCKED' END AS verdict, coalesce(least(n, quota), n) AS used, quota FROM q""")
def quota_gate(spark, d):
    """Every call of an account and month judged as it comes: two files, then, after a restart, a third."""
    out = shared_folder(spark)
    first, *more = calls_in_files(spark, d, out)
    first.write.parquet(f"{out}/calls")
    for n, part in enumerate(more):
        part.write.mode("append").parquet(f"{out}/calls")
        calls = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1000).parquet(f"{out}/calls")
        verdicts = Q.run_gate(spark, calls, out)  # the second run begins from what the first one kept
    return verdicts.select("account", "period", "event_id", "verdict", "used", "quota")


CHANGED = "o_orderkey % 97 < 3"


@query(f"""SELECT o_orderkey, o_custkey, CASE WHEN {CHANGED} THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN {CHANGED} THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, CASE WHEN {CHANGED} THEN 2 ELSE 1 END AS version FROM orders
  UNION ALL SELECT -1 - o_orderkey, o_custkey, 'N', o_totalprice, 2 FROM orders WHERE {CHANGED}""")
def bucketed_merge(spark, d):
    """All orders, then changes and new orders merged into the buckets that they touch, then late ones that change nothing."""
    path = f"{shared_folder(spark)}/orders"
    base = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.lit(1).alias("version"))
    changed = base.where(CHANGED)
    K.merge_touched(spark, path, base, ["o_orderkey"], "version")
    K.merge_touched(spark, path, changed.withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") * 2, "version": F.lit(2)}), ["o_orderkey"], "version")
    K.merge_touched(spark, path, changed.withColumns({"o_orderkey": -1 - F.col("o_orderkey"), "o_orderstatus": F.lit("N"), "version": F.lit(2)}), ["o_orderkey"], "version")
    K.merge_touched(spark, path, changed, ["o_orderkey"], "version")
    K.clean_versions(spark, path, 1)
    return K.read_version(spark, path)


def catalog(spark: SparkSession, d: str) -> str:
    """A new catalog with the labels of all documents, and decisions on some of them."""
    db = f"formloom_{shared_folder(spark).rsplit('/', 1)[-1]}"
    C.migrate(spark, db, shared_folder(spark), 8)
    lines = labels(spark, d)
    C.put(spark, db, "label_occurrences", lines.select(F.col("doc_id").cast("string").alias("document_id"), F.col("label").alias("normalized_label")))
    decided = lines.where("length(label) < 12").select(F.col("label").alias("normalized_label")).distinct()
    status = F.when(F.length("normalized_label") % 2 == 0, "APPROVED").otherwise("HELD")
    C.put(spark, db, "human_label_decisions", decided.select("normalized_label", F.lit("FREE_TEXT").alias("semantic_type"), status.alias("decision_status")))
    return db


@query(f"SELECT label AS normalized_label, count(*) AS occurrence_count, count(DISTINCT doc_id) AS document_count FROM ({LINES}) GROUP BY label")
def catalog_label_view(spark, d):
    """The catalog's view of labels by frequency, over labels that were put into its table."""
    return spark.table(f"{catalog(spark, d)}.labels_by_frequency")


@query(f"SELECT label AS normalized_label, CASE WHEN length(label) % 2 = 0 THEN 'APPROVED' ELSE 'HELD' END AS decision_status, count(*) AS occurrences FROM ({LINES}) WHERE length(label) < 12 GROUP BY label")
def catalog_bucketed_join(spark, d):
    """Occurrences of labels with decisions, joined bucket by bucket without an exchange."""
    db = catalog(spark, d)
    found = spark.table(f"{db}.label_occurrences").join(spark.table(f"{db}.human_label_decisions").hint("merge"), "normalized_label")
    return found.groupBy("normalized_label", "decision_status").agg(F.count(F.lit(1)).alias("occurrences"))


def surveyed(spark: SparkSession, d: str) -> tuple[dict, DataFrame]:
    """What a survey of all order lines, as cells of tables, observed, and its outputs' own counts read back."""
    lines = t(spark, d, "lineitem")
    outputs = {
        "headers": V.Output(F.col("l_linenumber") == 1, {"tbl": F.col("l_orderkey"), "label": F.col("l_returnflag")}),
        "inputs": V.Output(F.col("l_quantity") < 10, {"tbl": F.col("l_orderkey"), "row": F.col("l_linenumber"), "value": F.col("l_quantity")}),
        "issues": V.Output(F.col("l_discount") > 0.09, {"tbl": F.col("l_orderkey"), "reason": F.lit("discount")}),
        "none": V.Output(F.col("l_quantity") < 0, {"tbl": F.col("l_orderkey")}),
    }
    path = f"{shared_folder(spark)}/survey"
    found = V.survey(lines, outputs, path, {"quantity": F.sum("l_quantity"), "last": F.max("l_orderkey")})
    back = [V.output_of(spark, path, lines, name, o).agg(F.lit(name).alias("output"), F.count(F.lit(1)).alias("n"), F.sum("tbl").alias("tables")) for name, o in outputs.items()]
    out = back[0]
    for more in back[1:]:
        out = out.unionByName(more)
    return found, out


@query("""WITH o AS (SELECT 'headers' AS output, l_orderkey FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT 'inputs', l_orderkey FROM lineitem WHERE l_quantity < 10 UNION ALL SELECT 'issues', l_orderkey FROM lineitem WHERE l_discount > 0.09::DOUBLE)
  SELECT k.output, count(l_orderkey) AS n, sum(l_orderkey)::BIGINT AS tables, count(l_orderkey) AS observed, (SELECT count(*) FROM lineitem) AS input_rows FROM (VALUES ('headers'), ('inputs'), ('issues'), ('none')) k(output) LEFT JOIN o ON o.output = k.output GROUP BY k.output""")
def survey_outputs(spark, d):
    """Outputs of one survey as they stand in files, beside what the job observed while it wrote them."""
    found, out = surveyed(spark, d)
    observed = F.create_map(*(F.lit(x) for n in ("headers", "inputs", "issues", "none") for x in (n, found[n])))
    return out.withColumn("observed", F.element_at(observed, F.col("output")).cast("long")).withColumn("input_rows", F.lit(found["rows"]).cast("long"))
