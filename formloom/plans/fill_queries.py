"""Queries that bring values to fields and roll work up by its state, over analogous columns of the tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from formloom.functions.values import label_and_value, search_key
from formloom.operators import fill as L
from formloom.operators import records as R
from formloom.plans.queries import query, t
from formloom.sinks import tables as K
from formloom.streaming import events as S


@query("""WITH c AS (SELECT p_type AS target, p_partkey AS field, CASE WHEN p_name = 'red ring' THEN 0 ELSE 1 END AS via FROM part WHERE lower(replace(p_name, ' ', '')) IN ('redring', 'bluewidget')), b AS (SELECT target, min(via) AS via FROM c GROUP BY target)
  SELECT c.target, min(field) AS field, count(*) > 1 AS ambiguous FROM c JOIN b ON b.target = c.target AND b.via = c.via GROUP BY c.target""")
def alias_candidates(spark, d):
    """Fields by aliases of their targets, direct ones before others, one for each target."""
    part = t(spark, d, "part")
    targets = part.select(F.col("p_type").alias("target")).distinct().withColumn("aliases", F.array(F.lit("RED Ring"), F.lit("blue widget")))
    fields = part.select(F.col("p_partkey").alias("field"), F.col("p_name").alias("label"), F.col("p_type").alias("kind"))
    met = L.by_alias(targets, fields, search_key(F.col("label")), "aliases").join(fields.select("field", "kind"), "field").where("kind = target")
    return L.one_candidate(L.merged_candidates(met.where("1 = 0"), met))


@query("""WITH s AS (SELECT o_custkey AS target, o_orderstatus AS value, min(o_orderkey) AS source FROM orders GROUP BY ALL) SELECT target, value, source, count(*) OVER (PARTITION BY target) > 1 AS conflict FROM s""")
def source_line_values(spark, d):
    """Values of `label: value` lines of texts for the labels that are asked for, with conflicts marked."""
    text = F.concat(F.lit("Note without a value\nCustomer "), F.col("o_custkey").cast("string"), F.lit(" : "), "o_orderstatus", F.lit("\nEmpty:"))
    sources = t(spark, d, "orders").select(F.col("o_orderkey").alias("source"), text.alias("text"))
    targets = t(spark, d, "customer").select(F.col("c_custkey").alias("target"), F.concat(F.lit("customer"), F.col("c_custkey").cast("string")).alias("label"))
    return L.source_values(sources, targets, search_key(F.col("label")))


@query("""WITH m AS (SELECT l_orderkey AS r, max(l_quantity * 1000 + l_linenumber) AS best, count(DISTINCT l_returnflag) AS v FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey)
  SELECT o_orderkey AS requirement, CASE WHEN o_orderstatus = 'P' THEN 'MISSING' WHEN v > 1 THEN 'CONFLICT' WHEN v = 1 THEN 'MATCHED' ELSE 'OPEN' END AS status, best AS evidence FROM orders LEFT JOIN m ON r = o_orderkey""")
def review_item_states(spark, d):
    orders, lines = t(spark, d, "orders"), t(spark, d, "lineitem").where("l_returnflag <> 'N'")
    rank = F.col("l_quantity") * 1000 + F.col("l_linenumber")
    matches = lines.select(F.col("l_orderkey").alias("requirement"), rank.alias("evidence"), rank.alias("confidence"), F.col("l_returnflag").alias("value"))
    return L.review_items(orders.select(F.col("o_orderkey").alias("requirement")), matches, orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("requirement")))


@query("""SELECT c_custkey AS field, CASE c_custkey % 3 WHEN 0 THEN c_name ELSE a.answer END AS value, CASE c_custkey % 3 WHEN 0 THEN 'profile' ELSE 'answer' END AS origin FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS answer FROM (SELECT o_custkey, o_orderpriority, max(length(o_orderpriority)) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE length(o_orderpriority) = m GROUP BY o_custkey) a ON o_custkey = c_custkey
  WHERE c_custkey % 3 = 0 OR (c_custkey % 3 = 1 AND a.answer IS NOT NULL)""")
def fill_commands(spark, d):
    """What to write: values that are known, and the longest answer to what had to be asked."""
    action = F.when(F.col("c_custkey") % 3 == 0, "auto").when(F.col("c_custkey") % 3 == 1, "question").otherwise("skip")
    plan = t(spark, d, "customer").select(F.col("c_custkey").alias("field"), action.alias("action"), F.col("c_name").alias("value"))
    return L.fill_commands(plan, t(spark, d, "orders").select(F.col("o_custkey").alias("field"), F.col("o_orderpriority").alias("answer")))


@query("""WITH p AS (SELECT l_orderkey, arg_max(l_returnflag || l_linestatus, l_quantity * 1000 + ascii(l_returnflag) + ascii(l_linestatus) / 1000.0) AS proposal FROM lineitem GROUP BY l_orderkey)
  SELECT o_orderkey AS field, CASE WHEN o_orderstatus = 'P' THEN coalesce(proposal, '') ELSE o_orderstatus END AS value, o_orderstatus = 'P' AND proposal IS NOT NULL AS applied FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""")
def proposals_applied(spark, d):
    """The best proposal goes only where nothing stands yet."""
    fields = t(spark, d, "orders").select(F.col("o_orderkey").alias("field"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("value"))
    return L.proposals_applied(fields, t(spark, d, "lineitem").select(F.col("l_orderkey").alias("field"), F.concat("l_returnflag", "l_linestatus").alias("proposal"), F.col("l_quantity").alias("confidence")))


@query("""SELECT c_custkey AS form, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'none' END AS fingerprint, CASE WHEN c_custkey % 2 = 0 THEN s.template END AS template FROM customer LEFT JOIN (SELECT c_mktsegment AS f, max(c_custkey) AS template FROM customer WHERE c_nationkey < 5 GROUP BY c_mktsegment) s ON s.f = c_mktsegment""")
def template_lookup(spark, d):
    """The newest template of the same fingerprint."""
    rows = t(spark, d, "customer")
    forms = rows.select(F.col("c_custkey").alias("form"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("none").alias("fingerprint"))
    return L.template_of(forms, rows.where("c_nationkey < 5").select(F.col("c_custkey").alias("template"), F.col("c_mktsegment").alias("fingerprint"), F.col("c_custkey").alias("saved")))


@query("""SELECT o_orderkey AS item, o_orderstatus AS decision, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE o_orderpriority END AS decided_by, (CASE WHEN c_custkey IS NULL OR c_nationkey >= 20 THEN 1 ELSE 0 END + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END)::INT AS errors FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def decision_errors(spark, d):
    """Decisions held against the batch they belong to; what is wrong with each."""
    rows = t(spark, d, "orders")
    decisions = rows.select(F.col("o_orderkey").alias("item"), F.when(F.col("o_orderstatus") == "O", "APPROVED").when(F.col("o_orderstatus") == "F", "REJECTED").otherwise("P").alias("decision"), F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise(F.col("o_orderpriority")).alias("decided_by"))
    batch = rows.join(t(spark, d, "customer").where("c_nationkey < 20"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("item"))
    checked = L.decision_errors(decisions, batch)
    said = F.when(F.col("decision") == "APPROVED", "O").when(F.col("decision") == "REJECTED", "F").otherwise("P")
    return checked.select("item", said.alias("decision"), "decided_by", F.size("errors").alias("errors"))


@query("""SELECT p_brand AS label, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS semantics, count(DISTINCT p_type)::INT AS n FROM part WHERE p_size > 45 GROUP BY p_brand HAVING count(DISTINCT p_type) > 1""")
def approved_conflicts(spark, d):
    """Labels that were approved for more than one meaning."""
    rows = t(spark, d, "part").select(F.col("p_brand").alias("label"), F.col("p_type").alias("semantic"), F.when(F.col("p_size") > 45, "APPROVED").otherwise("HELD").alias("decision"))
    return L.semantic_conflicts(rows).select("label", F.array_join("semantics", ",").alias("semantics"), F.size("semantics").alias("n"))


@query("""SELECT coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY ALL""")
def status_rollup(spark, d):
    rows = t(spark, d, "orders").withColumn("state", F.nullif("o_orderstatus", F.lit("P")))
    return L.status_counts(rows, "state", "o_totalprice").withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("""SELECT l_partkey AS item, o_orderstatus AS kind, count(DISTINCT l_orderkey) AS documents FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""")
def kinds_of_documents(spark, d):
    occurrences = t(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("document"))
    return L.kinds_of_documents(occurrences, t(spark, d, "orders").select(F.col("o_orderkey").alias("document"), F.col("o_orderstatus").alias("kind")), "item", "document", "kind")


@query("""WITH k AS (SELECT p_type, p_brand, list_distinct(flatten(list(string_split(p_name, ' ')))) AS w FROM part GROUP BY ALL)
  SELECT a.p_type, coalesce(max(round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6)), 0)::DOUBLE AS alike FROM k a LEFT JOIN k b ON b.p_type = a.p_type AND a.p_brand < b.p_brand GROUP BY a.p_type""")
def most_alike_keys(spark, d):
    """The largest overlap of two brands' words within a type."""
    sets = t(spark, d, "part").select("p_type", "p_brand", F.explode(F.split("p_name", " ")).alias("w")).groupBy("p_type", "p_brand").agg(F.collect_set("w").alias("w"))
    return R.most_alike(sets, ["p_type"], "p_brand", "w")


@query("""SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_mktsegment END AS before, CASE WHEN c_nationkey = 4 THEN NULL WHEN c_nationkey = 5 THEN 'NEW' ELSE c_mktsegment END AS after, CASE c_nationkey WHEN 3 THEN 'added' WHEN 4 THEN 'removed' ELSE 'changed' END AS change FROM customer WHERE c_nationkey IN (3, 4, 5)""")
def inspection_changes(spark, d):
    """Added, removed and changed values of two inspections."""
    rows = t(spark, d, "customer")
    after = rows.where("c_nationkey <> 4").select("c_custkey", F.when(F.col("c_nationkey") == 5, "NEW").otherwise(F.col("c_mktsegment")).alias("seg"))
    return R.changed_values(rows.where("c_nationkey <> 3").select("c_custkey", F.col("c_mktsegment").alias("seg")), after, "c_custkey", "seg")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'HOLD' WHEN event_type = 'signup' THEN 'REJECT' WHEN event_type = 'view' THEN 'REVIEW' WHEN value >= 90 THEN 'AUTO' WHEN value >= 60 THEN 'REVIEW' ELSE 'REJECT' END AS decision,
  CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'signup' THEN 0 WHEN event_type = 'view' THEN 1 WHEN value >= 90 THEN 3 WHEN value >= 60 THEN 2 ELSE 1 END AS tier FROM events""")
def confidence_tiers(spark, d):
    kind = F.col("event_type")
    tier = R.confidence_tier(F.col("value") / 100, F.when(kind == "signup", "NOT_FOUND").when(kind == "view", "AMBIGUOUS").otherwise("RESOLVED"), kind == "error")
    return t(spark, d, "events").select("event_id", tier.alias("x")).select("event_id", "x.decision", "x.tier")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'empty' WHEN l.n IS NULL THEN 'no_source' WHEN l.hit = 0 THEN 'not_in_source' ELSE '' END AS reason FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS hit FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey""")
def sourced_values(spark, d):
    """Proposed values that a source of the same key holds, and why the others are turned away."""
    proposals = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", " ").otherwise("FLAG N").alias("value"))
    source = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("the flag "), "l_returnflag", F.lit(" stands")).alias("said"))
    return R.sourced(proposals, source, ["o_orderkey"], "value", "said").select("o_orderkey", "reason")


@query("""SELECT p_partkey, p_name AS label, p_type AS value FROM part WHERE p_size > 10""")
def label_value_lines(spark, d):
    """`label: value` texts taken apart; what has no colon gives nothing."""
    text = F.when(F.col("p_size") > 10, F.concat("p_name", F.lit(" : "), "p_type")).otherwise(F.col("p_name"))
    return t(spark, d, "part").select("p_partkey", label_and_value(text).alias("x")).where("x IS NOT NULL").select("p_partkey", "x.label", "x.value")


# Sinks and streams: written, read back and compared -----------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN o_orderkey % 10 = 0 THEN 'late' END AS note FROM orders""")
def table_upsert(spark, d):
    """A table kept by key: two generations are written, the second with a column more, and the newest is read."""
    folder = f"{S.stream_folder(spark)}/orders"
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(1).alias("version"))
    K.upsert_table(spark, folder, rows, ["o_orderkey"], "version")
    return K.upsert_table(spark, folder, rows.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(2).alias("version"), F.lit("late").alias("note")), ["o_orderkey"], "version")


@query("""SELECT c_custkey, c_name, 'a,' || c_mktsegment AS tags FROM customer UNION ALL SELECT -c_custkey, c_name, 'a,' || c_mktsegment FROM customer WHERE c_nationkey = 1""")
def jsonl_log(spark, d):
    """JSON lines written, appended to and read back."""
    path = f"{S.stream_folder(spark)}/log"
    rows = t(spark, d, "customer").select("c_custkey", "c_name", F.array(F.lit("a"), "c_mktsegment").alias("tags"))
    K.write_jsonl(rows, path)
    K.append_events(rows.join(t(spark, d, "customer").where("c_nationkey = 1").select("c_custkey"), "c_custkey").withColumn("c_custkey", -F.col("c_custkey")), path, "c_name")
    return spark.read.schema("c_custkey long, c_name string, tags array<string>").json(path).withColumn("tags", F.array_join("tags", ","))


@query("""SELECT p_partkey, p_name || chr(10) || '"x", y' AS text, '["' || p_brand || '",1]' AS nested FROM part""")
def csv_table(spark, d):
    """CSV with quotes, line breaks and nested values, written and read back."""
    path = f"{S.stream_folder(spark)}/csv"
    rows = t(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit('\n"x", y')).alias("text"), F.array(F.col("p_brand"), F.lit("1")).alias("nested"))
    K.write_csv(rows, path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.select(F.col("p_partkey").cast("long").alias("p_partkey"), "text", F.replace("nested", F.lit('"1"'), F.lit("1")).alias("nested"))


@query("""SELECT year(l_shipdate)::INT AS year, l_partkey, count(*) AS n FROM lineitem WHERE year(l_shipdate) = 1995 GROUP BY ALL""")
def partitioned_facts(spark, d):
    """Facts written by year, sorted inside, and read back for one year: only its folder is opened."""
    path = f"{S.stream_folder(spark)}/facts"
    facts = t(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), "l_partkey", "l_quantity")
    K.write_table(facts, path, partition_by=("year",), sort_by=("l_partkey",))
    return spark.read.parquet(path).where("year = 1995").groupBy("year", "l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT substr(sha256(p_brand || ' ' || p_type), 1, 2) AS shard, count(*) AS entries FROM (SELECT DISTINCT p_brand, p_type FROM part WHERE p_type <> 'PROMO') GROUP BY shard""")
def dictionary_snapshot(spark, d):
    """One version of a dictionary: allowed entries alone, snapshot in shards."""
    entries = t(spark, d, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("label"), F.col("p_type").alias("semantic"), F.when(F.col("p_type") != "PROMO", "ALLOWED").otherwise("HELD").alias("gate")).distinct()
    return K.dictionary_snapshot(K.dictionary_version(entries, "v1", "reviewer", "corpus"), "v1").select("shard", "entries")


@query("""WITH f AS (SELECT p_partkey, p_name, min('/in/' || lpad(p_partkey::VARCHAR, 9, '0')) OVER (PARTITION BY p_name) AS first_path FROM part WHERE p_size > 5)
  SELECT '/in/' || lpad(p_partkey::VARCHAR, 9, '0') AS path, CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_size = 1) THEN 'held' WHEN '/in/' || lpad(p_partkey::VARCHAR, 9, '0') = first_path THEN 'copy' ELSE 'duplicate' END AS action FROM f""")
def copy_in_manifest(spark, d):
    """Files to copy in: those whose cleaned name is neither held nor seen before."""
    part = t(spark, d, "part")
    path = F.concat(F.lit("/in/"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    found, held = (part.where(c).select(path.alias("path"), F.concat("p_name", F.lit(" ")).alias("name")) for c in ("p_size > 5", "p_size = 1"))
    return K.copy_in_manifest(found, held, search_key(F.col("name"))).select("path", "action")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase'")
def stream_event_log(spark, d):
    """A stream appended to JSON lines."""
    return S.appended(spark, d, "events.parquet", lambda e: e.where("event_type = 'purchase'").select("event_id", "user_id", "event_type"))


@query("SELECT event_id, event_type FROM events")
def stream_upsert(spark, d):
    """A stream put into a table kept by key."""
    return S.kept_by_key(spark, d, "events.parquet", ["event_id"], "ts").select("event_id", "event_type")
