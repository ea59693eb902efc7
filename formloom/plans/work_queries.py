"""Queries on running work: signals, roll-ups, chunks, found strings, commands, examples and decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom.functions.values import normalised, tagged
from formloom.operators import grid as G
from formloom.operators import work as W
from formloom.plans.queries import query, t


@query("SELECT event_id, user_id, value FROM events WHERE event_type IN ('click', 'purchase') AND value >= 10")
def reusable_signals(spark, d):
    return t(spark, d, "events").where("event_type IN ('click', 'purchase') AND value >= 10").select("event_id", "user_id", "value")


@query("SELECT user_id, count(*) AS blocked, min(event_id) AS first_id FROM events WHERE event_type = 'error' GROUP BY user_id")
def failed_patterns(spark, d):
    return t(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("blocked"), F.min("event_id").alias("first_id"))


@query("SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_orderkey))[1:3], ',') AS examples FROM lineitem GROUP BY l_partkey")
def example_documents(spark, d):
    """The first three documents of each item."""
    found = W.examples(t(spark, d, "lineitem"), "l_partkey", "l_orderkey", 3)
    return found.select("l_partkey", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


@query("""WITH k AS (SELECT o_orderkey % 3 AS k, o_orderdate FROM orders) SELECT CASE k WHEN 0 THEN 'DATE' WHEN 1 THEN 'YES_NO' ELSE 'TEXT' END AS kind, CASE k WHEN 0 THEN 'NORMALISED' WHEN 1 THEN 'UNPARSED' ELSE 'NORMALISED' END AS status, count(*) AS n FROM k GROUP BY ALL""")
def normalise_status(spark, d):
    """How many values of each kind came to their form."""
    kind = F.when(F.col("o_orderkey") % 3 == 0, "DATE").when(F.col("o_orderkey") % 3 == 1, "YES_NO").otherwise("TEXT")
    rows = t(spark, d, "orders").select(kind.alias("kind"), F.when(kind == "DATE", F.date_format("o_orderdate", "yyyy/M/d")).otherwise(F.col("o_orderpriority")).alias("raw"))
    return rows.select("kind", normalised(F.col("kind"), F.col("raw"))["status"].alias("status")).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(nullif(trim(replace(p_type, 'PROMO', '')), ''), 'none') AS kind, count(*) AS n FROM part GROUP BY kind")
def group_counts(spark, d):
    kind = F.coalesce(F.nullif(F.trim(F.replace("p_type", F.lit("PROMO"), F.lit(""))), F.lit("")), F.lit("none"))
    return t(spark, d, "part").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, round(avg(v), 6) AS mean, min(v) AS least, count(CASE WHEN v < 5 THEN 1 END) AS below FROM (SELECT event_type, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events) GROUP BY event_type")
def coverage_summary(spark, d):
    """Mean, least and number below a bound, leaving out what was not measured."""
    v = F.when(F.col("event_id") % 5 != 0, F.col("value"))
    return t(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("least"), F.count(F.when(v < 5, 1)).alias("below"))


@query("""WITH o AS (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text), k AS (SELECT d.lang, coalesce(l.quality, -1) AS q FROM o JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id))
  SELECT lang, count(*) FILTER (WHERE q = 0) AS bad, count(*) FILTER (WHERE q = 1) AS good, count(*) FILTER (WHERE q = -1) AS unknown FROM k GROUP BY lang""")
def verdict_crosstab(spark, d):
    """Verdicts by kind over texts that count once."""
    once = t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min(F.struct("doc_id", "lang")).alias("first")).select("first.doc_id", "first.lang")
    judged = once.join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    n = lambda c: F.count(F.when(c, 1))
    return judged.groupBy("lang").agg(n(F.col("quality") == 0).alias("bad"), n(F.col("quality") == 1).alias("good"), n(F.col("quality").isNull()).alias("unknown"))


@query("""SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS root, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS extension, count(*) AS files, sum(length(html))::BIGINT AS bytes FROM pages GROUP BY ALL""")
def file_kinds(spark, d):
    return W.file_kinds(t(spark, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"), F.length("html").alias("chars")), "path", "chars")


@query("""SELECT DISTINCT '/r' || p_size AS path FROM part WHERE p_size % 2 = 0 UNION SELECT DISTINCT '/r' || p_size || '/' || p_type FROM part WHERE p_size % 2 = 1""")
def least_roots(spark, d):
    """Roots that lie below no other one."""
    part = t(spark, d, "part")
    whole = part.where("p_size % 2 = 0").select(F.concat(F.lit("/r"), F.col("p_size").cast("string"), F.lit("/")).alias("path"))
    return W.least_roots(whole.unionByName(part.select(F.concat(F.lit("/r"), F.col("p_size").cast("string"), F.lit("/"), "p_type").alias("path"))), "path")


@query("SELECT o_orderkey // 1000 AS chunk, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS n FROM orders GROUP BY chunk")
def work_chunks(spark, d):
    return W.chunks(t(spark, d, "orders"), "o_orderkey", 1000)


@query("""WITH c AS (SELECT strftime(ts, '%Y-%m') AS cycle, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed FROM events GROUP BY cycle)
  SELECT *, sum(n) OVER (ORDER BY cycle)::BIGINT AS total_n, sum(failed) OVER (ORDER BY cycle)::BIGINT AS total_failed FROM c""")
def cycle_report(spark, d):
    """Counts of each cycle with the totals so far."""
    cycles = t(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("cycle")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("failed"))
    return W.running_totals(cycles, "cycle", "n", "failed")


@query("SELECT o_orderkey AS path, o_orderstatus || '!' AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'created' ELSE 'modified' END AS event FROM orders WHERE o_orderkey % 5 < 2")
def changed_files(spark, d):
    """Files that are new, or whose key is another one."""
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("key"))
    now = orders.withColumn("key", F.when(F.col("path") % 5 < 2, F.concat("key", F.lit("!"))).otherwise(F.col("key")))
    return W.changed_files(orders.where("path % 5 <> 0"), now, "path", "key")


@query("""WITH s AS (SELECT doc_id, string_split(text, 'the') AS p FROM documents), n AS (SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM s)
  SELECT doc_id, (i - 1)::INT AS nth, (list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * 3)::INT AS start FROM n""")
def found_strings(spark, d):
    """Every place of a string in every text."""
    return W.found_strings(t(spark, d, "documents"), "doc_id", "text", "the")


@query("SELECT doc_id, ((length(text) - length(replace(text, '. ', ''))) / 2)::INT AS hits, sha256(text) AS before_sha256, sha256(replace(text, '. ', '; ')) AS after_sha256 FROM documents WHERE contains(text, '. ')")
def replace_plan(spark, d):
    return W.replace_plan(t(spark, d, "documents"), "doc_id", "text", ". ", "; ")


@query("""SELECT conv_id, turn, 'X' || substr(text, 2) || '' AS text, 1 AS applied, 1 AS refused FROM (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE length(text) > 0 GROUP BY ALL)""")
def folded_commands(spark, d):
    """Two commands on each text: the first fits, the second expects what no longer stands there."""
    rows = t(spark, d, "conversations").where("length(text) > 0").groupBy("conv_id", "turn").agg(F.min("text").alias("text")).withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    first = rows.select("key", F.lit(1).alias("seq"), F.lit(0).alias("start"), F.lit(1).alias("chars"), F.substring("text", 1, 1).alias("expected"), F.lit("X").alias("insert"))
    second = rows.select("key", F.lit(2).alias("seq"), F.lit(0).alias("start"), F.lit(2).alias("chars"), F.lit("~~").alias("expected"), F.lit("").alias("insert"))
    done = W.folded(rows.select("key", "text"), first.unionByName(second), "key", "text", "seq")
    return done.join(rows.select("key", "conv_id", "turn"), "key").select("conv_id", "turn", "text", "applied", "refused")


@query("""SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'HOLD' WHEN p_size > 40 THEN 'APPROVE' WHEN p_size <= 5 THEN 'REJECT' ELSE 'REVIEW' END AS decision, CASE WHEN p_size <= 5 THEN 'no_schema' WHEN p_type = 'ECONOMY' THEN 'not_fillable' WHEN p_retailprice > 1000 THEN 'candidate' ELSE 'empty' END AS candidacy FROM part""")
def recommended_decisions(spark, d):
    size, kind = F.col("p_size"), F.col("p_type")
    decision = W.recommended(F.when(size > 40, "strong").when(size <= 5, "noise").otherwise("weak"), F.array_compact(F.array(F.when(kind == "PROMO", "conflict"))))
    candidacy = W.candidacy(size > 5, (F.col("p_retailprice") > 1000).cast("int"), F.when(kind == "ECONOMY", "notice").otherwise(kind))
    return t(spark, d, "part").select("p_partkey", decision.alias("decision"), candidacy.alias("candidacy"))


@query("""SELECT action, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus <> 'O' THEN 'HOLD_CONFLICT' WHEN l_quantity < 10 THEN 'SKIP_NO_CELLS' WHEN l_returnflag = 'R' THEN 'OVERWRITE' WHEN l_linestatus = 'O' THEN 'APPLY' ELSE 'REVIEW' END AS action FROM lineitem) GROUP BY action""")
def bar_actions(spark, d):
    action = W.bar_action(F.col("l_returnflag") == "R", F.col("l_quantity") >= 10, F.col("l_linestatus") == "O")
    return t(spark, d, "lineitem").groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, NOT contains(p_name, 'red') AND (contains(p_name, 'ring') OR contains(p_name, 'widget')) AS keep, CASE WHEN contains(p_name, 'red') THEN 'has red' WHEN contains(p_name, 'ring') THEN 'has ring' WHEN contains(p_name, 'widget') THEN 'has widget' ELSE 'nothing wanted' END AS reason FROM part""")
def inclusion_filter(spark, d):
    """Titles kept by words, unwanted ones first, each with its reason."""
    return t(spark, d, "part").select("p_partkey", W.included(F.col("p_name"), ["ring", "widget"], ["red"]).alias("x")).select("p_partkey", "x.keep", "x.reason")


@query("""SELECT tag, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(text, '[0-9]{3}') THEN 'number' WHEN regexp_matches(text, '@') THEN 'mail' WHEN regexp_matches(text, '[|]') THEN 'table' END AS tag FROM documents) GROUP BY tag""")
def pattern_guidance(spark, d):
    """The first pattern that is found in a text."""
    tag = tagged(F.col("text"), [("[0-9]{3}", "number"), ("@", "mail"), ("[|]", "table")])
    return t(spark, d, "documents").groupBy(tag.alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT a.l_orderkey, a.l_linenumber, b.l_quantity AS value, CASE WHEN b.l_quantity > 25 THEN 'filled' ELSE 'open' END AS state FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_returnflag = 'R'""")
def fill_requirements(spark, d):
    """What a label asks for, and the state of the cell on its right."""
    cells = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    found = G.at_offset(cells, ["l_orderkey"], "l_linenumber", 1, "l_quantity", "value").where("l_returnflag = 'R'")
    return found.select("l_orderkey", "l_linenumber", "value", F.when(F.col("value") > 25, "filled").otherwise("open").alias("state"))
