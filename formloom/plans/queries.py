"""The queries of the library on the supplied tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.functions.text import collapse, evidence, label_key, masked, matched_labels, ordered_rules
from formloom.operators import relational as R
from formloom.sources.html import html_blocks
from formloom.streaming import events as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Labels ------------------------------------------------------------------------------------------------------------

LINES = "SELECT doc_id, trim(l) AS label FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(trim(l)) BETWEEN 2 AND 60"


def labels(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).select("doc_id", F.trim("l").alias("label"))
    return lines.where(F.length("label").between(2, 60))


@query(f"SELECT label, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM ({LINES}) GROUP BY label")
def label_frequency(spark, d):
    return labels(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("doc_id").alias("documents"))


@query(f"""SELECT label, count(*) AS occurrences, count(DISTINCT doc_id) AS documents,
  round(least(1.0, log10(count(*) + 1) / 4 + log10(count(DISTINCT doc_id) + 1) / 4), 4) AS score
  FROM ({LINES}) GROUP BY label HAVING count(*) >= 5 AND count(DISTINCT doc_id) >= 3""")
def promotion_candidates(spark, d):
    counted = label_frequency(spark, d).where("occurrences >= 5 AND documents >= 3")
    return counted.withColumn("score", evidence(F.col("occurrences"), F.col("documents")))


@query(f"""WITH c AS (SELECT label, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM ({LINES}) GROUP BY label HAVING count(*) >= 2),
  s AS (SELECT *, round(least(1.0, log10(occurrences + 1) / 4 + log10(documents + 1) / 4), 4) AS score FROM c)
  SELECT label, CASE WHEN regexp_matches(label, '^[0-9]+$') THEN 'NOT_A_LABEL' WHEN documents < 2 THEN 'ONE_DOCUMENT' WHEN occurrences < 3 OR score < 0.3 THEN 'LOW_EVIDENCE' WHEN length(label) > 50 THEN 'NEEDS_REVIEW' ELSE 'ALLOWED' END AS gate FROM s""")
def gate_ladder(spark, d):
    counted = label_frequency(spark, d).where("occurrences >= 2")
    scored = counted.withColumn("score", evidence(F.col("occurrences"), F.col("documents")))
    gate = ordered_rules([(F.col("label").rlike("^[0-9]+$"), "NOT_A_LABEL"), (F.col("documents") < 2, "ONE_DOCUMENT"), ((F.col("occurrences") < 3) | (F.col("score") < 0.3), "LOW_EVIDENCE"), (F.length("label") > 50, "NEEDS_REVIEW")], "ALLOWED")
    return scored.select("label", gate.alias("gate"))


@query("""WITH v AS (SELECT doc_id, 'a' AS version, CASE WHEN n_chars < 1500 THEN 'short' ELSE 'long' END AS kind FROM documents
  UNION ALL SELECT doc_id, 'b', CASE WHEN length(text) - length(replace(text, chr(10), '')) < 8 THEN 'short' ELSE 'long' END FROM documents)
  SELECT x.doc_id, x.version AS version_a, x.kind AS value_a, y.version AS version_b, y.kind AS value_b FROM v x JOIN v y ON x.doc_id = y.doc_id AND x.version < y.version AND x.kind <> y.kind""")
def classification_disagreements(spark, d):
    docs = t(spark, d, "documents")
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    kinds = [docs.select("doc_id", F.lit(v).alias("version"), F.when(short, "short").otherwise("long").alias("kind")) for v, short in (("a", F.col("n_chars") < 1500), ("b", breaks < 8))]
    return R.disagreements(kinds[0].unionByName(kinds[1]), "doc_id", "version", "kind")


@query("""WITH v AS (SELECT DISTINCT lang FROM documents), e AS (SELECT lang, source FROM documents GROUP BY lang, source HAVING count(*) >= 5)
  SELECT v.lang, count(e.source) AS entries FROM v LEFT JOIN e ON v.lang = e.lang GROUP BY v.lang""")
def dictionary_version_summary(spark, d):
    docs = t(spark, d, "documents")
    entries = docs.groupBy("lang", "source").count().where("count >= 5").select("lang", "source")
    return docs.select("lang").distinct().join(entries, "lang", "left").groupBy("lang").agg(F.count("source").alias("entries"))


@query("""WITH e AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source), a AS (SELECT * FROM e WHERE lang = 'en'), b AS (SELECT * FROM e WHERE lang = 'fr')
  SELECT coalesce(a.source, b.source) AS entry, CASE WHEN b.source IS NULL THEN 'removed' WHEN a.source IS NULL THEN 'added' WHEN a.n <> b.n THEN 'changed' ELSE 'same' END AS status FROM a FULL JOIN b ON a.source = b.source""")
def dictionary_compare(spark, d):
    counts = t(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    a, b = (counts.where(F.col("lang") == lang).select(F.col("source").alias(f"s{k}"), F.col("n").alias(f"n{k}")) for k, lang in (("a", "en"), ("b", "fr")))
    status = ordered_rules([(F.col("sb").isNull(), "removed"), (F.col("sa").isNull(), "added"), (F.col("na") != F.col("nb"), "changed")], "same")
    return a.join(b, F.col("sa") == F.col("sb"), "full").select(F.coalesce("sa", "sb").alias("entry"), status.alias("status"))


@query("SELECT lang, count(*) AS n, sum(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END)::BIGINT AS agreed, round(avg(CASE WHEN (n_chars >= 500) = (l.quality = 1) THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM documents d JOIN labels l USING (doc_id) GROUP BY lang")
def inter_rater_agreement(spark, d):
    both = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    same = ((F.col("n_chars") >= 500) == (F.col("quality") == 1)).cast("double")
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("quality") == 1).cast("long")).alias("agreed"), F.round(F.avg(same), 6).alias("agreement"))


@query("""WITH k AS (SELECT doc_id, sha256(text) AS digest FROM documents)
  SELECT digest, count(*) AS copies, min(doc_id) AS first_id FROM k GROUP BY digest HAVING count(*) > 1""")
def duplicate_groups(spark, d):
    keyed = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query(r"""SELECT doc_id, lower(regexp_replace(source, '[^a-zA-Z0-9]+', '', 'g')) AS source_key, length(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+', '<email>', 'g'), '[0-9]{3,}', '<number>', 'g')) AS masked_chars FROM documents""")
def pii_redact(spark, d):
    return t(spark, d, "documents").select("doc_id", label_key(F.col("source")).alias("source_key"), F.length(masked(F.col("text"))).cast("long").alias("masked_chars"))


@query("""SELECT doc_id, CASE WHEN contains(text, 'License') OR contains(text, 'licensed') THEN 'notice' WHEN contains(text, ' | ') THEN 'table' WHEN n_chars < 300 THEN 'short' WHEN n_chars > 6000 THEN 'long' ELSE 'body' END AS kind FROM documents""")
def content_classify(spark, d):
    text, n = F.col("text"), F.col("n_chars")
    kind = ordered_rules([(F.contains(text, F.lit("License")) | F.contains(text, F.lit("licensed")), "notice"), (F.contains(text, F.lit(" | ")), "table"), (n < 300, "short"), (n > 6000, "long")], "body")
    return t(spark, d, "documents").select("doc_id", kind.alias("kind"))


# Catalogue ---------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_name ILIKE '%red%' AND p_size >= 10 ORDER BY (p_type = 'ECONOMY') DESC, p_retailprice DESC, p_partkey LIMIT 50")
def catalog_search(spark, d):
    """The first 50 hits: the limit is the feature."""
    hits = t(spark, d, "part").where(F.col("p_name").ilike("%red%") & (F.col("p_size") >= 10))
    return hits.orderBy((F.col("p_type") == "ECONOMY").desc(), F.col("p_retailprice").desc(), "p_partkey").limit(50).select("p_partkey", "p_name", "p_brand", "p_type")


@query("SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS types FROM part GROUP BY p_brand")
def facet_counts(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_type").alias("types"))


@query("""WITH d AS (SELECT p_partkey, unnest(list_filter([CASE WHEN contains(p_name, 'red') OR contains(p_name, 'blue') THEN 'colour' END, CASE WHEN contains(p_name, 'small') OR contains(p_name, 'large') THEN 'size' END], lambda x: x IS NOT NULL)) AS domain FROM part)
  SELECT domain, count(*) AS n FROM d GROUP BY domain""")
def category_counts(spark, d):
    domains = matched_labels(F.col("p_name"), {"colour": ["red", "blue"], "size": ["small", "large"]})
    return t(spark, d, "part").select(F.explode(domains).alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS parts, count(DISTINCT p_brand) AS brands, sum(CASE WHEN p_size >= 25 THEN 1 ELSE 0 END)::BIGINT AS large, round(avg(p_retailprice), 4) AS mean_price FROM part")
def catalog_stats(spark, d):
    return t(spark, d, "part").agg(F.count(F.lit(1)).alias("parts"), F.countDistinct("p_brand").alias("brands"), F.sum((F.col("p_size") >= 25).cast("long")).alias("large"), F.round(F.avg("p_retailprice"), 4).alias("mean_price"))


TOKENS = "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part"


def tokens(spark, d):
    return t(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("token"))


@query(f"""WITH k AS (SELECT DISTINCT p_partkey, token FROM ({TOKENS})), g AS (SELECT p_partkey, count(*) AS n, count(*) FILTER (WHERE token IN ('red', 'widget')) AS common FROM k GROUP BY p_partkey)
  SELECT p_partkey, common, round(common / (n + 2 - common), 6) AS jaccard FROM g WHERE common > 0 AND round(common / (n + 2 - common), 6) >= 0.3""")
def jaccard_match(spark, d):
    return R.set_overlap(t(spark, d, "part"), "p_partkey", F.split("p_name", " "), ["red", "widget"], 0.3)


@query(f"""SELECT p_partkey, round(sum(CASE WHEN token = 'red' THEN 1.0 WHEN contains(token, 'red') THEN 0.4 ELSE 0 END + CASE WHEN token = 'ring' THEN 1.0 WHEN contains(token, 'ring') THEN 0.4 ELSE 0 END) / 2, 4)::DOUBLE AS score FROM (SELECT DISTINCT p_partkey, token FROM ({TOKENS})) GROUP BY p_partkey
  HAVING sum(CASE WHEN contains(token, 'red') OR contains(token, 'ring') THEN 1 ELSE 0 END) > 0""")
def inverted_index_search(spark, d):
    """Token search, scored in the row that holds the tokens: nothing is shuffled."""
    asked = ["red", "ring"]
    part = lambda token: sum((F.when(token == q, 1.0).when(F.contains(token, F.lit(q)), 0.4).otherwise(0.0) for q in asked), F.lit(0.0))
    score = F.aggregate(F.array_distinct(F.split("p_name", " ")), F.lit(0.0), lambda a, token: a + part(token))
    return t(spark, d, "part").select("p_partkey", F.round(score / len(asked), 4).alias("score")).where("score > 0")


@query("""SELECT c_custkey, coalesce(o.n, 0) AS orders, n_name, CASE WHEN o.n IS NULL THEN 'registered' WHEN o.open > 0 THEN 'active' ELSE 'settled' END AS stage
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS open FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def pipeline_index(spark, d):
    counted = t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("o_orderstatus") == "O").cast("int")).alias("open"))
    joined = t(spark, d, "customer").join(counted, F.col("o_custkey") == F.col("c_custkey"), "left").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    stage = ordered_rules([(F.col("n").isNull(), "registered"), (F.col("open") > 0, "active")], "settled")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), "n_name", stage.alias("stage"))


@query("""SELECT p_type, min(p_retailprice) AS low, max(p_retailprice) AS high, arg_min(p_partkey, p_retailprice * 1000000 + p_partkey) AS cheapest FROM part GROUP BY p_type""")
def price_summary(spark, d):
    return t(spark, d, "part").groupBy("p_type").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"), F.min_by("p_partkey", F.col("p_retailprice") * 1000000 + F.col("p_partkey")).alias("cheapest"))


# Incremental -------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 1 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def resume_worklist(spark, d):
    done = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.work_list(t(spark, d, "orders"), done, "o_orderkey", 1, 4).select("o_orderkey")


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'Brand#new' ELSE p_brand END AS p_brand, CASE WHEN p_size > 40 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice FROM part""")
def staging_promote(spark, d):
    part = t(spark, d, "part")
    staged = part.where("p_size > 40").select("p_partkey", F.lit("Brand#new").alias("p_brand"), (F.col("p_retailprice") + 1).alias("p_retailprice"))
    return R.promoted(part, staged, "p_partkey", ["p_brand", "p_retailprice"]).select("p_partkey", "p_brand", "p_retailprice")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def upsert_latest(spark, d):
    base = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(1).alias("version"))
    changes = base.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(2).alias("version"))
    return R.latest_wins(base, changes, ["o_orderkey"], "version").select("o_orderkey", "o_orderstatus")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'N' FROM orders WHERE o_orderkey % 3 = 0""")
def insert_ignore(spark, d):
    orders = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return R.insert_ignore(orders.where("o_orderkey % 3 <> 0"), orders.withColumn("o_orderstatus", F.lit("N")), ["o_orderkey"])


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT l_orderkey, 0, sum(l_quantity) FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY l_orderkey""")
def replace_children(spark, d):
    items = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = items.where("l_orderkey % 5 = 0").groupBy("l_orderkey").agg(F.lit(0).alias("l_linenumber"), F.sum("l_quantity").alias("l_quantity"))
    return R.replace_children(items, new, "l_orderkey")


# Order inside groups -----------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, lag(role) OVER w AS previous_role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)")
def neighbor_turns(spark, d):
    return R.neighbours(t(spark, d, "conversations"), ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], "role", "previous_role", "next_role").select("conv_id", "turn", "previous_role", "next_role")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM events")
def asof_previous_header(spark, d):
    return R.as_of(t(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "signup", F.col("event_id"), "header").select("event_id", "header")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM events")
def forward_fill(spark, d):
    return R.as_of(t(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "purchase", F.col("value"), "filled").select("event_id", "filled")


@query("""WITH p AS (SELECT DISTINCT user_id, date_diff('day', DATE '1970-01-01', ts::DATE) AS day FROM events), r AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS run FROM p)
  SELECT user_id, min(day)::INT AS first, max(day)::INT AS last, count(*) AS n FROM r GROUP BY user_id, run""")
def gaps_islands(spark, d):
    days = t(spark, d, "events").select("user_id", F.unix_date(F.to_date("ts")).alias("day"))
    return R.islands(days, ["user_id"], "day")


@query("""WITH m AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events),
  r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
  SELECT user_id, event_type, count(*) AS n FROM r GROUP BY user_id, run, event_type HAVING count(*) > 1""")
def equal_runs(spark, d):
    found = R.runs(t(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type")
    return found.where("n > 1").select("user_id", "event_type", "n")


@query("""SELECT l_orderkey, l_linenumber, coalesce(max(l_shipdate + INTERVAL 5 DAY) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= l_shipdate, false) AS overlaps FROM lineitem""")
def interval_overlap(spark, d):
    items = t(spark, d, "lineitem").withColumn("until", F.col("l_shipdate") + F.expr("INTERVAL 5 DAYS"))
    order = [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")]
    return R.overlapping(items, ["l_orderkey"], order, "l_shipdate", "until").select("l_orderkey", "l_linenumber", "overlaps")


@query("""SELECT c_nationkey, c_custkey, place FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 3""")
def top_per_group(spark, d):
    return R.top_rows(t(spark, d, "customer"), ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "place")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, 'flag' AS slot, 1 AS rank FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_linenumber, 'status', 2 FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT l_orderkey, l_linenumber, 'large', 3 FROM lineitem WHERE l_quantity > 30)
  SELECT l_orderkey, l_linenumber, arg_min(slot, rank) AS slot FROM s GROUP BY l_orderkey, l_linenumber""")
def slot_priority_dedupe(spark, d):
    items = t(spark, d, "lineitem")
    found = [items.where(rule).select("l_orderkey", "l_linenumber", F.lit(name).alias("slot"), F.lit(rank).alias("rank")) for rank, (name, rule) in enumerate([("flag", "l_returnflag = 'R'"), ("status", "l_linestatus = 'O'"), ("large", "l_quantity > 30")])]
    slots = found[0].unionByName(found[1]).unionByName(found[2])
    return R.first_of_pair(slots, ["l_orderkey", "l_linenumber"], [F.col("rank")]).drop("rank")


# Reports -----------------------------------------------------------------------------------------------------------


@query("""SELECT event_type, CASE WHEN value >= 50 THEN 'CRITICAL' WHEN value >= 20 THEN 'HIGH' ELSE 'LOW' END AS severity, count(*) AS n FROM events GROUP BY ALL""")
def severity_backlog(spark, d):
    severity = F.when(F.col("value") >= 50, "CRITICAL").when(F.col("value") >= 20, "HIGH").otherwise("LOW")
    return t(spark, d, "events").groupBy("event_type", severity.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n, sum(CASE WHEN value > 10 THEN 1 ELSE 0 END)::BIGINT AS reusable, round(avg(value), 4) AS mean_value FROM events GROUP BY event_type")
def signal_summary(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") > 10).cast("long")).alias("reusable"), F.round(F.avg("value"), 4).alias("mean_value"))


@query("""SELECT year(l_shipdate) AS year, month(l_shipdate) AS month, count(*) AS facts, count(DISTINCT l_partkey) AS items, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS discounted, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY ALL""")
def price_quality_report(spark, d):
    by = t(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))
    return by.agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("l_partkey").alias("items"), F.sum((F.col("l_discount") > 0.05).cast("long")).alias("discounted"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))


@query("""SELECT year(o_orderdate) AS year, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY ALL""")
def calendar_matrix(spark, d):
    wide = t(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.fillna(0, ["F", "O", "P"])


@query("""WITH u AS (SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS units FROM events WHERE event_type = 'purchase' GROUP BY ALL)
  SELECT user_id, month, units, CASE user_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 20 WHEN 2 THEN 50 END AS quota, coalesce(units > CASE user_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 20 WHEN 2 THEN 50 END, false) AS over_quota FROM u""")
def metering_quota(spark, d):
    quota = F.when(F.col("user_id") % 4 == 0, 5).when(F.col("user_id") % 4 == 1, 20).when(F.col("user_id") % 4 == 2, 50)
    return S.metered(t(spark, d, "events")).withColumn("quota", quota).withColumn("over_quota", F.coalesce(F.col("units") > F.col("quota"), F.lit(False)))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, d):
    return t(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""WITH f AS (SELECT role, count(*) AS cells, count(DISTINCT conv_id) AS files FROM conversations GROUP BY role), n AS (SELECT count(DISTINCT conv_id) AS all_files FROM conversations)
  SELECT role, cells, files, round(files / all_files, 6) AS ratio, files / all_files >= 0.5 AS required FROM f, n""")
def form_field_catalog(spark, d):
    turns = t(spark, d, "conversations")
    files = turns.agg(F.countDistinct("conv_id").alias("all_files")).withColumn("one", F.lit(1))  # one row
    fields = turns.groupBy("role").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("conv_id").alias("files"))
    ratio = F.col("files") / F.col("all_files")
    return fields.withColumn("one", F.lit(1)).join(F.broadcast(files), "one").select("role", "cells", "files", F.round(ratio, 6).alias("ratio"), (ratio >= 0.5).alias("required"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y.%m.%d') AS day, CAST(round(o_totalprice) AS BIGINT) AS won, upper(trim(regexp_replace(o_orderpriority, '[0-9]-', ''))) AS priority FROM orders""")
def format_normalize(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy.MM.dd").alias("day"), F.round("o_totalprice").cast("long").alias("won"), F.upper(collapse(F.regexp_replace("o_orderpriority", "[0-9]-", ""))).alias("priority"))


@query("""SELECT o_orderkey, count(l_orderkey) AS items, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 0)::BIGINT AS returned, CASE WHEN count(l_orderkey) = 0 THEN 'MISSING' WHEN max(l_returnflag) = 'R' THEN 'REVIEW' ELSE 'AUTO' END AS status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def fill_plan(spark, d):
    joined = t(spark, d, "orders").select("o_orderkey").join(t(spark, d, "lineitem").select("l_orderkey", "l_returnflag"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    counted = joined.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("items"), F.coalesce(F.sum((F.col("l_returnflag") == "R").cast("long")), F.lit(0)).alias("returned"), F.max("l_returnflag").alias("flag"))
    return counted.select("o_orderkey", "items", "returned", ordered_rules([(F.col("items") == 0, "MISSING"), (F.col("flag") == "R", "REVIEW")], "AUTO").alias("status"))


@query("""SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def missing_material(spark, d):
    return t(spark, d, "orders").select("o_orderkey").join(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("""WITH a AS (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark), b AS (SELECT unnest(string_split(text, ' ')) AS w FROM documents), ca AS (SELECT w, count(*) AS n FROM a GROUP BY w), cb AS (SELECT w, count(*) AS n FROM b GROUP BY w)
  SELECT ca.w AS word, greatest(0, ca.n - coalesce(cb.n, 0)) AS missing FROM ca LEFT JOIN cb ON ca.w = cb.w WHERE ca.n > coalesce(cb.n, 0)""")
def multiset_difference(spark, d):
    """Only words that the smaller side has are counted on the larger one."""
    words = lambda x: t(spark, d, x).select(F.explode(F.split("text", " ")).alias("word"))
    a = words("benchmark").groupBy("word").agg(F.count(F.lit(1)).alias("na"))
    b = words("documents").join(a.select("word"), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("nb"))
    missing = F.col("na") - F.coalesce("nb", F.lit(0))
    return a.join(b, "word", "left").select("word", missing.alias("missing")).where("missing > 0")


@query()
def html_page_blocks(spark, d):
    return html_blocks(t(spark, d, "pages"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_watch_replay(spark, d):
    """A stream over the event files, replayed to its end."""
    return S.replayed(spark, d, "events.parquet", S.windowed_counts).select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS units FROM events WHERE event_type = 'purchase' GROUP BY ALL")
def stream_metering(spark, d):
    return S.replayed(spark, d, "events.parquet", S.metered)
