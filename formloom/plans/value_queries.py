"""Queries that normalise values and dates and tag texts, over columns of the supplied tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom.functions import dates as D
from formloom.functions import values as V
from formloom.plans.queries import query, t


@query("""SELECT c_custkey, '010-' || substr(lpad(c_custkey::VARCHAR, 8, '0'), 1, 4) || '-' || substr(lpad(c_custkey::VARCHAR, 8, '0'), 5, 4) AS phone,
  substr(lpad((c_custkey * 37)::VARCHAR, 10, '0'), 1, 3) || '-' || substr(lpad((c_custkey * 37)::VARCHAR, 10, '0'), 4, 2) || '-' || substr(lpad((c_custkey * 37)::VARCHAR, 10, '0'), 6, 5) AS business,
  CASE c_custkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' END AS agreed, (c_custkey % 90 + 1) * 10000 + 500 AS won FROM customer""")
def value_formats(spark, d):
    """Telephone and business numbers, yes and no, amounts with units, each from a hand-written form."""
    key, padded = F.col("c_custkey"), lambda c, n: F.lpad(c.cast("string"), n, "0")
    rows = t(spark, d, "customer").select("c_custkey", F.concat(F.lit("+82 10-"), padded(key, 8)).alias("p"), F.concat_ws(" ", F.substring(padded(key * 37, 10), 1, 5), F.substring(padded(key * 37, 10), 6, 5)).alias("b"), F.when(key % 3 == 0, " Yes ").when(key % 3 == 1, "아니오").otherwise("maybe").alias("y"), F.concat((key % 90 + 1).cast("string"), F.lit("만 500원")).alias("a"))
    return rows.select("c_custkey", V.phone(F.col("p")).alias("phone"), V.business_number(F.col("b")).alias("business"), V.yes_no(F.col("y")).alias("agreed"), V.amount(F.col("a")).alias("won"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE o_orderkey % 3 WHEN 0 THEN 'month:' || month(o_orderdate) WHEN 1 THEN 'week:' || week(o_orderdate) ELSE 'day:' || day(o_orderdate) END AS mark,
  month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day_of_month, strftime(o_orderdate, '%Y-%m') AS period FROM orders""")
def date_formats(spark, d):
    """Dates in three hand-written forms to one, and their marks on axes of months, weeks and days."""
    at = F.col("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(at, "yyyy년 M월 d일")).when(F.col("o_orderkey") % 3 == 1, F.date_format(at, "yyyy. M. d")).otherwise(F.date_format(at, "yyyyMMdd"))
    unit = F.when(F.col("o_orderkey") % 3 == 0, "month").when(F.col("o_orderkey") % 3 == 1, "week").otherwise("day")
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderdate", unit.alias("unit"), V.day(raw).alias("day"), F.date_format(at, "yyyy년 M월 d일").alias("words"))
    return rows.select("o_orderkey", "day", D.on_axis(F.col("day"), F.col("unit")).alias("mark"), D.month_of(F.col("words")).alias("month"), D.day_of(F.col("words")).alias("day_of_month"), D.period(F.col("o_orderdate")).alias("period"))


@query("""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS s, (o_orderdate::DATE + (o_orderkey % 75)::INT) AS e FROM orders),
  m AS (SELECT o_orderkey, s, e, unnest(generate_series(date_trunc('month', s), date_trunc('month', e), INTERVAL 1 MONTH))::DATE AS month FROM o)
  SELECT month::VARCHAR AS month, count(*) AS items, sum(date_diff('day', greatest(s, month), least(e, last_day(month))) + 1)::BIGINT AS days FROM m GROUP BY month""")
def monthly_calendar(spark, d):
    """Days that spans have in each month: every span meets only its own months."""
    day = F.to_date("o_orderdate")
    spans = t(spark, d, "orders").select(day.alias("s"), F.date_add(day, (F.col("o_orderkey") % 75).cast("int")).alias("e"))
    count = F.floor(F.months_between(F.trunc("e", "month"), F.trunc("s", "month"))).cast("int") + 1
    each = spans.select("s", "e", F.explode(D.month_starts(F.col("s"), count)).alias("month"))
    return each.groupBy("month").agg(F.count(F.lit(1)).alias("items"), F.sum(D.shared_days(F.col("s"), F.col("e"), F.col("month"), D.month_end(F.col("month")))).alias("days")).withColumn("month", F.col("month").cast("string"))


@query("""WITH o AS (SELECT o_orderpriority, o_orderdate::DATE AS s, (o_orderdate::DATE + (o_orderkey % 5)::INT) AS e FROM orders), e AS (SELECT o_orderpriority, unnest(generate_series(s, e, INTERVAL 1 DAY))::DATE AS day FROM o)
  SELECT o_orderpriority, day::VARCHAR AS day, count(*) AS active FROM e WHERE day BETWEEN DATE '1995-03-01' AND DATE '1995-03-31' GROUP BY ALL""")
def daily_calendar(spark, d):
    """How many items of a group are at work on each day of a month."""
    day = F.to_date("o_orderdate")
    spans = t(spark, d, "orders").select("o_orderpriority", day.alias("s"), F.date_add(day, (F.col("o_orderkey") % 5).cast("int")).alias("e")).where("e >= DATE'1995-03-01' AND s <= DATE'1995-03-31'")
    each = spans.select("o_orderpriority", F.explode(F.sequence("s", "e")).alias("day")).where("day BETWEEN DATE'1995-03-01' AND DATE'1995-03-31'")
    return each.groupBy("o_orderpriority", F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("active"))


@query("""SELECT p_partkey, i AS place, [p_brand, p_type, p_name][i::INT] AS item FROM part, (SELECT unnest([1, 2, 3]) AS i)""")
def list_items(spark, d):
    """Items of lists written into one text with numbers and signs before them."""
    text = F.concat(F.lit("1. "), "p_brand", F.lit("\n2) "), "p_type", F.lit("; - "), "p_name")
    return t(spark, d, "part").select("p_partkey", F.posexplode(V.items_of(text)).alias("place", "item")).select("p_partkey", (F.col("place") + 1).alias("place"), "item")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def mojibake_repair(spark, d):
    """Texts whose UTF-8 was read as Latin-1, once or twice over, read as they were meant."""
    wrong = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    text = F.when(F.col("doc_id") % 2 == 0, wrong(F.col("text"))).otherwise(wrong(wrong(F.col("text"))))
    return t(spark, d, "documents").select("doc_id", F.sha2(V.repaired(text), 256).alias("digest"))


@query(r"""SELECT doc_id, sha256(source) AS sha256, substr(regexp_replace(source || ' 0' || doc_id::VARCHAR, '[0-9]', '#', 'g'), 1, 12) AS preview, 'file_' || substr(sha256(source), 1, 12) AS name FROM documents""")
def redacted_previews(spark, d):
    shown = V.preview(F.concat("source", F.lit(" 0"), F.col("doc_id").cast("string")), 12)
    return t(spark, d, "documents").select("doc_id", F.sha2("source", 256).alias("sha256"), shown["preview"].alias("preview"), V.masked_name(F.col("source")).alias("name"))


@query(r"""SELECT lang, count(*) AS n, sum(CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]|[0-9]{6}-?[1-4][0-9]{6}|01[016789]-?[0-9]{3,4}-?[0-9]{4}') THEN 1 ELSE 0 END)::BIGINT AS leaking FROM documents GROUP BY lang""")
def leak_report(spark, d):
    """Documents that hold what should have been masked."""
    return t(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(V.leaks("text").cast("long")).alias("leaking"))


@query("""SELECT p_partkey, replace(p_name, ' ', '') AS stem, p_brand AS bare, replace(p_name, ' ', '') || '|||' || p_type AS key, replace(lower(p_name), ' ', '') AS found_by FROM part""")
def label_forms(spark, d):
    """Labels with numbers behind, brackets inside and marks around them, brought to their stems and keys."""
    stem = V.stem_label(F.concat("p_name", F.lit(" 1/20")))
    bare = V.bare_label(F.concat(F.lit("3) "), "p_brand", F.lit(" (see note) : ")))
    return t(spark, d, "part").select("p_partkey", stem.alias("stem"), bare.alias("bare"), V.composite_key(stem, F.col("p_type")).alias("key"), V.search_key(F.col("p_name")).alias("found_by"))


@query("""SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'offer' WHEN contains(p_name, 'red') OR contains(p_name, 'blue') THEN 'colour' WHEN contains(p_name, 'ring') THEN 'shape' END AS field,
  CASE WHEN p_type IN ('ECONOMY', 'PROMO') OR p_name IN ('red', 'blue', 'ring') THEN 0.95 WHEN contains(p_name, 'red') OR contains(p_name, 'blue') OR contains(p_name, 'ring') THEN 0.75 END::DOUBLE AS confidence FROM part""")
def field_hints(spark, d):
    """A field by hints, whole ones before those inside, earlier fields first."""
    text = F.when(F.col("p_type").isin("ECONOMY", "PROMO"), F.col("p_type")).otherwise(F.col("p_name"))
    hint = V.hinted(text, {"offer": ["ECONOMY", "PROMO"], "colour": ["red", "blue"], "shape": ["ring"]})
    return t(spark, d, "part").select("p_partkey", hint["field"].alias("field"), hint["confidence"].cast("double").alias("confidence"))


@query(r"""WITH f AS (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS breaks, length(text) - length(replace(text, '|', '')) AS bars, n_chars FROM documents),
  s AS (SELECT doc_id, least(1.0, breaks / 20.0)::DOUBLE AS a, least(1.0, bars / 10.0)::DOUBLE AS b, least(1.0, n_chars / 4000.0)::DOUBLE AS c FROM f)
  SELECT doc_id, CASE WHEN greatest(a, b, c) < 0.2 THEN 'unknown' WHEN a >= b AND a >= c THEN 'list' WHEN b >= c THEN 'table' ELSE 'body' END AS kind, round(greatest(a, b, c), 6) AS score,
  greatest(a, b, c) >= 0.2 AND greatest(a, b, c) - list_sort([a, b, c])[2] < 0.1 AS ambiguous FROM s""")
def scored_kinds(spark, d):
    """The kind with the largest of several scores, and whether the second comes near."""
    count = lambda mark: (F.length("text") - F.length(F.replace("text", F.lit(mark), F.lit(""))))
    part = lambda n, of: F.least(F.lit(1.0), n / F.lit(of))
    best = V.best_of({"list": part(count("\n"), 20.0), "table": part(count("|"), 10.0), "body": part(F.col("n_chars"), 4000.0)}, 0.2, "unknown")
    return t(spark, d, "documents").select("doc_id", best.alias("b")).select("doc_id", "b.kind", F.round("b.score", 6).alias("score"), "b.ambiguous")


@query("""SELECT l_partkey, min(l_extendedprice) AS least, max(l_extendedprice) AS most, sum(CASE WHEN l_extendedprice <= 0 THEN 1 ELSE 0 END)::BIGINT AS not_positive, sum(CASE WHEN l_extendedprice > 1000 AND l_extendedprice < 50000 THEN 0 ELSE 1 END)::BIGINT AS outside FROM lineitem GROUP BY l_partkey""")
def price_anomalies(spark, d):
    """Prices written with separators, read within open bounds."""
    rows = t(spark, d, "lineitem").select("l_partkey", "l_extendedprice", V.price(F.format_string("%.2f ", "l_extendedprice"), 1000, 50000).alias("price"))
    return rows.groupBy("l_partkey").agg(F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"), F.sum((F.col("l_extendedprice") <= 0).cast("long")).alias("not_positive"), F.sum(F.col("price").isNull().cast("long")).alias("outside"))


@query(r"""SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CASE WHEN CAST(json_extract(props, '$.k') AS INT) % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, 2::INT AS n FROM events""")
def json_element_tags(spark, d):
    """JSON arrays found inside answers, each element with a field set anew, the first of each key kept."""
    from formloom.operators import records as R

    said = F.concat(F.lit("Here is the list: [{\"key\":\"a\",\"verdict\":\"ok\"}, {\"key\":\"a\",\"verdict\":\"no\"}, {\"key\":\"b\",\"verdict\":\"no\"}, {\"key\":\"c\",\"verdict\":\"?\"}, "), "props", F.lit("] and that is all"))
    elements = R.with_tag(R.lenient_array(said, "struct<key:string,k:int,parity:string>"), "parity", lambda x: F.when(x["k"] % 2 == 0, "even").otherwise("odd"))
    last = F.element_at(elements, -1)
    return t(spark, d, "events").select("event_id", last["k"].alias("k"), last["parity"].alias("parity"), F.size(R.verdicts(said, ["ok", "no"])).alias("n"))
