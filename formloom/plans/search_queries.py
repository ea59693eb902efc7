"""Queries on kept indexes and on boxes of the plane."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.operators import boxes as B
from formloom.operators import search_index as X
from formloom.plans.queries import query, t
from formloom.session import shared_folder

KEYS = ["name", "domain", "kind", "number"]
#: The records that are indexed: parts as forms, in two batches; and what is asked: names cut short, of every twentieth part.
RECORDS = "SELECT p_partkey, p_name AS name, p_brand AS domain, p_type AS kind, (p_size % 2)::VARCHAR AS number FROM part"


def parts_index(spark: SparkSession, d: str) -> str:
    """A new index of all parts, the second half added to that of the first."""
    records = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("domain"), F.col("p_type").alias("kind"), (F.col("p_size") % 2).cast("string").alias("number"))
    path = f"{shared_folder(spark)}/index"
    for half in (0, 1):
        X.extend_index(spark, path, records.where(F.col("p_partkey") % 2 == half), KEYS, KEYS[:3])
    return path


TOKENS = "list_filter(string_split_regex({0}, '[\\s_\\-·/]+'), lambda x: length(x) >= 2)"


@query(f"""WITH e AS (SELECT md5('{{"name":' || to_json(name) || ',"domain":' || to_json(domain) || ',"kind":' || to_json(kind) || ',"number":' || to_json(number) || '}}') AS entry, name, domain, kind, number, count(*) AS files FROM ({RECORDS}) GROUP BY ALL),
  p AS (SELECT entry, unnest(list_distinct({TOKENS.format("name || ' ' || domain || ' ' || kind")})) AS held FROM e),
  q AS (SELECT p_partkey AS query_id, {TOKENS.format("substr(p_name, 1, length(p_name) - 2) || ' ' || p_type")} AS tokens FROM part WHERE p_partkey % 20 = 0),
  a AS (SELECT query_id, len(tokens) AS n, unnest(range(len(tokens))) AS place, unnest(tokens) AS token FROM q),
  h AS (SELECT token, entry, sum((held = token)::INT) AS whole, sum((held <> token)::INT) AS parts FROM (SELECT DISTINCT token FROM a) JOIN p ON contains(held, token) GROUP BY ALL),
  s AS (SELECT query_id, entry, round(sum(whole + 0.4::DOUBLE * parts) / any_value(n), 3) AS score, string_agg(CASE WHEN whole > 0 THEN token ELSE rtrim(repeat('~' || token || '|', parts::BIGINT), '|') END, '|' ORDER BY place) AS matched FROM a JOIN h USING (token) GROUP BY query_id, entry),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry) AS rank FROM s)
  SELECT query_id, rank, name, domain, kind, number, files, score, matched FROM r JOIN e USING (entry) WHERE rank <= 10""")
def kept_index_search(spark, d):
    """Forms by what is asked, from a kept index that was begun with half the records and extended by the others."""
    asked = t(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.expr("substring(p_name, 1, length(p_name) - 2) || ' ' || p_type").alias("text"))
    return X.search_index(spark, parts_index(spark, d), asked, KEYS).withColumn("matched", F.array_join("matched", "|"))


@query(f"""WITH e AS (SELECT name, domain, kind, number FROM ({RECORDS}) GROUP BY ALL), p AS (SELECT unnest(list_distinct({TOKENS.format("name || ' ' || domain || ' ' || kind")})) AS held FROM e)
  SELECT (SELECT count(*) FROM e) AS entries, (SELECT count(*) FROM part) AS records, count(DISTINCT held) AS tokens, count(*) AS postings FROM p""")
def kept_index_totals(spark, d):
    return X.index_totals(spark, parts_index(spark, d))


#: Boxes of three kinds of sizes, by two coordinates of a vector; some have no place.
BOXES = """SELECT label AS doc, vec_id AS id, CASE WHEN vec_id % 29 <> {3} THEN floor(embedding[{0}]::DOUBLE * {2}) END AS x, floor(embedding[{1}]::DOUBLE * {2}) AS y, CASE WHEN vec_id % 7 = 0 THEN 160.0 ELSE 5 + vec_id * 37 % 40 END::DOUBLE AS w, CASE WHEN vec_id % 11 = 0 THEN 90.0 ELSE 4 + vec_id * 17 % 20 END::DOUBLE AS h FROM embeddings"""
OBJECTS, CELLS = BOXES.format(1, 2, 3000, 3), BOXES.format(3, 4, 1500, 5)


def boxes(spark: SparkSession, d: str, i: int, scale: int, without: int) -> DataFrame:
    at = lambda k: F.floor(F.col("embedding")[k].cast("double") * scale).cast("double")
    n = F.col("vec_id")
    size = lambda every, big, low, step, wide: F.when(n % every == 0, big).otherwise(low + n * step % wide).cast("double")
    return t(spark, d, "embeddings").select(F.col("label").alias("doc"), n.alias("id"), F.when(n % 29 != without, at(i)).alias("x"), at(i + 1).alias("y"), size(7, 160, 5, 37, 40).alias("w"), size(11, 90, 4, 17, 20).alias("h"))


SHARED = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / greatest(1, a.w * a.h)"


@query(f"""WITH o AS ({OBJECTS}), c AS ({CELLS}),
  p AS (SELECT a.doc, a.id AS object_id, b.id AS cell_id, a.w, a.h, {SHARED} AS overlap, a.x + a.w / 2 BETWEEN b.x AND b.x + b.w AND a.y + a.h / 2 BETWEEN b.y AND b.y + b.h AS inside,
    sqrt((a.x + a.w / 2 - b.x - b.w / 2) ** 2 + (a.y + a.h / 2 - b.y - b.h / 2) ** 2) AS distance FROM o a JOIN c b ON a.doc = b.doc AND a.x IS NOT NULL AND b.x IS NOT NULL),
  k AS (SELECT *, max(inside) OVER w AS any_inside, max(overlap) OVER w > 0 AS any_overlap, min((distance, cell_id)) OVER w AS nearest FROM p WINDOW w AS (PARTITION BY doc, object_id)),
  g AS (SELECT *, CASE WHEN any_inside THEN 'CENTER_INSIDE_CELL' WHEN any_overlap THEN 'BBOX_OVERLAP' ELSE 'NEAREST_CELL' END AS reason FROM k WHERE CASE WHEN any_inside THEN inside WHEN any_overlap THEN overlap > 0 ELSE (distance, cell_id) = nearest END),
  r AS (SELECT *, overlap - lead(overlap) OVER w AS gap, row_number() OVER w AS place FROM g WINDOW w AS (PARTITION BY doc, object_id ORDER BY overlap DESC, cell_id))
  SELECT doc, object_id, cell_id, reason, round(overlap, 4) AS overlap, round(distance, 2) AS distance, round(CASE reason WHEN 'CENTER_INSIDE_CELL' THEN least(0.8::DOUBLE, 0.5 + 0.3::DOUBLE * least(1, overlap)) WHEN 'BBOX_OVERLAP' THEN least(0.8::DOUBLE, 0.3 + 0.5::DOUBLE * least(1, overlap)) ELSE least(0.6::DOUBLE, 0.2 + 0.4::DOUBLE * greatest(0, 1 - distance / (sqrt(w * w + h * h) * 4))) END, 3) AS confidence,
    coalesce(max(CASE WHEN place = 1 THEN gap < 0.05 END) OVER (PARTITION BY doc, object_id), false) AND reason <> 'NEAREST_CELL' AS ambiguous FROM r
  UNION ALL SELECT doc, id, NULL, 'NO_GEOMETRY', NULL, NULL, 0, false FROM o WHERE x IS NULL UNION ALL SELECT doc, id, NULL, 'NO_CELL_GEOMETRY', NULL, NULL, 0, false FROM o WHERE x IS NOT NULL AND doc NOT IN (SELECT doc FROM c WHERE x IS NOT NULL)""")
def object_cells(spark, d):
    """The cells that each object of a document may belong to, by centre, overlap or distance."""
    return B.cell_candidates(boxes(spark, d, 0, 3000, 3), boxes(spark, d, 2, 1500, 5), ["doc"])


@query(f"""WITH o AS ({OBJECTS}), c AS ({CELLS}) SELECT a.doc, a.id AS a_id, b.id AS b_id FROM o a JOIN c b ON a.doc = b.doc AND a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.h AND b.y <= a.y + a.h""")
def touching_boxes(spark, d):
    """Pairs of boxes of any size that share a point, each once."""
    return B.touching(boxes(spark, d, 0, 3000, 3), boxes(spark, d, 2, 1500, 5), ["doc"], 8.0).select("doc", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))
