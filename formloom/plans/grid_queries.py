"""Queries on grids and ordered rows: neighbours, nearest marks, sections, offsets and sessions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from formloom.operators import grid as G
from formloom.plans.queries import query, t


@query("""SELECT a.l_orderkey, a.l_linenumber, b.l_partkey AS right_part FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""")
def neighbor_right(spark, d):
    cells = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return G.at_offset(cells, ["l_orderkey"], "l_linenumber", 1, "l_partkey", "right_part").select("l_orderkey", "l_linenumber", "right_part")


@query("""WITH c AS (SELECT l_orderkey, (l_linenumber - 1) // 2 AS r, (l_linenumber - 1) % 2 AS c, l_linenumber, l_partkey FROM lineitem)
  SELECT a.l_orderkey, a.l_linenumber, b.l_partkey AS below_part FROM c a JOIN c b ON b.l_orderkey = a.l_orderkey AND b.c = a.c AND b.r = a.r + 1""")
def neighbor_below(spark, d):
    """Lines of an order laid out in two columns, row by row."""
    cells = G.in_rows(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), F.col("l_linenumber") - 1, 2)
    return G.at_offset(cells, ["l_orderkey", "grid_column"], "grid_row", 1, "l_partkey", "below_part").select("l_orderkey", "l_linenumber", "below_part")


@query("""SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS rank, round(l_quantity * 100 / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS width FROM lineitem""")
def scaled_widths(spark, d):
    """Ranks of the columns of a row, and their widths scaled to a declared total."""
    row = Window.partitionBy("l_orderkey")
    rank = F.dense_rank().over(row.orderBy("l_partkey")) - 1
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rank.cast("long").alias("rank"), F.round(F.col("l_quantity") * 100 / F.sum("l_quantity").over(row), 6).alias("width"))


@query("""WITH m AS (SELECT *, last_value(CASE WHEN event_type = 'error' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
    first_value(CASE WHEN event_type = 'error' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM events),
  n AS (SELECT event_id, least(coalesce(epoch_us(ts) - epoch_us(b), 9000000000000000), coalesce(epoch_us(a) - epoch_us(ts), 9000000000000000)) // 1000000 AS seconds FROM m)
  SELECT event_id, seconds FROM n WHERE seconds <= 86400""")
def nearest_within_tolerance(spark, d):
    """Seconds to the nearest error of the same user, a day at most: the marks before and after each row, no range join."""
    events = t(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    near = G.nearest(events, ["user_id"], "at", F.col("event_type") == "error", "distance")
    return near.select("event_id", F.floor(F.col("distance") / 1000000).alias("seconds")).where("seconds <= 86400")


@query("""WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events)
  SELECT user_id, section::BIGINT AS section, count(*) AS n, min(event_id) AS least_id FROM s WHERE section > 0 GROUP BY ALL""")
def capture_sections(spark, d):
    """Rows from each start mark to the next; what stands before the first mark is left out."""
    found = G.sections(t(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "signup")
    return found.where("section > 0").groupBy("user_id", "section").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least_id"))


@query("""WITH r AS (SELECT conv_id, turn, role, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM conversations)
  SELECT conv_id, turn, begins::BIGINT AS begins, 100 BETWEEN begins AND begins + length(text) - 1 AS holds_caret FROM r""")
def locate_offset(spark, d):
    """Where each run of a text begins, and which one holds the code point at offset 100."""
    begins = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = t(spark, d, "conversations").withColumn("begins", begins)
    return rows.select("conv_id", "turn", "begins", F.lit(100).between(F.col("begins"), F.col("begins") + F.length("text") - 1).alias("holds_caret"))


@query("""SELECT CAST(round_even(l_extendedprice / 5000, 0) * 5000 AS BIGINT) AS bin, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY bin""")
def tolerance_bins(spark, d):
    return t(spark, d, "lineitem").groupBy((F.bround(F.col("l_extendedprice") / 5000, 0) * 5000).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("orders"))


@query("""WITH m AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
  SELECT user_id, min(epoch_us(ts)) AS begins, count(*) AS n FROM s GROUP BY user_id, run""")
def session_counts(spark, d):
    """Sessions that end after six hours without an event."""
    timed = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.min(F.unix_micros("ts")).alias("begins"), F.count(F.lit(1)).alias("n")).select("user_id", "begins", "n")


@query("""WITH p AS (SELECT role, turn, count(*) AS n, count(DISTINCT conv_id) AS files FROM conversations GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, turn) AS place FROM p),
  f AS (SELECT role, count(DISTINCT conv_id) AS files, count(*) AS cells FROM conversations GROUP BY role)
  SELECT f.role, f.files, f.cells, string_agg(r.turn, ',' ORDER BY r.place) FILTER (WHERE r.place <= 3) AS positions FROM f JOIN r ON f.role = r.role GROUP BY ALL""")
def header_dictionary(spark, d):
    """For each header its files, its cells and its three most usual positions."""
    turns = t(spark, d, "conversations")
    placed = turns.groupBy("role", "turn").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.row_number().over(Window.partitionBy("role").orderBy(F.col("n").desc(), "turn"))).where("place <= 3")
    top = placed.groupBy("role").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "turn"))), lambda x: x["turn"].cast("string")), ",").alias("positions"))
    return turns.groupBy("role").agg(F.countDistinct("conv_id").alias("files"), F.count(F.lit(1)).alias("cells")).join(top, "role")


@query("""WITH o AS (SELECT vec_id, CAST(floor(embedding[1]::DOUBLE * 1000) AS BIGINT) AS x, CAST(floor(embedding[2]::DOUBLE * 1000) AS BIGINT) AS y FROM embeddings),
  m AS (SELECT o.vec_id, c.vec_id AS cell, (o.x - c.x) * (o.x - c.x) + (o.y - c.y) * (o.y - c.y) AS d FROM o JOIN o c ON c.vec_id <> o.vec_id AND abs(o.x - c.x) <= 50 AND abs(o.y - c.y) <= 50)
  SELECT vec_id, arg_min(cell, (d, cell)) AS cell, count(*) > 1 AS ambiguous FROM m GROUP BY vec_id""")
def spatial_best_match(spark, d):
    """The nearest of the boxes (side 100, around every other point) that hold a point; places meet on tiles of growing size."""
    whole = lambda i: F.floor(F.col("embedding")[i].cast("double") * 1000)
    points = t(spark, d, "embeddings").select("vec_id", whole(0).alias("x"), whole(1).alias("y"))
    return G.best_box(points, points, "vec_id", 50)
