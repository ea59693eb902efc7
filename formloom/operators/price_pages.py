"""Prices from the spans of printed pages: region headers, columns of stages, items and units that are carried down a page.

A page is the unit: its rows are ordered once, and what a row leaves out (its item, its unit, a ditto mark) it takes from the last row
before it that has it. Spans are (by, y, x, text), by naming a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.operators.lines import named_rows, upright_names
from formloom.session import shared_folder

#: Regions of a header, stages below it, ditto marks, units, and words that begin a size, not an item.
REGIONS, STAGES, DITTO = "서울 인천 수원 부산 대구 대전 광주 전주 강원 제주".split(), "① ② ③".split(), "〃 ″ //".split()
UNITS = "M/T m 개 ㎡ ㎥ ㎏ 본 롤 장 매 EA SET Set TON KG L ℓ 개소 식 대 조 ㎜ m2 m3 포 톤".split()
SIZES = "외경 내경 두께 직경 관경 파경 호칭경 규격 길이 폭 높이 반경 반지름".split()
#: Prices, numbers and sizes without words; heights of rows, reaches around headers and columns, bounds of a price.
PRICE, NUMBER = r"^\d[\d,]+$", r"^[\d.,×xX/㎜㎡㎥㎏%~@#ØΦ()\-]+$"
ROW, STAGE_BELOW, STAGE_NEAR, HEADER_BELOW, UNIT_ABOVE, UNIT_BELOW, UNIT_GAP, LEFT_OF, COLUMN_NEAR, SIZE_LEFT = 5, 40, 60, 15, 30, 70, 20, 40, 30, 160
LEAST, MOST, NAME = 500, 5_000_000_000, 60


def _tight(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def page_rows(spans: DataFrame, by: list[str]) -> DataFrame:
    """spans on rows of ROW: by, row, x, text without control characters; empty texts go, and pages with less than three long prices."""
    text = F.trim(F.regexp_replace(F.regexp_replace("text", r"[\x00-\x1F\x7F-\x9F]", ""), r"(?U)\s+", " "))
    rows = spans.select(*by, (F.bround(F.bround(F.col("y").cast("double"), 0) / ROW, 0) * ROW).alias("row"), F.col("x").cast("double").alias("x"), text.alias("text")).where("text <> '' AND row IS NOT NULL AND x IS NOT NULL")
    long_ = F.count_if(F.col("text").rlike(PRICE) & (F.length("text") > 5)).over(Window.partitionBy(*by))
    return rows.withColumn("long_", long_).where("long_ >= 3").drop("long_")


def region_columns(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, header, price_x, columns): of pages with a region header, its row, where prices begin, and the columns (x, label) in order.

    The header is the first row with three regions. Stages below it are columns of the nearest region; two of one region are told
    apart by their marks. Without stages the regions are the columns. A heading of units left of the columns moves the bound of prices.
    """
    tight = _tight(F.col("text"))
    page = Window.partitionBy(*by)
    there = rows.withColumn("region", F.when(tight.isin(REGIONS), tight)).withColumn("n", F.size(F.collect_set(F.when(F.col("region").isNotNull(), F.col("x"))).over(Window.partitionBy(*by, "row"))))
    there = there.withColumn("header", F.min(F.when(F.col("n") >= 3, F.col("row"))).over(page)).where("header IS NOT NULL")
    below = F.col("row") - F.col("header")
    is_stage = F.col("text").isin(STAGES) & (below > 0) & (below <= STAGE_BELOW)
    near = lambda up, down: below.between(-up, down)
    unit, place = F.when((tight == "단위") & near(UNIT_ABOVE, UNIT_BELOW), F.col("x")), F.struct("row", "x")
    upper, lower = (F.array_sort(F.collect_list(F.when((tight == c) & near(UNIT_ABOVE, down), place))) for c, down in (("단", UNIT_BELOW), ("위", UNIT_BELOW + UNIT_GAP)))
    # A heading of units may stand on two rows, one syllable under the other.
    joined = F.flatten(F.transform("lower", lambda w: F.transform(F.filter("upper", lambda d: (F.abs(d["x"] - w["x"]) <= 10) & (w["row"] > d["row"]) & (w["row"] - d["row"] <= UNIT_GAP)), lambda d: d["x"])))
    heads = there.groupBy(*by, "header").agg(
        F.array_sort(F.collect_set(F.when((F.col("row") == F.col("header")) & F.col("region").isNotNull(), F.struct("x", "region")))).alias("regions"),
        F.array_sort(F.collect_set(F.when(is_stage, F.col("x")))).alias("stages"), F.min_by(unit, F.when(unit.isNotNull(), place)).alias("unit_x"), upper.alias("upper"), lower.alias("lower"),
    ).withColumn("unit_x", F.coalesce("unit_x", F.get(joined, F.lit(0))))
    reach = lambda s: F.array_sort(F.filter(F.transform("regions", lambda r: F.struct(F.abs(r["x"] - s).alias("far"), r["x"].alias("x"), r["region"].alias("region"))), lambda r: r["far"] < STAGE_NEAR))
    met = F.filter(F.transform("stages", lambda s: F.struct(s.alias("x"), F.get(reach(s), F.lit(0))["region"].alias("region"))), lambda c: c["region"].isNotNull())
    heads = heads.withColumn("met", met)
    own = lambda c, upto: F.size(F.filter("met", lambda o: (o["region"] == c["region"]) & (o["x"] <= c["x"] if upto else F.lit(True))))
    label = lambda c: F.when(own(c, False) == 1, c["region"]).otherwise(F.concat(c["region"], F.when(own(c, True) == 1, "①").otherwise("②")))
    columns = F.when(F.size("stages") == 0, F.transform("regions", lambda r: F.struct(r["x"].alias("x"), r["region"].alias("label")))).otherwise(F.transform("met", lambda c: F.struct(c["x"].alias("x"), label(c).alias("label"))))
    heads = heads.withColumn("columns", columns).where(F.size("columns") > 0).withColumn("first_x", F.array_min(F.transform("columns", lambda c: c["x"])))
    base = F.col("first_x") - LEFT_OF
    bound = F.when((F.col("unit_x") < F.col("first_x")) & (F.col("unit_x") + UNIT_GAP > base), F.col("unit_x") + UNIT_GAP).otherwise(base)
    return heads.select(*by, "header", bound.alias("price_x"), "columns")


def item_of(tokens: Column) -> Column:
    """The item that the texts on the left of a row name, or null: the first that is a word, with short ones that follow it."""
    numeral = F.array(*map(F.lit, DITTO))
    word = lambda t: ~F.array_contains(numeral, t) & ~(F.contains(t, F.lit(",")) & t.rlike(r"\d")) & ~t.rlike(NUMBER) & t.rlike("^[가-힣].*") & t.rlike("[가-힣]{2,}") & ~t.rlike(f"^(?:{'|'.join(SIZES)})")
    words = F.filter(tokens, word)
    step = lambda s, t: F.when(s["open"] & (F.length(t) <= 6), F.struct(F.concat(s["name"], t).alias("name"), F.lit(True).alias("open"))).otherwise(F.struct(s["name"].alias("name"), F.lit(False).alias("open")))
    whole = F.aggregate(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), F.struct(F.get(words, F.lit(0)).alias("name"), F.lit(True).alias("open")), step, lambda s: F.substring(s["name"], 1, NAME))
    return F.when(F.size(words) > 0, whole)


def unit_of(tokens: Column) -> Column:
    """The unit that the texts on the left of a row end with, or null, also where a ditto mark stands in its place."""
    known = F.filter(F.transform(F.reverse(tokens), _tight), lambda t: t.isin(*UNITS, *DITTO))
    last = F.get(known, F.lit(0))
    return F.when(last.isin(UNITS), last)


def region_prices(spans: DataFrame, by: list[str]) -> DataFrame:
    """(by, row, x, item, unit, region, price): a row for each price under a region header.

    Rows without prices say nothing. An upright name in the margin is the item of the rows that it reaches, else the words on the left
    are; rows without either take the item before them, rows without a unit, or with a ditto mark, the unit before them. Prices before
    any item, farther than COLUMN_NEAR from every column or outside their bounds are none. Nulls and pages without header give nothing.
    """
    rows = page_rows(spans, by)
    heads = region_columns(rows, by)
    placed = rows.join(heads, by).where(F.col("row") > F.col("header") + HEADER_BELOW)
    digits = F.length(F.replace(F.col("text"), F.lit(","), F.lit("")))
    is_price = (F.col("x") >= F.col("price_x")) & F.col("text").rlike(PRICE) & (F.length("text") > 4) & ~((F.col("x") < SIZE_LEFT) & (digits <= 5))
    token = F.struct("x", "text")
    lines = placed.groupBy(*by, "row").agg(F.array_sort(F.collect_list(F.when(F.col("x") < F.col("price_x"), token))).alias("left"), F.array_sort(F.collect_list(F.when(is_price, token))).alias("prices"), F.first("columns").alias("columns"))
    shared_folder(spans.sparkSession)  # lines and names are checkpointed: the join of both asks for their reach before it begins
    lines = lines.where(F.size("prices") > 0).withColumn("left", F.transform("left", lambda t: t["text"])).checkpoint()
    names = upright_names(rows.select(*by, "x", F.col("row").alias("y"), "text"), by).checkpoint()
    upright = named_rows(lines.select(*by, F.col("row").alias("id"), F.col("row").alias("y")), names, by).select(*by, F.col("id").alias("row"), "name")
    lines = lines.join(upright, [*by, "row"], "left").withColumn("item", F.coalesce("name", item_of(F.col("left")))).withColumn("unit", unit_of(F.col("left")))
    down = Window.partitionBy(*by).orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = lines.select(*by, "row", "prices", "columns", F.last("item", ignorenulls=True).over(down).alias("item"), F.coalesce(F.last("unit", ignorenulls=True).over(down), F.lit("")).alias("unit")).where("item IS NOT NULL")
    each = carried.select(*by, "row", "item", "unit", "columns", F.explode("prices").alias("p"))
    near = F.get(F.array_sort(F.filter(F.transform("columns", lambda c: F.struct(F.abs(c["x"] - F.col("p.x")).alias("far"), c["x"].alias("x"), c["label"].alias("label"))), lambda c: c["far"] <= COLUMN_NEAR)), F.lit(0))
    found = each.select(*by, "row", F.col("p.x").alias("x"), "item", "unit", near["label"].alias("region"), F.replace(F.col("p.text"), F.lit(","), F.lit("")).try_cast("long").alias("price"))
    return found.where((F.col("price") > LEAST) & (F.col("price") < MOST) & F.col("region").isNotNull())
