"""Files as a whole: addresses held against what is there, layouts by what dominates, and one file for each category."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The share of addresses that must hold, and shares and counts by which a file's layout is told.
PASS, BACK_SHARE, APPROVAL_SHARE, APPROVALS, COLUMNS, ADJACENT = 0.98, 0.5, 0.4, 3, 0.90, 0.60
#: Headers of an office's approval, and of the back side of a page.
APPROVAL = "접수 직인 결재 담당 검토 승인 기안 전결 대결 서명 서명란 인 날인 확인인 계장 과장 부장 팀장 국장 처장 차장".split()
BACK = r"(?i)뒤?쪽|뒷?\s*면|앞\s*쪽?|앞\s*면|[(\[]\s*제?\s*\d+\s*쪽|\d+\s*/\s*\d+\s*쪽"


def first_failures(addresses: DataFrame, there: DataFrame, levels: list[str]) -> DataFrame:
    """(id, failed): of each address the first level that isn't there, null where all are.

    addresses: id, path (array, one value a level); there: path, whole or cut short. levels name what is missing at each depth. A path that is
    null, or has a null where a level should stand, fails there; one that is shorter than levels fails at its end. One join serves all
    levels: every path becomes a row for each of its beginnings. Ids that repeat are one address, which fails where the first of
    them does.
    """
    depth = lambda most: F.explode(F.sequence(F.lit(1), most)).alias("level")
    key = lambda: F.to_json(F.struct(F.slice("path", 1, F.col("level")).alias("p")))
    asked = addresses.select("id", F.coalesce("path", F.array().cast(addresses.schema["path"].dataType)).alias("path")).select("id", "path", depth(F.lit(len(levels))))
    good = (F.size("path") >= F.col("level")) & F.get(F.col("path"), F.col("level") - 1).isNotNull()
    asked = asked.select("id", "level", F.when(good, key()).alias("key"))
    known = there.where("path IS NOT NULL AND size(path) > 0").select("path", depth(F.least(F.size("path"), F.lit(len(levels))))).select("level", key().alias("key")).distinct().withColumn("is_there", F.lit(True))
    held = asked.join(known, ["level", "key"], "left")
    failed = held.groupBy("id").agg(F.min(F.when(F.col("is_there").isNull(), F.col("level"))).alias("at"))
    return failed.select("id", F.get(F.array(*map(F.lit, levels)), F.col("at") - 1).alias("failed"))


def address_verdicts(failures: DataFrame, owner: Column, least: float = PASS) -> DataFrame:
    """(owner, total, ok, failed, reasons, verdict): addresses of each owner, how many fail at each level, and whether enough hold."""
    rows = failures.select(owner.alias("owner"), "failed")
    by = rows.groupBy("owner", "failed").agg(F.count(F.lit(1)).alias("n"))
    reasons = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("failed").isNotNull(), F.struct("failed", "n")))))
    ok = F.coalesce(F.sum(F.when(F.col("failed").isNull(), F.col("n"))), F.lit(0))
    out = by.groupBy("owner").agg(F.sum("n").alias("total"), ok.alias("ok"), reasons.alias("reasons"))
    return out.select("owner", "total", "ok", (F.col("total") - F.col("ok")).alias("failed"), "reasons", F.when(F.col("ok") / F.col("total") >= least, "PASS").otherwise("FAIL").alias("verdict"))


def file_layout(headers: Column, columns: Column, adjacent: Column, inline: Column, tables: Column) -> Column:
    """A struct of layout and confidence of a file: its headers (array), input cells under headers, beside labels and inline, tables.

    In order: half the tables, and one at least, have headers of a back side; two fifths of the headers, and three at least, are an
    office's; nine tenths of the input cells stand under headers, or three fifths beside labels; no input cells; else unknown.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    texts = F.coalesce(headers, F.array().cast("array<string>"))
    back, office = F.size(F.filter(texts, lambda h: h.rlike(BACK))), F.size(F.filter(texts, lambda h: h.isin(APPROVAL)))
    cells = zero(columns) + zero(adjacent) + zero(inline)
    rules = [
        ((back >= zero(tables) * BACK_SHARE) & (back >= 1), "BACK_SIDE_FORM", 0.85), ((office >= F.size(texts) * APPROVAL_SHARE) & (office >= APPROVALS), "PUBLIC_DOC_APPROVAL_FORM", 0.80),
        ((cells > 0) & (zero(columns) >= COLUMNS * cells), "HEADER_COLUMN_FORM", 0.88), ((cells > 0) & (zero(adjacent) >= ADJACENT * cells), "LABEL_ADJACENT_FORM", 0.80), ((cells == 0) & (zero(tables) >= 1), "TABLE_LIST_ONLY", 0.65),
    ]
    named = lambda layout, sure: F.struct(F.lit(layout).alias("layout"), F.lit(sure).alias("confidence"))
    return reduce(lambda tail, r: F.when(r[0], named(*r[1:])).otherwise(tail), reversed(rules), named("UNKNOWN", 0.30))


def surveyed_layout(input_cells: Column, forms: Column, verticals: Column, tables: Column) -> Column:
    """file_layout() of a file that was surveyed without its headers: cells of form tables are inline, those of vertical tables beside
    labels, and the rest under headers."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    rest = F.greatest(F.lit(0), zero(input_cells) - zero(forms) - zero(verticals))
    return file_layout(F.lit(None).cast("array<string>"), rest, zero(verticals), zero(forms), tables)


def one_for_each(files: DataFrame, file: str, categories: dict[str, tuple[Column, list[Column]]]) -> DataFrame:
    """(category, file): for each category in order the first file, by its order and then its name, that meets its condition and no category before
    it took. categories: name -> (condition, order). Categories without a file have no row; there is one row at most for each."""
    spark, chosen = files.sparkSession, []
    for name, (condition, order) in categories.items():
        free = files.where(condition & F.col(file).isNotNull() & ~F.col(file).isin([f for _, f in chosen])) if chosen else files.where(condition & F.col(file).isNotNull())
        top = free.orderBy(*order, file).select(file).first()  # one row
        if top:
            chosen.append((name, top[0]))
    kind = files.schema[file].dataType.simpleString()
    return spark.createDataFrame(chosen, f"category string, `{file}` {kind}")
