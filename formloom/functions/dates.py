"""Dates and the axes of schedules as column functions: marks of months, weeks and days, calendars, shared days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def axis_mark(text: Column) -> Column:
    """month:N, week:N or day:N of a header, date:yyyy-MM-dd of a whole date, null of anything else."""
    number = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")
    month, week, day = number(r"^\s*([0-9]{1,2})\s*월\s*$"), number(r"^\s*(?:제\s*)?([0-9]{1,2})\s*주(?:차)?\s*$"), number(r"^\s*([0-9]{1,2})\s*일\s*$")
    whole = F.regexp_extract(text, r"^\s*([0-9]{4}-[0-9]{2}-[0-9]{2})\s*$", 1)
    return (
        F.when(whole != "", F.concat(F.lit("date:"), whole))
        .when(month.between(1, 12), F.concat(F.lit("month:"), month))
        .when(week.between(1, 53), F.concat(F.lit("week:"), week))
        .when(day.between(1, 31), F.concat(F.lit("day:"), day))
    )


def axis_unit(marks: Column) -> Column:
    """The unit that most of an array of axis marks have (month before week before day among equals); null for none."""
    count = lambda unit: F.size(F.filter(marks, lambda m: m.startswith(unit + ":")))
    best = F.array_max(F.array(*(F.struct(count(u).alias("n"), F.lit(-i).alias("back"), F.lit(u).alias("unit")) for i, u in enumerate(("month", "week", "day", "date")))))
    return F.when(best["n"] > 0, best["unit"])


def month_of(text: Column) -> Column:
    """The month of a date or of a month's name in digits; null outside 1 to 12."""
    n = F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*[0-9]{4}[-./년]\s*([0-9]{1,2})", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"([0-9]{1,2})\s*월", 1), F.lit(""))).cast("int")
    return F.when(n.between(1, 12), n)


def day_of(text: Column) -> Column:
    """The day of a date or the number before the word for day; null outside 1 to 31."""
    n = F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*[0-9]{4}[-./년]\s*[0-9]{1,2}[-./월]\s*([0-9]{1,2})", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"([0-9]{1,2})\s*일", 1), F.lit(""))).cast("int")
    return F.when(n.between(1, 31), n)


def on_axis(text: Column, unit: Column) -> Column:
    """The axis mark of a date on an axis of months, weeks or days; a text that is a mark already stays one."""
    dated = F.regexp_extract(text, r"^\s*([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).try_cast("date")
    mark = F.when(unit == "month", F.concat(F.lit("month:"), F.month(dated))).when(unit == "week", F.concat(F.lit("week:"), F.weekofyear(dated))).when(unit == "day", F.concat(F.lit("day:"), F.dayofmonth(dated))).otherwise(F.concat(F.lit("date:"), dated.cast("string")))
    return F.coalesce(mark, axis_mark(text))


def period(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_end(day: Column) -> Column:
    return F.last_day(day)


def month_starts(first: Column, n: int) -> Column:
    """array<date>: the first days of n months from that of `first` on."""
    start = F.trunc(first, "month")
    return F.sequence(start, F.add_months(start, n - 1), F.expr("INTERVAL 1 MONTH"))


def shared_days(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Days that two closed spans of days have in common."""
    return F.greatest(F.lit(0), F.datediff(F.least(end, high), F.greatest(start, low)) + 1)
