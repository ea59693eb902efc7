"""Values that people write by hand, brought to one form; tests of what a text looks like. Column functions throughout.

A value that doesn't fit gives null unless a function says otherwise; null gives null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from formloom.functions.text import collapse, ordered_rules

#: Words for yes and no.
YES, NO = ["yes", "y", "예", "o", "v", "✓", "1", "true", "있음"], ["no", "n", "아니오", "아니요", "x", "0", "false", "없음"]
#: Korean units of an amount and their worth, largest first.
UNITS = [("억", 100_000_000), ("천만", 10_000_000), ("백만", 1_000_000), ("만", 10_000), ("천", 1_000)]
#: What stands where a form leaves room for a value: words, what a text with it asks for, marks, rows of zeros.
PLACEHOLDERS, ASKED, MARKS, ZEROS = ["제", "호", "제호", "㎡", "년월일", "년월일시", "..."], "입력필요", r"^[.ㆍ·\-_()\[\]]+$", r"^0{2,}(?:[-.]0+)*$"


def without_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def plain(text: Column) -> Column:
    """Control characters go, white space runs become one blank."""
    return collapse(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def search_key(text: Column) -> Column:
    return F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit(""))


def bare_label(text: Column) -> Column:
    """A label without brackets and their content, numbering in front, and colons, stars and blanks at its ends."""
    inner = F.regexp_replace(F.regexp_replace(text, r"[(\[{<〔【][^)\]}>〕】]*[)\]}>〕】]", ""), r"^\s*(?:[0-9]+[.)]|[①-⑳]|[가-하][.)])\s*", "")
    return collapse(F.regexp_replace(inner, r"^[\s:：*※·]+|[\s:：*※·]+$", ""))


def stem_label(text: Column) -> Column:
    """A label without blanks and without the number at its end, if two letters or more are left before that."""
    tight = without_spaces(text)
    stem = F.regexp_replace(tight, r"[0-9/.\-]+$", "")
    return F.when(F.length(stem) >= 2, stem).otherwise(tight)


def composite_key(*parts: Column) -> Column:
    """Parts joined by a mark that values don't hold; null parts are empty."""
    return F.concat_ws("|||", *(F.coalesce(p, F.lit("")) for p in parts))


def has_hangul(text: Column) -> Column:
    return text.rlike("[가-힣]")


def is_number(text: Column) -> Column:
    """Digits, signs, separators and percent alone, with a digit among them."""
    return text.rlike(r"^[\s0-9.,%+\-()~/]*[0-9][\s0-9.,%+\-()~/]*$")


def is_date(text: Column) -> Column:
    return text.rlike(r"(?:19|20)[0-9]{2}\s*[-./년]\s*[0-9]{1,2}\s*(?:[-./월]\s*[0-9]{1,2}\s*일?)?") | text.rlike(r"^\s*[0-9]{1,2}\s*월(?:\s*[0-9]{1,2}\s*일)?\s*$")


def is_blank(text: Column) -> Column:
    """Nothing there, or only what holds a value's place, white space aside."""
    t = without_spaces(F.coalesce(text, F.lit("")))
    return (t == "") | F.contains(t, F.lit(ASKED)) | t.isin(PLACEHOLDERS) | t.rlike(MARKS) | t.rlike(ZEROS)


def is_label(text: Column, most: int = 30) -> Column:
    """A short text with a letter that is neither number, number with a unit, date, blank nor sentence."""
    t = F.trim(text)
    return ~is_blank(t) & (F.length(t) <= most) & t.rlike(r"\p{L}") & ~is_number(t) & ~t.rlike(r"^[0-9][0-9,.]*\s*[^0-9\s]{1,3}$") & ~is_date(t) & ~t.rlike(r"[.!?。]\s*$")


def yes_no(text: Column) -> Column:
    key = F.lower(F.trim(text))
    return F.when(key.isin(YES), "Y").when(key.isin(NO), "N")


def business_number(text: Column) -> Column:
    """ddd-dd-ddddd from any ten digits."""
    d = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(d) == 10, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 5)))


def phone(text: Column) -> Column:
    """Mobile numbers (01x), numbers of the capital (02) and of other areas (0dd), with hyphens; a country code 82 goes."""
    d = F.regexp_replace(F.regexp_replace(text, "[^0-9]", ""), "^82(?=[1-9])", "0")
    cut = lambda first: F.concat_ws("-", F.substring(d, 1, first), F.substring(d, F.lit(first + 1), F.length(d) - first - 4), F.substring(d, -4, 4))
    return F.when(d.rlike("^02[0-9]{7,8}$"), cut(2)).when(d.rlike("^0[1-9][0-9][0-9]{7,8}$"), cut(3))


def amount(text: Column) -> Column:
    """Whole won of an amount with separators, a currency and Korean units: each number counts with the unit after it."""
    t = F.regexp_replace(text, r"[,\s원₩]|krw|KRW", "")
    plain_number = t.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$")
    rest, total = t, F.lit(0.0)
    for unit, worth in UNITS:
        n = F.regexp_extract(rest, rf"^([0-9]+(?:\.[0-9]+)?){unit}", 1)
        total = total + F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(n, "^[0-9]+", 0), F.lit("")), F.lit("9" * 15)).cast("double") + F.coalesce(F.nullif(F.regexp_extract(n, r"\.[0-9]+$", 0), F.lit("")).cast("double"), F.lit(0.0)), F.lit(0.0)) * worth
        rest = F.regexp_replace(rest, rf"^[0-9]+(?:\.[0-9]+)?{unit}", "")
    units = t.rlike("^(?:[0-9]+(?:[.][0-9]+)?(?:억|천만|백만|만|천))+[0-9]*$")
    tail = F.coalesce(F.nullif(F.regexp_extract(rest, "^([0-9]+)$", 1), F.lit("")).cast("double"), F.lit(0.0))
    return F.when(plain_number, F.round(F.try_to_number(F.nullif(F.regexp_extract(t, r"^-?[0-9]+", 0), F.lit("")), F.lit("S" + "9" * 15)).cast("double")).cast("long")).when(units, F.round(total + tail).cast("long"))


def day(text: Column) -> Column:
    """yyyy-MM-dd of a date with hyphens, dots, slashes, Korean words or no mark at all."""
    part = lambda i: F.regexp_extract(text, r"^\s*([0-9]{4})\s*[-./년]?\s*([0-9]{1,2})\s*[-./월]?\s*([0-9]{1,2})\s*[일.]?\s*$", i)
    marked = text.rlike(r"[-./년]") | text.rlike(r"^\s*[0-9]{8}\s*$")
    return F.when(marked, F.date_format(F.try_make_timestamp(*(F.nullif(part(i), F.lit("")).cast("int") for i in (1, 2, 3)), F.lit(0), F.lit(0), F.lit(0)), "yyyy-MM-dd"))


def price(text: Column, above: float = 0.0, below: float = 1e9) -> Column:
    """A number within open bounds."""
    n = F.regexp_replace(text, r"[,\s]", "").try_cast("double")
    return F.when((n > above) & (n < below), n)


def free_text(text: Column) -> Column:
    return collapse(text)


#: Semantic types and the function that normalises each.
NORMALISERS = {"DATE": day, "AMOUNT": lambda c: amount(c).cast("string"), "PHONE": phone, "BUSINESS_NUMBER": business_number, "YES_NO": yes_no}


def normalised(kind: Column, text: Column) -> Column:
    """struct<value, status>: the value by its semantic type; other types are free text. EMPTY, NORMALISED or UNPARSED."""
    value = reduce(lambda tail, item: F.when(kind == item[0], item[1](text)).otherwise(tail), NORMALISERS.items(), free_text(text))
    bound = F.transform(F.array(value), lambda v: F.struct(F.coalesce(v, F.trim(text)).alias("value"), F.when(is_blank(text), "EMPTY").when(v.isNull(), "UNPARSED").otherwise("NORMALISED").alias("status")))
    return F.get(bound, F.lit(0))


def items_of(text: Column) -> Column:
    """array<string>: items of a list in one text, cut before their marks (1. 2) ① - · 가.), without these, two letters at
    least."""
    cut = F.split(F.coalesce(text, F.lit("")), r"(?:^|\s|,|;)\s*(?=(?:[0-9]{1,2}[.)]|[①-⑳]|[가-하][.)]|[-·•])\s*\S)")
    bare = F.transform(cut, lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[0-9]{1,2}[.)]|[①-⑳]|[가-하][.)]|[-·•])\s*", "")))
    return F.filter(bare, lambda x: F.length(x) >= 2)


def after_label(text: Column, label: str) -> Column:
    """What follows a label (a pattern) and an optional colon at the beginning of a text; null where it isn't there."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"^\s*(?:{label})\s*[:：]?\s*(.+)$", 1)), F.lit(""))


def label_and_value(text: Column) -> Column:
    """struct<label, value> of `label: value`; null without a colon or without a label."""
    parts = F.split(text, "[:：]", 2)
    return F.when((F.size(parts) == 2) & (F.length(F.trim(parts[0])) > 0), F.struct(F.trim(parts[0]).alias("label"), F.trim(parts[1]).alias("value")))


def lines_of(text: Column, least: int = 2, most: int = 60) -> Column:
    """array<string>: the trimmed lines whose length is within bounds."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: F.length(x).between(least, most))


def keyword_lines(text: Column, keywords: list[str], endings: list[str]) -> Column:
    """array<string>, distinct, in order: lines that have a keyword or end in one of the endings."""
    has = lambda x: reduce(lambda a, b: a | b, [*(F.contains(x, F.lit(k)) for k in keywords), *(F.endswith(x, F.lit(e)) for e in endings)])
    return F.array_distinct(F.filter(lines_of(text), has))


def repaired(text: Column, rounds: int = 3) -> Column:
    """UTF-8 that was read as Latin-1, up to `rounds` times over, read as it was meant; anything else stays."""
    for _ in range(rounds):
        narrow = F.when(text.rlike(r"^[\x00-\xFF]*$") & text.rlike(r"[\x80-\xFF]"), text)
        text = F.coalesce(F.try_validate_utf8(F.encode(narrow, "ISO-8859-1").cast("string")), text)
    return text


def preview(text: Column, most: int = 20) -> Column:
    """struct<sha256, preview>: the hash of a value and its first characters, digits and address names masked."""
    shown = F.regexp_replace(F.regexp_replace(text, r"[A-Za-z0-9._%+-]+(?=@)", "***"), "[0-9]", "#")
    return F.when(text.isNotNull(), F.struct(F.sha2(text, 256).alias("sha256"), F.substring(shown, 1, most).alias("preview")))


def masked_name(stem: Column) -> Column:
    return F.concat(F.lit("file_"), F.substring(F.sha2(stem, 256), 1, 12))


def leaks(*columns: str) -> Column:
    """Whether one of the columns holds what should have been masked: an address, a long number, a telephone number."""
    pattern = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]|[0-9]{6}-?[1-4][0-9]{6}|01[016789]-?[0-9]{3,4}-?[0-9]{4}"
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(c).cast("string").rlike(pattern), F.lit(False)) for c in columns))


def value_score(text: Column) -> Column:
    """How much a text looks like a filled-in value, 0 to 1, by what it holds."""
    score = F.lit(0.3)
    for condition, weight in ((text.rlike("[0-9]"), 0.3), (is_date(text), 0.2), (text.rlike("원|₩|%|@|-"), 0.2), (F.length(text) > 40, -0.3), (is_blank(text), -0.5), (text.rlike("[:：]\\s*$"), -0.3)):
        score = score + F.when(condition, weight).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def tagged(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The tag of the first pattern that is found in a text."""
    return ordered_rules([(text.rlike(p), tag) for p, tag in rules], default or "") if default else F.nullif(ordered_rules([(text.rlike(p), tag) for p, tag in rules], ""), F.lit(""))


def hinted(text: Column, hints: dict[str, list[str]]) -> Column:
    """struct<field, confidence>: 0.95 where a hint is the whole text, 0.75 where the text holds one; earlier fields first."""
    whole = reduce(lambda tail, item: F.when(text.isin(item[1]), item[0]).otherwise(tail), reversed([*hints.items()]), F.lit(None).cast("string"))
    inside = reduce(lambda tail, item: F.when(reduce(lambda a, b: a | b, (F.contains(text, F.lit(h)) for h in item[1])), item[0]).otherwise(tail), reversed([*hints.items()]), F.lit(None).cast("string"))
    return F.when(whole.isNotNull(), F.struct(whole.alias("field"), F.lit(0.95).alias("confidence"))).when(inside.isNotNull(), F.struct(inside.alias("field"), F.lit(0.75).alias("confidence")))


def best_of(scores: dict[str, Column], least: float, default: str) -> Column:
    """struct<kind, score, second, ambiguous>: the largest score's name, the earlier among equals; `default` below `least`;
    ambiguous where the second comes within a tenth."""
    ranked = F.sort_array(F.array(*(F.struct(s.cast("double").alias("score"), F.lit(-n).alias("back"), F.lit(k).alias("kind")) for n, (k, s) in enumerate(scores.items()))), asc=False)
    bound = F.transform(F.array(ranked), lambda r: F.struct(F.when(r[0]["score"] >= least, r[0]["kind"]).otherwise(default).alias("kind"), r[0]["score"].alias("score"), r[1]["score"].alias("second"), ((r[0]["score"] >= least) & (r[0]["score"] - r[1]["score"] < 0.1)).alias("ambiguous")))
    return F.get(bound, F.lit(0))


def percent(n: Column, of: Column) -> Column:
    """Share in percent, two places; null where there is nothing to share."""
    return F.when(of != 0, F.bround(n / of * 100, 2))


def box_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area that two boxes (left, top, right, bottom) have in common."""
    side = lambda low, high: F.greatest(F.lit(0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]))
    return side("left", "right") * side("top", "bottom")
