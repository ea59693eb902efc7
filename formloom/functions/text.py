"""Text normalisers and rule chains as column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(text: Column) -> Column:
    """White space runs become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def label_key(text: Column) -> Column:
    """A label without punctuation and white space, in lower case."""
    return F.lower(F.regexp_replace(text, r"[\s\p{Punct}]+", ""))


def ordered_rules(rules: list[tuple[Column, str]], default: str) -> Column:
    """The output of the first rule whose condition holds; a null condition doesn't hold."""
    return reduce(lambda tail, rule: F.when(rule[0], rule[1]).otherwise(tail), reversed(rules), F.lit(default))


def matched_labels(text: Column, keywords: dict[str, list[str]]) -> Column:
    """All labels of which text contains a keyword, in the order given."""
    hits = [F.when(reduce(lambda a, b: a | b, (F.contains(text, F.lit(k)) for k in words)), F.lit(label)) for label, words in keywords.items()]
    return F.array_compact(F.array(*hits))


def evidence(occurrences: Column, documents: Column) -> Column:
    """Evidence score of a label, 0 to 1, from how often and in how many documents it occurs."""
    return F.round(F.least(F.lit(1.0), F.log10(occurrences + 1) / 4 + F.log10(documents + 1) / 4), 4)


def masked(text: Column) -> Column:
    """E-mail addresses and long digit groups replaced by marks."""
    return F.regexp_replace(F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+", "<email>"), r"[0-9]{3,}", "<number>")
