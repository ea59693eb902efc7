"""Blocks of HTML pages, cut by patterns where Spark reads them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The entities that pages use most, the ampersand last.
ENTITIES = {"&nbsp;": " ", "&#160;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def plain_text(html: Column) -> Column:
    """Tags go, entities become what they stand for, white space runs become one blank."""
    bare = F.regexp_replace(html, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), bare), r"\s+", " "))


def html_blocks(pages: DataFrame, tags: tuple[str, ...] = ("p", "li", "h1", "h2", "h3", "title")) -> DataFrame:
    """(page_id, block, tag, text): the blocks of each page in order, without inner tags; null pages have none.

    Comments, scripts and styles are left out. A block ends at its closing tag, or where the next block begins if that
    comes first, so an unclosed one doesn't take in its successor.
    """
    names = "|".join(tags)
    clean = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    pattern = rf"(?is)<({names})\b[^>]*>((?:(?!</\1\s*>|<(?:{names})\b).)*+)"
    blocks = F.arrays_zip(F.regexp_extract_all(clean, F.lit(pattern), F.lit(1)).alias("tag"), F.regexp_extract_all(clean, F.lit(pattern), F.lit(2)).alias("text"))
    found = pages.select("page_id", F.posexplode(blocks).alias("block", "b"))
    return found.select("page_id", "block", F.lower("b.tag").alias("tag"), plain_text(F.col("b.text")).alias("text"))
