"""HTML as lines of text, in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that start a new line. Fixed values.
LINE_ELEMENTS = "p|div|li|tr|h[1-6]|br|hr"
#: Character references that are decoded, the ampersand last. Fixed values.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def html_lines(html: Column, mark_headings: bool = False) -> Column:
    """The trimmed lines of a page that are not blank. With ``mark_headings`` a heading's line starts with its level and a tab."""
    c = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", "")
    c = F.regexp_replace(c, r"[\r\n\t]+", " ")
    if mark_headings:
        c = F.regexp_replace(c, r"(?is)<h([1-6])(\s[^>]*)?>", "\n$1\t")
    c = F.regexp_replace(c, rf"(?is)</?({LINE_ELEMENTS})(\s[^>]*)?/?>", "\n")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", "")
    for old, new in REFERENCES:
        c = F.replace(c, F.lit(old), F.lit(new))
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r" +", " ")))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^[1-6]\t?$"))


def html_blocks(pages, id_column: str = "page_id"):
    """Ordered blocks of pages: doc_id, block_idx, text, page, heading_level, is_table, cells."""
    rows = pages.select(F.col(id_column).alias("doc_id"), F.posexplode(html_lines(F.col("html"), True)).alias("block_idx", "line"))
    level = F.regexp_extract("line", r"^([1-6])\t", 1)
    text = F.regexp_replace("line", r"^[1-6]\t", "")
    return rows.select(
        "doc_id", "block_idx", F.trim(text).alias("text"), F.lit(1).alias("page"), F.when(level != "", level.cast("int")).otherwise(0).alias("heading_level"),
        text.contains("|").alias("is_table"), F.when(text.contains("|"), F.filter(F.transform(F.split(text, r"\|"), F.trim), lambda x: x != "")).otherwise(F.array().cast("array<string>")).alias("cells"),
    )
