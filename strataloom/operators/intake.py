"""Taking documents in: kinds of files, names, addresses, pages and runs of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of text from which a page counts as text, and pages of a document at most.
TEXT_PAGE_CHARS = 80
MAX_PAGES = 50
#: Suffixes of images, and characters that file names may not hold. Fixed values.
IMAGE_SUFFIXES = r"(?i)\.(jpg|jpeg|png|bmp|tif|tiff|webp)$"
RESERVED = r'[\\/:*?"<>|]'
#: IPv4 ranges that are not public, as (first octet, lowest second, highest second). Fixed values.
BLOCKED_RANGES = ((0, 0, 255), (10, 0, 255), (127, 0, 255), (100, 64, 127), (169, 254, 254), (172, 16, 31), (192, 168, 168))
#: Masks and values of the first 16 bits of IPv6 addresses that are not public: unique local, link local, site local, multicast. Fixed values.
BLOCKED_PREFIXES = ((0xFE00, 0xFC00), (0xFFC0, 0xFE80), (0xFFC0, 0xFEC0), (0xFF00, 0xFF00))


def sniff(head: Column, entries: Column) -> Column:
    """The kind of a file from its first bytes, and for archives from the names of its entries; names and declared types do not count."""
    start = F.decode(F.substring(head, 1, 8192), "ISO-8859-1")
    inside = F.coalesce(entries, F.lit(""))
    return (
        F.when(F.substring(start, 1, 4) == "%PDF", "PDF")
        .when(F.startswith(start, F.lit("PK")) & inside.contains("[Content_Types].xml") & inside.contains("word/document.xml"), "DOCX")
        .when(F.hex(F.substring(head, 1, 4)) == "D0CF11E0", "DOC")
        .when(F.lower(start).rlike(r"mime-version:|content-type: multipart/related"), "MHTML")
        .otherwise("UNSUPPORTED_DOCUMENT_TYPE")
    )


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, RESERVED, "_")


def image_verdict(name: Column, size: Column, content_type: Column, most: int = 10_485_760) -> Column:
    """OK or the code of the first check that an image upload fails."""
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "EMPTY_FILE")
        .when(size > most, "FILE_TOO_LARGE")
        .when(~F.startswith(F.coalesce(content_type, F.lit("")), F.lit("image/")) | ~name.rlike(IMAGE_SUFFIXES), "UNSUPPORTED_IMAGE_TYPE")
        .otherwise("OK")
    )


def url_verdict(url: Column, hosts: list[str], ports: list[int]) -> Column:
    """OK, INVALID_DOCUMENT_URL or DOCUMENT_TARGET_BLOCKED. ``*.name`` allows all below a name; resolving names is left to the caller."""
    host = F.lower(F.regexp_extract(url, r"^https?://(?:[^/@]*@)?([^/:?#]+)", 1))
    port = F.regexp_extract(url, r"^https?://[^/:]+:(\d+)", 1)
    allowed = F.lit(False)
    for h in hosts:
        allowed = allowed | (F.endswith(host, F.lit(h[1:])) if h.startswith("*.") else host == h)
    return (
        F.when(~url.rlike("^https?://") | url.rlike("^https?://[^/]*@"), "INVALID_DOCUMENT_URL")
        .when((port != "") & ~port.isin([str(p) for p in ports]), "DOCUMENT_TARGET_BLOCKED")
        .when(allowed, "OK")
        .otherwise("DOCUMENT_TARGET_BLOCKED")
    )


def url_file_name(url: Column) -> Column:
    return F.url_decode(F.regexp_extract(url, r"^https?://[^/]+/(?:[^?#]*/)?([^/?#]*)", 1))


def ip_blocked(ip: Column) -> Column:
    """Whether an IPv4 or IPv6 address is not public; IPv4 addresses inside IPv6 ones are judged as such."""
    plain = F.regexp_replace(F.lower(ip), "^::ffff:(?=[0-9]+[.])", "")
    octets = F.split(plain, r"\.")
    first, second = F.get(octets, F.lit(0)).try_cast("int"), F.get(octets, F.lit(1)).try_cast("int")
    blocked = first >= 224
    for a, low, high in BLOCKED_RANGES:
        blocked = blocked | ((first == a) & second.between(low, high))
    head = F.coalesce(F.conv(F.nullif(F.regexp_extract(plain, "^([0-9a-f]{0,4}):", 1), F.lit("")), 16, 10).cast("int"), F.lit(0))
    six = plain.rlike("^[0:]*:0*1?$")  # unspecified, or the machine itself
    for mask, value in BLOCKED_PREFIXES:
        six = six | (head.bitwiseAND(F.lit(mask)) == value)
    return F.when(plain.contains(":"), six).otherwise(blocked)


def page_modes(pages: DataFrame) -> DataFrame:
    """doc_id, page, page_mode and parse_mode of the document: a page with TEXT_PAGE_CHARS characters or more besides white space is text, any other is read from its image."""
    chars = F.sum(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "")))
    modes = pages.groupBy("doc_id", "page").agg((chars >= TEXT_PAGE_CHARS).alias("is_text"))
    w = Window.partitionBy("doc_id")
    parse = F.when(F.bool_and("is_text").over(w), "PDF_TEXT").when(F.bool_or("is_text").over(w), "HYBRID").otherwise("OCR")
    return modes.select("doc_id", "page", F.when(F.col("is_text"), "PDF_TEXT").otherwise("OCR").alias("page_mode"), parse.alias("parse_mode"))


def drop_after_mark(blocks: DataFrame, mark: Column) -> DataFrame:
    """Blocks before the first marked block of their run of equal pages; tables always stay."""
    w = Window.partitionBy("doc_id").orderBy("block_idx")
    runs = blocks.withColumn("_turn", (F.col("page") != F.lag("page", 1, -1).over(w)).cast("int")).withColumn("_run", F.sum("_turn").over(w))
    seen = F.max(mark.cast("int")).over(Window.partitionBy("doc_id", "_run").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("_seen", seen).where("_seen = 0 or is_table").drop("_turn", "_run", "_seen")
