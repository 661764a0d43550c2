"""Lines and pages of cleaned text, and image links above captions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.textclean import PAGE_BREAK, caption_label, join_path, page_marker


def split_pages(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, page, page_text), pages parted by form feeds and counted from 1."""
    return docs.select(key, F.posexplode(F.split(text, PAGE_BREAK)).alias("_at", "page_text")).select(key, (F.col("_at") + 1).alias("page"), "page_text")


def numbered_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line, page): page of the last marker before or on the line, 1 without one."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("_mark", page_marker(F.col("line")))
    seen = F.last("_mark", ignorenulls=True).over(W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    return lines.withColumn("page", F.coalesce(seen, F.lit(1))).drop("_mark")


def caption_links(lines: DataFrame, key: str, manifest: DataFrame) -> DataFrame:
    """Caption lines with the image they take: the k-th caption of a page takes its k-th image; surplus captions none.

    ``manifest``: key, page, ord, file.
    """
    captions = lines.withColumn("label", caption_label(F.col("line"))).where(F.col("label").isNotNull() & page_marker(F.col("line")).isNull())
    captions = captions.withColumn("_k", F.row_number().over(W.partitionBy(key, "page").orderBy("line_no")))
    images = manifest.withColumn("_k", F.row_number().over(W.partitionBy(key, "page").orderBy("ord"))).select(key, "page", "_k", "file")
    return captions.join(images, [key, "page", "_k"], "left").drop("_k")


def link_images(docs: DataFrame, key: str, manifest: DataFrame, folder: str, text: str = "text") -> DataFrame:
    """(key, text) with ``![label](folder/file)`` and a blank line above every caption that takes an image.

    Everything else, a missing last newline too, stays as it is.
    """
    lines = numbered_lines(docs, key, text)
    found = caption_links(lines, key, manifest).where(F.col("file").isNotNull())
    links = found.select(key, "line_no", F.concat(F.lit("!["), "label", F.lit("]("), join_path(folder, F.col("file")), F.lit(")\n\n")).alias("link"))
    own = links.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("line_no", "link"))).alias("_links"))
    out = docs.select(key, text).join(own, key, "left")
    rebuilt = F.array_join(F.transform(F.split(text, "\n"), lambda line, i: F.concat(F.coalesce(F.col("_links")[i], F.lit("")), line)), "\n")
    return out.select(key, F.when(F.col("_links").isNull(), F.col(text)).otherwise(rebuilt).alias(text))


def join_page_range(pages: DataFrame, key: str, first: int, last: int, between: str = "\n\f\n") -> DataFrame:
    """(key, text) of pages first .. last in order."""
    own = pages.where(F.col("page").between(first, last)).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("page", "page_text"))).alias("_pages"))
    return own.select(key, F.array_join(F.transform("_pages", lambda p: p["page_text"]), between).alias("text"))
