"""Image manifests as tab-separated files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.textclean import is_local_path
from ..model import InvalidArgument
from .pdfs import MANIFEST

REQUIRED = ("file", "page", "name")


def write_manifest(rows: DataFrame, path: str) -> None:
    """One file with a header, in stream order; a manifest describes one document, so one task writes it."""
    rows.orderBy("page", "ord").coalesce(1).select(*MANIFEST).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(page, ord, file, name); other columns are ignored, rows keep their order, paths must be local."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    for name in REQUIRED:
        if name not in raw.columns:
            raise InvalidArgument(f'manifest is missing the required column "{name}"')
    rows = raw.withColumn("_at", F.monotonically_increasing_id())
    page = F.col("page").try_cast("int")
    bad = rows.where(page.isNull() | ~F.coalesce(is_local_path(F.col("file")), F.lit(False))).select("file", "page").first()
    if bad is not None:
        raise InvalidArgument(f"manifest row with page {bad['page']!r} and file {bad['file']!r} has no page number or no local path")
    rank = F.row_number().over(W.partitionBy("page").orderBy("_at")) - 1
    return rows.select(page.alias("page"), rank.alias("ord"), "file", "name")
