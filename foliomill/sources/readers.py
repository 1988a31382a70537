"""Readers for stored pages, URL lists, sitemaps and robots files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill import fixed_values as fv
from foliomill.functions import urls as U


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A page snapshot (page_id, url, html, ...), Parquet."""
    return spark.read.parquet(path)


def page_results(pages: DataFrame) -> DataFrame:
    """Pages as fetch results: stored pages count as fetched with status 200."""
    return pages.select(
        "url", "html", F.lit(200).cast("bigint").alias("status"), F.lit(False).alias("skipped"), F.lit("").alias("reason")
    )


def url_list(lines: DataFrame) -> DataFrame:
    """(line_no, url) from (line_no, line): no blanks, no comments, no skippable URLs.

    A comment starts with # in its first column; an indented # is taken as a URL.
    """
    url = F.btrim("line", F.lit(fv.WHITE_SPACE))
    kept = lines.where((url != "") & ~F.startswith("line", F.lit("#"))).select("line_no", url.alias("url"))
    return kept.where(~U.is_skippable(F.col("url")))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """URL list files as (line_no, url); line_no orders the lines of a file, and files one by one."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return url_list(lines)


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """Whole XML files as (sitemap_url, xml); the file's location stands for its URL."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("sitemap_url"), F.col("value").alias("xml")
    )


def read_entries(spark: SparkSession, path: str, tag: str = "url") -> DataFrame:
    """Sitemap files of any size, cut after each closing tag: (sitemap_url, block, id, entry).

    Files are split, so a large one is read by many tasks.  ``block`` is where a split of the file begins, and ``id``
    orders the entries of a block.
    """
    rows = spark.read.text(path, lineSep=f"</{tag}>")
    return rows.select(
        F.col("_metadata.file_path").alias("sitemap_url"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.col("value").alias("entry"),
    )


def read_robots(spark: SparkSession, path: str) -> DataFrame:
    """Whole robots files as (site, status, txt); the file's location stands for its site."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("site"), F.lit(200).alias("status"), F.col("value").alias("txt")
    )
