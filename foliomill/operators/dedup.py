"""Duplicates: of URLs and of contents.  The first in order wins.

Winners come from an aggregate over keys (md5 and order, 24 bytes a row) that combines on the map side;
a content copied into a third of all rows therefore reaches the reducer as one row per map task.
Content is never shuffled to find duplicates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_positions(rows: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """(keys, order): the smallest order of each key."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def url_dedup(urls: DataFrame) -> DataFrame:
    return first_positions(urls, ["url"])


def content_winners(docs: DataFrame, scope: Sequence[str] = (), order: str = "ord") -> DataFrame:
    """(scope, order) of the first document of each content, within the scope (a run's output)."""
    return first_positions(docs, [*scope, "content_md5"], order).select(*scope, order)


def content_dedup(docs: DataFrame, scope: Sequence[str] = (), order: str = "ord") -> DataFrame:
    """Documents without later copies.  The join back is on the unique order column."""
    winners = content_winners(docs.select(*scope, "content_md5", order), scope, order)
    return docs.join(winners.select(order), order, "left_semi")


def duplicates(docs: DataFrame, scope: Sequence[str] = (), order: str = "ord") -> DataFrame:
    """The later copies, which :func:`content_dedup` leaves out."""
    winners = content_winners(docs.select(*scope, "content_md5", order), scope, order)
    return docs.join(winners.select(order), order, "left_anti")


def dup_groups(docs: DataFrame, order: str = "ord") -> DataFrame:
    """(content_md5, n_docs, first_ord, first_url) for every content."""
    return docs.groupBy("content_md5").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.min(order).alias("first_ord"),
        F.min_by("url", order).alias("first_url"),
    )
