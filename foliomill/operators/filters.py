"""Row filters and order over URLs and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill import fixed_values as fv
from foliomill.functions import text as X
from foliomill.functions import urls as U
from foliomill.storage import written


def include(urls: DataFrame, needles: Sequence[str], url: str = "url") -> DataFrame:
    return urls.where(U.contains_any(F.col(url), needles)) if needles else urls


def exclude(urls: DataFrame, needles: Sequence[str], url: str = "url") -> DataFrame:
    return urls.where(~U.contains_any(F.col(url), needles)) if needles else urls


#: Length of the pieces that patterns are found by.
GRAM = 3
#: Patterns of so many bytes at most are broadcast; the URLs' pieces meet larger tables under so many salts.
BROADCAST_BYTES, SALTS = 8 << 20, 8


def _grams(text: str, length: int) -> Column:
    """The distinct pieces of ``length`` characters."""
    starts = F.sequence(F.lit(1), F.char_length(text) - length + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(text), i, length)))


def matching(urls: DataFrame, patterns: DataFrame, url: str = "url", pattern: str = "pattern") -> DataFrame:
    """``(url)``: the distinct URLs that contain any of a table of patterns, as plain text.

    No URL is compared with all patterns: of each pattern the piece of three characters is taken that the fewest URLs
    hold (of a shorter pattern the whole), URLs meet patterns by equal pieces, and only then is the whole pattern looked
    for.  A pattern with a piece that no URL holds is dropped at once.  The empty pattern is in every URL; null
    patterns and URLs match nothing.
    """
    texts = written(urls.select(F.col(url).alias("url")).where("url is not null").distinct(), "pattern-urls")
    sought = patterns.select(F.col(pattern).alias("pattern")).where("pattern is not null").distinct()
    sought = written(sought.withColumn("length", F.least(F.char_length("pattern"), F.lit(GRAM))), "patterns")
    sizes = {r["length"]: r["bytes"] for r in sought.groupBy("length").agg(F.sum(F.octet_length("pattern") + 16).alias("bytes")).collect()}
    if 0 in sizes:
        return texts
    if not sizes:
        return texts.limit(0)
    small = sum(sizes.values()) <= BROADCAST_BYTES

    def pieces(rows: DataFrame, text: str) -> DataFrame:
        """One row per piece of each length that a pattern has."""
        each = [F.when(F.char_length(text) >= n, _grams(text, n)).otherwise(F.array().cast("array<string>")) for n in sorted(sizes)]
        return rows.select("*", F.explode(F.concat(*each)).alias("gram"))

    of_patterns = written(pieces(sought, "pattern").where(F.char_length("gram") == F.col("length")).select("pattern", "gram"), "pattern-grams")
    of_urls, known = pieces(texts, "url"), of_patterns.select("gram").distinct()
    counts = of_urls.select("gram").join(F.broadcast(known) if small else known, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # A piece without a count is in no URL: its pattern has the least place then, and goes.
    place = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")
    rarest = of_patterns.join(counts, "gram", "left").groupBy("pattern").agg(F.min(place).alias("place")).where("place.n > 0")
    index = written(rarest.select("pattern", "place.gram"), "pattern-index")
    if small:
        met = of_urls.join(F.broadcast(index), "gram")
    else:
        # A piece that very many URLs hold is dealt over several keys.
        salted = index.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
        met = of_urls.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS))).join(salted, ["gram", "salt"])
    return met.where(F.contains("url", "pattern")).select("url").distinct()


def include_table(urls: DataFrame, patterns: DataFrame, url: str = "url", pattern: str = "pattern") -> DataFrame:
    """The rows whose URL contains any pattern of a table; all rows if the table is empty.  Null URLs go."""
    if patterns.where(F.col(pattern).isNotNull()).isEmpty():
        return urls
    return urls.join(matching(urls, patterns, url, pattern).withColumnRenamed("url", url), url, "left_semi")


def exclude_table(urls: DataFrame, patterns: DataFrame, url: str = "url", pattern: str = "pattern") -> DataFrame:
    """The rows whose URL contains no pattern of a table; all rows if the table is empty.  Else null URLs go."""
    if patterns.where(F.col(pattern).isNotNull()).isEmpty():
        return urls
    return urls.where(F.col(url).isNotNull()).join(matching(urls, patterns, url, pattern).withColumnRenamed("url", url), url, "left_anti")


def usable(pages: DataFrame) -> DataFrame:
    """Pages that were fetched and have HTML.  A table without a ``skipped`` column has no skips."""
    fetched = pages.where(~F.col("skipped")) if "skipped" in pages.columns else pages
    return fetched.where(F.length("html") > 0)  # a missing html is an empty one


def is_long_enough(content: Column, min_length: int = fv.MIN_LENGTH) -> Column:
    return (F.length(content) > 0) & (F.length(X.strip(content)) >= min_length)


def first_n(urls: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """First N rows of the whole table (a top-k, no full sort); all rows if N is not positive."""
    return urls.orderBy(order).limit(n) if n > 0 else urls


def first_n_per_group(urls: DataFrame, n: int, group: str, order: str = "ord", salts: int = 64) -> DataFrame:
    """First N rows of each group.

    Each group is first cut to N rows per salt, so at most ``salts * N`` rows of the largest group meet
    in one task however many rows it has.  The order column must be unique within the group.
    """
    if n <= 0:
        return urls
    salted = urls.withColumn("salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    local = Window.partitionBy(group, "salt").orderBy(order)
    final = Window.partitionBy(group).orderBy(order)
    cut = salted.withColumn("rn", F.row_number().over(local)).where(F.col("rn") <= n).drop("salt")
    return cut.withColumn("rn", F.row_number().over(final)).where(F.col("rn") <= n).drop("rn")
