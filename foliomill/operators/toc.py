"""Tables of contents as rows of lines, and the headers that open an output.

A table of contents is as long as its output has pages, so it is kept as one row per line and never
put together in a cell; its length comes from an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill import fixed_values as fv
from foliomill.functions import formats as R


def toc_entries(assigned: DataFrame, docs: DataFrame) -> DataFrame:
    """(output, seq, title, url) from the split's (output, ord, seq) and the documents."""
    return assigned.select("output", "ord", "seq").join(docs.select("ord", "title", "url"), "ord").select(
        "output", "seq", "title", "url"
    )


def toc_lines(entries: DataFrame) -> DataFrame:
    """(output, line_no, line): heading, count, entries in order, rule.  Each line ends with a newline."""
    counts = entries.groupBy("output").agg(F.count(F.lit(1)).alias("n"))
    top = F.array(F.lit(fv.TOC_HEADING), F.lit(""), R.toc_count(F.col("n")), F.lit(""))
    head = counts.select("output", F.posexplode(top).alias("line_no", "line"))
    tail = counts.select("output", "n", F.posexplode(F.array(F.lit(""), F.lit("---"))).alias("i", "line"))
    body = entries.select("output", (F.col("seq") + 3).alias("line_no"), R.toc_entry(F.col("seq"), F.col("title"), F.col("url")).alias("line"))
    tail = tail.select("output", (F.col("n") + 4 + F.col("i")).alias("line_no"), "line")
    return head.withColumn("line_no", F.col("line_no").cast("bigint")).unionByName(body).unionByName(tail)


def _digits_up_to(n: Column) -> Column:
    """Total number of digits of 1..n."""
    total = F.lit(0).cast("bigint")
    for d in range(19):
        total = total + F.greatest(n - F.lit(10**d) + 1, F.lit(0))
    return total


def toc_headers(kept: DataFrame) -> DataFrame:
    """(output, header_chars) of Markdown outputs, from (output, title, url) of their pages."""
    per = kept.groupBy("output").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("title") + F.length("url")).cast("bigint").alias("chars")
    )
    entry_frame = len(". []()") + 1
    fixed = len(fv.TOC_HEADING) + 1 + 1 + len(fv.TOC_COUNT.format("")) + 1 + 1 + 1 + len("---") + 1
    n = F.col("n")
    size = F.col("chars") + n * entry_frame + _digits_up_to(n) + fixed + F.length(n.cast("string"))
    return per.select("output", size.cast("bigint").alias("header_chars"))


def banner_headers(outputs: DataFrame, product: str, collected_at: str) -> DataFrame:
    """(output, header_chars, banner) of text outputs, from (output, base_url)."""
    banner = R.text_banner(product, F.col("base_url"), F.lit(collected_at))
    return outputs.select("output", F.length(banner).cast("bigint").alias("header_chars"), banner.alias("banner"))
