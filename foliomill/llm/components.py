"""Connected components of a link table, by contraction.

Every vertex adopts the neighbour (or itself) of smallest priority; the links are then drawn between the
adopted vertices, and the round is repeated until none is left.  Priorities are hashes salted by the round, so
the number of rounds is logarithmic for chains too.  Links are stored each round: the lineage stays short and a
lost executor costs one round.  What is adopted is counted, and broadcast only if it is few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.storage import written

#: Rows that may be broadcast.
MAX_BROADCAST_ROWS = 20_000


def sized(stored: DataFrame) -> DataFrame:
    """A stored table with a hint for joins: broadcast if its rows are counted to be few, else merged."""
    return stored.hint("broadcast" if stored.count() <= MAX_BROADCAST_ROWS else "merge")


def _priority(vertex: Column, salt: int) -> Column:
    return F.struct(F.xxhash64(vertex, F.lit(salt)).alias("h"), vertex.alias("v"))


def labels(links: DataFrame) -> DataFrame:
    """``(v, label)`` for every vertex of ``links(a, b)``: vertices of a component share a label.

    Nulls, self links and repeated links are allowed and change nothing; no links give no rows.  The label is a
    vertex of the component, but not one of a stated kind: aggregate over it for a smallest member.
    """
    links = written(links.where("a is not null and b is not null and a <> b").distinct(), "links")
    result = None
    salt = 0
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        adopted = both.groupBy(F.col("a").alias("v")).agg(F.min(_priority(F.col("b"), salt)).alias("near"))
        adopted = written(
            adopted.select("v", F.least("near", _priority(F.col("v"), salt)).getField("v").alias("label")), "adopted"
        )
        beside = sized(adopted)
        first = beside.select(F.col("v").alias("a"), F.col("label").alias("la"))
        second = beside.select(F.col("v").alias("b"), F.col("label").alias("lb"))
        links = written(
            links.join(first, "a").join(second, "b").where("la <> lb")
            .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(),
            "links",
        )
        if result is None:
            result = adopted
        else:
            step = beside.select(F.col("v").alias("label"), F.col("label").alias("next"))
            result = written(
                result.join(step, "label", "left").select("v", F.coalesce("next", "label").alias("label")), "labels"
            )
        salt += 1
    if result is None:
        return links.select(F.col("a").alias("v"), F.col("b").alias("label"))
    return result
