"""Events at least a horizon apart: of each key's times the first, and then each first one later than the horizon after the last kept.

Which times are kept depends on all earlier ones, yet one key may hold a third of all rows.  So no key is walked through.
Time is dealt into ranges as wide as the horizon; a range has one kept time at most.  Every time points to its *successor*,
the first time later than the horizon after it, found within a small slice of time.  Then ranges are composed two by two,
level by level: the table of a block of ranges says, of each time that can be the first kept there, which is the first
kept after the block.  Only times at a block's start can be, so each level has about half the rows of the one
before, and there are as many levels as the number of ranges has binary digits.  At last the first kept time is handed
down from the block of all ranges to the single ranges: whoever is handed to one is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.storage import written

#: A range has at most so many slices; the times of one key in one slice are sorted in one task.
SLICES = 1024
_NEVER = -(2**62)


def _slices(horizon: int) -> int:
    """The largest power of two up to :data:`SLICES` that divides the horizon."""
    return min(SLICES, horizon & -horizon)


def _floor(value: Column, width: int) -> Column:
    """``value`` divided by ``width``, rounded down, without a detour over floating point."""
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def successors(times: DataFrame, horizon: int) -> DataFrame:
    """``(key, t, next)`` of distinct ``(key, t)``: the first time of the key later than ``t + horizon``, or null."""
    per_range = _slices(horizon)
    width = horizon // per_range
    slice_of = times.withColumn("slice", _floor(F.col("t"), width))
    # What comes after a slice: in its range, or else in a later one.  Slices that are only looked up hold no time.
    firsts = slice_of.groupBy("key", "slice").agg(F.min("t").alias("first"))
    looked_up = firsts.select("key", (F.col("slice") + per_range).alias("slice"), F.lit(None).cast("long").alias("first"))
    both = firsts.unionByName(looked_up).groupBy("key", "slice").agg(F.min("first").alias("first"))
    both = both.withColumn("range", _floor(F.col("slice"), per_range))
    ranges = both.groupBy("key", "range").agg(F.min("first").alias("first"))
    later_range = F.min("first").over(Window.partitionBy("key").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1))
    later_slice = F.min("first").over(Window.partitionBy("key", "range").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1))
    after = both.withColumn("in_range", later_slice).join(ranges.select("key", "range", later_range.alias("beyond")), ["key", "range"])
    # In a slice, from its end to its start: what follows it, its times, and the points that look for a time after them.
    follows = after.select("key", "slice", F.coalesce("in_range", "beyond").alias("at"), F.lit(None).cast("long").alias("t")).where("at is not null")
    held = slice_of.select("key", "slice", F.col("t").alias("at"), F.lit(None).cast("long").alias("t"))
    points = slice_of.select("key", (F.col("slice") + per_range).alias("slice"), (F.col("t") + horizon).alias("at"), "t")
    backwards = Window.partitionBy("key", "slice").orderBy(F.desc("at"), F.desc("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nearest = F.min(F.when(F.col("t").isNull(), F.col("at"))).over(backwards)
    return follows.unionByName(held).unionByName(points).withColumn("next", nearest).where("t is not null").select("key", "t", "next")


def spaced(times: DataFrame, horizon: int) -> DataFrame:
    """``(key, t)``: the kept ones of ``(key, t)``, ``t`` a BIGINT.

    The first time of a key is kept, and after a kept time the first that is later by more than ``horizon``.  Repeated
    rows are one; null keys and times are left out; an empty table gives an empty result.
    """
    if horizon < 1:
        raise ValueError("the horizon must be positive")
    nodes = written(times.where("key is not null and t is not null").select("key", "t").distinct(), "spacing-times")
    span = nodes.agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
    if span["low"] is None:
        return nodes
    origin = span["low"] // horizon
    levels = (span["high"] // horizon - origin).bit_length()

    def block(t: Column, level: int) -> Column:
        """The number of a block of ``2 ** level`` ranges."""
        return _floor(t - origin * horizon, horizon << level)

    first = nodes.groupBy("key").agg(F.min("t").alias("t"))
    if levels == 0:
        return first
    # The first time of each range, with the range before it that holds any.
    ranges = nodes.groupBy("key", block(F.col("t"), 0).alias("range")).agg(F.min("t").alias("t"))
    before = F.lag("range", 1, _NEVER).over(Window.partitionBy("key").orderBy("range"))
    steps = successors(nodes, horizon).join(ranges.select("key", "t", before.alias("before")), ["key", "t"], "left")
    tables = [written(steps, "spacing-0")]
    for level in range(1, levels):
        # The first kept time of a block is in its first range, or the first of the range after it that holds any.
        own, ahead = block(F.col("t"), level), block(F.col("next"), level)
        start = own * (1 << level)
        below = tables[-1]
        entries = below.where((block(F.col("t"), 0) == start) | (F.col("before") <= start))
        second = below.select("key", F.col("t").alias("next"), F.col("next").alias("beyond"))
        joined = entries.join(second, ["key", "next"], "left")
        tables.append(written(joined.select("key", "t", F.when(own == ahead, F.col("beyond")).otherwise(F.col("next")).alias("next"), "before"), f"spacing-{level}"))
    kept = first
    for level in range(levels - 1, -1, -1):
        handed = kept.join(tables[level].select("key", "t", "next"), ["key", "t"])
        same = block(F.col("t"), level + 1) == block(F.col("next"), level + 1)
        kept = written(kept.unionByName(handed.where(same).select("key", F.col("next").alias("t"))), f"spacing-kept-{level}")
    return kept
