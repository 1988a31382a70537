"""Links of pages, and the depth-limited crawl over a link table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import html as H
from foliomill.functions import urls as U
from foliomill.operators.tokens import tokenize
from foliomill.storage import written


def page_links(pages: DataFrame, same_site: bool = True) -> DataFrame:
    """(src, dst, pos): every link of every page, absolute and without fragment.  Map-only."""
    keyed = pages.select(F.col("url").alias("src"), "html")
    anchors = tokenize(keyed, key="src").where((F.col("tag") == "a") & F.col("kind").isin("open", "void"))
    with_href = anchors.where(F.col("token").rlike(r"(?i)[\s\"']href(?:\s*=|[\s>/])"))
    hrefs = with_href.select("src", "pos", H.attribute(F.col("token"), "href").alias("href"))
    links = U.resolve(hrefs, "src", "href", "dst").select("src", "dst", "pos")
    if not same_site:
        return links
    # As a generator: a plain filter would be pushed below the steps that compute dst, and repeat them.
    inside = F.filter(F.array("dst"), lambda dst: U.same_domain(dst, F.col("src")))
    return links.select("src", F.explode(inside).alias("dst"), "pos")


def _passes(url: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    ok = ~U.is_skippable(url)
    if exclude:
        ok = ok & ~U.contains_any(url, exclude)
    if include:
        ok = ok & U.contains_any(url, include)
    return ok


#: Bases of a lane: as many bits as a row has for them.
WORD, WORDS = 64, 8
LANE = WORD * WORDS
#: So many bases at most are broadcast when the bits are read.
BROADCAST_BASES = 50_000
_BITS = [f"w{i}" for i in range(WORDS)]


def numbered(bases: DataFrame) -> DataFrame:
    """``(base, lane, bit)`` of distinct bases; the bases of a lane are of one site, :data:`LANE` at most.

    A site with more bases deals them into groups of about a lane by hash, so that no task numbers them all.
    """
    named = bases.withColumn("site", U.netloc(F.col("base")))
    groups = named.groupBy("site").agg(F.ceil(F.count("*") / LANE).alias("groups"))
    dealt = named.join(groups, "site").withColumn("group", F.pmod(F.xxhash64("base"), F.col("groups")))
    nth = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("site", "group").orderBy("base")) - 1)
    lane = F.concat_ws("\n", "site", "group", F.floor(F.col("nth") / LANE))
    return nth.select("base", lane.alias("lane"), (F.col("nth") % LANE).alias("bit"))


def _merged(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy("url", "lane").agg(*[F.bit_or(c).alias(c) for c in columns])


def crawl(
    links: DataFrame,
    bases: DataFrame,
    max_depth: int,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> DataFrame:
    """(base, url, depth): URLs reachable from each base, with their smallest depth.

    A search from all bases at once.  The bases of a site are numbered, and a URL has one row for each lane of 512 of
    them, with a bit for each base that has come by; so a hub that all bases of a site reach passes its links on
    once for 512 of them, and bits that meet on the way are merged before they are exchanged.  Only the
    result has a row for each base and URL.  One join per hop; a URL that fails a filter is neither kept nor
    expanded, and the include filter is waived for the base.  Links are filtered and made distinct once, each hop's
    frontier is written to the shared folder, and the loop ends early when a frontier is empty.  Null bases and URLs
    are left out.
    """
    start = written(bases.select("base").distinct().where(_passes(F.col("base"), (), exclude)), "crawl-bases")
    depth_of = F.lit(0).cast("bigint").alias("depth")
    if max_depth < 1:
        return start.select("base", F.col("base").alias("url"), depth_of)
    edges = links.select("src", "dst").where(_passes(F.col("dst"), include, exclude))
    edges = written(edges.where(U.same_domain(F.col("dst"), F.col("src"))).distinct(), "crawl-edges")
    names = written(numbered(start), "crawl-lanes")
    own = [F.when(F.floor(F.col("bit") / WORD) == i, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit") % WORD)).otherwise(0).alias(c) for i, c in enumerate(_BITS)]
    frontier = names.select(F.col("base").alias("url"), "lane", *own)
    found = frontier.withColumn("depth", F.lit(0).cast("bigint"))
    seen = [F.col(c).alias(f"seen_{c}") for c in _BITS]
    nothing = [F.lit(0).cast("bigint").alias(f"seen_{c}") for c in _BITS]
    for depth in range(1, max_depth + 1):
        reached = frontier.join(edges, F.col("url") == F.col("src")).select(F.col("dst").alias("url"), "lane", *_BITS, *nothing)
        before = found.select("url", "lane", *[F.lit(0).cast("bigint").alias(c) for c in _BITS], *seen)
        both = _merged(reached.unionByName(before), [*_BITS, *[f"seen_{c}" for c in _BITS]])
        new = both.select("url", "lane", *[F.col(c).bitwiseAND(F.bitwise_not(F.col(f"seen_{c}"))).alias(c) for c in _BITS])
        any_bit = reduce(lambda x, y: x | y, [F.col(c) != 0 for c in _BITS])
        frontier = written(new.where(any_bit), f"crawl-{depth}")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier.withColumn("depth", F.lit(depth).cast("bigint")))
    # Words to bits to bases.
    words = found.select("url", "lane", "depth", F.posexplode(F.array(*_BITS)).alias("nth", "word")).where("word <> 0")
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit("word", i) == 1)
    single = words.select("url", "lane", "depth", "nth", F.explode(bits).alias("at")).withColumn("bit", F.col("nth") * WORD + F.col("at"))
    few = names.count() <= BROADCAST_BASES
    return single.join(F.broadcast(names) if few else names, ["lane", "bit"]).select("base", "url", "depth")


def crawl_filtered(links: DataFrame, bases: DataFrame, max_depth: int, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """The crawl followed by the same filters over its result, which now also apply to the base."""
    return crawl(links, bases, max_depth, include, exclude).where(_passes(F.col("url"), include, exclude))
