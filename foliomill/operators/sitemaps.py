"""Sitemaps: locations, index trees, and which source a site's URLs come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill import fixed_values as fv
from foliomill.functions import text as X
from foliomill.functions import urls as U
from foliomill.operators.dedup import first_positions
from foliomill.storage import written

LOC_PATTERN = r"(?s)<loc(?:\s[^>]*)?>(.*?)</loc\s*>"
SITEMAP_PATTERN = r"(?s)<sitemap(?:\s[^>]*)?>(.*?)</sitemap\s*>"


def without_comments(xml: Column) -> Column:
    """XML without its comments; what looks like one inside CDATA stays."""
    return F.regexp_replace(xml, r"(?s)(<!\[CDATA\[.*?\]\]>)|<!--.*?-->", "$1")


def is_index(xml: Column) -> Column:
    return xml.rlike(r"<sitemap[\s>/]")


def location_text(inner: Column) -> Column:
    """Text of a <loc>: CDATA as it stands, otherwise with entities decoded."""
    cdata = F.regexp_extract(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", 1)
    plain = X.decode_entities(F.regexp_replace(inner, "<[^>]*>", ""))
    return X.strip(F.when(F.contains(inner, F.lit("<![CDATA[")), cdata).otherwise(plain))


def locations(sitemaps: DataFrame) -> DataFrame:
    """(sitemap_url, pos, url) of plain sitemaps: non-empty, not skippable, first mention only.

    Regular expressions and not an XML parser: one malformed file must not fail the job.
    """
    sitemaps = sitemaps.select("sitemap_url", without_comments(F.col("xml")).alias("xml"))
    found = sitemaps.where(~is_index(F.col("xml"))).select(
        "sitemap_url", F.posexplode(F.regexp_extract_all("xml", F.lit(LOC_PATTERN), F.lit(1))).alias("pos", "inner")
    )
    urls = found.select("sitemap_url", F.col("pos").cast("bigint").alias("pos"), location_text(F.col("inner")).alias("url"))
    kept = urls.where((F.col("url") != "") & ~U.is_skippable(F.col("url")))
    return first_positions(kept, ["sitemap_url", "url"], "pos").select("sitemap_url", "pos", "url")


_CDATA = r"(?s)<!\[CDATA\[.*?\]\]>"


def placed_entries(entries: DataFrame) -> DataFrame:
    """(sitemap_url, pos, entry, locs) of :func:`foliomill.sources.readers.read_entries`, in the order of each file.

    ``entry`` is without comments, also those that begin in an earlier entry: after any piece of text a comment is open
    if its last mark opens one, so a task needs only the last mark before its block.  ``locs`` are the contents of its
    locations, and ``pos`` counts those before it.  Windows see one block, or one row per block of a file.
    """
    stored = written(entries, "sitemap-entries")
    bare = F.regexp_replace("entry", _CDATA, "")
    # How far the last mark of each kind is from the end; the nearer one counts.
    opening, closing = (F.locate(mark, F.reverse(bare)) for mark in ("--!<", ">--"))
    mark = F.when((opening > 0) & ((closing == 0) | (opening < closing)), True).when(closing > 0, False)
    marked = stored.withColumn("mark", mark)
    in_block = Window.partitionBy("sitemap_url", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("sitemap_url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = marked.groupBy("sitemap_url", "block").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("id"))).alias("mark"))
    begun = last.select("sitemap_url", "block", F.last("mark", ignorenulls=True).over(in_file).alias("begun"))
    state = marked.withColumn("state", F.last("mark", ignorenulls=True).over(in_block)).join(begun, ["sitemap_url", "block"])
    inside = F.coalesce("state", "begun", F.lit(False))
    after = F.when(F.contains("entry", F.lit("-->")), F.substr("entry", F.locate("-->", F.col("entry")) + 3)).otherwise("")
    text = F.regexp_replace(without_comments(F.when(inside, after).otherwise(F.col("entry"))), r"(?s)(<!\[CDATA\[.*?\]\]>)|<!--.*", "$1")
    clean = state.select("sitemap_url", "block", "id", text.alias("entry"))
    clean = written(clean.withColumn("locs", F.regexp_extract_all("entry", F.lit(LOC_PATTERN), F.lit(1))), "sitemap-clean")
    sizes = clean.groupBy("sitemap_url", "block").agg(F.sum(F.size("locs")).alias("n"))
    first = sizes.select("sitemap_url", "block", F.coalesce(F.sum("n").over(in_file), F.lit(0)).alias("first"))
    counted = clean.withColumn("before", F.coalesce(F.sum(F.size("locs")).over(in_block), F.lit(0))).join(first, ["sitemap_url", "block"])
    return counted.select("sitemap_url", (F.col("first") + F.col("before")).alias("pos"), "entry", "locs")


def entry_locations(placed: DataFrame) -> DataFrame:
    """(sitemap_url, pos, url): what :func:`locations` gives, of files read entry by entry."""
    index = placed.where(is_index(F.col("entry"))).select("sitemap_url").distinct()
    found = placed.join(index, "sitemap_url", "left_anti").select("sitemap_url", "pos", F.posexplode("locs").alias("nth", "inner"))
    urls = found.select("sitemap_url", (F.col("pos") + F.col("nth")).alias("pos"), location_text(F.col("inner")).alias("url"))
    kept = urls.where((F.col("url") != "") & ~U.is_skippable(F.col("url")))
    return first_positions(kept, ["sitemap_url", "url"], "pos").select("sitemap_url", "pos", "url")


def malformed_entries(placed: DataFrame, tag: str = "url") -> DataFrame:
    """(sitemap_url, reason, n): entries that do not open just once, or have no location.  The end of a file is none."""
    opened = F.size(F.regexp_extract_all("entry", F.lit(rf"<{tag}[\s>/]"), F.lit(0)))
    reason = F.when(opened > 1, "not closed").when((opened == 1) & (F.size("locs") == 0), "no location").when((opened == 0) & (F.size("locs") > 0), "not opened")
    return placed.select("sitemap_url", reason.alias("reason")).where("reason is not null").groupBy("sitemap_url", "reason").agg(F.count("*").alias("n"))


def children(sitemaps: DataFrame) -> DataFrame:
    """(parent, pos, child): the first location of each entry of a sitemap index."""
    sitemaps = sitemaps.select("sitemap_url", without_comments(F.col("xml")).alias("xml"))
    found = sitemaps.where(is_index(F.col("xml"))).select(
        F.col("sitemap_url").alias("parent"),
        F.posexplode(F.regexp_extract_all("xml", F.lit(SITEMAP_PATTERN), F.lit(1))).alias("pos", "entry"),
    )
    with_loc = found.where(F.col("entry").rlike(LOC_PATTERN))
    child = location_text(F.regexp_extract("entry", LOC_PATTERN, 1))
    return with_loc.select("parent", F.col("pos").cast("bigint").alias("pos"), child.alias("child"))


def _start(root: str) -> Column:
    """The node where reading a root begins; the root itself may be read once more, as an entry."""
    return F.concat(F.lit("\n"), F.col(root))


def _hung(edges: DataFrame, joints: DataFrame) -> DataFrame:
    """``(node, up, path)``: nodes with a single parent, each with the nearest joint above it and the way from there.

    Ways are put together from both ends, so they double with each round, and a round writes only the nodes that
    have not met their joint yet.
    """
    single = edges.join(joints, F.col("child") == F.col("joint"), "left_anti")
    ways = single.select(F.col("child").alias("node"), F.col("parent").alias("up"), F.array("pos").alias("path"))

    def parted(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        met = rows.join(joints.withColumn("met", F.lit(True)), F.col("up") == F.col("joint"), "left")
        stored = written(met.select("node", "up", "path", F.coalesce("met", F.lit(False)).alias("met")), name)
        return stored.where("met").drop("met"), stored.where("not met").drop("met")

    done, open_ways = parted(ways, "sitemap-ways")
    for _ in range(ways.count().bit_length()):
        if open_ways.isEmpty():
            break
        above = done.unionByName(open_ways).select(F.col("node").alias("up"), F.col("up").alias("higher"), F.col("path").alias("before"))
        longer = open_ways.join(above, "up").select("node", F.col("higher").alias("up"), F.concat("before", "path").alias("path"))
        more, open_ways = parted(longer, "sitemap-ways")
        done = done.unionByName(more)
    return done  # what is left are rings that nothing leads to


def sitemap_tree(roots: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """(root, sitemap_url, path): every sitemap below each root, at its first place in reading order.

    Depth-first reading with a set of seen sitemaps visits each of them at its smallest simple path of entry
    positions.  A sitemap that only one index names has its path from there, so chains of these are put
    together first, in a logarithmic number of rounds.  Between the others, the joints, the smallest paths
    are relaxed: a round joins and writes only what the round before has made smaller; in a tree there is nothing
    to relax.  A child that is not in the table contributes nothing.
    """
    named = children(sitemaps).groupBy("parent", "child").agg(F.min("pos").alias("pos"))
    named = written(named, "sitemap-edges")
    starts = written(roots.select("root").where("root is not null").distinct(), "sitemap-roots")
    # A root that no index names is only read from its start.
    never = starts.join(named, F.col("root") == F.col("child"), "left_anti").select(F.col("root").alias("parent"))
    begun = starts.join(named, F.col("root") == F.col("parent")).select(_start("root").alias("parent"), "child", "pos")
    edges = written(named.join(never, "parent", "left_anti").unionByName(begun), "sitemap-edges")
    several = edges.groupBy("child").agg(F.count("*").alias("n")).where("n > 1").select(F.col("child").alias("joint"))
    joints = written(several.unionByName(starts.select(_start("root").alias("joint"))), "sitemap-joints")
    hung = _hung(edges, joints)

    into = edges.join(joints, F.col("child") == F.col("joint"), "left_semi")
    direct = into.join(joints, F.col("parent") == F.col("joint"), "left_semi").select("parent", "child", F.array("pos").alias("path"))
    through = into.join(hung, F.col("parent") == F.col("node")).select(F.col("up").alias("parent"), "child", F.concat("path", F.array("pos")).alias("path"))
    between = direct.unionByName(through).groupBy("parent", "child").agg(F.min("path").alias("step"))
    between = written(between, "sitemap-between")

    none = F.array().cast("array<bigint>")
    changed = written(starts.select("root", _start("root").alias("node"), none.alias("path"), F.array().cast("array<string>").alias("trail")), "sitemap-tree")
    places = changed
    while True:
        ahead = changed.join(between, F.col("node") == F.col("parent")).where(~F.array_contains("trail", F.col("child")))
        ahead = ahead.select("root", F.col("child").alias("node"), F.concat("path", "step").alias("path"), F.concat("trail", F.array("child")).alias("trail"))
        ahead = ahead.groupBy("root", "node").agg(F.min(F.struct("path", "trail")).alias("p")).select("root", "node", "p.*")
        best = places.groupBy("root", "node").agg(F.min("path").alias("best"))
        smaller = ahead.join(best, ["root", "node"], "left").where(F.col("best").isNull() | (F.col("path") < F.col("best"))).drop("best")
        changed = written(smaller, "sitemap-tree")
        if changed.isEmpty():
            break
        places = places.unionByName(changed)
    best = written(places.groupBy("root", "node").agg(F.min("path").alias("path")), "sitemap-places")
    below = best.withColumnRenamed("path", "before").withColumnRenamed("node", "up").join(hung, "up")
    found = best.unionByName(below.select("root", "node", F.concat("before", "path").alias("path")))
    return found.withColumnRenamed("node", "sitemap_url").join(sitemaps.select("sitemap_url").distinct(), "sitemap_url", "left_semi").select(
        "root", "sitemap_url", "path"
    )


def tree_urls(roots: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """(root, sitemap_url, path, pos, url): page URLs of each root sitemap in reading order."""
    found = locations(sitemaps)
    below = sitemap_tree(roots, sitemaps).join(found, "sitemap_url")
    direct = roots.select("root").distinct().join(found, F.col("root") == F.col("sitemap_url"))
    no_path = F.array().cast("array<bigint>")
    columns = ["root", "sitemap_url", "path", "pos", "url"]
    return below.select(*columns).unionByName(direct.withColumn("path", no_path).select(*columns))


def sitemap_union(sources: DataFrame, urls: DataFrame) -> DataFrame:
    """(site, url, source_ord, path, pos): URLs of all sitemaps of a site, each at its first place.

    ``sources`` is (site, source_ord, root); ``urls`` is the result of :func:`tree_urls`.
    """
    placed = sources.join(urls, "root").select("site", "url", F.struct("source_ord", "path", "pos").alias("place"))
    return placed.groupBy("site", "url").agg(F.min("place").alias("place")).select("site", "url", "place.*")


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(site, pos, sitemap_url) from (site, status, txt): Sitemap lines of robots files, in order."""
    lines = F.split("txt", rf"\r\n|[{fv.LINE_BREAK_CLASS}]")
    rows = robots.where(F.col("status") == 200).select("site", F.posexplode(lines).alias("pos", "line"))
    value = X.strip(F.regexp_extract("line", rf"(?i)^sitemap:[{fv.WHITE_SPACE_CLASS}]*(.+)", 1))
    return rows.select("site", F.col("pos").cast("bigint").alias("pos"), value.alias("sitemap_url")).where("sitemap_url <> ''")


def source_priority(sites: DataFrame, directives: DataFrame, candidates: DataFrame) -> DataFrame:
    """(site, source, pos, sitemap_url): where each site's URLs come from.

    All sitemaps named in robots; else the first usable well-known path; else the URL list (no
    sitemap).  ``candidates`` is (site, path, status, content_type), ``site`` being scheme and host.
    """
    rank = F.lit(None).cast("int")
    for i, path in enumerate(fv.SITEMAP_PATHS):
        rank = F.when(F.col("path") == path, i + 1).otherwise(rank)
    usable = candidates.where((F.col("status") == 200) & F.contains("content_type", F.lit("xml")))
    known = usable.select(
        "site", rank.alias("rank"), F.lit(0).cast("bigint").alias("pos"), F.concat("site", "path").alias("sitemap_url")
    ).where("rank is not null")
    options = directives.select("site", F.lit(0).alias("rank"), "pos", "sitemap_url").unionByName(known)
    best = options.groupBy("site").agg(F.min("rank").alias("rank"))
    chosen = sites.select("site").distinct().join(best, "site", "left").join(options, ["site", "rank"], "left")
    source = F.when(F.col("rank").isNull(), "url_list").when(F.col("rank") == 0, "robots").otherwise("well_known")
    return chosen.select("site", source.alias("source"), "pos", "sitemap_url")


def with_fallback(found: DataFrame, listed: DataFrame, site: str = "site") -> DataFrame:
    """URLs from sitemaps, and the URL list for the sites whose sitemaps gave none."""
    missing = listed.join(found.select(site).distinct(), site, "left_anti")
    return found.select(site, "url").unionByName(missing.select(site, "url"))
