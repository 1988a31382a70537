import random
from collections import deque

from pyspark.sql import functions as F

from foliomill.operators import links, outcomes, sitemaps
from foliomill.sources.readers import read_robots, read_sitemaps, read_url_list

H = "https://h.example.org/"


def crawl(spark, edges, base, depth, include=(), exclude=(), fn=links.crawl):
    graph = spark.createDataFrame([(H + a, H + b, i) for i, (a, b) in enumerate(edges)], "src string, dst string, pos int")
    bases = spark.createDataFrame([(H + base,)], "base string")
    return {r.url.removeprefix(H): r.depth for r in fn(graph, bases, depth, include, exclude).collect()}


def test_smallest_depth_wins_and_cycles_end(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d"), ("d", "e")]
    assert crawl(spark, edges, "a", 2) == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert crawl(spark, edges, "a", 0) == {"a": 0}


def test_filters_stop_descent(spark):
    edges = [("a", "x/b"), ("x/b", "c"), ("a", "d"), ("d", "e"), ("a", "tag/t"), ("tag/t", "f"), ("a", "p.pdf")]
    assert crawl(spark, edges, "a", 3, exclude=["/x/"]) == {"a": 0, "d": 1, "e": 2}
    assert crawl(spark, edges, "a", 3, include=["/x/"]) == {"a": 0, "x/b": 1}
    assert crawl(spark, edges, "a", 3, include=["/x/"], fn=links.crawl_filtered) == {"x/b": 1}
    assert crawl(spark, edges, "a", 3, exclude=["org/a"]) == {}


def test_depths_are_shortest_paths(spark):
    rng = random.Random(3)
    edges = [(str(rng.randint(0, 40)), str(rng.randint(0, 40))) for _ in range(90)]
    want, queue = {"0": 0}, deque(["0"])
    while queue:
        at = queue.popleft()
        for a, b in edges:
            if a == at and b not in want and want[at] < 4:
                want[b] = want[at] + 1
                queue.append(b)
    assert crawl(spark, edges, "0", 4) == want


def test_page_links(spark):
    html = (
        '<a href="/x#f">1</a><a HREF=" y ">2</a><a href>3</a><a name="n">4</a><a href="http://o.example.org/">5</a>'
        "<!-- <a href='/no'> --><script>'<a href=\"/no\">'</script><a href='/a?b=1&amp;c=2'>6</a><a data-href='/no'>7</a><a href='mailto:x@y'>8</a>"
    )
    pages = spark.createDataFrame([(H + "d/p", html)], "url string, html string")
    assert [r.dst.removeprefix(H) for r in links.page_links(pages).orderBy("pos").collect()] == ["x", "d/y", "d/p", "a?b=1&c=2"]


def sm(*entries):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{e}</loc></sitemap>" for e in entries) + "</sitemapindex>"


def us(*urls):
    return '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + "".join(f"<url><loc> {u} </loc></url>" for u in urls) + "</urlset>"


def test_locations(spark):
    files = [
        ("plain", us("http://a/1", "http://a/2", "http://a/1", "http://a/x.pdf", "")),
        ("odd", "<urlset><url><loc>http://a/?x=1&amp;y=2</loc><image:image><image:loc>http://i/1</image:loc></image:image></url><loc><![CDATA[http://a/c]]></loc><url><loc>cut"),
        ("index", sm("http://c") + "<url><loc>http://ignored</loc></url>"),
    ]
    df = spark.createDataFrame(files, "sitemap_url string, xml string")
    got = [(r.sitemap_url, r.url) for r in sitemaps.locations(df).orderBy("sitemap_url", "pos").collect()]
    assert got == [("odd", "http://a/?x=1&y=2"), ("odd", "http://a/c"), ("plain", "http://a/1"), ("plain", "http://a/2")]


def depth_first(files, root):
    """The definition: read on, child by child, and skip children seen before."""
    import re

    seen, order = set(), []

    def read(url):
        for child in re.findall(r"<sitemap><loc>(.*?)</loc>", files[url]):
            if child not in seen:
                seen.add(child)
                if child in files:
                    order.append(child)
                    read(child)

    read(root)
    return order


def test_trees_are_read_depth_first(spark):
    rng = random.Random(11)
    trees = [
        {"r": sm("a", "b", "gone"), "a": sm("c", "r"), "b": us("http://x/1"), "c": sm("b", "a", "d"), "d": us("http://x/2")},
        {"r": us("http://x/1", "http://x/2")},
    ]
    for _ in range(4):
        names = ["r", *"abcdefg"]
        trees.append({n: sm(*[rng.choice(names) for _ in range(rng.randint(0, 4))]) for n in names})
    for files in trees:
        df = spark.createDataFrame(list(files.items()), "sitemap_url string, xml string")
        roots = spark.createDataFrame([("r",)], "root string")
        got = [r.sitemap_url for r in sitemaps.sitemap_tree(roots, df).orderBy("path").collect()]
        assert got == depth_first(files, "r")
    first = spark.createDataFrame(list(trees[0].items()), "sitemap_url string, xml string")
    urls = sitemaps.tree_urls(spark.createDataFrame([("r",)], "root string"), first).orderBy("path", "pos")
    assert [r.url for r in urls.collect()] == ["http://x/1", "http://x/2"]
    lone = spark.createDataFrame(list(trees[1].items()), "sitemap_url string, xml string")
    assert sitemaps.tree_urls(spark.createDataFrame([("r",)], "root string"), lone).count() == 2


def test_a_deep_tree_takes_few_rounds_and_writes_what_changed(spark, monkeypatch):
    depth = 1000
    files = {"r": sm("x", "0")} | {str(i): sm(*["leaf"] * (i == 700), str(i + 1)) for i in range(depth)} | {str(depth): us("http://x/1"), "leaf": us("http://x/2"), "x": us()}
    files |= {"ring": sm("ring2"), "ring2": sm("ring"), "r2": sm("500", "r2")}
    sizes = []
    stored = sitemaps.written

    def counted(df, name):
        out = stored(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(sitemaps, "written", counted)
    df = spark.createDataFrame(list(files.items()), "sitemap_url string, xml string")
    got = sitemaps.sitemap_tree(spark.createDataFrame([("r",)], "root string"), df).collect()
    paths = {r.sitemap_url: list(r.path) for r in got}
    assert len(got) == len(paths) == depth + 3
    assert paths[str(depth)] == [1] + [0] * 700 + [1] + [0] * 299 and paths["leaf"] == [1] + [0] * 700 + [0] and paths["x"] == [0]
    rounds = [n for name, n in sizes if name == "sitemap-ways"]
    assert len(rounds) <= 12 and sum(rounds) <= 12 * depth and [n for name, n in sizes if name == "sitemap-tree"] == [1, 1, 0]
    sizes.clear()
    two = sitemaps.sitemap_tree(spark.createDataFrame([("r",), ("r2",)], "root string"), df).collect()
    assert sorted(r.sitemap_url for r in two if r.root == "r2") == sorted(["r2", "leaf", *map(str, range(500, depth + 1))])
    # A joint or two: their rows alone are written again.
    assert sum(n for name, n in sizes if name == "sitemap-tree") < 20


def test_robots(spark):
    txt = "User-agent: *\nSitemap: http://a/1 \nSITEMAP:http://a/2\r\n  sitemap: http://no\nsitemap:   \nxsitemap: http://no\rsitemap:\thttp://a/3"
    df = spark.createDataFrame([("s", 200, txt), ("t", 404, txt)], "site string, status int, txt string")
    assert [(r.site, r.sitemap_url) for r in sitemaps.robots_sitemaps(df).orderBy("pos").collect()] == [("s", "http://a/1"), ("s", "http://a/2"), ("s", "http://a/3")]


def test_source_priority_and_fallback(spark):
    sites = spark.createDataFrame([(s,) for s in "abcd"], "site string")
    named = spark.createDataFrame([("a", 1, "m1"), ("a", 3, "m3")], "site string, pos bigint, sitemap_url string")
    probes = [("a", "/sitemap.xml", 200, "text/xml"), ("b", "/sitemap.xml", 404, "text/xml"), ("b", "/sitemap_index.xml", 200, "application/xml"),
              ("b", "/sitemap/", 200, "text/xml"), ("c", "/sitemap.xml", 200, "text/html"), ("c", "/other.xml", 200, "text/xml")]
    candidates = spark.createDataFrame(probes, "site string, path string, status int, content_type string")
    got = sorted((r.site, r.source, r.sitemap_url or "") for r in sitemaps.source_priority(sites, named, candidates).collect())
    assert got == [("a", "robots", "m1"), ("a", "robots", "m3"), ("b", "well_known", "b/sitemap_index.xml"), ("c", "url_list", ""), ("d", "url_list", "")]
    found = spark.createDataFrame([("a", "f")], "site string, url string")
    listed = spark.createDataFrame([("a", "l"), ("b", "l")], "site string, url string")
    assert sorted(tuple(r) for r in sitemaps.with_fallback(found, listed).collect()) == [("a", "f"), ("b", "l")]


def test_fetch_outcomes(spark):
    rows = [
        ("ok", 1, 200, None), ("forbidden", 1, 403, None), ("forbidden", 2, 200, None), ("missing", 1, 500, None), ("missing", 2, 404, None),
        ("down", 1, 500, None), ("down", 2, 502, None), ("down", 3, 503, None), ("late", 1, 500, None), ("late", 2, 200, None),
        ("slow", 1, 0, "timeout"), ("slow", 2, 0, "timeout"), ("slow", 3, 0, "timeout"), ("broken", 1, 0, "x"), ("broken", 2, 0, "y"), ("broken", 3, 0, "z"),
        ("unfinished", 1, 500, None),
    ]
    df = spark.createDataFrame(rows, "url string, attempt int, status int, error string")
    got = {r.url: (r.attempt, r.status, r.skipped, r.reason) for r in outcomes.fetch_outcome(df).collect()}
    assert got == {
        "ok": (1, 200, False, ""), "forbidden": (1, 403, True, "403 Forbidden"), "missing": (2, 404, True, "404 Not Found"),
        "down": (3, 503, True, "HTTP 503"), "late": (2, 200, False, ""), "slow": (3, 0, True, "Timeout"), "broken": (3, 0, True, "z"),
        "unfinished": (None, 0, True, "Max retries exceeded"),
    }


def test_freshness_is_strictly_under_a_day(spark):
    snapshot = spark.sql(
        "select * from values ('under', 200, timestamp_ntz'2024-01-01 12:00:01'), ('at', 200, timestamp_ntz'2024-01-01 12:00:00'), "
        "('over', 200, timestamp_ntz'2024-01-01 11:59:59'), ('failed', 500, timestamp_ntz'2024-01-02 11:00:00') t(url, status, fetched_at)"
    )
    urls = spark.createDataFrame([(i, u) for i, u in enumerate(["under", "at", "over", "failed", "new"])], "ord int, url string")
    now = F.expr("timestamp_ntz'2024-01-02 12:00:00'")
    assert [r.url for r in outcomes.reusable_set(urls, snapshot, now).collect()] == ["under"]
    assert sorted(r.url for r in outcomes.refetch_set(urls, snapshot, now).collect()) == ["at", "failed", "new", "over"]


def test_positions_of_repeated_and_unknown_urls(spark):
    pages = spark.createDataFrame([("a",), ("b",), ("z",)], "url string")
    urls = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "ord bigint, url string")
    assert {r.url: r.restored_ord for r in outcomes.order_restore(pages, urls).collect()} == {"a": 2, "b": 1, "z": None}
    assert {r.url: r.restored_ord for r in outcomes.order_restore(pages, urls, 9999).collect()}["z"] == 9999


def test_known_size_estimate(spark):
    urls = spark.range(523).select(F.lit("s").alias("site"))
    row = outcomes.size_estimate(urls, "site").first()
    assert (row.est_chars, row.est_parts, round(row.est_seconds)) == (2_615_000, 6, 157)


def test_file_readers(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("http://a/1  \n\n# no\n  # yes\n#http://a/2\nhttp://a/x.png\n", encoding="utf-8")
    got = [r.url for r in read_url_list(spark, str(tmp_path / "urls.txt")).orderBy("line_no").collect()]
    assert got == ["http://a/1", "# yes"]
    (tmp_path / "m.xml").write_text(us("http://a/1"), encoding="utf-8")
    assert sitemaps.locations(read_sitemaps(spark, str(tmp_path / "m.xml"))).first().url == "http://a/1"
    (tmp_path / "robots.txt").write_text("Sitemap: http://a/m.xml\n", encoding="utf-8")
    assert sitemaps.robots_sitemaps(read_robots(spark, str(tmp_path / "robots.txt"))).first().sitemap_url == "http://a/m.xml"


def test_a_hub_passes_its_links_on_once_for_many_bases(spark, monkeypatch):
    """1,100 bases of one site and some of another; all reach a hub with many links."""
    rng = random.Random(8)
    other = "https://o.example.org/"
    bases = [f"{H}b{i}" for i in range(1100)] + [f"{other}b{i}" for i in range(3)] + [f"{H}b5"]
    edges = [(b, f"{H if b.startswith(H) else other}hub") for b in bases] + [(f"{H}hub", f"{H}x{i}") for i in range(60)] + [(f"{other}hub", f"{other}y"), (f"{H}hub", f"{other}y")]
    edges += [(f"{H}b{rng.randrange(1100)}", f"{H}{rng.choice(['x', 'b', 'z'])}{rng.randrange(60)}") for _ in range(300)] + [(f"{H}x1", f"{H}deep"), (f"{H}x2", f"{H}deep")]
    ahead = {}
    for a, b in edges:
        if a.split("/")[2] == b.split("/")[2]:
            ahead.setdefault(a, set()).add(b)
    want = set()
    for base in set(bases):
        depth, queue = {base: 0}, deque([base])
        while queue:
            at = queue.popleft()
            for b in ahead.get(at, ()):
                if b not in depth and depth[at] < 3:
                    depth[b] = depth[at] + 1
                    queue.append(b)
        want |= {(base, url, n) for url, n in depth.items()}
    sizes = {}
    stored = links.written

    def counted(df, name):
        out = stored(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(links, "written", counted)
    graph = spark.createDataFrame([(a, b) for a, b in edges] + [(None, H), (H, None)], "src string, dst string")
    got = links.crawl(graph, spark.createDataFrame([(b,) for b in bases] + [(None,)], "base string"), 3).collect()
    assert len(got) == len(want) and {(r.base, r.url, r.depth) for r in got} == want
    # 1,100 bases and 60 links: a row per link and lane, not per link and base.
    lanes = 1 + -(-1100 // links.LANE) + 3
    assert sizes["crawl-2"] < lanes * 200 and sizes["crawl-3"] < lanes * 200


def test_large_sitemaps_are_read_in_pieces(spark, tmp_path):
    """The same as whole files, with comments over several entries and files that are cut."""
    from foliomill.sources.readers import read_entries

    rng = random.Random(2)
    head = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n<!-- <url><loc>http://no/1</loc></url> -->'
    entries = []
    for i in range(3000):
        entries.append(f"<url>\n <loc> http://a/p{rng.randrange(2000)}{rng.choice(['', '.pdf', '?x=1&amp;y=2'])} </loc><lastmod>2020</lastmod></url>\n")
        if i % 300 == 50:
            entries.append("<!-- a comment <url><loc>http://no/2</loc></url>\n" + "".join(f"<url><loc>http://no/{k}</loc></url>" for k in range(40)) + "-->")
        if i % 300 == 150:
            entries.append("<url><loc><![CDATA[http://a/?c&d <!-- e]]></loc></url><url><lastmod>1</lastmod></url><loc>http://a/alone</loc></url>")
    (tmp_path / "a.xml").write_text(head + "".join(entries) + "</urlset>")
    (tmp_path / "b.xml").write_text(head + "".join(entries[:500]) + "<url><loc>http://a/z</loc></url><url><loc>http://cut")
    (tmp_path / "c.xml").write_text(sm("http://a/child") + "<url><loc>http://a/ignored</loc></url>")
    (tmp_path / "d.xml").write_text("")
    (tmp_path / "e.xml").write_text("<urlset><url><loc>http://a/1</loc></url><!-- open <url><loc>http://no</loc></url><url><loc>http://no</loc></url>")
    whole = sitemaps.locations(read_sitemaps(spark, str(tmp_path / "*.xml"))).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        cut = read_entries(spark, str(tmp_path / "*.xml"))
        assert cut.where(F.endswith("sitemap_url", F.lit("a.xml"))).select("block").distinct().count() > 5
        placed = sitemaps.placed_entries(cut)
        got = sitemaps.entry_locations(placed).collect()
        assert sorted(r.url for r in got if "e.xml" in r.sitemap_url) == ["http://a/1"]
        assert sorted(map(tuple, (r for r in got if "e.xml" not in r.sitemap_url))) == sorted(map(tuple, (r for r in whole if "e.xml" not in r.sitemap_url)))
        bad = {(r.sitemap_url[-5:], r.reason): r.n for r in sitemaps.malformed_entries(placed).collect()}
        assert bad[("a.xml", "no location")] == 10 and bad[("a.xml", "not opened")] == 10 and bad[("b.xml", "no location")] == 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
