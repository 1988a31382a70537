import random
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from foliomill import fixed_values as fv
from foliomill.functions import urls as U
from foliomill.operators import filters


def apply(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_every_extension_is_skipped_in_the_path_only(spark):
    base = "https://x.example.org/a/file"
    paths = [base + e.upper() for e in fv.SKIP_EXTENSIONS]
    assert all(apply(spark, paths, U.is_skippable))
    kept = [f"{base}?f=a{e}" for e in fv.SKIP_EXTENSIONS] + [base + ".jsonl", base + ".html", "https://x.example.org.pdf"]
    assert not any(apply(spark, kept, U.is_skippable))
    assert apply(spark, [base + ".pdf;v=1", base + ".pdf#x"], U.is_skippable) == [True, True]


def test_ignored_patterns(spark):
    root = "https://x.example.org"
    skipped = ["/search.html", "/GENINDEX.html", "/download.html?x", "/a?print=1", "/tag/x", "/Category/x", "/author/", "/page/12", "/page/3/", "/page=4"]
    kept = ["/a?page=2", "/page/x", "/tags/x", "/author", "/page/3/x", "/a?noprint=1"]
    assert all(apply(spark, [root + p for p in skipped], U.is_skippable))
    assert not any(apply(spark, [root + p for p in kept], U.is_skippable))


def test_parts_agree_with_the_standard_library(spark):
    urls = [
        "https://u:p@h.example.org:8080/a/b;c/d;e?q=/x#f", "http://h", "//h/p", "/p/q", "mailto:a@b.c", "HTTP://H/P?", "https://h?x=1", "https://h#f", "a b://x", "",
    ]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(
        "u", U.scheme(F.col("u")).alias("s"), U.netloc(F.col("u")).alias("n"), U.path(F.col("u")).alias("p")
    )
    for row in got.collect():
        want = urlparse(row.u)
        path = want.path if want.scheme in ("http", "https", "") else want.path.split(";")[0]
        assert (row.s, row.n, row.p) == (want.scheme, want.netloc, path), row.u


def test_links_resolve_like_the_standard_library(spark):
    bases = ["https://h.example.org/a/b/c.html?x=1", "http://h.example.org", "http://h.example.org:8080/a/", "https://h.example.org/a//b"]
    hrefs = [
        "/p", "p", "../p", "./p", "../../../../p", "a/./b/../c/", "..", ".", "../", "./", "?q=1", "", "mailto:x@y.z", "javascript:void(0)",
        "//o.example.org/x/../y", "http://o.example.org/a/../b?c", "https://o.example.org", "p?x=/../y", "p//q", "a:b", "x;y=1/../z", "/..", "/a/b/..",
        "p?a=b?c", "/p?", "tel:123",
    ]
    pairs = [(b, h) for b in bases for h in hrefs]
    rows = spark.createDataFrame(pairs, "base string, href string")
    wrong = []
    for row in U.resolve(rows, "base", "href", "got").collect():
        want = urljoin(row.base, row.href)
        # An absolute or host-relative link is kept as written, and an empty query keeps its "?".
        as_written = row.href.startswith(("http", "//")) or row.href.endswith("?")
        if not as_written and row.got != want:
            wrong.append((row.base, row.href, row.got, want))
    assert wrong == []


def test_fragment_and_blanks_are_cut(spark):
    rows = spark.createDataFrame([("https://h/a#x", " #f "), ("https://h/a", "b#c#d"), ("https://h/a", "\n/b\tc ")], "base string, href string")
    got = [r.o for r in U.resolve(rows, "base", "href", "o").collect()]
    assert got == ["https://h/a", "https://h/b", "https://h/bc"]


def test_same_domain_counts_the_port_and_the_case(spark):
    rows = [("https://h:1/a", "https://h:1/b", True), ("https://h:1/a", "https://h/b", False), ("https://H/a", "https://h/b", False), ("http://h", "https://h", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", U.same_domain(F.col("a"), F.col("b"))).collect())


def test_slugs(spark):
    urls = ["https://docs.example.org/3/", "https://h:80/a b/ü", "/", "https://h/_x_-y"]
    assert apply(spark, urls, U.site_slug) == ["docs_example_org_3", "h_80_a_b", "default_scrape", "h_x_-y"]


@pytest.mark.parametrize("broadcast", [8 << 20, 0])
def test_pattern_tables(spark, monkeypatch, broadcast):
    """Thousands of patterns, against every URL with every pattern."""
    monkeypatch.setattr(filters, "BROADCAST_BYTES", broadcast)
    rng = random.Random(4)
    urls = ["https://x.org/" + "".join(rng.choice("abcé/.") for _ in range(rng.randrange(12))) for _ in range(300)] + ["", "a", None, "https://x.org/a"] * 2
    patterns = ["".join(rng.choice("abcé/.d") for _ in range(rng.randrange(3, 8))) for _ in range(2000)] + ["éé", "xyz", None, "https://x.org/ab", "a/b/c/d/e/f/g/h/i"]
    rows = spark.createDataFrame(list(enumerate(urls)), "ord int, url string")
    table = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    hit = {i for i, u in enumerate(urls) if u is not None and any(p in u for p in patterns if p is not None)}
    plan = filters.include_table(rows, table)
    assert sorted(r.ord for r in plan.collect()) == sorted(hit)
    assert "NestedLoop" not in plan._jdf.queryExecution().toString() and "Cartesian" not in plan._jdf.queryExecution().toString()
    assert sorted(r.ord for r in filters.exclude_table(rows, table).collect()) == sorted(i for i, u in enumerate(urls) if u is not None and i not in hit)
    for odd, kept in (([], len(urls)), ([None], len(urls)), (["", "q"], len(urls) - 2), (["q"], 0), (["x", "https://x"], sum("x" in (u or "") for u in urls)), (["/."], sum("/." in (u or "") for u in urls))):
        few = spark.createDataFrame([(p,) for p in odd], "pattern string")
        assert filters.include_table(rows, few).count() == kept, odd
