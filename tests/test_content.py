import time

import pytest
from pyspark.sql import functions as F

from foliomill.functions import html as H
from foliomill.operators import content as C
from foliomill.operators.tokens import by_page, page_tokens, tokenize


def pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id bigint, html string")


def cleaned(spark, *htmls, selector=None):
    rows = C.clean_text(C.clean_tokens(by_page(pages(spark, *htmls)), selector)).collect()
    found = {r.page_id: r.text for r in rows}
    return [found.get(i, "") for i in range(len(htmls))]


def markdown(spark, *htmls):
    rendered = C.extract_tiers(C.render(C.blocks(C.clean_tokens(by_page(pages(spark, *htmls))))), C.finish_page, 1, 1)
    found = {r.page_id: r.content for r in rendered.collect()}
    return [found.get(i, "") for i in range(len(htmls))]


def kinds(spark, html):
    return [(r.kind, r.tag, r.token) for r in tokenize(pages(spark, html)).orderBy("pos").collect()]


def test_tokens(spark):
    got = kinds(spark, '<!DOCTYPE html><A HREF="a>b" title=\'x>y\'>t</a ><br/><img src=x/><div/>a < b<!-- <p> --><script>"</p>"</script>')
    assert [k[0] for k in got] == ["decl", "open", "text", "close", "void", "void", "void", "text", "text", "text", "comment", "raw"]
    assert got[1][1:] == ("a", '<A HREF="a>b" title=\'x>y\'>')


def test_tokens_lose_nothing(spark):
    html = '<p class=a href=/x/>1 < 2 <b x="un>closed>y</b><!-- open <i>z</i><script>never closed'
    assert "".join(k[2] for k in kinds(spark, html)) == html


def test_truncated_tags_take_linear_time(spark):
    html = "<p>text</p><div " + " ".join(f'data-{i}="v{i}"' for i in range(3000))
    start = time.time()
    assert tokenize(pages(spark, html, "<" * 20000, "<a " * 20000)).count() > 0
    assert time.time() - start < 20


def test_attributes(spark):
    cases = ['<a class="x  y">', "<a CLASS='x'>", "<a data-class=no class=x>", "<a>", '<a class="">', '<a id="&amp;">']
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(H.class_list(F.col("t"))).collect()] == ["x y", "x", "x", "", "", ""]
    assert df.select(H.attribute(F.col("t"), "id")).collect()[-1][0] == "&"


def test_code_language(spark):
    cases = ["a language-py b lang-js", "xlanguage-no", "highlight_sh", "language:", ""]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(H.code_language(F.col("t"))).collect()] == ["py", "", "sh", "", ""]


REGIONS = [
    ("<main>", "</main>"), ("<article>", "</article>"), ("<p role='main'>", "</p>"), ('<div class="a main-content">', "</div>"),
    ('<div id="content">', "</div>"), ('<div class="content">', "</div>"),
]


def test_region_kinds_and_their_priority(spark):
    htmls = []
    for i, (start, end) in enumerate(REGIONS):
        later = "".join(f"{s}low{e}" for s, e in reversed(REGIONS[i + 1 :]))
        htmls.append(f"<div>out</div>{later}{start}in{end}{start}second{end}<p>out</p>")
    assert cleaned(spark, *htmls) == ["in"] * 6


def test_no_region_means_the_whole_page(spark):
    assert cleaned(spark, '<title>t</title><div class="contents">a</div><section id="content">b</section>') == ["t|a|b"]


def test_selectors(spark):
    html = '<article>art</article><div class="x y" id="k"><ul><li>1</li><li class="z" data-q="v">2</li></ul></div>'
    wanted = {"div.x": "1|2", "#k li.z": "2", "div.x.y ul li": "1", "[data-q='v']": "2", "li[data-q]": "2", "span": "art|1|2", "article li": "art|1|2"}
    for selector, text in wanted.items():
        assert cleaned(spark, html, selector=selector) == [text], selector
    with pytest.raises(ValueError):
        cleaned(spark, html, selector="div:last-child")


def test_noise_is_removed_with_its_contents(spark):
    html = "<div><nav>n<div>n</div></nav>a<header><nav>n</nav>n</header>b<footer>n</footer><aside>n</aside><noscript>n</noscript>c</div>"
    assert cleaned(spark, html) == ["a|b|c"]


def test_noise_words_match_inside_class_and_id(spark):
    assert cleaned(spark, '<p class="download">x</p><p class="Shadow-sm">x</p><p id="TOC1">x</p><p data-class="ad">kept</p>') == ["kept"]
    assert cleaned(spark, '<body class="page-loading"><p>x</p></body>', '<body class="page-loading"><main>kept</main></body>', '<main class="ad">x</main>') == ["", "kept", ""]


def test_unclosed_and_stray_tags(spark):
    assert cleaned(
        spark,
        "<ul><li class=menu>x<li>kept</ul>",
        "<p class=ad>x<p>kept",
        "</div></div><div class=menu>x</div>kept",
        "<div class=menu>x<div>y</div>z</div>kept",
        "<b>a<b class=nav>x</b>kept",
        "<img class=ad>kept<div class=\"ad\"/>kept",
    ) == ["kept", "kept", "kept", "kept", "a|kept", "kept|kept"]


def test_titles(spark):
    cases = {
        "<title>A | B - C</title>": "A",
        "<title> A - B | C </title>": "A",
        "<title>A — B :: C</title>": "A",
        "<title>A|B</title>": "A|B",
        "<title></title><title>later</title><h1>x <b> y </b></h1>": "xy",
        "<title> </title>": "Untitled",
        "<!-- <title>no</title> --><script>'<title>no</title>'</script><h1>H &amp; I</h1>": "H & I",
        "<h1></h1>": "",
        "<p>x</p>": "Untitled",
    }
    got = pages(spark, *cases).select(H.page_title(F.col("html")).alias("t")).collect()
    assert [r.t for r in got] == list(cases.values())


def test_markdown_rendering(spark):
    got = markdown(
        spark,
        "<main><h1>T</h1><p>a <b>b</b> <em>c</em>\n <code>d</code></p><h3>x</h3>y</main>",
        "<main>before<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>after</main>",
        '<main>x<pre class="language-py">def f():\n    return  1\n</pre>y</main>',
        '<main>x<pre><code class="lang-js">a &lt; b</code></pre></main>',
        "<main>x<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td><p>2</p></td></tr></table>y</main>",
        "<main>x<blockquote><p>a</p><p>b</p></blockquote>y<hr>z<br>w</main>",
        "<main>unclosed <b>bold<p>new &copy; 1</main>",
        "<main>no <a href='/x'>link</a> or <img src=x alt=y> image, this text is longer than its link</main>",
    )
    assert got == [
        "# T\n\na **b** *c* `d`\n\n### x\n\ny",
        "before\n\n- a\n  - b\n- c\n\nafter",
        "x\n\n```py\ndef f():\n    return  1\n\n```\n\ny",
        "x\n\n```js\na < b\n\n```",
        "x\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\ny",
        "x\n\n> a\n\n> b\n\ny\n\n---\n\nz\nw",
        "unclosed bold\n\nnew © 1",
        "no link or image, this text is longer than its link",
    ]


def test_tiers(spark):
    rows = [(0, "x" * 100, "f"), (1, "x" * 99, "y" * 50), (2, "x" * 99, "y" * 49), (3, " " * 200, " " * 90)]
    got = C.extract_tiers(spark.createDataFrame(rows, "page_id int, precise string, full string")).orderBy("page_id").collect()
    assert [(r.tier, len(r.content)) for r in got] == [(1, 100), (2, 50), (0, 0), (0, 0)]


def test_link_lists_are_left_to_the_second_tier(spark):
    text = "<p>" + "word " * 30 + "</p>"
    links = "<ul>" + "".join(f"<li><a href='/{i}'>link number {i}</a></li>" for i in range(9)) + "</ul>"
    found = {r.page_id: (r.tier, "link number" in r.content) for r in C.page_content(by_page(pages(spark, f"<main>{text}{links}</main>", f"<main>{links}</main>"))).collect()}
    assert found == {0: (1, False), 1: (2, True)}


def test_one_exchange_serves_the_whole_extraction(spark):
    plan = C.page_content(by_page(pages(spark, "<p>x</p>")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert by_page(pages(spark, "<p>"), partitions=3).rdd.getNumPartitions() == 3


@pytest.mark.parametrize(
    "html,title,h1",
    [
        ("<h1>Open heading<p>x", "Open heading", "Open heading"),
        ("<h1>One<h2>Two</h2>", "One", "One"),
        ("<h1>Open</div><h1>Closed</h1>", "Open", "Open"),
        ("<h1>A <em>b</em></h1><p>c", "Ab", "Ab"),
        ("<h1> </h1><p>c", "", ""),
        ("<h1>to the end", "to the end", "to the end"),
        ("<p>none", "Untitled", ""),
        ("<title>T - S</title><h1>Open<p>x", "T", "Open"),
    ],
)
def test_headings_that_are_not_closed(spark, html, title, h1):
    row = spark.createDataFrame([(html,)], "html string").select(H.page_title(F.col("html")).alias("t"), H.h1_title(F.col("html")).alias("h")).first()
    assert (row.t, row.h) == (title, h1)


def test_full_tier_numbers_ordered_lists(spark):
    html = "<main><p>words before</p><ol start=4><li>four<li>five<ul><li>dot</ul><li>six</ol><ol><li>one<ol><li>deep</ol><li>two</ol></main>"
    got = C.page_content(by_page(pages(spark, html)), precise_min=10**6).first()
    assert (got.tier, got.content.split("\n")) == (
        2, ["words before", "", "4. four", "5. five", "  - dot", "6. six", "", "1. one", "  1. deep", "2. two"]
    )
    dashes = C.page_content(by_page(pages(spark, html)), precise_min=1).first()
    assert dashes.tier == 1 and "- five" in dashes.content


def test_noise_words_and_selector_lists(spark):
    html = "<div class='shadow-sm'><p>kept by word</p></div><div class='x ad'><p>gone</p></div><section><b>s</b></section><p id=q>q</p>"
    spans = page_tokens(by_page(pages(spark, html)))

    def words(**options):
        return [r.token for r in C.without_noise(spans, **options).where("kind = 'text'").orderBy("pos").collect()]

    assert words() == ["s", "q"] and words(match="word") == ["kept by word", "s", "q"]
    with pytest.raises(ValueError):
        words(match="other")
    region = C.with_region(spans, "section b, p#q").first().region
    token = {r.pos: r.token for r in spans.collect()}
    assert token[region.pos] == "<b>"
    with pytest.raises(ValueError):
        C.with_region(spans, "p, ,b")
