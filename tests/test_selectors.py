"""Selectors with children, siblings and positions, against a tree of its own."""

import random
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliomill.operators import content as C
from foliomill.operators.selectors import Matcher, _series, is_structural, parsed
from foliomill.operators.tokens import by_page, page_tokens


class Tree(HTMLParser):
    """The elements of well-formed HTML: (parent, tag, classes)."""

    def __init__(self):
        super().__init__()
        self.nodes, self.stack = [], [None]

    def handle_starttag(self, tag, attrs):
        self.nodes.append((self.stack[-1], tag, (dict(attrs).get("class") or "").split()))
        if tag not in ("br", "hr"):
            self.stack.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        if tag not in ("br", "hr"):
            self.stack.pop()


def fits(nodes, i, steps):
    """Whether element ``i`` ends the steps, by recursion."""
    combinator, test, positions = steps[-1].combinator, steps[-1].test, steps[-1].positions
    parent, tag, classes = nodes[i]
    want, *cls = test.split(".")
    if want not in ("", "*", tag) or not set(cls) <= set(classes):
        return False
    siblings = [j for j in range(len(nodes)) if nodes[j][0] == parent]
    for of_type, a, b in positions:
        rank = 1 + [j for j in siblings if not of_type or nodes[j][1] == tag].index(i)
        if not any(a * n + b == rank for n in range(0, 50)):
            return False
    if not combinator:
        return True
    before = [j for j in siblings if j < i]
    if combinator == ">":
        others = [parent]
    elif combinator == "+":
        others = before[-1:]
    elif combinator == "~":
        others = before
    else:
        others, up = [], parent
        while up is not None:
            others.append(up)
            up = nodes[up][0]
    return any(j is not None and fits(nodes, j, steps[:-1]) for j in others)


def random_html(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 4)):
        tag = rng.choice(["div", "p", "ul", "li", "b", "br"])
        cls = rng.choice(["", ' class="x"', ' class="y x"'])
        out.append(f"<{tag}{cls}>" if tag == "br" else f"<{tag}{cls}>{random_html(rng, depth + 1) if depth < 4 else 't'}</{tag}>")
    return "".join(out)


STEP = st.tuples(
    st.sampled_from(["div", "p", "ul", "li", "b", "br", "*", ".x", "li.y", "div.x"]),
    st.sampled_from(["", "", "", ":nth-child(2)", ":nth-child(2n+1)", ":nth-of-type(even)", ":first-child", ":first-of-type", ":nth-child(-n+2)", ":nth-child(2):nth-of-type(1)"]),
    st.sampled_from([" > ", " ", " + ", " ~ ", ">"]),
)


@given(st.lists(st.lists(STEP, min_size=1, max_size=4), min_size=1, max_size=3), st.integers(0, 10**6))
@settings(max_examples=300, deadline=None)
def test_bits_are_those_of_recursion(chains, seed):
    selector = ", ".join("".join((c if i else "") + t + p for i, (t, p, c) in enumerate(chain)) for chain in chains)
    tree = Tree()
    tree.feed(random_html(random.Random(seed)))
    steps = parsed(selector)
    want = [i for i in range(len(tree.nodes)) if any(fits(tree.nodes, i, chain) for chain in steps)]
    last = {}
    for i, (parent, _, _) in enumerate(tree.nodes):
        while parent is not None:
            last[parent] = i
            parent = tree.nodes[parent][0]
    matcher = Matcher(steps)
    got = []
    for i, (_, tag, classes) in enumerate(tree.nodes):
        tests = 0
        for bit, step in enumerate(s for chain in steps for s in chain):
            name, *cls = step.test.split(".")
            tests |= (name in ("", "*", tag) and set(cls) <= set(classes)) << bit
        if matcher.element(i, last.get(i, i), tag, tests, True) & matcher.final:
            got.append(i)
    assert got == want


def regions(spark, htmls, selector):
    pages = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")
    rows = C.with_region(page_tokens(by_page(pages)), selector).where("pos = region.pos").select("page_id", "token", "region.end").collect()
    return {r.page_id: r.token for r in rows}


def test_pages(spark):
    page = '<html><body><div id="a"><p>1</p><p id="b">2</p></div><div><b>x<p id="c">3</p><ul><li id="d">i<li id="e">j</ul><p id="f">4</p></div></body></html>'
    wanted = {
        "body > div > p:nth-child(2)": '<p id="b">', "div > p:nth-of-type(2)": '<p id="b">', "ul > li:nth-child(2)": '<li id="e">', "li + li": '<li id="e">',
        "div + div ul ~ p": '<p id="f">', "html>body>div:first-child": '<div id="a">', "[id='d'] + li": '<li id="e">', "body > p, #a > p:nth-child(odd)": "<p>",
        "b:nth-of-type(1) > #c": '<p id="c">',
    }
    for selector, token in wanted.items():
        assert regions(spark, [page, "<p>no such thing</p>"], selector) == {0: token}, selector


def test_an_element_that_is_not_closed_ends_with_its_parent(spark):
    page = '<div><p>one <b>bold</p><p id="x">two</p></div><p id="y">three</p>'
    assert regions(spark, [page], "div > p:nth-child(2)") == {0: '<p id="x">'}
    assert regions(spark, [page], "div + p") == {0: '<p id="y">'}
    assert regions(spark, [page], "b > p") == {}


def test_only_the_region_is_kept(spark):
    page = "<div><p>one</p><p>two</p></div>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    rows = C.clean_text(C.clean_tokens(by_page(pages), "div > p:nth-child(2)")).collect()
    assert [(r.page_id, r.text) for r in rows if r.text] == [(1, "two")]


def test_what_is_refused():
    for selector in ("", " , p", "> p", "p >", "p:last-child", "p:nth-child", "p:nth-child(x)", "p:hover", "p::before", "p:first-child(2)", "div >> p", "a|b"):
        with pytest.raises(ValueError):
            parsed(selector)
    with pytest.raises(ValueError):
        parsed(" > ".join(["p"] * 63))
    assert not is_structural("div.x [a='b:c > d'] p") and is_structural("div>p") and is_structural("p:first-child")
    assert [_series(t) for t in ("odd", "even", "3", "n", "-n+3", "2n - 1", "+3n+2")] == [(2, 1), (2, 0), (0, 3), (1, 0), (-1, 3), (2, -1), (3, 2)]
