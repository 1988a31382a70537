import itertools
import re
from collections import Counter

import pytest

from foliomill.llm import url_filter as uf
from foliomill.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://Example.ORG/es/1?x=1#y", "https://www.example.org/en/17", "https://a.org", "https://a.org?x", "https://a.org/", "ftp://x.com/fr/a",
    "https://x.com/de/a", "https://com/de/", "https://x.com.de/de/", "https://notexample.org/es/", "http://h:80/p/q#f?g", "a://b://c/d", "http:///p", "http://x.com#/de/", "HTTP://É.Com/fr/Ü",
]


def plain(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for rule, verdict in URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def no_labels(spark):
    return spark.createDataFrame([], "url string, bad boolean")


def test_explicit_rules(spark):
    pages = spark.createDataFrame([*enumerate(URLS), (3, URLS[3]), (None, None)], "page_id long, url string").selectExpr("*", "'mine' as host", "1 as tokens")
    got = uf.judge(pages, no_labels(spark), URL_RULES).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path, best = plain(URLS[r.page_id] if r.page_id is not None else None)
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == (best or (None, "allow"))
    assert uf.judge(pages.limit(0), no_labels(spark), URL_RULES).collect() == []
    with pytest.raises(ValueError):
        uf.judge(pages, no_labels(spark), [("a/", "allow")] * 1001)


def labelled_rows():
    rows = []
    for i in range(200):
        host = ["good.com", "spam.net", "mixed.org"][i % 3]
        word = ["news", "pills"][(i // 3) % 2]
        bad = host == "spam.net" or (host == "mixed.org" and word == "pills")
        rows.append((f"http://{host}/{word}/{i}", bad))
    return [*rows, (None, True), ("", False), ("http://good.com/x", None)]


def test_mined_rules_match_brute_force(spark):
    rows = labelled_rows()
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    tokens = {r.url: tuple(r.t) for r in labelled.select("url", uf.tokens_of(labelled.url).alias("t")).collect()}
    used = [(tokens[u], bad) for u, bad in rows if bad is not None and tokens[u]]
    least = max(uf.MIN_SUPPORT, uf.MIN_COUNT / len(used))
    both, every = Counter(), Counter()
    for t, bad in used:
        for n in range(1, 4):
            for c in itertools.combinations(t, n):
                every[c] += 1
                both[c] += bad
    rules = {c: both[c] / every[c] for c in every if both[c] / len(used) >= least - 1e-12 and both[c] / every[c] >= uf.MIN_CONFIDENCE}
    kept = {c: p for c, p in rules.items() if not any(s in rules and rules[s] >= p for n in range(1, len(c)) for s in itertools.combinations(c, n))}
    mined = uf.mine(labelled)
    assert {tuple(r.tokens): pytest.approx(r.confidence) for r in mined.collect()} == kept and kept

    asked = [f"http://{h}/{w}/9" for h in ("good.com", "spam.net", "mixed.org", "new.org") for w in ("news", "pills", "other")]
    pages = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
    asked_tokens = {r.page_id: set(r.t) for r in pages.select("page_id", uf.tokens_of(pages.url).alias("t")).collect()}
    for r in uf.judge(pages, labelled).collect():
        hits = [c for c in kept if set(c) <= asked_tokens[r.page_id]]
        assert r.verdict == ("block" if hits else "allow")
        if hits:
            assert r.mined == max((kept[c], " ".join(c)) for c in hits)[1]
