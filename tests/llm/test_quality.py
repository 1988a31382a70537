import random
import re
from collections import Counter

from data_llm import odd_rows

from foliomill.llm import quality


def measured(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    repeat = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat)


def test_measures_and_base_rules(spark, odd):
    want = []
    for r in odd_rows():
        m = measured(r[1])
        want.append((r[0], *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    got = quality.verdicts(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def hosts(spark):
    good, bad = "all good words stand here and no two of them are alike so keep", "short"
    rows = [(i, good, "fine") for i in range(40)] + [(100 + i, bad if i < 39 else good, "poor") for i in range(40)]
    rows += [(1000 + i, bad if i % 10 < 2 + i // 10 % 2 else good, f"usual{i // 10}") for i in range(300)]
    rows += [(200, bad, "once"), (201, good, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_hosts_are_shrunk_and_joined_back(spark):
    for limit in (100_000, 0):
        got = {r.doc_id: r for r in quality.verdicts(hosts(spark), max_broadcast_rows=limit).collect()}
        assert got[0].kept and got[201].kept
        assert not got[139].base_failed and got[139].host_rejected and not got[139].kept
        assert not got[200].host_rejected
        usual = {1000 + i for i in range(300) if i % 10 >= 2 + i // 10 % 2}
        assert {r.doc_id for r in quality.kept_documents(hosts(spark), max_broadcast_rows=limit).collect()} == {*range(40), 201, *usual}
    rates = {r.host: r for r in quality.host_rates(quality.measures(hosts(spark))).collect()}
    assert 39 / 40 > rates["poor"].short_rate > rates["once"].short_rate > rates["fine"].short_rate > 0


def test_chance_does_not_reject_a_host(spark):
    """A third of all documents fail, each on a host of its own: no host is known to be worse than another."""
    good, bad = "all good words stand here and no two of them are alike so keep", "short"
    rows = [(i, bad if i % 3 == 0 else good, f"h{i}") for i in range(300)]
    assert not any(r.host_rejected for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    # Two documents a host, dealt by chance.
    rng = random.Random(1)
    rows = [(i, bad if rng.random() < 0.3 else good, f"h{i % 150}") for i in range(300)]
    assert not any(r.host_rejected for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_failures_spread_over_rules_reject_a_host(spark):
    good, short, odd = "all good words stand here and no two of them are alike so keep", "short", "a # b # c # d # e # f # g # h # i # j # k"
    lines = "one line\n" * 30
    rows = [(i, good, f"fine{i % 5}") for i in range(200)]
    rows += [(1000 + i, [short, odd, lines, short, odd, lines, short, odd, lines, good][i % 10], "mixed") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    assert got[1009].host_rejected and not got[1009].base_failed and not got[1009].kept and got[0].kept
    rates = {r.host: r for r in quality.host_rates(quality.measures(docs)).collect()}["mixed"]
    assert max(rates.short_rate, rates.symbols_rate, rates.dup_lines_rate) < 0.6 and rates.any_rate > 0.75
    assert not any(r.host_rejected for r in quality.verdicts(docs, {"short": 0.6}).collect())


def test_empty(spark, empty, odd):
    assert quality.verdicts(empty).collect() == []
    assert quality.kept_documents(empty).columns == empty.columns and quality.kept_documents(empty).count() == 0
    assert quality.kept_documents(odd).columns == odd.columns
