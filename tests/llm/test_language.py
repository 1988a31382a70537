import random

from pyspark.sql import functions as F

from foliomill.llm import language_id as li

SYLLABLES = {"en": ["the", "ing", "and", "th", "sh"], "de": ["ein", "sch", "ung", "ch", "ver"], "fr": ["que", "eau", "ré", "ou", "èr"]}
EVIDENCE = "doc_id long, host string, domain string, markup string, path string"


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(spark, n=300):
    rng = random.Random(6)
    rows, pages = [], []
    for i in range(n):
        lang = ["en", "de", "fr"][i % 3]
        rows.append((i, text(rng, lang, rng.randrange(5, 60)), lang, f"s{i % 5}"))
        if i % 2:
            pages.append((i, f"www.{lang}{i % 4}.net", f"{lang}{i % 4}.net", lang if i % 10 else "en", f"/{lang}/{i}"))
    return rows, pages


def test_held_out_accuracy(spark):
    rows, pages = corpus(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    known = docs.withColumn("lang", F.when(F.col("doc_id") % 7 < 4, F.col("lang")))
    got = {r.doc_id: r.lang for r in li.identify(known, spark.createDataFrame(pages, EVIDENCE)).collect()}
    held = [r for r in rows if r[0] % 7 >= 4]
    assert sum(got[r[0]] == r[2] for r in held) >= 0.97 * len(held)


def test_other_evidence_decides_where_text_does_not(spark):
    rows, pages = corpus(spark)
    rows += [(1000 + i, None, None, None) for i in range(4)] + [(1001, "", None, None)]
    pages += [(1000, "x.de", "x.de", None, "/"), (1001, None, None, "fr", "/"), (1002, "www.fr1.net", "fr1.net", None, "/1"), (1003, "q.com", "q.com", "zz", "/")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit(1))
    got = li.identify(docs, spark.createDataFrame(pages, EVIDENCE)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r.lang for r in got}
    assert (by_id[1000], by_id[1001], by_id[1002]) == ("de", "fr", "fr") and by_id[1003] in SYLLABLES


def test_all_pages_of_a_document_count(spark):
    rows, pages = corpus(spark)
    # No text: two of three pages, and a host that only later pages of other documents make known.
    rows += [(2000, None, None, None), (2001, None, None, None)] + [(2100 + i, rows[3 * i + 2][1], "fr", None) for i in range(30)]
    pages += [(2000, "a.com", "a.com", "en", "/"), (2000, "b.com", "b.com", "de", "/"), (2000, "c.com", "c.com", "de", "/")]
    pages += [(2001, "z.later.org", "later.org", None, "/")] + [(2100 + i, host, host, None, "/") for i in range(30) for host in ("a.first.org", "z.later.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = li.identify(docs, spark.createDataFrame(pages, EVIDENCE)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[2000].lang == "de" and by_id[2000].host == "a.com"
    assert by_id[2001].lang == "fr"


def test_declarations(spark):
    rows = [('<!DOCTYPE html><HTML class=x LANG="De-at">',), ("<html lang=fr>",), ("<html>",), (None,), ("<p lang='es'>",)]
    got = spark.createDataFrame(rows, "h string").select(li.markup_language(F.col("h")).alias("x"))
    assert [r.x for r in got.collect()] == ["de", "fr", None, None, None]
    urls = spark.createDataFrame([("a.at", "/"), ("a.com", "/de/1"), ("a.com", "/deep/"), (None, None), ("x.fr", "/de/")], "h string, p string")
    got = urls.select(li.suffix_language(F.col("h"), F.col("p"), ["de", "fr"]).alias("x"))
    assert [r.x for r in got.collect()] == ["de", "de", None, None, "fr"]


def test_odd_and_empty(spark, odd, empty):
    pages = spark.createDataFrame([(1, None, None, None, None), (None, "a.b", "a.b", "en", "/")], EVIDENCE)
    got = li.identify(odd, pages).collect()
    assert len(got) == odd.count() and {r.lang for r in got} == {"en"}
    assert li.identify(empty, pages).collect() == []
    assert {r.lang for r in li.identify(odd.withColumn("lang", F.lit(None).cast("string")), pages).collect()} == {None}
