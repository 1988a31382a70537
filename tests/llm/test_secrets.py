import random
import re

from data_llm import odd_rows
from pyspark.sql import functions as F

from foliomill.llm import secret_scan as ss
from foliomill.storage import written

HEX = "0123456789abcdef"


def corpus(spark, n=160, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "in", "re", "ed", "at"]) for _ in range(rng.randrange(1, 4)))
    rows, truth = [], set()
    for i in range(n):
        words = [word() for _ in range(60)]
        kind = i % 4
        secret = "".join(rng.choice(HEX) for _ in range(40))
        if kind == 0:
            words[30] = f'token = "{secret}"'
            truth.add(secret)
        elif kind == 1:
            words[30] = str(rng.randrange(10**15, 10**16))
        elif kind == 2:
            words[30] = "".join(word() for _ in range(9))
        rows.append((i, " ".join(words), f"s{i % 3}"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), truth


def test_candidates_lie_in_the_text(spark, odd):
    texts = {}
    for r in odd_rows():
        texts.setdefault(r[0], []).append(r[1])
    found = ss.candidates(odd).collect()
    assert found
    for r in found:
        assert any((t or "")[r.start : r.start + len(r.candidate)] == r.candidate for t in texts[r.doc_id])
    want = sum(len(re.findall(ss.RUN, r[1] or "")) for r in odd_rows())
    assert len(found) == want


def test_held_out_accuracy(spark):
    """Trained on half of the documents, right on the other half."""
    docs, truth = corpus(spark)
    found = ss.candidates(docs)
    measured = ss.features(found, ss.vocabulary(docs)).cache()
    model = ss.train(ss.assigned_findings(measured.where("doc_id % 8 < 4")))
    held = ss.scored(measured.where("doc_id % 8 >= 4"), model).collect()
    right = sum(r.is_secret == (r.candidate in truth) for r in held)
    assert len(held) > 50 and right >= 0.97 * len(held)


def test_redaction(spark):
    docs, truth = corpus(spark)
    docs = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("_nth", F.lit("mine"))
    docs = docs.union(docs.where("doc_id < 2"))
    clean = ss.redacted(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in clean.collect():
        want = before[r.doc_id]
        for s in truth:
            want = want.replace(s, ss.PLACEHOLDER)
        assert r.text == want and r.n_chars == len(r.text)


def test_nothing_to_learn_from(spark, odd, empty):
    assert ss.findings(empty).collect() == []
    assert all(not r.is_secret for r in ss.findings(odd).collect())
    clean = ss.redacted(odd)
    assert sorted(map(str, clean.collect())) == sorted(map(str, odd.collect()))
    assert ss.redacted(empty).columns == empty.columns


def test_the_only_label(spark):
    docs = spark.createDataFrame([(1, 'password: "abc123abc123abc123def"', None)], "doc_id long, text string, source string")
    assert [r.is_secret for r in ss.findings(docs).collect()] == [True]


def test_prose_beside_a_secret_teaches_nothing(spark):
    """Words such as "shall" and "hotel" hold "sha" and "tel"; whole words count in the assigned name alone."""
    value = lambda i: f"{7**60 + 11**i:x}"[:40]
    lines = [
        'it shall token = "{}" in the hotel', 'discard a card number password: {} edshat', 'thousands shall, aws_secret_access_key={} hotel',
        'commit_sha = "{}"', "cardNumber: '{}'", 'marshall = "{}"', 'password_hash = "{}"', "a commit {} here",
    ]
    docs = spark.createDataFrame([(i, x.format(value(i)), "s") for i, x in enumerate(lines)], "doc_id long, text string, source string")
    found = ss.candidates(docs).where(F.col("candidate").rlike("^[0-9a-f]{40}$"))
    measured = ss.features(found, ss.vocabulary(docs))
    assert {r.doc_id: r.name for r in found.collect()} == dict(
        enumerate(["token", "password", "aws_secret_access_key", "commit_sha", "cardNumber", "marshall", "password_hash", ""])
    )
    assert {r.doc_id: r.label for r in ss.assigned_findings(measured).collect()} == {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0}


SHORT = {
    'password = "S3cret!pw9"': "S3cret!pw9", "secret: 'p@ss.word'": "p@ss.word", 'auth="user:pass@host"': "user:pass@host",
    "api_key=ab1.cd2.ef3, then": "ab1.cd2.ef3", "see x?token=q7&user=bob": "q7", "Authorization: Bearer a1b.c2d.e3f": "a1b.c2d.e3f",
    'pwd := "two words 1"': "two words 1", 'config["password"] = `x9`': "x9", '"secret": "a\\"b1",': 'a\\"b1', "passwd: geheim\u00df7.": "geheim\u00df7",
}


def test_assigned_values_of_any_length_are_candidates(spark):
    docs = spark.createDataFrame([(i, f"it is {x}", "s") for i, x in enumerate(SHORT)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.candidate, r.start) for r in ss.candidates(docs).collect()}
    assert got == {i: (v, len("it is ") + x.rindex(v)) for i, (x, v) in enumerate(SHORT.items())}
    none = [("the author: john1 says token and password, then", "s"), ('password = ""', "s"), ("secret =", "s")]
    assert ss.candidates(spark.createDataFrame([(i, *r) for i, r in enumerate(none)], "doc_id long, text string, source string")).count() == 0


def test_short_secrets_are_blanked_out(spark):
    docs, _ = corpus(spark)
    more = [(1000 + i, f"on the thin {x} there", "s1") for i, x in enumerate(SHORT)]
    clean = {r.doc_id: r.text for r in ss.redacted(docs.union(spark.createDataFrame(more, docs.schema))).collect()}
    for (i, text, _), value in zip(more[:4], SHORT.values()):
        assert clean[i] == text.replace(value, ss.PLACEHOLDER)


def test_candidates_are_not_broadcast(spark):
    """One line repeated packs into few bytes of a file, by which Spark would take its rows for few."""
    rows = [(i, f'token = "{HEX}" and more {i % 2}', "s1") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = written(ss.candidates(docs), "candidates")
    measured = ss.features(found, ss.vocabulary(docs))
    made = measured._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [candidate" in made
    assert measured.count() == found.count() == 300
