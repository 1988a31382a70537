import random

import corpus_pipeline
import pytest
from test_decontaminate import expected as contaminated
from test_quality import measured
from test_simhash import components, plain_fingerprint

import __spark_entry__
from foliomill.llm import queries


def table(tmp_path, spark):
    rng = random.Random(12)
    words = ["the", "and", "thing", "ever", "shall", "into"] + [f"w{i}" for i in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    quiz = [(i, prose(30)) for i in range(5)]
    rows = [(i, prose(rng.randrange(20, 300))) for i in range(80)]
    rows += [(100, rows[3][1]), (101, rows[3][1] + " "), (102, "too short"), (103, "again and " * 40), (104, None), (105, "")]
    rows += [(110 + i, prose(40) + " " + quiz[i][1] + " " + prose(30)) for i in range(5)] + [(120, prose(2000) + " " + quiz[0][1])]
    secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows += [(130 + i, f'{prose(60)} token = "{secret[i:]}0{i}" {prose(9)}') for i in range(12)]
    rows += [(150 + i, f"{prose(60)} {rng.randrange(10**15, 10**16)} {prose(9)}") for i in range(12)]
    rows += [rows[5]]
    docs = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(quiz, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, quiz, secret


def test_stages_against_brute_force(spark, tmp_path, vocabulary_file):
    from tokenizers import Tokenizer

    docs, quiz, secret = table(tmp_path, spark)
    want = [d for d in docs if (m := measured(d[1]))[0] >= 10 and 100 * m[4] <= 20 * m[0]]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "simhash_dedup":
            root = components({plain_fingerprint(d[1]) for d in want})
            least = {}
            for d in want:
                r = root[plain_fingerprint(d[1])]
                least[r] = min(d, least.get(r, d))
            want = sorted(set(least.values()))
        elif name == "decontamination":
            bad = {e[0] for e in contaminated(want, quiz) if e[4]}
            assert bad == {110, 111, 112, 113, 114}
            want = [d for d in want if d[0] not in bad]
        elif name == "secret_scans":
            plain = {}
            for i, t, *_ in want:
                for k in range(12):
                    t = t.replace(f"{secret[k:]}0{k}", "[SECRET]")
                plain[i] = t
            want = [(d[0], plain[d[0]], d[2], d[3], len(plain[d[0]])) for d in want]
            assert sum("[SECRET]" in d[1] for d in want) == 12
        if name != "packing":
            assert now.columns == columns
            assert sorted(map(tuple, now.collect())) == sorted(want), name
    encode = Tokenizer.from_file(vocabulary_file).encode
    totals = {}
    for r in now.collect():
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.length
    assert totals == {d[0]: len(encode(d[1], add_special_tokens=False).ids) + 1 for d in want}


def test_run_is_its_stages(spark, tmp_path):
    table(tmp_path, spark)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_odd_documents(spark, odd, empty, sf_dir, tmp_path):
    table(tmp_path, spark)
    for start in (odd, empty):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == start.columns
        assert (docs.count() > 0) == (start is odd)


def test_rows_of_one_id_are_judged_one_by_one(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(3))
    rows = [(1, a, 1), (5, a, 2), (5, b, 3), (5, b, 3), (5, b, 4), (None, a, 5), (None, c, 6), (None, c, 6), (7, c + " ", 7), (None, "only here " + b[::-1], 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept int")
    for name in ("row", "_row", "scanned", "_scanned", "digest", "place", "fp"):
        docs = docs.withColumn(name, docs["_kept"] * 10)
    got = corpus_pipeline.simhash_dedup(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted((r.doc_id or 0, r.text, r._kept, r._row, r.digest) for r in got.collect())
    assert [(i, t) for i, t, *_ in kept] == sorted([(1, a), (5, b), (7, c + " "), (0, "only here " + b[::-1])])
    assert all(k * 10 == row == digest for _, _, k, row, digest in kept)
    quiz = spark.createDataFrame([(1, a)], "item_id long, text string")
    clean = corpus_pipeline.decontaminate.clean_documents(docs, quiz)
    assert clean.columns == docs.columns and {r._kept for r in clean.collect()} == {3, 4, 6, 7, 8}
    blocks = corpus_pipeline.decontaminate.clean_documents(docs, quiz.union(spark.createDataFrame([(2, "x " + a)], quiz.schema)), max_pattern_bytes=5000)
    assert blocks.columns == docs.columns and {(r._kept, r._row, r.row) for r in blocks.collect()} == {(k, 10 * k, 10 * k) for k in (3, 4, 6, 7, 8)}


def test_queries_are_registered():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(queries.QUERIES) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_on_given_tables(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    table = "pages" if name.startswith("op6") else "documents"
    n = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    rows = got.count()
    assert rows == n or name.startswith(("op4", "op5")) and rows > 0
