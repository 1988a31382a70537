import re

from data_llm import SCHEMA, odd_rows

from foliomill.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                ids = windows.get(tuple(w[i : i + n]))
                if ids:
                    hit |= set(range(i, i + n))
                    found |= ids
        out.append((r[0], len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def benchmark(spark):
    rows = odd_rows()
    base = rows[9][1].split()
    items = [(1, " ".join(base[10:40])), (2, "Na, NA na."), (10, " ".join(base[20:33])), (3, None), (4, ""), (5, "日本 語"), (6, "w1"), (7, "!!")]
    return items, spark.createDataFrame(items, "item_id long, text string")


def test_matches_brute_force(spark, odd):
    items, table = benchmark(spark)
    for limit in (decontaminate.MAX_PATTERN_BYTES, 300):
        got = decontaminate.contamination(odd, table, max_pattern_bytes=limit).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got), key=str) == expected(odd_rows(), items)


def test_spans_lie_in_the_original(spark):
    text = "Ünïted, «hello»  BIG\tworld… and 日本 more"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([("a", "hello» big world")], "item_id string, text string")
    items2 = spark.createDataFrame([("a", "«Hello» big")], "item_id string, text string")
    assert decontaminate.contamination(docs, items).first().n_hit == 0
    span = decontaminate.contamination(docs, items2).first().spans[0]
    assert text[span["start"] : span["end"]] == "«hello»  BIG" and (span["first"], span["last"]) == (1, 2)


def test_clean_documents_keep_their_columns(spark, odd, empty):
    items, table = benchmark(spark)
    bad = [e[4] for e in expected(odd_rows(), items)]
    for limit in (decontaminate.MAX_PATTERN_BYTES, 300):
        kept = decontaminate.clean_documents(odd, table, max_pattern_bytes=limit)
        assert kept.columns == odd.columns and kept.count() == len(bad) - sum(bad)
        assert decontaminate.clean_documents(empty, table, max_pattern_bytes=limit).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean_documents(odd, none).count() == len(bad)
    assert decontaminate.contamination(spark.createDataFrame([], SCHEMA), none).collect() == []
