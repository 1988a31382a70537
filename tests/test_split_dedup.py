import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliomill.operators import dedup, filters, toc
from foliomill.operators.split import _chain, _chunk_effect, _composed, _number, _Segment, _sorted, greedy_split


def one_by_one(sizes, limit, fill=0):
    """The definition: record after record."""
    parts, part = [], 1
    for n in sizes:
        if fill > 0 and fill + n > limit:
            part, fill = part + 1, 0
        fill += n
        parts.append(part)
    return parts, fill


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.integers(1, 40), st.integers(0, 60))
def test_segment_rules(sizes, limit, fill):
    import numpy as np

    segment = _Segment(np.array(sizes, dtype=np.int64), limit)
    parts, left = one_by_one(sizes, limit, fill)
    assert segment.leave(fill) == (left, parts[-1] - 1)
    limits, fills, opened, zero_fill, zero_opened = segment.effect()
    if fill == 0:
        got = (zero_fill, zero_opened)
    else:
        at = int(np.searchsorted(limits, limit - fill, side="right"))
        got = (fill + sum(sizes), 0) if at == len(limits) else (fills[at], opened[at])
    assert got == (left, parts[-1] - 1)


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 30)), min_size=1, max_size=80),
    st.integers(1, 40), st.integers(1, 12), st.integers(0, 50), st.integers(2, 4),
)
def test_chunks_give_the_sequential_result(records, limit, chunk_rows, header, fan_in):
    import pandas as pd

    rows = [(o, i, n) for i, (o, n) in enumerate(records)]
    pdf = _sorted(pd.DataFrame(rows, columns=["output", "ord", "n_chars"]))
    pdf["header_chars"] = header
    pdf["chunk"] = pdf.index // chunk_rows
    effects = pd.concat([_chunk_effect(g, limit) for _, g in pdf.groupby("chunk")])
    nothing = (None, 0, 1, 0)
    straight = _chain(effects, limit, nothing)[0]
    # The same by composing tables: states of groups of chunks, then of the chunks in them.
    groups = pd.concat([_composed(g, limit, int(c)) for c, g in effects.groupby(effects["chunk"] // fan_in)])
    states = {c: state for c, *state in _chain(groups, limit, nothing)[0]}
    assert straight == [row for c, g in effects.groupby(effects["chunk"] // fan_in) for row in _chain(g, limit, tuple(states[c]))[0]]
    entries = {c: tuple(state[1:]) for c, *state in straight}
    got = pd.concat([_number(g.reset_index(drop=True), limit, entries[c]) for c, g in pdf.groupby("chunk")])
    for output, group in got.groupby("output"):
        sizes = [n for o, _, n in rows if o == output]
        assert group["part"].tolist() == one_by_one(sizes, limit, header)[0]
        assert group["seq"].tolist() == list(range(1, len(sizes) + 1))
        # Every part stays within the limit (part 1 with its header), or holds one record and empty ones.
        for part, members in group.groupby("part"):
            total = sum(rows[i][2] for i in members["ord"]) + (header if part == 1 else 0)
            assert total <= limit or sum(rows[i][2] > 0 for i in members["ord"]) <= 1


@pytest.mark.parametrize("sizes", [[10] * 700, [i * 37 % 50 for i in range(700)]])
def test_more_chunks_than_one_task_composes(spark, sizes):
    rows = [("a" if i < 600 else f"b{i // 20}", i, n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "output string, ord bigint, n_chars bigint")
    headers = df.select("output").distinct().withColumn("header_chars", F.lit(33).cast("bigint"))
    got = {}
    for r in greedy_split(df, 100, headers, rows_per_chunk=20, fan_in=3).orderBy("output", "ord").collect():
        got.setdefault(r.output, []).append((r.part, r.seq))
    for output, found in got.items():
        parts = one_by_one([n for o, _, n in rows if o == output], 100, 33)[0]
        assert found == list(zip(parts, range(1, len(parts) + 1), strict=True))


CASES = {
    "fits": [40, 60], "one over": [40, 61], "large first": [150, 10], "large middle": [10, 150, 10], "large last": [10, 150], "empty": [100, 0, 0, 1],
}


def test_hand_made_splits(spark):
    rows = [(name, i, n) for name, sizes in CASES.items() for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "output string, ord bigint, n_chars bigint")
    got = {}
    for r in greedy_split(df, 100).orderBy("output", "ord").collect():
        got.setdefault(r.output, []).append(r.part)
    assert got == {"fits": [1, 1], "one over": [1, 2], "large first": [1, 2], "large middle": [1, 2, 3], "large last": [1, 2], "empty": [1, 1, 1, 2]}


def test_header_counts_and_may_leave_part_one_alone(spark):
    df = spark.createDataFrame([("a", 0, 60), ("a", 1, 40), ("b", 0, 60)], "output string, ord bigint, n_chars bigint")
    headers = spark.createDataFrame([("a", 50)], "output string, header_chars bigint")
    got = [(r.output, r.part) for r in greedy_split(df, 100, headers).orderBy("output", "ord").collect()]
    assert got == [("a", 2), ("a", 2), ("b", 1)]


@pytest.mark.parametrize("rows_per_chunk", [10, 100, 10_000])
def test_one_output_may_hold_nearly_everything(spark, rows_per_chunk):
    rng = random.Random(7)
    rows = [("big" if rng.random() < 0.9 else f"s{rng.randint(0, 5)}", i * 13 - 500, rng.choice([0, 1, 20, 90, 250])) for i in range(400)]
    df = spark.createDataFrame(rows, "output string, ord bigint, n_chars bigint").repartition(5)
    got = {(r.output, r.ord): r.part for r in greedy_split(df, 100, rows_per_chunk=rows_per_chunk).collect()}
    want = {}
    for output in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == output]
        want.update({(output, r[1]): p for r, p in zip(mine, one_by_one([r[2] for r in mine], 100)[0], strict=True)})
    assert got == want


def docs(spark):
    rows = [(i, f"u{i}", "a" if i % 3 else "hot", "x" if i % 2 else "y") for i in range(60)] + [(99, "u99", "z", "x")]
    df = spark.createDataFrame(rows, "ord bigint, url string, content string, output string")
    return df.withColumn("content_md5", F.md5("content"))


def test_first_copy_wins_and_dedup_is_idempotent(spark):
    once = dedup.content_dedup(docs(spark))
    assert sorted(r.ord for r in once.collect()) == [0, 1, 99]
    assert sorted(r.ord for r in dedup.content_dedup(once).collect()) == [0, 1, 99]
    assert dedup.duplicates(docs(spark)).count() == 58
    assert sorted(r.ord for r in dedup.content_dedup(docs(spark), ["output"]).collect()) == [0, 1, 2, 3, 99]


def test_content_is_not_shuffled_to_find_winners(spark):
    plan = dedup.content_winners(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_first_n(spark):
    urls = spark.createDataFrame([(i, "g" if i < 90 else "h") for i in range(100)], "ord bigint, site string")
    assert [r.ord for r in filters.first_n(urls, 3).orderBy("ord").collect()] == [0, 1, 2]
    assert filters.first_n(urls, 0).count() == 100
    got = filters.first_n_per_group(urls, 4, "site").orderBy("ord").collect()
    assert [r.ord for r in got] == [0, 1, 2, 3, 90, 91, 92, 93]


def test_toc_length_is_known_without_the_text(spark):
    for n in (1, 9, 10, 123):
        kept = spark.createDataFrame([("o", i, f"t{i}", f"u{i}") for i in range(n)], "output string, ord bigint, title string, url string")
        entries = kept.withColumn("seq", F.col("ord") + 1)
        lines = [r.line for r in toc.toc_lines(entries).orderBy("line_no").collect()]
        text = "".join(line + "\n" for line in lines)
        assert toc.toc_headers(kept).first().header_chars == len(text)
        assert lines[4] == "1. [t0](u0)" and lines[-1] == "---" and lines[2] == f"Tổng số trang: **{n}**"
