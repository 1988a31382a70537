import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from foliomill.llm.fill_middle import SkipList, fill_in_middle, restored, transform, unit_widths

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(text, doc_id):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.lists(st.integers(1, 50), max_size=300), st.integers(0, 5))
@settings(max_examples=200, deadline=None)
def test_a_rank_of_the_skip_list_is_a_sum_of_widths(widths, seed):
    units = SkipList(np.array(widths, np.int64), seed)
    before = np.concatenate(([0], np.cumsum(widths))).astype(int)
    assert [units.point(r) for r in range(len(widths) + 1)] == before.tolist()


def test_lanes_get_sparser_and_each_sums_to_the_whole():
    units = SkipList(np.arange(1, 100_001))
    assert 5 <= len(units.lanes) <= 20
    for below, lane in zip(units.lanes, units.lanes[1:]):
        assert len(lane[0]) < len(below[0])
        assert lane[0].sum() == 100_000 and lane[1].sum() == units.points


@given(st.text(alphabet=st.sampled_from(list("ab \t\n\x0b\x1c\xa0é日<PSM>👍")), max_size=60), st.integers(0, 400))
@settings(max_examples=500, deadline=None)
def test_texts_are_cut_as_by_units(text, doc_id):
    assert unit_widths(text).tolist() == [len(u) for u in UNITS.findall(text)]
    assert transform(text, doc_id) == brute(text, doc_id)


def test_blocks_do_not_show(monkeypatch):
    text = "ab  c d\n" * 50 + "  "
    for block in (1, 2, 3, 7):
        monkeypatch.setattr("foliomill.llm.fill_middle._BLOCK", block)
        assert unit_widths(text).tolist() == [len(u) for u in UNITS.findall(text)]


def test_rows_and_what_they_were_made_of(spark, odd, monkeypatch):
    more = spark.createDataFrame([(i, f"a<S b {i} <M c> <P d<") for i in range(40)] + [(7, "has <M> in it"), (8, "x y\n")], "doc_id long, text string")
    docs = odd.unionByName(more, allowMissingColumns=True)
    found = fill_in_middle(docs).withColumn("restored", restored())
    got = sorted(map(str, found.collect()))
    rows = docs.select("doc_id", "text").collect()
    want = [(r.doc_id, *brute(r.text, r.doc_id), r.text or "") for r in rows]
    assert sorted(str(tuple(w)) for w in want) == sorted(str(tuple(r)) for r in found.collect())
    assert len(got) == len(rows) and {w[2] for w in want} == {"plain", "psm", "spm"}


def test_no_rows(empty):
    assert fill_in_middle(empty).collect() == []
