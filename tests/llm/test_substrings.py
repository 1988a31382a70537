import hashlib
import random

import pytest
from data_llm import odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from foliomill.llm import substring_dedup
from foliomill.llm.suffix_array import suffix_array


@given(st.one_of(st.binary(max_size=60), st.text("ab", max_size=80).map(str.encode), st.text("a", max_size=40).map(str.encode)), st.integers(1, 3))
@settings(max_examples=400, deadline=None)
def test_suffixes_are_in_order(text, times):
    text *= times
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_array([300 * c for c in text]) == suffix_array(text)


def test_segments_name_equal_windows_alike():
    rng = random.Random(4)
    text = bytes(rng.choice(b"abcd ") for _ in range(3000)) * 2
    key, first, stop, anchor = substring_dedup.segments(text)
    assert first[0] == 0 and stop[-1] == len(text) - 99 and (first[1:] == stop[:-1]).all()
    names = {}
    for k, f, s in zip(key.tolist(), first.tolist(), stop.tolist(), strict=True):
        for i in range(f, s):
            assert names.setdefault(text[i : i + 100], k) == k


def expected(rows, window=100):
    first, out = {}, []
    for r in rows:
        b = (r[1] or "").encode()
        place = -1 if r[0] is None else r[0]
        for i in range(len(b) - window + 1):
            first[b[i : i + window]] = min(first.get(b[i : i + window], (place, i)), (place, i))
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < (-1 if r[0] is None else r[0], i):
                gone[i : i + window] = b"\1" * window
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((r[0], len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got_of(found):
    out = []
    for r in found.collect():
        out.append((r.doc_id, r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("task,group", [(512, 1024), (1, 1024), (512, 2), (2, 3)])
def test_removal_matches_brute_force(spark, odd, task, group):
    """Also with limits so low that most segments are taken apart into windows."""
    # Of the two texts without an id one is null, so no two texts of one id differ.
    rows = odd_rows()
    assert got_of(substring_dedup.deduplicated(odd.repartition(4), 100, task, group)) == expected(rows)


def test_shared_passages(spark):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(180))
    other = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    rows = [(i, other(rng.randrange(150)) + (passage if i % 3 else passage[40:150]) + other(rng.randrange(150))) for i in range(60)]
    rows += [(100, passage * 4), (101, "ab" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for task, group in ((512, 1024), (3, 5)):
        assert got_of(substring_dedup.deduplicated(docs, 100, task, group)) == expected(rows)


def test_empty(empty):
    assert substring_dedup.deduplicated(empty).collect() == []


def test_only_what_shares_a_core_is_compared(monkeypatch):
    """Beside an anchor that others have too, a suffix array gets neither what is alone nor all bytes of a core."""
    rng = random.Random(9)
    text, other = (bytes(rng.choice(b"abcdefgh ") for _ in range(110)) for _ in range(2))
    rows = [(7, text, 1, 0, 40), (7, other[:20] + text[20:90] + other[90:], 2, 10, 40)]
    assert list(substring_dedup._shared(rows, 100)) == []
    rows[1] = (7, text[:105] + b"?" * 5, 2, 10, 40)
    groups, sizes = list(substring_dedup._shared(rows, 100)), []
    monkeypatch.setattr(substring_dedup, "suffix_array", lambda symbols: sizes.append(len(symbols)) or suffix_array(symbols))
    found = [r for batch in substring_dedup._compare(groups, 100) for r in batch.to_pylist()]
    assert sorted((r["doc"], i) for r in found for i in range(r["first"], r["stop"])) == [(2, i) for i in range(10, 16)]
    assert 2 * sum(sizes) < sum(len(p[0]) for g in groups for p in g)
