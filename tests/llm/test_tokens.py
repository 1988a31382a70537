import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from data_llm import odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliomill.llm import packing, token_files
from foliomill.llm.tokens import Encoder

TEXTS = [r[1] for r in odd_rows()] + [
    "a  b", " a", "a ", "a \n b", "x\n y", "x \ny", "it's  we'll", "<|endoftext|> a <|endoftext|>", "tab\t  x", "\x1c x \x85 y\xa0 z", " x",
    "1 234 5a", "…  …", " " * 50, "a  b 　c",
]


@pytest.fixture(scope="module")
def both(vocabulary_file):
    return Tokenizer.from_file(vocabulary_file), Encoder(vocabulary_file)


def same(both, text):
    plain, encoder = both
    want = plain.encode(text or "", add_special_tokens=False).ids
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == want
    return want


def test_ids_are_those_of_the_whole_text(both, monkeypatch):
    for t in TEXTS:
        same(both, t)
    monkeypatch.setattr("foliomill.llm.tokens.REMEMBERED", 3)
    for t in TEXTS:
        same(both, t)


@given(st.text(alphabet=st.sampled_from(list("ab'sX1 \n\t\x0b\x1c\x85\xa0 ​᠎.é日")), max_size=30))
@settings(max_examples=400, deadline=None)
def test_ids_of_any_text(both, text):
    same(both, text)


@given(st.lists(st.sampled_from(["ab", "X", "é", "1", "日", "'s", "'", "&&", "***", ".", "|>", "<|endoftext|>", " ", " ", "\n", "\n", "\r", "\t", "᠎"]), max_size=12).map("".join))
@settings(max_examples=400, deadline=None)
def test_ids_of_words_with_symbols_and_line_breaks(both, text):
    same(both, text)


def test_line_breaks_and_symbols_need_no_new_encoding(both, vocabulary_file, monkeypatch):
    encoder, asked = Encoder(vocabulary_file), []
    known = "zero one two three four\none\ntwo\nthree\nfour one*** two&&"
    assert np.frombuffer(encoder.ids(known), "<u4").tolist() == both[0].encode(known, add_special_tokens=False).ids
    library = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda pieces: asked.extend(pieces) or library(pieces))
    monkeypatch.setattr(encoder, "_lines", lambda pieces: asked.extend(pieces) or library([f" {p}" for p in pieces]))
    text = "zero four\nthree two\none three***\nfour&& one\ntwo&&"
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == both[0].encode(text, add_special_tokens=False).ids
    assert asked == ["zero"]


def tokens_of(both, rows):
    return [(r[0], both[0].encode(r[1] or "", add_special_tokens=False).ids) for r in rows]


def test_cuts_fill_their_classes():
    for n in range(1, 5000):
        cut = packing.cuts(n)
        assert sum(length for length, _ in cut) == n
        for length, k in cut:
            assert k * length <= packing.CAPACITY and (k >= packing.TAIL_CLASSES or length == packing.CAPACITY // k)


@pytest.mark.parametrize("capacity,tails", [(2048, 32), (100, 7), (16, 1)])
def test_packing_keeps_every_id_once(spark, odd, both, vocabulary_file, capacity, tails):
    got = packing.pack(odd.repartition(5), vocabulary_file, capacity, tails).collect()
    want = defaultdict(list)
    for doc, ids in tokens_of(both, odd_rows()):
        want[doc].append(np.array([*ids, 1], "<u4"))
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    assert set(pieces) == set(want)
    for doc, ids in want.items():
        found = sorted((p.start, p.length, p.ids_crc32) for p in pieces[doc] if p.doc_tokens in {len(x) for x in ids})
        assert sum(p.length for p in pieces[doc]) == sum(map(len, ids))
        if len(ids) == 1:
            at = 0
            for start, length, crc in found:
                assert start == at and zlib.crc32(ids[0][start : start + length].tobytes()) == crc
                at += length
    if capacity == 2048:
        total = sum(r.length for r in got)
        assert len(sequences) * capacity - total < 0.05 * total + capacity


def test_packing_nothing(empty, vocabulary_file):
    assert packing.pack(empty, vocabulary_file).collect() == []


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 9, 1000, 65_536):
        for top in (1, 2, 60_000, 1 << 32):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype("<u4")
            planes = token_files.to_planes(ids, kind)
            assert len(planes) == token_files.PLANES[kind]
            assert np.array_equal(token_files.from_planes(planes, n, kind), ids)


@pytest.mark.parametrize("kind,block", [("bit", 1000), ("byte", 64)])
def test_files_round_trip(spark, odd, both, vocabulary_file, tmp_path, kind, block):
    root = f"file://{tmp_path}/out"
    manifest = token_files.write(odd, vocabulary_file, root, kind=kind, block_ids=block, partitions=4)
    got = sorted(map(tuple, token_files.read_documents(manifest, root).collect()), key=lambda r: r[1])
    want = sorted(((d is not None, d or 0, d, np.array([*ids, 0], "<u4")) for d, ids in tokens_of(both, odd_rows())), key=lambda x: x[:2])
    assert [g[0] for g in got] == [w[2] for w in want]
    assert sorted((str(g[0]), g[2], g[3]) for g in got) == sorted((str(w[2]), len(w[3]), zlib.crc32(w[3].tobytes())) for w in want)
    start = 0
    for g in got:
        assert g[1] == start
        start += g[2]
    assert manifest.count() > 1
    row = manifest.orderBy("part").first()
    with open(f"{tmp_path}/out/{row.file}", "rb") as f:
        reader = token_files.TokenFileReader(f, row.n_bytes)
        every = reader.ids(0, row.n_ids)
        rng = random.Random(2)
        for _ in range(30):
            a = rng.randrange(row.n_ids)
            n = rng.randrange(0, min(3 * block, row.n_ids - a) + 1)
            assert np.array_equal(reader.ids(a, n), every[a : a + n])


def test_damage_is_noticed(tmp_path):
    path = tmp_path / "x.tokens"
    with open(path, "wb") as f:
        writer = token_files.TokenFileWriter(f, block_ids=16)
        writer.add(5, np.arange(40, dtype="<u4").tobytes())
        writer.add(None, b"")
        writer.close()
    data = bytearray(path.read_bytes())
    with open(path, "rb") as f:
        assert [d[:3] for d in token_files.TokenFileReader(f, len(data)).documents()] == [(5, 0, 40), (None, 40, 0)]
    data[12] ^= 0xFF
    path.write_bytes(data)
    with open(path, "rb") as f, pytest.raises(Exception):
        list(token_files.TokenFileReader(f, len(data)).documents())


def test_no_files(empty, vocabulary_file):
    assert token_files.round_trip(empty, vocabulary_file).collect() == []
