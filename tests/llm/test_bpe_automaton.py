import json
import random
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliomill.llm.bpe_automaton import Automaton, Codec, arc_labels, checked, compiled, decode, emitted, encode


def merged(symbols, merges):
    """BPE by its definition: the first rule that fits anywhere, leftmost place first."""
    symbols = list(symbols)
    while True:
        found = min(((r, i) for i in range(len(symbols) - 1) for r, m in enumerate(merges) if m == (symbols[i], symbols[i + 1])), default=None)
        if found is None:
            return symbols
        i = found[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def random_merges(rng, letters, n, end=""):
    tokens = [*letters, *([c + end for c in letters] if end else [])]
    merges = []
    for _ in range(200):
        u, v = rng.choice(tokens), rng.choice(tokens)
        if not (end and u.endswith(end)) and u + v not in tokens and len(merges) < n:
            merges.append((u, v))
            tokens.append(u + v)
    return tokens, merges


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("end", ["", "</w>"])
def test_all_short_words_of_random_merges(seed, end):
    rng = random.Random(seed)
    tokens, merges = random_merges(rng, "ab" if seed % 2 else "abc", 12, end)
    vocabulary = {t: i for i, t in enumerate(tokens)}
    automaton = Automaton(vocabulary, merges, end)
    for n in range(1, 9 if seed % 2 else 7):
        for word in product("ab" if seed % 2 else "abc", repeat=n):
            want = merged(automaton.symbols("".join(word)), merges)
            assert [automaton.labels[i] for i in automaton.encode("".join(word))] == want


def test_a_token_that_two_merges_make_is_refused():
    with pytest.raises(ValueError):
        Automaton({t: i for i, t in enumerate(["a", "b", "ab", "ba", "aba"])}, [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "ba")])


def test_unknown_symbols_are_an_error():
    with pytest.raises(ValueError):
        Automaton({"a": 0}, []).encode("ax")


@pytest.fixture(scope="module")
def path():
    return str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def both(path):
    data, automaton = compiled(path)
    return Tokenizer.from_file(path), Codec(data, automaton), arc_labels(checked(data))


def same(both, text):
    plain, codec, labels = both
    want = plain.encode(text, add_special_tokens=False).ids
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert emitted(ids, labels) == plain.decode(want, skip_special_tokens=False)


LETTERS = list("abtheins'S1 \n\t\x0b\x1c\x85\xa0​᠎İßΣé́日.!<|>👍힣") + ["<|endoftext|>", "<|startoftext|>", "'re", "ing"]


@given(st.lists(st.sampled_from(LETTERS), max_size=30))
@settings(max_examples=500, deadline=None)
def test_any_text_is_encoded_as_by_the_library(both, letters):
    same(both, "".join(letters))


def test_long_words_and_forgotten_pieces(both, monkeypatch):
    monkeypatch.setattr("foliomill.llm.bpe_automaton.REMEMBERED", 6)
    rng = random.Random(1)
    same(both, "".join(rng.choice("abcdehinst") for _ in range(100_000)))
    for _ in range(20):
        same(both, " ".join(rng.choice(["the", "cat's", "<|endoftext|>", "naïve", "x1y2", "😀😀"]) for _ in range(50)))


def test_other_kinds_of_files_are_refused(path):
    described = json.loads(open(path, encoding="utf-8").read())
    described["model"]["byte_fallback"] = True
    with pytest.raises(ValueError):
        checked(json.dumps(described))


def test_rows(spark, odd, empty, both, path, monkeypatch):
    more = spark.createDataFrame([(1, "The <|endoftext|>end"), (None, "It's  a 12 test")], "doc_id long, text string")
    docs = odd.unionByName(more, allowMissingColumns=True)
    got = decode(encode(docs, path), path).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = both[0].encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, tuple(ids), both[0].decode(ids, skip_special_tokens=False)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.text)) for r in got)
    assert decode(encode(empty, path), path).collect() == []
