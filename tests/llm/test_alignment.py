import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from foliomill.llm import alignment

ODD = ["▁ is a space to one", "a ▁b", "<|endoftext|> in <s> text </s>", "<0x41> and <unk>", "é́ 日本 👍👍", "  two  spaces ", "tab\tand\nline", "\x00 zero", "İß ﬁ"]


@pytest.fixture(scope="module")
def paths():
    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def byte_letters():
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(rows, paths):
    """Token by token, and pair by pair over all documents."""
    a_model, letters = Tokenizer.from_file(paths[0]), byte_letters()
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    shown, links_of, held = {}, {}, Counter()
    for text in {t for _, t in rows}:
        links_of[text], shown[text] = None, ""
        if not text:
            continue
        a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
        spelled_a = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
        spelled_b = []
        for i in b:
            p = b_model.id_to_piece(i)
            spelled_b.append(bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode())
        if b"".join(spelled_a) != (" " + text).encode() or b"".join(spelled_b) != (" " + text).encode():
            continue
        ranges_a, ranges_b, at = [], [], 0
        for s in spelled_a:
            ranges_a.append((at, at := at + len(s)))
        at = 0
        for s in spelled_b:
            ranges_b.append((at, at := at + len(s)))
        links_of[text] = [(x, y) for x, (s, e) in zip(a, ranges_a) for y, (t, u) in zip(b, ranges_b) if s < u and t < e]
        cuts = sorted({e for _, e in ranges_a} & {e for _, e in ranges_b})
        parts, low = [], 0
        for cut in cuts:
            parts.append("|".join(",".join(str(i) for i, (s, _) in zip(ids, r) if low <= s < cut) for ids, r in ((a, ranges_a), (b, ranges_b))))
            low = cut
        shown[text] = (len(a), len(b), len(cuts), ";".join(parts))
    for _, text in rows:
        held.update(set(links_of[text] or ()))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for doc, text in rows:
        links = links_of[text]
        if links is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, groups = shown[text]
            digest = hashlib.sha256(groups.encode()).hexdigest()
            out.append((doc, n_a, n_b, n_groups, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), digest))
    return sorted(map(str, out))


def short(rows):
    return [(r.doc_id, r.text if r.text is None or len(r.text) < 3000 else r.text[:3000]) for r in rows]


@pytest.mark.parametrize("block,part", [(1 << 20, 8 << 20), (100, 500)])
def test_measures_are_those_of_brute_force(spark, odd, paths, monkeypatch, block, part):
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "PART", part)
    rows = short(odd.select("doc_id", "text").collect()) + [(100 + i, t) for i, t in enumerate(ODD)] + [(200 + i, "the same text") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("a", "n_a", "text_key", "part", "count"):
        docs = docs.withColumn(name, docs["doc_id"])
    got = alignment.alignment(docs, *paths)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, paths)


def test_no_rows_and_no_tokens(spark, empty, paths):
    assert alignment.alignment(empty, *paths).collect() == []
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "▁")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.alignment(docs, *paths).collect()), key=str) == sorted([(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, None)], key=str)


def test_a_long_text(spark, paths):
    text = "Some words, and numbers 12345 too.\n" * 30_000
    row = alignment.alignment(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"), *paths).collect()[0]
    assert row.n_links == row.n_best + (row.n_links - row.n_best) and row.count_sum == 2 * row.n_links
    assert row.n_links == row.n_a + row.n_b - row.n_groups


def test_lines_and_symbols_are_put_together(paths):
    """Words known are not aligned again behind a line break or before symbols."""
    both, text = alignment.Tokenizers(*paths), "beta alpha, beta.\nalpha one;"
    both.texts(["alpha beta one.\nalpha one\nbeta"])
    aligned, align = [], both.align
    both.align = lambda pieces: aligned.extend(pieces) or align(pieces)
    got = both.measured([text])
    assert set(aligned) <= {"a", "a,", "a.", "a;"}
    both.texts = lambda texts: [align([f" {t}"]) for t in texts]
    for x, y in zip(got, both.measured([text]), strict=True):
        assert {k: list(v) if k in ("a", "b", "links") else v for k, v in x.items()} == {k: list(v) if k in ("a", "b", "links") else v for k, v in y.items()}
