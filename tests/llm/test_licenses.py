import re

import pytest
from data_llm import odd_rows

from foliomill.llm import license_scan as ls


def plain(text):
    """The rules once more, in plain Python."""
    ids = []

    def name(s):
        s = re.sub(r"[^a-z0-9.]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), s))
        return ls.SENTENCES.get(s.strip(" ."))

    for s in re.split(r"[.!?;:]+(?=[ \t\n\x0b\f\r\"')\]]|$)|\n[ \t\n\x0b\f\r]*\n", text or ""):
        whole = name(s)
        ids += [whole] if whole else [i for i in map(name, re.split(r"[\n\r]+", s)) if i]
    rest, found = ids, []
    for licence, wanted in ls.RULES:
        i, hit, left = 0, False, []
        while i < len(rest):
            if tuple(rest[i : i + len(wanted)]) == wanted:
                i, hit = i + len(wanted), True
                left.append(None)
            else:
                left.append(rest[i])
                i += 1
        rest = left
        if hit and licence not in found:
            found.append(licence)
    return ids, found


LONG = {i: s for s, i in ls.SENTENCES.items()}
TEXTS = [
    "Prose. Released under the MIT License.\nMore prose", "// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Title\nLicensed under CC BY 4.0", "Licensed under\n  CC BY-SA\n4.0.",
    ". ".join(LONG[i].capitalize() for i in ("bsd-grant", "bsd-source", "bsd-binary")) + ".",
    ". ".join(LONG[i].capitalize() for i in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")) + ". All rights reserved.",
    ". ".join(LONG[i] for i in ("mit-warranty", "mit-grant", "mit-notice")) + ".", ". ".join(LONG[i] for i in ("mit-grant", "mit-notice", "mit-warranty")) + ".\n\nReleased under the MIT License.",
    "The license of this is not known. Licensed by nobody.",
]


def test_every_known_sentence_is_reached():
    key = re.compile(ls.KEYWORD)
    for s in ls.SENTENCES:
        assert key.search(s) or s in {"licensed under cc by 4.0"}, s
        assert plain(s)[0] == [ls.SENTENCES[s]]
    assert {i for _, rule in ls.RULES for i in rule} <= set(ls.SENTENCES.values())


def test_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: (list(r.sentence_ids), list(r.licenses)) for r in ls.scan(docs).collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}
    assert [got[i][1] for i in range(9)] == [["MIT"], ["Apache-2.0"], ["GPL-3.0-only"], ["CC-BY-NC-4.0"], ["CC-BY-4.0"], ["CC-BY-SA-4.0"], ["BSD-2-Clause"], ["BSD-3-Clause", "All-Rights-Reserved"], ["MIT"]]


def test_odd_and_empty(odd, empty):
    rows = ls.scan(odd).collect()
    assert len(rows) == len(odd_rows()) and all(list(r.licenses) == [] for r in rows)
    assert ls.scan(empty).collect() == []


@pytest.mark.parametrize("name", ["documents"])
def test_given_documents(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (list(r.sentence_ids), list(r.licenses)) for r in ls.scan(docs).collect()}
    assert got == {i: plain(t) for i, t in texts.items()}
