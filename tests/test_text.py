import html
import json

import pytest
from pyspark.sql import functions as F

from foliomill.functions import formats as R
from foliomill.functions import text as X


def apply(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_strip_is_unicode_aware(spark):
    assert apply(spark, ["\u3000 a\u00a0\u2028", "\x1c\x1fb\x85", "\u200bc"], X.strip) == ["a", "b", "\u200bc"]


def test_entities_agree_with_the_standard_library(spark):
    cases = ["&amp;lt;", "a &lt; b &gt; c", "&eacute;&nbsp;&euro;", "&#233;&#xE9;&#x1F600;", "&unknown; & &;", "100%", "&quot;&apos;", "&middot;&copy;"]
    assert apply(spark, cases, X.decode_entities) == [html.unescape(c) for c in cases]


def test_invalid_code_points_vanish(spark):
    assert apply(spark, ["a&#0;b", "a&#xD800;b", "a&#x110000;b", "a&#65", "&#"], X.decode_entities) == ["ab", "ab", "ab", "aA", "&#"]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("a  \nb\t\u00a0\n", "a\nb"),
        ("a\n | | \nb", "a\nb"),
        ("|\n||\nx\n|", "x"),
        ("a | b\n|c|", "a | b\n|c|"),
        ("a\n\n\n\n\nb", "a\n\nb"),
        ("a\n```py\nx\n```\nb", "a\n\n```py\nx\n\n```\n\nb"),
        ("```\nx", "```\n\nx"),
        ("a\u2028b\x0bc\r\nd\re", "a\nb\nc\nd\ne"),
        ("", ""),
        ("  \n|\n ", ""),
    ],
)
def test_clean_markdown(spark, given, expected):
    assert apply(spark, [given], X.clean_markdown) == [expected]


def test_chunks_pack_paragraphs_and_keep_large_ones_whole(spark):
    texts = ["short", "aaa\n\nbbb\n\nccc", "x" * 25 + "\n\ny", "\n\n\n\n" + "b" * 9 + "\n\nccc", "aaaaaaaa\n\n\n\nbb\n\nc"]
    got = apply(spark, texts, lambda c: X.chunk_text(c, 10))
    assert got[0] == ["short"]
    assert got[1] == ["aaa\n\nbbb", "ccc"]
    assert got[2] == ["x" * 25, "y"]
    assert got[3] == ["b" * 9, "ccc"]
    assert got[4] == ["aaaaaaaa", "bb\n\nc"]


def test_summary_helpers(spark):
    words = " ".join(str(i) for i in range(71))
    assert apply(spark, [words, " a b "], X.summary_clamp) == [" ".join(str(i) for i in range(60)) + "...", "a b"]
    prompt = apply(spark, ["x" * 4000], lambda c: X.summary_input(F.lit("T"), c))[0]
    assert prompt.endswith("\n" + "x" * 3000) and prompt.startswith("Tiêu đề: T\n\n")


def test_noise_characters(spark):
    assert apply(spark, ["a\u00a0b\u200bc\ufeff\x07d\te\nf"], X.strip_noise_chars) == ["a bcd\te\nf"]


def test_iso_timestamp(spark):
    rows = spark.sql("select timestamp'2024-01-02 03:04:05.5' a, timestamp'2024-01-02 03:04:05' b")
    row = rows.select(X.iso_timestamp(F.col("a")), X.iso_timestamp(F.col("b"))).first()
    assert tuple(row) == ("2024-01-02T03:04:05.500000+00:00", "2024-01-02T03:04:05+00:00")


def test_json_line_is_what_the_standard_library_writes(spark):
    contents = ["plain", 'quote " and \\ and /', "line\nbreak\ttab\r\b\f.", "ctrl \x01\x1f\x0b \x7f", "é 📑 \u2028.", "\\u000b stays"]
    got = apply(spark, contents, lambda c: R.json_line(F.lit("t"), F.lit("u"), c, F.lit("now")))
    want = [json.dumps({"url": "u", "title": "t", "content": c, "collected_at": "now"}, ensure_ascii=False) + "\n" for c in contents]
    assert got == want


def test_page_block(spark):
    block = apply(spark, ["  body  "], lambda c: R.page_block(F.lit('a "b" \\'), F.lit("u"), c, F.lit("now"), F.lit("sum")))[0]
    assert block == (
        '---\nsource_url: u\ntitle: "a \\"b\\" \\"\ncollected_at: now\n---\n\n# a "b" \\\n\n> **Tóm tắt:** sum\n\nbody\n\n---\n'
    )


def test_text_block_and_names(spark):
    block = apply(spark, [" c "], lambda c: R.text_block(F.lit("T"), F.lit("u"), c))[0]
    assert block == "=" * 60 + "\nSOURCE: T\nURL: u\n" + "=" * 60 + "\n\nc\n\n"
    names = spark.range(1, 3).select(R.part_name(F.lit("docs"), F.col("id"), "md").alias("n")).collect()
    assert [r.n for r in names] == ["docs.md", "docs_part2.md"]


def test_unknown_format_is_refused():
    with pytest.raises(ValueError):
        R.record_text("pdf", F.lit(""), F.lit(""), F.lit(""), F.lit(""))
