"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of all benchmark items (13 consecutive words; a shorter item is one window) are the patterns of an
automaton that is built once per Python worker.  Each text is normalised without changing its length in bytes and
scanned once; words are found again at their place in the original text, so spans come in original characters.

The patterns are broadcast.  Their bytes are counted first; beyond ``max_pattern_bytes`` they are dealt into
blocks below it, each text is scanned with each block, and the findings of a text are merged by its row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.storage import written

WINDOW = 13
#: An automaton takes some 50 times the bytes of its patterns.
MAX_PATTERN_BYTES = 4_000_000

#: Every byte to itself in lower case if it is part of a word, else to a space: 0-9, A-Z, a-z and all beyond ASCII.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32 for b in range(256)
)
_SCANNED = "row long, doc_id long, n_words long, spans array<struct<first:long,last:long,start:long,end:long>>, items array<string>"

_built: dict[str, ahocorasick.Automaton] = {}


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


def _windows(item: bytes | None, window: int) -> set[bytes]:
    words = words_of(item)
    if not words:
        return set()
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def patterns(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(pattern, n_words, items)``: distinct windows with the ids, as sorted strings, of the items they occur in.

    Items without words or id have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, counts = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for w in _windows(text.as_py(), window):
                    ids.append(item)
                    found.append(w)
                    counts.append(w.count(b" ") + 1)
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(found, pa.binary()), pa.array(counts, pa.int64())], names=["item", "pattern", "n_words"])

    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).where(F.col(id_col).isNotNull())
    found = rows.mapInArrow(run, "item string, pattern binary, n_words long")
    return found.groupBy("pattern", "n_words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _automaton(shared: Broadcast) -> ahocorasick.Automaton:
    key = shared.value["key"]
    if key not in _built:
        _built.clear()
        automaton = ahocorasick.Automaton()
        for pattern, n, items in shared.value["patterns"]:
            automaton.add_word(f" {pattern.decode('latin-1')} ", (n, items))
        automaton.make_automaton()
        _built[key] = automaton
    return _built[key]


def scan_text(text: bytes | None, automaton: ahocorasick.Automaton) -> tuple[int, list[dict], list[str]]:
    """Number of words, merged runs of hit words, and the items found in one text.

    A run has its first and last word and where it starts and ends in characters of the original text.
    """
    text = text or b""
    normal = text.translate(_NORMAL)
    words = normal.split()
    joined = b" " + b" ".join(words) + b" "
    hits = [(end, n, items) for end, (n, items) in automaton.iter(joined.decode("latin-1"))] if words and len(automaton) else []
    if not hits:
        return len(words), [], []
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    last = np.searchsorted(spaces, [h[0] for h in hits])
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, last - [h[1] for h in hits], 1)
    np.add.at(edge, last, -1)
    covered = np.diff(np.concatenate(([0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0])))
    firsts, lasts = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1) - 1
    inside = np.concatenate(([False], np.frombuffer(normal, np.uint8) != 32, [False]))
    starts, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    spans = [
        {"first": int(f), "last": int(g), "start": int(chars[starts[f]]), "end": int(chars[ends[g]])}
        for f, g in zip(firsts, lasts, strict=True)
    ]
    return len(words), spans, sorted({i for h in hits for i in h[2]})


def _blocks(benchmark: DataFrame, window: int, max_bytes: int, id_col: str, text_col: str) -> list[Broadcast]:
    """The patterns, broadcast in as many blocks as their counted bytes ask for."""
    found = written(patterns(benchmark, window, id_col, text_col), "patterns")
    total = found.agg(F.sum(F.length("pattern"))).first()[0] or 0
    n = -(-total // max_bytes) or 1
    blocks = []
    for block in range(n):
        own = found.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == block)
        value = [(bytes(r.pattern), r.n_words, list(r["items"])) for r in own.toLocalIterator()]
        blocks.append(benchmark.sparkSession.sparkContext.broadcast({"key": uuid.uuid4().hex, "patterns": value}))
    return blocks


def _scan(rows: DataFrame, shared: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared)
        for batch in batches:
            counts, spans, items = [], [], []
            for text in batch.column(2):
                n, s, i = scan_text(text.as_py(), automaton)
                counts.append(n)
                spans.append(s)
                items.append(i)
            span = pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")])
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.string()))],
                names=["row", "doc_id", "n_words", "spans", "items"],
            )

    return rows.mapInArrow(run, _SCANNED)


def _merged(spans: list[dict]) -> list[dict]:
    merged: list[dict] = []
    for s in sorted(spans, key=lambda s: s["first"]):
        if merged and s["first"] <= merged[-1]["last"] + 1:
            if s["last"] > merged[-1]["last"]:
                merged[-1] |= {"last": s["last"], "end": s["end"]}
        else:
            merged.append(dict(s))
    return merged


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, words_per_hit: int = 20,
    max_pattern_bytes: int = MAX_PATTERN_BYTES, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, spans, contaminated)``, one row per row of ``docs``.

    ``spans`` are the runs of hit words by word number and by character of the original text.  A document is
    contaminated if a word is hit and at least one word in ``words_per_hit`` is.  A null or empty text has no
    words and is clean; an empty benchmark leaves all clean; repeated rows and ids are judged one by one.
    """
    blocks = _blocks(benchmark, window, max_pattern_bytes, item_col, item_text_col)
    rows = docs.select(F.lit(0).cast("long").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    if len(blocks) > 1:
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    scanned = reduce(DataFrame.union, [_scan(rows, block) for block in blocks])
    if len(blocks) > 1:

        @F.udf(scanned.schema["spans"].dataType)
        def merged(spans):
            return _merged([s.asDict() for s in spans])

        scanned = written(scanned, "scanned").groupBy("row", "doc_id", "n_words").agg(
            merged(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return scanned.withColumn("n_hit", n_hit).select(
        "doc_id", "n_words", "n_hit", "items", "spans",
        ((F.col("n_hit") > 0) & (words_per_hit * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def _free_name(docs: DataFrame, name: str) -> str:
    """A name that no column has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, words_per_hit: int = 20,
    max_pattern_bytes: int = MAX_PATTERN_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that :func:`contamination` does not find contaminated, with their columns.

    Rows are judged where they are; only with more than one block of patterns they are stored and joined again.
    """
    blocks = _blocks(benchmark, window, max_pattern_bytes, item_col, item_text_col)
    if len(blocks) > 1:
        row = _free_name(docs, "row")
        rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        found = contamination(rows, benchmark, window, words_per_hit, max_pattern_bytes, row, text_col, item_col, item_text_col)
        return rows.join(found.where("contaminated").select(F.col("doc_id").alias(row)), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    shared, width = blocks[0], len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared)
        for batch in batches:
            clean = []
            for text in batch.column(width):
                n_words, spans, _ = scan_text(text.as_py(), automaton)
                n_hit = sum(s["last"] - s["first"] + 1 for s in spans)
                clean.append(not (n_hit > 0 and words_per_hit * n_hit >= n_words))
            yield batch.select(list(range(width))).filter(pa.array(clean, pa.bool_()))

    return docs.withColumn(_free_name(docs, "scanned"), F.col(f"`{text_col}`").cast("binary")).mapInArrow(run, docs.schema)
