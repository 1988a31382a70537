"""Removal of repeated strings over all texts, by suffix arrays.

A byte goes if it is covered by a string of ``window`` bytes that also starts earlier: in a document with a smaller
id, or earlier in the same.  Only strings that can be equal meet:

1. Each window is named by the least-hashed short gram inside it (its anchor).  Equal windows have equal anchors at
   the same place.  Windows in a row with one anchor make a segment; every window is in exactly one segment.
2. Segments that are equal are settled by their first one, within the task that finds them before anything
   is exchanged, then over all tasks.  Only the first of each goes on, and only where its anchor has others.
3. The bytes of those are fetched from their documents.  Each segment is halved by where its anchor lies in the window;
   the windows of a half have a longer string in common, and only halves that agree on it meet.  Where they differ
   beside it, each is cut finer in the same way; what has its core in common with others is put together into texts of
   bounded size, a core as one symbol of its own, whose suffix arrays (:mod:`foliomill.llm.suffix_array`) bring equal
   windows of different segments side by side.
4. What goes is brought back to the documents.

An anchor with very many different segments is not put into one text: its segments are taken apart into windows, each a
row keyed by two hashes of its bytes, so they are dealt over all tasks.  A task that meets many segments of an anchor does
this at once and leaves a mark, and the few segments of the anchor in other tasks follow.  No group meets in one
task beyond :data:`TASK_SEGMENTS` rows a task, or :data:`GROUP_SEGMENTS` in one suffix array.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.suffix_array import suffix_array
from foliomill.storage import written

WINDOW = 100
GRAM = 24
#: Different segments of one anchor that a task hands on, and that one suffix array takes.
TASK_SEGMENTS = 512
GROUP_SEGMENTS = 1_024
#: Bytes of one suffix array, unless a single anchor has more; rows a task holds before it settles them.
TEXT_BYTES = 1 << 17
ROWS_AT_ONCE = 2_000_000
#: Into how many parts the places of an anchor are cut where segments are fetched, and where they are compared.
HALVES, PARTS = 2, 4

_RANGE, _SEGMENT, _WINDOW, _MARK = 0, 1, 2, 3
_NO_ID = -(1 << 63)
_PLACE_BITS = 24
_LONG_TEXT = 1 << 22
_FOUND = "kind byte, key long, digest long, doc long, first int, stop int"
_FOUND_ARROW = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
_NAMES = [f.split()[0] for f in _FOUND.split(", ")]


def _gram_hashes(octets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each place on."""
    lanes = np.lib.stride_tricks.as_strided(octets.view(np.uint8), (len(octets) - 7, 8), (1, 1))
    lanes = np.ascontiguousarray(lanes).view("<u8").ravel()
    n = len(octets) - GRAM + 1
    h = lanes[:n] * np.uint64(0x9E3779B185EBCA87)
    for at in range(8, GRAM, 8):
        h ^= h >> np.uint64(31)
        h += lanes[at : at + n]
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    return h


def segments(text: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor hash, first window, window after the last, place of the anchor)`` of each segment of a text, in order."""
    found = [_segments(text[at : at + _LONG_TEXT + window - 1], window, at) for at in range(0, max(len(text) - window + 1, 0), _LONG_TEXT)]
    if not found:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _segments(text: bytes, window: int, base: int) -> tuple[np.ndarray, ...]:
    hashes = _gram_hashes(np.frombuffer(text, np.uint8))
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    least = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    grams, width = window - GRAM + 1, 1
    while 2 * width <= grams:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < grams:
        least = np.minimum(least[: -(grams - width)], least[grams - width :])
    places = (least & mask).astype(np.int64)
    firsts = np.concatenate(([0], np.flatnonzero(places[1:] != places[:-1]) + 1))
    anchors = places[firsts]
    return hashes[anchors], firsts + base, np.append(firsts[1:], len(places)) + base, anchors + base


def _places(window: int, parts: int) -> list[tuple[int, int]]:
    """The places an anchor can have in a window in parts: the first and the last of each."""
    bounds = [(window - GRAM + 1) * k // parts for k in range(parts + 1)]
    return [(low, until - 1) for low, until in zip(bounds, bounds[1:], strict=False) if low < until]


def _halves(text: bytes, key: int, first: int, stop: int, anchor: int, window: int) -> Iterator[tuple[int, int, int]]:
    """``(key, first, stop)`` of the windows of a segment whose anchor lies early, and of those where it lies late.

    All windows of a half have a longer string around the anchor in common; its hash is the key.
    """
    for low, high in _places(window, HALVES):
        begin, end = max(first, anchor - high), min(stop, anchor - low + 1)
        if begin < end:
            core = xxhash.xxh3_64_intdigest(text[anchor - low : anchor - high + window], low)
            yield core ^ (key & 0xFFFFFFFFFFFFFFFF), begin, end


#: Some windows of a segment: their text, document and first window, and where their core begins in the text.
Piece = tuple[bytes, int, int, int]


def _shared(rows: list[tuple], window: int) -> Iterator[list[Piece]]:
    """Segments ``(key, text, doc, first, place of the anchor)`` of a key cut finer, together where cores are equal.

    What is alone with its core has no window in common with another.
    """
    of_core: dict[tuple[int, bytes], list[Piece]] = {}
    for low, high in _places(window, PARTS):
        for _, text, doc, first, anchor in rows:
            begin, end = max(0, anchor - high), min(len(text) - window + 1, anchor - low + 1)
            if begin < end:
                core = text[anchor - low : anchor - high + window]
                of_core.setdefault((low, core), []).append((text[begin : end + window - 1], doc, first + begin, anchor - low - begin))
    for pieces in of_core.values():
        if len(pieces) > 1:
            yield pieces


def _ordered(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (key, digest, doc, first, stop) in this order, the first column counting most."""
    order = np.lexsort(columns[3::-1])
    return [c[order] for c in columns]


def _firsts(key: np.ndarray, digest: np.ndarray) -> np.ndarray:
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
    return new


def _later(columns: list[np.ndarray], new: np.ndarray) -> np.ndarray:
    """Which rows start later than the first row equal to them; the same document may be there twice."""
    leader = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (columns[2] != columns[2][leader]) | (columns[3] != columns[3][leader])


def _merged(doc: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows with those that touch joined."""
    if len(doc) == 0:
        return doc, first, stop
    order = np.lexsort((stop, first, doc))
    doc, first, stop = doc[order], first[order], stop[order]
    new_doc = np.concatenate(([True], doc[1:] != doc[:-1]))
    # Stops are made to grow from document to document, so one running maximum serves all.
    number = np.cumsum(new_doc) - 1
    width = int(stop.max()) + 1
    reach = np.maximum.accumulate(number * width + stop)
    new = new_doc.copy()
    new[1:] |= number[1:] * width + first[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], first[at], reach[last] - number[at] * width


def _rows(kind: int, key: np.ndarray, digest: np.ndarray, doc: np.ndarray, first: np.ndarray, stop: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(doc), 100_000):
        part = slice(at, at + 100_000)
        n = len(doc[part])
        values = [np.full(n, kind, np.int8), key[part].view(np.int64), digest[part].view(np.int64), doc[part], first[part], stop[part]]
        yield pa.record_batch([pa.array(v).cast(t) for v, t in zip(values, _FOUND_ARROW, strict=True)], names=_NAMES)


def _ranges(doc: np.ndarray, first: np.ndarray, stop: np.ndarray) -> Iterator[pa.RecordBatch]:
    doc, first, stop = _merged(doc, first, stop)
    yield from _rows(_RANGE, doc * 0x9E3779B1, np.zeros(len(doc), np.int64), doc, first, stop)


def _window_rows(texts: list[bytes], keys: list[int], docs: list[int], firsts: list[int], window: int) -> list[np.ndarray]:
    """One row per window of each segment: its key mixes the anchor with one hash, its digest is another."""
    key, digest, doc, first = [], [], [], []
    for text, k, d, f in zip(texts, keys, docs, firsts, strict=True):
        for i in range(len(text) - window + 1):
            w = text[i : i + window]
            key.append(xxhash.xxh3_64_intdigest(w, k & 0xFFFFFFFF))
            digest.append(xxhash.xxh64_intdigest(w))
            doc.append(d)
            first.append(f + i)
    start = np.array(first, np.int64)
    return [np.array(key, np.uint64), np.array(digest, np.uint64), np.array(doc, np.int64), start, start + 1]


def _settled(kind: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Of equal rows the first as ``kind``, and the ranges of those that start later."""
    columns = _ordered(columns)
    new = _firsts(columns[0], columns[1])
    yield from _rows(kind, *[c[new] for c in columns])
    later = _later(columns, new)
    yield from _ranges(*[c[later] for c in columns[2:]])


def _find(window: int, task_segments: int):
    """Texts to segments, equal ones of the task settled."""

    def settle(held: list[tuple], texts: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        text_of = columns.pop()
        order = np.lexsort(columns[3::-1])
        columns, text_of = [c[order] for c in columns], text_of[order]
        new = _firsts(columns[0], columns[1])
        later = _later(columns, new)
        yield from _ranges(*[c[later] for c in columns[2:]])
        kept = [c[new] for c in columns]
        text_of = text_of[new]
        _, inverse, counts = np.unique(kept[0], return_inverse=True, return_counts=True)
        hot = counts[inverse] > task_segments
        yield from _rows(_SEGMENT, *[c[~hot] for c in kept])
        if hot.any():
            marks = np.unique(kept[0][hot])
            zero = np.zeros(len(marks), np.int64)
            yield from _rows(_MARK, marks, zero, zero, zero, zero)
            parts = [c[hot].tolist() for c in kept]
            cut = [texts[t][f : s + window - 1] for t, f, s in zip(text_of[hot].tolist(), parts[3], parts[4], strict=True)]
            yield from _settled(_WINDOW, _window_rows(cut, parts[0], parts[2], parts[3], window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, n = [], {}, 0
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                if len(text) < window:
                    continue
                key, first, stop, _ = segments(text, window)
                ends = (stop + window - 1).tolist()
                digest = np.array([xxhash.xxh3_64_intdigest(text[f:e]) for f, e in zip(first.tolist(), ends, strict=True)], np.uint64)
                texts[len(texts)] = text
                held.append((key, digest, np.full(len(key), doc, np.int64), first, stop, np.full(len(key), len(texts) - 1)))
                n += len(key)
                if n > ROWS_AT_ONCE:
                    yield from settle(held, texts)
                    held, texts, n = [], {}, 0
        yield from settle(held, texts)

    return run


def _meet(group_segments: int):
    """Rows of a key to ranges, first windows, and first segments (``digest`` 1: to take apart)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not held:
            return
        kind, *columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        columns[2:] = [c.astype(np.int64) for c in columns[2:]]
        yield from _ranges(*[c[kind == _RANGE] for c in columns[2:]])
        yield from _settled(_WINDOW, [c[kind == _WINDOW] for c in columns])
        rows = _ordered([c[kind == _SEGMENT] for c in columns])
        new = _firsts(rows[0], rows[1])
        later = _later(rows, new)
        yield from _ranges(*[c[later] for c in rows[2:]])
        rows = [c[new] for c in rows]
        _, inverse, counts = np.unique(rows[0], return_inverse=True, return_counts=True)
        marked = np.isin(rows[0], columns[0][kind == _MARK])
        apart = marked | (counts[inverse] > group_segments)
        go_on = marked | (counts[inverse] > 1)
        yield from _rows(_SEGMENT, rows[0][go_on], apart[go_on].astype(np.int64), *[c[go_on] for c in rows[2:]])

    return run


def _compare(groups: list[list[Piece]], window: int) -> Iterator[pa.RecordBatch]:
    """Ranges of windows that also start earlier in another text of their group, by one suffix array over all groups.

    All windows of a group hold the core, so as much of it as all cores have is one symbol that only this group has.
    """
    core = window - max(high - low for low, high in _places(window, PARTS))
    texts, docs, firsts, places = (list(c) for c in zip(*itertools.chain.from_iterable(groups), strict=True))
    short = [t[: at + 1] + t[at + core :] for t, at in zip(texts, places, strict=True)]
    lengths = np.array([len(t) for t in short])
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    symbols = np.frombuffer(b"\0".join(short), np.uint8).astype(np.int64) + 1
    symbols[(starts[1:] - 1)] = 0
    symbols[starts + np.array(places)] = 257 + np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    order = np.array(suffix_array(symbols))
    owner = np.searchsorted(starts, order, side="right") - 1
    window -= core - 1
    inside = order - starts[owner] <= lengths[owner] - window
    order, owner = order[inside], owner[inside]
    views = np.lib.stride_tricks.sliding_window_view(symbols, window)
    new = np.ones(len(order), bool)
    for at in range(1, len(order), 20_000):
        part = order[at - 1 : at + 20_000]
        rows = views[part]
        new[at : at + 20_000] = (rows[1:] != rows[:-1]).any(axis=1)
    doc, first = np.array(docs, np.int64)[owner], np.array(firsts, np.int64)[owner] + order - starts[owner]
    same = np.cumsum(new)
    by_place = np.lexsort((first, doc, same))
    same, doc, first = same[by_place], doc[by_place], first[by_place]
    new = np.concatenate(([True], same[1:] != same[:-1]))
    later = _later([same, same, doc, first], new)
    yield from _ranges(doc[later], first[later], first[later] + 1)


def _array(window: int):
    """Segments and windows dealt by key to ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segs, windows = [], []
        for b in batches:
            kind, key, digest, doc, first, stop, text = [b.column(i) for i in range(7)]
            numbers = [c.to_numpy(zero_copy_only=False) for c in (kind, key, digest, doc, first, stop)]
            is_window = numbers[0] == _WINDOW
            windows.append([c[is_window].astype(np.int64) for c in numbers[1:]])
            at = np.flatnonzero(~is_window)
            segs += zip(numbers[1][at].tolist(), text.take(pa.array(at)).to_pylist(), *[numbers[i][at].tolist() for i in (3, 4, 2)], strict=True)
        if windows:
            columns = _ordered([np.concatenate(c) for c in zip(*windows, strict=True)])
            later = _later(columns, _firsts(columns[0], columns[1]))
            yield from _ranges(*[c[later] for c in columns[2:]])
        segs.sort()
        groups: list[list[Piece]] = []
        size, equal = 0, []
        for _, of_key in groupby(segs, key=itemgetter(0)):
            distinct = []
            for s in of_key:
                if distinct and distinct[-1][1] == s[1]:
                    if distinct[-1][2:4] != s[2:4]:
                        equal.append((s[2], s[3], s[3] + len(s[1]) - window + 1))
                else:
                    distinct.append(s)
            if len(distinct) > 1:
                for pieces in _shared(distinct, window):
                    groups.append(pieces)
                    size += sum(len(p[0]) for p in pieces)
            if size > TEXT_BYTES:
                yield from _compare(groups, window)
                groups, size = [], 0
        if groups:
            yield from _compare(groups, window)
        if equal:
            yield from _ranges(*[np.array(c, np.int64) for c in zip(*equal, strict=True)])

    return run


def _fetch(window: int):
    """Documents with the segments wanted of them to rows with the bytes; segments to take apart become windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, value, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text = value.as_py()
                _, firsts, _, places = segments(text, window)
                anchor = dict(zip(firsts.tolist(), places.tolist(), strict=True))
                for w in wanted.as_py():
                    part = text[w["first"] : w["stop"] + window - 1]
                    if w["first"] not in anchor:
                        continue  # another text of the same id
                    if w["digest"]:
                        columns = _window_rows([part], [w["key"]], [doc], [w["first"]], window)
                        key, digest, docs, first, stop = [c.view(np.int64).tolist() for c in columns]
                        rows += [(_WINDOW, k, g, d, f, s, None) for k, g, d, f, s in zip(key, digest, docs, first, stop, strict=True)]
                    else:
                        place = anchor[w["first"]]
                        for key, first, stop in _halves(text, w["key"], w["first"], w["stop"], place, window):
                            # The digest is the place of the anchor in the text.
                            rows.append((_SEGMENT, key - (1 << 64) if key >> 63 else key, place - first, doc, first, stop, text[first : stop + window - 1]))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [*_FOUND_ARROW, pa.binary()], strict=True)], names=[*_NAMES, "text"])

    return run


def _cut(window: int):
    """Documents with their ranges to what is left of them and the spans that went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans = [], []
            for value, ranges in zip(batch.column(1), batch.column(2), strict=True):
                text, ranges, at, left, gone = value.as_py(), ranges.as_py(), 0, [], []
                for r in sorted(ranges or [], key=lambda r: (r["first"], r["stop"])):
                    start, end = r["first"], min(r["stop"] + window - 1, len(text))
                    if gone and start <= gone[-1]["end"]:
                        gone[-1]["end"] = max(gone[-1]["end"], end)
                    elif start < end:
                        gone.append({"start": start, "end": end})
                for g in gone:
                    left.append(text[at : g["start"]])
                    at = g["end"]
                kept.append(b"".join([*left, text[at:]]))
                spans.append(gone)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([batch.column(0), pa.array(kept, pa.binary()), pa.array(spans, span)], names=["doc", "kept", "spans"])

    return run


def removed_ranges(
    rows: DataFrame, window: int = WINDOW, task_segments: int = TASK_SEGMENTS, group_segments: int = GROUP_SEGMENTS
) -> DataFrame:
    """``(doc, first, stop)``: ranges of windows that also start earlier; ``rows`` is ``(doc, text)`` of binary texts."""
    found = rows.mapInArrow(_find(window, task_segments), _FOUND)
    met = written(found.repartition("key").mapInArrow(_meet(group_segments), _FOUND), "segments")
    wanted = met.where(F.col("kind") == _SEGMENT).groupBy("doc").agg(F.collect_list(F.struct("key", "digest", "first", "stop")).alias("wanted"))
    fetched = rows.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(_fetch(window), f"{_FOUND}, text binary")
    windows = met.where(F.col("kind") == _WINDOW).withColumn("text", F.lit(None).cast("binary"))
    compared = written(fetched.union(windows).repartition("key").mapInArrow(_array(window), _FOUND), "ranges")
    return met.where(F.col("kind") == _RANGE).union(compared).select("doc", "first", "stop")


def deduplicated(
    docs: DataFrame, window: int = WINDOW, task_segments: int = TASK_SEGMENTS, group_segments: int = GROUP_SEGMENTS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_bytes, kept, spans)``, one row per row of ``docs``: what is left, and the runs of bytes that went.

    Strings are judged on the texts as they are.  A null text is empty, and a text shorter than ``window`` stays.  A
    null id comes before all others.  Rows that repeat an id are one document that is there more than once: neither
    of equal rows starts earlier, and of different texts under one id what one loses the other loses at the same place.
    """
    if window < GRAM:
        raise ValueError(f"window must be at least {GRAM}")
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )
    ranges = removed_ranges(rows, window, task_segments, group_segments).groupBy("doc").agg(F.collect_list(F.struct("first", "stop")).alias("ranges"))
    cut = rows.join(ranges, "doc", "left").select("doc", "text", "ranges").mapInArrow(
        _cut(window), "doc long, kept binary, spans array<struct<start:long,end:long>>"
    )
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select(
        F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("doc_id"), (F.length("kept") + gone).alias("n_bytes"), "kept", "spans"
    )
