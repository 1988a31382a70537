"""Fill-in-middle transformation: texts cut at two ranks of their units and put together in another order.

The units of a text go into an indexable skip list.  Each edge of its lanes carries how many units and how many code
points it passes, so a descent that adds up widths reaches the unit of any rank and knows its code point
without walking the text.  Building is linear and vectorised, a look-up logarithmic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 documents so many are transformed, and of 100 transformed ones so many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 50, 80

#: A node of a lane is also one of the next lane with this chance.
_PROMOTED = 0.25
#: Code points looked at in one go, and output text of one batch.
_BLOCK, _BATCH = 1 << 20, 16 << 20


class SkipList:
    """An indexable skip list over units of given widths; node ``i`` is the place after the first ``i`` units."""

    def __init__(self, widths: np.ndarray, seed: int = SEED) -> None:
        n = len(widths)
        self.units, self.points = n, int(widths.sum())
        #: From the densest lane up: units and code points of each edge, and where each node is in the lane below.
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if n == 0:
            return
        draw = np.random.default_rng(seed)
        unit_widths, point_widths, down = np.ones(n, np.int64), widths.astype(np.int64), np.arange(n)
        while True:
            self.lanes.append((unit_widths, point_widths, down))
            if len(unit_widths) < 4:
                break
            # Edge j leaves node j of its lane; the head is in every lane.
            down = np.flatnonzero(np.concatenate(([True], draw.random(len(unit_widths) - 1) < _PROMOTED)))
            unit_widths, point_widths = np.add.reduceat(unit_widths, down), np.add.reduceat(point_widths, down)

    def point(self, rank: int) -> int:
        """Code points before the place after ``rank`` units."""
        if not 0 <= rank <= self.units:
            raise IndexError(rank)
        units = points = node = 0
        for unit_widths, point_widths, down in reversed(self.lanes):
            while node < len(unit_widths) and units + unit_widths[node] <= rank:
                units += int(unit_widths[node])
                points += int(point_widths[node])
                node += 1
            if units == rank:
                break
            node = int(down[node])
        return points


def unit_widths(text: str) -> np.ndarray:
    r"""Code points of each unit: ``[\x20\x09-\x0D]*[^\x20\x09-\x0D]+``, or white space at the end of the text."""
    ends = []
    for at in range(0, len(text), _BLOCK):
        points = np.frombuffer(text[at : at + _BLOCK + 1].encode("utf-32-le"), "<u4")
        blank = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
        inside = min(_BLOCK, len(text) - at)
        after = np.append(blank[1:], True)[:inside]
        ends.append(at + 1 + np.flatnonzero(~blank[:inside] & after))
    found = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    if text and (len(found) == 0 or found[-1] < len(text)):
        found = np.append(found, len(text))
    return np.diff(found, prepend=0)


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits that depend on the seed and the id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def transform(text: str, doc_id: int | None, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """``(units, form, code points of the prefix, of the middle, output)``."""
    widths = unit_widths(text)
    n = len(widths)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= TRANSFORMED:
        return n, "plain", None, None, text
    units = SkipList(widths, seed)
    first, last = sorted((units.point(h1 % (n + 1)), units.point(h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", first, last - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, last - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``, one row per row of ``docs``.  Map-only.

    A text that is null is an empty one; empty texts and those that hold one of the marks stay plain.  Cuts depend
    on the seed and the id, so repeated rows are cut alike; a null id counts as an empty one.  Other columns are not
    read.  An empty table gives an empty result.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.append((doc, *transform(text.as_py() or "", doc, seed)))
                size += len(rows[-1][-1])
                if size > _BATCH:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: str = "form", output: str = "output") -> F.Column:
    """The text that an output was made of.  Outputs that are not plain hold each mark once."""
    out = F.col(output)
    body = F.substr(out, F.lit(len(PREFIX) + 1))
    middle = F.substring_index(out, MIDDLE, -1)
    between = F.substring_index(body, MIDDLE, 1)
    return (
        F.when(F.col(form) == "psm", F.concat(F.substring_index(between, SUFFIX, 1), middle, F.substring_index(between, SUFFIX, -1)))
        .when(F.col(form) == "spm", F.concat(F.substring_index(between, PREFIX, -1), middle, F.substring_index(between, PREFIX, 1)))
        .otherwise(out)
    )
