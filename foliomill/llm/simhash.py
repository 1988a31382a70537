"""SimHash near duplicates by deletion-variant signatures.

Fingerprints at most k bits apart are cut into k // 2 + 1 segments, so that one segment differs in one bit at
most.  Of each segment all variants with one bit blanked out are indexed: two segments one bit apart share the
variant that blanks this bit.  An equality join on (blanked bit, variant) gives candidates, which are verified by
their bit distance.  Two segments of 64 bits give keys of 31 bits where exact matching of three gives 21.

Equal fingerprints are one row throughout.  Where many fingerprints share a variant, pairs would grow with the
square of the group.  There each fingerprint lists the points at most one bit from it, among the bits the variant
leaves open: two fingerprints are at most two bits apart exactly if they list a common point, so all that list a
point are linked to the least of them.  This is exact and linear, and chosen where it makes fewer rows than pairs.

Joins of tables that grow are hinted to be sort merges: a table of variants counts 64 times as many rows as its estimate, which
an explode leaves as it was, and would be sent to the driver to be broadcast.  Only what is counted to be few rows is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm.components import labels, sized
from foliomill.storage import written

SEED = 42
BITS = 64
_ROWS_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The fingerprint of one text as an unsigned number.

    Words are runs of bytes other than ASCII white space, A-Z in lower case.  No words give zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _ROWS_AT_ONCE):
        part = hashes[at : at + _ROWS_AT_ONCE].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``, one row per row of ``docs``; ``fp`` holds the 64 bits as a signed long.  Map-only.

    A null text has no words: fingerprint zero.  A null id is kept as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def _segment_masks(segments: int) -> list[int]:
    """The mask of the segment that each bit lies in, as signed longs."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    masks = []
    for low, high in zip(edges, edges[1:], strict=False):
        mask = ((1 << high) - 1) ^ ((1 << low) - 1)
        masks += [mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask] * (high - low)
    return masks


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints whose closure is that of all pairs at most ``max_bits`` apart.

    ``fps`` has distinct non-null values of ``fp``.  Every link is a pair at most ``max_bits`` apart; within one
    variant shared by many fingerprints not all such pairs are listed, but all are connected.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    if max_bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("a <> b")
    segments = max_bits // 2 + 1
    masks = F.array(*[F.lit(m) for m in _segment_masks(segments)])
    open_bits = BITS - BITS // segments + 1
    variants = (
        fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit"))
        .select("fp", "bit", F.get(masks, F.col("bit")).alias("mask"))
        .select("fp", "bit", F.col("mask").bitwiseAND(F.col("fp")).bitwiseAND(F.bitwise_not(_bit(F.col("bit")))).alias("key"))
    )
    shared = variants.groupBy("bit", "key").agg(F.count("*").alias("members")).where("members > 1")
    members = written(variants.join(shared.hint("merge"), ["bit", "key"]), "variants")

    few = members.where(F.col("members") <= 2 * open_bits)
    a = few.select("bit", "key", F.col("fp").alias("a"))
    b = few.select("bit", "key", F.col("fp").alias("b"))
    near = a.join(b.hint("merge"), ["bit", "key"]).where(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    )
    many = members.where(F.col("members") > 2 * open_bits).select(
        "fp", "bit", "key", F.get(masks, F.col("bit")).alias("mask")
    )
    flips = F.concat(
        F.array(F.lit(0).cast("long")),
        F.filter(
            F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), _bit),
            lambda one: (one == _bit(F.col("bit"))) | (one.bitwiseAND(F.col("mask")) == 0),
        ),
    )
    points = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    points = written(points.distinct(), "points")
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = points.join(least.hint("merge"), "point").select("a", F.col("fp").alias("b")).where("a <> b")
    return near.select("a", "b").union(stars).distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most ``max_bits`` bits, the own one included.
    Texts without words have fingerprint zero and are linked like any other.  Rows with a null id take part and
    get the smallest non-null id of their component (null if there is none).  Repeated ids are separate rows.
    An empty table gives an empty result.
    """
    rows = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    # Stored, so that both sides of the join are read as exchanged: only then are fingerprints of many rows split up.
    of_fp = written(_least(rows.withColumnRenamed("doc_id", "place"), max_bits), "least")
    return rows.join(of_fp.hint("merge"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id")
    )


def _least(rows: DataFrame, max_bits: int) -> DataFrame:
    """``(fp, least)``: the smallest ``place`` in the component of each fingerprint, of rows ``(fp, place)``."""
    distinct = written(rows.groupBy("fp").agg(F.min("place").alias("own")), "distinct-fingerprints")
    label = labels(links(distinct.select("fp"), max_bits))
    joined = written(distinct.join(label.hint("merge"), distinct.fp == label.v).select("fp", "own", "label"), "labelled")
    least = sized(written(joined.groupBy("label").agg(F.min("own").alias("least")), "least-of-labels"))
    moved = joined.join(least, "label").where(~F.col("own").eqNullSafe(F.col("least"))).select("fp", "least")
    return distinct.join(moved.hint("merge"), "fp", "left").select("fp", F.coalesce("least", "own").alias("least"))


def without_near_duplicates(
    docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of ``docs`` of each component, with its columns: the one with the smallest id.

    Rows are judged, not ids: rows that repeat an id with different texts are in components of their own.  Among rows of
    one id the one with the smallest digest of all its columns stays, rows without an id come last, and of equal
    rows one stays.  An empty table gives an empty result.
    """
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    digest = F.unhex(F.sha2(F.to_json(every, {"ignoreNullFields": "false"}).cast("binary"), 256))
    place = F.struct(F.col(f"`{id_col}`").isNull().alias("last"), F.col(f"`{id_col}`").cast("long").alias("id"), digest.alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fps)], names=["place", "fp"])

    placed = docs.select(place.alias("place"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    rows = written(placed.mapInArrow(run, "place struct<last: boolean, id: long, digest: binary>, fp long"), "fingerprints")
    kept = _least(rows, max_bits).select(F.col("least.digest").alias("digest")).distinct()
    whole = docs.select(every.alias("row"), digest.alias("digest"))
    return whole.join(kept.hint("merge"), "digest", "left_semi").dropDuplicates(["digest"]).select("row.*")
