"""Harmonic packing of token ids into sequences.

Lengths are dealt into reciprocal-capacity classes: class k takes pieces longer than C / (k + 1) and not longer
than C / k, and each of its bins takes k of them, whatever they are.  No bin depends on another class, and within a
class the n-th piece goes to bin n // k, so the bins are filled independently by all workers.

Documents may be cut, so lengths are made to fit their class: while a remainder is longer than C / ``tail_classes``
it gives up a piece of exactly floor(C / k), the largest such that fits; what is left is packed as it is.  A bin of
exact pieces wastes less than k ids, one of tails less than a share of 1 / k.  Only the last bin of each class
can be partly full; these at most C bins, a number that does not grow with the data, are put together first fit.

Texts are encoded once and only (document, start, length, checksum) leaves the task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm.tokens import encoder
from foliomill.storage import written

CAPACITY = 2048
TAIL_CLASSES = 32
END_ID = 1
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, worker int, rank long"


def cuts(n: int, capacity: int = CAPACITY, tail_classes: int = TAIL_CLASSES) -> list[tuple[int, int]]:
    """``(length, class)`` of the pieces of a document of ``n`` ids, in order."""
    pieces = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest * tail_classes > capacity:
        k = -(-capacity // rest)
        pieces.append((capacity // k, k))
        rest -= capacity // k
    if rest:
        pieces.append((rest, capacity // rest))
    return pieces


def pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, tail_classes: int = TAIL_CLASSES, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, class, worker, rank)``: the documents cut.  Map-only.

    ``rank`` numbers the pieces of a class within the worker (the task's partition) that made them.
    """
    end = end_id.to_bytes(4, "little")
    names = [f.split()[0] for f in _PIECE.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, worker, ranks = encoder(tokenizer_path).ids, TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, start = encode(text.as_py()) + end, 0
                for length, k in cuts(len(ids) // 4, capacity, tail_classes):
                    rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, k, worker, ranks[k]))
                    start += length
                    ranks[k] += 1
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECE)


def _first_fit(loads: list[tuple[int, int]], capacity: int) -> dict[int, tuple[int, int]]:
    """``class -> (number of the shared sequence, offset)`` for partly filled bins ``(class, ids)``, largest first."""
    filled: list[int] = []
    placed = {}
    for k, load in sorted(loads, key=lambda x: (-x[1], x[0])):
        at = next((i for i, f in enumerate(filled) if f + load <= capacity), None)
        if at is None:
            filled.append(0)
            at = len(filled) - 1
        placed[k] = (at, filled[at])
        filled[at] += load
    return placed


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, tail_classes: int = TAIL_CLASSES, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, one row per piece.

    Every document ends with ``end_id``.  Sequences hold at most ``capacity`` ids; offsets have no gaps.  A null
    or empty text is its end id alone; repeated rows and ids are packed one by one, null ids too; an empty table
    gives an empty result.
    """
    if not 1 <= tail_classes <= capacity:
        raise ValueError("tail_classes must be between 1 and the capacity")
    spark = docs.sparkSession
    stored = written(pieces(docs, tokenizer_path, capacity, tail_classes, end_id, id_col, text_col), "pieces")
    before = Window.partitionBy("class").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(
        stored.groupBy("class", "worker").agg(F.count("*").alias("n")).select(
            "class", "worker", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("class")).alias("total")
        ),
        "class-counts",
    )
    k = F.col("class").cast("long")
    placed = stored.join(counts, ["class", "worker"]).withColumn("nth", F.col("before") + F.col("rank")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "class",
        F.floor(F.col("nth") / k).alias("bin"), (F.col("nth") % k).alias("place"),
        (F.floor(F.col("nth") / k) == F.floor(F.col("total") / k)).alias("part_full"),
    )
    # Pieces of a class below tail_classes are equally long; in a bin of tails the lengths before are summed up.
    in_bin = Window.partitionBy("class", "bin").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    exact = placed.where(F.col("class") < tail_classes).withColumn("offset", F.col("place") * F.floor(capacity / F.col("class")))
    tails = placed.where(F.col("class") >= tail_classes).withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0)))
    # One row per class at most: a number that only the capacity sets.
    loads = placed.where("part_full").groupBy("class").agg(F.sum("length").alias("n")).collect()
    shared = _first_fit([(r["class"], r["n"]) for r in loads], capacity)
    moves = spark.createDataFrame(
        [(c, True, at * (capacity + 1), base) for c, (at, base) in shared.items()], "class int, part_full boolean, shared long, base long"
    )
    packed = exact.unionByName(tails).join(F.broadcast(moves), ["class", "part_full"], "left")
    return packed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("shared", F.col("bin") * (capacity + 1) + F.col("class")).alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )
