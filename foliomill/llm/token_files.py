"""Token files with bit-plane shuffled blocks.

A file holds the ids of consecutive documents.  Ids are cut into blocks of fixed size; each block is transposed into
planes (one per bit, or one per byte), and each plane is compressed with zstandard by itself.  Ids below 65,536
have sixteen planes of zeros, which take no space.  A chunk index tells where each block lies, so any id can
be read without those before its block.

    magic | planes of block 0 | planes of block 1 | ... | index | offset of the index (8 bytes) | magic

The index is one zstandard frame of little-endian numbers: kind of planes, block size, number of blocks and of documents;
per block its offset, number of ids, checksum and plane lengths; per document whether it has an id, the id, and its number
of ids.

Texts are range-partitioned by document id, so files follow each other in ascending order.  A task writes its file
under a name of its own; the manifest, which Spark commits, holds the names of successful attempts only.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm.tokens import encoder
from foliomill.sinks.filesystem import filesystem
from foliomill.storage import new_path, written

MAGIC = b"FMTOKEN1"
BLOCK_IDS = 65_536
END_ID = 0
PLANES = {"bit": 32, "byte": 4}
_MANIFEST = "part int, file string, n_docs long, n_ids long, n_bytes long"


def to_planes(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """The planes of a block, lowest bit or byte first; a plane of zeros is empty."""
    octets = np.ascontiguousarray(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T)
    if kind == "byte":
        return [o.tobytes() if o.any() else b"" for o in octets]
    planes = []
    for octet in octets:
        seen = int(np.bitwise_or.reduce(octet)) if len(octet) else 0
        planes += [np.packbits(octet & np.uint8(1 << bit)).tobytes() if seen >> bit & 1 else b"" for bit in range(8)]
    return planes


def from_planes(planes: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    octets = np.zeros((4, n), np.uint8)
    for at, plane in enumerate(planes):
        if not plane:
            continue
        if kind == "byte":
            octets[at] = np.frombuffer(plane, np.uint8)
        else:
            octets[at // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << np.uint8(at % 8)
    return np.ascontiguousarray(octets.T).view("<u4").ravel()


class TokenFileWriter:
    """Writes documents to an open stream; blocks leave memory as they fill."""

    def __init__(self, stream, kind: str = "bit", block_ids: int = BLOCK_IDS, level: int = 3) -> None:
        self.stream, self.kind, self.block_ids = stream, kind, block_ids
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.waiting, self.at, self.n_ids = bytearray(), len(MAGIC), 0
        self.blocks: list[tuple] = []
        self.docs: list[tuple[int, int, int]] = []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """One document; ``ids`` are little-endian unsigned 32-bit numbers."""
        self.docs.append((int(doc_id is not None), doc_id or 0, len(ids) // 4))
        self.n_ids += len(ids) // 4
        self.waiting += ids
        while len(self.waiting) >= 4 * self.block_ids:
            self._block(bytes(self.waiting[: 4 * self.block_ids]))
            del self.waiting[: 4 * self.block_ids]

    def _block(self, data: bytes) -> None:
        planes = [self.compressor.compress(p) if p else b"" for p in to_planes(np.frombuffer(data, "<u4"), self.kind)]
        self.blocks.append((self.at, len(data) // 4, zlib.crc32(data), *map(len, planes)))
        for p in planes:
            self.stream.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.waiting:
            self._block(bytes(self.waiting))
        head = struct.pack("<4Q", PLANES[self.kind], self.block_ids, len(self.blocks), len(self.docs))
        index = head + np.array(self.blocks, "<u8").tobytes() + np.array(self.docs, "<i8").tobytes()
        self.stream.write(self.compressor.compress(index) + struct.pack("<Q", self.at) + MAGIC)


class TokenFileReader:
    """Reads a seekable file; ``ids(start, n)`` touches only the blocks that hold them."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        self.plain = zstandard.ZstdDecompressor()
        file.seek(size - 16)
        tail = file.read(16)
        file.seek(0)
        if file.read(8) != MAGIC or tail[8:] != MAGIC:
            raise ValueError("not a token file")
        at = struct.unpack("<Q", tail[:8])[0]
        file.seek(at)
        index = self.plain.decompress(file.read(size - 16 - at))
        planes, self.block_ids, n_blocks, n_docs = struct.unpack("<4Q", index[:32])
        self.kind = next(k for k, n in PLANES.items() if n == planes)
        width = 3 + planes
        self.blocks = np.frombuffer(index, "<u8", n_blocks * width, 32).reshape(n_blocks, width).astype(np.int64)
        self.docs = np.frombuffer(index, "<i8", n_docs * 3, 32 + 8 * n_blocks * width).reshape(n_docs, 3)

    def block(self, i: int) -> bytes:
        at, n, crc, *lengths = self.blocks[i].tolist()
        self.file.seek(at)
        data, planes, pos = self.file.read(sum(lengths)), [], 0
        for length in lengths:
            planes.append(self.plain.decompress(data[pos : pos + length]) if length else b"")
            pos += length
        ids = from_planes(planes, n, self.kind).tobytes()
        if zlib.crc32(ids) != crc:
            raise ValueError(f"block {i} is damaged")
        return ids

    def ids(self, start: int, n: int) -> np.ndarray:
        first, last = start // self.block_ids, (start + max(n, 1) - 1) // self.block_ids
        data = b"".join(self.block(i) for i in range(first, min(last + 1, len(self.blocks))))
        return np.frombuffer(data, "<u4")[start - first * self.block_ids :][:n]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """``(id, start in the file, number of ids, checksum)`` of each document, one block in memory at a time."""
        data, at, block, start = b"", 0, 0, 0
        for has_id, doc, n in self.docs.tolist():
            left, crc = 4 * n, 0
            while left:
                if at == len(data):
                    data, at, block = self.block(block), 0, block + 1
                part = data[at : at + left]
                crc, at, left = zlib.crc32(part, crc), at + len(part), left - len(part)
            yield doc if has_id else None, start, n, crc
            start += n


def write(
    docs: DataFrame, tokenizer_path: str, root: str, kind: str = "bit", block_ids: int = BLOCK_IDS, end_id: int = END_ID,
    partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Write ``docs`` as token files below ``root`` and return the stored manifest ``(part, file, n_docs, n_ids, n_bytes)``.

    ``end_id`` ends each document.  Files ascend by document id; null ids come first, and rows that repeat an id follow
    each other by a hash of their texts.  A null text is empty.  Empty partitions write no file.  ``root`` is a folder that
    all executors reach.
    """
    if kind not in PLANES:
        raise ValueError(f"kind must be one of {sorted(PLANES)}")
    end = end_id.to_bytes(4, "little")
    names = [f.split()[0] for f in _MANIFEST.split(", ")]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, stream, writer = encoder(tokenizer_path).ids, TaskContext.get().partitionId(), None, None
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    files, base = filesystem(root)
                    files.create_dir(base, recursive=True)
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.tokens"
                    stream = files.open_output_stream(f"{base}/{name}")
                    writer = TokenFileWriter(stream, kind, block_ids)
                writer.add(doc, encode(text.as_py()) + end)
        if writer is not None:
            writer.close()
            size = stream.tell()
            stream.close()
            row = [part, name, len(writer.docs), writer.n_ids, size]
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.repartitionByRange(*([partitions] if partitions else []), "doc_id", F.xxhash64("text"))
    ordered = dealt.sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(ordered.mapInArrow(run, _MANIFEST), "token-manifest")


def read_documents(manifest: DataFrame, root: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, read from the files of a manifest.

    ``start`` counts the ids of all documents before it, over all files.  One task reads one file at a time.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files_at = manifest.select("file", "n_bytes", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    rows_at_once = 50_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = filesystem(root)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 4
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        for batch in batches:
            for name, size, base in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with files.open_input_file(f"{folder}/{name}") as file:
                    rows = []
                    for doc, start, n, crc in TokenFileReader(file, size).documents():
                        rows.append((doc, base + start, n, crc))
                        if len(rows) == rows_at_once:
                            yield batch_of(rows)
                            rows = []
                    yield batch_of(rows)

    n_files = manifest.count()
    return files_at.repartition(max(1, n_files), "file").mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer_path: str, root: str | None = None, **options) -> DataFrame:
    """Write ``docs`` and read them back; ``root`` is a new folder in the shared one where none is given."""
    root = root or new_path(docs.sparkSession, "token-files")
    return read_documents(write(docs, tokenizer_path, root, **options), root)
