"""Part files.

Records are brought together by (output, part) and sorted; each task then streams its records into
files, one Arrow batch at a time (a batch is bounded in rows and bytes by Spark's settings), so memory does not
depend on the size of a part or of a table of contents.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill import fixed_values as fv
from foliomill.functions.formats import part_name
from foliomill.sinks.filesystem import filesystem, followed, shared_root
from foliomill.storage import is_shared

MANIFEST = "output string, part bigint, filename string, n_records bigint, n_chars bigint, content_md5 string"


class _PartFile:
    """One open part: a running digest and, if there is a root, a file that appears when complete."""

    def __init__(self, root: str | None, output: str, part: int, filename: str) -> None:
        self.output, self.part, self.filename = output, part, filename
        self.digest, self.n_records, self.n_chars, self.stream = hashlib.md5(), 0, 0, None
        if root is not None:
            self.files, base = filesystem(root)
            self.files.create_dir(f"{base}/{output}", recursive=True)
            self.target = f"{base}/{output}/{filename}"
            self.attempt = f"{self.target}.{uuid.uuid4().hex}.tmp"
            self.stream = self.files.open_output_stream(self.attempt)

    def write(self, texts: pd.Series, is_record: pd.Series) -> None:
        """Records of this part that follow each other, in one piece."""
        joined = "".join(texts)
        data = joined.encode("utf-8")
        self.digest.update(data)
        self.n_chars += len(joined)
        self.n_records += int(is_record.sum())
        if self.stream is not None:
            self.stream.write(data)

    def close(self) -> tuple:
        if self.stream is not None:
            self.stream.close()
            self.files.move(self.attempt, self.target)
        return (self.output, self.part, self.filename, self.n_records, self.n_chars, self.digest.hexdigest())


def write_parts(records: DataFrame, fmt: str, root: str | None = None) -> DataFrame:
    """Write (output, part, seq, text) as ``root/output/output[_partN].fmt`` and return the manifest.

    Rows with ``seq`` of 0 or less are header lines.  Without a root nothing is written and the
    manifest says what would be.  A task that is run again replaces its files by equal ones: a file is
    written under a name of its own and moved into place when complete.  ``root`` is a URI or path that
    all executors can reach; any path in ``spark.checkpoint.dir`` is.
    """
    if fmt not in fv.FORMATS:
        raise ValueError(f"format must be one of {fv.FORMATS}, not {fmt!r}")
    spark, base = records.sparkSession, root
    if root is not None:
        base = followed(spark, root if is_shared(spark, root) else shared_root(root, spark.sparkContext.master))
    named = records.select("output", "part", "seq", part_name(F.col("output"), F.col("part"), fmt).alias("filename"), "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = named.repartition(n, "output", "part").sortWithinPartitions("output", "part", "seq")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: _PartFile | None = None
        for batch in batches:
            done = []
            places = batch[["output", "part"]].ne(batch[["output", "part"]].shift()).any(axis=1).cumsum()
            for _, rows in batch.groupby(places, sort=False):
                output, part, filename = rows["output"].iloc[0], rows["part"].iloc[0], rows["filename"].iloc[0]
                if current is None or (current.output, current.part) != (output, part):
                    if current is not None:
                        done.append(current.close())
                    current = _PartFile(base, output, int(part), filename)
                current.write(rows["text"], rows["seq"] > 0)
            yield pd.DataFrame(done, columns=[c.split()[0] for c in MANIFEST.split(", ")])
        if current is not None:
            yield pd.DataFrame([current.close()], columns=[c.split()[0] for c in MANIFEST.split(", ")])

    return placed.mapInPandas(stream, MANIFEST)


def write_skip_log(log: DataFrame, path: str) -> None:
    """The skip log, one folder per stage."""
    log.write.mode("overwrite").partitionBy("stage").parquet(path)
