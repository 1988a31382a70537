"""Intermediate tables in the folder all executors share.

A stage that several later stages read is written once as Parquet and read back: the lineage ends
there, a lost executor costs no upstream work, and later stages read only the columns they need.
"""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _configured(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; in local mode only, a new folder where it is unset."""
    sc = spark.sparkContext
    configured = _configured(spark)
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    current = sc.getCheckpointDir()
    if current is None:
        current = tempfile.mkdtemp(prefix="foliomill-")
        sc.setCheckpointDir(current)
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def is_shared(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` lies in ``spark.checkpoint.dir``, which all executors reach however it is written."""

    def plain(uri: str) -> str:
        return posixpath.normpath(re.sub(r"^file:(//)?(?=/)", "", uri))

    configured = _configured(spark)
    return bool(configured) and plain(path).startswith(f"{plain(configured)}/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/foliomill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the stored table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's own limit.
MAX_BUCKETS = 100_000


def written_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """:func:`written`, in as many buckets of ``key`` as a shuffle has partitions: joins on ``key`` do not exchange it again.

    ``df`` should be partitioned by ``key`` already; then each task writes one bucket.  The catalogue, which alone
    can describe buckets, knows the table only until it has been opened.
    """
    spark = df.sparkSession
    table = f"foliomill_{uuid.uuid4().hex}"
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_BUCKETS)
    df.write.format("parquet").bucketBy(n, key).sortBy(key).option("path", new_path(spark, name)).saveAsTable(table)
    stored = spark.table(table)
    spark.sql(f"drop table {table}")  # not its files, as their place was given
    return stored


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
