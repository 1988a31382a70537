"""The file system behind a URI, for tasks that write files of their own."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Hadoop's names of object stores and what pyarrow calls them.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def filesystem(root: str):
    """``(file system, path)`` of a URI as Spark writes it; a bare path or ``file:`` is the local file system."""
    from pyarrow import fs

    scheme, colon, rest = root.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        path = re.sub(r"^//[^/]+", "", rest) if scheme == "file" and colon else root
        return fs.LocalFileSystem(), re.sub(r"^/+", "/", path)
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def shared_root(root: str, master: str) -> str:
    """``root`` if all executors of a cluster reach it; a bare path or ``file:`` is only that in local mode.

    A folder that is mounted on every machine is given as ``file:`` with a host part, ``file://shared/mnt/out``.
    """
    local = "://" not in root or root.startswith("file:///")
    if local and not master.startswith("local"):
        raise ValueError(f"{root} may be another folder on each machine; give a URI that all executors reach")
    return root


def followed(spark: SparkSession, root: str) -> str:
    """``root``, or the folder behind it if it is a mount (``viewfs``) that only Spark's configuration knows."""
    if not root.startswith("viewfs:"):
        return root
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    return files.resolvePath(at).toString()
