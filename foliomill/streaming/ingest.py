"""Incremental runs: new page files are extracted, and contents already stored are left out."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from foliomill.operators import dedup
from foliomill.operators.spacing import spaced
from foliomill.plans.corpus import documents
from foliomill.settings import CorpusSettings
from foliomill.storage import exists, written
from foliomill.streaming.seen import remember, unseen

CONTENT = ["ord", "url", "title", "content", "n_chars", "content_md5"]
STORED = "ord bigint, url string, title string, content string, n_chars bigint, content_md5 string, run string, batch_id bigint"


def read_store(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """All rows of a store; none if nothing has been stored yet."""
    if not exists(spark, store):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(store)


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The documents of a store."""
    return read_store(spark, store, STORED)


def page_stream(spark: SparkSession, path: str, schema: StructType, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)


def ingest(pages: DataFrame, store: str, checkpoint: str, settings: CorpusSettings = CorpusSettings()) -> StreamingQuery:
    """Append the new contents of every micro-batch to ``store``.

    Tokens need ordered windows, which streaming plans refuse, so each micro-batch runs the batch plan.
    A batch writes a folder of its own, named by the stream's checkpoint and the batch, and looks at all
    others in the store but later ones of its own stream.  So a batch that is repeated after a failure gives
    the same rows, and streams with different checkpoints may fill one store, one after the other.

    Stored documents are not read: hashes and their filters lie beside them, see :mod:`foliomill.streaming.seen`, and a
    batch opens only the hashes that may be among its own.  :func:`index_store` makes them for a store that has none.
    """
    run = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        docs = written(documents(batch, settings.selector), "ingest-documents")
        ok = (F.col("n_chars") > 0) & (F.col("n_stripped") >= settings.min_length)
        fresh = dedup.content_dedup(docs.where(ok)).select(*CONTENT)
        earlier = (F.col("run") != run) | (F.col("batch_id") < batch_id)
        fresh = written(unseen(fresh, store.rstrip("/"), earlier), "ingest-fresh")
        fresh.write.mode("overwrite").parquet(f"{store}/run={run}/batch_id={batch_id}")
        remember(fresh.select(F.col("content_md5").alias("hash")), store.rstrip("/"), f"run={run}/batch_id={batch_id}")

    return (
        pages.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def index_store(spark: SparkSession, store: str) -> None:
    """Hashes and filters for a store of documents that was written without them."""
    remember(stored(spark, store).select(F.col("content_md5").alias("hash")).distinct(), store.rstrip("/"), "run=indexed/batch_id=0")


FETCH = "url string, fetched_at timestamp, run string, batch_id bigint"
#: What batches say of fetches: kept from now on (1), or no longer (-1); and the fetches they have seen.
_CHANGES = "url string, t bigint, fetched_at timestamp, change int, run string, batch_id bigint, day bigint"
_SEEN = "url string, t bigint, run string, batch_id bigint, day bigint"
_DAY = 86_400_000_000


def _day(t: str) -> Column:
    return F.call_function("div", F.col(t) - F.pmod(F.col(t), F.lit(_DAY)), F.lit(_DAY))


def _net(changes: DataFrame) -> DataFrame:
    return changes.groupBy("url", "t").agg(F.sum("change").alias("n")).where("n > 0").drop("n")


def kept_fetches(spark: SparkSession, store: str) -> DataFrame:
    """``(url, fetched_at)``: the fetches that :func:`spaced_fetches` keeps in a store, as of its last batch."""
    return _net(read_store(spark, store, _CHANGES)).select("url", F.timestamp_micros("t").alias("fetched_at"))


def spaced_fetches(fetches: DataFrame, store: str, checkpoint: str, horizon_seconds: int = 86_400) -> StreamingQuery:
    """Keep in ``store`` the fetches (``url``, ``fetched_at``) that lie over a day after the last kept one of their URL.

    The first fetch of a URL is kept.  Fetches may come late and in any order: after each batch the kept ones are
    those of all fetches so far, as if they had come at once.  A late fetch can change what was kept after it,
    so a batch appends changes (kept, or no longer), and :func:`kept_fetches` adds them up.

    What was kept before the earliest new fetch of a URL stands, as a fetch depends on earlier ones only.  So a
    batch reads the fetches of its URLs from there on, and of what was kept one horizon more; both are stored by day, and
    days before are not opened.  In a stream that comes in order these are today's.  How the kept ones are found
    is in :mod:`foliomill.operators.spacing`; no URL passes a single task.  A batch that is repeated gives the same
    rows.  Null URLs and times are left out.
    """
    run = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]
    horizon = horizon_seconds * 1_000_000
    seen = f"{store.rstrip('/')}/_seen"

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = (F.col("run") != run) | (F.col("batch_id") < batch_id)
        named = batch.where("url is not null and fetched_at is not null").select("url", F.unix_micros("fetched_at").alias("t"))
        new = written(named.distinct(), "fetches")
        since = written(new.groupBy("url").agg(F.min("t").alias("since")), "fetches-since")
        low = since.agg(F.min("since")).first()[0]
        if low is None:
            return

        def known(path: str, schema: str, start: int) -> DataFrame:
            """Rows of the batch's URLs, of days from ``start`` on."""
            rows = read_store(spark, path, schema).where(earlier & (F.col("day") >= start // _DAY))
            return rows.join(since, "url")

        kept = written(_net(known(store, _CHANGES, low - horizon)), "fetches-kept").join(since, "url")
        last = kept.where("t < since").groupBy("url").agg(F.max("t").alias("t"))
        times = new.unionByName(known(seen, _SEEN, low).where("t >= since").select("url", "t")).unionByName(last)
        now = spaced(times.withColumnRenamed("url", "key"), horizon).withColumnRenamed("key", "url")
        now = now.join(since, "url").where("t >= since").select("url", "t", F.lit(1).alias("change"))
        then = kept.where("t >= since").select("url", "t", F.lit(-1).alias("change"))
        changes = now.unionByName(then).groupBy("url", "t").agg(F.sum("change").cast("int").alias("change")).where("change <> 0")
        changes = changes.withColumn("fetched_at", F.timestamp_micros("t"))
        for rows, path in ((new, seen), (changes, store)):
            rows.withColumn("day", _day("t")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/run={run}/batch_id={batch_id}")

    return (
        fetches.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
