"""Which hashes a store has seen, without reading all of them.

Every batch leaves its hashes in folders by the first digit, and for each folder a Bloom filter: blocks of 32,768 bits, as
many as give each hash at least 16 bits; a hash has four bits in one block.  A new batch tests its hashes against the
filters, which are a small part of the hashes' size, and opens only the folders that may hold one of them.
Hashes are hexadecimal digests, so their digits are as good as independent hash functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.storage import exists, written

BLOCK_BITS, BITS_PER_HASH, PLACES = 1 << 15, 16, 4
_HASHES = "hash string, run string, batch_id bigint, prefix string"
_FILTERS = "size int, block int, bits binary, run string, batch_id bigint, prefix string"


def _digits(start: int, n: int) -> Column:
    return F.conv(F.substring("hash", start, n), 16, 10).cast("int")


_BLOCK = 18  # where the digits of the block begin; the places come before


def _placed(hashes: DataFrame) -> DataFrame:
    """``(hash, prefix, where, places)``: a number whose last digits are the block, and the bits in it."""
    places = [F.pmod(_digits(2 + 4 * i, 4), F.lit(BLOCK_BITS)) for i in range(PLACES)]
    return hashes.select("hash", F.substring("hash", 1, 1).alias("prefix"), _digits(_BLOCK, 6).alias("where"), F.array(*places).alias("places"))


def _block(size: str) -> Column:
    """The block of a filter of ``2 ** size`` blocks."""
    return F.pmod(F.col("where"), F.call_function("shiftleft", F.lit(1), F.col(size)))


def remember(hashes: DataFrame, store: str, batch: str) -> None:
    """Store the distinct ``hash`` values of a batch (``run=.../batch_id=...``) and their filters, in place of what it had."""
    placed = written(_placed(hashes), "hashes")
    blocks = F.count("*") * BITS_PER_HASH / BLOCK_BITS
    sizes = placed.groupBy("prefix").agg(F.greatest(F.lit(0), F.least(F.lit(24), F.ceil(F.log2(blocks)))).cast("int").alias("size"))
    placed.select("hash", "prefix").repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{store}/_hashes/{batch}")
    bits = placed.join(F.broadcast(sizes), "prefix").select("prefix", "size", _block("size").alias("block"), F.explode("places").alias("place"))
    filters = bits.groupBy("prefix", "size", "block").agg(F.call_function("bitmap_construct_agg", F.col("place").cast("bigint")).alias("bits"))
    filters.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{store}/_filters/{batch}")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def folders(hashes: DataFrame, store: str, earlier: Column) -> list[str]:
    """The folders of ``earlier`` batches that may hold one of the hashes."""
    filters = _table(hashes.sparkSession, f"{store}/_filters", _FILTERS).where(earlier)
    # The sizes of filters are powers of two: a few numbers.
    sizes = [r["size"] for r in filters.select("size").distinct().collect()]
    if not sizes:
        return []
    tested = _placed(hashes).withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    met = tested.withColumn("block", _block("size")).join(filters, ["prefix", "size", "block"])

    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, F.pmod(place, F.lit(8))) == 1

    may = met.where(F.forall("places", is_set)).select("run", "batch_id", "prefix").distinct()
    return sorted(f"{store}/_hashes/run={r['run']}/batch_id={r['batch_id']}/prefix={r['prefix']}" for r in may.collect())


def unseen(rows: DataFrame, store: str, earlier: Column, column: str = "content_md5") -> DataFrame:
    """The rows whose hash no ``earlier`` batch of the store has.  Opens only the folders that may hold one of them."""
    spark = rows.sparkSession
    paths = folders(rows.select(F.col(column).alias("hash")), store, earlier)
    if not paths:
        return rows
    known = spark.read.schema("hash string").parquet(*paths).select(F.col("hash").alias(column))
    return rows.join(known, column, "left_anti")
