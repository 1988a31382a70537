"""The index of stored hashes: nothing missed, few folders opened."""

import hashlib

from pyspark.sql import functions as F

from foliomill.streaming import ingest as S
from foliomill.streaming import seen


def hashes(spark, low, high):
    return spark.range(low, high).select(F.md5(F.col("id").cast("string")).alias("hash"))


ALL = "true"  # as an expression: no session yet


def test_no_stored_hash_is_missed(spark, tmp_path):
    store = str(tmp_path / "store")
    for batch, (low, high) in enumerate([(0, 40_000), (40_000, 40_001), (50_000, 50_300)]):
        seen.remember(hashes(spark, low, high), store, f"run=a/batch_id={batch}")
    rows = hashes(spark, 39_000, 52_000).withColumnRenamed("hash", "content_md5")
    left = {r.content_md5 for r in seen.unseen(rows, store, F.expr(ALL)).collect()}
    assert left == {hashlib.md5(str(i).encode()).hexdigest() for i in [*range(40_001, 50_000), *range(50_300, 52_000)]}
    earlier = F.col("batch_id") < 1
    assert seen.unseen(rows, store, earlier).count() == 12_000


def test_only_folders_that_may_match_are_opened(spark, tmp_path):
    store = str(tmp_path / "store")
    for batch in range(4):
        seen.remember(hashes(spark, batch * 20_000, batch * 20_000 + 20_000), store, f"run=a/batch_id={batch}")
    known = hashes(spark, 25_000, 25_001)
    prefix = known.first()["hash"][0]
    assert f"{store}/_hashes/run=a/batch_id=1/prefix={prefix}" in seen.folders(known, store, F.expr(ALL))
    assert len(seen.folders(known, store, F.expr(ALL))) <= 2
    # 200 new hashes, 64 folders: few tests of 800 go wrong.
    assert len(seen.folders(hashes(spark, 100_000, 100_200), store, F.expr(ALL))) <= 12
    rows = hashes(spark, 25_000, 25_001).withColumnRenamed("hash", "content_md5")
    read = seen.unseen(rows, store, F.expr(ALL))._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert any("hash" in read.apply(i).toString() for i in range(read.size()))


def test_an_empty_store(spark, tmp_path):
    rows = hashes(spark, 0, 5).withColumnRenamed("hash", "content_md5")
    assert seen.unseen(rows, str(tmp_path / "none"), ALL).count() == 5
    seen.remember(hashes(spark, 0, 0), str(tmp_path / "store"), "run=a/batch_id=0")
    assert seen.unseen(rows, str(tmp_path / "store"), ALL).count() == 5


def test_a_store_without_an_index(spark, tmp_path):
    store = str(tmp_path / "store")
    old = spark.createDataFrame([(i, "u", "t", "c", 1, hashlib.md5(str(i).encode()).hexdigest()) for i in range(5)], "ord long, url string, title string, content string, n_chars long, content_md5 string")
    old.write.parquet(f"{store}/run=x/batch_id=3")
    S.index_store(spark, store)
    rows = hashes(spark, 3, 8).withColumnRenamed("hash", "content_md5")
    assert seen.unseen(rows, store, F.expr(ALL)).count() == 3
    assert S.stored(spark, store).count() == 5


def test_documents_are_not_read(spark, tmp_path, monkeypatch):
    """A batch looks at hashes only, and a repeated one gives the same rows."""
    pages = spark.createDataFrame([(i, f"https://x.org/{i}", f"<p>{'word ' * 20}{i % 4}</p>") for i in range(12)], "page_id long, url string, html string")
    source, store, checkpoint = (str(tmp_path / n) for n in ("in", "store", "checkpoint"))
    monkeypatch.setattr(S, "stored", None)
    for low in (0, 6):
        pages.where(F.col("page_id").between(low, low + 5)).coalesce(1).write.mode("append").parquet(source)
        S.ingest(S.page_stream(spark, source, pages.schema), store, checkpoint).awaitTermination()
    monkeypatch.undo()
    want = sorted((r.ord, r.batch_id) for r in S.stored(spark, store).collect())
    assert [o for o, _ in want] == [0, 1, 2, 3]
    for name in ("commits/1", "commits/.1.crc"):
        path = tmp_path / "checkpoint" / name
        if path.exists():
            path.unlink()
    S.ingest(S.page_stream(spark, source, pages.schema), store, checkpoint).awaitTermination()
    assert sorted((r.ord, r.batch_id) for r in S.stored(spark, store).collect()) == want
