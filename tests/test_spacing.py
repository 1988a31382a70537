"""Fetches more than a day apart, against the rule applied one by one."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliomill.operators.spacing import spaced, successors
from foliomill.streaming import ingest as S


def one_by_one(rows, horizon):
    last, out = {}, []
    for key, t in sorted(set((k, t) for k, t in rows if k is not None and t is not None)):
        if key not in last or t > last[key] + horizon:
            last[key] = t
            out.append((key, t))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "key string, t long")


@pytest.mark.parametrize("horizon,span,n", [(64, 3000, 400), (1, 60, 100), (6, 5, 30), (2048, 10**7, 300)])
def test_kept_times_are_those_of_the_rule(spark, horizon, span, n):
    rng = random.Random(horizon + span)
    # One key has a third of all rows; some have long gaps, dense stretches, or times just at the horizon.
    rows = [("hot" if rng.random() < 0.33 else f"k{rng.randrange(12)}", rng.randrange(-span, span)) for _ in range(n)]
    rows += [("exact", i * horizon) for i in range(20)] + [("just", i * (horizon + 1)) for i in range(20)]
    rows += [("dense", i // 2) for i in range(200)] + [("far", 0), ("far", span * 50), ("far", span * 50 + horizon + 1), (None, 3), ("null", None)]
    got = sorted((r.key, r.t) for r in spaced(table(spark, rows), horizon).collect())
    assert got == one_by_one(rows, horizon)


def test_successors(spark):
    rng = random.Random(5)
    rows = {(f"k{rng.randrange(3)}", rng.randrange(0, 5000)) for _ in range(300)}
    got = {(r.key, r.t): r.next for r in successors(table(spark, sorted(rows)), 64).collect()}
    assert got == {(k, t): min((u for j, u in rows if j == k and u > t + 64), default=None) for k, t in rows}


def test_no_times(spark):
    assert spaced(table(spark, []), 10).collect() == []
    with pytest.raises(ValueError):
        spaced(table(spark, []), 0)


def test_no_key_is_a_window_of_its_own(spark):
    plan = successors(table(spark, [("a", 1)]), 64)._jdf.queryExecution().executedPlan().toString()
    # Times meet by slice only; windows over a key see one row per range or slice.
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert len(windows) == 3
    assert [("slice#" in line.split("windowspecdefinition(")[1].split(" ASC")[0].split(" DESC")[0]) for line in windows if " t#" in line or "at#" in line] == [True]


START = datetime(2024, 3, 1)


def stream(spark, tmp_path, batches, hours=24):
    source, store, checkpoint = (str(tmp_path / name) for name in ("in", "store", "checkpoint"))
    schema = "url string, fetched_at timestamp"
    for rows in batches:
        df = spark.createDataFrame([(u, None if t is None else START + timedelta(hours=t)) for u, t in rows], schema)
        df.coalesce(1).write.mode("append").parquet(source)
        S.spaced_fetches(S.page_stream(spark, source, df.schema), store, checkpoint, hours * 3600).awaitTermination()
    got = S.kept_fetches(spark, store).select("url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("at")).collect()
    return sorted((r.url, (datetime.fromisoformat(r.at) - START).total_seconds() / 3600) for r in got), store, source, checkpoint


def test_late_and_unordered_batches(spark, tmp_path):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.34 else f"u{rng.randrange(9)}", rng.randrange(0, 400)) for _ in range(240)]
    batches = [rows[i::3] for i in range(3)] + [[("hot", -30), ("u1", -3), (None, 4), ("u2", None)], [("new", 1), ("hot", -30)]]
    got, store, source, _ = stream(spark, tmp_path, batches)
    assert got == [(k, float(t)) for k, t in one_by_one([r for b in batches for r in b], 24)]
    # Late fetches took some back.
    assert S.read_store(spark, store, S._CHANGES).where("change < 0").count() > 0


def test_a_repeated_batch_gives_the_same(spark, tmp_path):
    got, store, source, checkpoint = stream(spark, tmp_path, [[("a", 30), ("a", 60)], [("a", 0), ("b", 5), ("a", 25)]])
    assert got == [("a", 0.0), ("a", 25.0), ("a", 60.0), ("b", 5.0)]
    # The last batch was not committed: the stream runs it again.
    for name in ("commits/1", "commits/.1.crc"):
        path = tmp_path / "checkpoint" / name
        if path.exists():
            path.unlink()
    S.spaced_fetches(S.page_stream(spark, source, spark.read.parquet(source).schema), store, checkpoint).awaitTermination()
    assert sorted(r.url for r in S.kept_fetches(spark, store).collect()) == ["a", "a", "a", "b"]


def test_a_batch_opens_no_earlier_days(spark, tmp_path):
    """In a stream that comes in order, days before yesterday's are pruned."""
    _, store, _, _ = stream(spark, tmp_path, [[("a", 24 * d), ("b", 24 * d + 1)] for d in range(0, 10, 3)])
    rows = S.read_store(spark, store, S._CHANGES).where("day >= 19790")
    assert "PartitionFilters: [isnotnull(day" in rows._jdf.queryExecution().toString()
    days = {r.url.split("day=")[1][:5] for r in rows.select(F.input_file_name().alias("url")).collect()}
    assert days == {"19792"} and S.read_store(spark, store, S._CHANGES).select("day").distinct().count() == 4
