import hashlib
from pathlib import Path
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from checks.oracle import ORACLE
from checks.run import rows_of
from foliomill import CorpusSettings
from foliomill import storage
from foliomill.operators import enrich
from foliomill.plans import corpus as P
from foliomill.plans.catalog import QUERIES
from foliomill.sinks.parts import write_parts
from foliomill.streaming import ingest as S


def page(i, text, extra=""):
    body = f"<p>{text}</p>" if text else ""
    return (i, f"https://h.example.org/{i}", f"<html><head><title>Page {i} | Site</title></head><body><nav>menu</nav><main>{body}{extra}</main></body></html>")


@pytest.fixture(scope="module")
def pages(spark):
    long = "Some words that make a page long enough to be kept, and then some more of them for good measure."
    rows = [page(i, f"{long} Number {i % 7}.") for i in range(20)] + [page(20, "short"), page(21, ""), (22, "https://h.example.org/22", "")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_a_run_writes_the_files_its_manifest_names(spark, pages, tmp_path):
    for fmt in ("md", "txt", "jsonl"):
        settings = CorpusSettings(fmt=fmt, split_limit=900, collected_at="now", rows_per_chunk=3)
        base = spark.createDataFrame([("h_example_org", "https://h.example.org/")], "output string, base_url string")
        root = tmp_path / fmt
        manifest = P.write_corpus(pages, settings, P.site_output(), str(root), base).orderBy("part").collect()
        assert sum(m.n_records for m in manifest) == 7
        names = {m.filename for m in manifest}
        assert names == {p.name for p in (root / "h_example_org").iterdir()} and f"h_example_org.{fmt}" in names
        for m in manifest:
            text = (root / m.output / m.filename).read_text(encoding="utf-8")
            assert (len(text), hashlib.md5(text.encode()).hexdigest()) == (m.n_chars, m.content_md5)
            assert m.n_records <= 1 or m.n_chars <= 900
        first = (root / "h_example_org" / f"h_example_org.{fmt}").read_text(encoding="utf-8")
        starts = {"md": "# 📑 MỤC LỤC\n\nTổng số trang: **7**\n\n1. [Page 0](", "txt": "FOLIOMILL — https://h.example.org/\n", "jsonl": '{"url": "https://h.example.org/0"'}
        assert first.startswith(starts[fmt])


def test_writing_again_gives_the_same_files(spark, tmp_path):
    rows = [("o", 1, 0, "head\n"), ("o", 1, 2, "b\n"), ("o", 1, 1, "é\n"), ("o", 2, 3, "c\n")]
    records = spark.createDataFrame(rows, "output string, part bigint, seq bigint, text string")
    for _ in range(2):
        manifest = write_parts(records, "txt", str(tmp_path)).orderBy("part").collect()
    assert [(m.filename, m.n_records, m.n_chars) for m in manifest] == [("o.txt", 2, 9), ("o_part2.txt", 1, 2)]
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["o.txt", "o_part2.txt"]
    assert (tmp_path / "o" / "o.txt").read_text(encoding="utf-8") == "head\né\nb\n"
    with pytest.raises(ValueError):
        write_parts(records, "pdf")


def test_html_is_scanned_and_exchanged_once(spark, pages, tmp_path):
    pages.write.parquet(str(tmp_path / "pages"))
    docs = P.documents(spark.read.parquet(str(tmp_path / "pages")))
    assert docs.count() > 0
    docs.collect()
    final = docs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and final.count("+- Exchange hashpartitioning(page_id") == 1 and "ReusedExchange" in final, final
    assert {r.url for r in docs.collect()} == {r.url for r in pages.where("html <> ''").collect()}


def test_later_passes_are_narrow(spark, pages):
    """Dedup and split read stored lengths, not contents."""
    docs = P.run_documents(pages, CorpusSettings())
    kept = docs.where("long_enough").select("output", "content_md5", "ord", "record_chars")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "content:string" not in plan and "record_chars:bigint" in plan


def test_corpus_filters_and_order(spark, pages):
    rows = P.corpus(pages, CorpusSettings(include=("example",), exclude=("/1",), max_pages=9)).orderBy("seq").collect()
    assert [(r.ord, r.seq, r.title) for r in rows][:2] == [(0, 1, "Page 0"), (2, 2, "Page 2")]
    assert len({r.content_md5 for r in rows}) == len(rows)


def test_skip_precedence(spark, pages):
    log = P.run(pages).skip_log()
    counts = {r.stage: r["count"] for r in log.groupBy("stage").count().collect()}
    assert counts == {"short": 3, "duplicate": 13}
    failed = pages.withColumn("skipped", F.col("page_id") == 0).withColumn("reason", F.lit("403 Forbidden"))
    lines = [r.line for r in P.run(failed).skip_log().where("stage = 'error'").collect()]
    assert lines == ["[SKIPPED] https://h.example.org/0 — 403 Forbidden"]


def test_log_and_totals_are_those_of_the_run(spark, pages):
    """Filters, scope and refined text count: kept and skipped pages are the chosen ones."""
    settings = CorpusSettings(include=("example",), exclude=("/1",), max_pages=9)
    for output in (None, F.col("url")):
        for refine in (None, lambda t: "the same text for all pages"):
            done = P.run(pages, settings, output, refine=refine)
            chosen = {r.url for r in P.select_urls(pages, settings).collect()}
            kept = {r.url for r in done.docs.join(done.assigned.select("ord"), "ord").collect()}
            skipped = [r.url for r in done.skip_log().collect()]
            assert kept | set(skipped) == chosen and len(kept) + len(skipped) == len(chosen)
            assert tuple(done.totals().first()) == (len(kept), len(chosen), len(skipped))
            if refine is not None:
                ok = done.docs.where("long_enough").count()
                assert len(kept) == (1 if output is None else ok)


def test_errors_of_hooks_are_in_the_log(spark, pages):
    def fn(text):
        if "Number 3" in text:
            raise ValueError("no answer")
        return text

    done = P.run(pages, summarize=fn, refine=fn)
    hooks = done.skip_log().where("stage = 'hook'").collect()
    assert sorted(r.url[-2:] for r in hooks) == ["/3", "10", "17"]
    assert {r.reason for r in hooks} == {"summarize: ValueError: no answer; refine: ValueError: no answer"}
    assert hooks[0].line == f"[ERROR] {hooks[0].url} — {hooks[0].reason}"
    assert done.totals().first().total == 23


def test_settings_refuse_unknown_formats():
    with pytest.raises(ValueError):
        CorpusSettings(fmt="html")


def test_refine_falls_back_per_page(spark):
    def fn(text):
        if "bad" in text:
            raise RuntimeError
        return text.upper()

    docs = spark.createDataFrame([(0, "aa\n\nbb"), (1, "aa\n\nbad"), (2, " \n "), (3, "")], "id int, content string")
    got = enrich.refine(docs, fn, 4).orderBy("id").collect()
    assert [r.content for r in got] == ["AA\n\nBB", "aa\n\nbad", " \n ", ""]
    assert [r.hook_error for r in got] == [None, "refine: RuntimeError: ", None, None]


def test_summaries(spark):
    docs = spark.createDataFrame([(0, "t", "x"), (1, "t", " "), (2, "fail", "x")], "id int, title string, content string")

    def fn(prompt):
        if "fail" in prompt:
            raise RuntimeError
        return " " + "w " * 80

    got = [r.summary for r in enrich.summarize(docs, fn).orderBy("id").collect()]
    assert got == [" ".join(["w"] * 60) + "...", None, None]


def test_stream_ingest_in_two_batches(spark, pages, tmp_path):
    source, store, checkpoint = (str(tmp_path / n) for n in ("in", "store", "cp"))
    pages.where("page_id < 5").coalesce(1).write.parquet(source)
    stream = S.page_stream(spark, source, pages.schema)
    S.ingest(stream, store, checkpoint).awaitTermination()
    assert S.stored(spark, store).count() == 5
    pages.where("page_id >= 3").coalesce(1).write.mode("append").parquet(source)
    S.ingest(S.page_stream(spark, source, pages.schema), store, checkpoint).awaitTermination()
    rows = S.stored(spark, store).collect()
    assert sorted(r.ord for r in rows) == list(range(7))
    assert {r.batch_id for r in rows} == {0, 1}
    # Another stream with a checkpoint of its own adds to the same store, and takes nothing away.
    other = str(tmp_path / "other")
    pages.where("page_id in (1, 5, 20) or page_id = 22").union(spark.createDataFrame([page(30, "A text that is new to the store and long enough to be kept in it.")], pages.schema)).coalesce(1).write.parquet(other)
    S.ingest(S.page_stream(spark, other, pages.schema), store, str(tmp_path / "cp2")).awaitTermination()
    assert sorted(r.ord for r in S.stored(spark, store).collect()) == [*range(7), 30]
    assert S.stored(spark, store).select("run").distinct().count() == 2


def test_fetches_a_day_apart(spark, tmp_path):
    """The same rows however the fetches are batched."""
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    hours = [0, 1, 24, 25, 26, 40, 49, 50, 51, 200, 224, 225, 300]
    rows = [(u, start + timedelta(hours=h + shift)) for u, shift in (("a", 0), ("b", 5)) for h in hours] + [("a", start), (None, start), ("a", None)]
    want = [("a", h) for h in (0, 25, 50, 200, 225, 300)] + [("b", h + 5) for h in (0, 25, 50, 200, 225, 300)]
    df = spark.createDataFrame(rows, "url string, fetched_at timestamp")
    for cuts in ([], [30], [1, 26, 60, 210]):
        source, store, checkpoint = (str(tmp_path / f"{len(cuts)}-{n}") for n in ("in", "store", "cp"))
        for low, high in zip([-1, *cuts], [*cuts, 10_000], strict=True):
            hour = (F.unix_timestamp("fetched_at") - int(start.replace(tzinfo=__import__("datetime").timezone.utc).timestamp())) / 3600
            df.where(hour.between(low, high) & (hour > low) | F.col("fetched_at").isNull() & F.lit(low == -1)).write.mode("append").parquet(source)
            S.spaced_fetches(S.page_stream(spark, source, df.schema), store, checkpoint).awaitTermination()
        got = S.read_store(spark, store, S.FETCH).collect()
        assert sorted((r.url, round((r.fetched_at - start).total_seconds() / 3600)) for r in got) == sorted(want)


def test_part_roots():
    from foliomill.sinks.filesystem import filesystem, shared_root

    assert shared_root("/out", "local[2]") == "/out" and shared_root("s3a://b/x", "spark://c") == "s3a://b/x"
    assert shared_root("file://shared/out", "spark://c") == "file://shared/out"
    for root in ("/out", "file:///out", "file:/out", "out"):
        with pytest.raises(ValueError):
            shared_root(root, "spark://c")
    assert filesystem("file:///a/b")[1] == filesystem("file:/a/b")[1] == filesystem("/a/b")[1] == filesystem("file://shared/a/b")[1] == "/a/b"


@pytest.mark.parametrize("fmt", ["md", "txt", "jsonl"])
def test_part_files_in_the_shared_folder_of_a_cluster(spark, monkeypatch, tmp_path, fmt):
    records = spark.createDataFrame([("site", 1, 1, "a\n"), ("site", 1, 2, "b\n"), ("site", 2, 3, "c\n")], "output string, part long, seq long, text string")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://cluster:7077")
    for root in (storage.new_path(spark, "parts"), f"file://{storage.new_path(spark, 'parts')}"):
        manifest = write_parts(records, fmt, root).orderBy("part").collect()
        assert [r.n_records for r in manifest] == [2, 1]
        folder = Path(root.removeprefix("file://")) / "site"
        assert [(folder / r.filename).read_text() for r in manifest] == ["a\nb\n", "c\n"]
    for root in (str(tmp_path), f"{storage.shared_dir(spark)}/../elsewhere", f"{storage.shared_dir(spark)}-2/x"):
        with pytest.raises(ValueError):
            write_parts(records, fmt, root)


@pytest.mark.parametrize("fmt", ["md", "txt", "jsonl"])
def test_part_files_of_pages_without_url(spark, tmp_path, fmt):
    rows = [page(i, f"Page {i} has some words that make it long enough to be kept, and a few more of them.") for i in range(6)]
    pages = spark.createDataFrame([(i, None if i % 2 else url, html) for i, url, html in rows], "page_id bigint, url string, html string")
    manifest = P.write_corpus(pages, CorpusSettings(fmt=fmt, split_limit=1_000), root=str(tmp_path)).orderBy("part").collect()
    texts = [(tmp_path / "corpus" / r.filename).read_text() for r in manifest]
    assert sum(r.n_records for r in manifest) == 6 and [len(t) for t in texts] == [r.n_chars for r in manifest]
    assert all(len(t) <= 1_000 or r.n_records < 2 for t, r in zip(texts, manifest, strict=True))
    assert all(sum(f"Page {i} has some words" in t for t in texts) == 1 for i in range(6))


def test_part_files_behind_a_mount(spark, tmp_path):
    records = spark.createDataFrame([("site", 1, 1, "a\n")], "output string, part long, seq long, text string")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.parts.link./out", f"file:{tmp_path}")
    (row,) = write_parts(records, "txt", "viewfs://parts/out/run").collect()
    assert (tmp_path / "run" / "site" / row.filename).read_text() == "a\n"


def test_shared_folder(spark, monkeypatch):
    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    elsewhere = SimpleNamespace(
        conf=SimpleNamespace(get=lambda *a: None),
        sparkContext=SimpleNamespace(master="spark://cluster", getConf=lambda: SimpleNamespace(get=lambda k: None), getCheckpointDir=lambda: None),
    )
    with pytest.raises(RuntimeError):
        storage.shared_dir(elsewhere)


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= entry_module.queries().keys() and ORACLE.keys() <= entry_module.oracle_sql().keys()


CHECKED = ["corpus", "rich_markdown", "md_parts", "crawl_bfs_filtered", "sitemap_union", "url_join", "fetch_outcome", "chunk_text", "greedy_split_header"]


@pytest.mark.parametrize("name", CHECKED)
def test_queries_agree_with_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    df = entry_module.queries()[name](spark, sf_dir)
    result = con.execute(entry_module.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in result.description], result.fetchall())


def test_contents_are_exchanged_by_part_only(spark, sf_dir):
    """Documents are stored in buckets: they meet their parts where they are, and only records for files move."""
    from foliomill.plans import corpus as P
    from foliomill.storage import written_by

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = P.run(spark.read.parquet(f"{sf_dir}/pages.parquet"), CorpusSettings())
        records = P.part_records(done.docs, done.assigned, done.settings)
        plan = records._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount" in plan and "SortMergeJoin" in plan
        for part in plan.split("Exchange ")[1:]:
            # What an exchange reads: the subtree under it begins with its scan.
            assert "content#" not in part.split("Exchange ")[0].split("FileScan parquet")[-1], part
        assert records.count() > 50
        rows = spark.range(50).selectExpr("id", "id * 2 as twice")
        stored = written_by(rows.repartition(4, "id"), "buckets", "id")
        assert sorted(r.twice for r in stored.collect()) == [2 * i for i in range(50)]
        assert len(stored.inputFiles()) == 4 and not [t for t in spark.catalog.listTables() if t.name.startswith("foliomill_")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
