"""A corpus run: stored pages in, deduplicated and size-bounded outputs out.

Exchanges of a run: pages by page once (as HTML), keys by content hash once, positions by output, and
finished records by part once; contents are exchanged by part only.  The documents are written to the shared folder after extraction, with all
lengths that later steps ask for, so length rule, dedup and split read narrow columns of them, and a lost
executor never repeats the extraction.  Outputs, skip log and totals come from the same stored run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions import formats as R
from foliomill.functions import html as H
from foliomill.functions import text as X
from foliomill.functions import urls as U
from foliomill.operators import dedup, enrich, filters, outcomes, split, toc
from foliomill.operators.content import page_content
from foliomill.operators.tokens import by_page
from foliomill.settings import CorpusSettings
from foliomill.sinks.parts import write_parts
from foliomill.storage import written, written_by


#: Ends the URL of a page in the string that is exchanged; a noncharacter, which no URL holds.
_URL_END = "\ufdd4"
#: What a page may lack; part files have nothing in its place.
_NAMED = ["title", "url"]


def documents(pages: DataFrame, selector: str | None = None) -> DataFrame:
    """(ord, url, title, content, n_chars, content_md5) of every usable page, '' where nothing is left."""
    usable = filters.usable(pages).where("page_id is not null")
    # Titles and contents read one exchange.  It carries URL and HTML as a single string, so that both readers
    # ask for the same column and the plan reuses the scan and the exchange instead of repeating them.
    packed = F.concat(F.coalesce("url", F.lit("")), F.lit(_URL_END), "html")
    pages_by_id = by_page(usable.select("page_id", packed.alias("html")))
    at = F.instr("html", F.lit(_URL_END))
    html = F.substring(F.col("html"), (at + 1).cast("int"), F.length("html"))
    url = F.nullif(F.substring(F.col("html"), F.lit(1), (at - 1).cast("int")), F.lit(""))
    titles = pages_by_id.select("page_id", url.alias("url"), H.page_title(html).alias("title"))
    content = page_content(pages_by_id.select("page_id", html.alias("html")), selector).select("page_id", "content")
    docs = titles.join(content, "page_id", "left").select(
        F.col("page_id").alias("ord"), "url", "title", F.coalesce("content", F.lit("")).alias("content")
    )
    return with_sizes(docs)


def with_sizes(docs: DataFrame) -> DataFrame:
    return docs.select(
        "*", F.length("content").cast("bigint").alias("n_chars"), X.content_md5(F.col("content")).alias("content_md5"),
        F.length(X.strip(F.col("content"))).cast("bigint").alias("n_stripped"),
    )


def site_output() -> Column:
    """One output per site: the slug of scheme and host."""
    return U.site_slug(F.concat(U.scheme(F.col("url")), F.lit("://"), U.netloc(F.col("url"))))


def select_urls(pages: DataFrame, settings: CorpusSettings) -> DataFrame:
    """Include, exclude and limit, before any page is read in full.

    The limit is a top-k over ids alone; its last id then filters the scan.
    """
    chosen = filters.exclude(filters.include(pages, settings.include), settings.exclude)
    if settings.max_pages <= 0:
        return chosen
    last = filters.first_n(chosen.select("page_id"), settings.max_pages, "page_id").agg(F.max("page_id"))
    return chosen.where(F.col("page_id") <= last.scalar())


def run_documents(
    chosen: DataFrame,
    settings: CorpusSettings,
    output: Column | None = None,
    summarize: Callable[[str], str] | None = None,
    refine: Callable[[str], str] | None = None,
    lacking: str | None = None,
) -> DataFrame:
    """The documents of the chosen pages with their output, stored; ``long_enough`` says which are.

    ``lacking`` stands for a missing title or URL in the length of the record; without it that is null.  Length is judged before refining, a summary is made of the text before refining, and copies are
    found (later) in the text after it.
    """
    docs = documents(chosen, settings.selector)
    docs = docs.withColumn("output", F.lit("corpus") if output is None else output).withColumn(
        "long_enough", (F.col("n_chars") > 0) & (F.col("n_stripped") >= settings.min_length)
    )
    hooked = summarize is not None or refine is not None
    if hooked:
        # Stored first: the hooks must not repeat the extraction.
        docs = written(docs, "documents")
        if summarize is not None:
            docs = enrich.summarize(docs, summarize)
        if refine is not None:
            docs = with_sizes(enrich.refine(docs, refine).drop("n_chars", "content_md5", "n_stripped"))
    sized = docs.withColumn("record_chars", F.length(_record(docs, settings, lacking)).cast("bigint"))
    # Without hooks the rows are still where the extraction put them, by page: stored so, they join their parts in place.
    return written(sized, "documents") if hooked else written_by(sized, "documents", "ord")


def _record(docs: DataFrame, settings: CorpusSettings, lacking: str | None = None) -> Column:
    summary = F.col("summary") if "summary" in docs.columns else None
    title, url = (F.col(name) if lacking is None else F.coalesce(name, F.lit(lacking)) for name in _NAMED)
    return R.record_text(settings.fmt, title, url, F.col("content"), F.lit(settings.collected_at), summary)


def assign_parts(docs: DataFrame, settings: CorpusSettings, base_urls: DataFrame | None = None) -> DataFrame:
    """(output, ord, part, seq) of the first document of each content, by the length of its record."""
    sizes = docs.where("long_enough").select("output", "content_md5", "ord", "title", "url", F.col("record_chars").alias("n_chars"))
    winners = dedup.content_winners(sizes.select("output", "content_md5", "ord"), ["output"])
    kept = written(sizes.drop("content_md5").join(winners.select("ord"), "ord", "left_semi"), "kept")
    headers = None
    if settings.fmt == "md":
        headers = toc.toc_headers(kept)
    elif settings.fmt == "txt" and base_urls is not None:
        headers = toc.banner_headers(base_urls, settings.product, settings.collected_at)
    return split.greedy_split(kept, settings.split_limit, headers, settings.rows_per_chunk)


@dataclass(frozen=True)
class CorpusRun:
    """One run: its documents, where each kept one goes, and what became of every chosen page.

    ``docs``: as :func:`run_documents` stores them; ``assigned``: (output, ord, part, seq) of kept ones;
    ``statuses``: (page_id, url, stage, reason, error_type, kept), ``stage`` null for kept pages, and ``hook_error`` of a
    run with hooks.
    """

    docs: DataFrame
    assigned: DataFrame
    statuses: DataFrame
    settings: CorpusSettings

    def skip_log(self) -> DataFrame:
        return outcomes.skip_log(self.statuses, self.settings.min_length)

    def totals(self) -> DataFrame:
        return outcomes.run_totals(self.statuses)


def run(
    pages: DataFrame,
    settings: CorpusSettings = CorpusSettings(),
    output: Column | None = None,
    base_urls: DataFrame | None = None,
    summarize: Callable[[str], str] | None = None,
    refine: Callable[[str], str] | None = None,
) -> CorpusRun:
    """Extract the chosen pages once; outputs, skip log and totals are read off what is stored.

    ``pages`` may have ``skipped``, ``reason`` and ``error_type``, the results of fetching.
    """
    chosen = select_urls(pages, settings)
    docs = run_documents(chosen, settings, output, summarize, refine, lacking="")
    assigned = written(assign_parts(docs.fillna("", _NAMED), settings, base_urls), "assigned")

    def given(name: str, default: Column) -> Column:
        return (F.coalesce(F.col(name), default) if name in pages.columns else default).alias(name)

    none = F.lit(None).cast("string")
    fetched = chosen.select("page_id", "url", given("skipped", F.lit(False)), given("reason", none), given("error_type", none))
    hooks = ["hook_error"] if "hook_error" in docs.columns else []
    judged = docs.select(F.col("ord").alias("page_id"), "long_enough", *hooks)
    winners = assigned.select(F.col("ord").alias("page_id"), F.lit(True).alias("first_copy"))
    stage = outcomes.page_stage(F.col("skipped"), F.col("long_enough"), F.col("first_copy"))
    statuses = fetched.join(judged, "page_id", "left").join(winners, "page_id", "left").withColumn("stage", stage)
    columns = ["page_id", "url", "stage", "reason", "error_type", F.col("stage").isNull().alias("kept"), *hooks]
    return CorpusRun(docs, assigned, statuses.select(*columns), settings)


def corpus(
    pages: DataFrame,
    settings: CorpusSettings = CorpusSettings(),
    output: Column | None = None,
    summarize: Callable[[str], str] | None = None,
    refine: Callable[[str], str] | None = None,
) -> DataFrame:
    """One row per kept page: (output, part, seq, ord, url, title, n_chars, content_md5, content)."""
    docs = run_documents(select_urls(pages, settings), settings, output, summarize, refine)
    assigned = assign_parts(docs, settings)
    columns = ["output", "part", "seq", "ord", "url", "title", "n_chars", "content_md5", "content"]
    return docs.drop("output").join(assigned, "ord").select(*columns)


def part_records(docs: DataFrame, assigned: DataFrame, settings: CorpusSettings, base_urls: DataFrame | None = None) -> DataFrame:
    """(output, part, seq, text): everything the part files hold; header lines have seq <= 0."""
    text = _record(docs, settings, lacking="")
    records = docs.drop("output").join(assigned, "ord").select("output", "part", "seq", text.alias("text"))
    first = F.lit(1).cast("bigint").alias("part")
    if settings.fmt == "md":
        lines = toc.toc_lines(toc.toc_entries(assigned, docs.fillna("", _NAMED)))
        # Line numbers run up, so a fixed large offset keeps them in order and below the first record.
        order = (F.col("line_no") - F.lit(2**62)).alias("seq")
        records = records.unionByName(lines.select("output", first, order, F.concat("line", F.lit("\n")).alias("text")))
    elif settings.fmt == "txt" and base_urls is not None:
        banners = toc.banner_headers(base_urls, settings.product, settings.collected_at)
        banners = banners.join(assigned.select("output").distinct(), "output", "left_semi")
        zero = F.lit(0).cast("bigint").alias("seq")
        records = records.unionByName(banners.select("output", first, zero, F.col("banner").alias("text")))
    return records


def write_corpus(
    pages: DataFrame,
    settings: CorpusSettings,
    output: Column | None = None,
    root: str | None = None,
    base_urls: DataFrame | None = None,
    summarize: Callable[[str], str] | None = None,
    refine: Callable[[str], str] | None = None,
) -> DataFrame:
    """Run and write all part files; returns the manifest (output, part, filename, sizes, digest).

    ``base_urls`` is (output, base_url), for the banner of text outputs.
    """
    done = run(pages, settings, output, base_urls, summarize, refine)
    return write_parts(part_records(done.docs, done.assigned, settings, base_urls), settings.fmt, root)
