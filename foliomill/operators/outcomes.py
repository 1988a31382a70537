"""Fetch attempts to outcomes, cache freshness, order restore, skip log and run counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill import fixed_values as fv


def fetch_outcome(attempts: DataFrame, max_attempts: int = fv.FETCH_ATTEMPTS) -> DataFrame:
    """(url, attempt, status, skipped, reason) from (url, attempt, status, error).

    403 and 404 end a URL at once, success too; other statuses from 400, timeouts and errors end it at
    the last attempt.  The first ending attempt of each URL is found by an aggregate that combines on
    the map side, so a URL with very many attempts is no hot spot.
    """
    status, error, attempt = F.col("status"), F.col("error"), F.col("attempt")
    failed = error.isNotNull()
    last = attempt == max_attempts
    ends = (~failed & (status.isin(403, 404) | (status < 400))) | last
    reason = (
        F.when(failed & (error == "timeout"), fv.REASON_TIMEOUT)
        .when(failed, error)
        .when(status == 403, fv.REASON_FORBIDDEN)
        .when(status == 404, fv.REASON_NOT_FOUND)
        .when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string")))
        .otherwise("")
    )
    outcome = F.struct(
        attempt.cast("bigint").alias("attempt"),
        F.when(failed, 0).otherwise(status).cast("bigint").alias("status"),
        reason.alias("reason"),
    )
    first = attempts.where(attempt <= max_attempts).groupBy("url").agg(F.min(F.when(ends, outcome)).alias("o"))
    return first.select(
        "url",
        F.col("o.attempt").alias("attempt"),
        F.coalesce("o.status", F.lit(0)).alias("status"),
        (F.coalesce("o.reason", F.lit(fv.REASON_EXHAUSTED)) != "").alias("skipped"),
        F.coalesce("o.reason", F.lit(fv.REASON_EXHAUSTED)).alias("reason"),
    )


def is_fresh(now: Column, ttl_seconds: int = fv.CACHE_TTL_SECONDS) -> Column:
    return (F.col("status") == 200) & (F.col("fetched_at") > now - F.expr(f"interval {ttl_seconds} seconds"))


def refetch_set(urls: DataFrame, snapshot: DataFrame, now: Column) -> DataFrame:
    """URLs without a successful fetch in the last 24 hours."""
    fresh = snapshot.where(is_fresh(now)).select("url")
    return urls.join(fresh, "url", "left_anti")


def reusable_set(urls: DataFrame, snapshot: DataFrame, now: Column) -> DataFrame:
    """URLs whose stored page is still fresh."""
    fresh = snapshot.where(is_fresh(now)).select("url")
    return urls.join(fresh, "url", "left_semi")


def order_restore(pages: DataFrame, urls: DataFrame, missing: int | None = None) -> DataFrame:
    """Pages with the position of their URL, the last one for a repeated URL.

    An unknown URL has no position (sort with nulls last), or ``missing``; a number put in its place
    (``fixed_values.MISSING_POSITION``) lands amid the others as soon as there are more URLs than that.
    """
    positions = urls.groupBy("url").agg(F.max("ord").alias("restored_ord"))
    joined = pages.join(positions, "url", "left")
    return joined if missing is None else joined.fillna(missing, ["restored_ord"])


def page_stage(failed: Column, long_enough: Column, first_copy: Column) -> Column:
    """Why a page is left out: ``error``, ``short`` or ``duplicate``, in this order; null if it is kept."""
    return (
        F.when(failed, "error")
        .when(~F.coalesce(long_enough, F.lit(False)), "short")
        .when(~F.coalesce(first_copy, F.lit(False)), "duplicate")
    )


def skip_log(statuses: DataFrame, min_length: int = fv.MIN_LENGTH) -> DataFrame:
    """(url, stage, reason, line) of every page left out, from (url, stage, reason, error_type).

    ``error_type`` is the class of an error that is none of the known outcomes, which makes its line an
    error line.  A page with a ``hook_error`` has a further line of stage ``hook``; it need not be left out.
    """
    rows = statuses.where("stage is not null").select(
        "url", "stage",
        F.when(F.col("stage") == "error", F.col("reason")).when(F.col("stage") == "short", fv.REASON_SHORT.format(min_length)).otherwise(fv.REASON_DUPLICATE).alias("reason"),
        F.when(F.col("stage") == "error", F.col("error_type")).alias("error_type"),
    )
    skipped = F.concat(F.lit("[SKIPPED] "), "url", F.lit(" — "), "reason")
    error = F.concat(F.lit("[ERROR] "), "url", F.lit(" — "), "error_type", F.lit(": "), "reason")
    log = rows.select("url", "stage", "reason", F.coalesce(error, skipped).alias("line"))
    if "hook_error" not in statuses.columns:
        return log
    line = F.concat(F.lit("[ERROR] "), "url", F.lit(" — "), "hook_error")
    hooks = statuses.where("hook_error is not null")
    return log.unionByName(hooks.select("url", F.lit("hook").alias("stage"), F.col("hook_error").alias("reason"), line.alias("line")))


def skip_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def run_totals(statuses: DataFrame) -> DataFrame:
    """One row (kept, total, skipped) from a table with a boolean ``kept``."""
    kept = F.count_if(F.col("kept"))
    return statuses.agg(kept.alias("kept"), F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - kept).alias("skipped"))


def size_estimate(urls: DataFrame, group: str, split_limit: int = fv.SPLIT_LIMIT, concurrency: int = fv.CONCURRENCY) -> DataFrame:
    """Expected characters, parts and seconds of a run, from the number of its URLs."""
    counts = urls.groupBy(group).agg(F.count(F.lit(1)).alias("n_urls"))
    chars = F.col("n_urls") * fv.EST_CHARS_PER_PAGE
    parts = F.greatest(F.lit(1), F.floor(chars / split_limit) + 1)
    seconds = F.col("n_urls") / concurrency * fv.EST_SECONDS_PER_PAGE
    return counts.select(
        group, "n_urls", chars.alias("est_chars"), parts.cast("bigint").alias("est_parts"), seconds.alias("est_seconds")
    )


def preview(urls: DataFrame, n: int = fv.PREVIEW_URLS) -> DataFrame:
    """The first URLs of a run and how many more there are."""
    more = urls.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).cast("bigint"))
    return urls.select("ord", "url").orderBy("ord").limit(n).withColumn("n_more", more.scalar())


def part_summary(assigned: DataFrame) -> DataFrame:
    """Records and characters of each part, from (output, part, n_chars)."""
    return assigned.groupBy("output", "part").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum("n_chars").alias("n_chars")
    )
