"""Hooks for an outside text function: refine a page, summarise a page.

The function belongs to the user.  It runs in Arrow batches on the executors, map-only; an error in it
affects one page, which then keeps its text (refine) or has no summary (summarise).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill import fixed_values as fv
from foliomill.functions import text as X


def rejoin_chunks(chunks: DataFrame, key: str, position: str, text: str) -> DataFrame:
    """(key, text): pieces of a text joined with a blank line, in order."""
    return chunks.groupBy(key).agg(X.ordered_concat(position, text, "\n\n").alias("text"))


def _safely(fn: Callable[[str], str]) -> Callable[[str], tuple[str | None, str | None]]:
    def call(text: str) -> tuple[str | None, str | None]:
        try:
            return fn(text), None
        except Exception as e:  # noqa: BLE001 - any failure of the user's function means "no result"
            return None, f"{type(e).__name__}: {e}"

    return call


def _hook(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    """An array of texts to (answers, error): error is that of the first text which failed."""
    call = _safely(fn)

    @F.pandas_udf("answers array<string>, error string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pieces in batch:
                answers = None if pieces is None else [call(p) for p in pieces]
                rows.append((None if answers is None else [a for a, _ in answers], next((e for _, e in answers or () if e is not None), None)))
            yield pd.DataFrame(rows, columns=["answers", "error"])

    return apply


def with_error(docs: DataFrame, hook: str, error: Column) -> DataFrame:
    """Add a failure to ``hook_error``, after those of earlier hooks; null where nothing failed."""
    said = F.concat(F.lit(f"{hook}: "), error)
    earlier = F.col("hook_error") if "hook_error" in docs.columns else F.lit(None).cast("string")
    return docs.withColumn("hook_error", F.nullif(F.concat_ws("; ", earlier, said), F.lit("")))


def refine(docs: DataFrame, fn: Callable[[str], str], max_chars: int = fv.CHUNK_MAX_CHARS) -> DataFrame:
    """Replace ``content`` by its chunks passed through ``fn`` and rejoined.

    Blank content is left alone; if ``fn`` fails on any chunk of a page the page keeps its content, and
    ``hook_error`` says why.
    """
    blank = X.strip(F.col("content")) == ""
    pieces = F.when(~blank, X.chunk_text(F.col("content"), max_chars))
    refined = docs.withColumn("answer", _hook(fn)(pieces))
    failed = F.exists("answer.answers", lambda p: p.isNull())
    joined = F.when(F.col("answer.answers").isNotNull() & ~failed, F.array_join("answer.answers", "\n\n"))
    refined = refined.withColumn("content", F.coalesce(joined, F.col("content")))
    return with_error(refined, "refine", F.col("answer.error")).drop("answer")


def summarize(docs: DataFrame, fn: Callable[[str], str]) -> DataFrame:
    """Add ``summary``: ``fn`` of the title and the opening of the content, clamped; null, and ``hook_error``, on failure."""
    blank = X.strip(F.col("content")) == ""
    prompt = F.when(~blank, F.array(X.summary_input(F.col("title"), F.col("content"))))
    answered = docs.withColumn("answer", _hook(fn)(prompt))
    answered = answered.withColumn("summary", X.summary_clamp(F.try_element_at("answer.answers", F.lit(1))))
    return with_error(answered, "summarize", F.col("answer.error")).drop("answer")
