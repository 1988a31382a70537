"""Quality rules with verdicts on hosts.

Each document is measured and judged by base rules.  Rule failures are counted by host, the rates of hosts are
shrunk towards the rate of all hosts with a beta prior fitted to the counts themselves (moments), and a host whose
shrunk rate is too high for any rule takes its documents with it.

All is built-in functions.  Measures are computed within the row (no text is exchanged); hosts are counted by a
map-side combined aggregate, so a host with a third of all rows reaches its reducer as one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.storage import written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Rules that are counted by host: share of failing documents beyond which the host is rejected.
HOST_LIMITS = {"short": 0.6, "repetitive": 0.6, "symbols": 0.6, "dup_lines": 0.6, "any": 0.75}
MIN_WORDS = 10
WINDOW = 5


def words(text: Column) -> Column:
    """Maximal runs of characters that are not ASCII white space; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _repeat_words(w: Column, window: int) -> Column:
    """Words inside a window of ``window`` words that is found twice or more, within one array of words.

    Hashes of windows are compared as a set first; only a text with a repeated window sorts them.
    """
    n = F.size(w)
    hashes = F.when(n < window, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
    )

    def counted(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i).getField("h") == F.get(s, j).getField("h"), F.lit(False))
            at = F.filter(F.transform(s, lambda x, i: F.when((same(i - 1, i)) | (same(i, i + 1)), x.getField("i"))), lambda i: i.isNotNull())
            return F.array_sort(at)

        def covered(p: Column) -> Column:
            return F.aggregate(
                p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")),
                lambda acc, i: F.struct(
                    (acc.getField("n") + F.least(F.lit(window), i - acc.getField("last")).cast("long")).alias("n"), i.alias("last")
                ),
                lambda acc: acc.getField("n"),
            )

        return _let(_let(ordered, starts), covered)

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(counted(h)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, doc)``, row by row.

    ``doc`` holds the columns of the row as they came.  A null or empty text measures zero throughout, and fails.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
    )
    measured = F.transform(
        F.array(words(F.col("text"))),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w, WINDOW).alias("n_repeat_words"),
        ),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return rows.select(
        "doc_id", "host", F.explode(measured).alias("m"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), dup.alias("n_dup_lines"), "doc",
    ).select(
        "doc_id", "host", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words",
        ((F.col("m.n_words") < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > 20 * F.col("m.n_words"))).alias("base_failed"), "doc",
    )


def failures() -> dict[str, Column]:
    """The rules that are counted by host, over the columns of :func:`measures`; the last is failing any of the others."""
    rules = {
        "short": F.col("n_words") < MIN_WORDS,
        "repetitive": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "dup_lines": 3 * F.col("n_dup_lines") > F.col("n_words"),
    }
    return rules | {"any": reduce(lambda a, b: a | b, rules.values())}


def host_rates(measured: DataFrame, limits: dict[str, float] = HOST_LIMITS) -> DataFrame:
    """``(host, n_docs, <rule>_rate ..., host_rejected)``, one row per non-null host.

    Of h hosts with n documents, k_i of n_i failing at host i, m = k / n.  The prior is Beta(m s, (1 - m) s), fitted by
    moments: under it the sum of n_i (k_i / n_i - m)^2 is expected to be m (1 - m) (h + (n - h) / (s + 1)), where the
    first part is what single documents scatter anyhow, however alike the hosts.  s is held within 1 and 1,000
    documents; hosts that differ by no more than chance, or have one document each, give the latter.  A host's shrunk rate
    is (k_i + m s) / (n_i + s); the host is rejected if the rate of any rule is over its limit.  Only sums over all
    hosts come to the driver.
    """
    rules = failures()
    counts = written(
        measured.where("host is not null").groupBy("host").agg(
            F.count("*").alias("n_docs"), *[F.sum(c.cast("long")).alias(r) for r, c in rules.items()]
        ),
        "host-counts",
    )
    sums = counts.agg(
        F.count("*").alias("hosts"), F.sum("n_docs").alias("n"), *[F.sum(r).alias(r) for r in rules], *[F.sum(F.col(r) * F.col(r) / F.col("n_docs")).alias(f"{r}_sq") for r in rules]
    ).first()
    rates = {}
    for r in rules:
        m = sums[r] / sums["n"] if sums["n"] else 0.0
        alike = 0.0  # the correlation of two documents of a host: 1 / (s + 1)
        if 0 < m < 1 and sums["n"] > sums["hosts"]:
            alike = ((sums[f"{r}_sq"] - sums["n"] * m * m) / (m * (1 - m)) - sums["hosts"]) / (sums["n"] - sums["hosts"])
        s = min(max(1 / alike - 1, 1.0), 1000.0) if alike > 0 else 1000.0
        rates[r] = (F.col(r) + m * s) / (F.col("n_docs") + s)
    rejected = reduce(lambda a, b: a | b, [c > limits[r] for r, c in rates.items() if r in limits])
    return counts.select("host", "n_docs", *[c.alias(f"{r}_rate") for r, c in rates.items()], rejected.alias("host_rejected"))


def _with_hosts(measured: DataFrame, rates: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """``measured`` with ``kept``.  Rejected hosts are counted and broadcast if few, else joined by a shuffle."""
    rejected = written(rates.where("host_rejected").select("host", "host_rejected"), "rejected-hosts")
    if rejected.count() <= max_broadcast_rows:
        rejected = F.broadcast(rejected)
    return measured.join(rejected, "host", "left").withColumn(
        "kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))
    )


def verdicts(
    docs: DataFrame, limits: dict[str, float] = HOST_LIMITS, id_col: str = "doc_id", text_col: str = "text",
    host_col: str = "source", max_broadcast_rows: int = 100_000,
) -> DataFrame:
    """Measures, ``base_failed``, ``host_rejected`` and ``kept``, one row per row of ``docs``.

    A document is kept if it passes the base rules and its host is not rejected.  A null host is no host: its
    documents are judged by the base rules alone.  Repeated rows and ids are judged, and counted, one by one.  An
    empty table gives an empty result.
    """
    measured = written(measures(docs, id_col, text_col, host_col).drop("doc"), "measures")
    judged = _with_hosts(measured, host_rates(measured, limits), max_broadcast_rows)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce("host_rejected", F.lit(False)).alias("host_rejected"), "kept",
    )


def kept_documents(
    docs: DataFrame, limits: dict[str, float] = HOST_LIMITS, id_col: str = "doc_id", text_col: str = "text",
    host_col: str = "source", max_broadcast_rows: int = 100_000,
) -> DataFrame:
    """The rows of ``docs`` that :func:`verdicts` keeps, with their columns.  Texts are measured twice, not exchanged."""
    measured = measures(docs, id_col, text_col, host_col)
    rates = host_rates(measured.drop("doc"), limits)
    return _with_hosts(measured, rates, max_broadcast_rows).where("kept").select("doc.*")
