"""URL filter by mined association rules, with explicit rules before them.

Labelled URLs are transactions of tokens (scheme, host labels, path words, extension, query keys) and of what they
are labelled as.  FP-growth finds token combinations that are frequent, and those that mean "block" with enough
confidence become rules.  A rule is indexed by its rarest token: a URL meets only rules whose rarest token it has,
and is then checked for the others.

URLs with the same tokens are matched once; numbers are one token, so there are far fewer sets than URLs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.storage import written

BLOCK = "label:block"
ALLOW = "label:allow"
MIN_SUPPORT = 0.002
MIN_COUNT = 5
MIN_CONFIDENCE = 0.7
MAX_TOKENS = 3
#: Explicit rules that may be given; they are tried in the row.
MAX_EXPLICIT = 1_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """The tokens of a URL as a sorted array without repeats; numbers are all ``#``.  None without ``://``."""
    u, host, path = F.lower(F.coalesce(url, F.lit(""))), host_of(url), path_of(url)

    def number(t: Column) -> Column:
        return F.regexp_replace(t, r"\d+", "#")

    def tagged(name: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda t: t != ""), lambda t: F.concat(F.lit(f"{name}:"), number(t)))

    query = F.regexp_extract(u, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    every = F.concat(
        tagged("scheme", F.array(F.regexp_extract(u, r"(?s)^(.*?)://", 1))),
        tagged("host", F.array(host)), tagged("name", F.split(host, r"[.\-]")), tagged("suffix", F.array(F.regexp_extract(host, r"[^.]+$", 0))),
        tagged("path", F.split(F.lower(path), r"[/.\-_]")),
        tagged("query", F.regexp_extract_all(query, F.lit(r"([^&=]+)(=[^&]*)?"), 1)),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(every)))


def mine(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE,
    max_tokens: int = MAX_TOKENS, url_col: str = "url", bad_col: str = "bad",
) -> DataFrame:
    """``(tokens, confidence, support)``: rules "all of these tokens, so block", at most ``max_tokens`` tokens each.

    ``bad_col`` is a boolean; rows where it or all tokens are missing teach nothing.  ``min_count`` holds as well as
    ``min_support``.  A rule is dropped if a rule on fewer of its tokens is at least as confident.
    """
    label = F.when(F.col(bad_col), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    rows = written(
        labelled.where(F.col(bad_col).isNotNull()).select(tokens_of(F.col(url_col)).alias("tokens"), label.alias("label"))
        .where(F.size("tokens") > 0).select(F.concat("tokens", F.array("label")).alias("items")),
        "url-transactions",
    )
    n = rows.count()
    if n < min_count:
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_count / n), minConfidence=min_confidence).fit(rows)
    rules = written(
        model.associationRules.where(F.array_contains("consequent", BLOCK) & (F.size("antecedent") <= max_tokens))
        .where(~F.array_contains("antecedent", ALLOW))
        .select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"),
        "url-rules",
    )
    # All smaller token sets of a rule, as keys: at most 2 ** max_tokens.
    small = rules.select("tokens", "confidence", F.explode("tokens").alias("dropped")).select(
        "tokens", "confidence", F.array_remove("tokens", F.col("dropped")).alias("less")
    )
    smaller = small.union(
        small.select("tokens", "confidence", "less", F.explode("less").alias("dropped")).select("tokens", "confidence", F.array_remove("less", F.col("dropped")))
    ).where(F.size("less") > 0)
    known = rules.select(F.col("tokens").alias("less"), F.col("confidence").alias("sure"))
    dropped = smaller.join(known, "less").where("sure >= confidence").select("tokens")
    return rules.join(dropped, "tokens", "left_anti")


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``(tokens, mined, confidence)``: the most confident rule of each token set that has one (ties by spelling)."""
    rarity = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    of_rule = rules.withColumnRenamed("tokens", "needed").select("needed", "confidence", F.explode("needed").alias("token"))
    index = of_rule.join(rarity, "token").groupBy("needed", "confidence").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("needed", "tokens")) == 0)
    return met.groupBy("tokens").agg(F.max(F.struct("confidence", F.array_join("needed", " ").alias("mined"))).alias("best")).select("tokens", "best.mined", "best.confidence")


def _explicit(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as ``(length, rule, verdict)``; null if none does."""
    if len(rules) > MAX_EXPLICIT:
        raise ValueError(f"at most {MAX_EXPLICIT} explicit rules; give more as labels")
    fits = []
    for rule, verdict in rules:
        rule_host, slash, rule_path = rule.partition("/")
        ok = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rule_path)
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def judge(
    pages: DataFrame, labelled: DataFrame, explicit: Sequence[tuple[str, str]] = (), id_col: str = "page_id", url_col: str = "url", **mining,
) -> DataFrame:
    """``(page_id, host, path, rule, mined, verdict)``, one row per row of ``pages``.

    ``explicit``: pairs of ``host/path`` and ``allow`` or ``block``; one fits its host and all subdomains if the path
    starts with the rule's, and the longest wins.  Else a URL that meets a mined rule is blocked and any other
    allowed.  A null URL, or one without ``://``, has neither host, path nor tokens and is allowed.  Repeated rows and
    ids are judged one by one; without labels nothing is mined.
    """
    rules = mine(labelled, **mining)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), tokens_of(F.col("url")).alias("tokens")
    )
    sets = written(rows.select("tokens").distinct(), "url-token-sets")
    found = written(matched(sets, rules), "url-matches")
    fit = _explicit(F.col("host"), F.col("path"), explicit)
    return rows.join(found, "tokens", "left").withColumn("fit", fit).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), "mined",
        F.coalesce(F.col("fit.verdict"), F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )
