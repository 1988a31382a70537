"""Language identification by fusing evidence.

For each language the logarithms of four independent pieces of evidence are summed:

- the text: byte trigrams, hashed into a fixed table, under a model per language (trained on a bounded sample of
  labelled texts; whole texts are scored, and a text's weight saturates as its trigrams are not independent);
- the language that the page's markup declares, and the one its address suffix stands for, each by how often texts
  of a language carry that declaration (counted over all labelled documents);
- the host: how often its other documents are in the language by the evidence so far, smoothed towards its domain, and
  that towards all documents.  The document itself is left out of the counts.

Texts are read once and leave the task as one number per language; all else is grouped counts and narrow joins.  A host
with a third of all documents is one row of counts per task before anything is exchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.storage import written

CELLS = 1 << 15
#: Labelled texts a model is trained on, of each language at most.
MAX_PER_LANGUAGE = 400
MAX_LANGUAGES = 1_000
#: Trigrams beyond which more text adds little.
SATURATION = 100.0
#: Documents that a host must have to weigh as much as its domain, and a domain as much as all documents.
HOST_WEIGHT = 20.0
DOMAIN_WEIGHT = 100.0
OTHER = "other"
#: Suffixes of addresses and the language they stand for; languages' own codes need no entry.
SUFFIX_LANGUAGE = {"at": "de", "ch": "de", "uk": "en", "us": "en", "ie": "en", "au": "en", "mx": "es", "ar": "es", "cl": "es", "be": "fr"}


def markup_language(html: Column) -> Column:
    """The primary code that the ``html`` tag declares, in lower case; null if it declares none."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    return F.when(found != "", found)


def suffix_language(host: Column, path: Column, languages: list[str]) -> Column:
    """The language of the last part of the host, or else of the first part of the path; null if it is none."""
    known = {**{c: c for c in languages}, **{s: c for s, c in SUFFIX_LANGUAGE.items() if c in languages}}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.lit(None).cast("map<string,string>")
    last = F.regexp_extract(host, r"[^.]+$", 0)
    first = F.lower(F.regexp_extract(path, r"^/([A-Za-z]{2,3})(?:[/_\-]|$)", 1))
    return F.coalesce(F.try_element_at(table, last), F.when(first.isin(languages or [""]), first))


def _cells(text: bytes) -> np.ndarray:
    """The cells of the byte trigrams of a text, in lower case (ASCII)."""
    b = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.uint32)
    return ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(17)


def train(labelled: DataFrame, max_per_language: int = MAX_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log P(cell | language) as a table of cells by languages.

    ``labelled`` is ``(text, lang)`` with binary texts.  The sample takes the smallest hashes of texts of each language.
    """
    by_hash = Window.partitionBy("lang").orderBy("hash", "text")
    usable = labelled.where("text is not null and lang is not null").withColumn("hash", F.xxhash64("text"))
    # The hashes that the sample ends with come first, so only sampled texts are exchanged.  Each task hands on its
    # smallest max_per_language hashes of a language only (Spark limits a window's groups for such a filter).
    edge = usable.select("lang", "hash").distinct()
    edge = edge.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("n") <= max_per_language)
    last = written(edge.groupBy("lang").agg(F.max("hash").alias("last")), "language-samples")
    if last.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels: these are no languages")
    # One row per language, counted: broadcast, so that texts outside the sample stay where they are.
    sample = usable.join(F.broadcast(last), "lang").where("hash <= last").withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= max_per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total = sums.setdefault(lang, np.zeros(CELLS, np.int64))
                total += np.bincount(_cells(text.as_py()), minlength=CELLS)
        for lang, total in sums.items():
            cells = np.flatnonzero(total)
            yield pa.record_batch([pa.array([lang] * len(cells)), pa.array(cells), pa.array(total[cells])], names=["lang", "cell", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    rows = counts.toArrow()
    languages = sorted(set(rows.column("lang").to_pylist()))
    table = np.ones((CELLS, len(languages)), np.float64)
    at = np.array([languages.index(x) for x in rows.column("lang").to_pylist()], np.int64)
    if languages:
        np.add.at(table, (rows.column("cell").to_numpy(), at), rows.column("n").to_numpy())
    return languages, np.log(table / table.sum(axis=0))


def text_scores(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """``docs`` with its column ``text`` (binary) replaced by ``score``: weighted log likelihoods by language."""
    shared = docs.sparkSession.sparkContext.broadcast(table.astype(np.float32))
    at = docs.columns.index("text")
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = shared.value
        for batch in batches:
            scores = []
            for text in batch.column(at):
                cells = _cells(text.as_py() or b"")
                n = len(cells)
                counts = np.bincount(cells, minlength=CELLS) if n > CELLS else None
                total = counts @ log if counts is not None else log[cells].sum(axis=0, dtype=np.float64)
                scores.append((total / (1 + n / SATURATION)).tolist())
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.record_batch([*kept, pa.array(scores, pa.list_(pa.float64()))], names=[*names, "score"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{fields}, score array<double>")


def _declared(scored: DataFrame, column: str, languages: list[str]) -> dict[str, list[float]]:
    """log P(declaration | language) for each declaration, from all labelled rows that have one, add-one smoothed."""
    counts = {
        (r["value"], r["label"]): r["n"]
        for r in scored.where(F.col(column).isNotNull() & F.col("label").isin(languages or [""]))
        .groupBy(F.col(column).alias("value"), "label").agg(F.count("*").alias("n")).collect()
    }
    values = [*languages, OTHER]
    rows = {}
    for v in values:
        rows[v] = []
        for c in languages:
            total = sum(counts.get((w, c), 0) for w in values)
            rows[v].append(math.log((counts.get((v, c), 0) + 1) / (total + len(values))))
    return rows


def _lookup(column: str, rows: dict[str, list[float]], size: int) -> Column:
    value = F.array(*[F.lit(0.0)] * size)
    for v, logs in rows.items():
        value = F.when(F.col(column) == v, F.array(*[F.lit(x) for x in logs])).otherwise(value)
    return value


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _best(score: Column) -> Column:
    """The place of the largest score; the first of equals."""
    return (F.array_position(score, F.array_max(score)) - 1).cast("int")


def identify(
    docs: DataFrame, evidence: DataFrame, max_per_language: int = MAX_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "lang", host_col: str = "source",
) -> DataFrame:
    """``(doc_id, lang, probability, text_lang, host)``, one row per row of ``docs``.

    ``evidence`` is ``(doc_id, host, domain, markup, path)``, any number of rows per id, such as its pages; a document without
    such a row has its ``host_col`` as host and no domain.  Every row of evidence counts for its host and for the reliability
    of what it declares; the log likelihoods of a document's rows are averaged, as they are of one document, and the
    first of its hosts by spelling is reported.  ``label_col`` is the known language where there is one: it trains the text model
    and the reliability of declarations, and is not looked at for the document's own verdict beyond that.

    A null or empty text is judged by the other evidence; a null host has no counts, so its prior is that of all
    documents.  Repeated rows and ids are judged one by one.  Without any label there are no languages, and ``lang`` is
    null; equal scores go to the first language by spelling.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("own_host"),
        F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("binary").alias("text"),
    )
    languages, table = train(rows.select("text", F.col("label").alias("lang")), max_per_language)
    if not languages:
        none = F.lit(None).cast("string")
        return rows.select("doc_id", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), F.col("own_host").alias("host"))
    size = len(languages)
    names = F.array(*[F.lit(c) for c in languages])

    def code(c: Column) -> Column:
        return F.when(c.isin(languages), c).when(c.isNotNull(), F.lit(OTHER))

    seen = evidence.select(
        F.col("doc_id").alias("_id"), F.col("host").alias("page_host"), "domain", code(F.col("markup")).alias("markup"),
        suffix_language(F.col("host"), F.col("path"), languages).alias("suffix"),
    )
    scored = written(text_scores(rows.withColumn("row", F.monotonically_increasing_id()), table), "language-scores")
    # One row for each document and row of evidence.
    scored = written(
        scored.join(seen, F.col("doc_id") == F.col("_id"), "left")
        .select("row", "doc_id", F.coalesce("page_host", "own_host").alias("host"), "domain", "label", "markup", "suffix", "score"),
        "language-evidence",
    )

    def averaged(by: DataFrame, value: str) -> DataFrame:
        """``(row, <value>)`` averaged over the evidence of a document."""
        parts = by.groupBy("row").agg(*[F.avg(F.get(value, F.lit(i))).alias(f"x{i}") for i in range(size)])
        return parts.select("row", F.array(*[f"x{i}" for i in range(size)]).alias(value))

    declared = _plus(
        _lookup("markup", _declared(scored, "markup", languages), size), _lookup("suffix", _declared(scored, "suffix", languages), size)
    )
    by_text = scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.min("host").alias("first_host"), F.first("score").alias("score"))
    fused = by_text.join(averaged(scored.select("row", declared.alias("declared")), "declared"), "row")
    fused = fused.select("row", "doc_id", "first_host", _best(F.col("score")).alias("by_text"), _plus(F.col("score"), F.col("declared")).alias("score"))
    fused = written(fused.withColumn("guess", _best(F.col("score"))), "language-guesses")
    first = scored.select("row", "host", "domain").join(fused.select("row", "guess"), "row")

    def counts(name: str) -> Column:
        return F.array(*[F.sum((F.col("guess") == i).cast("double")) for i in range(size)]).alias(name)

    by_host = written(first.groupBy("host", "domain").agg(counts("host_n")), "host-languages")
    total = by_host.agg(*[F.sum(F.get("host_n", F.lit(i))).alias(f"n{i}") for i in range(size)]).first()
    everywhere = [(n or 0.0) + 1.0 for n in total]
    share = F.array(*[F.lit(n / sum(everywhere)) for n in everywhere])
    by_domain = by_host.where("domain is not null").groupBy("domain").agg(
        F.array(*[F.sum(F.get("host_n", F.lit(i))) for i in range(size)]).alias("domain_n")
    )
    hosts = by_host.where("host is not null").join(by_domain, "domain", "left").select(
        F.col("host").alias("_host"), F.col("domain").alias("_domain"), "host_n", "domain_n"
    )
    joined = first.join(hosts, (F.col("host") == F.col("_host")) & F.col("domain").eqNullSafe(F.col("_domain")), "left")

    def smoothed(n: Column, weight: float, towards: Column) -> Column:
        """Shares of ``n`` without the document itself, with ``weight`` documents of the shares ``towards``."""
        others = F.transform(n, lambda x, i: x - (i == F.col("guess")).cast("double"))
        all_n = F.aggregate(others, F.lit(0.0), lambda a, x: a + x)
        return F.when(n.isNull(), towards).otherwise(F.zip_with(others, towards, lambda x, t: (x + weight * t) / (all_n + weight)))

    prior = smoothed(F.col("host_n"), HOST_WEIGHT, smoothed(F.col("domain_n"), DOMAIN_WEIGHT, share))
    priors = averaged(joined.select("row", F.transform(prior, lambda p: F.log(p)).alias("prior")), "prior")
    final = fused.join(priors, "row").select(
        "doc_id", F.col("first_host").alias("host"), "by_text", _plus(F.col("score"), F.col("prior")).alias("score")
    )
    best = final.withColumn("at", _best(F.col("score")))
    odds = F.aggregate(F.transform("score", lambda x: F.exp(x - F.array_max("score"))), F.lit(0.0), lambda a, x: a + x)
    return best.select(
        "doc_id", F.get(names, F.col("at")).alias("lang"), F.round(1 / odds, 6).alias("probability"),
        F.get(names, F.col("by_text")).alias("text_lang"), "host",
    )
