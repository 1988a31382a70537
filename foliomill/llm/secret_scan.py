"""Secrets: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 16 or more characters of encoded keys, or whatever is assigned to a name with a word for
secrets, of any length and alphabet.  Its features are its length, its make-up, how likely
its character transitions are in the corpus' own words, how much of it is made of frequent words, and what stands
before it, after it and in the document's path.  The forest is trained on labelled findings.

All is built-in functions and Spark's own classifier.  Texts are not exchanged to find candidates; the words that
transitions and the dictionary come from are counted over all texts with map-side combined counts.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.storage import written

RUN = r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}+={0,2}"
#: Words beside a candidate that speak for a secret.
SECRET_WORD = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api_?-?key|access_?-?key|private_?-?key|auth(?!or(?!i[sz]))|credential)"
#: Whole words of the name a candidate is assigned to that speak against one.
PLAIN_WORD = r"(?i)(?<![a-z])(sha\d*|md5|commit|checksum|digest|uuid|hash|revision|etag|isbn|phone|tel|card|iban|number)(?![a-z])"
#: What stands between a name and its value; ``Bearer`` and ``Basic`` come before a value.
ASSIGN = r"[\"'`]?\]?\s{0,8}[=:]{1,2}>?\s{0,8}[\"'`]?((?i:bearer|basic)\s{1,4})?"
#: The name that a candidate is assigned to, at the end of the text before it.
NAME = rf"([\w.\-]+){ASSIGN}$"
#: Values: to the closing quote, or to white space, a quote, the next assignment, or punctuation that ends a clause.
_QUOTED = [rf"(?<={q})(?:\\.|[^{q}\\\n])++(?={q})" for q in "\"'`"]
_BARE = r"(?:(?![&,;]\w{1,40}[=:])(?![.,;:?)\]}>]{0,8}+(?:[\s\"'`]|\z))[^\s\"'`])++"
#: All lookbehinds but the last are there to leave most places at once.
NAMED = (
    r"(?<=[=:>\s\"'`])((?<![\w,.;][ \t])|(?<=(?i:bearer|basic)[ \t]))" + rf"(?<=(?i:{SECRET_WORD[4:]})[\w.\-]{{0,20}}{ASSIGN})(?!(?i:bearer|basic)\s)"
    + f"(?:{'|'.join([*_QUOTED, _BARE])})"
)
FOUND = f"(?:{NAMED}|{RUN})"
#: Assigned values that are shorter are judged, but teach nothing.
MIN_LABELLED = 8
TEST_PATH = r"(?i)(^|[/_.\-])(test|tests|example|examples|sample|samples|fixture|fixtures|mock|docs?)([/_.\-]|$)"
PLACEHOLDER = "[SECRET]"

#: Symbols of the transition table: letters, one for digits, one for the rest and the edges.
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0"
_SIDE = len(_ALPHABET) + 1
DICTIONARY_WORDS = 5_000
MAX_TRAINING = 20_000
FEATURES = [
    "f_length", "f_transition", "f_covered", "f_digits", "f_uppers", "f_symbols", "f_distinct", "f_changes", "f_hex",
    "f_assigned", "f_quoted", "f_secret_word", "f_plain_word", "f_test_path",
]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``(doc_id, text_key, nth, start, candidate, before, after, name, path)``, one row per candidate of each row.

    ``nth`` and ``start`` (in characters) count from 0 within the text; ``text_key`` tells texts of one id apart.
    ``name`` is what the candidate is assigned to, empty if it is not; a long name is a run, so a candidate, itself.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text")
    ).where(F.col("text").rlike(FOUND))
    parts = rows.select(
        "doc_id", "path", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("text_key"),
        F.regexp_extract_all("text", F.lit(FOUND), 0).alias("found"), F.split("text", FOUND).alias("gaps"),
    )

    def before(i: Column, n: int) -> Column:
        return F.right(F.concat(F.coalesce(F.get("found", i - 1), F.lit("")), F.get("gaps", i)), F.lit(n))

    one = F.transform(
        "found",
        lambda x, i: F.struct(
            i.alias("nth"), x.alias("candidate"), F.length(F.get("gaps", i)).alias("gap"),
            before(i, 40).alias("before"), F.left(F.get("gaps", i + 1), F.lit(20)).alias("after"),
            F.regexp_extract(before(i, 120), NAME, 1).alias("name"),
        ),
    )
    each = parts.select("doc_id", "path", "row", "text_key", F.explode(one).alias("c")).select("doc_id", "path", "row", "text_key", "c.*")
    so_far = Window.partitionBy("row").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("candidate")).over(so_far)
    return each.select(
        "doc_id", "text_key", "nth", (end - F.length("candidate")).cast("long").alias("start"), "candidate", "before", "after",
        "name", "path",
    )


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)``: runs of 2 to 20 ASCII letters in lower case, counted over all texts."""
    found = F.split(F.lower(F.translate(F.col(text_col), "0123456789", "          ")), r"[^a-z]+")
    return (
        docs.select(F.explode(found).alias("word")).where(F.length("word").between(2, 20))
        .groupBy("word").agg(F.count("*").alias("n"))
    )


def _symbol(c: Column) -> Column:
    at = F.instr(F.lit(_ALPHABET), c)
    return F.when(c.between("0", "9"), F.lit(26)).when(at > 0, at - 1).otherwise(F.lit(_SIDE - 1))


def _pairs(text: Column) -> Column:
    """The transitions of a text as cells of the table, its edges included."""
    padded = F.concat(F.lit("."), F.lower(text), F.lit("."))
    return F.transform(
        F.sequence(F.lit(1), F.length(padded) - 1),
        lambda i: _symbol(F.substr(padded, i, F.lit(1))) * _SIDE + _symbol(F.substr(padded, i + 1, F.lit(1))),
    )


def transition_table(words: DataFrame) -> list[float]:
    """Log probability of each symbol after each, add-one smoothed; the size is set by the alphabet."""
    counts = dict(
        words.select(F.explode(_pairs(F.col("word"))).alias("cell"), "n").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    )
    table = []
    for a in range(_SIDE):
        row = [counts.get(a * _SIDE + b, 0) + 1 for b in range(_SIDE)]
        table += [math.log(n / sum(row)) for n in row]
    return table


def features(found: DataFrame, words: DataFrame, dictionary_words: int = DICTIONARY_WORDS) -> DataFrame:
    """``found`` (see :func:`candidates`) with the columns of ``FEATURES``.

    ``words``: counts as :func:`vocabulary` gives them.  The dictionary is its ``dictionary_words`` most frequent
    words of three letters or more (ties by spelling), a number that does not grow with the data.
    """
    table = F.array(*[F.lit(x) for x in transition_table(words)])
    frequent = words.where(F.length("word") >= 3).orderBy(F.desc("n"), "word").limit(dictionary_words).select("word")
    distinct = found.select("candidate").distinct()
    pieces = distinct.select("candidate", F.explode(F.split(F.lower(F.regexp_replace("candidate", "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")).alias("word"))
    covered = pieces.join(F.broadcast(frequent), "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("covered"))
    c, n = F.col("candidate"), F.length("candidate")

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace(c, pattern, "")) / n

    cells = F.transform(_pairs(c), lambda cell: F.get(table, cell))
    kinds = F.translate(
        F.lower(c), "abcdefghijklmnopqrstuvwxyz0123456789", "a" * 26 + "0" * 10
    )
    measured = distinct.join(covered, "candidate", "left").select(
        c, n.cast("double").alias("f_length"),
        (F.aggregate(cells, F.lit(0.0), lambda a, x: a + x) / (n + 1)).alias("f_transition"),
        (F.coalesce("covered", F.lit(0)) / n).alias("f_covered"),
        share("[^0-9]").alias("f_digits"), share("[^A-Z]").alias("f_uppers"), share("[A-Za-z0-9]").alias("f_symbols"),
        (F.size(F.array_distinct(F.split(c, ""))) / n).alias("f_distinct"),
        (F.length(F.regexp_replace(F.regexp_replace(kinds, "a+", "a"), "0+", "0")) / n).alias("f_changes"),
        share("[^0-9a-fA-F]").alias("f_hex"),
    )
    beside = F.concat_ws(" ", "before", "after")
    # Merged, as stored candidates that repeat take far fewer bytes than their rows, and would be broadcast for that.
    return found.join(measured.hint("merge"), "candidate").select(
        *found.columns, *[f for f in FEATURES if f in measured.columns],
        (F.col("name") != "").cast("double").alias("f_assigned"),
        F.col("before").rlike("[\"'`]$").cast("double").alias("f_quoted"),
        beside.rlike(SECRET_WORD).cast("double").alias("f_secret_word"),
        F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1_$2").rlike(PLAIN_WORD).cast("double").alias("f_plain_word"),
        F.coalesce(F.col("path").rlike(TEST_PATH), F.lit(False)).cast("double").alias("f_test_path"),
    )


def assigned_findings(measured: DataFrame) -> DataFrame:
    """Labelled findings where none are given: rows of ``measured`` with ``label``.

    A candidate of ``MIN_LABELLED`` or more characters, letters and digits among them, assigned to a name with a word for
    secrets is a finding (1).  None (0) is one without letters or without digits that is not assigned to such a name, or
    that is and is a known word or a number of up to 5 digits; and one assigned to a name with a word for something plain
    and none for secrets.  All others are not labelled; what else stands near a candidate labels nothing.
    """
    c = F.col("candidate")
    mixed = c.rlike("[0-9]") & c.rlike("[A-Za-z]")
    named, plain = F.col("name").rlike(SECRET_WORD), F.col("f_plain_word") > 0
    known = (c.rlike("^[A-Za-z]+$") & (F.col("f_covered") == 1)) | c.rlike("^[0-9]{1,5}$")
    label = F.when(mixed & named & ~plain & (F.length(c) >= MIN_LABELLED), 1.0).when(F.when(named, known).otherwise(~mixed | plain), 0.0)
    return measured.withColumn("label", label).where("label is not null")


def train(labelled: DataFrame, max_rows: int = MAX_TRAINING, trees: int = 24, depth: int = 6, seed: int = 7):
    """A forest fitted to at most ``max_rows`` labelled findings of each label, or the only label there is.

    The sample takes the smallest hashes of candidates and is sorted, so a run repeated gives the same forest.
    """
    key = F.xxhash64("candidate", "before", "after")
    sample = None
    for value in (0.0, 1.0):
        part = labelled.where(F.col("label") == value).withColumn("key", key).orderBy("key", "start").limit(max_rows)
        sample = part if sample is None else sample.union(part)
    sample = written(sample.select("label", "key", "start", *FEATURES).coalesce(1).sortWithinPartitions("key", "start"), "labelled")
    kinds = [r.label for r in sample.select("label").distinct().collect()]
    if len(kinds) < 2:
        return kinds[0] if kinds else 0.0
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample.coalesce(1))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=64).fit(rows.select("label", "features"))


def scored(measured: DataFrame, model) -> DataFrame:
    """``measured`` with ``probability`` and ``is_secret`` (over one half).  A model of one label gives that."""
    if isinstance(model, float):
        return measured.withColumn("probability", F.lit(model)).withColumn("is_secret", F.lit(model > 0.5))
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(measured)
    p = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(assembled).withColumn("probability", p).withColumn("is_secret", F.col("probability") > 0.5)


def findings(
    docs: DataFrame, labelled=assigned_findings, max_training: int = MAX_TRAINING, id_col: str = "doc_id",
    text_col: str = "text", path_col: str = "source",
) -> DataFrame:
    """All candidates with their verdict: ``(doc_id, text_key, nth, start, candidate, probability, is_secret)``.

    ``labelled``: a function from measured candidates to labelled ones.  Null and empty texts have no candidates, a
    null path is none, repeated rows have their candidates each; without any labelled finding nothing is a secret.
    """
    found = written(candidates(docs, id_col, text_col, path_col), "candidates")
    words = written(vocabulary(docs, text_col), "vocabulary")
    measured = written(features(found, words), "measured")
    judged = scored(measured, train(labelled(measured), max_training))
    return judged.select("doc_id", "text_key", "nth", "start", "candidate", F.round("probability", 6).alias("probability"), "is_secret")


def redacted(
    docs: DataFrame, labelled=assigned_findings, max_training: int = MAX_TRAINING, placeholder: str = PLACEHOLDER,
    id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", length_col: str | None = "n_chars",
) -> DataFrame:
    """``docs`` with each secret replaced; ``length_col``, if it is there, follows the changed texts.

    Every row stays, with its columns.  Rows are matched by id and text, so repeated ids keep their own texts.
    """
    found = findings(docs, labelled, max_training, id_col, text_col, path_col).where("is_secret")
    hits = found.groupBy(F.col("doc_id").alias("hit_doc"), F.col("text_key").alias("hit_key")).agg(F.collect_set("nth").alias("hit_nth"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text, key = F.col("row").getField(text_col), F.col("row").getField(id_col).cast("long")
    joined = rows.join(hits, key.eqNullSafe(F.col("hit_doc")) & F.xxhash64(text).eqNullSafe(F.col("hit_key")), "left")
    gaps = F.split(text, FOUND)
    rebuilt = F.array_join(
        F.transform(
            F.regexp_extract_all(text, F.lit(FOUND), 0),
            lambda x, i: F.concat(F.get(gaps, i), F.when(F.array_contains("hit_nth", i), F.lit(placeholder)).otherwise(x)),
        ),
        "",
    )
    clean = joined.withColumn("clean", F.when(F.col("hit_nth").isNull(), text).otherwise(F.concat(rebuilt, F.element_at(gaps, -1))))
    columns = []
    for name in docs.columns:
        value = F.col("row").getField(name)
        if name == text_col:
            value = F.col("clean")
        elif name == length_col:
            value = F.when(F.col("hit_nth").isNull(), value).otherwise(F.length("clean").cast(docs.schema[name].dataType))
        columns.append(value.alias(name))
    return clean.select(*columns)
