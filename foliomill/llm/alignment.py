"""Alignment of two tokenizers over a corpus, with each distinct text tokenised and aligned once.

Texts are exchanged in full and counted, so a text that a third of all documents hold reaches its reducer as one row per
map task.  Each distinct text is encoded by both tokenizers and aligned by byte offsets.  Aligned texts are dealt into
*parts* of some megabytes, and each part sums up how many documents hold each pair of ids it links, weighted by the
multiplicity of its texts.  Only these sums travel to be counted over the corpus and back to their part, so a pair that
nearly all texts link is one row per part, never one per text.  At last measures are joined to the ids of
documents by a digest of the text; texts that over one in 256 documents hold (so 256 at most) are broadcast there.
"""

from __future__ import annotations

import gc
import itertools
import os
import re
from collections.abc import Iterator, Sequence

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from pyspark import TaskContext  # noqa: E402
from pyspark.sql import DataFrame, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from foliomill.llm.tokens import _CUT, _RUNS, _SYMBOLS, Encoder, _byte_letters, _plain, _sure  # noqa: E402
from foliomill.storage import written  # noqa: E402

#: Characters aligned in one go, and in one part.
BLOCK, PART = 1 << 19, 8 << 20
#: Pieces that one worker remembers, and the longest: some 150 MB at most.
REMEMBERED, LONGEST = 400_000, 40
#: A text that more than one in so many documents hold is joined by broadcast.
HOT_SHARE = 256

ALIGNED = (
    "part long, text_key binary, n_docs long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "a array<int>, b array<int>, links array<int>"
)
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    out = np.empty(len(entries), object)
    out[:] = entries
    return out, np.array([len(e) for e in entries], np.int64)


#: Tokens aligned: their numbers on both sides, of groups, the groups as text, and the linked pairs, a number for each link.
Aligned = tuple[int, int, int, str, bytes]


def _flat(ids: list[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one array, and how many each text has."""
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(n.sum())), n


class Tokenizers:
    """Two tokenizers: ids of texts, and the bytes that each id stands for.

    Neither has a token across a single space between other characters, nor, as a rule, one that holds such a line break
    and more, so what lies between these is encoded and aligned on its own, and the alignment of a text is theirs put
    together.  A bounded number of these pieces is remembered.  A piece stands for itself after a space or, if it begins
    with a line break, for itself alone; one that begins with a space has no cut at one of its ends and is taken as it is.
    """

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import sentencepiece

        self.first = Encoder(byte_path, remembered=0)
        # The strings of special tokens inside texts are plain text.
        self.first.tokenizer.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        byte_of = {letter: byte for byte, letter in _byte_letters().items()}
        vocabulary = self.first.tokenizer.get_vocab(with_added_tokens=False)
        spelled = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in byte_of for c in token):
                spelled[i] = bytes(byte_of[c] for c in token)
        self.bytes_a, self.width_a = _table(spelled)
        n = self.second.get_piece_size()
        names = [self.second.id_to_piece(i) for i in range(n)]
        self.bytes_b, self.width_b = _table(
            [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        )
        self.cuts = not any(re.search("[^▁]▁", p) for p in names)
        self.lines = self.cuts and self.first.line is not None and not any("\n" in p and p != "\n" for p in names)
        self.n_before = len(self.second.encode("."))
        odd = (self.second.is_byte, self.second.is_control, self.second.is_unknown)
        self.ends = self.cuts and not any(
            x.isalpha() and y in _SYMBOLS for i, p in enumerate(names) if not any(of(i) for of in odd) for x, y in zip(p, p[1:], strict=False)
        )
        self.tails: dict[str, Aligned | None] = {}
        # An id and what comes after it: the next of its side, or the end of its side of a group.
        self.shown = np.array([f"{i}{c}" for i in range(len(self.bytes_a)) for c in ",|"] + [f"{i}{c}" for i in range(n) for c in ",;"], object)
        self.known: dict[str, Aligned] = {}
        self.older: dict[str, Aligned] = {}

    def _ids(self, pieces: list[str]) -> tuple[list[Sequence[int]], list[list[int]]]:
        """The ids of each piece on both sides."""
        cut, uncut = [p for p in pieces if p[0] != " "], [p for p in pieces if p[0] == " "]
        known = self.first.learn(cut) if cut else {}
        ids_a: dict[str, Sequence[int]] = {p: memoryview(known[p]).cast("I") for p in cut}
        if uncut:
            found = self.first.tokenizer.encode_batch_fast(uncut, add_special_tokens=False)
            ids_a |= {p: e.ids for p, e in zip(uncut, found, strict=True)}
        # The library puts a space before; a line break goes behind another character, which then is left out.
        ids_b = self.second.encode([f".{p}" if p[0] == "\n" else p[p[0] == " " :] for p in pieces], num_threads=1)
        return [ids_a[p] for p in pieces], [b[self.n_before :] if p[0] == "\n" else b for p, b in zip(pieces, ids_b, strict=True)]

    def _spelled(self, ids: list[Sequence[int]], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
        flat, n = _flat(ids)
        return flat, n, b"".join(entries[flat].tolist())

    def align(self, pieces: list[str]) -> list[Aligned | None]:
        """Each piece aligned; nothing where the bytes of either side are not those the piece stands for.

        Ends of tokens are byte offsets over all pieces put together.  A stretch between two neighbouring ends, of either
        side, lies in one token of each: the links are these stretches, and a group ends where both have an end.
        """
        if not pieces:
            return []
        wholes = [p if p[0] in " \n" else f" {p}" for p in pieces]
        ids_a, ids_b = self._ids(pieces)
        good = [True] * len(pieces)
        (a, n_a, said_a), (b, n_b, said_b) = self._spelled(ids_a, self.bytes_a), self._spelled(ids_b, self.bytes_b)
        if not said_a == said_b == "".join(wholes).encode():
            for i, whole in enumerate(wholes):
                data = whole.encode()
                good[i] = self._spelled(ids_a[i : i + 1], self.bytes_a)[2] == data == self._spelled(ids_b[i : i + 1], self.bytes_b)[2]
            (a, n_a), (b, n_b) = (_flat([x for x, g in zip(ids, good, strict=True) if g]) for ids in (ids_a, ids_b))
        if not len(a):
            return [None] * len(pieces)
        ends_a, ends_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        is_end = np.zeros((2, int(ends_a[-1]) + 1), bool)
        is_end[0, ends_a] = is_end[1, ends_b] = True
        ends = np.flatnonzero(is_end[0] | is_end[1])
        # How many tokens end before each end is which token it lies in.
        in_a, in_b = (np.cumsum(is_end[side])[ends] - is_end[side, ends] for side in (0, 1))
        both = is_end[0, ends] & is_end[1, ends]
        last_a, last_b = is_end[1, ends_a], is_end[0, ends_b]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # Each group is its tokens of one side and then those of the other.
        shown = np.empty(len(a) + len(b), object)
        a_until, b_until = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
        b_before = np.append(0, b_until)[:-1]
        shown[np.arange(len(a)) + b_before[group_a]] = self.shown[2 * a + last_a]
        shown[np.arange(len(b)) + a_until[group_b]] = self.shown[2 * len(self.bytes_a) + 2 * b + last_b]

        shown = shown.tolist()
        pairs = (a[in_a] * len(self.bytes_b) + b[in_b]).tobytes()
        text_ends = ends_a[np.cumsum(n_a) - 1]
        links_until = np.searchsorted(ends, text_ends, "right")
        groups_until = np.append(0, np.cumsum(both))[links_until]
        rows, token, link, group = [], 0, 0, 0
        for x, y, links, groups in zip(n_a.tolist(), n_b.tolist(), links_until.tolist(), groups_until.tolist(), strict=True):
            rows.append((x, y, groups - group, "".join(shown[token : token + x + y])[:-1], pairs[8 * link : 8 * links]))
            token, link, group = token + x + y, links, groups
        found = iter(rows)
        return [next(found) if g else None for g in good]

    def _found(self, text: str, fresh: dict[str, None]) -> tuple[list[str], list[Aligned | None]]:
        """The pieces of a text and those known aligned; ``fresh`` gets the others.

        Known pieces are the same wherever they come from, so only others are looked at closer.
        """
        pieces = [f" {text}"] if not self.cuts else (text.replace("\n", " \n") if self.lines else text).split(" ")
        found = list(map(self.known.get, pieces))
        new = [] if all(found) else [p for p, x in zip(pieces, found, strict=True) if not x]
        # White space at an end of a piece is not printable.
        if self.cuts and not (all(new) and all([_sure(p[self.lines and p[0] == "\n" :]) for p in new if not p.isprintable()])):
            # Beside other white space neither a space nor a line break is a cut.
            first, *pieces = _CUT.split(f" {text}")
            pieces = [first[1:] if _sure(first[1:]) else first, *pieces]
            if len(pieces) > 1 and not _sure(pieces[-1]):
                pieces[-1] = f" {pieces[-1]}"
            found = list(map(self.known.get, pieces))
            new = [p for p, x in zip(pieces, found, strict=True) if not x]
        fresh.update(dict.fromkeys(new))
        return pieces, found

    def _tail(self, symbols: str) -> Aligned | None:
        """Symbols behind a word aligned, if they are to be remembered."""
        if symbols not in self.tails:
            if len(self.tails) >= _RUNS or len(symbols) > LONGEST:
                return None
            a, both = self.align(["a", f"a{symbols}"])
            known = a is not None and both is not None
            self.tails[symbols] = (*[y - x for x, y in zip(a[:3], both[:3], strict=True)], both[3][len(a[3]) + 1 :], both[4][len(a[4]) :]) if known else None
        return self.tails[symbols]

    def _together(self, piece: str) -> Aligned | None:
        """A piece that is a known word and symbols behind it: no token crosses the two."""
        word = piece.rstrip(_SYMBOLS)
        if not self.ends or len(word) == len(piece) or not _plain(word[1:] if word[:1] == "\n" else word):
            return None
        head = self.known.get(word) or self.older.get(word)
        tail = head and self._tail(piece[len(word) :])
        return tail and (head[0] + tail[0], head[1] + tail[1], head[2] + tail[2], f"{head[3]};{tail[3]}", head[4] + tail[4])

    def texts(self, texts: list[str]) -> list[list[Aligned] | None]:
        """The aligned pieces of each text; nothing for texts that one side does not keep byte by byte."""
        fresh: dict[str, None] = {}
        cut = [self._found(t, fresh) for t in texts]
        found: dict[str, Aligned | None] = {}
        learnt = []
        for p in fresh:
            x = self.older.get(p) or self._together(p)
            if x:
                found[p] = x
            else:
                learnt.append(p)
        found |= zip(learnt, self.align(learnt), strict=True)
        lost = {p for p, x in found.items() if x is None}
        out: list[list[Aligned] | None] = []
        for text, (pieces, rows) in zip(texts, cut, strict=True):
            rows = [x or found[p] for p, x in zip(pieces, rows, strict=True)]
            if lost and None in rows:
                # The pieces of such a text could make up for each other: judge it as a whole.
                whole = self.align([f" {text}"])[0]
                rows = None if whole is None else [whole]
            out.append(rows)
        if len(self.known) + len(found) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
        self.known.update([(p, x) for p, x in found.items() if x is not None and len(p) <= LONGEST])
        return out

    def measured(self, texts: list[str]) -> list[dict]:
        """Of each text the numbers of tokens, groups and links, the groups as text, and the distinct linked pairs."""
        none = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": None, "a": [], "b": [], "links": []}
        found = [rows and tuple(zip(*rows, strict=True)) for rows in self.texts(texts)]
        data = [b"" if x is None else b"".join(x[4]) for x in found]
        n_links = np.array([len(d) // 8 for d in data])
        wide = len(self.bytes_b)
        span = len(self.bytes_a) * wide
        keys, times = np.unique(np.repeat(np.arange(len(texts)) * span, n_links) + np.frombuffer(b"".join(data), np.int64), return_counts=True)
        cut = np.searchsorted(keys, np.arange(len(texts) + 1) * span)
        a, b, links = (keys % span // wide).astype(np.int32), (keys % wide).astype(np.int32), times.astype(np.int32)
        return [
            none if x is None else {
                "n_a": sum(x[0]), "n_b": sum(x[1]), "n_groups": sum(x[2]), "n_links": int(n_links[i]), "groups": ";".join(x[3]),
                "a": a[cut[i] : cut[i + 1]], "b": b[cut[i] : cut[i + 1]], "links": links[cut[i] : cut[i + 1]],
            }
            for i, x in enumerate(found)
        ]


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(byte_path: str, piece_path: str) -> Tokenizers:
    """The tokenizers of this Python worker."""
    if (byte_path, piece_path) not in _loaded:
        _loaded[byte_path, piece_path] = Tokenizers(byte_path, piece_path)
        # Very many small objects and hardly a cycle: the collector need not look so often.
        gc.set_threshold(200_000)
    return _loaded[byte_path, piece_path]


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(text, n_docs)``: the texts that are not null or empty, with how many rows hold each."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text <> ''")
    return texts.groupBy("text").agg(F.count("*").alias("n_docs"))


def text_key(text: str) -> F.Column:
    return F.unhex(F.sha2(F.col(text).cast("string").cast("binary"), 256))


def aligned(texts: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """:data:`ALIGNED` of ``(text, n_docs)``.  ``groups`` is ``a1,a2|b1;a3|b2,b3`` (ids), null where there are no tokens.

    ``a``, ``b`` and ``links`` are the distinct pairs of ids that overlap and how many times each does.  Map-only.
    """
    keyed = texts.select(text_key("text").alias("text_key"), "n_docs", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, task = tokenizers(byte_path, piece_path), TaskContext.get().partitionId()
        seen = 0
        for batch in batches:
            begin = size = 0
            for i, text in enumerate(batch.column(2)):
                size += len(text.as_py())
                if size >= BLOCK or i + 1 == batch.num_rows:
                    block = batch.slice(begin, i + 1 - begin)
                    found = both.measured(block.column(2).to_pylist())
                    columns = [pa.array([task << 32 | seen // PART] * len(found), pa.int64()), *block.columns[:2]]
                    columns += [pa.array([r[k] for r in found], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")]
                    columns.append(pa.array([r["groups"] for r in found], pa.large_string()))
                    columns += [pa.array([r[k] for r in found], pa.list_(pa.int32())) for k in ("a", "b", "links")]
                    yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in ALIGNED.split(", ")])
                    seen += size
                    begin, size = i + 1, 0

    return keyed.mapInArrow(run, ALIGNED)


def part_pairs(texts: DataFrame) -> DataFrame:
    """``(part, a, b, n)``: how many documents of each part hold a pair linked, of rows of :func:`aligned`."""
    pairs = texts.select("part", "n_docs", F.explode(F.arrays_zip("a", "b")).alias("pair"))
    return pairs.groupBy("part", "pair.a", "pair.b").agg(F.sum("n_docs").alias("n"))


def pair_counts(of_parts: DataFrame) -> DataFrame:
    """``(a, b, count, best)``: how many documents hold a pair linked, and whether no pair of ``a`` is held by more.

    An ``a`` has at most as many pairs as there are ids of the other side, so its window is bounded.
    """
    counts = of_parts.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def _scored(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """``(text_key, n_best, count_sum)`` of the texts of one part and the counts of its pairs."""
    wide = np.int64(1) << 32
    known = pairs["a"].to_numpy().astype(np.int64) * wide + pairs["b"].to_numpy()
    order = np.argsort(known)
    known, count, best = known[order], pairs["count"].to_numpy()[order], pairs["best"].to_numpy()[order]
    lists = texts["a"].combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = [texts[k].combine_chunks().flatten().to_numpy().astype(np.int64) for k in ("a", "b", "links")]
    at = np.searchsorted(known, flat[0] * wide + flat[1])
    text_of = np.repeat(np.arange(len(lists)), lengths)
    n_best, count_sum = np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
    if len(at):
        np.add.at(n_best, text_of, flat[2] * best[at])
        np.add.at(count_sum, text_of, flat[2] * count[at])
    return pa.table({"text_key": texts["text_key"], "n_best": n_best, "count_sum": count_sum})


def alignment(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row per row of ``docs``.

    ``n_best`` are the links of pairs held linked by as many documents as any pair of their first id, ``count_sum`` the
    sum of these numbers of documents over all links.  Texts that are null or empty, and those that either tokenizer
    does not keep byte by byte, have no tokens: zeros, and '' for the digest.  Repeated rows count one by one, a
    null id is kept; other columns are not read; an empty table gives an empty result.
    """
    found = aligned(distinct_texts(docs, text_col), byte_path, piece_path)
    shown = F.when(F.col("groups").isNull(), "").otherwise(F.sha2("groups", 256))
    texts = written(found.withColumn("groups_sha256", shown).drop("groups"), "aligned")
    of_parts = written(part_pairs(texts), "part-pairs")
    counts = written(pair_counts(of_parts), "pair-counts")
    back = of_parts.join(counts, ["a", "b"]).select("part", "a", "b", "count", "best")
    scored = (
        texts.select("part", "text_key", "a", "b", "links").groupBy("part")
        .cogroup(back.groupBy("part")).applyInArrow(_scored, "text_key binary, n_best long, count_sum long")
    )
    measures = written(
        texts.select("text_key", "n_docs", *MEASURES[:4], "groups_sha256").join(scored, "text_key"), "text-measures"
    )
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(F.col(text_col).cast("string") != "", text_key(text_col)).alias("text_key"))
    keys = written(keyed, "text-keys")
    total = measures.agg(F.sum("n_docs").alias("n")).first()["n"] or 0
    hot = F.col("n_docs") * HOT_SHARE > total
    columns = ["doc_id", *MEASURES, "groups_sha256"]
    often = F.broadcast(measures.where(hot))
    filled = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in MEASURES] + [F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")]
    rest = keys.where("text_key is not null").join(F.broadcast(measures.where(hot).select("text_key")), "text_key", "left_anti")
    none = keys.where("text_key is null").select("doc_id", *[F.lit(0).cast("long").alias(c) for c in MEASURES], F.lit("").alias("groups_sha256"))
    return (
        keys.join(often, "text_key").select(*columns)
        .unionByName(rest.join(measures.where(~hot), "text_key").select("doc_id", *filled))
        .unionByName(none)
    )
