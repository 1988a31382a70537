"""BPE encoding and decoding by a deterministic automaton over tokens.

A sequence of tokens is what BPE makes of its symbols exactly when a certain automaton accepts it.  It starts as the
automaton of all sequences of single symbols, and each merge (u, v), in order of rank, changes it by one gadget:
wherever u can come (and v after it), uv can come too and leads to a new state; what can follow v can follow uv; and
after u, v can come no more (Berglund, Martens and van der Merwe, "Constructing a BPE Tokenization DFA", 2024).  A
state is named by the token that leads to it, so the automaton is one table of bits: may token t follow state s.
States that allow the same tokens, and tokens that the same states allow, share a row or column of it.

A word is encoded from left to right: from each state the arcs are looked up in a tree of the tokens' symbols, and the
longest is taken that the table allows.  Every prefix of a word has one accepted sequence, so a place that leads nowhere
is left once and for all: time is linear in the word, however long.  Decoding emits the arcs' labels.

The automaton is compiled once on the driver (some seconds) and broadcast: its size depends on the vocabulary alone.
"""

from __future__ import annotations

import gc
import json
import os
from array import array
from collections.abc import Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from foliomill.llm.tokens import _FIRST_OTHER, _MARKS, _byte_letters  # noqa: E402

#: Pieces between spaces that one worker remembers, and the longest: some 100 MB at most.
REMEMBERED = 300_000
LONGEST = 40
#: Bytes of ids in one batch of results.
_BATCH = 8 << 20


def _classes(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct lines of a table of bytes, and which of them each line is."""
    if not lines.size:
        return lines[:1], np.zeros(len(lines), np.int64)
    whole = np.ascontiguousarray(lines).view(f"V{lines.shape[1]}").ravel()
    _, first, of = np.unique(whole, return_index=True, return_inverse=True)
    return lines[first], of.ravel()


class Automaton:
    """The automaton of a list of merges.  ``rows[row_of[s]][byte_of[t]] & mask_of[t]``: token ``t`` may follow token ``s``.

    ``end`` is the mark that a token at the end of a word has (empty: none); ``start`` is the row where words begin.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str = "") -> None:
        size = max(vocabulary.values(), default=-1) + 1
        self.end, self.labels = end, {i: s for s, i in vocabulary.items()}
        steps = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges]
        made = [w for *_, w in steps]
        if len(set(made)) < len(made):
            raise ValueError("two merges make the same token")
        known = set(made)
        base = [i for i in sorted(self.labels) if i not in known]
        # The states that something can follow, and the tokens, each in order of making.
        order = np.array([*base, *made], np.int64)
        goes_on = [i for i in order.tolist() if not (end and self.labels[i].endswith(end))]
        row, column = np.zeros(size, np.int64), np.zeros(size, np.int64)
        row[goes_on] = np.arange(1, len(goes_on) + 1)
        column[order] = np.arange(len(order))
        table = self._compiled(steps, row, column, len(base), len(order), len(goes_on) + 1)
        columns, column_class = _classes(table)
        rows = np.unpackbits(columns, axis=1, bitorder="little")[:, : len(goes_on) + 1].T
        allowed, row_class = _classes(np.packbits(rows, axis=1, bitorder="little"))
        self.rows = [line.tobytes() for line in allowed]
        column_of, row_of = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        column_of[order] = column_class
        row_of[goes_on] = row_class[1:]
        self.start, self.row_of = int(row_class[0]), row_of.tolist()
        self.byte_of, self.mask_of = (column_of >> 3).tolist(), (1 << (column_of & 7)).tolist()
        self.tree: dict = {}
        for token in order.tolist():
            self._plant(token)

    @staticmethod
    def _compiled(steps: list, row: np.ndarray, column: np.ndarray, n_base: int, n_tokens: int, n_rows: int) -> np.ndarray:
        """Bits, one line per token: the states it may follow."""
        table = np.zeros((n_tokens, (n_rows + 7) // 8), np.uint8)
        base_rows = np.zeros(n_rows, np.uint8)
        base_rows[0] = 1
        first_made = min((int(row[w]) for *_, w in steps if row[w]), default=n_rows)
        base_rows[1:first_made] = 1
        table[:n_base] = np.packbits(base_rows, bitorder="little")
        clear = [np.uint8(255 - (1 << bit)) for bit in range(8)]
        for u, v, w in steps:
            at, left = int(column[w]), int(row[u])
            if not left or not table[column[v], left >> 3] >> np.uint8(left & 7) & 1:
                continue  # v never comes after u, so nothing ever makes this token
            table[at] = table[column[u]]
            if row[w]:
                of, to = int(row[v]), int(row[w])
                bits = (table[: at + 1, of >> 3] >> np.uint8(of & 7)) & np.uint8(1)
                table[: at + 1, to >> 3] |= bits << np.uint8(to & 7)
            table[column[v], left >> 3] &= clear[left & 7]
            if u == v:  # of three in a row the first two merge
                table[at, left >> 3] &= clear[left & 7]
        return table

    def symbols(self, word: str) -> list[str]:
        """A word as single symbols; the last one carries the mark of the end."""
        return [*word[:-1], word[-1] + self.end] if word else []

    def _plant(self, token: int) -> None:
        """Add a token to the tree: symbols lead to nodes, and a node's token is under the empty symbol."""
        label, node = self.labels[token], self.tree
        whole = label[: len(label) - len(self.end)] if self.end and label.endswith(self.end) else None
        symbols = [*label] if whole is None else self.symbols(whole)
        for symbol in symbols:
            node = node.setdefault(symbol, {})
        node[""] = token

    def encode(self, word: str) -> list[int]:
        """The ids of one pre-split word.  Symbols outside the vocabulary are an error."""
        symbols = self.symbols(word)
        n = len(symbols)
        rows, byte_of, mask_of, row_of, tree = self.rows, self.byte_of, self.mask_of, self.row_of, self.tree
        ids: list[int] = []
        back: list[tuple] = []
        dead: set[int] = set()
        i, row = 0, rows[self.start]
        while i < n:
            arcs, node = [], tree
            for j in range(i, n):
                node = node.get(symbols[j])
                if node is None:
                    break
                if "" in node:
                    arcs.append((node[""], j + 1))
            while True:
                while arcs:
                    token, j = arcs.pop()
                    if row[byte_of[token]] & mask_of[token] and j not in dead:
                        break
                else:
                    # The accepted path does not come by this place.
                    dead.add(i)
                    if not ids:
                        raise ValueError(f"a symbol of {word!r} is not in the vocabulary")
                    ids.pop()
                    i, row, arcs = back.pop()
                    continue
                break
            ids.append(token)
            back.append((i, row, arcs))
            i, row = j, rows[row_of[token]]
        return ids


class Codec:
    """Whole texts to ids, as the tokenizers library does with the file ``data``, which is given as its text.

    The library's own normalizer and pre-tokenizer cut a text into words; the automaton encodes the words.  Words hold no
    white space and no rule of normalising looks across a space, so texts are cut at spaces and line breaks
    first, and each worker remembers the ids of a bounded number of the pieces.  A piece of plain letters, alone or before
    one mark, is a word as it is but for its case, and does not need the library; words are remembered too.
    """

    def __init__(self, data: str, automaton: Automaton) -> None:
        self.tokenizer, self.automaton = Tokenizer.from_str(data), automaton
        self.special = {t["content"]: t["id"] for t in json.loads(data)["added_tokens"]}
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.letters = _byte_letters()
        self.marks = {m: self._other(m) for m in _MARKS}

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, spelled in the vocabulary's letters."""
        pre = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return [w for w, _ in pre if w]

    def _word(self, word: str) -> bytes:
        ids = self.plain.get(word)
        if ids is None:
            spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = array("I", self.automaton.encode(spelled)).tobytes()
            if len(word) <= LONGEST:
                if len(self.plain) > REMEMBERED // 2:
                    self.plain = {}
                self.plain[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        if max(piece) < _FIRST_OTHER:
            lower = piece.lower()
            if lower.isalpha():
                return self._word(lower)
            if piece[-1] in self.marks and lower[:-1].isalpha():
                return self._word(lower[:-1]) + self.marks[piece[-1]]
        return self._other(piece)

    def _other(self, piece: str) -> bytes:
        ids: list[int] = []
        rest = piece
        while True:
            # The leftmost special token; none of them is the start of another.
            found = min(((at, s) for s in self.special if (at := rest.find(s)) >= 0), default=None)
            for word in self.words(rest if found is None else rest[: found[0]]):
                ids += self.automaton.encode(word)
            if found is None:
                return array("I", ids).tobytes()
            ids.append(self.special[found[1]])
            rest = rest[found[0] + len(found[1]) :]

    def _learn(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self._piece(piece)
        if len(piece) <= LONGEST:
            if len(self.known) > REMEMBERED // 2:
                self.older, self.known = self.known, {"": b""}
            self.known[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        pieces = (text or "").replace("\n", " ").split(" ")
        found = list(map(self.known.get, pieces))
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = self.known.get(pieces[i]) or self._learn(pieces[i])
        return b"".join(found)


def arc_labels(described: dict) -> np.ndarray:
    """The label of each id, special tokens included."""
    labels = {i: s for s, i in described["model"]["vocab"].items()} | {t["id"]: t["content"] for t in described["added_tokens"]}
    return np.array([labels.get(i, "") for i in range(max(labels, default=-1) + 1)], object)


def emitted(ids: bytes, labels: np.ndarray) -> str:
    """The labels of the arcs; a file without a decoder has a space between them."""
    return " ".join(labels[np.frombuffer(ids, "<u4")].tolist())


def checked(data: str) -> dict:
    """The description of a vocabulary file, if the automaton can stand for its model."""
    described = json.loads(data)
    model = described["model"]
    odd = {k: model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)}
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in described["added_tokens"])
    if model["type"] != "BPE" or odd or described.get("decoder") or not plain:
        raise ValueError(f"this kind of vocabulary file is not supported: {odd}")
    contents = [t["content"] for t in described["added_tokens"]]
    if any(a != b and a.startswith(b) for a in contents for b in contents) or any(c.split() != [c] for c in contents):
        raise ValueError("special tokens that hold white space or begin with another are not supported")
    return described


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def compiled(path: str) -> tuple[str, Automaton]:
    """The text of a tokenizers file and the automaton of its merges."""
    data = _read(path)
    model = checked(data)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return data, Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")


#: The codecs of this Python worker.
_codecs: dict[str, Codec] = {}


def _codec(data: str, automaton: Automaton) -> Codec:
    if data not in _codecs:
        _codecs[data] = Codec(data, automaton)
        gc.freeze()  # the tree stays; the collector need not walk through it
    return _codecs[data]


def _mapped(rows: DataFrame, schema: str, name: str, kind: pa.DataType, value, size) -> DataFrame:
    """``rows`` (whose last column is judged) with one more column, in batches of bounded size.  Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = weight = 0
            out: list = []
            for i, given in enumerate(batch.column(batch.num_columns - 1)):
                out.append(value(given.as_py()))
                weight += size(out[-1])
                if weight > _BATCH or i + 1 == batch.num_rows:
                    part = batch.slice(begin, len(out))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, kind)], names=[*part.schema.names, name])
                    begin, weight, out = i + 1, 0, []

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: ids as little-endian unsigned 32-bit integers, one row per row of ``docs``.  Map-only.

    A text that is null, empty or white space has no ids.  Special tokens in a text are found as the library finds them.
    Repeated rows and null ids are encoded one by one; other columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(compiled(path))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = _mapped(rows, "doc_id long, text string, ids binary", "ids", pa.large_binary(), lambda text: _codec(*shared.value).encode(text), len)
    return found.select("doc_id", "ids")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, text)``: the labels of ``ids``, special ones included.  Null ids are none.  Map-only."""
    shared = encoded.sparkSession.sparkContext.broadcast(arc_labels(checked(_read(path))))
    rows = encoded.select("doc_id", "ids")
    return _mapped(rows, "doc_id long, ids binary, text string", "text", pa.large_string(), lambda ids: emitted(ids or b"", shared.value), len)
