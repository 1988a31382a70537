"""Token ids of whole texts by the tokenizers library, word by word.

The pre-tokenizer of a byte-level vocabulary always cuts a text before a single space that follows and precedes
something other than white space, and on both sides of such a line break.  The pieces between these cuts encode
independently, and most come again and again, so each Python worker remembers the ids of pieces (a bounded number) as
bytes, and the library encodes only new ones: plain words by its model alone, as the pre-tokenizer leaves them whole, what
stands behind them (a run of symbols) once, and others many as lines of one text.  The ids are exactly those of encoding
the whole text; tests compare them.
"""

from __future__ import annotations

import gc
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: Pieces that one worker remembers, and the longest: some 250 MB at most.
REMEMBERED = 1_200_000
LONGEST = 40
#: Where a cut is sure.  U+180E counts as white space in some versions of Unicode.
_CUT = re.compile(r"(?<=[^\s᠎]) (?=[^\s᠎])")


#: Letters below this are letters in every version of Unicode.
_FIRST_OTHER = "\u0250"
#: A single mark after a word is a piece of its own to the pre-tokenizer.
_MARKS = ".,;:!?"
#: So is a run of these; an apostrophe may begin a short form.
_SYMBOLS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and c != 39)
#: Runs of symbols that one worker remembers.
_RUNS = 4_096


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def _sure(piece: str) -> bool:
    """Whether there is a cut on both sides of a piece between spaces."""
    return piece != "" and not (piece[0].isspace() or piece[-1].isspace() or piece[0] == "᠎" or piece[-1] == "᠎")


def _plain(word: str) -> bool:
    """Whether a word is of letters that are letters in every version of Unicode."""
    return word.isalpha() and (word.isascii() or max(word) < _FIRST_OTHER)


class Encoder:
    """``ids(text)`` gives little-endian unsigned 32-bit ids as bytes.  ``path``: a byte-level tokenizers file.

    A piece stands for itself after a space or, if it begins with a line break, for itself alone.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        lines = [e.ids for e in self.tokenizer.encode_batch_fast(["a\na", ".\n.", "1\n1"], add_special_tokens=False)]
        self.line = lines[0][1] if {(len(x), x[1]) for x in lines} == {(3, lines[0][1])} else None
        self.break_id = b"" if self.line is None else np.array([self.line], "<u4").tobytes()
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.space = self.letters[32]
        self.runs: dict[str, bytes] = {}

    def _encode(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _lines(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that hold no line break but one they may begin with."""
        if self.line is None or len(pieces) < 3:
            return self._encode([p if p[0] == "\n" else f" {p}" for p in pieces])
        text = "\n".join([p[1:] if p[0] == "\n" else f" {p}" for p in pieces])
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = [*(4 * np.flatnonzero(ids == self.line)).tolist(), 4 * len(ids)]
        data, at, out = ids.tobytes(), 0, []
        for p, end in zip(pieces, ends, strict=True):
            out.append(self.break_id + data[at:end] if p[0] == "\n" else data[at:end])
            at = end + 4
        return out

    def _word(self, word: str) -> bytes:
        """The ids of a piece that is a plain word, but for the line break it may begin with."""
        before, lead = b"", self.space
        if word[0] == "\n":
            before, lead, word = self.break_id, "", word[1:]
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return before + array("I", [t.id for t in self.model.tokenize(lead + spelled)]).tobytes()

    def _run(self, symbols: str) -> bytes:
        """The ids of a run of symbols after a word."""
        value = self.runs.get(symbols)
        if value is None:
            value = self._encode([symbols])[0]
            if len(self.runs) < _RUNS and len(symbols) <= LONGEST:
                self.runs[symbols] = value
        return value

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces, of which those of usual length are remembered."""
        found, others, odd = {}, [], []
        known, older, tokenize, space = self.known, self.older, self.model.tokenize, self.space
        for p in pieces:
            value = older.get(p)
            if value is None:
                if p.isalpha() and p.isascii():
                    value = array("I", [t.id for t in tokenize(space + p)]).tobytes()
                else:
                    word = p.rstrip(_SYMBOLS)
                    if not _plain(word[1:] if word[:1] == "\n" else word):
                        (odd if "\n" in p[1:] else others).append(p)
                        continue
                    value = known.get(word) or older.get(word) or self._word(word)
                    if len(word) < len(p):
                        value += self._run(p[len(word) :])
            found[p] = value
        if others:
            found |= zip(others, self._lines(others), strict=True)
        if odd:
            found |= zip(odd, self._encode([f" {p}" for p in odd]), strict=True)
        if len(known) + len(found) > self.remembered // 2:
            self.older, self.known = known, {}
        self.known.update(found if max(map(len, found)) <= LONGEST else {p: v for p, v in found.items() if len(p) <= LONGEST})
        return found

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        pieces = (text if self.line is None else text.replace("\n", " \n")).split(" ")
        first, last = pieces.pop(0), b""
        get = self.known.get
        found = list(map(get, pieces))
        new = [] if all(found) else list(dict.fromkeys([p for p, v in zip(pieces, found, strict=True) if not v]))
        # White space at an end of a piece is not printable; few pieces need a closer look.
        if (first and not _sure(f".{first}")) or not all(new) or not all([_sure(p[p[0] == "\n" :]) for p in new if not p.isprintable()]):
            # Beside other white space neither a space nor a line break is a cut.
            pieces = _CUT.split(text)
            first = pieces.pop(0)
            if pieces and not _sure(pieces[-1]):
                last = self._encode([f" {pieces.pop()}"])[0]
            found = list(map(get, pieces))
            new = list(dict.fromkeys([p for p, v in zip(pieces, found, strict=True) if not v]))
        head = self._encode([first])[0]
        if new:
            extra = self.learn(new)
            found = [v or extra[p] for p, v in zip(pieces, found, strict=True)]
        return head + b"".join(found) + last


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
        # Very many small objects and hardly a cycle: the collector need not look so often.
        gc.set_threshold(200_000)
    return _encoders[path]
