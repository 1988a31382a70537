"""Selectors with child and sibling combinators and positions: ``body > div > p:nth-child(2)``.

The tree is that of the spans: the parent of an element is the nearest enclosing one, and an element that is not
closed ends at the latest with its parent.  What an element is of itself (tag, class, id, attributes) is tested on
columns; only its place, its span, its tag and the bits of these tests go, in order, through a pass that holds the open
elements of one page.  A chain of steps is a run of bits: an element has the bit of a step if it passes the step's test
and the step before it is a bit of its parent, ancestors, or siblings.  The pass is linear in the elements and gives a
row per page at most.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.operators.tokens import PAGE_END

_TEST = r"(?:\*|[A-Za-z][\w-]*)?(?:[.#][\w-]+|\[[\w-]+(?:=(?:'[^']*'|\"[^\"]*\"|[\w-]+))?\])*"
_STEP = re.compile(rf"\s*([>+~]?)\s*({_TEST})((?::[a-z-]+(?:\([^()]*\))?)*)")
_POSITION = re.compile(r":(first|nth)-(child|of-type)(?:\(\s*([^()]*?)\s*\))?")
_SERIES = re.compile(r"^(?:([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))$")
#: Steps of all chains of a selector: their bits are a BIGINT.
MAX_STEPS = 62


@dataclass(frozen=True)
class Step:
    """``combinator`` to the step before ('' at the start of a chain), own test, and positions ``(of type, a, b)``: an + b."""

    combinator: str
    test: str
    positions: tuple[tuple[bool, int, int], ...]


def _series(text: str) -> tuple[int, int]:
    text = {"odd": "2n+1", "even": "2n"}.get(text.lower(), text.lower())
    match = _SERIES.match(text)
    if match is None:
        raise ValueError(f"unsupported position: {text!r}")
    step, sign, offset, alone = match.groups()
    if alone is not None:
        return 0, int(alone)
    a = int(step + "1") if step in ("", "+", "-") else int(step)
    return a, int(f"{sign or '+'}{offset or 0}")


def parsed(selector: str) -> list[list[Step]]:
    """The chains of a selector list.  ``ValueError`` for what is not supported."""
    chains = []
    for part in re.split(r",(?![^(\[]*[)\]])", selector):
        chain: list[Step] = []
        rest = part.strip()
        at = 0
        while at < len(rest):
            match = _STEP.match(rest, at)
            combinator, test, positions = match.groups()
            found = list(_POSITION.finditer(positions))
            if not (test or positions) or match.end() == at or "".join(m.group(0) for m in found) != positions or (combinator and not chain):
                raise ValueError(f"unsupported selector: {part.strip()!r}")
            series = []
            for m in found:
                if (m.group(1) == "nth") != (m.group(3) is not None):
                    raise ValueError(f"unsupported position: {m.group(0)!r}")
                series.append((m.group(2) == "of-type", *(_series(m.group(3)) if m.group(3) is not None else (0, 1))))
            if chain and not combinator:
                if not rest[at].isspace():
                    raise ValueError(f"unsupported selector: {part.strip()!r}")
                combinator = " "
            chain.append(Step(combinator, test or "*", tuple(series)))
            at = match.end()
        if not chain:
            raise ValueError(f"unsupported selector: {selector!r}")
        chains.append(chain)
    if sum(map(len, chains)) > MAX_STEPS:
        raise ValueError(f"a selector may have {MAX_STEPS} steps at most")
    return chains


def is_structural(selector: str) -> bool:
    """Whether a selector needs the tree: any combinator but white space, or a position."""
    return re.search(r"[>+~:]", re.sub(r"'[^']*'|\"[^\"]*\"", "", selector)) is not None


@dataclass
class _Open:
    """An open element: its end, its bits, those of it and its ancestors, and what is known of its children so far."""

    end: int
    bits: int = 0
    above: int = 0
    children: int = 0
    by_tag: dict[str, int] = field(default_factory=dict)
    last: int = 0
    earlier: int = 0


class Matcher:
    """Goes through the elements of a page in order; ``bits`` of an element say which steps it ends."""

    def __init__(self, chains: list[list[Step]]) -> None:
        steps = [s for chain in chains for s in chain]
        where = {c: sum(1 << i for i, s in enumerate(steps) if s.combinator == c) for c in ("", " ", ">", "+", "~")}
        self.start, self.inside, self.child, self.next, self.later = where.values()
        self.positions = [(1 << i, s.positions) for i, s in enumerate(steps) if s.positions]
        ends = -1
        self.final = 0
        for chain in chains:
            ends += len(chain)
            self.final |= 1 << ends
        self.new_page()

    def new_page(self) -> None:
        self.open = [_Open(PAGE_END)]

    def element(self, pos: int, end: int, tag: str, tests: int, opens: bool) -> int:
        stack = self.open
        while stack[-1].end < pos:
            stack.pop()
        parent = stack[-1]
        parent.children += 1
        of_type = parent.by_tag[tag] = parent.by_tag.get(tag, 0) + 1
        bits = tests & (
            self.start | (self.inside & parent.above << 1) | (self.child & parent.bits << 1) | (self.next & parent.last << 1) | (self.later & parent.earlier << 1)
        )
        for bit, positions in self.positions:
            if bits & bit:
                for by_type, a, b in positions:
                    n = (of_type if by_type else parent.children) - b
                    if n != 0 if a == 0 else n % a != 0 or n // a < 0:
                        bits &= ~bit
        parent.last = bits
        parent.earlier |= bits
        if opens:
            # Not closed, or closed after its parent: it ends with its parent.
            stack.append(_Open(min(end, parent.end), bits, parent.above | bits))
        return bits


def first_matches(spans: DataFrame, selector: str, key: str, condition: Callable[[str], Column]) -> DataFrame:
    """``(key, region)`` of pages with a match: ``struct(rank, pos, end)`` of the first.

    ``condition`` gives the test of an element by itself, such as ``div.x[a='v']``.
    """
    chains = parsed(selector)
    tests = F.lit(0).cast("long")
    for i, step in enumerate(s for chain in chains for s in chain):
        tests = tests + F.when(condition(step.test), 1 << i).otherwise(0)
    elements = spans.where("kind in ('open', 'void', 'raw')").select(
        F.col(key).alias("key"), "pos", "end", "tag", tests.alias("tests"), (F.col("kind") == "open").alias("opens")
    )
    # Pages may be dealt by page and tag: narrow rows are put together by page.
    rows = elements.repartition("key").sortWithinPartitions("key", "pos")
    key_type = spans.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(chains)
        final = matcher.final
        page, begun, done = None, False, False
        for batch in batches:
            keys, found = batch.column(0).to_pylist(), []
            for i, (k, pos, end, tag, tests, opens) in enumerate(zip(keys, *(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                if not begun or k != page:
                    page, begun, done = k, True, False
                    matcher.new_page()
                if not done and matcher.element(pos, end, tag, tests, opens) & final:
                    done = True
                    found.append(i)
            yield batch.take(pa.array(found, pa.int32())).select(["key", "pos", "end"])

    schema = f"key {key_type.simpleString()}, pos long, end long"
    return rows.mapInArrow(run, schema).select(F.col("key").alias(key), F.expr("struct(1 as rank, pos, end) as region"))
