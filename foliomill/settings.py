"""Run settings.  Defaults are the fixed values; every operator takes what it needs as an argument."""

from __future__ import annotations

from dataclasses import dataclass

from foliomill import fixed_values as fv


@dataclass(frozen=True)
class CorpusSettings:
    """Options of one corpus run.

    ``collected_at`` is a parameter and not the clock, so that a run repeated after a lost executor
    writes the same bytes.  ``product`` is the word that opens the banner of a text output.
    """

    fmt: str = "md"
    selector: str | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_pages: int = 0
    min_length: int = fv.MIN_LENGTH
    split_limit: int = fv.SPLIT_LIMIT
    collected_at: str = "1970-01-01T00:00:00+00:00"
    product: str = "FOLIOMILL"
    rows_per_chunk: int = 1_000_000

    def __post_init__(self) -> None:
        if self.fmt not in fv.FORMATS:
            raise ValueError(f"format must be one of {fv.FORMATS}, not {self.fmt!r}")
        if self.split_limit < 1 or self.rows_per_chunk < 1:
            raise ValueError("split_limit and rows_per_chunk must be positive")
