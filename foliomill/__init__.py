"""foliomill: a table of web pages in, a clean, deduplicated, size-bounded text corpus out, on Spark."""

from foliomill.settings import CorpusSettings

__all__ = ["CorpusSettings"]
