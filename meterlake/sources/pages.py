"""Where words come from: plug-ins for pages with a text layer and for scanned pages.

Reading PDFs and recognising text in images needs libraries that are no part of this package. A deployment registers
functions from file contents to words; everything after the words is in ``operators``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import is_useful_text
from ..schemas import WORDS

Reader = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
_READERS: dict[str, Reader] = {}
_LANGUAGES: dict[str, frozenset[str] | None] = {}


def register(kind: str, reader: Reader, languages: set[str] | None = None) -> None:
    """``kind`` is pdf (words of the text layer) or ocr (words of scanned pages, with their confidence). ``languages``: those
    that the reader has data for, if it can tell."""
    _READERS[kind] = reader
    _LANGUAGES[kind] = frozenset(languages) if languages is not None else None


def require(kind: str, settings: Settings = Settings()) -> None:
    """Raises before any job starts if no reader is there, or one without data for a language that is set (as eng+hin)."""
    if kind not in _READERS:
        raise NotImplementedError(f"no reader for {kind} is registered: reading such files needs a library that is not part of this package")
    known = _LANGUAGES[kind]
    missing = [x for x in settings.ocr_language.split("+") if kind == "ocr" and known and x not in known]
    if missing:
        raise RuntimeError(f"the reader has no data for: {', '.join(missing)}; it has: {', '.join(sorted(known))}")


def words(files: DataFrame, kind: str, settings: Settings = Settings()) -> DataFrame:
    """Words of files (doc_id, file_type, content), batch by batch."""
    require(kind, settings)
    return files.select("doc_id", "file_type", "content").mapInPandas(_READERS[kind], WORDS)


def by_strategy(pages: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Pages (doc_id, page, text) whose text layer is worth reading, and pages to be recognised."""
    useful = F.coalesce(is_useful_text(F.col("text"), settings.least_text_chars), F.lit(False))
    return pages.filter(useful), pages.filter(~useful)


def within_limit(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pages of documents with no more pages than allowed."""
    few = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= settings.max_pages).select("doc_id")
    return pages.join(few, "doc_id", "left_semi")
